"""The core's operators against small examples and plain Python."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import queries
from corpusloom.operators import bpe, counts, encode, ngrams, pack, quality, segment, vocab


def test_merge_orders():
    words = {"abc": 10, "zbc": 3, "abd": 5}
    assert bpe.merges_of(words, 4)[0] == [("a", "b"), ("ab", "c"), ("ab", "d"), ("b", "c")]
    assert bpe.merges_of(words, 4, lazy=True)[0] == [("a", "b"), ("ab", "c"), ("ab", "d"), ("z", "b")]


def slow_merges(words, n):
    rows, done = {w: (list(w), f) for w, f in words.items()}, []
    while len(done) < n:
        c = {}
        for s, f in rows.values():
            for p in zip(s, s[1:]):
                c[p] = c.get(p, 0) + f
        if not c or max(c.values()) < 2:
            break
        best = min(c, key=lambda p: (-c[p], p))
        done.append(best)
        rows = {w: (merge(s, best), f) for w, (s, f) in rows.items()}
    return done


def merge(s, pair):
    out, i = [], 0
    while i < len(s):
        hit = i + 1 < len(s) and (s[i], s[i + 1]) == pair
        out.append(s[i] + s[i + 1] if hit else s[i])
        i += 1 + hit
    return out


@given(st.dictionaries(st.text("abc", min_size=1, max_size=7), st.integers(1, 9), max_size=8))
@settings(max_examples=80, deadline=None)
def test_merges_are_exact(words):
    assert bpe.merges_of(words, 12)[0] == slow_merges(words, 12)


@given(st.text("abc", max_size=14), st.lists(st.sampled_from([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "a"), ("aa", "b"), ("c", "ab"), ("abc", "a")]), unique=True, max_size=6))
@settings(max_examples=200, deadline=None)
def test_merged_by_rank(word, merges):
    s, rank = list(word), {p: r for r, p in enumerate(merges)}
    while found := [rank[p] for p in zip(s, s[1:]) if p in rank]:
        s = merge(s, merges[min(found)])
    assert encode.Encoder({}, merges).merged(word) == s


def test_letters_of_unknown_core_tokens():
    e = encode.Encoder({"<unk>": 1, "క@@": 5, "ల": 6, "మ@@": 7, "మ": 8})
    assert e.token("కలమ") == [5, 1, 8] and e.token("కమ@@") == [5, 7] and e.token("కల@@") == [5, 6]


def test_encoding_is_pure():
    e = encode.Encoder({"x@@": 4, "y": 5, "y@@": 6})
    assert e.token("xy@@") == [4, 6] and e.token("xy") == [4, 5]


def test_pairs_and_merge(spark):
    w = spark.createDataFrame([("aaa", 2), ("ab", 1), ("", 4)], "word string, freq bigint").select("word", counts.symbols(F.col("word")).alias("symbols"), "freq")
    assert {tuple(r) for r in counts.pair_counts(w).collect()} == {("a", "a", 4), ("a", "b", 1)}
    got = {r["word"]: r["symbols"] for r in counts.merge_pair(w, "a", "a").collect()}
    assert got == {"aaa": ["aa", "a"], "ab": ["a", "b"], "": []}
    got = {r["word"]: r["symbols"] for r in counts.merge_pair(w, "a", "b").collect()}
    assert got["ab"] == ["ab"] and got["aaa"] == ["a", "a", "a"]


def test_vocabulary(spark):
    core = spark.createDataFrame([("కల@@", 5), ("మల", 5), ("ఒక", 1), ("<unk>", 9)], "token string, n bigint")
    sub = spark.createDataFrame([("ab", 3), ("a", 2)], "token string, n bigint")
    v = {r["token"]: (r["id"], r["tier"]) for r in vocab.vocab_ids(core, sub).collect()}
    assert [v[x] for x in ("<pad>", "<unk>", "<eos>", "కల@@", "మల", "ab", "ab@@", "a")] == [(0, 0), (1, 0), (3, 0), (4, 1), (5, 1), (6, 2), (7, 2), (8, 2)]
    assert "ఒక" not in v and sorted(i for i, _ in v.values()) == list(range(len(v)))
    capped = vocab.vocab_ids(core, sub, cap=5)
    assert capped.where("tier = 1").count() == 0 or capped.where("tier = 1").count() <= 1


def test_ids_are_numbered_by_ranges(spark):
    core = spark.createDataFrame([("క" + chr(0xC15 + i % 30) * (1 + i // 30), 2 + i % 7) for i in range(600)], "token string, n bigint").repartition(5)
    v = vocab.vocab_ids(core)
    assert "windowspecdefinition(tier" not in v._jdf.queryExecution().optimizedPlan().toString()
    rows = v.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(rows))) and dict(v.dtypes)["id"] == "int"
    assert [r["token"] for r in rows if r["tier"] == 1] == [r["token"] for r in core.orderBy(F.desc("n"), "token").collect()]


def stream_of(spark, lengths, parts=3):
    rows = [(i, [10 * i + k for k in range(n)]) for i, n in enumerate(lengths)]
    return pack.stream(spark.createDataFrame(rows, "doc_id bigint, ids array<int>").where(F.size("ids") > 0).repartition(parts))


def test_stream_blocks_examples(spark):
    random.seed(1)
    lengths = [random.randrange(0, 9) for _ in range(40)]
    flat = [10 * i + k for i, n in enumerate(lengths) for k in range(n)]
    s = stream_of(spark, lengths)
    assert [r["token_id"] for r in pack.positions(s).orderBy("pos").collect()] == flat
    assert [r["ids"] for r in pack.blocks(s, 4).orderBy("block_id").collect()] == [flat[k : k + 4] for k in range(0, len(flat), 4)]
    got = pack.examples(s, 4).orderBy("block_id").collect()
    assert [(r["x"], r["y"]) for r in got] == [(flat[k : k + 4], flat[k + 1 : k + 5]) for k in range(0, len(flat) - 4, 4)]
    for r in pack.sampled_windows(s, 4, 10).collect():
        assert r["x"] == flat[r["start"] : r["start"] + 4] and r["y"] == flat[r["start"] + 1 : r["start"] + 5]


def test_tail_split(spark):
    s = stream_of(spark, [50, 51])
    n = {(r["doc_id"], r["split"]): r["n"] for r in pack.tail_split(s, 0.02).collect()}
    assert n == {(0, "train"): 50, (1, "train"): 49, (1, "val"): 2}


def test_last_ids(spark):
    assert pack.last_ids(spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [])], "doc_id bigint, ids array<int>"), 3).orderBy("doc_id").collect()[0]["ids"] == [2, 3, 4]


def test_segmenter(spark):
    stems, ends = ["పుస్తక", "గ్రామ", "నగర", "మార్గ", "విమాన"], ["లు", "లో", "ను", "కు"]
    words = spark.createDataFrame([(a + b, 5) for a in stems for b in ends] + [(a, 3) for a in stems], "word string, n bigint")
    low, high = segment.train(words, weight=1.0), segment.train(words, weight=50.0)
    parts = {r["word"]: r["parts"] for r in low.split(words).collect()}
    assert all("".join(p) == w for w, p in parts.items())
    pieces = lambda m: sum(len(r["parts"]) for r in m.split(words).collect())
    assert pieces(high) <= pieces(low)
    docs = spark.createDataFrame([(1, "గ్రామలో IPLగ్రామలో x"), (2, None), (3, " ")], "doc_id bigint, text string")
    split = spark.createDataFrame([("గ్రామలో", 1, ["గ్రామ", "లో"])], "word string, n bigint, parts array<string>")
    assert [tuple(r) for r in segment.segment_documents(docs, split).collect()] == [(1, ["గ్రామ@@", "లో", "IPL@@", "గ్రామ@@", "లో", "x"])]


def test_best_split_is_the_cheapest():
    cost = {"ab": 3.0, "a": 1.0, "b": 1.5, "abc": 9.0, "c": 2.0}
    assert segment.best_split("abc", cost, 20.0, 5) == ["a", "b", "c"]
    assert segment.best_split("abz", {"ab": 2.0, "a": 1.0, "b": 1.0}, 20.0, 5) == ["ab", "z"]  # a tie: fewer parts
    assert segment.best_split("", cost, 1.0, 5) == []


def test_chat(spark):
    rows = [(1, 0, "user", "Q"), (1, 0, "user", "Q"), (1, 1, " Assistant", "A"), (1, 2, "user", None), (2, 0, None, "x"), (3, 0, "bot", "x")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in quality.chat_format(c).collect()] == [(1, "<bos>user: Q\nassistant: A<eos>")]
    assert {(r["role"], r["loss_tokens"]) for r in quality.loss_mask(c).collect()} == {("user", 0), ("assistant", 1)}


def test_duplicates_and_quota(spark):
    d = spark.createDataFrame([(3, "A  b", "x"), (1, "a\nB", "x"), (2, "c", None), (4, None, None)], "doc_id bigint, text string, domain string")
    assert {tuple(r) for r in quality.exact_duplicates(d).collect()} == {(3, 1), (1, 1), (2, 2)}
    assert quality.stratified(d, "domain", 1).count() == 2


def test_ngrams(spark):
    rows = spark.createDataFrame([(1, [5, 6, 7])], "doc_id bigint, ids array<int>")
    g = ngrams.suffix_ngrams(rows).orderBy("pos").collect()
    assert [tuple(r)[2:] for r in g] == [(None, None, 5), (None, 5, 6), (5, 6, 7)]
    h = ngrams.hash_slots(ngrams.suffix_ngrams(rows)).orderBy("pos").collect()
    assert h[2]["slot3"] == ((5 * 1000003) ^ (6 * 8191) ^ (7 * 131071)) % 500009 and h[0]["slot2"] is None


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string, domain string")
    e = spark.createDataFrame([], "doc_id bigint, ids array<int>")
    tokens = spark.createDataFrame([], "token string, n bigint")
    assert counts.core_word_counts(d).count() == 0 and pack.blocks(pack.stream(e), 4).count() == 0
    assert tuple(counts.kept_ratios(tokens).first()) == (0, 0, 0.0, 0)
    assert segment.statistics(spark.createDataFrame([], "word string, n bigint, parts array<string>")).first()["total_word_tokens"] == 0
    assert quality.exact_duplicates(d).count() == 0 and segment.train(spark.createDataFrame([], "word string, n bigint")).counts == {}


def test_registered_merges_are_the_whole_training(spark, tmp_path):
    random.seed(2)
    words = sorted({"".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(600)})
    spark.createDataFrame([(i, " ".join(words)) for i in range(6)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    merges = queries.QUERIES["bpe_train"](spark, str(tmp_path)).orderBy("rank").collect()
    done, left = bpe.merges_of(dict.fromkeys(words, 6), 8000)
    assert len(done) > 1000 and [(r["left"], r["right"]) for r in merges] == done
    assert dict(map(tuple, queries.QUERIES["bpe_subwords"](spark, str(tmp_path)).collect())) == left


def test_a_lexicon_beyond_what_is_sent_stays_whole(spark, monkeypatch):
    random.seed(3)
    stems, ends = ["".join(random.choices("కగచజటడతదనపబమయరలవసహ", k=random.randrange(2, 6))) for _ in range(60)], ["లు", "లో", "ను", "కు", "", "నుండి"]
    rows = sorted({(a + b, 2 + len(a) * len(b)) for a in stems for b in ends} | {("ఱ" * 81, 3), ("ఱ", 2), ("", 4)})
    words = spark.createDataFrame([*rows, ("ఘఙ", 1)], "word string, n bigint")
    learned = lambda m: (m.counts, sorted(map(str, m.split(words).collect())))
    sent = learned(segment.train(words))
    monkeypatch.setattr(segment, "MOST_MORPHS", 3)
    assert learned(segment.train(words)) == sent and len(sent[0]) > 3 and any(len(m) > 1 for m in sent[0])


def test_merges_in_rounds_are_the_same(spark, monkeypatch):
    random.seed(5)
    rows = sorted({("".join(random.choices("abcd", k=random.randrange(1, 7))), random.randrange(1, 9)) for _ in range(25)} | {("aaaa", 7), ("", 9)})
    words = spark.createDataFrame(list(dict(rows).items()), "word string, n bigint")
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    merges, left = bpe.train(words, 11, 2)
    done, want = bpe.merges_of({w: n for w, n in dict(rows).items() if w and n >= 2}, 11)
    assert [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()] == done
    assert dict(map(tuple, left.collect())) == dict(want)


@given(st.text("abc", max_size=10), st.lists(st.tuples(st.sampled_from(["a", "b", "ab", "c"]), st.sampled_from(["a", "b", "c", "bc"])), max_size=5))
@settings(max_examples=100, deadline=None)
def test_merges_applied_in_order(word, merges):
    s = list(word)
    for pair in merges:
        s = merge(s, pair)
    assert bpe.encode_in_order(word, merges) == s


def test_in_order_over_tables(spark):
    w = spark.createDataFrame([("anana", 3), (None, 1), ("", 2)], "word string, freq bigint")
    assert {r["word"]: r["symbols"] for r in bpe.applied_in_order(w, [("a", "n"), ("an", "a")]).collect()} == {"anana": ["an", "ana"], "": []}


def test_prompts_come_from_the_tail(spark):
    s = stream_of(spark, [50, 51])
    flat = [10 * i + k for i, n in enumerate([50, 51]) for k in range(n)]
    got = pack.sampled_prompts(s, 0.2, 4, 5).collect()
    assert len(got) == 5 and all(81 <= r["start"] <= 97 and r["ids"] == flat[r["start"] : r["start"] + 4] for r in got)
    assert pack.sampled_prompts(s, 0.02, 4, 5).count() == 0


def test_offsets_over_odd_rows(spark):
    d = spark.createDataFrame([(3, None), (1, 4), (2, 0), (7, 5)], "doc_id bigint, n bigint")
    assert {r["doc_id"]: r["start"] for r in pack.offsets(d).collect()} == {1: 0, 2: 4, 3: 4, 7: 4}
    assert pack.offsets(d.where("false")).count() == 0


def test_pipeline_round_trip(spark, tmp_path):
    """What the learned pipeline encodes comes back, white space aside, for words whose letters the vocabulary holds."""
    texts = ["గ్రామం గ్రామంలో GSMను పుస్తకం", "గ్రామంలో పుస్తకం the the 1975కి", None, "  ", "పుస్తకం the గ్రామం"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts * 4)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seg = segment.segment_texts(docs, segment.train(counts.core_word_counts(docs)))
    tokens = counts.token_counts(seg)
    merges, symbols = bpe.train(counts.other_counts(tokens).withColumnRenamed("base", "word"), 50, 2)
    v = vocab.vocab_ids(counts.core_counts(tokens), symbols.select(F.col("subword").alias("token"), F.col("frequency").alias("n")))
    assert v.where("tier = 2 AND token = 'the'").count() == 1
    e = encode.Encoder({r["token"]: r["id"] for r in v.collect()}, [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()])
    ids = encode.encoded(seg.select("doc_id", F.array_join("tokens", " ").alias("text")), e, bos=2, eos=3)
    back = {r["doc_id"]: r["text"] for r in encode.decoded(ids, v.select("token", "id")).collect()}
    assert back == {k: " ".join(x.split()) for k, x in enumerate(texts * 4) if x and x.strip()}
    got = queries.QUERIES["pipeline_learned"](spark, str(tmp_path)).collect()
    assert len(got) == 12 and all(r["ids"].endswith(" 3") for r in got)


def test_segmentation_within_the_row_is_the_joined_one(spark):
    words = spark.createDataFrame([("గ్రామలో", 9), ("గ్రామ", 7), ("నగరలో", 6), ("నగర", 5)], "word string, n bigint")
    model = segment.train(words)
    docs = spark.createDataFrame([(1, "గ్రామలో IPLనగరలో@@x  y"), (2, None), (3, " "), (4, "గ్రామలో"), (4, "గ్రామలో")], "doc_id bigint, text string")
    found = docs.where("doc_id < 4").select(F.explode(segment.t.core_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    assert {r[0]: r[1] for r in segment.segment_texts(docs.where("doc_id < 4"), model).collect()} == {r[0]: r[1] for r in segment.segment_documents(docs.where("doc_id < 4"), model.split(found)).collect()}
    assert segment.segment_texts(docs, model).count() == 3


def test_hot_texts_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "COPIES", 2)
    d = spark.createDataFrame([(k, "a b" if k % 2 else f"c{k}") for k in range(10)] + [(20, " "), (21, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in quality.exact_duplicates(d).collect()} == {(k, 1 if k % 2 else k) for k in range(10)} | {(20, 20), (21, 20)}


def test_losses_and_quotas(spark):
    d = spark.createDataFrame([(1, "a a b", "s"), (2, "z", "s"), (3, None, "s"), (4, "a", "t"), (5, "a", None)], "doc_id bigint, text string, source string")
    teacher = quality.unigram_loss(d, counts.piece_counts(d), "teacher")
    student = quality.unigram_loss(d, counts.piece_counts(d.where("doc_id = 4")), "student")
    assert {r[0] for r in teacher.collect()} == {1, 2, 4, 5} and {r["doc_id"]: r["student"] for r in student.collect()}[4] == round(__import__("math").log2(3 / 2), 6)
    assert 0 < quality.hard_set(teacher, student, 0.5).count() < 4
    s = spark.createDataFrame([("s", 0.6), ("t", 0.4), ("u", None)], "source string, target_share double")
    assert sorted(r["source"] for r in quality.source_quotas(d, s, 4).collect()) == ["s", "s", "t"]
    assert quality.source_quotas(d.where("false"), s, 4).count() == 0


def test_types_and_masks(spark):
    rows = [(1, 0, "user", "Why?"), (1, 1, "assistant", "A b"), (2, 0, "user", "do:\n- x"), (3, 0, "User", "go on"), (4, 0, "user", "this is a long one"), (5, 0, "assistant", "x")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert {tuple(r) for r in quality.instruction_types(c).collect()} == {(1, "question"), (2, "list"), (3, "short"), (4, "statement")}
    got = [(r["token"], r["loss"]) for r in quality.loss_mask_tokens(c).where("conv_id = 1").orderBy("turn", "pos").collect()]
    assert got == [("Why?", 0), ("A", 1), ("b", 1), ("<eos>", 1)]


def test_heads_and_shares(spark):
    g = ngrams.suffix_ngrams(spark.createDataFrame([(1, [5, 6, 7]), (2, [])], "doc_id bigint, ids array<int>"))
    h = {(r["pos"], r["order"], r["head"]): r["slot"] for r in ngrams.hash_heads(g).collect()}
    assert len(h) == 8 * (2 + 1) and h[2, 3, 4] == ((7 * ngrams.HEADS[4][0]) ^ (6 * ngrams.HEADS[4][1]) ^ (5 * ngrams.HEADS[4][2])) % 500009
    assert len({ngrams.HEADS[k] for k in range(8)}) == 8
    top = ngrams.cumulative(ngrams.skew(g)).collect()
    assert [(r["n"], r["share_of_occurrences"]) for r in top] == [(1, 1.0)]


def test_guards(spark):
    d = spark.createDataFrame([(1, "కలమల  కలమల"), (2, "కలమల"), (3, None), (4, "కలమలక")], "doc_id bigint, text string")
    half = lambda w: segment.t.split_after(w, 3, 2)
    giant, tokens = segment.guarded_text(F.col("text"), half, 5)
    got = {r[0]: (r[1], r[2]) for r in d.select("doc_id", giant, tokens).collect()}
    assert got == {1: (True, ["కలమల", "కలమల"]), 2: (False, ["కల@@", "మల"]), 3: (None, None), 4: (False, ["కల@@", "మలక"])}
    assert [r[0] for r in d.where("doc_id in (2, 4)").orderBy("doc_id").select(segment.guarded_word(F.col("text"), half, 4)).collect()] == [["కల", "మల"], ["కలమలక"]]
