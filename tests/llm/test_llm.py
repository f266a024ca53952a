"""The operators for training data: golden cases, brute force, and odd tables."""

import random
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


from corpusloom.llm import budget, confusables, langid, mixing, neardup, packing, termfreq, tiling, truncation
from corpusloom.plans import tables

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, domain string, shard int, fetched_at timestamp, loaded_at timestamp, id int, n int, words string, value string, key string, tokens string, bag string, rep int, start int"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own; all but id, text, lang and source are null."""
    return spark.createDataFrame([(*r, *[None] * (18 - len(r))) for r in rows], DOCS)


LONG = "కల మల ఒక చాలా ఇది. " * 30_000
ODD = [(1, None, None, None), (2, "", "te", "A-b"), (3, " \n\t", "und", "a_b "), (4, "కల మల", None, None), (4, "కల మల", None, None), (None, "కల", "te", None), (5, LONG, "te", "a_b"), (6, ".. — !", "zz", "x"), (7, "​ ­", "en", "x")]


@pytest.fixture
def odd(spark):
    return table(spark, ODD)


@pytest.fixture
def none(spark):
    return table(spark, [])


@pytest.fixture
def samples(spark):
    from corpusloom.llm.labels import LANGS

    text = {"te": "మరియు ఈ ఒక చాలా ఉంది గ్రామం", "te_latn": "mariyu ee oka chaalaa undi graamam", "en": "the and of is village water", "hi": "और यह एक बहुत है गाँव", "kn": "ಮತ್ತು ಈ ಒಂದು ತುಂಬಾ ಇದೆ ಗ್ರಾಮ", "ta": "மற்றும் இந்த ஒரு மிகவும் உள்ளது கிராமம்", "mr": "आणि हा एक खूप आहे गाव"}
    return spark.createDataFrame([(k, g, text[g]) for k, g in enumerate(LANGS)], "sample_id bigint, lang string, text string")


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([("a_b", "v/tel", 0.5, 2, None), ("x", "h/tel", 0.3, None, None), ("gone", None, 0.2, 3, None), ("out", "o", None, None, None)], "source string, data_dir string, target_share double, max_repeats int, tokens string")


@pytest.fixture
def tokenizer(spark):
    ids = {"<pad>": 0, "<unk>": 1, "<bos>": 2, "<eos>": 3, "కల": 4, "కల@@": 5, "క@@": 6, ".": 7, "a": 8, "ab": 9, "ab@@": 10, "మ@@": 11, "ల": 12}
    return spark.createDataFrame([("2.0", "t", 13, "@@", {"<unk>": 1}, ids, [["a", "b"]])], "version string, type string, vocab_size int, separator string, special_tokens map<string,int>, token_to_id map<string,int>, bpe_merges array<array<string>>")


# 1


def test_terms(spark, odd, none):
    c = {r["token"]: r for r in termfreq.counts_by_dictionary(odd, {"కల": 4, "zz": 9}).collect()}
    assert (c["కల"]["occurrences"], c["కల"]["documents"], c["కల"]["all_documents"]) == (30_003, 4, 6)
    assert c["zz"]["documents"] == 0
    assert {tuple(r) for r in termfreq.marks(termfreq.counts_by_dictionary(odd, {"కల": 4, "zz": 9})).collect()} == {("కల", "common"), ("zz", "rare")}
    got = termfreq.counts_of_all_terms(odd).collect()
    want, docs = Counter(), Counter()
    for _, t, *_ in ODD:
        want.update((t or "").split())
        docs.update(set((t or "").split()))
    assert {r["token"]: (r["occurrences"], r["documents"]) for r in got} == {w: (want[w], docs[w]) for w in want}
    assert sorted(r["term_id"] for r in got) == list(range(len(want)))
    assert termfreq.counts_of_all_terms(none).count() == 0
    assert [r["documents"] for r in termfreq.counts_by_dictionary(none, {"a": 4}).collect()] == [0]


def test_ranges_of_ids(spark, odd):
    ids = {f"t{k}": 3 * k for k in range(2500)} | {"కల": 5000, "మల": 8}
    got = {r["token"]: r["documents"] for r in termfreq.counts_by_dictionary(odd, ids).collect()}
    assert len(got) == len(ids) and got["కల"] == 4 and got["మల"] == 3 and sum(got.values()) == 7


def test_dictionary_of_many_ranges(spark, odd, monkeypatch):
    monkeypatch.setattr(termfreq, "RANGE_TERMS", 2)
    monkeypatch.setattr(termfreq, "BLOCK_TERMS", 3)
    want, docs = Counter(), Counter()
    for _, t, *_ in ODD:
        want.update((t or "").split())
        docs.update(set((t or "").split()))
    got = termfreq.counts_of_all_terms(odd).collect()
    assert {r["token"]: (r["occurrences"], r["documents"]) for r in got} == {w: (want[w], docs[w]) for w in want} and sorted(r["term_id"] for r in got) == list(range(len(want)))
    ids = {"కల": 4, "zz": 9, "మల": 7}
    sent = sorted(termfreq.counts_by_dictionary(odd, ids).collect())
    monkeypatch.setattr(termfreq, "MOST_GIVEN", 1)
    assert sorted(termfreq.counts_by_dictionary(odd, ids).collect()) == sent


# 2


def test_languages(spark, samples, odd, none):
    s = langid.samples_of(samples)
    te, en = "మరియు ఈ ఒక చాలా ఉంది గ్రామం మరియు ఈ గ్రామం.", "The village and the water of the village is."
    d = table(spark, [(1, te + " " + en, "te", None), (2, te, "TE", None), (3, en, "und", None), (4, te[:-1] + " “the water of village” ఉంది.", "tel", None), (5, te.replace("గ్రామం", "గ్ರామం"), None, None)])
    assert {tuple(r) for r in langid.unnamed(d, s).collect()} == {(1, "en"), (3, "en"), (5, "te")}
    seg = langid.segments(d, s).where("doc_id = 1").orderBy("segment").collect()
    assert [(r["lang"], r["start"], r["pieces"]) for r in seg] == [("te", 0, 9), ("en", 9, 9)] and all(0 < r["confidence"] <= 1 for r in seg)
    top = {r["doc_id"]: r["lang"] for r in langid.languages(langid.segments(d, s)).collect()}
    assert top[2] == "te" and top[3] == "en"
    for x in (odd, none):
        langid.unnamed(x, s).collect(), langid.languages(langid.segments(x, s)).collect()
    assert langid.unnamed(none, s).count() == 0
    assert langid.segments(odd, s).where("doc_id = 5").agg(F.sum("pieces")).first()[0] == 150_000


def ppm(text: str, context: bytes, byte: int) -> float:
    """Bits of a byte by the definition: escapes by the number of distinct bytes, bytes of longer contexts excluded."""
    data, bits, out = b" " + b"".join(map(langid.piece_bytes, text.split())), 0.0, set()
    for n in range(min(langid.ORDER, len(context)), -1, -1):
        c = context[len(context) - n :]
        seen = Counter(data[i] for i in range(1, len(data)) if i >= n and data[i - n : i] == c)
        kept = {x: k for x, k in seen.items() if x not in out}
        total = sum(kept.values()) + len(kept)
        if byte in kept:
            return bits + np.log2(total / kept[byte])
        if kept:
            bits += np.log2(total / len(kept))
        out |= set(kept)
    return bits + np.log2(256 - len(out))


def lengths(tree, context: bytes) -> np.ndarray:
    c = int.from_bytes(context[-langid.ORDER :], "big")
    return tree.bits(np.array([c << 8 | b for b in range(256)], np.uint64))


@pytest.mark.parametrize("text", ["the then them", "కల మల కల ఇది", "a", "ab abab b"])
def test_code_lengths_are_probabilities(text):
    tree = langid.train([("en", text)])[langid.LANGS.index("en")]
    for context in (b" ", b" th", b"zz", b" then th", b"n t", "కల మ".encode(), b"ab a", b" the t"):
        got = lengths(tree, context)
        assert (2.0**-got).sum() == pytest.approx(1, abs=1e-9)
        assert all(got[b] == pytest.approx(ppm(text, context[-langid.ORDER :], b)) for b in (0x20, ord("t"), ord("e"), 0xE0, 0xB0, 1))


def test_lengths_of_a_sentence_add_up_across_blanks():
    s = langid.Scorer(langid.train([("en", "the then them there")]))
    *_, words, bits = langid.sentences(["The, then 12 qua. them"], s)
    data = b" the then qua "
    want = sum(ppm("the then them there", data[max(0, i - langid.ORDER) : i], data[i]) for i in range(1, len(data)))
    assert bits[0, langid.LANGS.index("en")] == pytest.approx(want, rel=1e-5) and words.tolist() == [4, 1]


# 3


def test_budget(spark, odd, none, sources, tokenizer):
    spec = budget.spec_of(tokenizer)
    d = table(spark, [(1, "కల కల. కమ ab abab q", "TE", "A-B"), (2, "కల", None, "other"), (3, None, "te", "a_b")])
    n = {r["doc_id"]: r["n_tokens"] for r in budget.document_tokens(d, spec).collect()}
    assert n == {1: 1 + 2 + 2 + 1 + 2 + 1, 2: 1, 3: 0}
    rows = {(r["source"], r["lang"]): r for r in budget.token_budget(d, sources, spec).collect()}
    assert rows["a_b", "te"]["tokens"] == 9 and rows["a_b", "te"]["data_dir"] == "v/tel" and rows["a_b", "te"]["documents"] == 2
    assert rows["other", None]["data_dir"] is None
    assert budget.token_budget(none, sources, spec).count() == 0
    total = budget.token_budget(odd, sources, spec).agg(F.sum("tokens"), F.sum("documents")).first()
    assert total[0] == budget.document_tokens(odd, spec).agg(F.sum("n_tokens")).first()[0] and total[1] == len(ODD)
    assert budget.rolled_up(budget.token_budget(odd, sources, spec)).where("level = 'all'").first()["tokens"] == total[0]


# 4


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=150, deadline=None)
def test_packing_keeps_all(lengths):
    n = np.array(lengths, np.int64)
    first = packing.best_fit(n, 40)
    bins = packing.pack(n, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(n)))
    assert all(n[b].sum() <= 40 for b in bins) and len(bins) <= len(first)


def test_search_empties_bins():
    n = np.array([6, 6, 4, 4, 5, 5, 3, 3, 2, 2], np.int64)
    assert len(packing.improve(n, [[0, 2], [1, 3], [4, 6], [5, 7], [8, 9]], 10)) == 4
    assert len(packing.improve(np.array([5, 5, 4, 6], np.int64), [[0, 2], [1], [3]], 10)) == 2


def test_search_takes_two_back_from_bins_of_many():
    n = np.array([5] + [2] * 14 + [26], np.int64)
    assert len(packing.improve(n, [[0], list(range(1, 15)), [15]], 30)) == 2


def test_search_gives_two_of_many():
    n = np.array([2] * 65 + [3, 996] * 130, np.int64)
    bins = packing.improve(n, [list(range(65)), *([k, k + 1] for k in range(65, len(n), 2))], 1000)
    assert min(int(n[b].sum()) for b in bins) == 98 and sorted(i for b in bins for i in b) == list(range(len(n)))


def test_search_raises_squared_fills_most():
    n = np.array([4, 3, 20, 97], np.int64)
    assert sorted(int(n[b].sum()) for b in packing.improve(n, [[0, 1], [2], [3]], 100)) == [24, 100]


@pytest.mark.parametrize("seed", [0, 1, 2, 6])
def test_search_reaches_the_bound(seed):
    n = np.random.default_rng(seed).integers(20, 120, 400)
    first = packing.best_fit(n, 256)
    bins = packing.improve(n, first, 256)
    assert len(bins) < len(first) and len(bins) == packing.least_bins(n, 256) and sorted(i for b in bins for i in b) == list(range(400))


def test_search_goes_back_to_stuck_bins():
    n = np.array([7, 4, 3, 96, 97, 93], np.int64)  # 7 fits nowhere until 97 and 4 or 93 have met
    assert len(packing.improve(n, [[0], [1, 2], [3], [4], [5]], 100)) == 3


@given(st.lists(st.integers(1, 20), max_size=12))
@settings(max_examples=100, deadline=None)
def test_bound_of_bins(lengths):
    n = np.array(lengths, np.int64)
    assert -(-int(n.sum()) // 20) <= packing.least_bins(n, 20) <= len(packing.best_fit(n, 20))


def test_packed(spark, monkeypatch):
    configs = spark.createDataFrame([("c", 10, 0), ("none", None, 1), ("zero", 0, 1)], "config_name string, block_size int, n int")
    lengths = spark.createDataFrame([(1, 25), (2, 4), (3, 0), (4, 6), (None, 3), (2, 4)], "doc_id bigint, n bigint")
    rows = packing.packed(lengths, configs, 1).collect()
    per = Counter()
    for r in rows:
        per[r["block_id"]] += r["tokens"]
    assert max(per.values()) <= 10 and sum(per.values()) == 42 and {r["doc_id"] for r in rows if r["part"]} == {1} and None in {r["doc_id"] for r in rows}
    assert packing.summary(packing.packed(lengths, configs, 1), configs).first()["blocks"] == len(per) == 5
    assert packing.packed(lengths.where("false"), configs, 2).count() == 0 and packing.packed(lengths, configs.where("false"), 2).count() == 0
    monkeypatch.setattr(packing, "MOST_CONFIGS", 1)
    two = spark.createDataFrame([("c", 10), ("d", 30)], "config_name string, block_size int")
    assert sorted(map(str, packing.packed(lengths, two, 1).where("config_name = 'c'").collect())) == sorted(map(str, rows))


# 5


def brute(rows, percent=80):
    sets = sorted({(i, t): neardup.as_set(t) for i, t in rows if i is not None and t and not t.isspace()}.items())
    return {(min(i, j), max(i, j)) for k, ((i, _), a) in enumerate(sets) for (j, _), b in sets[k + 1 :] if i != j and len(np.intersect1d(a, b)) * 100 >= percent * max(len(a), len(b))}


def test_near_duplicates(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(400)] + ["the", "of", "is"] * 40
    rows = []
    for k in range(60):
        base = [r.choice(vocab) for _ in range(r.choice([1, 3, 5, 6, 9, 12, 30, 80, 300]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.choice([0, 1, 3])):
            new = [r.choice(vocab) if r.random() < r.choice([0, 0.02, 0.1, 0.19, 0.22]) else w for w in base]
            new = new[: int(len(new) * r.choice([1, 1, 0.95, 0.85, 0.8]))]
            r.shuffle(new)
            rows.append((len(rows), " ".join(new).upper().replace(" ", ",  ", r.choice([0, 2]))))
    rows += [(900, None), (901, ""), (902, " "), (903, "!"), (904, "?"), (None, "a b c d e f"), (0, rows[0][1])]
    d = table(spark, [(i, t, None, None) for i, t in rows])
    got = [tuple(x) for x in neardup.similar_pairs(d).collect()]
    assert len(got) == len(set(got)) and set(got) - {(903, 904)} == {p for p in brute(rows) if p != (903, 904)} and (903, 904) in got
    g = {x["doc_id"]: x for x in neardup.groups(d).collect()}
    assert all(g[a]["group_id"] == g[b]["group_id"] for a, b in got) and min(x["group_id"] for x in g.values()) == 0
    links = {(g[a]["class_id"], g[b]["class_id"]) for a, b in got if g[a]["class_id"] != g[b]["class_id"]}
    links = {(min(p), max(p)) for p in links}
    assert all(g[c]["links"] == sum(c in p for p in links) for c in {x["class_id"] for x in g.values()})


def test_hot_keys_and_classes_are_split(spark, monkeypatch):
    """Every key over a few documents goes to a grid of parts, units hold a few keys, and classes of three are joined apart; no pair is lost."""
    for name, value in (("HOT", 3), ("UNIT", 40), ("BUCKET", 3000), ("COPIES", 2)):
        monkeypatch.setattr(neardup, name, value)
    r = random.Random(5)
    foot = "share this page with all your friends today please".split()
    rows = []
    for _ in range(70):
        base = [f"w{r.randrange(60)}" for _ in range(r.choice([4, 6, 8, 12, 40]))] + (foot if r.random() < 0.5 else [])
        for _ in range(r.choice([1, 1, 2, 4])):
            rows.append((len(rows), " ".join(w if r.random() > 0.06 else f"w{r.randrange(60)}" for w in base)))
    rows += [(len(rows) + k, "one two three four five") for k in range(6)]
    d = table(spark, [(i, t, None, None) for i, t in rows])
    got = [tuple(x) for x in neardup.similar_pairs(d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    g = {x["doc_id"]: x for x in neardup.groups(d).collect()}
    assert len(g) == len(rows) and all(g[a]["group_id"] == g[b]["group_id"] for a, b in got)


@given(st.integers(0, 2**32), st.integers(1, 40))
@settings(max_examples=40, deadline=None)
def test_grid_lets_every_entry_meet_every_probe(seed, hot):
    r = np.random.default_rng(seed)
    n = r.integers(5, 9, 30)
    tok = np.concatenate([np.sort(r.choice(12, k, replace=False)) for k in n]).astype(np.uint64)
    doc, band = np.repeat(np.arange(len(n)), n), np.full(len(n), 3)
    df = np.bincount(tok.astype(np.int64), minlength=neardup.CELLS).astype(float)
    budget = np.full(len(n), 3)
    meet = {}
    for h in (10**9, hot):
        parts = neardup.parts_of(np.arange(5), np.full(5, 30.0), 80, h)
        key, owner, kind = neardup.entries(n, doc, tok, band, budget, df, 30.0, 80, True, parts)
        by = {}
        for k, o, f in zip(key.tolist(), owner.tolist(), kind.tolist()):
            by.setdefault(k, []).append((o, f))
        meet[h] = {(a, b) for rows in by.values() for a, fa in rows if fa & 2 for b, fb in rows if not fb & 8 and a != b and (fa & 1 and (fb & 1 or fa & 4) or not fa & 1 and fb & 1)}
    assert meet[10**9] == meet[hot]


def test_odd_near_duplicates(spark, odd, none):
    assert neardup.similar_pairs(none).count() == 0 and neardup.groups(none).count() == 0
    assert {x["doc_id"] for x in neardup.groups(odd).collect()} == {4, 5, 6, 7}
    same = table(spark, [(i, "a b c d e", None, None) for i in range(30)])
    assert neardup.similar_pairs(same).count() == 30 * 29 // 2


@given(st.lists(st.integers(0, 2**63), unique=True, min_size=1, max_size=60), st.lists(st.integers(0, 2**63), unique=True, min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_bitmaps_bound_the_difference(a, b):
    rows = neardup.bitmaps(np.repeat([0, 1], [len(a), len(b)]), np.array(a + b, np.uint64), 2, 4)
    assert np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(set(a) ^ set(b))


# 6


@pytest.mark.parametrize(
    ("word", "folded"),
    [
        ("kаrfоѕ", "karfos"), ("Мау", "May"), ("α", "α"), ("“Δ”,", "“Δ”,"), ("పంಡుగ", "పండుగ"), ("ಕನ್ನడ", "ಕನ್ನಡ"), ("ఫోన్‌లు", "ఫోన్‌లు"), ("a‌b", "ab"), ("కల‌", "కల"), ("ﬂag", "flag"), ("ＫＶ１", "KV1"),
        ("café", "café"), ("ज़", "ज़"), ("ज़", "ज़"), ("ై", "ై"), ("a­b​﻿", "ab"), ("IPLలో", "IPLలో"), ("�", "�"), ("–", "–"), ("привет", "привет"), ("", ""),
    ],
)
def test_fold(word, folded):
    assert confusables.fold(word) == folded and confusables.fold(folded) == folded


@given(st.text(max_size=12))
@settings(max_examples=300, deadline=None)
def test_fold_is_stable(s):
    once = confusables.fold(s)
    assert unicodedata.normalize("NFC", once) == once or not confusables._suspect.search(s)


def test_variants(spark, odd, none, monkeypatch):
    d = table(spark, [(1, "kаrfоѕ x", None, None), (2, "a\u00a0b", None, None), (3, "plain  text\n", None, None), (4, "ఫోన్‌లు α", None, None), (5, "karfos", None, None), (6, None, None, None), (7, "café ఫోన్​లు", None, None)])
    assert {r[0] for r in confusables.variant_documents(d).collect()} == {1, 2, 7}
    t = {r["doc_id"]: r["text"] for r in confusables.canonical_texts(d).collect()}
    assert t == {1: "karfos x", 2: "a b", 3: "plain  text\n", 4: "ఫోన్‌లు α", 5: "karfos", 6: None, 7: "café ఫోన్లు"}
    monkeypatch.setattr(tables, "HOT", 0)
    assert {r[0] for r in confusables.variant_documents(d).collect()} == {1, 2, 7}
    assert {r["doc_id"]: r["text"] for r in confusables.canonical_texts(d).collect()} == t
    assert {r[0] for r in confusables.variant_documents(odd).collect()} == {7}
    assert confusables.variant_documents(none).count() == 0 and confusables.canonical_texts(none).count() == 0


def test_classes_decide(spark):
    """Composed and decomposed spellings and invisible characters meet by the collation alone; the most frequent usual spelling stands for the class."""
    nfd = unicodedata.normalize("NFD", "café")
    assert confusables.classes_of(nfd) == [(nfd, "café")] and confusables.classes_of("ca\u200bf")[0][0] == "ca\u200bf"
    d = table(spark, [(1, nfd + " ca\u200bfé x", None, None), (2, "café Café", None, None), (3, "పంಡుಗು ಕ\u200bಲ", None, None), (4, "కಲ", None, None), (5, "ಕಲ ಕಲ కల", None, None), (6, "Мау", None, None), (7, "ഉனம் ૨०१", None, None)])
    got = {r["value"]: r["canonical"] for r in confusables.canonical_values(d).collect()}
    assert got[nfd] == got["ca\u200bfé"] == "café" and got["కಲ"] == "ಕಲ" and got["ಕ\u200bಲ"] == "ಕಲ" and got["Мау"] == "May"
    assert got["ഉனம்"] == "உனம்" and got["૨०१"] == "२०१" and "Café" not in got and "కల" not in got
    # the same word goes to Telugu where Telugu texts have it more often
    more = table(spark, [(4, "కಲ", None, None), (5, "ಕಲ కల కల", None, None)])
    assert {r["value"]: r["canonical"] for r in confusables.canonical_values(more).collect()} == {"కಲ": "కల"}


def test_texts_without_an_id(spark):
    d = table(spark, [(None, "kаrfоѕ x", None, None), (None, "y kаrfоѕ\u00a0a", None, None), (None, None, None, None), (1, "kаrfоѕ", None, None), (1, "z kаrfоѕ", None, None)])
    assert sorted(map(str, confusables.canonical_texts(d).select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(None, "karfos x"), (None, "y karfos a"), (None, None), (1, "karfos"), (1, "z karfos")])


# 7


def longest_run(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)


@given(st.lists(st.integers(1, 4), max_size=14), st.lists(st.integers(1, 4), max_size=14))
@settings(max_examples=150, deadline=None)
def test_tiles(a, b):
    tiles = tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), 2)
    best = longest_run(a, b)
    assert (tiles[0][2] if tiles else 0) == (best if best >= 2 else 0)
    for side in (0, 1):
        used = [t[side] + k for t in tiles for k in range(t[2])]
        assert len(used) == len(set(used))
    assert all(a[p : p + n] == b[q : q + n] for p, q, n in tiles)


def greedy(a, b, least):
    """Tiling by its definition: the longest unmarked common run, the first places first, again and again."""
    free, tiles = [[True] * len(a), [True] * len(b)], []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free[0][i + n] and free[1][j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append((i, j, n))
        for k in range(n):
            free[0][i + k] = free[1][j + k] = False


@given(st.lists(st.integers(1, 4), max_size=14), st.lists(st.integers(1, 4), max_size=14), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_tiles_by_definition(a, b, least):
    assert tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), least) == greedy(a, b, least)


def test_tiling_of_repetitive_texts_is_fast():
    r = random.Random(2)
    words = lambda n: np.array([k % 5 + 1 if r.random() > 0.02 else 100 + r.randrange(50) for k in range(n)], np.uint64)
    began = time.process_time()
    tiles = tiling.tile(words(400), words(8000), 5)
    assert time.process_time() - began < 2 and sum(n for *_, n in tiles) > 200


def test_leaks(spark, odd, none, monkeypatch):
    w = [f"w{k}" for k in range(20)]
    items = spark.createDataFrame([(1, " ".join(w), 0), (2, " ".join(w).upper() + "!", 0), (3, None, 0), (4, "", 0), (5, "one two three", 0)], "item_id bigint, text string, doc_id int")
    d = table(spark, [(10, "x y " + ",\n".join(w[3:14]) + " z", None, None), (11, " ".join(w[:9]) + " q " + " ".join(w[9:18]), None, None), (12, " ".join(w[10:] + w[:10]), None, None), (13, "z two  Three.", None, None), (14, None, None, None)])
    pairs = tiling.leaks(d, items)
    monkeypatch.setattr(tiling, "ITEMS", 2)
    assert sorted(tiling.leaks(d, items).collect()) == sorted(pairs.collect())
    assert {tuple(r) for r in tiling.leaked(pairs).collect()} == {(10, 1), (10, 2), (12, 1), (12, 2), (13, 5)}
    assert pairs.where("doc_id = 12 and item_id = 1").first()["covered"] == 20
    assert {(r[0], r[1]): r[2] for r in tiling.covered(pairs).collect()}[11, 1] == 0.9
    assert tiling.leaks(none, items).count() == 0 and tiling.leaks(odd, items.where("false")).count() == 0
    assert {r["doc_id"] for r in tiling.leaks(odd, spark.createDataFrame([(1, "కల మల ఒక చాలా ఇది కల")], "item_id bigint, text string")).collect()} >= {5}


# 8


def test_public_tokens():
    enc = mixing._tokenizer(mixing.VOCABULARY)[0]
    for s in ("a b\nc", "  two  spaces\n\n", "తెలుగు మాట, it's 2024!", "", "x y z", "\n", " ", "a\n b"):
        assert mixing.text_tokens(s) == len(enc.encode_ordinary(s))


@given(st.text(alphabet="ab1, \n\t క్’'", max_size=30))
@settings(max_examples=200, deadline=None)
def test_any_public_tokens(s):
    assert mixing.text_tokens(s) == len(mixing._tokenizer(mixing.VOCABULARY)[0].encode_ordinary(s))


def test_mixture(spark, odd, none, sources):
    d = table(spark, [(i, "word " * 10, None, "A-B" if i % 2 else "x") for i in range(400)])
    sizes = mixing.document_sizes(d)
    rated = mixing.rates(sizes, sources)
    rate = {r["key"]: r["rate"] for r in rated.collect()}
    assert rate["a_b"] == pytest.approx(1.0) and rate["x"] == pytest.approx(0.6) and rate["gone"] == 0 and "out" not in rate
    assert {r[0] for r in mixing.short_sources(sizes, rated).collect()} == {"gone"}
    n = Counter(r["source"] for r in mixing.mixed(sizes, rated).collect())
    assert n["a_b"] == 200 and 90 < n["x"] < 150
    assert mixing.mixed(sizes.repartition(7), rated).count() == sum(n.values())
    out = {r["source"]: r for r in mixing.shares(sizes, rated).collect()}
    assert sum(r["actual_share"] for r in out.values()) == pytest.approx(1, abs=1e-4) and out["gone"]["actual_share"] == 0
    for x in (odd, none):
        s = mixing.document_sizes(x)
        mixing.mixed(s, mixing.rates(s, sources)).collect(), mixing.shares(s, mixing.rates(s, sources)).collect()
    e = mixing.document_sizes(none)
    assert {r[0] for r in mixing.short_sources(e, mixing.rates(e, sources)).collect()} == set()


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5), st.integers(1, 60)), min_size=1, max_size=6))
@settings(max_examples=6, deadline=None)
def test_short_sources_by_the_rule(spark, rows):
    """The sources that the mix leaves short are those whose documents, repeated as allowed, hold too little."""
    docs = [(100 * k + j, f"s{k}", 3 + j % 4) for k, (n, _, _) in enumerate(rows) for j in range(n)]
    sizes = spark.createDataFrame(docs, "id bigint, source string, tokens bigint")
    whole = sum(w for _, _, w in rows)
    sources = spark.createDataFrame([(f"s{k}", w / whole, m) for k, (_, m, w) in enumerate(rows)], "source string, target_share double, max_repeats int")
    total = sum(t for *_, t in docs)
    want = {f"s{k}" for k, (_, m, w) in enumerate(rows) if m * sum(t for _, s, t in docs if s == f"s{k}") < w / whole * total}
    assert {r[0] for r in mixing.short_sources(sizes, mixing.rates(sizes, sources)).collect()} == want


# 9


def test_cut_texts(spark, odd, none):
    r = random.Random(1)
    words = ["".join(r.choice("aeioubcdfg") for _ in range(6)) for _ in range(200)]
    sentence = lambda: " ".join(r.choice(words) for _ in range(8)) + "."
    whole = [(i, "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(3)), "en", "s") for i in range(200)]
    cut = [(300 + i, w[1][: len(w[1]) - 7 - i], "en", "S ") for i, w in enumerate(whole[:12])]
    debris = [(400, whole[0][1][:-30] + " <", "en", "s"), (401, whole[1][1][:-30] + "�", "en", "s")]
    fine = [(500 + i, whole[i][1] + f"\nBy {words[i]}", "en", "s") for i in range(12)] + [(600, "a headline of seven words without stop", "en", "s")]
    found = truncation.judged(table(spark, whole + cut + debris + fine))
    assert {x["doc_id"] for x in found.where("cut").collect()} == {i for i, t, *_ in cut + debris if not t.endswith(".")}
    rate = {x["source"]: x for x in truncation.rates(found).collect()}
    assert rate["s"]["documents"] == len(whole + cut + debris + fine)
    assert truncation.judged(none).count() == 0
    assert sorted(x["doc_id"] or 0 for x in truncation.judged(odd).collect()) == [0, 4, 4, 5, 6]


def test_kinds_of_last_lines(spark, monkeypatch):
    """Rare kinds of last lines are known by their length, sentences by their first word, and headlines by their number: no count is a limit."""
    r = random.Random(4)
    words = ["".join(r.choice("aeioubcdfg") for _ in range(6)) for _ in range(120)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    texts = [sentence(9) + " " + sentence(11) + "\n" + sentence(12) for _ in range(120)]
    byline = [t + f"\nBy {words[k]}" for k, t in enumerate(texts[:8])] + [texts[9] + "\nPhoto: Zuz", texts[10] + "\nRelated pages"]
    opened = [texts[20] + "\n" + " ".join([words[0]] + [words[k]] + [words[3][:2]]) for k in range(1)] + [texts[30 + k][:-9] for k in range(6)]
    heads = [" ".join(r.choice(words) for _ in range(r.randrange(7, 10))) for _ in range(6)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts + byline + opened + heads)]
    found = {x["doc_id"]: x for x in truncation.judged(table(spark, rows)).collect()}
    n = len(texts) + len(byline)
    assert {k for k, x in found.items() if x["cut"]} == set(range(n, n + len(opened)))
    monkeypatch.setattr(tables, "HOT", 3)
    assert {k: x["cut"] for k, x in found.items()} == {x["doc_id"]: x["cut"] for x in truncation.judged(table(spark, rows)).collect()}
    assert all(x["column_kind"] == "line" for k, x in found.items() if 120 <= k < n)


def test_languages_have_thresholds_of_their_own(spark):
    r = random.Random(6)
    text = lambda a, stop: "\n".join(" ".join("".join(r.choice(a) for _ in range(5)) for _ in range(8)) + stop for _ in range(3))
    rows = [(k, text("abcde", "."), "en", "s") for k in range(60)] + [(100 + k, text("अआकखग", "।"), "hi", "s") for k in range(60)] + [(200, text("अआकखग", "।"), "en", "s"), (201, text("अआकखग", "।")[:-4], "hi", "s"), (202, text("abcde", ".")[:-3], None, "s")]
    found = truncation.judged(table(spark, rows))
    assert {x["doc_id"] for x in found.where("cut").collect()} == {201, 202}
    assert found.select("lang", "threshold").distinct().where("lang <> 'und'").count() == 2
