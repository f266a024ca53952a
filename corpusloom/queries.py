"""The queries of the engine's operators, over the whole tables, and the same in DuckDB's SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .functions import tolerant
from .operators import bpe, counts, encode, ngrams, pack, quality, segment, vocab
from .plans.metrics import Stage
from .plans.tables import cut, table
from .sources import readers, sinks
from .streaming.counts import stream_core_word_counts

LEAST, HEAD = 8, 5  # the deterministic segmenter of the checked queries
BLOCK, SHARE, SLOTS = 256, 0.02, 500009

SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# parts of the SQL

_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_C = t.TELUGU.chars
_PIECES = f"list_filter(regexp_split_to_array(text, '{_WHITE}'), lambda x: x <> '')"
_TOK = f"""pc AS (SELECT doc_id, {_PIECES} AS w FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(w) AS p, generate_subscripts(w, 1) AS pos FROM pc)"""
_CORE_WORDS = f"SELECT doc_id, unnest(regexp_extract_all(text, '[{_C}]+')) AS word FROM documents WHERE text IS NOT NULL"
_WORDS = f"cw AS (SELECT word, count(*) AS n FROM ({_CORE_WORDS}) GROUP BY word)"
_SPLIT_WORDS = f"sw AS (SELECT word, n, CASE WHEN length(word) >= {LEAST} THEN [substring(word, 1, {HEAD}), substring(word, {HEAD + 1})] ELSE [word] END AS parts FROM cw)"
_SEG = f"""{_TOK},
dp AS (SELECT p, flatten(list_transform(regexp_extract_all(p, '[{_C}]+|[^{_C}]+'), lambda r: CASE WHEN regexp_matches(r, '[{_C}]') AND length(r) >= {LEAST} THEN [substring(r, 1, {HEAD}), substring(r, {HEAD + 1})] ELSE [r] END)) AS parts FROM (SELECT DISTINCT p FROM tok)),
sp AS (SELECT p, list_transform(parts, lambda x, i: CASE WHEN i < len(parts) AND NOT ends_with(x, '@@') THEN x || '@@' ELSE x END) AS toks FROM dp),
seg AS (SELECT tok.doc_id, tok.pos, generate_subscripts(sp.toks, 1) AS k, unnest(sp.toks) AS token FROM tok JOIN sp USING (p))"""
_SEG_COUNTS = f"""{_SEG}, sc AS (SELECT token, count(*) AS n FROM seg GROUP BY token),
sb AS (SELECT token, n, CASE WHEN ends_with(token, '@@') THEN substring(token, 1, length(token) - 2) ELSE token END AS base FROM sc)"""
_VOC = "voc AS (SELECT unnest(map_keys(token_to_id)) AS token, unnest(map_values(token_to_id)) AS id FROM tokenizer)"
_ENC = f"""{_TOK}, {_VOC},
dt AS (SELECT DISTINCT p FROM tok),
miss AS (SELECT p, regexp_matches(p, '[{_C}]') AS core FROM dt WHERE p NOT IN (SELECT token FROM voc)),
mc AS (SELECT p, core, unnest(string_split(p, '')) AS c, generate_subscripts(string_split(p, ''), 1) AS i, len(string_split(p, '')) AS l FROM miss),
mi AS (SELECT mc.p, mc.i, CASE WHEN i = l THEN coalesce(b.id, 1) WHEN core THEN coalesce(a.id, 1) ELSE coalesce(a.id, b.id, 1) END AS id
  FROM mc LEFT JOIN voc a ON a.token = mc.c || '@@' LEFT JOIN voc b ON b.token = mc.c),
pe AS (SELECT p, list(id ORDER BY i) AS ids FROM mi GROUP BY p UNION ALL SELECT p, [voc.id] FROM dt JOIN voc ON voc.token = dt.p),
enc AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM tok JOIN pe USING (p) GROUP BY doc_id)"""
_STREAM = f"""{_ENC}, se AS (SELECT doc_id, list_append(ids, 3) AS ids FROM enc),
st AS (SELECT doc_id, ids, CAST(sum(len(ids)) OVER (ORDER BY doc_id) - len(ids) AS BIGINT) AS start FROM se)"""
_POS = f"{_STREAM}, ps AS (SELECT start + unnest(range(0, len(ids))) AS pos, unnest(ids) AS id FROM st)"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _words(s: SparkSession, d: str) -> DataFrame:
    return counts.core_word_counts(_docs(s, d))


def _split(w):
    return t.split_after(w, LEAST, HEAD)


def _segmented(docs: DataFrame) -> DataFrame:
    return segment.segment_texts(docs, partial(segment.split_after, least=LEAST, head=HEAD))


def _token_counts(s: SparkSession, d: str) -> DataFrame:
    return counts.segmented_counts(_docs(s, d), _split)


def _split_words(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).withColumn("parts", _split(F.col("word")))


def _encode(s: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    """Lookup, then characters; no merges."""
    return encode.encoded(docs, encode.encoder_of(table(s, d, "tokenizer"), merges=False)).where(F.size("ids") > 0)


def _encoded(s: SparkSession, d: str) -> DataFrame:
    return _encode(s, d, _docs(s, d))


def _stream(s: SparkSession, d: str) -> DataFrame:
    """Encoded once, in the order of the ids."""
    return pack.stream(pack.with_eos(_encode(s, d, pack.by_ranges(_docs(s, d).select("doc_id", "text")))), ranged=True)


def _shown(ids) -> object:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


_SHOW = "array_to_string({}, ' ')"


# counts


@query(f"WITH {_WORDS} SELECT word, n FROM cw")
def core_word_freq(s, d):
    """Occurrences of each run of core letters."""
    return _words(s, d)


@query(f"WITH {_WORDS} SELECT word, n FROM cw ORDER BY n DESC, word LIMIT 30")
def core_word_top30(s, d):
    return counts.top(_words(s, d), "word", 30)


@query(f"WITH {_TOK} SELECT CASE WHEN regexp_full_match(p, '[{_C}]+') THEN 'pure' WHEN regexp_matches(p, '[{_C}]') THEN 'mixed' ELSE 'other' END AS class, count(*) AS n FROM tok GROUP BY 1")
def token_class_counts(s, d):
    rows = counts.piece_counts(_docs(s, d))
    return rows.groupBy(t.token_class(F.col("token")).alias("class")).agg(F.sum("n").alias("n"))


@query(f"""WITH {_TOK}, m AS (SELECT p, count(*) AS n, regexp_extract_all(p, '[{_C}]+|[^{_C}]+') AS r FROM tok WHERE regexp_matches(p, '[{_C}]') AND NOT regexp_full_match(p, '[{_C}]+') GROUP BY p)
SELECT p AS token, array_to_string(list_transform(r, lambda x, i: CASE WHEN i < len(r) AND NOT ends_with(x, '@@') THEN x || '@@' ELSE x END), ' ') AS runs, n FROM m""")
def mixed_token_runs(s, d):
    c = counts.piece_counts(_docs(s, d)).where(t.token_class(F.col("token")) == "mixed")
    return c.select("token", F.array_join(t.marked(t.runs(F.col("token"))), " ").alias("runs"), "n")


@query(f"WITH {_TOK} SELECT p AS token, count(*) AS n FROM tok GROUP BY p")
def whitespace_token_freq(s, d):
    return counts.piece_counts(_docs(s, d))


@query(f"WITH {_SEG_COUNTS} SELECT base, CAST(sum(n) AS BIGINT) AS n FROM sb WHERE NOT regexp_matches(base, '[{_C}]') GROUP BY base")
def other_token_freq(s, d):
    return counts.other_counts(_token_counts(s, d))


@query(f"WITH {_SEG_COUNTS} SELECT token, n FROM sb WHERE regexp_matches(base, '[{_C}]')")
def core_token_freq_marked(s, d):
    return counts.core_counts(_token_counts(s, d))


@query(f"""WITH {_SEG_COUNTS}, x AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE regexp_matches(base, '[{_C}]')) AS BIGINT) AS kept, count(*) FILTER (WHERE regexp_matches(base, '[{_C}]')) AS types FROM sb)
SELECT total, kept, round(kept * 100 / total, 6) AS pct, types FROM x""")
def corpus_token_ratios(s, d):
    return counts.kept_ratios(_token_counts(s, d))


@query(f"WITH {_SEG_COUNTS} SELECT ends_with(token, '@@') AS continued, count(*) AS types FROM sb WHERE regexp_matches(base, '[{_C}]') GROUP BY 1")
def cont_vs_final_types(s, d):
    return counts.core_counts(_token_counts(s, d)).groupBy(t.is_continued(F.col("token")).alias("continued")).agg(F.count("*").alias("types"))


@query(f"WITH {_SEG_COUNTS} SELECT base, CAST(sum(n) AS BIGINT) AS n FROM sb WHERE NOT regexp_matches(base, '[{_C}]') GROUP BY base HAVING sum(n) >= 5")
def min_freq_filter(s, d):
    return counts.other_counts(_token_counts(s, d)).where("n >= 5")


@query("SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT source FROM sources WHERE data_dir NOT LIKE 'generated/%') GROUP BY source")
def source_subset_counts(s, d):
    names = [r[0] for r in table(s, d, "sources").where("data_dir NOT LIKE 'generated/%'").select("source").collect()]  # the catalogue
    return readers.subset(_docs(s, d), names).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def doc_limit_per_source(s, d):
    return readers.first_per_source(_docs(s, d).select("doc_id", "source"), 3)


@query(f"""WITH w AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[{_C}]+')), 0) AS BIGINT) AS words FROM documents),
x AS (SELECT doc_id, words, CAST(sum(words) OVER (ORDER BY doc_id) - words AS BIGINT) AS before FROM w) SELECT * FROM x WHERE before < 50000""")
def budget_sample(s, d):
    return readers.budget_sample(_docs(s, d), 50_000)


@query(f"WITH {_WORDS} SELECT word, CASE WHEN length(word) > {segment.LONG_WORD} THEN word ELSE substring(word, 1, {HEAD}) || CASE WHEN length(word) >= {LEAST} THEN '@@ ' || substring(word, {HEAD + 1}) ELSE substring(word, {HEAD + 1}) END END AS parts FROM cw")
def long_token_guard(s, d):
    """Words beyond a length stay whole."""
    parts = segment.guarded_word(F.col("word"), _split)
    return _words(s, d).select("word", F.array_join(t.marked(parts), " ").alias("parts"))


@query(f"""WITH {_SEG}, g AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos, k) AS text FROM seg GROUP BY doc_id), r AS (SELECT doc_id, string_agg(p, ' ' ORDER BY pos) AS text FROM tok GROUP BY doc_id)
SELECT doc_id, length(d.text) > {segment.GIANT_TEXT} AS guarded, CASE WHEN length(d.text) > {segment.GIANT_TEXT} THEN r.text ELSE g.text END AS text FROM documents d JOIN g USING (doc_id) JOIN r USING (doc_id)""")
def giant_doc_guard(s, d):
    """Documents beyond a length aren't segmented; their white space is still collapsed."""
    guarded, tokens = segment.guarded_text(F.col("text"), _split)
    rows = _docs(s, d).where("text IS NOT NULL").select("doc_id", guarded.alias("guarded"), tokens.alias("tokens"))
    return rows.where(F.size("tokens") > 0).select("doc_id", "guarded", F.array_join("tokens", " ").alias("text"))


@query(f"WITH {_WORDS} SELECT word, CAST(round_even(log2(n + 1), 0) AS BIGINT) AS log, CAST(1 AS BIGINT) AS ones, n AS none FROM cw")
def dampened_counts(s, d):
    return _words(s, d).select("word", *(t.dampened(F.col("n"), how).alias(how) for how in ("log", "ones", "none")))


@query("SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT source, shard, word, written_at, max(count) AS n FROM word_frequencies WHERE word IS NOT NULL AND word <> '' AND count > 0 GROUP BY ALL) GROUP BY word")
def word_frequency_totals(s, d):
    """Partial counts of sources and shards added up; rows sent again count once, rows without a word or a positive count don't."""
    rows = table(s, d, "word_frequencies").where("word IS NOT NULL AND word <> '' AND count > 0")
    once = rows.groupBy("source", "shard", "word", "written_at").agg(F.max("count").alias("n"))
    return once.groupBy("word").agg(F.sum("n").alias("n"))


# segments


@query(f"WITH {_WORDS}, {_SPLIT_WORDS} SELECT word, array_to_string(parts, '@@ ') AS parts, n FROM sw")
def segment_pure_words_toy(s, d):
    return _split_words(s, d).select("word", F.array_join(t.marked(F.col("parts")), " ").alias("parts"), "n")


@query(f"WITH {_SEG} SELECT doc_id, string_agg(token, ' ' ORDER BY pos, k) AS text FROM seg GROUP BY doc_id")
def segment_documents_toy(s, d):
    return _segmented(_docs(s, d)).select("doc_id", F.array_join("tokens", " ").alias("text"))


@query(f"""WITH {_TOK}, q AS (SELECT doc_id, pos, CASE WHEN regexp_full_match(p, '[{_C}]+') AND length(p) >= {LEAST} THEN substring(p, 1, {HEAD}) || '@@ ' || substring(p, {HEAD + 1}) ELSE p END AS p FROM tok)
SELECT doc_id, string_agg(p, ' ' ORDER BY pos) AS text FROM q GROUP BY doc_id""")
def segment_pure_only_toy(s, d):
    """Segmentation that leaves mixed pieces whole."""
    rows = _docs(s, d).where("text IS NOT NULL").select("doc_id", t.segmented(F.col("text"), _split, split_mixed=False).alias("tokens"))
    return rows.where(F.size("tokens") > 0).select("doc_id", F.array_join("tokens", " ").alias("text"))


@query(f"WITH {_WORDS}, {_SPLIT_WORDS}, m AS (SELECT unnest(parts) AS morpheme, n FROM sw) SELECT morpheme, CAST(sum(n) AS BIGINT) AS frequency FROM m GROUP BY morpheme")
def morpheme_vocab_toy(s, d):
    return segment.morpheme_counts(_split_words(s, d))


@query(f"""WITH {_WORDS}, {_SPLIT_WORDS}, m AS (SELECT DISTINCT unnest(parts) AS morpheme FROM sw), a AS (SELECT count(*) AS mt, avg(length(morpheme)) AS len FROM m),
b AS (SELECT count(*) AS wt, count(*) FILTER (WHERE len(parts) = 1) AS whole, sum(n) AS wn, sum(n * len(parts)) AS mn FROM sw)
SELECT wt AS word_types, mt AS morpheme_types, round(wt / mt, 2) AS compression_ratio, whole AS unsegmented_words, round(whole * 100.0 / wt, 1) AS unsegmented_pct, round(mn / wn, 2) AS avg_morphemes_per_word_token,
round(len, 1) AS avg_morpheme_length_chars, CAST(wn AS BIGINT) AS total_word_tokens, CAST(mn AS BIGINT) AS total_morpheme_tokens FROM a, b""")
def vocab_stats_toy(s, d):
    return segment.statistics(_split_words(s, d))


@query(f"""WITH {_WORDS}, {_SPLIT_WORDS}, m AS (SELECT morpheme, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(parts) AS morpheme, n FROM sw) GROUP BY morpheme)
SELECT * FROM (SELECT 'top' AS side, morpheme, n FROM m ORDER BY n DESC, morpheme LIMIT 30) UNION ALL SELECT * FROM (SELECT 'bottom' AS side, morpheme, n FROM m ORDER BY n, morpheme LIMIT 30)""")
def top_bottom_morphemes(s, d):
    m = segment.morpheme_counts(_split_words(s, d)).withColumnRenamed("frequency", "n")
    side = lambda name, least: counts.top(m, "morpheme", 30, least).select(F.lit(name).alias("side"), "morpheme", "n")
    return side("top", False).unionByName(side("bottom", True))


@query(f"""WITH {_WORDS}, {_SPLIT_WORDS}, t AS (SELECT word, parts, n, row_number() OVER (ORDER BY n DESC, word) AS r FROM sw)
SELECT 'frequent' AS part, word, array_to_string(parts, '@@ ') AS parts, n FROM t WHERE r <= 30 UNION ALL SELECT 'listed', word, array_to_string(parts, '@@ '), n FROM t WHERE word IN ({", ".join(f"'{w}'" for w in segment.SHOWN)})""")
def segmentation_sample(s, d):
    """A report of the segmenter: the 30 most frequent words and listed ones, with their parts."""
    rows = segment.report(_split_words(s, d))
    return rows.select("part", "word", F.array_join(t.marked(F.col("parts")), " ").alias("parts"), "n")


@query(f"""WITH {_TOK}, o AS (SELECT doc_id, pos, flatten(list_transform(regexp_extract_all(p, '[{_C}]+|[^{_C}]+'), lambda r: CASE WHEN regexp_matches(r, '[{_C}]') AND length(r) >= {LEAST} THEN [substring(r, 1, {HEAD}), substring(r, {HEAD + 1})] ELSE [r] END)) AS parts, p FROM tok)
SELECT doc_id, string_agg(CASE WHEN regexp_matches(p, '[{_C}]') THEN array_to_string(parts, '@@ ') ELSE p END, ' ' ORDER BY pos) AS text FROM o GROUP BY doc_id""")
def segment_online_toy(s, d):
    """Segmentation of a prompt: marks are set whatever a part ends in."""
    rows = _docs(s, d).where("text IS NOT NULL").select("doc_id", t.segmented(F.col("text"), _split, always=True).alias("tokens"))
    return rows.where(F.size("tokens") > 0).select("doc_id", F.array_join("tokens", " ").alias("text"))


@query()
def segmenter_train(s, d):
    """The lexicon learned from the word counts."""
    return segment.train(_words(s, d)).lexicon


@query()
def segment_documents(s, d):
    """The documents in the learned segments."""
    return segment.segment_texts(_docs(s, d), segment.train(cut(_words(s, d)))).select("doc_id", F.array_join("tokens", " ").alias("text"))


# vocabulary


_RANGE = "SELECT chr(CAST(x AS INTEGER)) AS c, o FROM (SELECT unnest(range(32, 127)) AS x, unnest(range(0, 95)) AS o) UNION ALL SELECT chr(CAST(x AS INTEGER)), o FROM (SELECT unnest(range(3072, 3200)) AS x, unnest(range(95, 223)) AS o) UNION ALL SELECT c, o FROM (SELECT unnest(string_split('–—‘’“”…•·€₹°±×÷', '')) AS c, unnest(range(223, 238)) AS o)"


@query(f"WITH r AS ({_RANGE}) SELECT CAST(o AS BIGINT) AS ord, v.variant, c || v.mark AS token FROM r, (VALUES (0, ''), (1, '@@')) v(variant, mark)")
def char_fallback_vocab(s, d):
    return s.createDataFrame([(i, v, c + (t.SEP if v else "")) for i, c in enumerate(t.characters()) for v in (0, 1)], "ord bigint, variant int, token string")


def _vocab_sql(cap: int) -> str:
    limit = f"ORDER BY n DESC, token LIMIT {cap - 4}" if cap else ""
    return f"""WITH {_SEG_COUNTS}, r AS ({_RANGE}), ot AS (SELECT base, CAST(sum(n) AS BIGINT) AS n FROM sb WHERE NOT regexp_matches(base, '[{_C}]') GROUP BY base HAVING sum(n) >= 5),
ct AS (SELECT token, n FROM sb WHERE regexp_matches(base, '[{_C}]') AND n >= 2 {limit}),
v(variant, mark) AS (VALUES (0, ''), (1, '@@')),
x AS (SELECT unnest(['<pad>', '<unk>', '<bos>', '<eos>']) AS token, 0 AS tier, 0 AS f, unnest([0, 1, 2, 3]) AS o, '' AS bare, 0 AS variant
UNION ALL SELECT token, 1, n, 0, token, 0 FROM ct UNION ALL SELECT base || mark, 2, n, 0, base, variant FROM ot, v UNION ALL SELECT c || mark, 3, 0, o, c, variant FROM r, v),
y AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY tier, f DESC, o, bare, variant) AS k FROM x)
SELECT token, CAST(row_number() OVER (ORDER BY tier, f DESC, o, bare, variant) - 1 AS INTEGER) AS id, CAST(tier AS INTEGER) AS tier, CAST(f AS BIGINT) AS frequency FROM y WHERE k = 1"""


def _vocab(s: SparkSession, d: str, cap: int = 0) -> DataFrame:
    seg = cut(_token_counts(s, d))
    sub = counts.other_counts(seg).where("n >= 5").withColumnRenamed("base", "token")
    return vocab.vocab_ids(counts.core_counts(seg), sub, cap=cap)


@query(_vocab_sql(0))
def vocab_ids(s, d):
    """Special tokens, core tokens, frequent other tokens bare and marked, characters."""
    return _vocab(s, d)


@query(_vocab_sql(1000))
def vocab_cap(s, d):
    """The same with the core tier capped."""
    return _vocab(s, d, 1000)


@query(f"SELECT id AS token_id, token, frequency FROM ({_vocab_sql(0)}) WHERE tier <= 1")
def token_frequency_report(s, d):
    return _vocab(s, d).where("tier <= 1").select(F.col("id").alias("token_id"), "token", "frequency")


# encoding


@query(f"WITH {_ENC} SELECT doc_id, {_SHOW.format('ids')} AS ids FROM enc")
def encode_lookup_char(s, d):
    return _encoded(s, d).select("doc_id", _shown(F.col("ids")).alias("ids"))


@query(f"WITH {_TOK}, {_VOC} SELECT doc_id, '2 ' || string_agg(CAST(coalesce(voc.id, 1) AS VARCHAR), ' ' ORDER BY pos) AS ids FROM tok LEFT JOIN voc ON voc.token = tok.p GROUP BY doc_id")
def encode_wordlevel_unk(s, d):
    return encode.word_level(_docs(s, d), encode.vocabulary(table(s, d, "tokenizer"))).select("doc_id", _shown(F.col("ids")).alias("ids"))


_DECODED = f"""{_ENC}, ix AS (SELECT doc_id, unnest(ids) AS tid, generate_subscripts(ids, 1) AS pos FROM enc),
dec AS (SELECT doc_id, replace(string_agg(coalesce(voc.token, '<unk>'), ' ' ORDER BY pos), '@@ ', '') AS text FROM ix LEFT JOIN voc ON voc.id = ix.tid WHERE tid NOT IN (0, 2, 3) GROUP BY doc_id)"""


@query(f"WITH {_DECODED} SELECT doc_id, text FROM dec")
def decode_documents(s, d):
    return encode.decoded(_encoded(s, d), encode.vocabulary(table(s, d, "tokenizer")))


@query(f"WITH {_DECODED} SELECT doc_id, replace(text, '@@', '') AS text FROM dec")
def decode_export(s, d):
    """The decoding of exported models: marks that glue nothing go, too."""
    return encode.decoded(_encoded(s, d), encode.vocabulary(table(s, d, "tokenizer")), strip_rest=True)


@query(f"WITH {_ENC} SELECT doc_id, '2 ' || {_SHOW.format('ids')} || ' 3' AS ids FROM enc")
def encode_bos_eos(s, d):
    """Encoding with a mark at either end of a document."""
    e = encode.encoder_of(table(s, d, "tokenizer"), merges=False)
    return encode.encoded(_docs(s, d), e, bos=2, eos=3).where(F.size("ids") > 0).select("doc_id", _shown(F.col("ids")).alias("ids"))


@query(f"""WITH {_DECODED}, raw AS (SELECT doc_id, string_agg(p, ' ' ORDER BY pos) AS text FROM tok GROUP BY doc_id)
SELECT count(*) AS documents, count(*) FILTER (WHERE dec.text = raw.text) AS same FROM raw JOIN dec USING (doc_id)""")
def roundtrip_rate(s, d):
    """Documents that decoding their ids gives back, white space aside."""
    raw = _docs(s, d).where("text IS NOT NULL").select("doc_id", F.array_join(t.pieces(F.col("text")), " ").alias("raw"))
    both = encode.decoded(_encoded(s, d), encode.vocabulary(table(s, d, "tokenizer"))).join(raw, "doc_id")
    return both.agg(F.count("*").alias("documents"), F.count_if(F.col("text") == F.col("raw")).alias("same"))


@query(f"""WITH {_ENC}, a AS (SELECT count(*) AS source_tokens FROM tok), b AS (SELECT CAST(sum(len(ids)) AS BIGINT) AS stream_tokens, CAST(sum(len(list_filter(ids, lambda x: x = 1))) AS BIGINT) AS unk FROM enc)
SELECT source_tokens, stream_tokens, unk, round(unk / stream_tokens, 6) AS unk_rate FROM a, b""")
def unk_rate(s, d):
    e = _encoded(s, d).agg(F.sum(F.size("ids")).alias("stream_tokens"), F.sum(F.size(F.filter("ids", lambda x: x == 1))).alias("unk"))
    n = _docs(s, d).agg(F.sum(F.greatest(F.size(t.pieces(F.col("text"))), F.lit(0))).cast("bigint").alias("source_tokens"))
    rate = F.round(F.coalesce(F.try_divide("unk", "stream_tokens"), F.lit(0.0)), 6)
    return n.crossJoin(e).select("source_tokens", "stream_tokens", "unk", rate.alias("unk_rate"))  # one row each


#: Missing pieces without core letters, their characters between chr(1) and chr(2), merged by the lowest rank as long as a pair can be: bpl (p, symbols).
_MERGED = """mg AS (SELECT k AS rank, chr(1) || bpe_merges[k][1] || chr(2) || chr(1) || bpe_merges[k][2] || chr(2) AS pat, chr(1) || bpe_merges[k][1] || bpe_merges[k][2] || chr(2) AS rep FROM (SELECT bpe_merges, unnest(range(1, len(bpe_merges) + 1)) AS k FROM tokenizer)),
bp(p, step, s) AS (SELECT p, 0, array_to_string(list_transform(string_split(p, ''), lambda c: chr(1) || c || chr(2)), '') FROM mw
  UNION ALL SELECT p, step + 1, replace(s, m.pat, m.rep) FROM (SELECT bp.p, any_value(bp.step) AS step, any_value(bp.s) AS s, arg_min(struct_pack(pat := mg.pat, rep := mg.rep), mg.rank) AS m FROM bp, mg WHERE contains(bp.s, mg.pat) GROUP BY bp.p)),
bpl AS (SELECT p, list_filter(string_split(replace(arg_max(s, step), chr(2), ''), chr(1)), lambda x: x <> '') AS sy FROM bp GROUP BY p)"""
_BPE_ENC = _ENC.replace("pe AS (SELECT p, list(id ORDER BY i) AS ids FROM mi GROUP BY p", f"""mw AS (SELECT p FROM miss WHERE NOT core), {_MERGED},
bs AS (SELECT p, unnest(sy) AS y, generate_subscripts(sy, 1) AS j, len(sy) AS m FROM bpl),
bi AS (SELECT bs.p, bs.j, bs.m, bs.y, CASE WHEN j = m THEN b.id ELSE a.id END AS id FROM bs LEFT JOIN voc a ON a.token = bs.y || '@@' LEFT JOIN voc b ON b.token = bs.y),
bc AS (SELECT p, j, m, unnest(string_split(y, '')) AS c, generate_subscripts(string_split(y, ''), 1) AS i, length(y) AS l FROM bi WHERE id IS NULL),
bj AS (SELECT p, j, 0 AS i, id FROM bi WHERE id IS NOT NULL UNION ALL SELECT bc.p, bc.j, bc.i, coalesce(CASE WHEN j = m AND i = l THEN b.id ELSE a.id END, 1) FROM bc LEFT JOIN voc a ON a.token = bc.c || '@@' LEFT JOIN voc b ON b.token = bc.c),
pe AS (SELECT p, list(id ORDER BY j, i) AS ids FROM bj GROUP BY p UNION ALL SELECT p, list(id ORDER BY i) AS ids FROM mi WHERE p IN (SELECT p FROM miss WHERE core) GROUP BY p""")


@query(f"WITH RECURSIVE {_BPE_ENC} SELECT doc_id, {_SHOW.format('ids')} AS ids FROM enc")
def bpe_encode(s, d):
    """Encoding with the tokenizer's merges."""
    return encode.encoded(_docs(s, d), encode.encoder_of(table(s, d, "tokenizer"))).where(F.size("ids") > 0).select("doc_id", _shown(F.col("ids")).alias("ids"))


# the pipeline as a whole


def _pipeline(s: SparkSession, d: str) -> DataFrame:
    """Documents segmented, encoded by the vocabulary of their own segments: (doc_id, ids) in order of the ids, each with <eos>."""
    seg = _segmented(pack.by_ranges(_docs(s, d).select("doc_id", "text"))).select("doc_id", F.array_join("tokens", " ").alias("text"))
    ids = cut(_vocab(s, d).select("token", "id"))
    encode.checked(ids.count())
    e = encode.Encoder({r["token"]: r["id"] for r in ids.collect()})
    return pack.with_eos(encode.encoded(seg, e))


@query("pipeline_encode")
def pipeline_encode(s, d):
    """Raw texts to ids: segments, vocabulary, encoding."""
    return _pipeline(s, d).select("doc_id", _shown(F.col("ids")).alias("ids"))


@query("pipeline_blocks")
def pipeline_blocks(s, d):
    """Raw texts to blocks."""
    return pack.blocks(pack.stream(_pipeline(s, d), ranged=True), BLOCK).select("block_id", _shown(F.col("ids")).alias("ids"))


@query()
def pipeline_learned(s, d):
    """The same with everything learned: segmenter, merges over the other segments, vocabulary with their symbols, encoding by the merges."""
    docs = _docs(s, d)
    seg = cut(segment.segment_texts(docs, segment.train(cut(counts.core_word_counts(docs)))))
    tokens = cut(counts.token_counts(seg))
    merges, symbols = bpe.train(counts.other_counts(tokens).withColumnRenamed("base", "word"))
    ids = cut(vocab.vocab_ids(counts.core_counts(tokens), symbols.select(F.col("subword").alias("token"), F.col("frequency").alias("n"))))
    encode.checked(ids.count())
    ids = {r["token"]: r["id"] for r in ids.select("token", "id").collect()}
    e = encode.Encoder(ids, [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()])
    text = seg.select("doc_id", F.array_join("tokens", " ").alias("text"))
    return encode.encoded(text, e, eos=3).select("doc_id", _shown(F.col("ids")).alias("ids"))


# merges


_OTHER = f"ow AS (SELECT base AS word, CAST(sum(n) AS BIGINT) AS freq FROM sb WHERE NOT regexp_matches(base, '[{_C}]') GROUP BY base HAVING sum(n) >= 5)"
_PAIRS = f"{_SEG_COUNTS}, {_OTHER}, pr AS (SELECT string_split(word, '')[i] AS l, string_split(word, '')[i + 1] AS r, freq FROM (SELECT word, freq, unnest(range(1, length(word))) AS i FROM ow))"


def _other_words(s: SparkSession, d: str) -> DataFrame:
    w = counts.other_counts(_token_counts(s, d)).where("n >= 5 AND base <> ''")
    return w.select(F.col("base").alias("word"), counts.symbols(F.col("base")).alias("symbols"), F.col("n").alias("freq"))


@query(f"WITH {_PAIRS} SELECT l, r, CAST(sum(freq) AS BIGINT) AS n FROM pr GROUP BY l, r")
def bpe_pair_counts(s, d):
    return counts.pair_counts(_other_words(s, d))


_FIRST = f"{_PAIRS}, fm AS (SELECT l, r, CAST(sum(freq) AS BIGINT) AS n FROM pr GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1)"


@query(f"WITH {_FIRST} SELECT l, r, n FROM fm")
def bpe_first_merge(s, d):
    return counts.pair_counts(_other_words(s, d)).orderBy(F.desc("n"), "l", "r").limit(1)


@query(f"WITH {_SEG_COUNTS}, {_OTHER} SELECT word, array_to_string(string_split(replace(word, 'an', chr(1)), ''), ' ') AS symbols, freq FROM ow".replace("array_to_string(string_split(replace(word, 'an', chr(1)), ''), ' ')", "replace(array_to_string(string_split(replace(word, 'an', chr(1)), ''), ' '), chr(1), 'an')"))
def bpe_apply_merge(s, d):
    """One merge, of a and n, applied to all words."""
    return counts.merge_pair(_other_words(s, d), "a", "n").select("word", F.array_join("symbols", " ").alias("symbols"), "freq")


@query(f"WITH {_SEG_COUNTS}, {_OTHER} SELECT l, r, count(DISTINCT word) AS words FROM (SELECT word, string_split(word, '')[i] AS l, string_split(word, '')[i + 1] AS r FROM (SELECT word, unnest(range(1, length(word))) AS i FROM ow)) GROUP BY l, r")
def bpe_pair_words(s, d):
    """In how many words each pair occurs."""
    w = _other_words(s, d).where(F.size("symbols") > 1)
    pairs = w.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda i: F.struct(F.element_at("symbols", i).alias("l"), F.element_at("symbols", i + 1).alias("r"))))).alias("p"))
    return pairs.groupBy("p.l", "p.r").agg(F.count("*").alias("words"))


@query(f"WITH {_SEG_COUNTS}, {_OTHER} SELECT l, r, count(*) AS n, string_agg(word, ' ' ORDER BY word) AS words FROM (SELECT DISTINCT word, string_split(word, '')[i] AS l, string_split(word, '')[i + 1] AS r FROM (SELECT word, unnest(range(1, length(word))) AS i FROM ow)) GROUP BY l, r")
def bpe_pair_index(s, d):
    """The words that hold each pair."""
    return counts.pair_index(_other_words(s, d)).select("l", "r", F.size("words").cast("bigint").alias("n"), F.array_join("words", " ").alias("words"))


#: Merges that are applied one after the other in the checked query.
_ORDER = (("a", "n"), ("i", "n"), ("an", "a"), ("e", "r"), ("an", "i"))


def _applied_sql(symbols: str) -> str:
    for a, b in _ORDER:
        symbols = f"replace({symbols}, chr(1) || '{a}' || chr(2) || chr(1) || '{b}' || chr(2), chr(1) || '{a}{b}' || chr(2))"
    return symbols


@query(f"""WITH {_SEG_COUNTS}, {_OTHER}, wr AS (SELECT word, freq, {_applied_sql("array_to_string(list_transform(string_split(word, ''), lambda c: chr(1) || c || chr(2)), '')")} AS s FROM ow WHERE word <> '')
SELECT word, freq, trim(replace(replace(s, chr(1), ' '), chr(2), '')) AS symbols FROM wr""")
def bpe_apply_order(s, d):
    """Merges applied one after the other, each once."""
    return bpe.applied_in_order(_other_words(s, d), list(_ORDER)).select("word", "freq", F.array_join("symbols", " ").alias("symbols"))


#: Merges of the checked training.
FIRST = 24


@query(f"""WITH RECURSIVE {_SEG_COUNTS}, {_OTHER}, tr(step, l, r, word, freq, s) AS (SELECT 0, NULL::VARCHAR, NULL::VARCHAR, word, freq, array_to_string(list_transform(string_split(word, ''), lambda c: chr(1) || c || chr(2)), '') FROM ow WHERE word <> ''
  UNION ALL SELECT tr.step + 1, b.l, b.r, tr.word, tr.freq, replace(tr.s, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2), chr(1) || b.l || b.r || chr(2)) FROM tr, (
    SELECT l, r FROM (SELECT sy[i] AS l, sy[i + 1] AS r, freq FROM (SELECT sy, freq, unnest(range(1, len(sy))) AS i FROM (SELECT list_filter(string_split(replace(s, chr(2), ''), chr(1)), lambda x: x <> '') AS sy, freq FROM tr)))
    GROUP BY l, r HAVING sum(freq) >= 2 ORDER BY sum(freq) DESC, l, r LIMIT 1) b WHERE tr.step < {FIRST})
SELECT DISTINCT step - 1 AS rank, l AS "left", r AS "right" FROM tr WHERE step > 0""")
def bpe_first_merges(s, d):
    """The first merges of the training, which only number FIRST here so that SQL can follow."""
    w = counts.other_counts(_token_counts(s, d)).withColumnRenamed("base", "word")
    return bpe.train(w, FIRST)[0]


@query()
def bpe_train(s, d):
    """Merges learned from the other tokens."""
    w = counts.other_counts(_token_counts(s, d)).withColumnRenamed("base", "word")
    return bpe.train(w)[0]


@query()
def bpe_subwords(s, d):
    """Frequencies of the symbols that are left after the merges."""
    w = counts.other_counts(_token_counts(s, d)).withColumnRenamed("base", "word")
    return bpe.train(w)[1]


# packing


@query(f"WITH {_STREAM} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, start, start // {BLOCK} AS first_block FROM st")
def pack_offsets(s, d):
    n = pack.with_eos(_encode(s, d, pack.by_ranges(_docs(s, d).select("doc_id", "text")))).select("doc_id", F.size("ids").cast("bigint").alias("n"))
    return pack.offsets(n, ranged=True).select("doc_id", "n", "start", F.floor(F.col("start") / BLOCK).alias("first_block"))


@query(f"WITH {_POS} SELECT pos // {BLOCK} AS block_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM ps GROUP BY 1")
def pack_blocks(s, d):
    return pack.blocks(_stream(s, d), BLOCK).select("block_id", _shown(F.col("ids")).alias("ids"))


_CUT = f"{_STREAM}, tt AS (SELECT CAST(sum(len(ids)) AS BIGINT) AS total FROM st), cc AS (SELECT tt.total - CAST(floor(total * {SHARE}) AS BIGINT) AS cut_at FROM tt)"


@query(f"""WITH {_CUT}, z AS (SELECT doc_id, len(ids) AS n, least(greatest(cut_at - start, 0), len(ids)) AS train FROM st, cc)
SELECT doc_id, 'train' AS split, CAST(train AS BIGINT) AS n FROM z WHERE train > 0 UNION ALL SELECT doc_id, 'val', CAST(n - train AS BIGINT) FROM z WHERE n > train""")
def train_val_split(s, d):
    return pack.tail_split(_stream(s, d), SHARE)


@query(f"""WITH {_POS}, ld AS (SELECT pos, id, lead(id) OVER (ORDER BY pos) AS nx FROM ps)
SELECT pos // {BLOCK} AS block_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS x, string_agg(CAST(nx AS VARCHAR), ' ' ORDER BY pos) AS y FROM ld GROUP BY 1 HAVING count(nx) = {BLOCK}""")
def shifted_examples(s, d):
    return pack.examples(_stream(s, d), BLOCK).select("block_id", _shown(F.col("x")).alias("x"), _shown(F.col("y")).alias("y"))


_TOTAL = f"{_POS}, tt AS (SELECT count(*) AS total FROM ps)"


@query(f"""WITH {_TOTAL}, sw AS (SELECT k, CAST((k + 1) * 2654435761 % (total - {BLOCK} - 1) AS BIGINT) AS start FROM (SELECT unnest(range(0, 64)) AS k), tt)
SELECT k, start, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE pos < start + {BLOCK}) AS x, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE pos > start) AS y
FROM sw JOIN ps ON pos BETWEEN start AND start + {BLOCK} GROUP BY k, start""")
def window_sample(s, d):
    """Windows at hashed places of the stream."""
    return pack.sampled_windows(_stream(s, d), BLOCK, 64).select("k", "start", _shown(F.col("x")).alias("x"), _shown(F.col("y")).alias("y"))


@query(f"""WITH {_TOTAL}, cc AS (SELECT total, total - CAST(floor(total * {SHARE}) AS BIGINT) AS cut_at FROM tt), sw AS (SELECT k, CAST(cut_at + (k + 1) * 2654435761 % (total - cut_at - 32) AS BIGINT) AS start FROM (SELECT unnest(range(0, 3)) AS k), cc)
SELECT k, start, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM sw JOIN ps ON pos BETWEEN start AND start + 31 GROUP BY k, start""")
def prompt_sample(s, d):
    """Three prompts of 32 ids from the tail for validation."""
    return pack.sampled_prompts(_stream(s, d), SHARE, 32, 3).select("k", "start", _shown(F.col("ids")).alias("ids"))


@query(f"WITH {_ENC} SELECT doc_id, array_to_string(ids[greatest(len(ids) - 31, 1):], ' ') AS ids FROM enc")
def context_truncate(s, d):
    return pack.last_ids(_encoded(s, d), 32).select("doc_id", _shown(F.col("ids")).alias("ids"))


@query(f"""WITH {_CUT} SELECT t.vocab_size, 256 AS block_size, cut_at AS train_tokens, tt.total - cut_at AS val_tokens, tt.total AS total_tokens, 'uint32' AS dtype FROM cc, tt, tokenizer t""")
def stream_metadata(s, d):
    """The prepared stream's record."""
    split = pack.tail_split(_stream(s, d), SHARE)
    n = lambda name: F.coalesce(F.sum(F.when(F.col("split") == name, F.col("n"))), F.lit(0))
    one = split.agg(n("train").alias("train_tokens"), n("val").alias("val_tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"))
    return table(s, d, "tokenizer").select("vocab_size").crossJoin(one).select("vocab_size", F.lit(BLOCK).alias("block_size"), "train_tokens", "val_tokens", "total_tokens", F.lit("uint32").alias("dtype"))  # one row each


@query(f"""WITH {_STREAM}, tt AS (SELECT sum(len(ids)) AS total FROM st)
SELECT config_name, CAST(128 AS BIGINT) * block_size AS tokens_per_step, round(total / (128 * block_size), 6) AS steps_per_epoch, round(128 * block_size * CAST(45000 AS BIGINT) / total, 6) AS epochs FROM model_config, tt""")
def epoch_accounting(s, d):
    total = pack.with_eos(_encoded(s, d)).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("total"))
    return pack.epochs(table(s, d, "model_config"), total)


@query("""SELECT config_name, CAST(v * e + l * (4 * e * e + 3 * e * ((8 * e // 3 + 255) // 256) * 256) + (2 * l + 1) * e AS BIGINT) AS parameters
FROM (SELECT config_name, CAST(coalesce(nullif(m.vocab_size, 0), t.vocab_size) AS BIGINT) AS v, CAST(n_embd AS BIGINT) AS e, CAST(n_layer AS BIGINT) AS l FROM model_config m, tokenizer t)""")
def model_parameters(s, d):
    return pack.parameters(table(s, d, "model_config"), table(s, d, "tokenizer"))


@query("""SELECT step, round(CASE WHEN step < 1000 THEN step * 3e-4 / 1000 WHEN step > 45000 THEN 3e-5 ELSE 3e-5 + 0.5 * (1 + cos(pi() * (step - 1000) / 44000)) * (3e-4 - 3e-5) END, 10) AS rate FROM (SELECT unnest(range(0, 50001, 250)) AS step)""")
def learning_rates(s, d):
    return pack.learning_rates(s, list(range(0, 50001, 250)))


# n-grams


_NG = f"{_ENC}, ng AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ids[i - 2] AS back2, ids[i - 1] AS back1, ids[i] AS token_id FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM enc))"
_NG = _NG.replace("ids[i - 2] AS back2, ids[i - 1] AS back1", "CASE WHEN i > 2 THEN ids[i - 2] END AS back2, CASE WHEN i > 1 THEN ids[i - 1] END AS back1")


@query(f"WITH {_NG} SELECT doc_id, pos, back2, back1, token_id FROM ng")
def suffix_ngrams(s, d):
    return ngrams.suffix_ngrams(_encoded(s, d))


@query(f"""WITH {_NG} SELECT doc_id, pos, CAST(xor(CAST(back1 AS BIGINT) * 1000003, CAST(token_id AS BIGINT) * 8191) % {SLOTS} AS BIGINT) AS slot2,
CAST(xor(xor(CAST(back2 AS BIGINT) * 1000003, CAST(back1 AS BIGINT) * 8191), CAST(token_id AS BIGINT) * 131071) % {SLOTS} AS BIGINT) AS slot3 FROM ng""")
def ngram_hash_slots(s, d):
    return ngrams.hash_slots(ngrams.suffix_ngrams(_encoded(s, d)), SLOTS)


@query(f"WITH {_NG}, c AS (SELECT back1, token_id, count(*) AS n FROM ng WHERE back1 IS NOT NULL GROUP BY ALL) SELECT n, count(*) AS bigrams, CAST(sum(n) AS BIGINT) AS occurrences FROM c GROUP BY n")
def ngram_skew(s, d):
    return ngrams.skew(ngrams.suffix_ngrams(_encoded(s, d)))


def _slot_sql(n: int, w: tuple[int, ...]) -> str:
    h = f"CAST(token_id AS BIGINT) * {w[0]}"
    for c, k in list(zip(("back1", "back2"), w[1:]))[: n - 1]:
        h = f"xor({h}, CAST({c} AS BIGINT) * {k})"
    return f"CAST({h} % {SLOTS} AS BIGINT)"


_HEADS = " UNION ALL ".join(f"SELECT doc_id, pos, {n} AS \"order\", {k} AS head, {_slot_sql(n, w)} AS slot FROM ng WHERE back{n - 1} IS NOT NULL" for n in (2, 3) for k, w in enumerate(ngrams.HEADS))


@query(f"WITH {_NG}, hd AS ({_HEADS}) SELECT \"order\", head, count(*) AS n, count(DISTINCT slot) AS slots, CAST(sum(slot) AS BIGINT) AS slot_sum FROM hd GROUP BY 1, 2")
def ngram_hash_heads(s, d):
    """How the eight hash heads spread the n-grams of two and three ids: their number, the slots they take and the slots' sum."""
    heads = ngrams.hash_heads(ngrams.suffix_ngrams(_encoded(s, d)), SLOTS)
    per = heads.groupBy("order", "head", "slot").agg(F.count("*").alias("n"))
    return per.groupBy("order", "head").agg(F.sum("n").alias("n"), F.count("*").alias("slots"), F.sum(F.col("slot") * F.col("n")).alias("slot_sum"))


@query(f"""WITH {_NG}, c AS (SELECT back1, token_id, count(*) AS n FROM ng WHERE back1 IS NOT NULL GROUP BY ALL), k AS (SELECT n, count(*) AS bigrams, CAST(sum(n) AS BIGINT) AS occurrences FROM c GROUP BY n)
SELECT n, bigrams, occurrences, round(sum(bigrams) OVER (ORDER BY n DESC) / sum(bigrams) OVER (), 6) AS share_of_bigrams, round(sum(occurrences) OVER (ORDER BY n DESC) / sum(occurrences) OVER (), 6) AS share_of_occurrences FROM k""")
def ngram_cumulative(s, d):
    """What the most frequent bigrams make up of all, for a cache."""
    return ngrams.cumulative(ngrams.skew(ngrams.suffix_ngrams(_encoded(s, d))))


@query(f"""WITH {_VOC}, k AS (SELECT id, trim(lower(replace(token, '@@', ''))) AS norm FROM voc), f AS (SELECT norm, min(id) AS first FROM k GROUP BY norm),
r AS (SELECT norm, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS canonical_id FROM f) SELECT id, canonical_id FROM k JOIN r USING (norm)""")
def canonical_ids(s, d):
    return ngrams.canonical_ids(encode.vocabulary(table(s, d, "tokenizer")), nfkc=False)


@query()
def canonical_ids_nfkc(s, d):
    """The same with compatibility forms made equal."""
    return ngrams.canonical_ids(encode.vocabulary(table(s, d, "tokenizer")))


_PIPE = _ENC.removeprefix(f"{_TOK}, {_VOC}").replace("FROM tok)", "FROM tk)").replace("FROM tok JOIN pe", "FROM tk JOIN pe")
_PIPE = _PIPE.replace("mc AS (SELECT p, core, unnest(string_split(p, '')) AS c, generate_subscripts(string_split(p, ''), 1) AS i, len(string_split(p, '')) AS l FROM miss)", """mb AS (SELECT p, core, ends_with(p, '@@') AS cont, CASE WHEN ends_with(p, '@@') THEN substring(p, 1, length(p) - 2) ELSE p END AS q FROM miss),
mc AS (SELECT p, core, cont, unnest(string_split(q, '')) AS c, generate_subscripts(string_split(q, ''), 1) AS i, len(string_split(q, '')) AS l FROM mb WHERE q <> '')""")
# the last letter of a token that goes on takes its marked form, if there is one; others only if the bare form is in the vocabulary
_PIPE = _PIPE.replace("CASE WHEN i = l THEN coalesce(b.id, 1) WHEN core", "CASE WHEN i = l AND cont AND core THEN coalesce(a.id, b.id, 1) WHEN i = l AND cont AND b.id IS NOT NULL THEN coalesce(a.id, b.id) WHEN i = l THEN coalesce(b.id, 1) WHEN core")
_PIPE = f"{_SEG}, voc AS ({_vocab_sql(0)}), tk AS (SELECT doc_id, token AS p, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS pos FROM seg){_PIPE}"
_PIPE_EOS = f"{_PIPE}, se AS (SELECT doc_id, list_append(ids, 3) AS ids FROM enc)"
SQL["pipeline_encode"] = f"WITH {_PIPE_EOS} SELECT doc_id, {_SHOW.format('ids')} AS ids FROM se"
SQL["pipeline_blocks"] = f"""WITH {_PIPE_EOS}, st AS (SELECT doc_id, ids, CAST(sum(len(ids)) OVER (ORDER BY doc_id) - len(ids) AS BIGINT) AS start FROM se), ps AS (SELECT start + unnest(range(0, len(ids))) AS pos, unnest(ids) AS id FROM st)
SELECT pos // {BLOCK} AS block_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM ps GROUP BY 1"""


# chat and quality


_TURNS = f"tn AS (SELECT DISTINCT conv_id, turn, lower(trim(role, ' ')) AS role, text FROM conversations WHERE lower(trim(role, ' ')) IN ('system', 'user', 'assistant') AND len({_PIECES}) > 0)"


@query(f"WITH {_TURNS} SELECT conv_id, '<bos>' || string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) || '<eos>' AS text FROM tn GROUP BY conv_id")
def chat_format(s, d):
    return quality.chat_format(table(s, d, "conversations"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, role, CAST(len({_PIECES}) AS BIGINT) AS tokens, CAST(CASE WHEN role = 'assistant' THEN len({_PIECES}) ELSE 0 END AS BIGINT) AS loss_tokens FROM tn")
def loss_mask(s, d):
    return quality.loss_mask(table(s, d, "conversations"))


@query(f"WITH {_TURNS} SELECT count(*) AS turns, round(avg(CAST(regexp_matches(rtrim(text, ' '), '[.?!।]$') AS DOUBLE)), 6) AS rate FROM tn WHERE role = 'assistant'")
def format_compliance(s, d):
    return quality.format_compliance(table(s, d, "conversations"))


@query(f"WITH k AS (SELECT doc_id, md5(lower(array_to_string({_PIECES}, ' '))) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id FROM k")
def exact_dedup(s, d):
    return quality.exact_duplicates(_docs(s, d))


@query(f"SELECT doc_id, chars, core_chars FROM (SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '[^{_C}]', '', 'g')) AS core_chars FROM documents WHERE text IS NOT NULL) WHERE chars >= 200 AND core_chars >= 0.5 * chars")
def quality_filter(s, d):
    return quality.quality_filter(_docs(s, d))


@query("SELECT doc_id, domain FROM (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 20")
def stratified_mix(s, d):
    return quality.stratified(_docs(s, d), "domain", 20)


def _loss_sql(name: str, where: str) -> str:
    return f"""{name}c AS (SELECT p, count(*) AS n FROM tok {where} GROUP BY p), {name}t AS (SELECT coalesce(sum(n), 0) AS al, count(*) AS ty FROM {name}c),
{name} AS (SELECT doc_id, round(sum(m * log2((al + ty + 1) / (coalesce(n, 0) + 1))) / sum(m), 6) AS loss FROM ow LEFT JOIN {name}c USING (p), {name}t GROUP BY doc_id)"""


@query(f"""WITH {_TOK}, ow AS (SELECT doc_id, p, count(*) AS m FROM tok GROUP BY doc_id, p), {_loss_sql('te', '')}, {_loss_sql('st', "WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'varadhi_web')")},
g AS (SELECT doc_id, round(st.loss - te.loss, 6) AS gap FROM te JOIN st USING (doc_id)) SELECT doc_id, gap FROM g WHERE gap > (SELECT quantile_cont(gap, 0.8) FROM g)""")
def hard_set(s, d):
    """The fifth of the documents that a student, counts of one source only, finds harder than its teacher, counts of all, by the widest gap."""
    docs = _docs(s, d)
    teacher, student = counts.piece_counts(docs), counts.piece_counts(docs.where("source = 'varadhi_web'"))
    return quality.hard_set(quality.unigram_loss(docs, teacher, "teacher"), quality.unigram_loss(docs, student, "student"))


@query("""WITH q AS (SELECT source, floor(target_share * 400) AS k FROM sources WHERE target_share IS NOT NULL),
r AS (SELECT doc_id, source, k, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents JOIN q USING (source)) SELECT doc_id, source FROM r WHERE r <= k""")
def source_quota_mix(s, d):
    """A sample of 400 documents with each source's share as its quota."""
    return quality.source_quotas(_docs(s, d), table(s, d, "sources"), 400)


_TYPES = rf"""{_TURNS}, fu AS (SELECT conv_id, arg_min(text, (turn, text)) AS text FROM tn WHERE role = 'user' GROUP BY conv_id),
ty AS (SELECT conv_id, CASE WHEN regexp_matches(rtrim(text, ' '), '\?["''”’)]*$') THEN 'question' WHEN regexp_matches(rtrim(text, ' '), '
\s*([-*•]|\d+[.)])\s') THEN 'list' WHEN len({_PIECES}) <= 3 THEN 'short' ELSE 'statement' END AS type FROM fu)"""


@query(f"WITH {_TYPES} SELECT conv_id, type FROM (SELECT conv_id, type, row_number() OVER (PARTITION BY type ORDER BY md5(CAST(conv_id AS VARCHAR)), conv_id) AS r FROM ty) WHERE r <= 20")
def type_diversity(s, d):
    """At most 20 conversations of each type of instruction."""
    kinds = quality.instruction_types(table(s, d, "conversations")).withColumnRenamed("conv_id", "doc_id")
    return quality.stratified(kinds, "type", 20).withColumnRenamed("doc_id", "conv_id")


@query(f"""WITH {_TURNS}, tk AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN list_append({_PIECES}, '<eos>') ELSE {_PIECES} END AS w FROM tn)
SELECT conv_id, turn, role, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS token, CAST(role = 'assistant' AS INTEGER) AS loss FROM tk""")
def loss_mask_tokens(s, d):
    """1 on the assistant's tokens and their <eos>, 0 elsewhere."""
    return quality.loss_mask_tokens(table(s, d, "conversations"))


# sources and streams


@query("SELECT source, data_dir, approx_size_gb, round(sum(approx_size_gb) OVER (), 6) AS total_gb, round(1.5 * sum(approx_size_gb) OVER (), 6) AS wanted_gb FROM sources")
def size_estimate(s, d):
    """What the sources of the catalogue need on disk; a warning's figures."""
    c = table(s, d, "sources")
    total = c.agg(F.sum("approx_size_gb").alias("t"))
    return c.crossJoin(F.broadcast(total)).select("source", "data_dir", "approx_size_gb", F.round("t", 6).alias("total_gb"), F.round(F.col("t") * 1.5, 6).alias("wanted_gb"))  # one row


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE text IS NOT NULL) AS texts, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters FROM documents")
def observed_counts(s, d):
    """Counters of a stage, taken while its rows are written."""
    stage = Stage("documents", _docs(s, d), documents=F.count(F.lit(1)), texts=F.count("text"), characters=F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint"))
    got = stage.run(lambda rows: rows.select("doc_id", "text").write.format("noop").mode("overwrite").save())
    return s.createDataFrame([(got["documents"], got["texts"], got["characters"])], "documents bigint, texts bigint, characters bigint")


@query("SELECT doc_id, CASE WHEN length(text) > 5000 THEN text ELSE upper(text) END AS text, CASE WHEN length(text) > 5000 THEN 'ValueError' END AS error FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7f]', '?', 'g') AS text FROM documents)")
def tolerant_map(s, d):
    """A function that fails on some texts: those stay as they were, beside the error's name."""
    plain = _docs(s, d).select("doc_id", F.regexp_replace("text", r"[^\x00-\x7f]", "?").alias("text"))
    return tolerant.map_texts(plain, _upper)


def _upper(text: str) -> str:
    if len(text) > 5000:
        raise ValueError(len(text))
    return text.upper()


@query()
def files_largest_first(s, d):
    """The files of the data folder, the largest first."""
    return readers.largest_first(s, d).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "bytes", "rank")


@query()
def size_inventory(s, d):
    """Files and bytes of the data folder."""
    return sinks.size_inventory(s, d)


@query(SQL["core_word_freq"])
def stream_word_freq(s, d):
    """The word counts again, by a stream over the files."""
    return stream_core_word_counts(s, f"{d}/documents.parquet")
