"""The queries of the operators for training data, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import cut, table
from . import budget, confusables, langid, mixing, neardup, packing, termfreq, tiling, truncation
from .labels import ALIASES


def _vocabulary(spark: SparkSession, d: str, all_: bool = False) -> dict[str, int]:
    r = table(spark, d, "tokenizer").select("token_to_id", "separator").first()
    return {t: i for t, i in r["token_to_id"].items() if all_ or i >= 4 and not t.endswith(r["separator"])}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the vocabulary that too few or too many documents hold."""
    return termfreq.marks(termfreq.counts_by_dictionary(table(spark, d, "documents"), _vocabulary(spark, d)))


def p1_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and documents of every entry of the vocabulary."""
    return termfreq.counts_by_dictionary(table(spark, d, "documents"), _vocabulary(spark, d, True)).select("token", "id", "occurrences", "documents")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and documents of every distinct piece."""
    return termfreq.counts_of_all_terms(table(spark, d, "documents")).select("token", "occurrences", "documents")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages that documents contain and their labels don't name."""
    return langid.unnamed(table(spark, d, "documents"), langid.samples_of(table(spark, d, "lang_samples")))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of one language in each document."""
    return langid.segments(table(spark, d, "documents"), langid.samples_of(table(spark, d, "lang_samples")))


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """The main language of each document."""
    return langid.languages(p2_segments(spark, d))


def p3_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each source, data_dir, language and domain."""
    return budget.token_budget(table(spark, d, "documents"), table(spark, d, "sources"), budget.spec_of(table(spark, d, "tokenizer")))


def p3_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Token totals at several levels."""
    return budget.rolled_up(cut(p3_token_budget(spark, d)))


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Which documents lie in which training block, for every configuration."""
    docs = table(spark, d, "documents")
    n = budget.document_tokens(docs, budget.spec_of(table(spark, d, "tokenizer")))
    lengths = n.select("doc_id", F.when(F.col("n_tokens") > 0, F.col("n_tokens") + 1).otherwise(0).alias("n"))  # each document ends in <eos>
    return packing.packed(lengths, table(spark, d, "model_config"), max(1, docs.count() // packing.SHARD))


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and unused positions of every configuration."""
    return packing.summary(cut(p4_blocks(spark, d)), table(spark, d, "model_config"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share at least 80 per cent of their words."""
    return neardup.similar_pairs(table(spark, d, "documents"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each document's class of equal texts, group of similar ones and number of links."""
    return neardup.groups(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a character variant."""
    return confusables.variant_documents(table(spark, d, "documents"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text in the consistent form."""
    return confusables.canonical_texts(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items in documents."""
    return tiling.leaked(p7_tiles(spark, d))


def p7_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of document and item with a shared seed: the item's words, those covered by tiles, the longest tile and how many there are."""
    return tiling.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_covered(spark: SparkSession, d: str) -> DataFrame:
    """Items of which tiles cover at least half, in any order, and the share covered."""
    return tiling.covered(p7_tiles(spark, d))


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(mixing.document_sizes(table(spark, d, "documents")))  # ids, sources and numbers: the texts are read once
    return sizes, cut(mixing.rates(sizes, table(spark, d, "sources")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources too small for their share."""
    return mixing.short_sources(*_rated(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source really gets."""
    return mixing.shares(*_rated(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture, once for each copy."""
    return mixing.mixed(*_rated(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were cut off."""
    return truncation.judged(table(spark, d, "documents")).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source's documents were cut off."""
    return truncation.rates(truncation.judged(table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_vocabulary, p1_terms, p2_found, p2_segments, p2_languages, p3_token_budget, p3_rollup, p4_blocks, p4_summary, p5_found, p5_groups, p6_found, p6_texts, p7_found, p7_tiles, p7_covered, p8_found, p8_shares, p8_mix, p9_found, p9_rates)}


_PIECES = r"list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')"
_COUNTED = f"""
WITH d AS (SELECT doc_id, {_PIECES} AS w FROM documents WHERE text IS NOT NULL),
o AS (SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(w) AS token FROM d) GROUP BY token),
n AS (SELECT count(*) AS c FROM d WHERE len(w) > 0),
v AS (SELECT unnest(map_keys(token_to_id)) AS token, unnest(map_values(token_to_id)) AS id, separator FROM tokenizer)
"""
_ALIAS = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIASES.items())
#: Tokens of each distinct piece: whole ones are one, others are cut into runs of core and other letters; core runs count by letters, others by merged symbols.
_BUDGET = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, {_PIECES} AS w, text, source, lang, domain FROM documents),
tok AS (SELECT n, unnest(w) AS p FROM d), v AS (SELECT unnest(map_keys(token_to_id)) AS token FROM tokenizer),
dp AS (SELECT DISTINCT p FROM tok), ms AS (SELECT p, CASE WHEN regexp_matches(p, '[ఀ-౿]') THEN regexp_extract_all(p, '[ఀ-౿]+|[^ఀ-౿]+') ELSE [p] END AS rs FROM dp WHERE p NOT IN (SELECT token FROM v)),
rn AS (SELECT p, k, r, k < len(rs) AS cont, CASE WHEN k < len(rs) AND NOT ends_with(r, '@@') THEN r || '@@' ELSE r END AS t FROM (SELECT p, rs, unnest(rs) AS r, generate_subscripts(rs, 1) AS k FROM ms)),
rw AS (SELECT DISTINCT t, CASE WHEN ends_with(t, '@@') THEN substring(t, 1, length(t) - 2) ELSE t END AS b, ends_with(t, '@@') AS cont FROM rn WHERE t NOT IN (SELECT token FROM v)),
cl AS (SELECT t, cont, unnest(string_split(b, '')) AS c, generate_subscripts(string_split(b, ''), 1) AS i, length(b) AS l FROM rw WHERE regexp_matches(b, '[ఀ-౿]')),
cc AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE CASE WHEN i < l THEN a.token IS NULL WHEN cont THEN a.token IS NULL AND z.token IS NULL ELSE z.token IS NULL END) AS u
  FROM cl LEFT JOIN v a ON a.token = cl.c || '@@' LEFT JOIN v z ON z.token = cl.c GROUP BY t),
mw AS (SELECT DISTINCT b AS p FROM rw WHERE b <> '' AND NOT regexp_matches(b, '[ఀ-౿]')),
mg AS (SELECT k AS rank, chr(1) || bpe_merges[k][1] || chr(2) || chr(1) || bpe_merges[k][2] || chr(2) AS pat, chr(1) || bpe_merges[k][1] || bpe_merges[k][2] || chr(2) AS rep FROM (SELECT bpe_merges, unnest(range(1, len(bpe_merges) + 1)) AS k FROM tokenizer)),
bp(p, step, s) AS (SELECT p, 0, array_to_string(list_transform(string_split(p, ''), lambda c: chr(1) || c || chr(2)), '') FROM mw
  UNION ALL SELECT p, step + 1, replace(s, m.pat, m.rep) FROM (SELECT bp.p, any_value(bp.step) AS step, any_value(bp.s) AS s, arg_min(struct_pack(pat := mg.pat, rep := mg.rep), mg.rank) AS m FROM bp, mg WHERE contains(bp.s, mg.pat) GROUP BY bp.p)),
bs AS (SELECT p, unnest(sy) AS y, generate_subscripts(sy, 1) AS j, len(sy) AS m FROM (SELECT p, list_filter(string_split(replace(arg_max(s, step), chr(2), ''), chr(1)), lambda x: x <> '') AS sy FROM bp GROUP BY p)),
bi AS (SELECT bs.*, CASE WHEN j = m THEN z.token ELSE a.token END AS known FROM bs LEFT JOIN v a ON a.token = bs.y || '@@' LEFT JOIN v z ON z.token = bs.y),
bc AS (SELECT p, j, m, unnest(string_split(y, '')) AS c, generate_subscripts(string_split(y, ''), 1) AS i, length(y) AS l FROM bi WHERE known IS NULL),
bj AS (SELECT p, 1 AS n, 0 AS u FROM bi WHERE known IS NOT NULL UNION ALL SELECT bc.p, 1, CAST(CASE WHEN j = m AND i = l THEN z.token ELSE a.token END IS NULL AS INTEGER) FROM bc LEFT JOIN v a ON a.token = bc.c || '@@' LEFT JOIN v z ON z.token = bc.c),
bt AS (SELECT p, sum(n) AS n, sum(u) AS u FROM bj GROUP BY p),
ru AS (SELECT t, n, u FROM cc UNION ALL SELECT t, n, u FROM rw JOIN bt ON bt.p = rw.b UNION ALL SELECT token, 1, 0 FROM v),
pt AS (SELECT p, sum(ru.n) AS n, sum(ru.u) AS u FROM rn JOIN ru USING (t) GROUP BY p UNION ALL SELECT p, 1, 0 FROM dp WHERE p IN (SELECT token FROM v)),
dt AS (SELECT tok.n, sum(pt.n) AS tokens, sum(pt.u) AS unknown FROM tok JOIN pt USING (p) GROUP BY tok.n),
kd AS (SELECT n, nullif(regexp_replace(lower(trim(source, ' ')), '[-\\s]+', '_', 'g'), '') AS source, CASE regexp_replace(lower(trim(lang, ' ')), '_', '-', 'g') {_ALIAS} END AS lang, domain FROM d),
ag AS (SELECT source, lang, domain, count(*) AS documents, count(*) FILTER (WHERE tokens > 0) AS with_text, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(unknown), 0) AS BIGINT) AS unknown FROM kd LEFT JOIN dt USING (n) GROUP BY ALL),
sn AS (SELECT regexp_replace(lower(trim(source, ' ')), '[-\\s]+', '_', 'g') AS source, any_value(data_dir) AS data_dir FROM sources GROUP BY 1),
bu AS (SELECT ag.source, data_dir, lang, domain, documents, with_text, tokens, unknown FROM ag LEFT JOIN sn USING (source))
"""
_SUMS = "CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(with_text) AS BIGINT) AS with_text, CAST(sum(tokens) AS BIGINT) AS tokens"


def _rolled() -> str:
    dims = ("source", "data_dir", "lang", "domain")
    levels = {"all": (), "source": ("source", "data_dir"), "data_dir": ("data_dir",), "lang": ("lang",), "domain": ("domain",), "source_lang": ("source", "data_dir", "lang")}
    return _BUDGET + " UNION ALL ".join(f"SELECT '{k}' AS level, {', '.join(c if c in by else f'CAST(NULL AS VARCHAR) AS {c}' for c in dims)}, {_SUMS} FROM bu" + (f" GROUP BY {', '.join(by)}" if by else "") for k, by in levels.items())


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""{_COUNTED} SELECT token, mark FROM (
            SELECT v.token, CASE WHEN coalesce(o.documents, 0) < 3 THEN 'rare' WHEN o.documents > 0.25 * n.c THEN 'common' END AS mark
            FROM v LEFT JOIN o USING (token), n WHERE v.id >= 4 AND NOT ends_with(v.token, v.separator)) WHERE mark IS NOT NULL""",
        "p1_vocabulary": f"""{_COUNTED} SELECT v.token, v.id, coalesce(o.occurrences, 0) AS occurrences, coalesce(o.documents, 0) AS documents FROM v LEFT JOIN o USING (token)""",
        "p1_terms": f"""{_COUNTED} SELECT token, occurrences, documents FROM o""",
        "p3_token_budget": f"{_BUDGET} SELECT * FROM bu",
        "p3_rollup": _rolled(),
    }
