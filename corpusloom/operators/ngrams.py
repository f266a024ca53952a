"""N-grams of token ids and canonical ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from .pack import offsets


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def canonical_ids(vocab: DataFrame, sep: str = t.SEP, nfkc: bool = True) -> DataFrame:
    """(id, canonical_id): entries (token, id) that differ by marks, case (and compatibility forms) share one; numbered by their least ids."""
    norm = F.lower(F.replace("token", F.lit(sep), F.lit("")))
    keyed = vocab.withColumn("norm", F.trim(_nfkc(norm) if nfkc else norm))
    first = keyed.groupBy("norm").agg(F.min("id").alias("first"))
    numbered = offsets(first.withColumn("n", F.lit(1).cast("bigint")), "first")  # by ranges of the ids
    return keyed.join(numbered.select("norm", F.col("start").cast("int").alias("canonical_id")), "norm").select("id", "canonical_id")


def suffix_ngrams(rows: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, pos, back2, back1, token_id) of each position of (id, ids); null before the start. Made within the row, without a window."""
    at = F.expr("transform(ids, (x, i) -> struct(i as pos, case when i >= 2 then ids[i - 2] end as back2, case when i >= 1 then ids[i - 1] end as back1, x as token_id))")
    return rows.select(id, F.explode(at).alias("g")).select(id, "g.pos", "g.back2", "g.back1", "g.token_id")


#: A multiplier for each place of an n-gram. Products stay below 2^63.
WEIGHTS = (1000003, 8191, 131071)


def hash_slots(ngrams: DataFrame, slots: int = 500009, id: str = "doc_id") -> DataFrame:
    """(id, pos, slot2, slot3): multiplied ids, xored, modulo the table's size; null where the n-gram is incomplete."""
    m = lambda c, w: F.col(c).cast("bigint") * F.lit(w)
    h2 = m("back1", WEIGHTS[0]).bitwiseXOR(m("token_id", WEIGHTS[1]))
    h3 = m("back2", WEIGHTS[0]).bitwiseXOR(m("back1", WEIGHTS[1])).bitwiseXOR(m("token_id", WEIGHTS[2]))
    return ngrams.select(id, "pos", F.pmod(h2, F.lit(slots)).alias("slot2"), F.pmod(h3, F.lit(slots)).alias("slot3"))


#: Odd multipliers for the heads, one for each head and each place back from the end; products stay below 2^63 for ids below 2^31.
HEADS = tuple(tuple(2 * (1009 * head + 7919 * back) + 1 for back in range(3)) for head in range(8))


def hash_heads(ngrams: DataFrame, slots: int = 500009, id: str = "doc_id") -> DataFrame:
    """(id, pos, order, head, slot): of each position a slot for every head and for n-grams of two and three ids; incomplete ones have none."""
    ids = [F.col("token_id").cast("bigint"), F.col("back1").cast("bigint"), F.col("back2").cast("bigint")]

    def slot(n: int, w: tuple[int, ...]):
        h = ids[0] * w[0]
        for x, k in zip(ids[1:n], w[1:n]):
            h = h.bitwiseXOR(x * k)
        return F.pmod(h, F.lit(slots))

    each = F.array(*(F.struct(F.lit(n).alias("order"), F.lit(k).alias("head"), slot(n, w).alias("slot")) for n in (2, 3) for k, w in enumerate(HEADS)))
    return ngrams.select(id, "pos", F.explode(each).alias("h")).select(id, "pos", "h.order", "h.head", "h.slot").where("slot IS NOT NULL")


def cumulative(skewed: DataFrame) -> DataFrame:
    """(n, bigrams, occurrences, share_of_bigrams, share_of_occurrences): what bigrams of n occurrences or more make up of all. skewed: skew's rows, one for
    each number of occurrences that there is, so at most some square root of the corpus."""
    above, whole = Window.orderBy(F.desc("n")), Window.partitionBy()
    share = lambda c: F.round(F.sum(c).over(above) / F.sum(c).over(whole), 6)
    return skewed.select("n", "bigrams", "occurrences", share("bigrams").alias("share_of_bigrams"), share("occurrences").alias("share_of_occurrences"))


def skew(ngrams: DataFrame) -> DataFrame:
    """(n, bigrams, occurrences): how many distinct bigrams occur n times, and their occurrences."""
    c = ngrams.where("back1 IS NOT NULL").groupBy("back1", "token_id").agg(F.count("*").alias("n"))
    return c.groupBy("n").agg(F.count("*").alias("bigrams"), F.sum("n").alias("occurrences"))
