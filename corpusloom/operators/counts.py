"""Counts of words and tokens. Every aggregation combines in the tasks before it shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def with_text(docs: DataFrame) -> DataFrame:
    """The documents whose text is neither null nor empty."""
    return docs.where("text IS NOT NULL AND text <> ''")


def core_word_counts(docs: DataFrame, profile=t.TELUGU) -> DataFrame:
    """(word, n) of all runs of core letters."""
    return with_text(docs).select(F.explode(t.core_words(F.col("text"), profile)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def piece_counts(docs: DataFrame) -> DataFrame:
    """(token, n) of all pieces."""
    return with_text(docs).select(F.explode(t.pieces(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """(token, n) of a table with arrays of tokens."""
    return tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def segmented_counts(docs: DataFrame, segment, profile=t.TELUGU) -> DataFrame:
    """(token, n) of the segmented texts: each distinct piece is segmented once and weighted by its count."""
    tokens = t.segmented(F.col("token"), segment, profile)
    return piece_counts(docs).select(F.explode(tokens).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


def top(counts: DataFrame, key: str, n: int, least_first: bool = False) -> DataFrame:
    """The n most (or least) frequent, ties by code points. The limit is what is asked for."""
    return counts.orderBy(F.asc("n") if least_first else F.desc("n"), key).limit(n)


def other_counts(tokens: DataFrame, profile=t.TELUGU) -> DataFrame:
    """(base, n) of the counted tokens (token, n) without core letters, their marks taken off."""
    base = tokens.select(t.base_form(F.col("token")).alias("base"), "n")
    return base.where(~t.has_core(F.col("base"), profile)).groupBy("base").agg(F.sum("n").alias("n"))


def core_counts(tokens: DataFrame, profile=t.TELUGU) -> DataFrame:
    """(token, n) of the counted tokens with core letters, marks kept."""
    return tokens.where(t.has_core(t.base_form(F.col("token")), profile))


def kept_ratios(tokens: DataFrame, profile=t.TELUGU) -> DataFrame:
    """One row for counted tokens: all, those with core letters, their share and their types; 0 on an empty table."""
    c = tokens.withColumn("core", t.has_core(t.base_form(F.col("token")), profile))
    kept = F.coalesce(F.sum(F.when(F.col("core"), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return c.agg(total.alias("total"), kept.alias("kept"), F.round(F.coalesce(F.try_divide(kept * 100, total), F.lit(0.0)), 6).alias("pct"), F.count_if("core").alias("types"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(l, r, n): adjacent pairs of symbols over words (symbols, freq); overlapping pairs count each time."""
    at = F.explode(F.sequence(F.lit(1), F.size("symbols") - 1)).alias("i")
    pairs = words.where(F.size("symbols") > 1).select("symbols", "freq", at)
    return pairs.select(F.col("symbols")[F.col("i") - 1].alias("l"), F.col("symbols")[F.col("i")].alias("r"), "freq").groupBy("l", "r").agg(F.sum("freq").alias("n"))


def pair_index(words: DataFrame) -> DataFrame:
    """(l, r, words): the distinct words (word, symbols) that hold each adjacent pair, in order. As long as the table of words together with its symbols."""
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda i: F.struct(F.element_at("symbols", i).alias("l"), F.element_at("symbols", i + 1).alias("r"))))
    return words.where(F.size("symbols") > 1).select("word", F.explode(pairs).alias("p")).groupBy("p.l", "p.r").agg(F.sort_array(F.collect_set("word")).alias("words"))


def symbols(word) -> object:
    """Column: the characters of a word."""
    return F.filter(F.split(word, ""), lambda c: c != "")


def merge_pair(words: DataFrame, left: str, right: str) -> DataFrame:
    """(word, symbols, freq) with one merge applied, from left to right without overlap."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("held"))

    def step(acc, s):
        hit = acc["held"] & (s == right)
        out = F.when(hit, F.concat(acc["out"], F.array(F.lit(left + right)))).when(acc["held"], F.concat(acc["out"], F.array(F.lit(left)), F.when(s == left, F.array().cast("array<string>")).otherwise(F.array(s)))).when(s == left, acc["out"]).otherwise(F.concat(acc["out"], F.array(s)))
        return F.struct(out.alias("out"), (~hit & (s == left)).alias("held"))

    done = F.aggregate("symbols", empty, step, lambda acc: F.when(acc["held"], F.concat(acc["out"], F.array(F.lit(left)))).otherwise(acc["out"]))
    return words.withColumn("symbols", done)
