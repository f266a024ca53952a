"""Texts that were cut off (problem 9).

A backward character n-gram model, trained on all lines of all documents: for the last 1 to ORDER characters before a place it counts how often the
line ended there and how often it went on, in each language and in all. Lines that a line break follows are whole; the last line of a text is what is
judged. Counts are taken of words (how often a word stands in lines of a language, how often at their ends), so the model comes from the distinct words.

A text's final context is looked up in every order, the longer orders leaning on the shorter; other languages' places count less than its own; its log-odds of end against
continuation are held against a threshold of its language, between a line's places at large and its ends.

Last lines without a sentence's end are also judged by their column, by log-odds again. In texts of several lines it is the kind of line: how often lines
with the same first word have just so many words, leaning on how often last lines of that length recur in this way; so bylines, tag lines, link lines and list
items are told from sentences, with no least number of times. In texts of one line it is the headline: how many there are of about that length, against
how many the cut lines of other texts let expect. An end is natural if either log-odds speak for it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, join_counted
from .arrow import slices
from .confusables import Keys, fold
from .labels import LANGS, lang_code, source_key

#: Characters of the longest context, and places by which an order leans on the shorter one.
ORDER, LEAN = 6, 20.0
#: How far from a line's places at large to its ends a language's threshold lies.
WAY = 0.4
#: What a place in a text of another language counts.
OTHERS = 0.5
#: The share of lines with one first word that a kind of line has: what speaks against a kind counts that much.
SHARE = 0.06
#: Lines that the length's share of recurring kinds stands for.
WEIGHT = 2
#: Lengths from one class of lengths to the next.
STEP = 1.3
END = ".?!।॥"

folded = Keys(lambda w: fold(w).lower())


def last_line(text: str | None) -> list[str]:
    """Folded words of the last line that has any; empty for a blank text."""
    for line in reversed((text or "").rstrip().splitlines()):
        if words := [x for w in line.split() if (x := folded[w])]:
            return words
    return []


def _ends(word: str) -> bool:
    return word.rstrip("\"'”’)]}")[-1:] in tuple(END)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    finals: Counter = Counter()
    starts: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        rows = [("word", lang, w, 0, n, finals[lang, w]) for (lang, w), n in words.items()] + [("start", lang, w, k, n, 0) for (lang, w, k), n in starts.items()]
        c = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:3]), pa.array(c[3], pa.int32()), *(pa.array(x, pa.int64()) for x in c[4:])], ["what", "lang", "w", "k", "n", "ends"])

    for b in slices(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            lines = [x for x in (text or "").rstrip().splitlines() if x and not x.isspace()]
            for k, line in enumerate(lines):
                row = [x for w in line.split() if (x := folded[w])]
                if not row:
                    continue
                if len(lines) > 1:
                    n = 0 if _ends(row[-1]) else len(row)
                    starts[lang, row[0], n] += 1
                if k < len(lines) - 1:  # whole
                    words.update((lang, w) for w in row)
                    finals[lang, row[-1]] += 1
                else:  # what comes before the last word surely went on
                    words.update((lang, w) for w in row[:-1])
        if len(words) > 300_000:
            yield from out()
            words.clear(), finals.clear(), starts.clear()
    yield from out()


def _finals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, source, lang, context, column, first, words, single): prose ends a sentence or holds one's end on a single line; others are open lines or headlines."""
    for b in slices(batches):
        rows = []
        for i, source, lang, text in zip(*(b.column(c).to_pylist() for c in ("id", "source", "lang", "text"))):
            if line := last_line(text):
                single = len((text or "").strip().splitlines()) == 1
                open_ = not (any(_ends(w) for w in line) if single else _ends(line[-1]))
                column = ("headline" if single else "line") if open_ else "prose"
                rows.append((i, source, lang, (" " + line[-1])[-ORDER:], column, line[0] if column == "line" else None, len(line), single))
        c = list(zip(*rows)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.string()) for x in c[1:6]), pa.array(c[6], pa.int32()), pa.array(c[7], pa.bool_())], ["id", "source", "lang", "context", "column", "first", "words", "single"])


def _odds(p):
    return F.log(p / (1 - p))


def _ends_of_contexts(words: DataFrame, contexts: DataFrame) -> DataFrame:
    """(lang, context, documents, threshold, log_odds) of final contexts (lang, context, documents), from the counts of words (lang, w, n, ends)."""
    of = lambda *by: words.groupBy(*by).agg(F.log((F.sum("ends") + 0.5) / (F.sum(F.col("n") * F.length("w")) + 0.5)).alias("base"))
    # how likely a line's end is after the characters that lines end in: per language, from a row for each character
    chars = words.groupBy("lang", F.expr("right(w, 1)").alias("c")).agg(F.sum("ends").alias("e"), F.sum("n").alias("n"))
    sure = chars.groupBy("lang").agg((F.sum(F.col("e") * F.col("e") / F.col("n")) / (F.sum("e") + LEAN)).alias("sure"))
    sure = sure.select("lang", F.greatest("sure", F.lit(1e-6)).alias("sure"))
    base = F.broadcast(of("lang").join(sure, "lang").select("lang", "base", (F.col("base") * (1 - WAY) + _odds(F.col("sure")) * WAY).alias("threshold")))  # a row for each code
    # places in a word: after its first characters it went on; after the last one it went on unless the line ended
    at = F.explode(F.sequence(F.lit(1), F.length("w"))).alias("at")
    places = words.select("lang", F.concat(F.lit(" "), "w").alias("w"), "n", "ends", at)
    whole = F.col("at") == F.length("w") - 1
    places = places.select("lang", F.expr(f"substring(w, greatest(at + 2 - {ORDER}, 1), least({ORDER}, at + 1))").alias("c"), F.when(whole, F.col("n") - F.col("ends")).otherwise(F.col("n")).alias("on"), F.when(whole, F.col("ends")).otherwise(0).alias("ends"))
    longest = places.groupBy("lang", "c").agg(F.sum("on").alias("on"), F.sum("ends").alias("ends"))
    # a row for each order and context, with each language's counts beside each other: they travel once
    codes = [*LANGS, "und"]
    suffixes = longest.select("lang", F.explode(F.sequence(F.lit(1), F.length("c"))).alias("k"), "c", "on", "ends").select("lang", "k", F.expr("right(c, k)").alias("c"), "on", "ends")
    model = suffixes.groupBy("k", "c").agg(*(F.sum(F.when(F.col("lang") == g, F.col(x))).alias(f"{x}_{g}") for g in codes for x in ("ends", "on")))
    # its own language's places and a part of the others': labels are wrong at times
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = lambda x: zero(F.coalesce(*(F.when(F.col("lang") == g, F.col(f"{x}_{g}")) for g in codes)))
    all_ = lambda x: sum((zero(F.col(f"{x}_{g}")) for g in codes[1:]), zero(F.col(f"{x}_{codes[0]}")))
    mixed = lambda x: (own(x) * (1 - OTHERS) + all_(x) * OTHERS).alias(x)
    tails = contexts.select("lang", "context", F.explode(F.sequence(F.lit(1), F.length("context"))).alias("k")).withColumn("c", F.expr("right(context, k)"))
    seen = tails.join(model, ["k", "c"]).select("lang", "context", F.struct("k", mixed("ends"), mixed("on")).alias("x"))
    known = seen.groupBy("lang", "context").agg(F.sort_array(F.collect_list("x")).alias("seen"))
    score = contexts.join(known, ["lang", "context"], "left").join(base, "lang", "left")
    start = F.coalesce("base", F.lit(-6.0))
    # from the shortest context to the longest, each share of ends leans on the one before by LEAN places
    share = F.aggregate(F.coalesce("seen", F.array()), F.exp(start) / (1 + F.exp(start)), lambda p, x: (x["ends"] + p * LEAN) / (x["ends"] + x["on"] + LEAN))
    return score.select("lang", "context", "documents", F.coalesce("threshold", start * (1 - WAY)).alias("threshold"), _odds(share).alias("log_odds"))


def _length(words):
    """The class of lengths that a number of words falls into."""
    return F.floor(F.log(words) / float(np.log(STEP)) + 1e-9).cast("int")


def _kinds_of_lines(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(first, words, documents, column_odds) of open last lines (first, words, documents), from the counts of first words (w, k, n): k words and open, or 0."""
    total = starts.groupBy(F.col("w").alias("first")).agg(F.sum("n").alias("all"))
    same = starts.where("k > 0").groupBy(F.col("w").alias("first"), F.col("k").alias("words")).agg(F.sum("n").alias("n"))
    # the line itself speaks neither for nor against
    rows = lines.join(same, ["first", "words"], "left").join(total, "first", "left")
    rows = cut(rows.select("first", "words", "documents", (F.coalesce("n", F.lit(1)) - 1).alias("n"), (F.coalesce("all", "n", F.lit(1)) - F.coalesce("n", F.lit(1))).alias("on")))
    recurs = (F.col("n") >= 1) & (F.col("n") >= SHARE * F.col("on"))
    length = rows.groupBy(_length(F.col("words")).alias("length")).agg(F.sum(F.when(recurs, F.col("documents")).otherwise(0)).alias("r"), F.sum("documents").alias("d"))
    length = F.broadcast(length.select("length", ((F.col("r") + 0.5) / (F.col("d") + 1)).alias("r")))  # some fifty rows
    rows = rows.withColumn("length", _length(F.col("words"))).join(length, "length")
    return rows.select("first", "words", "documents", F.log((F.col("n") + WEIGHT * F.col("r")) / (SHARE * F.col("on") + WEIGHT * (1 - F.col("r")))).alias("column_odds"))


def _headlines(finals: DataFrame, starts: DataFrame) -> DataFrame:
    """(length, headline_odds): texts of one line without a sentence's end against those that cuts make, by their length.

    A cut hits any line alike, so cut lines that aren't a text's first tell how many first ones there should be.
    """
    heads = finals.where("column = 'headline'").groupBy(_length(F.col("words")).alias("length")).agg(F.count("*").alias("heads"))
    open_ = finals.where("column = 'line' AND coalesce(column_odds, 0) <= 0").groupBy(_length(F.col("words")).alias("length")).agg(F.count("*").alias("cuts"))
    # a first line for each text; the other lines are those of texts of several lines but the first
    whole = finals.agg(F.count("*").alias("texts"), F.count_if(F.col("single")).alias("single")).crossJoin(starts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines")))
    rate = whole.select((F.col("texts") / F.greatest(F.col("lines") - F.col("texts") + F.col("single"), F.lit(1))).alias("rate"))
    both = heads.join(open_, "length", "left").crossJoin(rate)  # one row
    return both.select("length", F.log(F.col("heads") / (F.coalesce("cuts", F.lit(0)) * F.col("rate") + 0.5)).alias("headline_odds"))


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, source, lang, column_kind, log_odds, threshold, column_odds, cut) of every document with text.

    lang is the code that the label names, `und` for none; column_kind is prose, line (an open last line) or headline (an open only line); cut tells whether
    the text was cut off. Null, empty and blank texts have no row; repeated rows have one each. Nothing is dropped for a context that nobody knows: it
    falls back to shorter ones, at last to the base; a first word that nobody knows falls back to its line's length.
    """
    rows = docs.select(F.col(id).alias("id"), source_key(F.col("source")).alias("source"), F.coalesce(lang_code(F.col("lang")), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = rows.select("lang", "text").mapInArrow(lambda it: _counts(it), "what string, lang string, w string, k int, n bigint, ends bigint")
    counts = cut(counts.groupBy("what", "lang", "w", "k").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))
    starts = counts.where("what = 'start'")
    finals = cut(rows.mapInArrow(lambda it: _finals(it), "id bigint, source string, lang string, context string, column string, first string, words int, single boolean"))
    score = cut(_ends_of_contexts(counts.where("what = 'word'"), finals.groupBy("lang", "context").agg(F.count("*").alias("documents"))))
    kinds = cut(_kinds_of_lines(finals.where("first IS NOT NULL").groupBy("first", "words").agg(F.count("*").alias("documents")), starts))
    # hot contexts and first words are joined apart
    lines = join_counted(finals.where("first IS NOT NULL"), kinds, ["first", "words"], "documents")
    known = cut(finals.where("first IS NULL").withColumn("column_odds", F.lit(None).cast("double")).unionByName(lines))
    heads = F.broadcast(_headlines(known, starts))  # some fifty rows
    out = join_counted(known, score, ["lang", "context"], "documents").withColumn("length", _length(F.col("words"))).join(heads, "length", "left")
    odds = F.when(F.col("column") == "headline", F.col("headline_odds")).when(F.col("column") == "line", F.col("column_odds"))
    natural = (F.col("log_odds") >= F.col("threshold")) | (F.coalesce(odds, F.lit(-1.0)) > 0)
    return out.select(F.col("id").alias(id), "source", "lang", F.col("column").alias("column_kind"), F.round("log_odds", 4).alias("log_odds"), F.round("threshold", 4).alias("threshold"), F.round(odds, 4).alias("column_odds"), (~natural).alias("cut"), "context", "first", "words")


def rates(found: DataFrame) -> DataFrame:
    """(source, documents, cut, rate) of judged documents by source; null for documents without one."""
    return found.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut")).withColumn("rate", F.round(F.col("cut") / F.col("documents"), 6))
