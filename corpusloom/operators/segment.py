"""Morphemes of core words: a segmenter trained on word counts, its application to distinct words, and statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.batches import slices
from ..plans.tables import cut

#: Entries of a lexicon that is sent to the tasks; a larger one is joined to the words' substrings, with the same splits.
MOST_MORPHS = 500_000


def best_split(word: str, cost: dict[str, float], unseen: float, longest: int) -> list[str]:
    """The cheapest split of a word into morphs; single letters outside the lexicon cost `unseen` each. Ties: fewer parts, then the longest first."""
    n = len(word)
    best: list[tuple] = [(0.0, 0, ())]
    for j in range(1, n + 1):
        options = []
        for i in range(max(0, j - longest), j):
            c = cost.get(word[i:j], unseen if j - i == 1 else None)
            if c is not None:
                options.append((round(best[i][0] + c, 9), best[i][1] + 1, (*best[i][2], i - j)))
        best.append(min(options))
    out, at = [], 0
    for k in best[n][2]:
        out.append(word[at : at - k])
        at -= k
    return out


def _split(batches: Iterator[pa.RecordBatch], model: tuple) -> Iterator[pa.RecordBatch]:
    cost, unseen, longest, guard = model
    for b in batches:
        words = b.column("word").to_pylist()
        parts = [[w] if guard and len(w) > guard else best_split(w, cost, unseen, longest) for w in words]
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(parts, pa.list_(pa.string()))], ["word", "n", "parts"])


def _split_own(batches: Iterator[pa.RecordBatch], model: tuple) -> Iterator[pa.RecordBatch]:
    """The same by a lexicon of each word's own: the counts of those of its substrings that are morphs, beside the letters' costs."""
    letters, total, unseen, longest, guard = model
    for b in batches:
        words, parts = b.column("word").to_pylist(), []
        for w, own in zip(words, b.column("own").to_pylist()):
            cost = {c: letters[c] for c in w if c in letters} | {m["morph"]: math.log2(total / m["n"]) for m in own or ()}
            parts.append([w] if guard and len(w) > guard else best_split(w, cost, unseen, longest))
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(parts, pa.list_(pa.string()))], ["word", "n", "parts"])


def _substrings(word, least: int, most: int) -> object:
    """Column: the substrings of a word that have at least `least` and at most `most` letters."""
    each = lambda i: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(word) - i + 1)), lambda k: F.substring(word, i, k))
    return F.when(F.length(word) >= least, F.flatten(F.transform(F.sequence(F.lit(1), F.length(word) - least + 1), each))).otherwise(F.array().cast("array<string>"))


class Segmenter:
    """A lexicon (morph, n), each morph once. The cost of a split is its morphs' code length under the counts.

    A lexicon of at most MOST_MORPHS morphs is sent to the tasks; of a larger one only the single letters, and the rest is joined.
    """

    def __init__(self, lexicon: DataFrame, longest: int = 12, guard: int = 80):
        self.lexicon, self.longest, self.guard = lexicon, longest, guard
        self.size, total = lexicon.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.total = total + 1
        self.unseen = math.log2(self.total) + 8

    @property
    def counts(self) -> dict[str, int]:
        """The lexicon on the driver."""
        return {r["morph"]: r["n"] for r in self.lexicon.collect()}

    def _cost(self, lexicon: DataFrame) -> dict[str, float]:
        return {r["morph"]: math.log2(self.total / r["n"]) for r in lexicon.collect()}

    def sent(self) -> tuple:
        """What a task needs of a lexicon of at most MOST_MORPHS morphs."""
        return self._cost(self.lexicon), self.unseen, self.longest, self.guard

    def split(self, words: DataFrame) -> DataFrame:
        """(word, n, parts) of distinct words (word, n); words longer than the guard stay whole."""
        sc, words, out = words.sparkSession.sparkContext, words.select("word", "n"), "word string, n bigint, parts array<string>"
        if self.size <= MOST_MORPHS:
            sent = sc.broadcast(self.sent())
            return words.mapInArrow(lambda it: _split(it, sent.value), out)
        # letters occur in most words: they are sent, which also keeps hot keys out of the join
        sent = sc.broadcast((self._cost(self.lexicon.where(F.length("morph") == 1)), self.total, self.unseen, self.longest, self.guard))
        short = words.where(F.length("word") <= self.guard) if self.guard else words
        found = short.select("word", F.explode(F.array_distinct(_substrings(F.col("word"), 2, self.longest))).alias("morph")).join(self.lexicon, "morph")
        own = found.groupBy("word").agg(F.collect_list(F.struct("morph", "n")).alias("own"))
        return words.join(own, "word", "left").select("word", "n", "own").mapInArrow(lambda it: _split_own(it, sent.value), out)


def train(words: DataFrame, rounds: int = 4, dampening: str = "log", threshold: int = 2, weight: float = 1.0, longest: int = 12) -> Segmenter:
    """A segmenter from (word, n): all substrings of the words start the lexicon; then words are split and morphs recounted, round by round.

    A morph pays for its letters in the lexicon: it stays if its uses times weight save more than that, a higher weight splits less. Deterministic for any
    partitioning. The lexicon stays a table, whole at any size. An empty table gives an empty lexicon.
    """
    seen = cut(words.where(F.col("n") >= threshold).select("word", t.dampened(F.col("n"), dampening).alias("n")))
    morphs = seen.select(F.explode(_substrings(F.col("word"), 1, longest)).alias("morph"), "n").groupBy("morph").agg(F.sum("n").alias("n")).where((F.col("n") >= 2 * threshold) | (F.length("morph") == 1))
    start = F.greatest((F.col("n") * F.least(F.length("morph"), F.lit(4)) / (4 * weight)).cast("bigint"), F.lit(1))
    model = Segmenter(cut(morphs.select("morph", start.alias("n"))), longest)
    for _ in range(rounds):
        uses = model.split(seen).select(F.explode("parts").alias("morph"), "n").groupBy("morph").agg(F.sum("n").alias("n"))
        worth = F.col("n") * weight * F.log2(F.lit(1.0) + F.length("morph")) >= F.length("morph")
        model = Segmenter(cut(uses.where(worth | (F.length("morph") == 1))), longest)
    return model


def segment_documents(docs: DataFrame, split: DataFrame, profile=t.TELUGU, sep: str = t.SEP, id: str = "doc_id") -> DataFrame:
    """(id, tokens): each document in segments. split: (word, parts) of distinct core words, joined to the documents' distinct words; others stay whole.

    Documents without text, or with a blank one, have no row. Hot words are salted: a document's words are dealt to SALTS parts.
    """
    salt = F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int").alias("_salt")
    words = docs.select(id, salt, F.explode(F.array_distinct(t.core_words(F.col("text"), profile))).alias("word"))
    several = split.where(F.size("parts") > 1).select("word", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    own = words.join(several, ["word", "_salt"]).groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("word", "parts"))).alias("_parts"))
    both = docs.where("text IS NOT NULL").select(id, "text").join(own, id, "left").withColumn("_parts", F.coalesce("_parts", F.expr("cast(map() as map<string, array<string>>)")))
    tokens = t.segmented(F.col("text"), lambda w: F.coalesce(F.element_at("_parts", w), F.array(w)), profile, sep)
    return both.select(id, tokens.alias("tokens")).where(F.size("tokens") > 0)


#: Parts that a hot word's documents are dealt to.
SALTS = 16


def split_after(word: str, least: int, head: int) -> list[str]:
    """A deterministic segmenter: words of at least so many letters are split after the head."""
    return [word[:head], word[head:]] if len(word) >= least else [word]


def _by_model(word: str, model: tuple) -> list[str]:
    cost, unseen, longest, guard = model
    return [word] if guard and len(word) > guard else best_split(word, cost, unseen, longest)


def _segment(batches: Iterator[pa.RecordBatch], split: Callable[[str], list[str]], chars: str, sep: str, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    runs, core, memory = re.compile(f"[{chars}]+|[^{chars}]+"), re.compile(f"[{chars}]"), {}

    def tokens(piece: str) -> list[str]:
        parts = []
        for r in runs.findall(piece):
            parts += split(r) if core.match(r) else [r]
        return [*(x if x.endswith(sep) else x + sep for x in parts[:-1]), parts[-1]] if core.search(piece) else [piece]

    for b in slices(batches):
        rows = []
        for text in b.column("text").to_pylist():
            row: list[str] = []
            for p in text.split() if text else ():
                if (x := memory.get(p)) is None:
                    if len(memory) >= most:
                        memory.clear()
                    x = memory[p] = tokens(p)
                row += x
            rows.append(row)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.string()))], ["id", "tokens"])


def segment_texts(docs: DataFrame, model: Segmenter | Callable[[str], list[str]], profile=t.TELUGU, sep: str = t.SEP, id: str = "doc_id") -> DataFrame:
    """(id, tokens): each document in the segments of a model or a function of a word, within the row: each distinct piece of a task is taken apart once.

    Documents without text, or with a blank one, have no row. A lexicon too large for the tasks splits the distinct words, which are joined back.
    """
    split = model
    if isinstance(model, Segmenter) and model.size > MOST_MORPHS:
        words = docs.select(F.explode(t.core_words(F.col("text"), profile)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        return segment_documents(docs, model.split(words), profile, sep, id)
    if isinstance(model, Segmenter):
        sent = docs.sparkSession.sparkContext.broadcast(model.sent())
        split = lambda w: _by_model(w, sent.value)
    rows = docs.select(F.col(id).alias("id"), "text").mapInArrow(lambda it: _segment(it, split, profile.chars, sep), "id bigint, tokens array<string>")
    return rows.where(F.size("tokens") > 0).withColumnRenamed("id", id)


def morpheme_counts(split: DataFrame) -> DataFrame:
    """(morpheme, frequency): over word types, the words' counts of each part."""
    return split.select(F.explode("parts").alias("morpheme"), "n").groupBy("morpheme").agg(F.sum("n").alias("frequency"))


def statistics(split: DataFrame) -> DataFrame:
    """One row of nine figures on (word, n, parts); zeros on an empty table."""
    m = morpheme_counts(split).agg(F.count("*").alias("morpheme_types"), F.coalesce(F.avg(F.length("morpheme")), F.lit(0.0)).alias("length"))
    w = split.agg(F.count("*").alias("word_types"), F.count_if(F.size("parts") == 1).alias("whole"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.col("n") * F.size("parts")), F.lit(0)).alias("morphemes"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return w.crossJoin(m).select(  # one row each
        "word_types", "morpheme_types", F.round(ratio(F.col("word_types"), F.col("morpheme_types")), 2).alias("compression_ratio"), F.col("whole").alias("unsegmented_words"),
        F.round(ratio(F.col("whole") * 100.0, F.col("word_types")), 1).alias("unsegmented_pct"), F.round(ratio(F.col("morphemes"), F.col("words")), 2).alias("avg_morphemes_per_word_token"),
        F.round("length", 1).alias("avg_morpheme_length_chars"), F.col("words").alias("total_word_tokens"), F.col("morphemes").alias("total_morpheme_tokens"),
    )


#: Words that a report shows whatever their frequency.
SHOWN = ("గ్రామం", "విద్యార్థి", "పుస్తకం", "ఉద్యోగం", "నగరం", "విజ్ఞానం", "ప్రభుత్వం", "కుటుంబం")


def report(split: DataFrame, top: int = 30, shown=SHOWN) -> DataFrame:
    """(part, word, parts, n): the most frequent words of (word, n, parts), ties by code points, and those of a list that occur."""
    listed = split.where(F.col("word").isin(*shown)).select(F.lit("listed").alias("part"), "word", "parts", "n")
    return split.orderBy(F.desc("n"), "word").limit(top).select(F.lit("frequent").alias("part"), "word", "parts", "n").unionByName(listed)


#: Letters of a word, and characters of a text, beyond which it isn't segmented.
LONG_WORD, GIANT_TEXT = 80, 500_000


def guarded_word(word, segment, most: int = LONG_WORD):
    """Column: the parts of a word, or the word alone if it is longer than most."""
    return F.when(F.length(word) > most, F.array(word)).otherwise(segment(word))


def guarded_text(text, segment, most: int = GIANT_TEXT):
    """Columns: whether a text is longer than most, and its tokens, then its pieces as they are."""
    giant = F.length(text) > most
    return giant, F.when(giant, t.pieces(text)).otherwise(t.segmented(text, segment))
