"""The languages of documents and of their segments, by prediction by partial matching (problem 2).

For each language a tree of byte contexts of every order up to ORDER holds the counts of the bytes that follow, taken from samples of known language and
frozen. A byte's code length is read off the longest context that knows the byte; each context that doesn't adds an escape, whose probability grows with
the context's distinct bytes, and bytes that a longer context knows are excluded from the shorter ones, so that the probabilities of all bytes sum to one.
Contexts run across blanks within a sentence. A byte and its context are one 64-bit number, so a task computes the lengths of each distinct one once. Sentences sum
up their bytes; neighbouring sentences of one language make a segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .confusables import compare_key, fold
from .labels import LANGS, lang_code

ORDER = 7  # with the byte itself a context fills 64 bits
#: Rows of samples that are used at most, by language: the models' size follows from it.
SAMPLES = 5_000
#: Words of a sentence that counts, and bits by which its language must lead over the next one, and over the document's main one, if it is another.
LEAST_WORDS, LEAD, OVER_MAIN = 8, 15.0, 40.0
#: Distinct bytes in context, and distinct pieces, that a task remembers.
MOST_WINDOWS, MOST_PIECES = 1_000_000, 200_000
_U = np.uint64
_MASK = [_U((1 << 8 * n) - 1) for n in range(9)]

_end = re.compile(r"[.?!।॥]+[\"'”’)\]}]*$")


def piece_bytes(piece: str) -> bytes:
    """What a piece adds to its sentence: its folded letters and a blank; nothing if it has no letters."""
    key = compare_key(piece)
    return key.replace("\0", "").encode("utf-8", "replace") + b" " if any(c.isalpha() for c in key) else b""


def windows(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER bytes before it in its sentence as a 64-bit number, the byte itself lowest; and its place in the sentence."""
    a = np.frombuffer(data, np.uint8)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(a)]])))
    w = np.zeros(len(a), _U)
    for k in range(min(ORDER, len(a) - 1) + 1):
        w[k:] |= a[: len(a) - k].astype(_U) << _U(8 * k)
    return w & np.array(_MASK[1:], _U)[np.minimum(place, ORDER)], place


class Tree:
    """The frozen counts of one language: for each order its contexts and its pairs of context and byte, sorted."""

    def __init__(self, texts: list[str]):
        parts = [b" " + x for t in texts if (x := b"".join(map(piece_bytes, t.split())))]
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        w, place = windows(b"".join(parts), starts)
        self.pairs, self.count, self.context, self.total, self.kinds, self.parent, self.rest, self.rest_kinds = ([] for _ in range(8))
        for n in range(ORDER + 1):
            pairs, count = np.unique(w[place > max(n - 1, 0)] & _MASK[n + 1], return_counts=True)  # the first blank is given
            context, of = np.unique(pairs >> _U(8), return_inverse=True)
            total, kinds = np.bincount(of, count, len(context)), np.bincount(of, minlength=len(context))
            parent, rest, rest_kinds = np.zeros(len(context), np.int64), total, kinds
            if n:
                # what the next shorter context holds besides the bytes of this one, all of which it knows
                parent = np.searchsorted(self.context[-1], context & _MASK[n - 1])
                shorter = self.count[-1][np.searchsorted(self.pairs[-1], pairs & _MASK[n])]
                rest = self.total[-1][parent] - np.bincount(of, shorter, len(context))
                rest_kinds = self.kinds[-1][parent] - kinds
            for x, y in zip((self.pairs, self.count, self.context, self.total, self.kinds, self.parent, self.rest, self.rest_kinds), (pairs, count, context, total, kinds, parent, rest, rest_kinds)):
                x.append(y)

    def bits(self, w: np.ndarray) -> np.ndarray:
        """Code lengths of bytes in context."""
        out, node, order = np.zeros(len(w)), np.zeros(len(w), np.int64), np.full(len(w), -1)
        if not len(self.context[0]):
            return out + 8
        for n in range(ORDER, -1, -1):  # the longest context that is known at all
            todo = np.flatnonzero(order < 0)
            key = (w[todo] >> _U(8)) & _MASK[n]
            at = np.searchsorted(self.context[n], key)
            hit = np.flatnonzero(self.context[n][np.minimum(at, len(self.context[n]) - 1)] == key) if len(self.context[n]) else []
            order[todo[hit]], node[todo[hit]] = n, at[hit]
        total, kinds = np.zeros(len(w)), np.zeros(len(w))
        left = np.ones(len(w), bool)
        for n in range(ORDER, -1, -1):
            rows = np.flatnonzero(left & (order >= n))
            first = rows[order[rows] == n]
            total[first], kinds[first] = self.total[n][node[first]], self.kinds[n][node[first]]
            if not len(rows):
                continue
            key = w[rows] & _MASK[n + 1]
            at = np.minimum(np.searchsorted(self.pairs[n], key), len(self.pairs[n]) - 1)
            hit = self.pairs[n][at] == key
            known, missed = rows[hit], rows[~hit]
            out[known] += np.log2(total[known] + kinds[known]) - np.log2(self.count[n][at[hit]])
            left[known] = False
            out[missed] += np.log2((total[missed] + kinds[missed] + (kinds[missed] == 0)) / np.maximum(kinds[missed], 1))  # without kinds left nothing is left to escape from
            if n:
                here = node[missed]
                total[missed], kinds[missed], node[missed] = self.rest[n][here], self.rest_kinds[n][here], self.parent[n][here]
        out[left] += np.log2(256 - self.kinds[0][0])
        return out


def train(samples: list[tuple[str, str]]) -> tuple[Tree, ...]:
    """Frozen statistics of (language, text) rows, for each language of LANGS."""
    return tuple(Tree([t or "" for lang, t in samples if lang == g]) for g in LANGS)


class Scorer:
    """Code lengths under the frozen trees, with a bounded memory of pieces and of bytes in context."""

    def __init__(self, trees: tuple[Tree, ...]):
        self.trees = trees
        self.nothing = np.zeros(0, _U), np.zeros((len(LANGS), 0), np.float32)
        self.known = [self.nothing, self.nothing]  # sorted: most of them, and those met lately
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.ends: list[bool] = []
        self.counts: list[bool] = []

    def __getitem__(self, piece: str) -> int:
        """The row of a piece in bytes, ends and counts."""
        if (r := self.rows.get(piece)) is None:
            r = self.rows[piece] = len(self.rows)
            self.bytes.append(piece_bytes(piece))
            self.ends.append(bool(_end.search(fold(piece))))
            self.counts.append(bool(compare_key(piece)))
        return r

    def bits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of bytes in context in the lengths, and the lengths of the distinct ones, a row for each language."""
        distinct, of = np.unique(w, return_inverse=True)
        out = np.empty((len(LANGS), len(distinct)), np.float32)
        left = np.ones(len(distinct), bool)
        for keys, lengths in self.known:
            if len(keys):
                rows = np.flatnonzero(left)
                at = np.minimum(np.searchsorted(keys, distinct[rows]), len(keys) - 1)
                hit = keys[at] == distinct[rows]
                out[:, rows[hit]] = lengths[:, at[hit]]
                left[rows[hit]] = False
        if left.any():
            new = distinct[left]
            out[:, left] = np.array([t.bits(new) for t in self.trees], np.float32)
            self.known[1] = _merged(self.known[1], (new, out[:, left]))
            if len(self.known[1][0]) > max(50_000, len(self.known[0][0]) // 4):  # rarely: sorting all takes longer
                old = self.known[0] if len(self.known[0][0]) <= MOST_WINDOWS else self.nothing
                self.known = [_merged(old, self.known[1]), self.nothing]
        return of, out


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]], 1)[:, order]


@lru_cache(2)
def _scorer(samples: tuple) -> Scorer:
    return Scorer(train(samples))


def sentences(texts: list[str | None], s: Scorer):
    """Arrays of the sentences of texts, in order: document, first piece, pieces, words, bits (a row of LANGS)."""
    if len(s.rows) > MOST_PIECES:
        s.reset()
    code, doc, close = [], [], []
    for d, t in enumerate(texts):
        for line in (t or "").splitlines():
            if row := [s[w] for w in line.split()]:
                code += row
                doc += [d] * len(row)
                close += [False] * (len(row) - 1) + [True]
    if not code:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros((0, len(LANGS))),)
    parts = [s.bytes[c] for c in code]
    code, doc = np.array(code), np.array(doc)
    last = np.array(close) | np.array(s.ends)[code]
    start = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    size = np.diff(np.concatenate([start, [len(code)]]))
    for k in start.tolist():
        parts[k] = b" " + parts[k]
    length = np.add.reduceat(np.array([len(x) for x in parts]), start)
    begin = np.cumsum(length) - length
    w, place = windows(b"".join(parts), begin)
    at, lengths = s.bits(w)
    bits = np.empty((len(start), len(LANGS)))
    for g in range(len(LANGS)):
        bits[:, g] = np.add.reduceat(np.where(place > 0, lengths[g][at], 0).astype(np.float64), begin)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    piece = start - np.repeat(first, np.diff(np.concatenate([first, [len(doc)]])))[start]
    return doc[start], piece, size, np.add.reduceat(np.array(s.counts)[code].astype(np.int64), start), bits


def _judged(bits: np.ndarray, words: np.ndarray):
    """Best language, its lead over the next in bits, and its share of the languages' probabilities at the bits of one average word."""
    best = bits.argmin(1)
    ordered = np.sort(bits, 1)
    p = np.exp2(-(bits - ordered[:, :1]) / np.maximum(words, 1)[:, None])
    return best, ordered[:, 1] - ordered[:, 0], 1 / p.sum(1)


def _contained(batches: Iterator[pa.RecordBatch], samples: tuple) -> Iterator[pa.RecordBatch]:
    s = _scorer(samples)
    for b in slices(batches):
        doc, _, _, words, bits = sentences(b.column("text").to_pylist(), s)
        best, lead, conf = _judged(bits, words)
        whole = np.zeros((len(b), len(LANGS)))
        np.add.at(whole, doc, bits)
        main = whole.argmin(1)[doc]
        over = bits[np.arange(len(doc)), main] - bits[np.arange(len(doc)), best]
        ok = (words >= LEAST_WORDS) & ((lead >= LEAD) & (over >= OVER_MAIN) | (lead > 0) & (best == main))
        pair, n = np.unique(doc[ok] * len(LANGS) + best[ok], return_counts=True)
        most = np.zeros(len(b) * len(LANGS))
        np.maximum.at(most, doc[ok] * len(LANGS) + best[ok], conf[ok])
        row = pa.array(pair // len(LANGS))
        yield pa.RecordBatch.from_arrays([b.column("id").take(row), b.column("named").take(row), pa.array([LANGS[g] for g in pair % len(LANGS)], pa.string()), pa.array(n), pa.array(most[pair])], ["id", "named", "lang", "sentences", "confidence"])


def _segments(batches: Iterator[pa.RecordBatch], samples: tuple) -> Iterator[pa.RecordBatch]:
    s = _scorer(samples)
    for b in slices(batches):
        ids = b.column("id").to_pylist()
        doc, at, size, words, bits = sentences(b.column("text").to_pylist(), s)
        best, lead, _ = _judged(bits, words)
        # a sentence too short or too even to tell goes with the one before it, or else the one after it
        sure = (words >= 3) & (lead >= LEAD)
        first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
        number = np.arange(len(doc))
        before = np.maximum.accumulate(np.where(sure, number, -1)) if len(doc) else number
        after = np.minimum.accumulate(np.where(sure, number, len(doc))[::-1])[::-1] if len(doc) else number
        of = lambda k: (k >= 0) & (k < len(doc)) & (doc[np.clip(k, 0, max(len(doc) - 1, 0))] == doc)
        place = np.where(of(before), before, np.where(of(after), after, -1))
        lang = np.where(place >= 0, best[np.maximum(place, 0)], best)
        new = first | np.concatenate([[True], lang[1:] != lang[:-1]])[: len(lang)] if len(doc) else first
        start = np.flatnonzero(new)
        rows = []
        if len(start):
            total, n = np.add.reduceat(bits, start), np.add.reduceat(words, start)
            pieces = np.add.reduceat(size, start)
            p = np.exp2(-(total - total.min(1, keepdims=True)) / np.maximum(n, 1)[:, None])
            conf = p[np.arange(len(start)), lang[start]] / p.sum(1)
            number = np.arange(len(start)) - np.searchsorted(doc[start], doc[start], "left")
            rows = list(zip((ids[d] for d in doc[start]), number.tolist(), at[start].tolist(), pieces.tolist(), n.tolist(), (LANGS[g] for g in lang[start]), np.round(conf, 6).tolist()))
        c = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.int32()) for x in c[1:5]), pa.array(c[5], pa.string()), pa.array(c[6], pa.float64())], ["id", "segment", "start", "pieces", "words", "lang", "confidence"])


def samples_of(samples: DataFrame) -> tuple:
    """At most SAMPLES rows of each language, least ids first: what the models are fitted on."""
    from pyspark.sql import Window

    by = Window.partitionBy("lang").orderBy("sample_id")
    rows = samples.where(F.col("lang").isin(*LANGS)).withColumn("k", F.row_number().over(by)).where(F.col("k") <= SAMPLES).orderBy("lang", "sample_id")
    return tuple((r["lang"], r["text"]) for r in rows.select("lang", "text").collect())


def contained(docs: DataFrame, samples: tuple) -> DataFrame:
    """(doc_id, named, lang, sentences, confidence): each language in which a row has a whole sentence or line of LEAST_WORDS words or more.

    named is the code that the row's label names, null for a missing or unknown label. Null, empty and blank texts contain none; a repeated row has rows
    of its own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    rows = docs.select(F.col("doc_id").alias("id"), lang_code(F.col("lang")).alias("named"), "text")
    return rows.mapInArrow(lambda it: _contained(it, sent.value), "id bigint, named string, lang string, sentences bigint, confidence double").withColumnRenamed("id", "doc_id")


def unnamed(docs: DataFrame, samples: tuple) -> DataFrame:
    """(doc_id, lang) of each language that a document contains and its label doesn't name."""
    return contained(docs, samples).where(~F.col("lang").eqNullSafe(F.col("named"))).select("doc_id", "lang").distinct()


def segments(docs: DataFrame, samples: tuple, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, segment, start, pieces, words, lang, confidence): the stretches of one language of each document; start and pieces count whitespace-separated
    pieces. Documents without text have no segment; text without letters goes with its neighbours, alone it gets an even confidence."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: _segments(it, sent.value), "id bigint, segment int, start int, pieces int, words int, lang string, confidence double").withColumnRenamed("id", id)


def languages(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, lang, confidence, languages): of each document with segments the language of most words (ties: the first in order of the codes), the
    confidence weighted by words and by that language's share of the words, and how many languages there are."""
    by = found.groupBy(id, "lang").agg(F.sum("words").alias("words"), F.sum(F.col("confidence") * F.col("words")).alias("weight"))
    return by.groupBy(id).agg(F.min_by(F.struct("lang", "weight"), F.struct(-F.col("words"), F.col("lang"))).alias("top"), F.sum("words").alias("all"), F.count("*").cast("int").alias("languages")).select(id, F.col("top.lang").alias("lang"), F.round(F.coalesce(F.try_divide(F.col("top.weight"), F.col("all")), F.lit(0.0)), 6).alias("confidence"), "languages")
