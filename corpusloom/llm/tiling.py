"""Evaluation texts in training texts, by greedy string tiling (problem 7).

Shared-token seeds come first: a rolling hash (Karp and Rabin's) over every run of a few words in the documents is looked up among the seeds of the
items. A pair of document and item that shares a seed is tiled: again and again the longest runs of words that are unmarked on both sides are found by
hashed runs of falling lengths and marked, until no run of the least length is left. The tiles tell the item's covered share, whatever the order
of the passages, and the longest unbroken run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .confusables import Keys, compare_key

SEED = 5
#: Items whose seeds are sent to the tasks at a time; more items are taken in blocks, each against all documents.
ITEMS = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def word_code(piece: str) -> int:
    """64-bit code of a piece as it is compared; 0 for a piece without letters or digits."""
    k = compare_key(piece)
    return xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) | 1 if k else 0


codes = Keys(word_code)


def coded(text: str | None) -> np.ndarray:
    """Codes of the words of a text, in order."""
    a = np.array([codes[w] for w in text.split()], np.uint64) if text else np.zeros(0, np.uint64)
    return a[a != 0]


def rolling(a: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n codes: a polynomial in the base, modulo 2^64, mixed."""
    if len(a) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(a) - n + 1, np.uint64)
    for k in range(n):
        h = h * _BASE + a[k : len(a) - n + 1 + k] * _MIX
    return h ^ (h >> np.uint64(29))


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in document, words), longest first, none overlapping another on either side; ties go to the first places.

    Search lengths fall: a bisection finds the longest run of unmarked words that both sides hold, by Karp and Rabin's hashes of all runs of a length, and
    one pass marks all runs of that length. A pass takes time in proportion to the words, however repetitive they are; lengths only fall.
    """
    sides = [np.asarray(item, np.uint64), np.asarray(doc, np.uint64)]
    free = [np.ones(len(x), bool) for x in sides]
    sums = []
    power = np.cumprod(np.full(max(map(len, sides)) + 1, _BASE, np.uint64))
    power = np.concatenate([[np.uint64(1)], power])
    for x in sides:  # prefix sums of word * base^place: a run's hash is a difference, brought to a common power
        sums.append(np.concatenate([[np.uint64(0)], np.cumsum(x * _MIX * power[: len(x)])]))
    top = len(power) - 1

    def runs(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the unmarked runs of n words."""
        marked = np.concatenate([[0], np.cumsum(~free[k])])
        at = np.flatnonzero(marked[n:] == marked[:-n]) if len(sides[k]) >= n else np.zeros(0, np.int64)
        return at, (sums[k][at + n] - sums[k][at]) * power[top - at]

    tiles, high = [], min(map(len, sides))
    while high >= least:
        low = least - 1
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if np.isin(runs(0, n)[1], runs(1, n)[1]).any() else (low, n - 1)
        if low < least:
            break
        (p, hp), (q, hq) = runs(0, low), runs(1, low)
        inside = np.isin(hq, hp)
        where = defaultdict(list)
        for place, h in zip(q[inside][::-1].tolist(), hq[inside][::-1].tolist()):
            where[h].append(place)  # the first place comes off last
        inside = np.isin(hp, hq)
        found = 0
        for i, h in zip(p[inside].tolist(), hp[inside].tolist()):
            if not free[0][i : i + low].all():
                continue
            while where[h] and not free[1][where[h][-1] : where[h][-1] + low].all():
                where[h].pop()  # a marked place is never free again
            if where[h] and (sides[0][i : i + low] == sides[1][where[h][-1] : where[h][-1] + low]).all():
                j = where[h].pop()
                tiles.append((i, j, low))
                free[0][i : i + low] = free[1][j : j + low] = False
                found += 1
        high = low if found else low - 1  # only a collision of hashes finds none
    return tiles


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, bytes]], share: float) -> Iterator[pa.RecordBatch]:
    own = [(i, np.frombuffer(x, np.uint64)) for i, x in items]
    least = [max(1, min(SEED, -int(-len(a) * share // 1))) for _, a in own]
    tables = []
    for n in sorted(set(least)):
        h = [(x, k) for k, (_, a) in enumerate(own) if least[k] == n for x in set(rolling(a, n).tolist())]
        h.sort()
        keys = np.array([x for x, _ in h], np.uint64)
        maybe = np.zeros(1 << 20, bool)
        maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
        tables.append((n, keys, [k for _, k in h], maybe))
    for b in slices(batches):
        ids, rows = b.column("doc_id").to_pylist(), []
        parts = [coded(t) for t in b.column("text").to_pylist()]
        ends = np.cumsum([len(p) for p in parts])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        pairs = set()
        for n, keys, of, maybe in tables:
            h = rolling(flat, n)
            at = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)]) if len(h) else []
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            doc = np.searchsorted(ends, at, "right")
            whole = (hi > lo) & (at + n <= ends[np.minimum(doc, len(ends) - 1)])
            for d, x, y in zip(doc[whole].tolist(), lo[whole].tolist(), hi[whole].tolist()):
                pairs.update((d, k) for k in of[x:y])
        for d, k in sorted(pairs):
            item = own[k][1]
            tiles = tile(item, parts[d], least[k])
            rows.append((ids[d], own[k][0], len(item), sum(t[2] for t in tiles), max(t[2] for t in tiles), len(tiles)))
        if rows:
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.int32()) for x in c[2:])], ["doc_id", "item_id", "words", "covered", "longest", "tiles"])


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.5, id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, words, covered, longest, tiles) of every document and item that share a run of SEED words, or of the share of a shorter item.

    Letter case, punctuation, spacing and character variants don't count. Items without words match nothing; items with the same words each get their
    rows, and so do rows that repeat a text. Null ids stay null. Documents aren't shuffled: the items go to the tasks, in blocks of ITEMS.
    """
    spark, found = docs.sparkSession, None
    items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    first = items.limit(ITEMS + 1).collect()
    many = 1 if len(first) <= ITEMS else -(-items.count() // ITEMS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(many))
    for k in range(many):
        # the blocks are hashed, so one may hold a few more items than ITEMS; a block is on the driver only while it is sent
        block = [(r[0], coded(r[1]).tobytes()) for r in (first if many == 1 else items.where(part == k).collect())]
        sent = spark.sparkContext.broadcast(sorted(((i, x) for i, x in block if x), key=lambda t: (t[0] is None, t[0] or 0, t[1])))
        rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it, sent=sent: _search(it, sent.value, share), "doc_id bigint, item_id bigint, words int, covered int, longest int, tiles int")
        found = rows if found is None else found.unionByName(rows)
    return found


def leaked(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id) of the pairs whose longest unbroken run has at least that share of the item's words."""
    return pairs.where(F.col("longest") >= F.col("words") * share).select("doc_id", "item_id").distinct()


def covered(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, coverage) of the pairs whose tiles cover at least that share of the item's words: also reordered and interrupted passages."""
    coverage = F.round(F.col("covered") / F.col("words"), 6)
    return pairs.where(F.col("covered") >= F.col("words") * share).groupBy("doc_id", "item_id").agg(F.max(coverage).alias("coverage"))
