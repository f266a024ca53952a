"""Merges learned from word counts.

Spark reduces the corpus to distinct words of a least frequency; the merge loop, sequential by nature, runs over that bounded table.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.batches import slices
from ..plans.tables import cut
from . import counts

#: Distinct words that the loop takes; beyond, the pairs are counted in rounds.
MOST_WORDS = 5_000_000


def merged_pair(symbols: list[str], left: str, right: str) -> list[str]:
    """The symbols with a pair merged from left to right, without overlap."""
    out, i = [], 0
    while i < len(symbols):
        hit = i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right
        out.append(left + right if hit else symbols[i])
        i += 1 + hit
    return out


def merges_of(words: dict[str, int], merges: int, lazy: bool = False) -> tuple[list[tuple[str, str]], Counter]:
    """The merges in order, and how often each remaining symbol occurs.

    The most frequent pair is merged, ties go to the least pair; it stops below a count of 2. With lazy a pair whose count has fallen isn't looked at
    again unless a merge makes it anew, as in a loop that only queues rising counts.
    """
    rows = [(list(w), f) for w, f in sorted(words.items())]
    count: Counter = Counter()
    where: dict[tuple, set] = defaultdict(set)
    for k, (s, f) in enumerate(rows):
        for p in zip(s, s[1:]):
            count[p] += f
            where[p].add(k)
    heap = [(-n, p) for p, n in count.items()]
    heapq.heapify(heap)
    done: list[tuple[str, str]] = []
    while len(done) < merges and heap:
        n, pair = heapq.heappop(heap)
        now = count.get(pair, 0)
        if now != -n:
            if not lazy and now >= 2:
                heapq.heappush(heap, (-now, pair))
            continue
        if now < 2:
            break
        done.append(pair)
        risen = set()
        for k in sorted(where.pop(pair)):
            s, f = rows[k]
            for p in zip(s, s[1:]):
                count[p] -= f
                if p in where:
                    where[p].discard(k)
            out = merged_pair(s, *pair)
            rows[k] = (out, f)
            for p in zip(out, out[1:]):
                count[p] += f
                where[p].add(k)
                risen.add(p)
        count.pop(pair, None)
        for p in risen:
            if count[p] >= 2:
                heapq.heappush(heap, (-count[p], p))
    left: Counter = Counter()
    for s, f in rows:
        for x in s:
            left[x] += f
    return done, left


def train(words: DataFrame, merges: int = 8000, min_freq: int = 5, lazy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rank, left, right) and (subword, frequency) from (word, n): the loop runs on the driver, or in rounds over more than MOST_WORDS words."""
    spark = words.sparkSession
    kept = cut(words.where((F.col("n") >= min_freq) & (F.col("word") != "")).select("word", "n"))
    if kept.count() > MOST_WORDS:
        if lazy:
            raise ValueError(f"more than {MOST_WORDS} words; a loop that forgets pairs runs on the driver only")
        return learned_in_rounds(kept, merges)
    done, left = merges_of({r[0]: r[1] for r in kept.collect()}, merges, lazy)
    return (
        spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(done)], "rank int, left string, right string"),
        spark.createDataFrame(sorted(left.items()), "subword string, frequency bigint"),
    )


def encode_in_order(word: str, merges: list[tuple[str, str]]) -> list[str]:
    """Symbols of a word after each merge has been applied once, in order."""
    s = list(word)
    for a, b in merges:
        s = merged_pair(s, a, b)
    return s


def _in_order(batches: Iterator[pa.RecordBatch], merges: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "word"):
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("freq"), pa.array([encode_in_order(w, merges) for w in b.column("word").to_pylist()], pa.list_(pa.string()))], ["word", "freq", "symbols"])


def applied_in_order(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """(word, freq, symbols) of distinct words (word, freq) after each merge has been applied once, in order."""
    sent = words.sparkSession.sparkContext.broadcast(merges)  # as many as were asked for in training
    return words.where("word IS NOT NULL").select("word", "freq").mapInArrow(lambda it: _in_order(it, sent.value), "word string, freq bigint, symbols array<string>")


def learned_in_rounds(words: DataFrame, merges: int, every: int = 8) -> tuple[DataFrame, DataFrame]:
    """What train gives, for more distinct words (word, n) than the driver can hold: each round counts the pairs and merges the best one in all words.

    Only the best pair of a round comes to the driver; lineage is cut every few rounds.
    """
    rows = cut(words.select("word", counts.symbols(F.col("word")).alias("symbols"), F.col("n").alias("freq")))
    done: list[tuple[int, str, str]] = []
    while len(done) < merges:
        best = counts.pair_counts(rows).where("n >= 2").orderBy(F.desc("n"), "l", "r").first()
        if best is None:
            break
        done.append((len(done), best["l"], best["r"]))
        rows = counts.merge_pair(rows, best["l"], best["r"])
        if len(done) % every == 0:
            rows = cut(rows)
    left = rows.select(F.explode("symbols").alias("subword"), "freq").groupBy("subword").agg(F.sum("freq").alias("frequency"))
    return words.sparkSession.createDataFrame(done, "rank int, left string, right string"), left
