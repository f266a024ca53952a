"""Occurrences and documents of every term over the whole collection (problem 1).

A global dictionary gives each term an integer. Blocks of documents encode their pieces by a block-local dictionary and add them up in two count
arrays, one for occurrences and one for the documents that hold the term; the arrays go out cut by identifier range and are summed range by range.
The dictionary is either given (a vocabulary) or made of the collection's own terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..plans.tables import cut, small
from .arrow import slices

#: Terms after which a block hands over its arrays: bounds the memory of a task, not the result.
BLOCK_TERMS = 400_000
#: Identifiers in a range whose arrays are summed together: of a given dictionary, and of the collection's own (terms of blocks, on average).
RANGE, RANGE_TERMS = 1024, 150_000
#: Entries of a dictionary that is sent to all tasks; a larger one is joined to the collection's own terms.
MOST_GIVEN = 2_000_000


def _add(ids: np.ndarray, lengths: np.ndarray, occ: np.ndarray, docs: np.ndarray) -> None:
    """Adds the ids of a slice of documents, laid end to end, to the count arrays; -1 stands for no id."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    keep = ids >= 0
    ids, doc = ids[keep], doc[keep]
    occ += np.bincount(ids, minlength=len(occ))
    seen = np.unique(doc * np.int64(len(docs)) + ids) % max(1, len(docs))
    docs += np.bincount(seen, minlength=len(docs))


def _given(batches: Iterator[pa.RecordBatch], ids: dict[str, int], size: int) -> Iterator[pa.RecordBatch]:
    occ, docs, blank = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
    n = 0
    for b in slices(batches):
        texts = [t.split() for t in b.column("text").to_pylist() if t]
        lengths = np.array([len(t) for t in texts], np.int64)
        n += int((lengths > 0).sum())
        get = ids.get
        _add(np.array([get(w, -1) for t in texts for w in t], np.int64), lengths, occ, docs)
    starts = range(0, size, RANGE)
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *(s // RANGE for s in starts)], pa.int32()), pa.array([[0], *(occ[s : s + RANGE] for s in starts)], pa.list_(pa.int64())), pa.array([[n], *(docs[s : s + RANGE] for s in starts)], pa.list_(pa.int64()))],
        ["range", "occ", "docs"],
    )


def counts_by_dictionary(docs: DataFrame, ids: dict[str, int], text: str = "text") -> DataFrame:
    """(token, id, occurrences, documents, all_documents) of each entry of a given dictionary, entries without an occurrence included.

    all_documents is the number of documents with non-blank text. Pieces are compared exactly as stored. Null, empty and blank texts count nowhere;
    rows that repeat a text are documents of their own. Entries under one id share its counts. An empty collection gives zeros.
    """
    spark = docs.sparkSession
    if len(ids) > MOST_GIVEN:
        return _joined(docs, ids, text)
    # ids of a vocabulary may have gaps; they are numbered without
    code = {i: k for k, i in enumerate(sorted(set(ids.values())))}
    local, size = {t: code[i] for t, i in ids.items()}, len(code)
    blocks = docs.select(F.col(text).alias("text")).mapInArrow(lambda it: _given(it, local, size), "range int, occ array<bigint>, docs array<bigint>")
    summed = blocks.select("range", F.posexplode(F.arrays_zip("occ", "docs")).alias("at", "x")).groupBy("range", "at").agg(F.sum("x.occ").alias("occurrences"), F.sum("x.docs").alias("documents"))
    total = summed.where("range = -1").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("all_documents"))
    entries = spark.createDataFrame([(t, i, local[t] // RANGE, local[t] % RANGE) for t, i in ids.items()], "token string, id int, range int, at int")
    counted = entries.join(summed, ["range", "at"], "left").select("token", "id", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("documents", F.lit(0)).alias("documents"))
    return counted.crossJoin(F.broadcast(total))  # one row


def _joined(docs: DataFrame, ids: dict[str, int], text: str) -> DataFrame:
    """The same for a dictionary that isn't sent to the tasks. Entries under one id share the sum of their counts; a document that holds two of them counts
    for each."""
    entries = docs.sparkSession.createDataFrame(list(ids.items()), "token string, id int")
    own = entries.join(counts_of_all_terms(docs, text).select("token", "occurrences", "documents"), "token", "left")
    sums = own.groupBy("id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("occurrences", "documents")))
    blank = F.size(F.filter(F.split(F.col(text), WHITE), lambda x: x != "")) > 0
    total = docs.agg(F.count_if(blank).alias("all_documents"))
    return entries.join(sums, "id").select("token", "id", "occurrences", "documents").crossJoin(F.broadcast(total))  # one row


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, occ, docs) of blocks of documents: each encodes its pieces by a dictionary of its own and hands its arrays over."""
    local: dict[str, int] = {}
    occ, docs = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def out() -> pa.RecordBatch:
        n = len(local)
        return pa.RecordBatch.from_arrays([pa.array(list(local), pa.string()), pa.array(occ[:n].copy()), pa.array(docs[:n].copy())], ["token", "occ", "docs"])

    for b in slices(batches):
        texts = [t.split() for t in b.column("text").to_pylist() if t]
        ids = np.array([local.setdefault(w, len(local)) for t in texts for w in t], np.int64)
        while len(local) > len(occ):
            occ, docs = np.concatenate([occ, np.zeros_like(occ)]), np.concatenate([docs, np.zeros_like(docs)])
        if len(ids):
            _add(ids, np.array([len(t) for t in texts], np.int64), occ, docs)
        if len(local) > BLOCK_TERMS:
            yield out()
            local.clear()
            occ[:], docs[:] = 0, 0
    if local:
        yield out()


def _summed(t: pa.Table) -> pa.Table:
    """A range's part of the global dictionary, its terms numbered by code points, and the blocks' arrays summed by these numbers."""
    coded = t.column("token").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    terms, code = coded.dictionary, coded.indices.to_numpy()
    rank = np.empty(len(terms), np.int64)
    rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
    arrays = []
    for c in ("occ", "docs"):
        total = np.zeros(len(terms), np.int64)
        np.add.at(total, rank[code], t.column(c).to_numpy())
        arrays.append(total)
    return pa.table({"range": pa.array(np.full(len(terms), t.column("range")[0].as_py()), pa.int32()), "place": np.arange(len(terms)), "token": terms.take(pc.sort_indices(terms)), "occurrences": arrays[0], "documents": arrays[1]})


def counts_of_all_terms(docs: DataFrame, text: str = "text", ranges: int | None = None) -> DataFrame:
    """(term_id, token, occurrences, documents) of every distinct piece of the texts; term_id numbers the terms densely from 0.

    A block sends each of its terms once, so a frequent term is no hot key. Ranges of the dictionary, as many as the blocks' terms ask for, number their terms
    by code points and sum the blocks' arrays by these numbers; ranges follow each other, and only their sizes (a row each) are brought together. Null, empty
    and blank texts add nothing.
    """
    blocks = cut(docs.select(F.col(text).alias("text")).mapInArrow(lambda it: _own(it), "token string, occ bigint, docs bigint"))
    many = ranges or max(1, blocks.count() // RANGE_TERMS)
    ranged = blocks.withColumn("range", F.pmod(F.xxhash64("token"), F.lit(many)).cast("int"))
    summed = cut(ranged.groupBy("range").applyInArrow(lambda t: _summed(t), "range int, place bigint, token string, occurrences bigint, documents bigint"))
    sizes = summed.groupBy("range").agg(F.count("*").alias("size"))
    bases = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("base"))
    return summed.join(small(bases), "range").select((F.col("base") + F.col("place")).alias("term_id"), "token", "occurrences", "documents")


def marks(counts: DataFrame, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """(token, mark) of the counted entries in fewer documents than rare_below (`rare`) or in more than that share of all (`common`)."""
    mark = F.when(F.col("documents") < rare_below, "rare").when(F.col("documents") > F.col("all_documents") * common_above, "common")
    return counts.select("token", mark.alias("mark")).where("mark is not null")
