"""Tokens of texts under a given tokenizer, by source, language and domain (problem 3).

A piece that stands in the vocabulary is one token. A piece with letters of the core script is cut into runs of core and other letters, marked with
the separator. Other runs are merged: the piece is a doubly linked list of symbols and a priority queue holds the merges that are possible, lowest rank
first; the symbols that survive are counted, one by one if the vocabulary lacks them. Runs of core letters outside the vocabulary count by letters.
Each distinct piece is encoded once per task and weighted by its frequency.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import Encoder, checked
from .arrow import slices
from .confusables import Keys
from .labels import lang_code, source_key


@lru_cache(2)
def _encoder(spec: tuple) -> tuple[Encoder, Keys]:
    ids, merges, sep, core, unk = spec
    e = Encoder(dict(ids), merges, sep, core, unk)
    return e, Keys(lambda w: (len(x := e.piece(w)), x.count(unk)))


def spec_of(tokenizer: DataFrame, core: str = "ఀ-౿") -> tuple:
    """What the tasks need of a tokenizer table's one row; its size, the vocabulary's, is checked."""
    r = tokenizer.select("token_to_id", "bpe_merges", "separator", "special_tokens").first()
    checked(max(len(r["token_to_id"]), len(r["bpe_merges"] or [])))
    unk = (r["special_tokens"] or {}).get("<unk>", 1)
    return (tuple(sorted(r["token_to_id"].items())), tuple((m[0], m[1]) for m in r["bpe_merges"] or []), r["separator"] or "@@", core, unk)


def _counted(texts: list[str | None], memory: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and unknown tokens of each text: a row each of tokens of its distinct pieces, weighted by their frequencies."""
    local: dict[str, int] = {}
    parts = [t.split() if t else [] for t in texts]
    code = np.array([local.setdefault(w, len(local)) for p in parts for w in p], np.int64)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    cost = np.array([memory[w] for w in local], np.int64).reshape(-1, 2)
    pair, times = np.unique(doc * max(1, len(local)) + code, return_counts=True)
    of, weight = pair // max(1, len(local)), cost[pair % max(1, len(local))] * times[:, None] if len(pair) else np.zeros((0, 2), np.int64)
    total = np.zeros((len(parts), 2), np.int64)
    np.add.at(total, of, weight)
    return total[:, 0], total[:, 1]


def _documents(batches: Iterator[pa.RecordBatch], spec: tuple) -> Iterator[pa.RecordBatch]:
    _, memory = _encoder(spec)
    for b in slices(batches):
        n, _ = _counted(b.column("text").to_pylist(), memory)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n)], ["id", "n_tokens"])


def document_tokens(docs: DataFrame, spec: tuple, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens) of every row; null, empty and blank texts have none."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)  # the vocabulary
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lambda it: _documents(it, sent.value), "id bigint, n_tokens bigint").withColumnRenamed("id", id)


def _sums(batches: Iterator[pa.RecordBatch], spec: tuple) -> Iterator[pa.RecordBatch]:
    _, memory = _encoder(spec)
    total: dict[tuple, list[int]] = {}
    for b in slices(batches):
        texts = b.column("text").to_pylist()
        n, unk = _counted(texts, memory)
        for key, tokens, unknown in zip(zip(*(b.column(c).to_pylist() for c in ("source", "lang", "domain"))), n.tolist(), unk.tolist()):
            t = total.setdefault(key, [0, 0, 0, 0])
            t[0] += 1
            t[1] += tokens > 0
            t[2] += tokens
            t[3] += unknown
    rows = [(*k, *v) for k, v in total.items()]
    c = list(zip(*rows)) or [[]] * 7
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:3]), *(pa.array(x, pa.int64()) for x in c[3:])], ["source", "lang", "domain", "documents", "with_text", "tokens", "unknown"])


def token_budget(docs: DataFrame, sources: DataFrame, spec: tuple) -> DataFrame:
    """(source, data_dir, lang, domain, documents, with_text, tokens, unknown): exact sums of every slice.

    Sources that are spelled differently are one; a source that the table of sources lacks keeps its key and has no data_dir. lang is the code that the
    label names, null for none. Tasks add up their slices, so a large source is no hot key. Documents without text count as documents only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(source_key(F.col("source")).alias("source"), lang_code(F.col("lang")).alias("lang"), "domain", "text")
    parts = rows.mapInArrow(lambda it: _sums(it, sent.value), "source string, lang string, domain string, documents bigint, with_text bigint, tokens bigint, unknown bigint")
    sums = parts.groupBy("source", "lang", "domain").agg(*(F.sum(c).alias(c) for c in ("documents", "with_text", "tokens", "unknown")))
    names = sources.select(source_key(F.col("source")).alias("source"), "data_dir").dropDuplicates(["source"])
    return sums.join(names, "source", "left").select("source", "data_dir", "lang", "domain", "documents", "with_text", "tokens", "unknown")


def rolled_up(slices_: DataFrame) -> DataFrame:
    """(level, source, data_dir, lang, domain, documents, with_text, tokens): totals over all, by source, data_dir, language, domain, and source and language."""
    dims = ["source", "data_dir", "lang", "domain"]
    sets = {"all": [], "source": ["source", "data_dir"], "data_dir": ["data_dir"], "lang": ["lang"], "domain": ["domain"], "source_lang": ["source", "data_dir", "lang"]}
    out = None
    for level, keys in sets.items():
        sums = slices_.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("documents", "with_text", "tokens")))
        part = sums.select(F.lit(level).alias("level"), *(F.col(d) if d in keys else F.lit(None).cast("string").alias(d) for d in dims), "documents", "with_text", "tokens")
        out = part if out is None else out.unionByName(part)
    return out
