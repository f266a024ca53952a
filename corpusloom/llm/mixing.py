"""A mixture of sources by target shares of tokens (problem 8).

Sizes are tokens of a public byte-level tokenizer, read from its vocabulary file. Tokens are summed by source; a source's rate is its target share of
all tokens over its own, at most its number of repeats; each document is emitted floor(rate) times, and once more if a hash of its id and the seed falls
below the rate's fraction.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import small
from .arrow import slices
from .confusables import Keys
from .labels import source_key

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, Keys(lambda w: len(encoding.encode_ordinary(w))), Keys(lambda w: len(encoding.encode_ordinary(" " + w)))


def text_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text. A cut never crosses a space before a word, so words are counted one by one, from memory, where spaces are single."""
    if not text:
        return 0
    encoding, first, later = _tokenizer(path)
    total = -1
    for line in text.split("\n"):
        words = line.split(" ")
        if "" in words:
            return len(encoding.encode_ordinary(text))
        total += 1 + first[words[0]] + sum(map(later.__getitem__, words[1:]))
    return total


def _sizes(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n = np.array([text_tokens(t, path) for t in b.column("text").to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(n)], ["id", "source", "tokens"])


def document_sizes(docs: DataFrame, path: str = VOCABULARY, id: str = "doc_id") -> DataFrame:
    """(id, source, tokens) of every document, the source without differences of spelling; null or empty texts have no tokens."""
    rows = docs.select(F.col(id).alias("id"), source_key(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(lambda it: _sizes(it, path), "id bigint, source string, tokens bigint")


def rates(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, source, target_share, max_repeats, tokens, all_tokens, rate) of each source with a target, sources without documents included.

    all_tokens counts every document, also those outside the mix. A null number of repeats sets no limit. A source without tokens has rate 0.
    """
    sums = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))  # pre-aggregated in each task
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    wanted = sources.where("target_share is not null").select(source_key(F.col("source")).alias("key"), "source", "target_share", "max_repeats")
    both = wanted.join(sums.select(F.col("source").alias("key"), "tokens"), "key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).crossJoin(F.broadcast(total))  # one row
    full = F.col("target_share") * F.col("all_tokens") / F.col("tokens")
    return both.withColumn("rate", F.when(F.col("tokens") > 0, F.least(full, F.coalesce(F.col("max_repeats").cast("double"), full))).otherwise(0.0))


def copied(sizes: DataFrame, rated: DataFrame, seed: int = 42) -> DataFrame:
    """(id, source, tokens, copies) of the documents of the mix: floor(rate) copies and one more by a hash of seed and id. The same for any partitioning."""
    by = small(rated.select(F.col("key").alias("source"), "rate"))  # a row for each source
    chance = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / float(1 << 40)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return sizes.join(by, "source").withColumn("copies", copies).where("copies > 0").select("id", "source", "tokens", "copies")


def mixed(sizes: DataFrame, rated: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, copy, tokens): each document of the mix once for each copy, numbered from 0."""
    return copied(sizes, rated, seed).select(F.col("id").alias("doc_id"), "source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "tokens")


def used(sizes: DataFrame, rated: DataFrame, seed: int = 42) -> DataFrame:
    """rated with used_tokens, what the mix's copies of each source hold; summed in the tasks before the shuffle."""
    sums = copied(sizes, rated, seed).groupBy(F.col("source").alias("key")).agg(F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"))
    return rated.join(sums, "key", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))


def short_sources(sizes: DataFrame, rated: DataFrame, seed: int = 42) -> DataFrame:
    """(source) of the sources that the mix can't give their share: repeated as often as allowed, their copies still hold fewer tokens.

    Only a source whose rate has reached its number of repeats can be short; another one that misses its share a little does so by chance of the last
    copies. A source without tokens has no rate to raise. Without any tokens at all no share is missed.
    """
    at_most = (F.col("rate") >= F.col("max_repeats")) | (F.col("tokens") == 0) & F.col("max_repeats").isNotNull()
    return used(sizes, rated, seed).where(at_most & (F.col("used_tokens") < F.col("target_share") * F.col("all_tokens"))).select("source")


def shares(sizes: DataFrame, rated: DataFrame, seed: int = 42) -> DataFrame:
    """(source, target_share, max_repeats, tokens, rate, used_tokens, actual_share): what the mix really gives each source."""
    whole = F.sum("used_tokens").over(Window.partitionBy())  # a row for each source
    return used(sizes, rated, seed).select("source", "target_share", "max_repeats", "tokens", F.round("rate", 6).alias("rate"), "used_tokens", F.round(F.coalesce(F.try_divide(F.col("used_tokens"), whole), F.lit(0.0)), 6).alias("actual_share"))
