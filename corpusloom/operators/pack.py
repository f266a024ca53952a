"""Documents' ids as one stream, its split, blocks and examples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import cut


def by_ranges(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows dealt by ranges of a key and in its order; what is computed from each row afterwards stays in that order."""
    return rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)


def _running(batches: Iterator[pa.RecordBatch], n: str) -> Iterator[pa.RecordBatch]:
    """The rows of a range with the sum of n over those before."""
    total = 0
    for b in batches:
        x = np.nan_to_num(b.column(n).to_numpy(zero_copy_only=False)).astype(np.int64)
        sums = total + np.cumsum(x)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums - x)], [*b.schema.names, "_inside"])
        total = int(sums[-1]) if len(x) else total


def offsets(rows: DataFrame, key: str = "doc_id", n: str = "n", ranged: bool = False) -> DataFrame:
    """The rows with `start`, the sum of n over the rows before in the order of key (which is unique).

    Rows are dealt by ranges of the key, unless they already are; a range adds up in its order, and only the ranges' sums are brought together. The rows
    travel once and are kept in the checkpoint folder.
    """
    dealt = rows if ranged else by_ranges(rows, key)
    inside = dealt.mapInArrow(lambda it: _running(it, n), T.StructType([*rows.schema.fields, T.StructField("_inside", T.LongType())]))
    kept = cut(inside.withColumn("_range", F.spark_partition_id()))
    sums = kept.groupBy("_range").agg(F.sum(n).alias("_sum"))
    bases = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_base"))  # a row for each range
    return kept.join(F.broadcast(bases), "_range").withColumn("start", F.col("_base") + F.col("_inside")).drop("_range", "_base", "_inside")


def with_eos(rows: DataFrame, eos: int = 3) -> DataFrame:
    """The rows that have ids, each with eos at its end."""
    return rows.where(F.size("ids") > 0).withColumn("ids", F.concat("ids", F.array(F.lit(eos))))


def stream(rows: DataFrame, key: str = "doc_id", ranged: bool = False) -> DataFrame:
    """(key, start, ids) of documents with ids. ranged: the rows come from by_ranges, so making them again for a sample of the key is saved."""
    return offsets(rows.select(key, "ids", F.size("ids").cast("bigint").alias("n")), key, ranged=ranged).select(key, "start", "ids")


def positions(streamed: DataFrame) -> DataFrame:
    """(pos, token_id) of a stream."""
    return streamed.select("start", F.posexplode("ids").alias("i", "token_id")).select((F.col("start") + F.col("i")).alias("pos"), "token_id")


def blocks(streamed: DataFrame, size: int, only: DataFrame | None = None) -> DataFrame:
    """(block_id, ids): the stream cut into blocks; the last one may be short. A document sends each block one slice.

    only: a small table of the block_ids that are wanted; what lies in no such block isn't sent.
    """
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.size("ids") - 1) / size)
    parts = streamed.select("start", "ids", F.explode(F.sequence(first, last)).alias("block_id"))
    if only is not None:
        parts = parts.join(F.broadcast(only), "block_id", "left_semi")
    begin = F.greatest(F.col("block_id") * size - F.col("start"), F.lit(0))
    end = F.least((F.col("block_id") + 1) * size - F.col("start"), F.size("ids"))
    parts = parts.select("block_id", F.struct((F.col("start") + begin).alias("at"), F.slice("ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("ids")).alias("part"))
    return parts.groupBy("block_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))


def examples(streamed: DataFrame, size: int) -> DataFrame:
    """(block_id, x, y): every full window of a block and the same shifted by one; the stream's last block lacks the next id and is left out."""
    b = blocks(streamed, size)
    ahead = b.select((F.col("block_id") - 1).alias("block_id"), F.col("ids")[0].alias("next"))
    return b.where(F.size("ids") == size).join(ahead, "block_id").select("block_id", F.col("ids").alias("x"), F.concat(F.slice("ids", 2, size - 1), F.array("next")).alias("y"))


def tail_split(streamed: DataFrame, share: float) -> DataFrame:
    """(key columns, split, n): ids of each document before and after the cut that leaves int(total * share) ids for validation."""
    s, cut_at = streamed.crossJoin(F.broadcast(_cut_at(streamed, share))), F.col("cut_at")  # one row
    train = F.least(F.greatest(cut_at - F.col("start"), F.lit(0)), F.size("ids").cast("bigint"))
    parts = F.explode(F.array(F.struct(F.lit("train").alias("split"), train.alias("n")), F.struct(F.lit("val").alias("split"), (F.size("ids") - train).alias("n"))))
    return s.select("doc_id", parts.alias("p")).select("doc_id", "p.split", "p.n").where("n > 0")


def _cut_at(streamed: DataFrame, share: float) -> DataFrame:
    """One row (total, cut_at): where the tail for validation begins."""
    total = streamed.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("total"))
    return total.select("total", (F.col("total") - F.floor(F.col("total") * share)).alias("cut_at"))


def _windows(streamed: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """(k, start, ids): size + 1 ids from each start, of a small table (k, start)."""
    need = starts.select("k", "start", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + size) / size))).alias("block_id"))
    got = blocks(streamed, size, need.select("block_id").distinct()).join(F.broadcast(need), "block_id")
    got = got.groupBy("k", "start").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block_id", "ids"))), lambda b: b["ids"])).alias("ids"))
    return got.select("k", "start", F.slice("ids", (F.col("start") % size + 1).cast("int"), size + 1).alias("ids"))


def sampled_windows(streamed: DataFrame, size: int, k: int, seed: int = 0) -> DataFrame:
    """(k, start, x, y): k windows at hashed starts, with replacement. A window takes its ids from the two or three blocks that it touches."""
    total = streamed.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("total"))
    starts = streamed.sparkSession.range(k).withColumnRenamed("id", "k").crossJoin(F.broadcast(total)).where(F.col("total") > size + 1)  # one row
    starts = cut(starts.select("k", F.pmod((F.col("k") + 1) * HASH + seed, F.col("total") - size - 1).alias("start")))
    return _windows(streamed, starts, size).select("k", "start", F.slice("ids", 1, size).alias("x"), F.slice("ids", 2, size).alias("y"))


def sampled_prompts(streamed: DataFrame, share: float, size: int, k: int, seed: int = 0) -> DataFrame:
    """(k, start, ids): k prompts of size ids at hashed starts in the tail that is held out for validation; none if it is shorter than a prompt."""
    at = _cut_at(streamed, share)
    room = F.col("total") - F.col("cut_at") - size
    starts = streamed.sparkSession.range(k).withColumnRenamed("id", "k").crossJoin(F.broadcast(at)).where(room > 0)  # one row
    starts = cut(starts.select("k", (F.col("cut_at") + F.pmod((F.col("k") + 1) * HASH + seed, room)).alias("start")))
    return _windows(streamed, starts, size).select("k", "start", F.slice("ids", 1, size).alias("ids"))


#: Fixed value: Knuth's multiplier for hashing.
HASH = 2654435761


def last_ids(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, ids): at most the last n ids of each row."""
    return rows.select("doc_id", F.slice("ids", F.greatest(F.size("ids") - n + 1, F.lit(1)), n).alias("ids"))


def epochs(configs: DataFrame, total: DataFrame, micro: int = 32, accumulation: int = 4, steps: int = 45_000) -> DataFrame:
    """(config_name, tokens_per_step, steps_per_epoch, epochs) for a one-row table (total) of the stream's ids."""
    per = F.lit(micro * accumulation).cast("bigint") * F.col("block_size")
    rows = configs.crossJoin(F.broadcast(total))
    return rows.select("config_name", per.alias("tokens_per_step"), F.round(F.col("total") / per, 6).alias("steps_per_epoch"), F.round(F.coalesce(F.try_divide(per * steps, F.col("total")), F.lit(0.0)), 6).alias("epochs"))


def parameters(configs: DataFrame, tokenizer: DataFrame) -> DataFrame:
    """(config_name, parameters): the model's size; a vocabulary size of null or 0 is the tokenizer's."""
    v = tokenizer.select(F.col("vocab_size").alias("_v"))
    n, layers = F.col("n_embd").cast("bigint"), F.col("n_layer").cast("bigint")
    hidden = F.floor((F.floor(8 * n / 3) + 255) / 256) * 256
    vocab = F.when(F.coalesce("vocab_size", F.lit(0)) > 0, F.col("vocab_size")).otherwise(F.col("_v")).cast("bigint")
    return configs.crossJoin(F.broadcast(v)).select("config_name", (vocab * n + layers * (4 * n * n + 3 * n * hidden) + (2 * layers + 1) * n).alias("parameters"))


def learning_rates(spark, steps: list[int], peak: float = 3e-4, floor: float = 3e-5, warmup: int = 1000, decay: int = 45_000) -> DataFrame:
    """(step, rate): a linear rise, then half a cosine down to the floor."""
    s = F.col("step").cast("double")
    down = F.lit(floor) + 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (s - warmup) / (decay - warmup))) * (peak - floor)
    return spark.createDataFrame([(x,) for x in steps], "step bigint").select("step", F.round(F.when(s < warmup, s * peak / warmup).when(s > decay, F.lit(floor)).otherwise(down), 10).alias("rate"))
