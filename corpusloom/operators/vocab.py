"""One ranked vocabulary of four tiers with dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.tables import cut

SPECIAL = ("<pad>", "<unk>", "<bos>", "<eos>")  # fixed values: ids 0 to 3


def vocab_ids(core: DataFrame, subwords: DataFrame | None = None, profile=t.TELUGU, sep: str = t.SEP, min_freq: int = 2, cap: int = 0) -> DataFrame:
    """(token, id, tier, frequency): special tokens, core tokens (token, n), subwords (token, n) bare and marked, then characters bare and marked.

    Within a tier frequent ones come first, ties by code points; a token of an earlier tier isn't repeated. cap bounds the core tier at cap - 4 tokens,
    as the reference's size option does. Ids are ranks over the types: ranges of the order are numbered apart and follow each other, and only their
    sizes are brought together.
    """
    spark = core.sparkSession
    core = core.where(F.col("n") >= min_freq).select("token", F.col("n").alias("frequency"))
    if cap:
        core = core.orderBy(F.desc("frequency"), "token").limit(cap - len(SPECIAL))
    special = spark.createDataFrame([(s, 0, 0, i, 0) for i, s in enumerate(SPECIAL)], "token string, tier int, frequency bigint, ord bigint, variant int")
    parts = special.unionByName(core.select("token", F.lit(1).alias("tier"), "frequency", F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("variant")))
    if subwords is not None:
        both = subwords.select(F.col("token").alias("bare"), F.col("n").alias("frequency"), F.posexplode(F.array(F.col("token"), F.concat("token", F.lit(sep)))).alias("variant", "token"))
        parts = parts.unionByName(both.select("token", F.lit(2).alias("tier"), "frequency", F.lit(0).cast("bigint").alias("ord"), "variant", "bare"), allowMissingColumns=True)
    chars = spark.createDataFrame([(c + (sep if v else ""), 3, 0, i, v) for i, c in enumerate(t.characters(profile)) for v in (0, 1)], "token string, tier int, frequency bigint, ord bigint, variant int")
    parts = parts.unionByName(chars, allowMissingColumns=True)
    if "bare" not in parts.columns:
        parts = parts.withColumn("bare", F.lit(None).cast("string"))
    parts = parts.withColumn("bare", F.coalesce("bare", "token"))
    first = Window.partitionBy("token").orderBy("tier", F.desc("frequency"), "ord", "bare", "variant")
    kept = parts.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    order = ["tier", F.desc("frequency"), "ord", "bare", "variant"]
    ranged = cut(kept.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    bases = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(bases), "_range").select("token", (F.col("_base") + F.col("_inside")).cast("int").alias("id"), "tier", "frequency")
