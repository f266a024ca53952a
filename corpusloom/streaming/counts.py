"""Counts over arriving files, equal to the counts of a batch over all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.tables import shared_folder
from ..sources.readers import read_stream


def stream_core_word_counts(spark: SparkSession, path: str, profile=t.TELUGU, state: str | None = None) -> DataFrame:
    """(word, n) after all files that are there now have been taken in; running counts are the query's state.

    state is the folder of the query's progress and counts; without one a new folder below the shared one is used.
    """
    base = state or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).select("text").schema
    words = read_stream(spark, path, schema).where("text IS NOT NULL AND text <> ''").select(F.explode(t.core_words(F.col("text"), profile)).alias("word"))
    out = f"{base}/counts"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = words.groupBy("word").agg(F.count("*").alias("n")).writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("word string, n bigint").parquet(out)
