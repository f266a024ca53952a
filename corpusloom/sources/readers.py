"""Readers of corpora and of the small files that the stages hand to each other."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..plans.tables import ship

TEXT = T.StructType([T.StructField("text", T.StringType())])
FORMATS = {"parquet": "*.parquet", "json": "*.jsonl", "text": "*.txt"}


def has_files(spark: SparkSession, path: str, pattern: str) -> bool:
    """Whether a path, in any file system that Spark knows, has such files at any depth."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.isFile(p):
        return p.getName().endswith(pattern[1:])
    files = fs.listFiles(p, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(pattern[1:]):
            return True
    return False


def read_corpus(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """(text, file) of every document below a path: `text` of Parquet and JSON lines, lines of text files, at any depth.

    Null, empty and (in JSON and text) blank ones are left out, and so are JSON lines that don't parse or lack the field. exclude leaves out files whose
    path holds that string. No file gives an empty table.
    """
    ship(spark)
    out = spark.createDataFrame([], "text string, file string")
    for fmt, pattern in FORMATS.items():
        if has_files(spark, path, pattern):
            read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            df = read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file")) if fmt == "text" else read.schema(TEXT).format(fmt).load(path).select("text", F.col("_metadata.file_path").alias("file"))
            if fmt == "text":
                df = df.withColumn("text", F.trim("text"))
            out = out.unionByName(df.where("text IS NOT NULL AND text <> ''" + ("" if fmt == "parquet" else " AND trim(text) <> ''")))
    return out if exclude is None else out.where(~F.contains("file", F.lit(exclude)))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) of `count word` lines; others are skipped."""
    parts = F.split("value", " ", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(1)).alias("word"), F.expr("try_cast(split(value, ' ', 2)[0] AS BIGINT)").alias("n")).where("word IS NOT NULL AND word <> '' AND n IS NOT NULL")


def read_counts(spark: SparkSession, path: str, name: str = "morpheme") -> DataFrame:
    """(name, frequency) of a tab-separated file with a header; rows of other than two fields are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) == 2)
    return rows.select(parts[0].alias(name), F.expr("try_cast(split(value, '\\t')[1] AS BIGINT)").alias("frequency")).where("frequency IS NOT NULL")


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, left, right) of a merge list `rank left right`; a list without ranks is a single ordered file, numbered by line."""
    lines = [x.strip().split(" ", 1) for x in spark.sparkContext.wholeTextFiles(path).values().first().split("\n")]
    return spark.createDataFrame([(k, *p) for k, p in enumerate(p for p in lines if len(p) == 2)], "rank int, left string, right string")


def _whole(spark: SparkSession, path: str, name: str) -> str:
    """The text of a file, or of the file of that name in a folder, in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = f"{path}/{name}" if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory() else path
    return spark.read.option("wholetext", True).text(at).first()["value"]


def read_tokenizer(spark: SparkSession, path: str) -> DataFrame:
    """A tokenizer file (or tokenizer.json of a folder) as the one-row tokenizer table; a missing version is 1.0."""
    d = json.loads(_whole(spark, path, "tokenizer.json"))
    schema = "version string, type string, vocab_size int, separator string, special_tokens map<string,int>, token_to_id map<string,int>, bpe_merges array<array<string>>"
    return spark.createDataFrame([(d.get("version", "1.0"), d.get("type"), d.get("vocab_size", len(d["token_to_id"])), d.get("separator", t.SEP), d.get("special_tokens", {}), d["token_to_id"], d.get("bpe_merges", []))], schema)


METADATA = "vocab_size int, block_size int, train_tokens bigint, val_tokens bigint, total_tokens bigint, unk_rate double, dtype string"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a prepared stream; an error if there is none."""
    if not has_files(spark, path, "*.json"):
        raise FileNotFoundError(f"no prepared stream at {path}")
    return spark.read.schema(METADATA).json(path).limit(1)  # one row is written


def read_segmented(spark: SparkSession, path: str, raw: str | None = None, split_at: str = " ") -> DataFrame:
    """(text, tokens) of a segmented corpus: tokens as written by write_segmented, or lines of tokens of *.seg.txt files at any depth.

    Without either the raw text files below raw are taken, their lines split at white space; without those an error tells so.
    """
    ship(spark)
    lines = lambda p, pattern: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(p)
    if has_files(spark, path, "*.parquet"):
        rows = spark.read.option("recursiveFileLookup", True).parquet(path)
        return rows.select(F.array_join("tokens", split_at).alias("text"), "tokens")
    if has_files(spark, path, "*.seg.txt"):
        rows = lines(path, "*.seg.txt")
    elif raw is not None and has_files(spark, raw, "*.txt"):
        rows = lines(raw, "*.txt")
    else:
        raise FileNotFoundError(f"no segmented corpus at {path}")
    return rows.select(F.col("value").alias("text"), t.pieces(F.col("value")).alias("tokens")).where(F.size("tokens") > 0)


def load_sources(spark: SparkSession, catalogue: DataFrame, root: str, names: list[str]) -> tuple[DataFrame, list[str]]:
    """((text, file, source) of the named sources, names without files): a source's files lie below its data_dir in root, in any format of read_corpus.

    The catalogue has a row for each source. Names that it lacks, and those without a folder, are handed back.
    """
    dirs = {r["source"]: r["data_dir"] for r in catalogue.where(F.col("source").isin(*names)).select("source", "data_dir").collect()}
    out, missing = None, []
    for name in names:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{dirs.get(name)}")
        if not dirs.get(name) or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            missing.append(name)
            continue
        rows = read_corpus(spark, f"{root}/{dirs[name]}").withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return (spark.createDataFrame([], "text string, file string, source string") if out is None else out), missing


def largest_first(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rank): the files below a path, the largest first, equal ones by name; their contents aren't read. A listing has a row for each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    return files.select("file", "bytes", F.row_number().over(Window.orderBy(F.desc("bytes"), "file")).alias("rank"))


def sample_of_files(spark: SparkSession, path: str, budget: int, profile=t.TELUGU) -> DataFrame:
    """(file, words, before): files, the largest first, until their core words reach the budget; the file that crosses it is taken whole."""
    from ..operators.pack import offsets

    words = F.greatest(F.size(t.core_words(F.col("text"), profile)), F.lit(0)).cast("bigint")
    per = read_corpus(spark, path).groupBy("file").agg(F.sum(words).alias("n"))
    ranked = per.join(largest_first(spark, path), "file").select("rank", "file", "n")
    return offsets(ranked, "rank").where(F.col("start") < budget).select("file", F.col("n").alias("words"), F.col("start").alias("before"))


def read_stream_binary(spark: SparkSession, path: str) -> DataFrame:
    """(first_block, ids): the files of write_stream_binary, each one run of 32-bit ids from the block that its name tells."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("bigint").alias("first_block"), "content")
    return files.mapInArrow(_ids, "first_block bigint, ids array<int>")


def _ids(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in b.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("first_block"), pa.array(ids, pa.list_(pa.int32()))], ["first_block", "ids"])


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of Parquet files, or a single file of a folder, as a stream of the files that arrive."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    read = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return read.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return read.parquet(path)


def unknown_names(catalogue: DataFrame, names: list[str]) -> list[str]:
    """The names that the catalogue lacks, with a warning."""
    known = {r[0] for r in catalogue.where(F.col("source").isin(*names)).select("source").collect()} if names else set()
    if lost := [n for n in names if n not in known]:
        warnings.warn(f"unknown sources: {', '.join(lost)}", stacklevel=2)
    return lost


def subset(docs: DataFrame, names: list[str]) -> DataFrame:
    """The documents of the named sources; unknown names match nothing."""
    return docs.where(F.col("source").isin(*names)) if names else docs.where("false")


def first_per_source(docs: DataFrame, n: int) -> DataFrame:
    """The n documents of each source with the least ids."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    some = docs.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("source", "_p").orderBy("doc_id"))).where(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("_r") <= n).drop("_r", "_p")


def budget_sample(docs: DataFrame, budget: int, profile=t.TELUGU) -> DataFrame:
    """(doc_id, words, before): documents in order of id until the core words reach the budget; the one that crosses it is taken whole."""
    from ..operators.pack import offsets

    words = docs.select("doc_id", F.coalesce(F.size(t.core_words(F.col("text"), profile)), F.lit(0)).cast("bigint").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))
    return offsets(words).where(F.col("start") < budget).select("doc_id", F.col("n").alias("words"), F.col("start").alias("before"))
