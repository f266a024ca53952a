"""Writers, the manifest that tells finished stages, and exports."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.encode import checked


def write_text(docs: DataFrame, path: str) -> None:
    """A line of text for each document, its white space collapsed, so that reading gives as many documents as there were."""
    docs.select(F.array_join(t.pieces(F.col("text")), " ").alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def write_json(docs: DataFrame, path: str) -> None:
    """JSON lines."""
    docs.write.mode("overwrite").json(path)


def write_segmented(tokens: DataFrame, path: str, by: str | None = None) -> None:
    """(id, tokens) as Parquet, split by a column if one is named."""
    w = tokens.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_word_list(counts: DataFrame, path: str) -> None:
    """`count word` lines, frequent ones first, ties by code points."""
    counts.orderBy(F.desc("n"), "word").select(F.concat(F.col("n").cast("string"), F.lit(" "), "word").alias("value")).write.mode("overwrite").text(path)


def write_counts(counts: DataFrame, path: str, name: str = "morpheme") -> None:
    """Tab-separated rows with a header, frequent ones first."""
    counts.orderBy(F.desc("frequency"), name).select(name, "frequency").write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_merges(merges: DataFrame, path: str) -> None:
    """`left right` lines in order of rank, one file: the list is bounded by its number of merges."""
    merges.coalesce(1).sortWithinPartitions("rank").select(F.concat_ws(" ", "left", "right").alias("value")).write.mode("overwrite").text(path)


def tokenizer_json(vocab: DataFrame, merges: DataFrame, sep: str = t.SEP) -> str:
    """The tokenizer's bundle as JSON; the sizes of vocabulary and merges are checked."""
    checked(max(vocab.count(), merges.count()))
    ids = {r[0]: r[1] for r in vocab.orderBy("id").select("token", "id").collect()}
    pairs = [[r[0], r[1]] for r in merges.orderBy("rank").select("left", "right").collect()]
    special = {k: v for k, v in ids.items() if v < 4}
    return json.dumps({"version": "2.0", "type": "morph_bpe_mixed", "vocab_size": len(ids), "separator": sep, "special_tokens": special, "token_to_id": ids, "bpe_merges": pairs}, ensure_ascii=False)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One file of UTF-8 text, in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_tokenizer(vocab: DataFrame, merges: DataFrame, path: str, sep: str = t.SEP) -> None:
    """tokenizer.json, vocab.txt (a token a line, in order of the ids) and token_frequencies.tsv (special and core tokens) in a folder.

    vocab: (token, id, tier, frequency), of a checked size.
    """
    spark = vocab.sparkSession
    write_file(spark, f"{path}/tokenizer.json", tokenizer_json(vocab, merges, sep))
    rows = vocab.orderBy("id").collect()
    write_file(spark, f"{path}/vocab.txt", "".join(f"{r['token']}\n" for r in rows))
    write_file(spark, f"{path}/token_frequencies.tsv", "token_id\ttoken\tfrequency\n" + "".join(f"{r['id']}\t{r['token']}\t{r['frequency']}\n" for r in rows if r["tier"] <= 1))


def write_metadata(row: DataFrame, path: str) -> None:
    """The one row of a prepared stream as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def _save(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs

    fs, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    out, ids = None, 0
    for b in batches:
        for k, x in zip(b.column("block_id").to_pylist(), b.column("ids")):
            if out is None:
                name = f"{root}/{k:012d}.bin"
                out = fs.open_output_stream(f"{name}.part")
            values = x.values.to_numpy().astype("<u4")
            ids += len(values)
            out.write(values.tobytes())
    if out:
        out.close()
        fs.move(f"{name}.part", name)  # a task that is run again writes the same file
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids])], ["file", "ids"])


def write_stream_binary(blocks: DataFrame, path: str) -> None:
    """(block_id, ids) as files of little-endian 32-bit ids, one for each task, named by their first block, in a folder or address that all tasks see."""
    p = blocks.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(blocks.sparkSession._jsc.hadoopConfiguration()).mkdirs(p)
    rows = blocks.select("block_id", "ids").repartitionByRange("block_id").sortWithinPartitions("block_id")
    rows.mapInArrow(lambda it: _save(it, path), "file string, ids bigint").write.format("noop").mode("overwrite").save()


def disk_guard(spark: SparkSession, catalogue: DataFrame, path: str, factor: float = 1.5) -> dict[str, object]:
    """free_gb of the file system at a path against wanted_gb, the catalogue's sizes times factor; warns if that is more, and never stops the work."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    free = p.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus(p).getRemaining() / 1e9
    wanted = (catalogue.agg(F.sum("approx_size_gb")).first()[0] or 0.0) * factor
    if free < wanted:
        warnings.warn(f"{free:.1f} GB free at {path}, {wanted:.1f} GB wanted", stacklevel=2)
    return {"free_gb": free, "wanted_gb": wanted, "enough": free >= wanted}


def size_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files below a path; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"))


def fingerprint(parameters: dict) -> str:
    return hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def staged(spark: SparkSession, path: str, parameters: dict, make) -> DataFrame:
    """The stage's table: as it lies there if it was finished with these parameters, else made and written."""
    jvm, mark = spark._jvm, f"{path}/_PARAMETERS_{fingerprint(parameters)}"
    m = jvm.org.apache.hadoop.fs.Path(mark)
    fs = m.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.exists(m) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))):
        make().write.mode("overwrite").parquet(path)
        fs.create(m).close()
    return spark.read.parquet(path)
