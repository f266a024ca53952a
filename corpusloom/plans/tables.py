"""Access to the input tables and to the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, root.name), "zip", root.parent, root.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name below the folder, one Parquet file or folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or the context's checkpoint folder.

    A session on one machine without either gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        return own.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/corpusloom-checkpoints"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows with their lineage cut, written to the reliable checkpoint folder below shared_folder.

    Spark removes what no table needs any more if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The table, marked to be sent to all tasks if its rows, counted now, are at most so many; a larger one is left to the optimizer."""
    return F.broadcast(df) if df.count() <= most else df


#: Rows of one key after which the key is joined apart from the others.
HOT = 10_000


def join_counted(rows: DataFrame, other: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """rows joined to a table with a row for each key and the number of rows that have it; both are read several times, so they should be cut before.

    Keys of more than HOT rows are few (a HOT-th of the rows at most), so they go to all tasks after their number was checked, and no task gets all rows of a
    hot key.
    """
    hot = small(other.where(F.col(count) > HOT).drop(count))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(other.where(F.col(count) <= HOT).drop(count), keys, how)
    return cold.unionByName(rows.join(hot, keys))
