"""Session helpers: reading tables, cutting lineage, sizing."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\r"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's executors, once, so that it need not be installed there.

    The archive is served by the driver; executors keep their copy among Spark's own files.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="docloom-"), "docloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(archive)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``directory``."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The folder is the one named by the session (``spark.checkpoint.dir``), which all executors share. Only a session
    that names none, as in tests, gets a temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="docloom-"))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` held for several uses, in memory as far as it fits. Parts on a lost executor are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def strip_blanks(c: Column | str) -> Column:
    """Column without outer blanks (space, tab, line feed, carriage return)."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def wide_partitions(df: DataFrame, per_core: int = 3) -> int:
    """A partition count for CPU-bound stages: a few tasks for each core, never fewer than the shuffle setting."""
    sc = df.sparkSession.sparkContext
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), per_core * sc.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many partitions as the session has cores, for stages that work long on each row: shuffled by
    ``key`` if its own splits are fewer, else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(wide_partitions(df), key)


def bounded_collect(df: DataFrame, most: int) -> list | None:
    """The rows of ``df`` if they are at most ``most``, else None. Reads no more than ``most`` + 1 rows."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None
