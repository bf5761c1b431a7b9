"""Shared storage and table access used by every operator.

Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir`` (shared by the driver and all executors), so a lost
executor never takes the only copy of a result with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the Parquet tables below ``sf_dir`` through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    A private one is set only where none is named and all runs on this machine: on a
    cluster each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("no shared folder: set spark.checkpoint.dir to one that the driver and all executors reach")
    own = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Paths that were given out and not yet removed.
_GIVEN: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    _GIVEN.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was put into the shared folder since its beginning.

    For a job whose results have been written elsewhere or read by then: intermediate
    tables and models stay as long as some result may still be computed from them.
    """
    before = len(_GIVEN)
    try:
        yield
    finally:
        for path in _GIVEN[before:]:
            discard(spark, path)
        del _GIVEN[before:]


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to a new table in the shared folder and reads it back.

    This cuts the lineage at replicated storage, so that later stages neither
    recompute nor depend on an executor that may be lost.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; one that already has a split or a file for each stays as it is.

    Meant for scans that heavy expressions follow: a Parquet file of one row group
    is one task, whatever it costs. The choice rests on the optimiser's estimate, so
    nothing is run for it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < cores * split
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def looked_up(rows: DataFrame, table: DataFrame, key: str, most: int = 10_000, least: int = 500) -> DataFrame:
    """Rows joined with a table of one row a ``key``; rows without a match fall away.

    Keys of more than a ``most``-th of all rows (and more than ``least``), of which there are at most
    ``most``, are joined by broadcast, so a key that a third of the rows share meets in no single
    task; the others by merging, whatever Spark takes the tables' sizes for. ``rows`` are read three times: written ones are best.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") > max(least, rows.count() // most)).select(key)
    often = materialise(F.broadcast(often).join(table, key), "frequent-keys")
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table.hint("merge"), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that :func:`shared_path` named."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
