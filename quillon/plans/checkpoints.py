"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``, else, in local tests, a new one.

    On a cluster without that setting this raises: a folder of one machine would not survive it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = sc._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillon-")
        sc.setCheckpointDir(named)
    return named


def plain_unions(spark: SparkSession) -> None:
    """Keeps the planner from treating a union as partitioned like its parts.

    In Spark 4.1 that can zip parts with unequal numbers of partitions, which fails when a union is aggregated or joined.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


_written: list[str] = []


@contextmanager
def released(spark: SparkSession):
    """Deletes, at the end of the block, the tables that operators wrote to the shared folder in it; write results before.

    For a service that runs many of them in one application.
    """
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        del _written[before:]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and read back from a table written to the shared folder.

    Lost executors cost no recomputation, the plan starts anew from a scan of known size, and the
    files go when the application ends, or with the block of :func:`released`.
    """
    spark = df.sparkSession
    plain_unions(spark)
    path = f"{shared_folder(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
