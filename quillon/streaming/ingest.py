"""Streams: tales as they come, and the query log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.plans.checkpoints import shared_folder
from quillon.sources.corpus import accept, latest

#: How late a log entry may be and still be counted in its hour, and its repeated deliveries be dropped.
LATENESS = "7 days"
#: Micro-batches that are kept apart before they are put together.
COMPACT_EVERY = 20


def ingest_tales(stream: DataFrame, path: str, checkpoint: str, on_batch=None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keeps a table of the latest tales under ``path`` up to date with a stream of raw rows; :func:`tales_at` reads it.

    Each micro-batch is checked, reduced to the last row of each tale_id and written as a folder of its own, so that
    it costs what it brings and not the whole table; every ``compact_every`` batches these are put together
    into a new base and deleted.  ``on_batch(table)`` may then rebuild an index.  A batch that is run again writes
    the same folder again.
    """

    def apply(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        latest(accept(rows).rows).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % compact_every == compact_every - 1:
            tales_at(spark, path).write.mode("overwrite").parquet(f"{path}/base={number}")
            for kind, n in _folders(spark, path):
                if n < number or (kind == "batch" and n == number):
                    _fs(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}"), True)
        if on_batch:
            on_batch(tales_at(spark, path))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(kind, number) of the whole folders of a table."""
    names = [(x.getPath().getName(), x.getPath().toString()) for x in _fs(spark, path).listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))]
    whole = [n.split("=") for n, where in names if "=" in n and _fs(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS"))]
    return [(kind, int(n)) for kind, n in whole]


def tales_at(spark: SparkSession, path: str) -> DataFrame:
    """The latest tales of a table: its last base and the batches after it, of each tale_id the row of the last one."""
    folders = _folders(spark, path)
    base = max((n for kind, n in folders if kind == "base"), default=-1)
    parts = [f"{path}/{kind}={n}" for kind, n in folders if n > base or (kind == "base" and n == base)]
    number = F.regexp_extract(F.col("_metadata.file_path"), "/(?:base|batch)=(\\d+)/[^/]*$", 1).cast("bigint")
    return latest(spark.read.parquet(*parts).select("*", number.alias("_number")), "tale_id", "_number").drop("_number")


def log_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The query log as a stream of files."""
    return spark.readStream.schema(schema).parquet(path)


def log_counts(stream: DataFrame, window: str = "1 hour") -> DataFrame:
    """(start, query_mode, requests) by time of the query; repeated deliveries count once, entries later than ``LATENESS`` not at all."""
    timed = stream.withWatermark("created_at", LATENESS).dropDuplicatesWithinWatermark(["log_id"])
    return timed.groupBy(F.window("created_at", window), "query_mode").agg(F.count("*").alias("requests")).select(F.col("window.start").alias("start"), "query_mode", "requests")


def run_once(counts: DataFrame, value: str = "requests") -> DataFrame:
    """Runs a streaming aggregation over what is there and returns its last values, through tables in the shared folder.

    Groups come when they change, so that the watermark can free those that are over.  A stream without a row gives none.
    """
    spark = counts.sparkSession
    where = f"{shared_folder(spark)}/quillon-stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/state/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if not _fs(spark, where).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/state")):
        return spark.createDataFrame([], counts.schema)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in counts.schema)}, batch bigint").parquet(f"{where}/state")
    keys = [c for c in counts.columns if c != value]
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value)).select(*counts.columns)
