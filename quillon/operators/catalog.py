"""Reads of the metadata tables and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of search that a log entry can have.
LOG_SCHEMA = (
    "log_id bigint, query_text string, query_mode string, feedback_applied struct<relevant_ids: array<string>, non_relevant_ids: array<string>>, execution_time_ms double, created_at timestamp"
)
QUERY_MODES = ("boolean", "vsm", "bm25", "nl_query", "feedback", "prf")


def list_tales(tales: DataFrame, tradition: str | None = None, region: str | None = None, tale_type: str | None = None) -> DataFrame:
    """Tales by patterns (any case) of tradition and region and by type, without their texts."""
    rows = tales.drop("raw_text", "processed_tokens")
    for column, pattern in (("tradition", tradition), ("region", region)):
        if pattern:
            rows = rows.where(F.col(column).rlike(f"(?i){pattern}"))
    return rows.where(F.col("tale_type") == tale_type) if tale_type else rows


def page(rows: DataFrame, skip: int = 0, limit: int = 20) -> tuple[DataFrame, int]:
    """One page, the newest first, and the number of all rows."""
    return rows.orderBy(F.desc("created_at"), F.desc("doc_seq")).offset(skip).limit(limit), rows.count()


def by_key(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The row of a key; LookupError if there is none."""
    found = rows.where(F.col(column) == value)
    if found.isEmpty():
        raise LookupError(f"{column} {value!r} not found")
    return found


def list_types(tale_types: DataFrame) -> DataFrame:
    return tale_types.orderBy("atu_code", "tale_type_id")


def variants_of(tales: DataFrame, tale_type: str) -> DataFrame:
    """Tales of exactly this type, by tradition."""
    return tales.where(F.col("tale_type") == tale_type).orderBy("tradition", "doc_seq")


def list_qrels(qrels: DataFrame) -> DataFrame:
    return qrels.orderBy("query_id")


def browse_types(tales: DataFrame, tale_types: DataFrame, text: str = "", tradition: str = "") -> DataFrame:
    """Types with ``text`` in their title, code or description that have a tale with ``tradition`` in its tradition."""
    fields = [F.coalesce(F.lower(c), F.lit("")) for c in ("canonical_title", "atu_code", "description")]
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(f, F.lit(text.lower()))
    rows = tale_types.where(hit)
    if tradition:
        some = tales.where(F.contains(F.lower("tradition"), F.lit(tradition.lower()))).select(F.col("tale_type").alias("tale_type_id")).distinct()
        rows = rows.join(some, "tale_type_id", "left_semi")
    return rows.orderBy("atu_code", "tale_type_id")


def clean_results(results: DataFrame) -> DataFrame:
    """Results with an id and a title; metadata that say "unknown" are blanked."""
    rows = results.where("doc_id IS NOT NULL AND doc_id <> '' AND title IS NOT NULL AND trim(title) <> ''")
    for c in ("region", "tradition", "source_collection", "tale_type"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.when(F.lower(c).startswith("unknown"), "").otherwise(F.col(c)))
    return rows


def largest_type(types: DataFrame) -> DataFrame:
    """The type with most variants (ties by name)."""
    return types.orderBy(F.desc("variants"), "tale_type").limit(1)


def append_log(entries: DataFrame, path: str) -> None:
    """Adds entries to the log's table; those with an unknown kind of search are an error."""
    if not entries.where(~F.col("query_mode").isin(*QUERY_MODES)).isEmpty():
        raise ValueError("unknown query_mode")
    entries.write.mode("append").parquet(path)


def delivered_once(log: DataFrame) -> DataFrame:
    """One row of each log_id: the first received."""
    rest = [c for c in log.columns if c != "log_id"]
    one = log.groupBy("log_id").agg(F.min_by(F.struct(*rest), F.struct("received_at", "created_at")).alias("r"))
    return one.select("log_id", *(F.col(f"r.{c}") for c in rest)).select(*log.columns)


def latest_log(log: DataFrame, limit: int = 50) -> DataFrame:
    """The newest entries of the log."""
    return delivered_once(log).orderBy(F.desc("created_at"), F.desc("log_id")).limit(limit)


def latency_by_mode(log: DataFrame) -> DataFrame:
    """(query_mode, requests, timed, mean_ms, slowest_ms), negative times left out of the times."""
    timed = F.when(F.col("execution_time_ms") >= 0, F.col("execution_time_ms"))
    return delivered_once(log).groupBy("query_mode").agg(F.count("*").alias("requests"), F.count(timed).alias("timed"), F.round(F.avg(timed), 3).alias("mean_ms"), F.max(timed).alias("slowest_ms"))
