"""Raw tales: reading, checking, defaults, upserts and fingerprints."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.checkpoints import checkpointed, plain_unions

FIELDS = ("tale_id", "tale_type", "title", "region", "tradition", "source_collection", "translator", "collection_era", "raw_text")
SCHEMA = ", ".join(f"{c} STRING" for c in FIELDS)
REQUIRED = ("tale_id", "title", "raw_text")
# What a missing field holds.
DEFAULTS = {"tale_type": "UNKNOWN", "region": "Unknown Region", "tradition": "Unknown", "source_collection": "", "translator": "", "collection_era": ""}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Corpus files that hold an array of tales or a single one; ``doc_seq`` is the order of the files by name, and within a file its own."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return with_sequence(rows, F.col("_metadata.file_path"))


def with_sequence(rows: DataFrame, file: Column | None = None) -> DataFrame:
    """Rows with a ``doc_seq`` from 0, in the order in which they are stored; with ``file``, that of the files first.

    The rows are written once with the numbers that their tasks give them; of each file, or partition, only
    the first number and the count are gathered, so that there is no global sort.
    """
    number = F.monotonically_increasing_id()
    numbered = checkpointed(rows.select("*", (F.shiftright(number, 33).cast("string") if file is None else file).alias("_file"), number.alias("_id")))
    order = F.col("_first") if file is None else F.col("_file")
    sizes = numbered.groupBy("_file").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row for each file or partition
    return numbered.join(starts, "_file").select((F.col("_start") + F.col("_id") - F.col("_first")).alias("doc_seq"), *rows.columns)


def in_sequence(parts: list[DataFrame]) -> DataFrame:
    """Several corpora one behind the other: ``source`` is the place in the list, and ``doc_seq`` goes on from one to the next."""
    out, begin = None, 0
    for k, part in enumerate(parts):
        updated = F.col("updated_at") if "updated_at" in part.columns else F.lit(None)
        rows = part.select(F.lit(k).alias("source"), (F.col("doc_seq") + F.lit(begin)).alias("doc_seq"), updated.cast("timestamp").alias("updated_at"), *FIELDS)
        out = rows if out is None else out.unionByName(rows)
        begin += (part.agg(F.max("doc_seq")).first()[0] or 0) + 1 if k + 1 < len(parts) else 0
    plain_unions(out.sparkSession)
    return out


@dataclass(frozen=True)
class Accepted:
    rows: DataFrame
    rejected: DataFrame

    def stats(self) -> dict:
        """Numbers of ingested and skipped rows, and up to ten reasons."""
        reasons = self.rejected.groupBy("reason").count().orderBy("reason").limit(10).collect()
        skipped = self.rejected.count()
        return {"documents_ingested": self.rows.count(), "skipped": skipped, "errors": [f"{r['reason']} ({r['count']} rows)" for r in reasons]}


def accept(rows: DataFrame) -> Accepted:
    """Rows with all required fields, defaults filled in, and the others with the reason."""
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED))
    checked = rows.withColumn("reason", F.when(missing != "", F.concat(F.lit("missing fields: "), missing)))
    filled = [F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in rows.columns]
    return Accepted(checked.where("reason IS NULL").select(*filled), checked.where("reason IS NOT NULL"))


def latest(rows: DataFrame, key: str = "tale_id", *order: str) -> DataFrame:
    """The last row of each key: by ``order`` (nulls first), by default updated_at and doc_seq as far as they are there.

    A maximum of a struct, combined before the shuffle, so that a key with very many rows costs one row in each task.
    """
    order = order or tuple(c for c in ("updated_at", "doc_seq") if c in rows.columns)
    rest = [c for c in rows.columns if c not in (key, *order)]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("r"))
    return best.select(*(F.col(key) if c == key else F.col(f"r.{c}") for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, key: str = "tale_id") -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key."""
    plain_unions(old.sparkSession)
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def insert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new``; a key that is there already is an error, found by a join."""
    if not new.join(old.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"{key} exists already")
    return old.unionByName(new)


def update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with rows replaced; a key that is not there is an error."""
    if not new.join(old.select(key), key, "left_anti").isEmpty():
        raise KeyError(f"{key} not found")
    return upsert(old, new, key)


def digest(rows: DataFrame) -> Column:
    """A hash of a row, whatever the order of its columns: of each column its name and value, a null told from a text."""
    def shown(c: str, kind: str) -> Column:
        if kind == "timestamp":
            return F.unix_micros(c).cast("string")
        return F.to_json(F.col(c)) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")

    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit(":"), shown(c, kind)), F.lit(""))) for c, kind in sorted(rows.dtypes)]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def fingerprint_of(digests: DataFrame) -> str | None:
    """One hash for a column ``digest`` that depends on neither order nor partitions; None for no rows.

    Row hashes are added up in four sums of 32-bit parts, so that nothing of the size of the corpus is gathered.
    """
    parts = [F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    row = digests.agg(F.count("*").cast("string").alias("n"), *(p.alias(f"s{i}") for i, p in enumerate(parts))).select("n", F.sha2(F.concat_ws("-", "n", "s0", "s1", "s2", "s3"), 256).alias("h")).first()
    return None if row.n == "0" else row.h


def fingerprint(rows: DataFrame) -> str | None:
    """The fingerprint of a table's rows; reads all of them."""
    return fingerprint_of(rows.select(digest(rows).alias("digest")))


def snapshot(rows: DataFrame) -> str | None:
    """A hash of the files that a table is read from (path, size, time of change) and of what is done with them; None if it has no files."""
    files = sorted(rows.inputFiles())
    if not files:
        return None
    spark = rows.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    made = hashlib.sha256(f"{rows._jdf.queryExecution().analyzed().canonicalized().toString()} {rows.schema.json()}\n".encode())
    for name in files:
        where = path(name)
        status = where.getFileSystem(conf).getFileStatus(where)
        made.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return made.hexdigest()
