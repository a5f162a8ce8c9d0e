"""python -m quillon.build --corpus FILE_OR_TABLE --index FOLDER [--report]: builds an index, or reports on one."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import index as ix
from quillon.sources import corpus as src


def ingest(spark: SparkSession, sources: list[str]) -> tuple[src.Accepted | None, list[str]]:
    """Rows of JSON files and Parquet tables, and what went wrong with a source.

    Of each tale_id the row of the last source that has it is kept, of several rows of a source the last
    by updated_at (if it is there) and then by order.  A source that is missing is left out, with an error.
    """
    parts, errors = [], []
    for path in sources:
        try:
            rows = src.read_json(spark, path) if path.endswith(".json") else spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            errors.append(f"corpus not found: {path}")
            continue
        parts.append(rows if "doc_seq" in rows.columns else src.with_sequence(rows))
    if not parts:
        return None, errors
    kept = src.latest(src.in_sequence(parts), "tale_id", "source", "updated_at", "doc_seq")
    return src.accept(kept.drop("source", "updated_at")), errors


def rebuild(spark: SparkSession, sources: list[str], path: str) -> dict:
    """Builds the index of ``sources`` anew and stores it at ``path``, if they have a row; the numbers of rows and up to ten errors."""
    accepted, errors = ingest(spark, sources)
    stats = accepted.stats() if accepted else {"documents_ingested": 0, "skipped": 0, "errors": []}
    terms = 0
    if stats["documents_ingested"]:
        index = ix.build_index(accepted.rows)
        ix.save(index, path)
        terms = index.term_stats.count()
    return {"status": "rebuilt", "sources": sources, "terms_indexed": terms, **stats, "errors": [*errors, *stats["errors"]][:10]}


def report(index: ix.Index, show=print) -> None:
    """Sizes, documents by tradition and by type (all of them, row by row), and the twenty most frequent terms."""
    frames: list[tuple[str, DataFrame]] = [("Sizes", ix.status(index)), ("By tradition", ix.counts_by(index, "tradition").orderBy(F.desc("documents"), "tradition")), ("By type", ix.tale_types(index)), ("Most frequent terms", ix.top_terms(index))]
    for title, df in frames:
        show(title)
        for row in df.toLocalIterator():
            show("  " + ", ".join(f"{k} {v}" for k, v in row.asDict().items()))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--corpus", action="append", default=[], help="JSON file or Parquet table; can be given several times")
    parser.add_argument("--index", required=True)
    parser.add_argument("--report", action="store_true", help="only report on the stored index")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("index").getOrCreate()
    if not args.report:
        stats = rebuild(spark, args.corpus, args.index)
        print(stats)
        if not stats["documents_ingested"]:
            return 1
    index = ix.load(spark, args.index)
    if index is None:
        return 1
    report(index)
    return 0


if __name__ == "__main__":
    sys.exit(main())
