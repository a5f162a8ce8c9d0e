"""Queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.canonical import canonical_ids
from quillon.llm.consistent_form import consistent_form
from quillon.llm.distinctive import distinctive_terms
from quillon.llm.leakage import leaks
from quillon.llm.near_duplicates import near_duplicates
from quillon.llm.shared_spans import shared_amounts, shared_spans
from quillon.llm.spam import spam_scores
from quillon.llm.sql import ORACLES
from quillon.llm.tales import one_row_per_tale
from quillon.llm.term_counts import term_counts
from quillon.llm.tokens import token_ids, token_texts
from quillon.plans.shipping import ship
from quillon.sources.tables import table

#: Where the vocabulary files are; a parameter of the operators.
VOCABULARY = os.environ.get("QUILLON_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = near_duplicates(table(spark, d, "tales"), "tale_id", "raw_text", n=3, p=1, q=2)
    return found.pairs().select(F.col("a").alias("tale_id_a"), F.col("b").alias("tale_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "tales"), "tale_id", "raw_text", n=3, p=1, q=2).groups().withColumnRenamed("key", "tale_id")


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 0.8 of their sequences of five words in common; here the inverted lists cost least."""
    return near_duplicates(table(spark, d, "documents"), "doc_id", "text", n=5, p=4, q=5).groups().withColumnRenamed("key", "doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_ids(table(spark, d, "tales"), table(spark, d, "canonical_values"), ["region", "tradition", "source_collection"])


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "tales"), {"raw_text": 150, "translator": 60})


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("field", "tale_id", "start", "stop")


def p3_amounts(spark: SparkSession, d: str) -> DataFrame:
    return shared_amounts(_spans(spark, d)).select("field", "tale_id", "size", "shared")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_amounts(spark, d).select("field", "tale_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    texts = one_row_per_tale(table(spark, d, "tales"), "title", "raw_text")
    return distinctive_terms(texts, ["title", "raw_text"], min_tf=3, max_texts=6).select("tale_id", "term")


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    texts = one_row_per_tale(table(spark, d, "tales"), "title", "raw_text")
    best = distinctive_terms(texts, ["title", "raw_text"], top=5)
    return best.select("tale_id", "term", "tf", "texts", "occurrences", "n", F.round("log_p", 4).alias("log_p"), F.round("score", 3).alias("score"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return consistent_form(table(spark, d, "tales"), "doc_seq", ["title", "raw_text"], changed_only=True).select("doc_seq", "field")


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return consistent_form(table(spark, d, "tales"), "doc_seq", ["title", "raw_text"]).select("doc_seq", "field", "text", "changed")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(one_row_per_tale(table(spark, d, "tales"), "raw_text"), ["raw_text"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_terms(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), VOCABULARY)


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that come back from the ids."""
    return token_texts(token_ids(table(spark, d, "documents"), VOCABULARY), VOCABULARY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_cut(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), cut=True)


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam_scores(table(spark, d, "documents")).select("doc_id", "language", "listed", "distance", "leaning", "spam")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_scores(table(spark, d, "documents")).where("spam").select("doc_id")


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package sent to the executors first."""

    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return query(spark, d)

    return run


QUERIES = (
    p1_found, p1_groups, p1_documents, p2_found, p3_found, p3_spans, p3_amounts, p4_found, p4_top, p5_found, p5_texts, p6_found, p6_terms, p7_ids, p7_texts, p8_found, p8_cut, p9_found, p9_scores,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
