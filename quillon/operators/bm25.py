"""BM25 with a title boost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import contains_ignoring_case, query_tokens
from quillon.functions.weights import bm25_idf
from quillon.operators.index import Index

K1, B, TITLE_BOOST = 1.5, 0.75, 1.5


def contribution(index: Index, k1: float, b: float, title_boost: float) -> Column:
    """Of one posting with its document's ``token_count``; 0 where the denominator is not positive."""
    tf = F.col("tf_body") + F.lit(float(title_boost)) * F.col("tf_title")
    below = tf + F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * F.col("token_count") / F.lit(index.avgdl))
    return F.when(below > 0, bm25_idf(index.n_docs, F.col("df")) * tf * F.lit(k1 + 1.0) / below).otherwise(F.lit(0.0))


def bm25_search(
    index: Index, query: str, top_k: int = 10, k1: float = K1, b: float = B, title_boost: float = TITLE_BOOST, collection: str | None = None, region: str | None = None,
    analyzer: Callable[[str], list[str]] = query_tokens,
) -> DataFrame:
    """The ``top_k`` documents by BM25 over the distinct query terms, with ``score`` and ``terms_matched``.

    ``collection`` is a part of source_collection, ``region`` of the region.  Ties go by the first
    matching term, then by ingest order.
    """
    terms = list(dict.fromkeys(analyzer(query)))
    registry = index.registry
    if collection:
        registry = registry.where(contains_ignoring_case(F.col("source_collection"), collection))
    if region:
        registry = registry.where(contains_ignoring_case(F.col("region"), region))
    position = F.array_position(F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>"), F.col("term"))
    hits = index.of_terms(terms).join(registry.select("doc_id", "token_count"), "doc_id")
    scores = hits.groupBy("doc_id").agg(F.sum(contribution(index, k1, b, title_boost)).alias("exact"), F.min(position).alias("first"), F.array_sort(F.collect_set("term")).alias("terms_matched"))
    rows = scores.join(registry, "doc_id").orderBy(F.desc(F.round("exact", 10)), "first", "doc_seq").limit(top_k)
    return rows.select(*registry.columns, F.round("exact", 6).alias("score"), "terms_matched")
