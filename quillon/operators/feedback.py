"""Rocchio relevance feedback, explicit and pseudo."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import query_tokens
from quillon.functions.weights import plain
from quillon.operators.index import Index
from quillon.operators.vsm import query_vector, vector_frame, vsm_search
from quillon.plans.checkpoints import plain_unions

ALPHA, BETA, GAMMA = 1.0, 0.75, 0.15


def centroid(index: Index, ids: list[str]) -> DataFrame:
    """(term, w): mean of the documents' plain vectors; the divisor counts every listed id, unknown and repeated ones too."""
    times = F.create_map(*(F.lit(x) for pair in Counter(ids).items() for x in pair))
    rows = index.of_documents(list(dict.fromkeys(ids)))
    return rows.groupBy("term").agg((F.sum(plain(index.n_docs) * times[F.col("doc_id")]) / F.lit(float(max(1, len(ids))))).alias("w"))


def modified_query(index: Index, vector: dict[str, float], relevant: list[str], non_relevant: list[str], alpha: float, beta: float, gamma: float) -> dict[str, float]:
    """Terms of max(0, alpha q + beta centroid(relevant) - gamma centroid(non-relevant)) with a positive weight; as many as the query and the judged documents have."""
    plain_unions(index.registry.sparkSession)
    parts = vector_frame(index, vector).select("term", (F.col("q") * F.lit(alpha)).alias("w"))
    for ids, factor in ((relevant, beta), (non_relevant, -gamma)):
        if ids:
            parts = parts.unionByName(centroid(index, ids).select("term", (F.col("w") * F.lit(factor)).alias("w")))
    return {r.term: r.q for r in parts.groupBy("term").agg(F.sum("w").alias("q")).where("q > 0").collect()}


def rerank(index: Index, modified: dict[str, float], top_k: int) -> DataFrame:
    """Documents by cosine of their plain vectors with the modified query, whose terms reach the scan; ties by doc_id, last first."""
    norm = norm_of(modified)
    hits = index.of_terms(sorted(modified)) if norm else index.postings.limit(0)
    dots = hits.join(F.broadcast(vector_frame(index, modified)), "term").groupBy("doc_id").agg(F.sum(F.col("q") * plain(index.n_docs)).alias("dot"))
    exact = dots.join(index.norms(), "doc_id").select("doc_id", (F.col("dot") / (F.lit(norm or 1.0) * F.col("norm"))).alias("exact"))
    best = exact.orderBy(F.desc(F.round("exact", 10)), F.desc("doc_id")).limit(top_k)
    rows = best.join(index.registry, "doc_id").orderBy(F.desc(F.round("exact", 10)), F.desc("doc_id"))
    return rows.select(*index.registry.columns, F.round("exact", 6).alias("score"), F.lit(True).alias("feedback_applied"))


def rocchio(
    index: Index, query: str, relevant: list[str], non_relevant: list[str], top_k: int = 10, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA,
    analyzer: Callable[[str], list[str]] = query_tokens,
) -> DataFrame:
    """Explicit feedback: the query moved towards the relevant documents and away from the others."""
    return rerank(index, modified_query(index, query_vector(index, query, analyzer=analyzer), relevant, non_relevant, alpha, beta, gamma), top_k)


def pseudo_feedback(index: Index, query: str, top_k: int = 10, prf_k: int = 3, beta: float = BETA, analyzer: Callable[[str], list[str]] = query_tokens) -> DataFrame:
    """Feedback with the first ``prf_k`` results of the query as relevant; no result gives none."""
    first = [r.doc_id for r in vsm_search(index, query, prf_k, analyzer=analyzer).select("doc_id").collect()]
    if not first:
        return rerank(index, {}, 0)
    return rocchio(index, query, first, [], top_k, 1.0, beta, 0.0, analyzer)


def local_rerank(results: DataFrame, relevant: list[str], non_relevant: list[str]) -> DataFrame:
    """A quick re-ordering of results: +0.15 for relevant, -0.20 for non-relevant ones."""
    step = F.when(F.col("doc_id").isin(relevant), 0.15).when(F.col("doc_id").isin(non_relevant), -0.20).otherwise(0.0)
    return results.withColumn("score", F.col("score") + step).orderBy(F.desc("score"), "doc_id")


def norm_of(vector: dict[str, float]) -> float:
    return math.sqrt(sum(w * w for w in vector.values()))
