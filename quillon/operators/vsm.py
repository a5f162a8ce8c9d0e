"""TF-IDF cosine retrieval with zone weights and weighted expansions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import contains_ignoring_case, query_tokens
from quillon.functions.weights import zoned
from quillon.operators.index import Index

TITLE_WEIGHT, BODY_WEIGHT = 2.0, 1.0


def query_vector(index: Index, query: str, expansions: dict[str, float] | None = None, analyzer: Callable[[str], list[str]] = query_tokens) -> dict[str, float]:
    """Weights of the query's terms that occur, in query order: (1 + ln qtf) idf; of expansions not in it weight x idf."""
    counts = Counter(analyzer(query))
    df = index.document_frequencies([*counts, *(expansions or {})])
    if not counts:
        return {}
    vector = {t: (1 + math.log(n)) * math.log(1 + index.n_docs / df[t]) for t, n in counts.items() if t in df}
    for t, w in (expansions or {}).items():
        if t not in vector and t in df:
            vector[t] = float(w) * math.log(1 + index.n_docs / df[t])
    return vector


def vector_frame(index: Index, vector: dict[str, float]) -> DataFrame:
    """(ord, term, q): one row for each term of one query."""
    return index.registry.sparkSession.createDataFrame([(i, t, float(w)) for i, (t, w) in enumerate(vector.items())], "ord int, term string, q double")


def vsm_search(
    index: Index, query: str, top_k: int = 10, title_weight: float = TITLE_WEIGHT, body_weight: float = BODY_WEIGHT, collection: str | None = None,
    region: str | None = None, expansions: dict[str, float] | None = None, analyzer: Callable[[str], list[str]] = query_tokens,
) -> DataFrame:
    """The ``top_k`` documents by cosine, with ``score``, ``terms_matched`` (in query order) and ``expansions_matched``.

    ``collection`` is a part of source_collection or tradition, ``region`` of the region, in any case.  Ties go by
    the first matching term, then by ingest order.  A query without a known term has no results.
    """
    vector = query_vector(index, query, expansions, analyzer)
    norm = math.sqrt(sum(w * w for w in vector.values()))
    hits = index.of_terms(list(vector)) if norm else index.postings.limit(0)
    registry = index.registry
    if collection:
        registry = registry.where(contains_ignoring_case(F.col("source_collection"), collection) | contains_ignoring_case(F.col("tradition"), collection))
    if region:
        registry = registry.where(contains_ignoring_case(F.col("region"), region))
    weighted = hits.join(F.broadcast(vector_frame(index, vector)), "term")
    dots = weighted.groupBy("doc_id").agg(
        F.sum(F.col("q") * zoned(index.n_docs, title_weight, body_weight)).alias("dot"), F.min("ord").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]).alias("terms_matched"),
    )
    scored = dots.join(index.norms(title_weight, body_weight), "doc_id").withColumn("exact", F.col("dot") / (F.lit(norm or 1.0) * F.col("norm")))
    known = F.array(*(F.lit(t) for t in sorted(expansions))) if expansions else F.array().cast("array<string>")
    rows = scored.join(registry, "doc_id").orderBy(F.desc(F.round("exact", 10)), "first", "doc_seq").limit(top_k)
    return rows.select(
        *(c for c in index.registry.columns), F.round("exact", 6).alias("score"), "terms_matched",
        F.array_sort(F.array_intersect("terms_matched", known)).alias("expansions_matched"),
    )


def ranked(scored: DataFrame, top_k: int | None) -> DataFrame:
    """Ranks within each query by score, then doc_id; Spark's window group limit keeps only the top rows before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rows = scored.withColumn("rank", F.row_number().over(order))
    return rows if top_k is None else rows.where(F.col("rank") <= top_k)
