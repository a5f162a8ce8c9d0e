"""Spelling correction of query terms against the index's vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.index import Index


def corrections(missing: DataFrame, vocabulary: DataFrame, max_distance: int = 2) -> DataFrame:
    """(term, correction, distance) for the terms of ``missing`` that are not in ``vocabulary`` (both: term).

    The nearest word within ``max_distance`` edits; of several at distance 1 the first in the alphabet, of
    several at distance 2 none.  Terms of fewer than three letters and numbers are left alone.  Candidates
    come from equality joins: with at most k edits, one of k + 1 segments of the vocabulary word stands
    in the term, shifted by k places at most.
    """
    words = missing.select("term").distinct().where((F.length("term") >= 3) & ~F.col("term").rlike("^[0-9]+$"))
    words = words.join(vocabulary.select("term"), "term", "left_anti").select("term")
    k, size = max_distance, F.length("word")
    cut = [(F.lit(1) + F.floor(size * i / (k + 1)).cast("int"), F.lit(1) + F.floor(size * (i + 1) / (k + 1)).cast("int")) for i in range(k + 1)]
    pieces = F.array(*(F.struct(F.lit(i).alias("i"), a.alias("start"), F.expr("word").substr(a, b - a).alias("piece")) for i, (a, b) in enumerate(cut)))
    index = vocabulary.select(F.col("term").alias("word"), size.alias("n")).where(F.length("word") >= 1).select("word", "n", F.explode(pieces).alias("p")).select("word", "n", "p.i", "p.start", "p.piece")
    n, wanted = F.col("n"), F.length("term")
    lengths = words.select("term", F.explode(F.sequence(F.greatest(F.lit(1), wanted - k), wanted + k)).alias("n"))
    own = [(F.lit(1) + F.floor(n * i / (k + 1)).cast("int"), F.lit(1) + F.floor(n * (i + 1) / (k + 1)).cast("int")) for i in range(k + 1)]
    starts = F.array(*(F.struct(F.lit(i).alias("i"), a.alias("start"), (b - a).alias("width")) for i, (a, b) in enumerate(own)))
    probes = lengths.select("term", "n", F.explode(starts).alias("p")).select("term", "n", "p.*")
    shifts = F.explode(F.sequence(F.greatest(F.lit(-k), 1 - F.col("start")), F.lit(k))).alias("shift")
    probes = probes.select("term", "n", "i", "start", "width", shifts)
    probes = probes.select("term", "n", "i", "start", F.col("term").substr(F.col("start") + F.col("shift"), F.col("width")).alias("piece")).distinct()
    near = probes.join(index, ["n", "i", "start", "piece"]).select("term", "word").distinct().withColumn("distance", F.levenshtein("term", "word", k)).where("distance >= 0")
    best = near.withColumn("r", F.rank().over(Window.partitionBy("term").orderBy("distance"))).where("r = 1")
    one = best.groupBy("term").agg(F.min("word").alias("correction"), F.first("distance").alias("distance"), F.count("*").alias("n"))
    return one.where((F.col("distance") < 2) | (F.col("n") == 1)).select("term", "correction", "distance")


def correct_terms(index: Index, terms: list[str], max_distance: int = 2) -> dict[str, str]:
    """Corrections of a query's terms, changed ones only, in their order."""
    if not terms:
        return {}
    missing = index.registry.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    found = {r.term: r.correction for r in corrections(missing, index.term_stats, max_distance).collect()}
    return {t: found[t] for t in dict.fromkeys(terms) if t in found}


def correct_queries(queries: DataFrame, vocabulary: DataFrame, terms: Column, max_distance: int = 2) -> DataFrame:
    """``queries`` with ``corrected``: the terms (an array column) of each query with their corrections, joined by spaces; null if nothing is corrected."""
    rows = queries.withColumn("_id", F.monotonically_increasing_id()).withColumn("_terms", terms)
    fixed = corrections(rows.select(F.explode("_terms").alias("term")), vocabulary, max_distance).select("term", "correction")
    placed = rows.select("_id", F.posexplode("_terms").alias("place", "term")).join(fixed, "term", "left")
    whole = placed.groupBy("_id").agg(
        F.count("correction").alias("changes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("correction", "term").alias("t")))), lambda x: x["t"]), " ").alias("text")
    )
    return rows.join(whole, "_id", "left").select(*queries.columns, F.when(F.col("changes") > 0, F.col("text")).alias("corrected"))
