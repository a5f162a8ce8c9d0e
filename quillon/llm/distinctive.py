"""Problem 4: how distinctive a term is for a record.

Hypergeometric enrichment: of the ``total`` word occurrences of the collection, ``cf`` are of the term; a
record of ``n`` words is held against n draws without replacement, and the score of a term that it has
``tf`` times is the negative natural logarithm of the exact chance of tf or more, adjusted for false
discoveries (Benjamini and Hochberg) over all pairs of record and term.

The counts come from the heavy-light pass of :mod:`term_counts`: frequent words are counted in local arrays and
scored where the texts are read, with their totals broadcast (at most 2 / SHARE words); only the
pairs of other words are shuffled.  For the adjustment every pair is counted in a histogram of log
probabilities, whose number of bins is fixed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.codepoints import Words, chunks, mix
from quillon.llm.term_counts import SHARE, find_heavy, texts_of
from quillon.plans.checkpoints import checkpointed

#: Bins of the histogram of -ln p: so many for each unit, and so many in all (the last takes the rest).
PER_UNIT, BINS = 50, 100_000


@lru_cache(None)
def _small() -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1024)))])


def log_factorial(m: np.ndarray) -> np.ndarray:
    """ln m! = ln gamma(m + 1): a table for small m, Stirling's series for the rest."""
    m = np.asarray(m, np.float64)
    small = m < 1024
    x = np.where(small, 2.0, m + 1)
    inverse = 1 / x
    series = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + inverse * (1 / 12 - inverse * inverse * (1 / 360 - inverse * inverse / 1260))
    return np.where(small, _small()[np.where(small, m, 0).astype(np.int64)], series)


def log_upper_tail(k, n, cf, total) -> np.ndarray:
    """ln P[X >= k] of the hypergeometric distribution, exactly summed: upwards above the mean, else one minus the lower tail."""
    k, n, cf = (np.asarray(v, np.float64) for v in (k, n, cf))
    total = float(total)

    def log_mass(i):
        return (
            log_factorial(cf) - log_factorial(i) - log_factorial(cf - i) + log_factorial(total - cf) - log_factorial(n - i)
            - log_factorial(total - cf - n + i) - log_factorial(total) + log_factorial(n) + log_factorial(total - n)
        )

    out = np.zeros(len(k))
    upper = k > n * cf / total
    lowest = np.maximum(0.0, n + cf - total)
    certain = k <= lowest
    first = np.where(upper, k, np.maximum(k - 1, lowest))
    with np.errstate(divide="ignore", invalid="ignore"):
        begin = log_mass(first)
        sums = np.ones(len(k))
        term = np.ones(len(k))
        i = first.copy()
        open_ = np.flatnonzero(~certain)
        while len(open_):
            j, up = i[open_], upper[open_]
            ratio = np.where(
                up,
                (cf[open_] - j) * (n[open_] - j) / ((j + 1) * (total - cf[open_] - n[open_] + j + 1)),
                j * (total - cf[open_] - n[open_] + j) / ((cf[open_] - j + 1) * (n[open_] - j + 1)),
            )
            term[open_] *= np.maximum(ratio, 0)
            sums[open_] += term[open_]
            i[open_] += np.where(up, 1, -1)
            open_ = open_[term[open_] > 1e-16 * sums[open_]]
        tail = begin + np.log(sums)
        out = np.where(upper, tail, np.log1p(-np.exp(np.minimum(tail, 0))))
    return np.minimum(np.where(certain, 0.0, out), 0.0)


def _bins(logp: np.ndarray) -> np.ndarray:
    return np.minimum((-logp * PER_UNIT).astype(np.int64), BINS - 1)


def _count(batches, heavy):
    names = ["slot", "term", "tale_id", "tf", "n"]
    cf, df = np.zeros(len(heavy.hashes), np.int64), np.zeros(len(heavy.hashes), np.int64)
    for batch in batches:
        text = texts_of(batch, list(range(1, batch.num_columns)))
        for a, b in chunks(text):
            words = Words(text.slice(a, b - a))
            row, slot, tf, rest = heavy.pairs(words)
            cf += np.bincount(slot, tf, minlength=len(cf)).astype(np.int64)
            df += np.bincount(slot, minlength=len(df))
            if len(rest):
                salted = words.hash[rest] ^ mix(words.row[rest].astype(np.uint64))
                _, first, count = np.unique(salted, return_index=True, return_counts=True)
                which = rest[first]
                ids = batch.column(0).slice(a, b - a).take(pa.array(words.row[which]))
                size = words.counts()[words.row[which]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), -1)), words.strings(which).cast(pa.string()), ids, pa.array(count.astype(np.int64)), pa.array(size.astype(np.int64))], names)
    used = np.flatnonzero(df)
    blank = pa.nulls(len(used), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(used), blank, blank, pa.array(cf[used]), pa.array(df[used])], names)


def _score_heavy(batches, heavy, cf, df, total, min_tf, max_texts, top):
    names = ["bin", "pairs", "tale_id", "term", "tf", "occurrences", "texts", "n", "logp"]
    bins: dict[int, int] = {}
    terms = pa.array(heavy.terms, pa.string())
    by_name = np.argsort(np.argsort(np.array([t.encode() for t in heavy.terms], object))) if heavy.terms else np.zeros(0, np.int64)
    for batch in batches:
        text = texts_of(batch, list(range(1, batch.num_columns)))
        for a, b in chunks(text):
            words = Words(text.slice(a, b - a))
            row, slot, tf, _ = heavy.pairs(words)
            n = words.counts()[row]
            same = np.unique((slot << 40) | (np.minimum(tf, (1 << 20) - 1) << 20) | np.minimum(n, (1 << 20) - 1), return_index=True, return_inverse=True) if n.max(initial=0) < 1 << 20 else (0, np.arange(len(n)), np.arange(len(n)))
            one = same[1]
            logp = log_upper_tail(tf[one], n[one], cf[slot[one]], total)[same[2]]
            which, count = np.unique(_bins(logp), return_counts=True)
            for x, y in zip(which.tolist(), count.tolist()):
                bins[x] = bins.get(x, 0) + y
            keep = np.flatnonzero((tf >= min_tf) & (df[slot] <= max_texts))
            if top is not None and len(keep):
                order = keep[np.lexsort((by_name[slot[keep]], np.round(logp[keep], 6), row[keep]))]
                begin = np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))
                keep = order[np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) < top]
            if len(keep):
                ints = [pa.array(x[keep].astype(np.int64)) for x in (tf, cf[slot], df[slot], n)]
                blank = pa.nulls(len(keep), pa.int64())
                ids = batch.column(0).slice(a, b - a).take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays([blank, blank, ids, terms.take(pa.array(slot[keep])), *ints, pa.array(logp[keep])], names)
    if bins:
        m = len(bins)
        none = [pa.nulls(m, pa.string())] * 2 + [pa.nulls(m, pa.int64())] * 4 + [pa.nulls(m, pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(bins), pa.int64()), pa.array(list(bins.values()), pa.int64()), *none], names)


def _score_light(batches, total):
    for batch in batches:
        k, n, cf = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("tf", "n", "occurrences"))
        logp = log_upper_tail(k, n, cf, total)
        yield pa.RecordBatch.from_arrays([pa.array(_bins(logp)), *batch.columns, pa.array(logp)], ["bin", *batch.schema.names, "logp"])


def distinctive_terms(texts: DataFrame, columns: list[str], key: str = "tale_id", min_tf: int = 1, max_texts: int | None = None, top: int | None = None, share: float = SHARE) -> DataFrame:
    """(key, term, tf, texts, occurrences, n, log_p, score): how much each word marks out each record.

    ``tf`` counts the word in the record's text columns together, ``texts`` and ``occurrences`` over all
    records, ``n`` is the record's number of words.  ``log_p`` is the exact logarithm of the chance, and
    ``score`` is minus that of the adjusted chance (0 for words expected anyway); the adjustment takes ranks to 2% of a probability.  Only
    pairs with at least ``min_tf`` and at most ``max_texts`` are returned, or the ``top`` best of each record
    (ties to six places of log_p by term); the adjustment always covers all pairs.  Each row of ``texts`` is a record (string
    keys); records without words give no rows, and a null key is passed on.
    """
    spark = texts.sparkSession
    max_texts = np.iinfo(np.int64).max if max_texts is None else max_texts
    source = texts.select(F.col(f"`{key}`").alias("tale_id"), *(f"`{c}`" for c in columns))
    heavy = find_heavy(texts, columns, share)
    total = heavy.occurrences
    counted = checkpointed(source.mapInArrow(lambda it: _count(it, heavy), "slot bigint, term string, tale_id string, tf bigint, n bigint"))
    cf, df = np.zeros(len(heavy.hashes), np.int64), np.zeros(len(heavy.hashes), np.int64)
    for r in counted.where("slot >= 0").groupBy("slot").agg(F.sum("tf").alias("cf"), F.sum("n").alias("df")).collect():
        cf[r.slot], df[r.slot] = r.cf, r.df
    light = counted.where("slot < 0").select("tale_id", "term", "tf", "n")
    sums = light.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("texts"))  # joined back, so that a frequent term can be split
    light = light.join(sums, "term").select("tale_id", "term", "tf", "occurrences", "texts", "n")
    layout = "tale_id string, term string, tf bigint, occurrences bigint, texts bigint, n bigint, logp double"
    light = checkpointed(light.mapInArrow(lambda it: _score_light(it, total), f"bin bigint, {layout}"))
    scored = checkpointed(source.mapInArrow(lambda it: _score_heavy(it, heavy, cf, df, total, min_tf, max_texts, top), f"bin bigint, pairs bigint, {layout}"))
    histogram = scored.where("bin IS NOT NULL").select("bin", "pairs").unionAll(light.select("bin", F.lit(1).cast("bigint").alias("pairs"))).groupBy("bin").agg(F.sum("pairs").alias("pairs"))
    rows = sorted((r.bin, r.pairs) for r in histogram.collect())  # at most BINS rows
    pairs = sum(n for _, n in rows)
    table, rank, least = [], pairs, 0.0
    for b, n in rows:  # from the greatest probability on: rank is the number of pairs at most as probable
        shift = float(np.log(pairs) - np.log(rank))
        table.append((b, shift, least))
        least = min(least, shift - b / PER_UNIT)
        rank -= n
    adjust = F.broadcast(spark.createDataFrame(table, "bin bigint, shift double, least double"))
    every = scored.where("bin IS NULL").select(*[c.split()[0] for c in layout.split(", ")]).unionAll(
        light.where((F.col("tf") >= min_tf) & (F.col("texts") <= int(max_texts))).drop("bin")
    )
    if top is not None:
        best = Window.partitionBy("tale_id").orderBy(F.round("logp", 6), "term")
        every = every.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).drop("place")
    bin_ = F.least((-F.col("logp") * PER_UNIT).cast("bigint"), F.lit(BINS - 1))
    joined = every.withColumn("bin", bin_).join(adjust, "bin")
    score = F.greatest(F.lit(0.0), -F.least(F.col("logp") + F.col("shift"), F.col("least")))
    return joined.select(F.col("tale_id").alias(key), "term", "tf", "texts", "occurrences", "n", F.col("logp").alias("log_p"), score.alias("score"))
