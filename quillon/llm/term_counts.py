"""Problem 6: frequency of every distinct word, and in how many texts it occurs.

Heavy-light aggregation.  A first pass over all texts finds the heavy words (at least ``SHARE`` of
all occurrences); a word that is heavy in the whole is heavy in one of the batches at least, so each
batch names its own and their counts are added up.  At most 1/SHARE words can be named by a batch and at
most 2/SHARE are kept, which bounds what is broadcast.  In the second pass each task counts heavy
words exactly in local arrays and sends one row for each at its end; only the other words are
shuffled, already counted by batch.  Both tables are united.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.codepoints import Words, chunks
from quillon.plans.checkpoints import checkpointed

SHARE = 1e-4


@dataclass
class Heavy:
    """The heavy words (sorted by hash) and totals over all texts."""

    hashes: np.ndarray
    terms: list[str]
    texts_with_words: int
    texts: int
    occurrences: int

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each heavy word, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        table, shared = self._table
        place = (hashes & np.uint64(len(table) - 1)).astype(np.int64)
        slot = table[place]
        slot = np.where(self.hashes[slot] == hashes, slot, -1)
        again = np.flatnonzero((slot < 0) & shared[place])  # places of several heavy words
        if len(again):
            i = np.minimum(np.searchsorted(self.hashes, hashes[again]), len(self.hashes) - 1)
            slot[again] = np.where(self.hashes[i] == hashes[again], i, -1)
        return slot

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """A heavy word for each value of the hashes' low bits, and whether several have it."""
        size = 1 << max(10, int(16 * len(self.hashes)).bit_length())
        place = (self.hashes & np.uint64(size - 1)).astype(np.int64)
        table = np.zeros(size, np.int64)
        table[place] = np.arange(len(self.hashes))
        return table, np.bincount(place, minlength=size) > 1

    def pairs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, slot and count of each heavy word of each row, and the numbers of the other words."""
        slot = self.slots(words.hash)
        own = slot >= 0
        width = max(1, len(self.hashes))
        pairs, count = np.unique(words.row[own] * width + slot[own], return_counts=True)
        return pairs // width, pairs % width, count, np.flatnonzero(~own)


def texts_of(batch: pa.RecordBatch, columns: list[int]) -> pa.Array:
    """The texts of several columns as one, with a line feed between them."""
    import pyarrow.compute as pc

    parts = [pc.fill_null(batch.column(i).cast(pa.large_string()), "") for i in columns]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar("\n", pa.large_string()))


def find_heavy(texts: DataFrame, columns: list[str], share: float = SHARE) -> Heavy:
    """The heavy words of the text columns; one pass over all texts, one small result to the driver."""
    schema = "term string, n bigint, full bigint, texts bigint"

    def run(batches):
        for batch in batches:
            n, full, seen = 0, 0, []
            text = texts_of(batch, list(range(batch.num_columns)))
            for a, b in chunks(text):
                words = Words(text.slice(a, b - a))
                n += len(words.hash)
                full += int(np.count_nonzero(words.counts()))
                kinds, first, counts = np.unique(words.hash, return_index=True, return_counts=True)
                seen.append((kinds, counts, words.strings(first)))
            if seen:
                kinds = np.concatenate([s[0] for s in seen])
                counts = np.concatenate([s[1] for s in seen])
                terms = pa.concat_arrays([s[2].cast(pa.string()) for s in seen])
                kinds, first, inverse = np.unique(kinds, return_index=True, return_inverse=True)
                counts = np.bincount(inverse, counts, minlength=len(kinds)).astype(np.int64)
                big = np.flatnonzero(counts >= share * n)
                zero = pa.array(np.zeros(len(big), np.int64))
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(first[big])), pa.array(counts[big]), zero, zero], schema_names)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *(pa.array([v], pa.int64()) for v in (n, full, batch.num_rows))], schema_names)

    schema_names = ["term", "n", "full", "texts"]
    sums = checkpointed(
        texts.select(*(f"`{c}`" for c in columns)).mapInArrow(run, schema)
        .groupBy("term").agg(*(F.sum(c).alias(c) for c in schema_names[1:]))
    )
    total = sums.where("term IS NULL").first()
    if total is None or not total.n:
        return Heavy(np.zeros(0, np.uint64), [], 0, total.texts if total else 0, 0)
    terms = [r.term for r in sums.where(F.col("term").isNotNull() & (F.col("n") >= share / 2 * total.n)).select("term").collect()]
    words = Words(pa.array(terms, pa.string()))
    order = np.argsort(words.hash)
    return Heavy(words.hash[order], [terms[i] for i in order], total.full, total.texts, total.n)


def count_rows(texts: DataFrame, columns: list[str], heavy: Heavy) -> DataFrame:
    """(slot, term, occurrences, texts): partial counts; heavy words by slot with a null term, the others by term with slot -1."""

    def run(batches):
        occ, docs = np.zeros(len(heavy.hashes), np.int64), np.zeros(len(heavy.hashes), np.int64)
        names = ["slot", "term", "occurrences", "texts"]
        for batch in batches:
            light = []
            text = texts_of(batch, list(range(batch.num_columns)))
            for a, b in chunks(text):
                words = Words(text.slice(a, b - a))
                if not len(words.hash):
                    continue
                _, slot, tf, rest = heavy.pairs(words)
                occ += np.bincount(slot, tf, minlength=len(occ)).astype(np.int64)
                docs += np.bincount(slot, minlength=len(docs))
                kinds, first, inverse, counts = np.unique(words.hash[rest], return_index=True, return_inverse=True, return_counts=True)
                width = max(1, len(kinds))
                in_texts = np.bincount(np.unique(words.row[rest] * width + inverse) % width, minlength=len(kinds))
                light.append((kinds, counts, in_texts, words.strings(rest[first]).cast(pa.string())))
            if light:
                kinds, first, inverse = np.unique(np.concatenate([x[0] for x in light]), return_index=True, return_inverse=True)
                sums = [np.bincount(inverse, np.concatenate([x[k] for x in light]), minlength=len(kinds)).astype(np.int64) for k in (1, 2)]
                terms = pa.concat_arrays([x[3] for x in light]).take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), -1)), terms, *map(pa.array, sums)], names)
        used = np.flatnonzero(occ)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.nulls(len(used), pa.string()), pa.array(occ[used]), pa.array(docs[used])], names)

    return texts.select(*(f"`{c}`" for c in columns)).mapInArrow(run, "slot bigint, term string, occurrences bigint, texts bigint")


def term_counts(texts: DataFrame, columns: list[str], share: float = SHARE, rare_below: int = 3, common_above: float = 0.4) -> DataFrame:
    """(term, occurrences, texts, mark): exact counts of every word of the text columns, taken together.

    ``mark`` is ``rare`` for a word of fewer than ``rare_below`` texts, ``common`` for one of more than
    ``common_above`` of the texts that have a word, else null.  Null, empty and blank texts have no
    words; each row of ``texts`` is a text, also when repeated; an empty table gives no rows.
    """
    spark = texts.sparkSession
    heavy = find_heavy(texts, columns, share)
    sums = count_rows(texts, columns, heavy).groupBy("slot", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("texts").alias("texts"))
    names = spark.createDataFrame([*enumerate(heavy.terms)], "slot bigint, name string")  # at most 2 / share rows
    whole = sums.join(F.broadcast(names), "slot", "left").select(F.coalesce("term", "name").alias("term"), "occurrences", "texts")
    mark = F.when(F.col("texts") < rare_below, "rare").when(F.col("texts") > F.lit(common_above) * heavy.texts_with_words, "common")
    return whole.withColumn("mark", mark)
