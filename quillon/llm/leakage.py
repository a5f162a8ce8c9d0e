"""Problem 8: evaluation texts leaking into training text.

The word n-grams of the evaluation items, hashed in the consistent form, are sent to every task as a
sorted array behind a bit table; the words of each document are windowed in arrays and looked up
there, so the corpus is read once and nothing is shuffled.  A hit is verified word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.codepoints import Words, chunks, encode
from quillon.llm.shared_spans import _Table, _table
from quillon.plans.checkpoints import checkpointed, plain_unions

#: Bytes of item text sent to the tasks at once (about 3 bytes of hashes for each); more items are taken in blocks, with one pass each.
BLOCK_BYTES = 16_000_000
BITS = 22


@dataclass(frozen=True)
class Grams:
    """Hashes of all windows of one length, sorted, with the item and the word number of each."""

    n: int
    hashes: np.ndarray
    item: np.ndarray
    word: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, n: int, hashes: np.ndarray, item: np.ndarray, word: np.ndarray) -> Grams:
        order = np.lexsort((word, item, hashes))
        table = np.zeros(1 << BITS, bool)
        table[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        return cls(n, hashes[order], item[order], word[order], np.packbits(table))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashes``, place in this table) of all equal pairs."""
        slot = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.flatnonzero(self.table[slot >> 3] & (128 >> (slot & 7)).astype(np.uint8))
        low = np.searchsorted(self.hashes, hashes[at], "left")
        count = np.searchsorted(self.hashes, hashes[at], "right") - low
        end = np.cumsum(count)
        return np.repeat(at, count), np.repeat(low - (end - count), count) + np.arange(int(end[-1]) if len(end) else 0)


def _grams(words: Words, n: int) -> list[Grams]:
    """Windows of n words, and of all words for items with fewer."""
    size = words.counts()
    out = []
    for k in sorted({n, *size[(size > 0) & (size < n)].tolist()}):
        hashes, first = words.grams(k)
        row = words.row[first]
        own = (size[row] >= n) if k == n else (size[row] == k)
        if own.any():
            out.append(Grams.of(k, hashes[own], row[own], first[own]))
    return out


def _same(a: Words, i: np.ndarray, b: Words, j: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from i on in a are the n words from j on in b."""
    k = np.arange(n)
    left = a.strings((i[:, None] + k).ravel())
    right = b.strings((j[:, None] + k).ravel())
    return pc.equal(left, right).to_numpy(zero_copy_only=False).reshape(-1, n).all(1)


def _leaked(words: Words, items: Words, grams: list[Grams]) -> np.ndarray:
    """Which words are in a window that an item has, too."""
    ends = np.zeros(len(words.hash) + 1, np.int64)
    for g in grams:
        hashes, first = words.grams(g.n)
        at, place = g.hits(hashes)
        start = first[at]
        true = start[_same(words, start, items, g.word[place], g.n)] if len(at) else start
        np.add.at(ends, true, 1)
        np.add.at(ends, true + g.n, -1)
    return np.cumsum(ends[:-1]) > 0


def _without(words: Words, inside: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Rows that have some of the words ``inside``, their texts without these, and how many they lose."""
    hit = np.unique(words.row[inside])
    end = np.append(words.source[1:], len(words.cps))
    last = np.append(words.row[1:] != words.row[:-1], True)
    end[last] = words.source[last] + words.size[last]
    drop = np.zeros(len(words.cps) + 1, np.int64)
    np.add.at(drop, words.source[inside], 1)
    np.add.at(drop, end[inside], -1)
    keep = np.cumsum(drop[:-1]) == 0
    off = np.concatenate([[0], np.cumsum(keep)])[words.off]
    removed = np.bincount(words.row[inside], minlength=words.rows)
    return hit, encode(words.cps[keep], off).cast(pa.string()).take(pa.array(hit)), removed[hit]


def _cut(batches, key: str, leaked_in):
    """The documents with leaked words, without them; ``leaked_in`` (batch, first row, words) tells which words those are."""
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            words = Words(batch.column(1).slice(a, b - a))
            inside = leaked_in(batch, a, words)
            if inside.any():
                hit, out, removed = _without(words, inside)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(hit)), out, pa.array(removed)], [key, "text", "removed_words"])


def _find(batches, key: str, ids: list[int], items: Words, grams: list[Grams]):
    """Documents and the items that they hold."""
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            words = Words(batch.column(1).slice(a, b - a))
            rows, found = [], []
            for g in grams:
                hashes, first = words.grams(g.n)
                at, place = g.hits(hashes)
                start = first[at]
                pair = words.row[start] * len(ids) + g.item[place]
                left = np.arange(len(pair))
                while len(left):  # one verified window is enough; others are looked at where the first was a chance hit
                    _, one = np.unique(pair[left], return_index=True)
                    one = left[one]
                    true = _same(words, start[one], items, g.word[place[one]], g.n)
                    rows.append(words.row[start[one[true]]])
                    found.append(g.item[place[one[true]]])
                    left = np.setdiff1d(left, one)
                    left = left[~np.isin(pair[left], pair[one[true]])]
            if rows:
                pair = np.unique(np.concatenate(rows) * len(ids) + np.concatenate(found))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(pair // len(ids))), pa.array([ids[i] for i in (pair % len(ids)).tolist()], pa.int64())], [key, "item_id"])


def _runs(batches, items: Words, grams: list[Grams]):
    """The runs of leaked words of each document, named by the hash of its text."""
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            words = Words(batch.column(1).slice(a, b - a))
            inside = _leaked(words, items, grams)
            if inside.any():
                first = np.cumsum(words.counts()) - words.counts()
                begin = np.flatnonzero(inside & np.append(True, ~inside[:-1] | (words.row[1:] != words.row[:-1])))
                end = np.flatnonzero(inside & np.append(~inside[1:] | (words.row[1:] != words.row[:-1]), True)) + 1
                row = words.row[begin]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(begin - first[row]), pa.array(end - first[row])], ["code", "first", "last"])


def _listed(batch: pa.RecordBatch, a: int, words: Words) -> np.ndarray:
    """The words in the runs that a batch lists for its rows."""
    first = np.cumsum(words.counts()) - words.counts()
    ends = np.zeros(len(words.hash) + 1, np.int64)
    for column, step in ((2, 1), (3, -1)):
        lists = batch.column(column).slice(a, words.rows)
        row = np.repeat(np.arange(words.rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        np.add.at(ends, first[row] + pc.list_flatten(lists).to_numpy(zero_copy_only=False), step)
    return np.cumsum(ends[:-1]) > 0


def leaks(documents: DataFrame, items: DataFrame, n: int = 12, key: str = "doc_id", text: str = "text", cut: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which items leaked into which documents, or the documents without the leaked spans.

    A document holds an item if it has ``n`` consecutive words of it (all, if it has fewer) in the same
    order with no other word between them; case, punctuation and typography do not count.  Result:
    (key, item_id), one row for each pair.  With ``cut`` instead (key, text, removed_words) of the
    documents that hold something, in the consistent form, every leaked window removed.

    Null, empty and blank texts hold nothing, items without a word are in nothing, and items with equal
    texts are each reported; a document that comes twice gives its rows twice.  Items (``item_id``, ``text``) of
    more than ``block_bytes`` are taken in blocks, each in a pass of its own over the documents.  Cutting then
    collects the runs of all blocks, by text, and cuts in one more pass, so that the result is the same.
    """
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    without = f"`{key}` {kind}, text string, removed_words bigint"
    plain_unions(documents.sparkSession)
    out = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()
        ids, words = [r.item_id for r in own], Words(pa.array([r.text for r in own], pa.string()))
        grams = _grams(words, n)
        if not cut:
            part = rows.mapInArrow(lambda it, i=ids, w=words, g=grams: _find(it, key, i, w, g), f"`{key}` {kind}, item_id bigint")
        elif blocks == 1:
            part = rows.mapInArrow(lambda it, w=words, g=grams: _cut(it, key, lambda _, __, own: _leaked(own, w, g)), without)
        else:
            part = rows.select(F.xxhash64("text").alias("code"), "text").mapInArrow(lambda it, w=words, g=grams: _runs(it, w, g), "code bigint, first bigint, last bigint")
        out = part if out is None else out.unionAll(part)
    if cut and blocks > 1:
        runs = checkpointed(out.distinct().groupBy("code").agg(F.collect_list(F.struct("first", "last")).alias("r")).select(F.col("code").alias("anchor"), F.col("r.first").alias("first"), F.col("r.last").alias("last")))
        wanted = _table(runs, runs.count())  # only documents that lose something are shuffled
        coded = rows.where("text IS NOT NULL").select(F.xxhash64("text").alias("anchor"), "key", "text").mapInArrow(lambda it: _those_in(it, wanted), f"anchor bigint, key {kind}, text string")
        out = coded.join(runs, "anchor").select("key", "text", "first", "last").mapInArrow(lambda it: _cut(it, key, _listed), without)
    return out


def _those_in(batches, wanted: _Table):
    for batch in batches:
        yield batch.filter(pa.array(wanted.has(batch.column(0).to_numpy().view(np.uint64))))
