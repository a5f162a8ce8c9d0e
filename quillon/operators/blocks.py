"""Products of many sparse rows with many others, in tiles of bounded size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and columns of a tile of scores, terms of it that are multiplied as a dense matrix at once, and single products that are added up at once.
TILE, SLAB, LOT = 2_000, 500, 500_000
#: A term is multiplied densely if it has at least this part of a tile's cells: measured, a dense product took 0.04 ns a cell, an added one 23 ns without its index.
DENSE = 0.001


@dataclass(frozen=True)
class ByTerm:
    """Sparse rows by term: of term t the entries ``begin[t]:begin[t + 1]`` of row and weight."""

    rows: int
    begin: np.ndarray
    row: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: int, terms: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> ByTerm:
        order = np.argsort(term, kind="stable")
        return cls(rows, np.searchsorted(term[order], np.arange(terms + 1)), row[order], weight[order])

    def part(self, at: int, to: int) -> ByTerm:
        """Some of the rows, numbered from 0."""
        own = (self.row >= at) & (self.row < to)
        before = np.append(0, np.cumsum(own))
        return ByTerm(max(0, min(to, self.rows) - at), before[self.begin], self.row[own] - at, self.weight[own])

    def ones(self) -> ByTerm:
        return ByTerm(self.rows, self.begin, self.row, np.ones(len(self.row), np.float32))

    def dense(self, terms: np.ndarray) -> np.ndarray:
        which, at = _entries(self.begin, terms)
        out = np.zeros((self.rows, len(terms)), self.weight.dtype)
        out[self.row[at], which] = self.weight[at]
        return out


def _entries(begin: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry of the terms, the place of its term in ``terms``, and its own place."""
    count = begin[terms + 1] - begin[terms]
    which = np.repeat(np.arange(len(terms)), count)
    return which, np.arange(len(which)) + np.repeat(begin[terms] - (np.cumsum(count) - count), count)


def dots(a: ByTerm, b: ByTerm) -> np.ndarray:
    """The product of each row of ``a`` with each of ``b``; make either of at most ``TILE`` rows.

    Terms of many cells are multiplied as dense matrices, the products of the others are added one by one.
    """
    products = np.diff(a.begin) * np.diff(b.begin)
    dense = products >= max(1, DENSE * a.rows * b.rows)
    out = np.zeros((a.rows, b.rows), a.weight.dtype)
    heavy = np.flatnonzero(dense)
    for at in range(0, len(heavy), SLAB):
        out += a.dense(heavy[at : at + SLAB]) @ b.dense(heavy[at : at + SLAB]).T
    light = np.flatnonzero(~dense & (products > 0))
    lot = np.cumsum(products[light]) // LOT
    ends = np.append(np.flatnonzero(np.diff(lot)) + 1, len(light))
    for at, to in zip(np.append(0, ends[:-1]), ends):
        which, i = _entries(a.begin, light[at:to])
        term = light[at:to][which]
        count = b.begin[term + 1] - b.begin[term]
        each = np.repeat(np.arange(len(i)), count)
        j = np.arange(len(each)) + np.repeat(b.begin[term] - (np.cumsum(count) - count), count)
        np.add.at(out.reshape(-1), a.row[i][each] * b.rows + b.row[j], a.weight[i][each] * b.weight[j])
    return out


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest positive scores of each row; of equal ones the first."""
    if score.shape[1] <= k:
        return np.nonzero(score > 0)
    least = np.partition(score, -k, axis=1)[:, -k, None]
    above, equal = score > np.maximum(least, 0), (score == least) & (score > 0)
    row, column = np.nonzero(equal)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    own = place < k - above.sum(axis=1)[row]
    more = np.nonzero(above)
    return np.concatenate([more[0], row[own]]), np.concatenate([more[1], column[own]])


def first(query: np.ndarray, score: np.ndarray, doc: pa.Array, k: int) -> np.ndarray:
    """The places of the k best of each query: by score, then by document."""
    place = pc.rank(doc, sort_keys="ascending", tiebreaker="dense").to_numpy() if len(doc) else np.zeros(0, np.int64)
    order = np.lexsort((place, -score, query))
    begin = np.flatnonzero(np.append(True, query[order][1:] != query[order][:-1])) if len(order) else np.zeros(0, np.int64)
    return order[np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) < k]


def nearest(x: np.ndarray, places: int) -> np.ndarray:
    """Positive numbers rounded to so many places."""
    return np.floor(x * 10.0**places + 0.5) / 10.0**places
