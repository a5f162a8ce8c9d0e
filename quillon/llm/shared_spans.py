"""Problem 3: long exact spans shared between records.

Seed and extend.  Of every window of ``least`` characters the winnowed anchor (the k-gram of least hash,
k half as long) is kept, so that two records with a common run of that length have a common anchor in
it.  Anchors are counted by tale in one aggregation (combined before the shuffle, so that a hot anchor
costs one row in each task), and those of two tales or more are put into a bit table of bounded size.
A second scan cuts out the *pieces* around the occurrences that pass the table; all further steps read these.

A maximal repeat is a span of a record that another tale has, too, while no longer span around it is shared.
Each is found from its two ends:

* Left.  Occurrences of an anchor are sorted by the characters before them, backwards; where two of them part is a
  start.  All occurrences that agree up to there have it, so that the start is a class of equal text.
* Right.  From each start the run is hashed up to every further anchor of the piece, in rounds of twice as many
  anchors; a run is alive while two tales have its hash.  A repeat ends at most ``least`` characters behind the last
  anchor: the classes of the last runs are sorted by what follows, and the nearest other tale in that order agrees longest.

Of the spans of a record those within another are left out.  No pairs of records are made.  Anchors and classes with
very many occurrences are not collected: their branches are found by counting the hashes of each length instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.codepoints import BASE, chunks, decode, encode, mix
from quillon.plans.checkpoints import checkpointed

#: Bits of the anchor table: 16 for each shared anchor, at most this power of two (32 MB); with more anchors than that texts and anchors are joined instead.
MOST_BITS = 28
#: Anchors and classes with more occurrences are extended by counting hashes.
HOT = 1000
#: Anchors that a run is followed over in the first round.
FIRST_ROUND = 16
NONE = np.uint64(2**64 - 1)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int, way: str) -> np.ndarray:
    if len(_powers[way]) < n:
        base = BASE if way == "up" else pow(BASE, -1, 2**64)
        _powers[way] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(max(n, 1 << 21), base, np.uint64)))
    return _powers[way][:n]


class Hashes:
    """Hashes of any run of a flat text in constant time."""

    def __init__(self, cps: np.ndarray):
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * _power(len(cps), "up")))
        self.down = _power(len(cps) + 1, "down")

    def runs(self, begin: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[begin + size] - self.sums[begin]) * self.down[begin])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[s : s + w] for every s, over windows of doubling width."""
    low, width = x, 1
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(x) - w + 1
    return np.minimum(low[:n], low[w - width : w - width + n])


def anchors(cps: np.ndarray, off: np.ndarray, least: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes | None]:
    """(place, row, hash) of the winnowed anchors of each row of at least ``least`` characters."""
    size = np.diff(off) - 1
    if not len(size) or size.max() < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    k = least // 2
    w = least - k + 1
    hashes = Hashes(cps)
    h = hashes.runs(np.arange(len(cps) - k + 1), k) ^ np.uint64(salt)
    row = np.repeat(np.arange(len(size)), size + 1)
    end = (off[1:] - 1)[row[: len(h)]]
    h = np.where((np.arange(len(h)) + k <= end) & (size[row[: len(h)]] >= least), h, NONE)
    low = _sliding_least(h, w)
    low = np.where(np.arange(len(low)) + least <= end[: len(low)], low, NONE)
    # A place is chosen if it holds the least of a window that it is in: the greatest of the least values around it is its own.
    most = ~_sliding_least(~np.concatenate([np.zeros(w - 1, np.uint64), np.where(low == NONE, np.uint64(0), low), np.zeros(len(h) - len(low), np.uint64)]), w)
    at = np.flatnonzero((h == most[: len(h)]) & (h != NONE))
    return at, row[at], h[at], hashes


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class _Table:
    """Bits of hashes: two places each."""

    def __init__(self, bits: int, words: dict[int, int] | None = None, index=None, values=None):
        self.bits = bits
        self.words = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
        if index is not None and len(index):
            self.words[index] = values

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for shift in (0, 32):
            p = (h >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
        return out


def _table(hashes: DataFrame, count: int) -> _Table:
    """The bits of a column ``anchor`` of hashes; set by an aggregation, so that its size alone bounds what comes to the driver."""
    bits = min(MOST_BITS, max(10, int(16 * max(1, count) - 1).bit_length()))
    place = [F.shiftrightunsigned("anchor", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, 32)]
    rows = (
        hashes.select(F.explode(F.array(*place)).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
        .toArrow()
    )
    return _Table(bits, index=rows["i"].to_numpy(), values=rows["v"].to_numpy().view(np.uint64))


def _salt(k: int) -> int:
    return int(mix(np.array([k + 1], np.uint64))[0])


def _seed_rows(batches, least: list[int]):
    for batch in batches:
        tale = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in chunks(*batch.columns[1:]):
            for k, size in enumerate(least):
                at, row, h, _ = anchors(*decode(batch.column(1 + k).slice(a, b - a)), size, _salt(k))
                if len(at):
                    own = tale[a + row]
                    _, one = np.unique(mix(own.view(np.uint64)) ^ h, return_index=True)
                    yield pa.RecordBatch.from_arrays([_signed(h[one]), pa.array(own[one])], ["anchor", "tale"])


def _cut(cps: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of a flat text as an Arrow array."""
    end = np.cumsum(size + 1)
    flat = cps[np.minimum(np.repeat(begin - (end - size - 1), size + 1) + np.arange(end[-1]), len(cps) - 1)]
    return encode(flat, np.concatenate([[0], end])).cast(pa.string())


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def _anchor_rows(batches, least: list[int]):
    """The anchors of each text, by the text's code."""
    for batch in batches:
        code = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in chunks(*batch.columns[1:]):
            for k, size in enumerate(least):
                _, row, h, _ = anchors(*decode(batch.column(1 + k).slice(a, b - a)), size, _salt(k))
                if len(h):
                    yield pa.RecordBatch.from_arrays([_signed(h), pa.array(code[a + row])], ["anchor", "code"])


def _known(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    """The shared anchors that a batch lists for its rows a:b, each with its row."""
    values, ends = _flat_list(batch.column(batch.num_columns - 1).slice(a, b - a))
    return mix(np.repeat(np.arange(b - a), np.diff(ends)).astype(np.uint64)) ^ values.view(np.uint64)


def _piece_rows(batches, least: list[int], shared: _Table | None):
    """The pieces of each text around its shared anchors: ``start`` in the text, and the places of the anchors in the piece.

    Which anchors are shared says the table, or, without one, a last column with a list for each row.
    """
    names = ["piece", "record", "tale", "tale_id", "f", "size", "start", "text", "places", "anchors"]
    for batch in batches:
        tale, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for a, b in chunks(*batch.columns[2 : 2 + len(least)]):
            known = None if shared else np.sort(_known(batch, a, b))
            for k, size in enumerate(least):
                cps, off = decode(batch.column(2 + k).slice(a, b - a))
                at, row, h, hashes = anchors(cps, off, size, _salt(k))
                keep = shared.has(h) if shared else np.isin(mix(row.astype(np.uint64)) ^ h, known)
                at, row, h = at[keep], row[keep], h[keep]
                if not len(at):
                    continue
                around = size - size // 2 + 1
                low = np.maximum(off[row], at - around)
                high = np.minimum(off[row + 1] - 1, at + size // 2 + around)
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (low[1:] > high[:-1])))
                end = np.append(first[1:], len(at))
                begin, r = low[first], row[first]
                length = off[r + 1] - off[r] - 1
                own = tale[a + r].view(np.uint64)
                record = mix(hashes.runs(off[r], length) ^ mix(own ^ np.uint64(_salt(k))))
                start = begin - off[r]
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(mix(record + start.astype(np.uint64) + np.uint64(1))), _signed(record), _signed(own), ids.slice(a, b - a).take(pa.array(r)), pa.array(np.full(len(r), k, np.int32)), pa.array(length.astype(np.int32)),
                        pa.array(start.astype(np.int32)), _cut(cps, begin, high[end - 1] - begin), _lists((at - np.repeat(begin, end - first)).astype(np.int32), end, pa.int32()), _lists(h.view(np.int64), end, pa.int64()),
                    ],
                    names,
                )


PIECE = "piece bigint, record bigint, tale bigint, tale_id string, f int, size int, start int, text string, places array<int>, anchors array<bigint>"


def _flat_list(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list array."""
    counts = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(array).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _places(batch, a: int, b: int):
    """Of the rows a:b of a batch of pieces: flat text and offsets, then of each anchor its row, number in the piece, place in the flat text and hash."""
    part = batch.slice(a, b - a)
    cps, off = decode(part.column("text"))
    place, ends = _flat_list(part.column("places"))
    row = np.repeat(np.arange(b - a), np.diff(ends))
    return part, cps, off, row, np.arange(len(row)) - ends[row], off[row] + place, _flat_list(part.column("anchors"))[0].view(np.uint64)


def _left_rows(batches, least: list[int], hot: _Table):
    """What stands before each occurrence of an anchor."""
    for batch in batches:
        for a, b in chunks(batch.column("text")):
            part, cps, off, row, idx, at, h = _places(batch, a, b)
            keep = np.flatnonzero(~hot.has(h))
            if not len(keep):
                continue
            row, idx, at, h = row[keep], idx[keep], at[keep], h[keep]
            f = part.column("f").to_numpy()[row]
            n = np.minimum(at - off[row], np.array([x - x // 2 + 1 for x in least])[f])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([_signed(h), part.column("tale").take(take), part.column("piece").take(take), pa.array(idx.astype(np.int32)), pa.array(f), _cut(cps, at - n, n)], ["anchor", "tale", "piece", "idx", "f", "left"])


def _left_ladder(batches, least: list[int], hot: _Table):
    """Of each occurrence of a hot anchor a row for each number of characters before it: the hash, and the character before those (a number of the tale's own where the text begins)."""
    for batch in batches:
        for a, b in chunks(batch.column("text")):
            part, cps, off, row, idx, at, h = _places(batch, a, b)
            keep = np.flatnonzero(hot.has(h))
            if not len(keep):
                continue
            row, idx, at, h = row[keep], idx[keep], at[keep], h[keep]
            f = part.column("f").to_numpy()[row]
            n = np.minimum(at - off[row], np.array([x - x // 2 for x in least])[f]) + 1
            which = np.repeat(np.arange(len(n)), n)
            l = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            begin = at[which] - l
            node = mix(Hashes(cps).runs(begin, l) ^ h[which] ^ mix(l.astype(np.uint64)))
            inside = begin > off[row[which]]
            tale = part.column("tale").to_numpy()[row[which]]
            before = np.where(inside, cps[np.maximum(begin - 1, 0)], -2 - (tale & 0x3FFFFFFF)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_signed(node), pa.array(before), part.column("piece").take(pa.array(row[which])), pa.array(idx[which].astype(np.int32)), pa.array(l.astype(np.int32))], ["node", "before", "piece", "idx", "l"])


def _matrix(text: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the first ``width`` characters (or the last ones, backwards) plus one, 0 where there is none, and the lengths."""
    cps, off = decode(text)
    size = np.minimum(np.diff(off) - 1, width)
    place = (off[1:, None] - 2 - np.arange(width)) if backwards else (off[:-1, None] + np.arange(width))
    inside = np.arange(width) < size[:, None]
    return np.where(inside, cps[np.clip(place, 0, max(0, len(cps) - 1))] + np.uint32(1), np.uint32(0)).astype(">u4"), size


def _agree(matrix: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many characters the rows i and j of a matrix have in common from the first on."""
    same = matrix[i] == matrix[j]
    return np.minimum(np.where(same.all(1), matrix.shape[1], same.argmin(1)), np.minimum(size[i], size[j]))


def _text_order(key: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{4 * matrix.shape[1]}").ravel(), kind="stable")
    return order[np.argsort(key[order], kind="stable")]


def _starts(table: pa.Table, least: list[int]):
    """(piece, idx, l): the numbers of characters before an occurrence after which others of its anchor part from it."""
    for f, size in enumerate(least):
        own = table.filter(pc.equal(table["f"], f))
        if own.num_rows < 2:
            continue
        most = size - size // 2
        anchor, tale, piece, idx = (own[c].to_numpy() for c in ("anchor", "tale", "piece", "idx"))
        matrix, n = _matrix(own["left"].combine_chunks(), most + 1, True)
        order = _text_order(anchor, matrix)
        lcp = np.where(anchor[order][1:] == anchor[order][:-1], _agree(matrix, n, order[1:], order[:-1]), -1)
        for l in np.unique(lcp[(lcp >= 0) & (lcp <= most)]).tolist():
            begin = np.flatnonzero(np.append(True, lcp < l))
            node = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
            parts = np.zeros(len(begin), bool)
            parts[node[1:][lcp == l]] = True
            parts &= np.minimum.reduceat(tale[order], begin) != np.maximum.reduceat(tale[order], begin)
            hit = order[parts[node]]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(piece[hit]), pa.array(idx[hit]), pa.array(np.full(len(hit), l, np.int32))], ["piece", "idx", "l"])


def _stops(table: pa.Table, least: list[int]):
    """(piece, begin, stop): how far the text from a start on agrees with that of another tale of its class."""
    for f, size in enumerate(least):
        own = table.filter(pc.equal(table["f"], f))
        if own.num_rows < 2:
            continue
        key, tale, piece, begin, end = (own[c].to_numpy() for c in ("key", "tale", "piece", "begin", "end"))
        matrix, n = _matrix(own["right"].combine_chunks(), size - size // 2 + 1, False)
        order = _text_order(key, matrix)
        k, t = key[order], tale[order]
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
        before, after = first[run] - 1, np.append(first[1:], len(k))[run]
        best = np.full(len(k), -1)
        for other in (before, after):
            there = (other >= 0) & (other < len(k))
            there[there] = k[other[there]] == k[there]
            i = np.flatnonzero(there)
            best[i] = np.maximum(best[i], _agree(matrix, n, order[i], order[other[i]]))
        i = np.flatnonzero(best >= 0)
        o = order[i]
        yield pa.RecordBatch.from_arrays([pa.array(piece[o]), pa.array(begin[o]), pa.array((end[o] + best[i]).astype(np.int32))], ["piece", "begin", "stop"])


def _by_group(batches, name: str, work, rows: int = 4000):
    """``work`` on whole groups of batches that are sorted by the column ``name``; a group that a batch cuts is carried on."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            key = table[name].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            at = 0
            while at < cut:
                end = min(at + rows, cut)
                end = cut if end == cut else max(int(np.searchsorted(key, key[end])), int(np.searchsorted(key, key[at], "right")))
                yield from work(table.slice(at, end - at))
                at = end
            held = table.slice(cut).combine_chunks().to_batches()
            n = sum(x.num_rows for x in held)
    if n:
        yield from work(pa.Table.from_batches(held))


def _run_rows(batches, least: list[int], low: int, high: int):
    """The hash of the run from each start up to its anchor and to ``low`` ... ``high`` - 1 anchors further; ``more`` marks the last of these if the piece goes on."""
    gram = np.array([x // 2 for x in least])
    for batch in batches:
        for a, b in chunks(batch.column("text")):
            part, cps, off, _, _, at, _ = _places(batch, a, b)
            f = part.column("f").to_numpy()
            idx, ends = _flat_list(part.column("idxs"))
            l = _flat_list(part.column("ls"))[0]
            row = np.repeat(np.arange(b - a), np.diff(ends))
            first = _flat_list(part.column("places"))[1]  # number of each row's first anchor
            own = first[row] + idx
            n = np.clip(first[row + 1] - own - low, 0, high - low)
            which = np.repeat(np.arange(len(n)), n)
            if not len(which):
                continue
            to = own[which] + low + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            r = row[which]
            begin, end = at[own[which]] - l[which], at[to] + gram[f[r]]
            key = Hashes(cps).runs(begin, end - begin) ^ np.array([_salt(k) for k in range(len(least))], np.uint64)[f[r]]
            more = (to == own[which] + high - 1) & (to + 1 < first[r + 1])
            order = np.lexsort((~more, end, begin))  # a start found from several anchors has the same runs
            one = order[np.append(True, (begin[order][1:] != begin[order][:-1]) | (end[order][1:] != end[order][:-1]))]
            which, begin, end, key, more, r = (x[one] for x in (which, begin, end, key, more, r))
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [_signed(mix(key)), part.column("tale").take(take), part.column("piece").take(take), pa.array(f[r]), pa.array(idx[which].astype(np.int32)), pa.array(l[which].astype(np.int32)), pa.array((begin - off[r]).astype(np.int32)), pa.array((end - off[r]).astype(np.int32)), pa.array(more)],
                ["key", "tale", "piece", "f", "idx", "l", "begin", "end", "more"],
            )


RUN = "key bigint, tale bigint, piece bigint, f int, idx int, l int, begin int, end int, more boolean"


def _right_ladder(batches):
    """Of each member of a hot class a row for each number of characters behind it."""
    for batch in batches:
        for a, b in chunks(batch.column("right")):
            part = batch.slice(a, b - a)
            cps, off = decode(part.column("right"))
            n = np.diff(off)  # one more than the characters
            which = np.repeat(np.arange(b - a), n)
            r = np.arange(len(which)) - off[which]
            node = mix(Hashes(cps).runs(off[which], r) ^ mix(part.column("key").to_numpy().view(np.uint64)[which] ^ mix(r.astype(np.uint64))))
            take = pa.array(which)
            stop = part.column("end").to_numpy()[which] + r
            yield pa.RecordBatch.from_arrays([_signed(node), *(part.column(c).take(take) for c in ("tale", "piece", "begin")), pa.array(stop.astype(np.int32))], ["node", "tale", "piece", "begin", "stop"])


def _of_two_tales(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` two tales have; counted before the shuffle, and joined back with skew handling."""
    shared = rows.groupBy(key).agg(F.min("tale").alias("x"), F.max("tale").alias("y")).where("x <> y").select(key)
    return rows.join(shared, key, "left_semi")


def shared_spans(tales: DataFrame, least: dict[str, int], hot: int = HOT, most_bits: int = MOST_BITS) -> DataFrame:
    """(field, tale_id, record, size, start, stop): the maximal spans of a tale's text that another tale has character for character.

    ``least`` gives the length of the shortest span for each field.  Texts are taken as stored.  ``start``
    and ``stop`` count characters from 0, ``size`` is the text's length, ``record`` a number for the text (rows of a tale
    with different texts are told apart, equal ones are one).  Spans of one text may overlap, but none lies in another.
    Rows of one tale_id are one tale, and spans between them do not count.  Null, empty and shorter texts
    and rows without a tale_id have no spans; an empty table gives no rows.
    """
    fields, sizes = list(least), list(least.values())
    rows = tales.where("tale_id IS NOT NULL")
    texts = rows.select(F.xxhash64("tale_id").alias("tale"), "tale_id", *(f"`{f}`" for f in fields))
    seeds = texts.drop("tale_id").mapInArrow(lambda it: _seed_rows(it, sizes), "anchor bigint, tale bigint")
    counted = seeds.groupBy("anchor").agg(F.min("tale").alias("a"), F.max("tale").alias("b"), F.count("*").alias("n"))
    shared = checkpointed(counted.where("a <> b").select("anchor", "n"))
    count = shared.count()
    many = shared.where(F.col("n") > hot)
    hot_table = _table(many, many.count())
    if 16 * count <= 1 << most_bits:
        table = _table(shared, count)
        cut = texts.mapInArrow(lambda it: _piece_rows(it, sizes, table), PIECE)
    else:  # only texts with a shared anchor are shuffled, with the list of these
        coded = texts.withColumn("code", F.xxhash64("tale_id", *(f"`{f}`" for f in fields)))
        found = coded.select("code", *(f"`{f}`" for f in fields)).mapInArrow(lambda it: _anchor_rows(it, sizes), "anchor bigint, code bigint")
        known = found.join(shared.select("anchor"), "anchor", "left_semi").groupBy("code").agg(F.collect_set("anchor").alias("known"))
        cut = coded.join(known, "code").drop("code").mapInArrow(lambda it: _piece_rows(it, sizes, None), PIECE)
    pieces = checkpointed(cut.dropDuplicates(["piece"]))
    starts = (
        pieces.mapInArrow(lambda it: _left_rows(it, sizes, hot_table), "anchor bigint, tale bigint, piece bigint, idx int, f int, left string")
        .repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda it: _by_group(it, "anchor", lambda t: _starts(t, sizes)), "piece bigint, idx int, l int")
    )
    if hot_table.words.any():
        ladder = checkpointed(pieces.mapInArrow(lambda it: _left_ladder(it, sizes, hot_table), "node bigint, before bigint, piece bigint, idx int, l int"))
        parting = ladder.groupBy("node").agg(F.min("before").alias("x"), F.max("before").alias("y")).where("x <> y").select("node")
        starts = starts.unionAll(ladder.join(parting, "node", "left_semi").select("piece", "idx", "l"))
    runs, low, high = None, 0, FIRST_ROUND
    while True:
        listed = starts.groupBy("piece").agg(F.collect_list(F.struct("idx", "l")).alias("c")).select("piece", F.col("c.idx").alias("idxs"), F.col("c.l").alias("ls"))
        made = pieces.select("piece", "tale", "f", "text", "places", "anchors").join(listed, "piece").mapInArrow(lambda it, a=low, b=high: _run_rows(it, sizes, a, b), RUN)
        alive = checkpointed(_of_two_tales(checkpointed(made), "key"))
        runs = alive if runs is None else runs.unionAll(alive)
        starts = alive.where("more").select("piece", "idx", "l").distinct()
        if starts.isEmpty():
            break
        low, high = high, 3 * high
    span, behind = (F.element_at(F.array(*(F.lit(v) for v in values)), F.col("f") + 1) for values in (sizes, [x - x // 2 + 1 for x in sizes]))
    reach = F.max("end").over(Window.partitionBy("piece", "begin"))  # at most the anchors of a piece
    last = runs.withColumn("reach", reach).where(F.col("end") > F.col("reach") - span).select("key").distinct()
    members = runs.join(last, "key", "left_semi").select("key", "tale", "piece", "f", "begin", "end").distinct()
    members = checkpointed(members.join(pieces.select("piece", "text"), "piece").select("key", "tale", "piece", "f", "begin", "end", F.substring("text", F.col("end") + 1, behind).alias("right")))
    crowded = members.groupBy("key").count().where(F.col("count") > hot).select("key")
    stops = (
        members.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key")
        .mapInArrow(lambda it: _by_group(it, "key", lambda t: _stops(t, sizes)), "piece bigint, begin int, stop int")
    )
    if not crowded.isEmpty():
        ladder = checkpointed(members.join(crowded, "key", "left_semi").select("key", "tale", "piece", "begin", "end", "right").mapInArrow(_right_ladder, "node bigint, tale bigint, piece bigint, begin int, stop int"))
        stops = stops.unionAll(_of_two_tales(ladder, "node").select("piece", "begin", "stop"))
    furthest = stops.groupBy("piece", "begin").agg(F.max("stop").alias("stop"))
    placed = furthest.join(pieces.select("piece", "record", "tale_id", "f", "size", F.col("start").alias("offset")), "piece").where(F.col("stop") - F.col("begin") >= span)
    before = Window.partitionBy("record").orderBy("begin", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("begin", F.col("begin") + F.col("offset")).withColumn("stop", F.col("stop") + F.col("offset"))
    kept = placed.withColumn("so_far", F.max("stop").over(before)).where("so_far IS NULL OR stop > so_far")
    name = F.element_at(F.array(*(F.lit(f) for f in fields)), F.col("f") + 1)
    return kept.select(name.alias("field"), "tale_id", "record", "size", F.col("begin").alias("start"), "stop")


def shared_amounts(spans: DataFrame) -> DataFrame:
    """(field, tale_id, size, shared, spans, longest): of each tale with spans the number of characters in any of them, and the spans and the longest of them.

    Of a tale with several different texts the sizes and the amounts of those with spans are added up.
    """
    texts = spans.groupBy("field", "tale_id", "record").agg(F.max("size").alias("size"), F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"))
    total = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], x["stop"]).alias("end")),
    )["n"]
    longest = F.array_max(F.transform("s", lambda x: x["stop"] - x["start"]))
    each = texts.select("field", "tale_id", F.col("size").cast("bigint").alias("size"), total.cast("bigint").alias("shared"), F.size("s").cast("bigint").alias("spans"), longest.alias("longest"))
    return each.groupBy("field", "tale_id").agg(*(F.sum(c).alias(c) for c in ("size", "shared", "spans")), F.max("longest").alias("longest"))
