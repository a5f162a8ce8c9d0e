"""Problem 1: near-duplicate records with small edits.

An exact set-similarity join on word n-grams, by size-aware heavy-light joining.  Two sets are linked if
the share of common grams in all their grams (Jaccard) is at least a threshold p/q; two sets of sizes a
and b then have at least need(a, b) = p (a + b) / (p + q) common grams.

Order.  Grams are ordered rarest first, by counts in a table of fixed size that is filled from all
records (any common order keeps the join exact; this one keeps stock phrases out of the prefixes).
If two sets have ``need`` common grams, then their prefixes of size - need + c have c in common.

Small sets enumerate subsets of two grams.  Grams fall into G groups by hash; of c = G + s common grams
in the prefixes at least s pairs lie within groups, so that only pairs of one group are enumerated:
about as many subsets as the set has grams.  G is a power of two that depends on the smaller
set's size class, so that groups of one class are unions of those of the next and a set
enumerates for its own and the next lower class at once.  Of its subsets a set leaves out the ``DROPPED``
most frequent ones (by the counts of their rarer gram): of s common subsets those can only be the
most frequent, and s - DROPPED stay in common.  So stock phrases make no long lists, and a pair that
meets less often than that is no candidate.  A key that very many sets may have is split into cells, in
which every two parts of these sets meet.

Large sets scan inverted lists: they and the sets that can match them post single grams of their
prefixes (c = 1), and in each list pairs with a large set are kept if sizes and places still allow
``need`` common grams.

The boundary between small and large is the one of least cost, estimated from all sets' sizes and the counts.
Sets are named by a 64-bit hash of their grams, which makes equal sets one; keys and names are packed in
arrays, a few bytes each, for the one shuffle.  Candidates are verified on whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.codepoints import Words, chunks, mix
from quillon.llm.shared_spans import _Table, _table
from quillon.plans.checkpoints import checkpointed

#: Counters of the gram table: one for so many bytes of the records, between these bounds (5 bytes each at the driver and in every task).
BYTES_PER_SLOT, FEWEST_SLOTS, MOST_SLOTS = 8192, 1 << 20, 1 << 24
#: Keys in a bucket, about; and rows of texts whose keys a task packs together.
BUCKET_KEYS, PACK_ROWS = 2_000_000, 12_000
#: Sets that a key may have, by the counts, before it is split into cells, and cells on a side at most (the counts have steps of a fifth).
HOT_SETS, MOST_PARTS = 20_000, 1_000
#: Subsets that two sets have in common at least (in the classes of large enough sets), and those that each set leaves out.
COMMON, DROPPED = 6, 4
#: Bits of a gram's hash, and of what is left of it in the order of a set.
GRAM_BITS, TOKEN_BITS = 44, 36
SINGLE, LISTED = np.uint64(0x5BD1E995A1B2C3D4), np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Threshold:
    p: int
    q: int

    def need(self, a, b):
        """Common grams that sets of sizes a and b must have at least."""
        return -(-self.p * (a + b) // (self.p + self.q))

    def smallest(self, n):
        """Size of the smallest partner of a set of n grams."""
        return -(-self.p * n // self.q)


def _class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def _common_subsets(t: Threshold, j: np.ndarray) -> np.ndarray:
    """Subsets that two sets have in common at least if the smaller is in class j (2^j to 2^(j+1) - 1 grams)."""
    return np.where(t.need(2**j, 2**j) > 2 * COMMON, COMMON, 1)


def _groups(t: Threshold, j: np.ndarray) -> np.ndarray:
    """Groups for pairs whose smaller set is in class j: a power of two that leaves room for the common subsets, 0 if there is none."""
    room = t.need(2**j, 2**j) - _common_subsets(t, j)
    power = np.where(room >= 1, 2 ** _class(np.maximum(room, 1)), 0)
    return np.minimum(power, 2 ** np.maximum(j - 1, 0))


def _prefixes(t: Threshold, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For sets of n grams, (groups, prefix, common subsets) of each size class that a smaller or equal partner can be in; prefix 0: none is."""
    own = _class(n)
    low = t.smallest(n)
    out = []
    for back in range(int((own - _class(low)).max()) + 1 if len(n) else 0):
        j = np.maximum(own - back, 0)
        least = np.maximum(2**j, low)
        there = (own >= back) & (least < 2 ** (j + 1)) & (least <= n)
        g, s = _groups(t, j), _common_subsets(t, j)
        prefix = np.minimum(n, n - t.need(n, least) + g + s)
        out.append((g, np.where(there, prefix, 0), s))
    return out


def _subsets(t: Threshold, n: np.ndarray) -> np.ndarray:
    """About how many keys small sets of n grams enumerate."""
    total = np.zeros(len(n))
    for g, prefix, _ in _prefixes(t, n):
        total = np.maximum(total, np.where(g > 0, prefix**2 / (2.0 * np.maximum(g, 1)), prefix))
    return total


def boundary(t: Threshold, sizes: np.ndarray, sets: np.ndarray, counts: np.ndarray) -> int:
    """The greatest size of a small set, by least cost: keys of small sets, postings and list pairs of large ones."""
    n = sizes.astype(np.int64)
    ordered = np.sort(counts[counts > 0].astype(np.float64))
    rare = ordered[np.cumsum(ordered) <= ordered.sum() / 2] if len(ordered) else ordered
    meet = (rare**2).sum() / max(1.0, rare.sum()) ** 2  # chance that two postings are in one list
    keys, posts = _subsets(t, n) * sets, (n - t.need(n, t.smallest(n)) + 1.0) * sets
    best, cost = 0, np.inf
    for x in [*(2 ** np.arange(0, 41))]:
        large, listed = n > x, n >= t.smallest(x + 1)
        own = keys[~large].sum() + (posts[listed].sum() + posts[large].sum() * posts[listed].sum() * meet if large.any() else 0)
        if own < cost:
            best, cost = int(x), own
    return best if len(n) and n.max() > best else 1 << 40  # without a large set no list is posted


def slots(size: int) -> int:
    """Counters for records of so many bytes: a power of two."""
    return int(min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << int(size // BYTES_PER_SLOT).bit_length())))


class _Sets:
    """The distinct grams of each row of a chunk, sorted by row and hash."""

    def __init__(self, text: pa.Array, n: int):
        words = Words(text)
        if words.rows > 1 << (64 - GRAM_BITS):
            raise ValueError("too many rows in a chunk")
        grams, first = words.grams(n)
        both = np.sort(words.row[first].astype(np.uint64) << np.uint64(GRAM_BITS) | grams >> np.uint64(64 - GRAM_BITS))
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        self.grams = both & np.uint64((1 << GRAM_BITS) - 1)
        self.row = (both >> np.uint64(GRAM_BITS)).astype(np.int64)
        self.size = np.bincount(self.row, minlength=words.rows)
        self.rows = np.flatnonzero(self.size)
        begin = (np.cumsum(self.size) - self.size)[self.rows]
        self.name = np.zeros(words.rows, np.uint64)
        if len(begin):
            self.name[self.rows] = mix(np.add.reduceat(mix(self.grams), begin) ^ self.size[self.rows].astype(np.uint64))

    def packed(self, rows: np.ndarray) -> list[bytes]:
        """The grams of some rows, 6 bytes each."""
        begin = np.cumsum(self.size) - self.size
        data = self.grams.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        return [data[6 * begin[r] : 6 * (begin[r] + self.size[r])] for r in rows.tolist()]


def _profile(batches, n: int, slots: int):
    """Pass 1: the set of each record, gram counts by slot, and the numbers of sets by size."""
    counts = np.zeros(slots, np.uint32)
    sizes: dict[int, int] = {}
    names = ["name", "key", "part", "data", "size", "sets"]
    kind = pa.string()
    for batch in batches:
        kind = batch.column(0).type
        for a, b in chunks(batch.column(1)):
            s = _Sets(batch.column(1).slice(a, b - a), n)
            which, times = np.unique(s.grams & np.uint64(slots - 1), return_counts=True)
            counts[which.astype(np.int64)] += times.astype(np.uint32)
            for x, y in zip(*(v.tolist() for v in np.unique(s.size[s.rows], return_counts=True))):
                sizes[x] = sizes.get(x, 0) + y
            k = len(s.rows)
            keys = batch.column(0).slice(a, b - a).take(pa.array(s.rows))
            blank = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(s.name[s.rows].view(np.int64)), keys, *blank, pa.array(s.size[s.rows].astype(np.int64)), pa.nulls(k, pa.int64())], names)
    if sizes:
        parts = 16
        cut = counts.reshape(parts, -1)
        wide = np.uint8 if counts.max() < 256 else np.uint32
        data = [cut[i].astype(wide).tobytes() for i in range(parts)]
        none = pa.nulls(parts, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(parts, kind), pa.array(range(parts), pa.int32()), pa.array(data, pa.binary()), none, none], names)
        k = len(sizes)
        none = [pa.nulls(k, pa.int64()), pa.nulls(k, kind), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], names)


def _counts(data: bytes, slots: int) -> np.ndarray:
    width = len(data) * 16 // slots
    return np.frombuffer(data, {1: np.uint8, 4: np.uint32}[width]).astype(np.uint64)


def _add(batches, slots: int):
    """Sums of the parts' counters, one row for each part that the task has."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = _counts(data, slots)
            sums[part] = sums[part] + own if part in sums else own
    if sums:
        data = [np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], ["part", "data"])


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of seven bits."""
    return np.minimum(4 * np.log2(1.0 + counts), 127).astype(np.uint8)


def split_into(counts: np.ndarray, most: int) -> np.ndarray:
    """Parts for each rarity, so that a part has about ``most`` sets; what a slot holds of other grams (the median, with a margin) is taken off."""
    noise = float(np.median(counts)) if len(counts) else 0.0
    above = 2.0 ** (np.arange(128) / 4) - 1.2 * (noise + 6 * np.sqrt(noise))
    return np.clip(np.ceil(above / most), 1, MOST_PARTS).astype(np.int64)


def _cells(names: np.ndarray, who: np.ndarray, keys: np.ndarray, weights: np.ndarray, split: np.ndarray, places: np.ndarray | None = None):
    """The keys, those that very many sets may have split into cells.

    The sets of such a key fall into parts by their names, and every two parts have a cell where they
    meet; a set goes to all cells of its part, so that no task gets a whole hot key.  Sets of one part meet in
    several cells: they are counted more often than they should be, which costs a look and no link.
    """
    parts = split[weights.astype(np.int64)]
    if not len(parts) or parts.max() == 1:
        return who, keys, places
    i = np.repeat(np.arange(len(parts)), parts)
    other = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
    p = parts[i]
    own = (mix(names[who[i]]) % p.astype(np.uint64)).astype(np.int64)
    cell = np.minimum(own, other) * p + np.maximum(own, other)
    key = np.where(p > 1, mix(keys[i] ^ mix(cell.astype(np.uint64) + np.uint64(1))), keys[i])
    return who[i], key, None if places is None else places[i]


def _keys(s: _Sets, t: Threshold, rarity: np.ndarray, x: int, skip: np.ndarray, split: np.ndarray):
    """(set, key) of small sets and (set, key, place) of the inverted lists; ``skip`` marks rows that need none."""
    one, row_at, token_at = np.uint64(1), np.uint64(GRAM_BITS), np.uint64(GRAM_BITS - TOKEN_BITS)
    rare = rarity[(s.grams & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64)
    token = mix(s.grams) >> np.uint64(64 - TOKEN_BITS)
    order = np.sort(s.row.astype(np.uint64) << row_at | rare << np.uint64(TOKEN_BITS) | token)  # by row, rarest first
    row = (order >> row_at).astype(np.int64)
    rare = order >> np.uint64(TOKEN_BITS) & np.uint64(127)
    token = order & np.uint64((1 << TOKEN_BITS) - 1)
    place = np.arange(len(row)) - (np.cumsum(s.size) - s.size)[row]
    live = ~skip[row]
    small = live & (s.size <= x)[row]
    sets, keys, weights = [], [], []
    done = np.zeros(len(s.size), np.int64)  # prefix whose pairs of a coarser class are out already
    drop = np.full(len(s.size), DROPPED)
    for g, prefix, common in reversed(_prefixes(t, s.size)):
        drop[(prefix > 0) & (common < COMMON)] = 0
        own = small & (place < prefix[row])
        single = np.flatnonzero(own & (g == 0)[row])
        if len(single):
            sets.append(row[single])
            keys.append(mix(token[single] ^ SINGLE))
            weights.append(rare[single])
        own = np.flatnonzero(own & (g > 0)[row])
        if len(own):
            late = (place[own] >= done[row[own]]).astype(np.uint64)
            both = np.sort(row[own].astype(np.uint64) << row_at | token[own] << token_at | rare[own] << one | late)
            r = (both >> row_at).astype(np.int64)
            shift = row_at - np.log2(np.maximum(g, 1)).astype(np.uint64)[r]
            h = both >> token_at & np.uint64((1 << TOKEN_BITS) - 1)
            w = both >> one & np.uint64(127)
            group = both >> shift
            d = 1
            while d < len(r):
                pair = group[d:] == group[:-d]
                if not pair.any():
                    break
                i = np.flatnonzero(pair & ((both[d:] | both[:-d]) & one > 0))
                sets.append(r[i])
                keys.append(mix(h[i] * np.uint64(3) + mix(h[i + d])))
                weights.append(np.minimum(w[i], w[i + d]))
                d += 1
            done = np.maximum(done, np.where(g > 0, prefix, 0))
    who, key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if sets:
        who, key, weight = np.concatenate(sets), np.concatenate(keys), np.concatenate(weights)
        # A set leaves out its most frequent keys, those that tie with the most frequent one kept aside.
        level = weight << np.uint64(32) | key >> np.uint64(32)
        both = np.sort(who.astype(np.uint64) << np.uint64(39) | level)
        begin = np.searchsorted(both, np.arange(len(s.size)).astype(np.uint64) << np.uint64(39))
        end = np.append(begin[1:], len(both))
        most = np.zeros(len(s.size), np.uint64)
        has = end - drop > begin
        most[has] = both[(end - drop - 1)[has]] & np.uint64((1 << 39) - 1)
        keep = level <= most[who]
        who, key, _ = _cells(s.name, who[keep], key[keep], weight[keep], split)
    listed = live & (s.size >= t.smallest(x + 1))[row] & (place < (s.size - t.need(s.size, t.smallest(s.size)) + 1)[row])
    at = np.flatnonzero(listed)
    return (who, key), _cells(s.name, row[at], mix(token[at] ^ LISTED), rare[at], split, place[at])


def _pack(names: np.ndarray, sizes: np.ndarray, who: np.ndarray, keys: np.ndarray, places: np.ndarray | None, buckets: int):
    """(bucket, bytes) of the keys: a table of the sets in it with the number of keys of each, then the keys, 4 bytes each."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    if places is None:  # bucket and set above the 32 bits of the key that are kept
        both = np.sort((bucket * len(names) + who).astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF))
        bucket, who = np.divmod((both >> np.uint64(32)).astype(np.int64), len(names))
        keys = both & np.uint64(0xFFFFFFFF)
    else:
        order = np.argsort(bucket * len(names) + who, kind="stable")
        bucket, who, keys, places = bucket[order], who[order], keys[order], places[order]
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(bucket)).tolist()):
        table, count = np.unique(who[a:b], return_counts=True)
        parts = [np.array([len(table), b - a], np.uint32).tobytes(), names[table].tobytes(), sizes[table].astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes(), keys[a:b].astype(np.uint32).tobytes()]
        if places is not None:
            parts.append(places[a:b].astype(np.uint32).tobytes())
        yield int(bucket[a]), b"".join(parts)


def _unpack(data: bytes, listed: bool):
    k, m = np.frombuffer(data, np.uint32, 2).tolist()
    at = 8
    out = []
    for count, kind in ((k, np.uint64), (k, np.uint32), (k, np.uint32), (m, np.uint32), *([(m, np.uint32)] if listed else [])):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    names, sizes, counts, keys = out[:4]
    return keys, np.repeat(names, counts), np.repeat(sizes, counts), out[4] if listed else np.zeros(0, np.uint32)


def _post(batches, n: int, t: Threshold, rarity: np.ndarray, x: int, buckets: int, split: np.ndarray):
    """Pass 2: packed keys of all sets, equal sets of a task once."""
    held: list[tuple] = []
    seen: set[int] = set()

    def flush():
        names = np.concatenate([h[0] for h in held])
        sizes = np.concatenate([h[1] for h in held])
        base = np.cumsum([0, *(len(h[0]) for h in held)])
        for listed, parts in ((False, [h[2] for h in held]), (True, [h[3] for h in held])):
            who = np.concatenate([p[0] + base[i] for i, p in enumerate(parts)])
            keys = np.concatenate([p[1] for p in parts])
            places = np.concatenate([p[2] for p in parts]) if listed else None
            packed = list(_pack(names, sizes, who, keys, places, buckets))
            for i in range(0, len(packed), 64):
                some = packed[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in some], pa.int32()), pa.array([listed] * len(some)), pa.array([p[1] for p in some], pa.binary())], ["bucket", "listed", "data"])

    rows = 0
    for batch in batches:
        for a, b in chunks(batch.column(0)):
            s = _Sets(batch.column(0).slice(a, b - a), n)
            skip = np.ones(len(s.size), bool)
            for r in s.rows.tolist():
                name = int(s.name[r])
                if name not in seen:
                    seen.add(name)
                    skip[r] = False
            small, listed = _keys(s, t, rarity, x, skip, split)
            if rows + len(s.size) > PACK_ROWS and held:
                yield from flush()
                held, rows = [], 0
                if len(seen) > 1_000_000:
                    seen = set()
            held.append((s.name, s.size, small, listed))
            rows += len(s.size)
    if held:
        yield from flush()


def _meet(keys, names, sizes, places, t: Threshold, x: int, listed: bool, block: int = 2_000_000):
    """(pairs of names with common keys, how many, how many are needed), in blocks; a pair can come in several."""
    which = np.flatnonzero(np.bincount(keys & np.uint32(0xFFFFFF), minlength=1 << 24)[keys & np.uint32(0xFFFFFF)] > 1) if len(keys) > 1 << 20 else np.arange(len(keys))
    keys, names, sizes = keys[which], names[which], sizes[which].astype(np.int64)
    order = np.lexsort((names, keys))
    keys, names, sizes = keys[order], names[order], sizes[order]
    places = places[which][order].astype(np.int64) if listed else places
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
    keys, names, sizes = keys[new], names[new], sizes[new]
    places = places[new] if listed else places
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    length = np.diff(np.append(begin, len(keys)))
    partners = np.repeat(begin + length, length) - np.arange(len(keys)) - 1 if len(keys) else begin  # later members of the list
    ends = np.cumsum(partners)
    at = 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        count = partners[at:to]
        left = np.repeat(np.arange(at, to), count)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        a, b = sizes[left], sizes[right]
        keep = np.minimum(a, b) >= t.smallest(np.maximum(a, b))
        if listed:
            keep &= (np.maximum(a, b) > x) & (1 + np.minimum(a - places[left], b - places[right]) > t.need(a, b))
        else:
            keep &= np.maximum(a, b) <= x
        left, right = left[keep], right[keep]
        if len(left):
            pairs = np.stack([names[left], names[right], np.minimum(a, b)[keep].astype(np.uint64)], axis=1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            first = np.flatnonzero(np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1)))
            times = np.diff(np.append(first, len(pairs)))
            least = pairs[first, 2].astype(np.int64)
            needed = np.ones(len(first), np.int64) if listed else np.where(_common_subsets(t, _class(least)) == COMMON, COMMON - DROPPED, 1)
            yield pairs[first, :2], times, needed
        at = to


def _candidates(batches, t: Threshold, x: int):
    """Pairs met in the bucket of a task."""
    held: dict[bool, list[tuple]] = {False: [], True: []}
    for batch in batches:
        for listed, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[listed].append(_unpack(data, listed))
    for listed, parts in held.items():
        if parts:
            for pairs, times, needed in _meet(*(np.concatenate([p[i] for p in parts]) for i in range(4)), t, x, listed):
                ends = [pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(times), pa.array(needed)], ["a", "b", "times", "needed"])


def _grams(batches, n: int, wanted: _Table):
    """Pass 2 b: the grams of the records that candidates name."""
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            own = np.flatnonzero(wanted.has(batch.column(0).slice(a, b - a).to_numpy().view(np.uint64)))
            if len(own):
                s = _Sets(batch.column(1).slice(a, b - a).take(pa.array(own)), n)
                yield pa.RecordBatch.from_arrays([pa.array(s.name[s.rows].view(np.int64)), pa.array(s.packed(s.rows), pa.binary())], ["name", "grams"])


def _common(batches, t: Threshold):
    """Exact number of common grams of each candidate, and whether it is enough."""
    def flat(column):
        raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = np.array([len(v) // 6 for v in raw.to_pylist()])
        wide = np.zeros((int(size.sum()), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, 6)
        return size, wide.view(np.uint64).ravel()

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            (na, ga), (nb, gb) = flat(part.column(2)), flat(part.column(3))
            salt = mix(np.arange(part.num_rows).astype(np.uint64))
            both = np.concatenate([ga ^ np.repeat(salt, na), gb ^ np.repeat(salt, nb)])
            owner = np.concatenate([np.repeat(np.arange(part.num_rows), na), np.repeat(np.arange(part.num_rows), nb)])
            order = np.argsort(both, kind="stable")
            twice = np.flatnonzero(both[order][1:] == both[order][:-1])
            common = np.bincount(owner[order][twice], minlength=part.num_rows)
            ok = np.flatnonzero(common >= t.need(na, nb))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ok)), part.column(1).take(pa.array(ok)), pa.array(common[ok] / (na + nb - common)[ok])], ["a", "b", "similarity"])


@dataclass(frozen=True)
class NearDuplicates:
    """``members`` (name, key, size): the set of each record; ``links`` (a, b, similarity): linked, different sets, a and b names in either order."""

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(a, b, similarity): every two linked keys, a < b, those of equal sets included."""
        own = self.members.select("name", "key").distinct()
        left = own.select(F.col("name").alias("a"), F.col("key").alias("ka"))
        right = own.select(F.col("name").alias("b"), F.col("key").alias("kb"))
        linked = self.links.join(left, "a").join(right, "b").select("ka", "kb", "similarity")
        equal = left.join(right, F.col("a") == F.col("b")).where("ka < kb").select("ka", "kb", F.lit(1.0).alias("similarity"))
        both = linked.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity").where("a < b")
        return both.unionAll(equal.toDF("a", "b", "similarity")).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    def groups(self) -> DataFrame:
        """(key, class_id, group_id, copies, links): for each key its class of equal sets, its group of chained links, and their numbers."""
        classes = self.members.groupBy("name").agg(F.min("key").alias("class_id"), F.countDistinct("key").alias("copies"))
        edges = self.links.select("a", "b").unionAll(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = edges.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "name")
        label = components(self.members.select("name").distinct(), edges)
        rows = classes.join(label, "name").join(degree, "name", "left")
        rows = rows.join(rows.groupBy("label").agg(F.min("class_id").alias("group_id")), "label")
        return self.members.select("name", "key").distinct().join(rows, "name").select("key", "class_id", "group_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, label): the least name of each node's component; ``edges`` (a, b) in both directions.

    Labels take the least of their neighbours' and then jump to their label's label, until none changes;
    every round is written to the shared folder.
    """
    edges = checkpointed(edges.distinct())
    linked = checkpointed(edges.select(F.col("a").alias("name")).distinct().withColumn("label", F.col("name")))
    while True:
        near = edges.join(linked.withColumnRenamed("name", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        new = linked.join(near.withColumnRenamed("a", "name"), "name").select("name", F.least("label", "least").alias("to"), "label")
        new = checkpointed(new)
        jump = new.select(F.col("name").alias("to"), F.col("to").alias("further"))
        moved = new.join(jump, "to").select("name", F.least("to", "further").alias("label"), F.col("label").alias("old"))
        moved = checkpointed(moved)
        linked = moved.select("name", "label")
        if moved.where("label <> old").isEmpty():
            break
    return nodes.join(linked, "name", "left").select("name", F.coalesce("label", "name").alias("label"))


def near_duplicates(records: DataFrame, key: str, text: str, n: int = 5, p: int = 4, q: int = 5, hot: int = HOT_SETS) -> NearDuplicates:
    """Links between the texts of ``records`` whose sets of ``n`` consecutive words are p/q alike or more (p/q at least 1/2).

    Exact up to hashes (44 bits for a gram, 64 for a set).  Texts with fewer than n words (null and empty ones too) have no grams and
    no links.  A key may come in several rows; equal texts of one key are one, and pairs are of different
    keys.  Rows with a null key are left out; an empty table gives no links.
    """
    if 2 * p < q or p > q:
        raise ValueError("the threshold must be between 1/2 and 1")
    spark = records.sparkSession
    t = Threshold(p, q)
    rows = records.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = records.schema[key].dataType.simpleString()
    size = slots(int(rows.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    profile = checkpointed(rows.mapInArrow(lambda it: _profile(it, n, size), f"name bigint, key {kind}, part int, data binary, size bigint, sets bigint"))
    members = profile.where("name IS NOT NULL").select("name", "key", "size")
    sizes = profile.where("sets IS NOT NULL").groupBy("size").agg(F.sum("sets").alias("sets")).toArrow()
    parts = profile.where("part IS NOT NULL").select("part", "data").repartition(16, "part").mapInArrow(lambda it: _add(it, size), "part int, data binary").collect()
    counts = np.zeros(size, np.uint64)
    for r in parts:
        counts.reshape(16, -1)[r.part] = _counts(r.data, size)
    grams, sets = sizes["size"].to_numpy(), sizes["sets"].to_numpy()
    x = boundary(t, grams, sets, counts)
    rarity, split = _rarity(counts), split_into(counts, hot)
    expected = float((_subsets(t, grams.astype(np.int64)) * sets).sum())
    buckets = int(max(spark.sparkContext.defaultParallelism, expected // BUCKET_KEYS + 1))
    posted = rows.select("text").mapInArrow(lambda it: _post(it, n, t, rarity, x, buckets, split), "bucket int, listed boolean, data binary")
    met = posted.repartitionById(buckets, "bucket").select("listed", "data").mapInArrow(lambda it: _candidates(it, t, x), "a bigint, b bigint, times bigint, needed bigint")
    pairs = met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("needed").alias("needed")).where("times >= needed").select("a", "b")
    pairs = checkpointed(pairs)
    named = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    keys = checkpointed(members.join(named, "name", "left_semi").groupBy("name").agg(F.min("key").alias("key")).select(F.xxhash64("key").alias("anchor")))
    wanted = _table(keys, keys.count())  # one record of each set that a candidate names
    sets_ = rows.select(F.xxhash64("key").alias("k"), "text").mapInArrow(lambda it: _grams(it, n, wanted), "name bigint, grams binary")
    one = checkpointed(sets_).groupBy("name").agg(F.first("grams").alias("grams"))
    a = one.select(F.col("name").alias("a"), F.col("grams").alias("ga"))
    b = one.select(F.col("name").alias("b"), F.col("grams").alias("gb"))
    sided = pairs.join(a, "a").join(b, "b").select("a", "b", "ga", "gb")
    links = checkpointed(sided.mapInArrow(lambda it: _common(it, t), "a bigint, b bigint, similarity double"))
    return NearDuplicates(members, links)
