"""Texts as flat numpy code-point arrays.

Every operator on text in this subpackage works on this form: the rows of an
Arrow string array are laid end to end, each followed by one line feed, decoded
in one call and then handled with table gathers, reductions and scans.  No
Python string is made for a row.

A *chunk* bounds the memory: :func:`chunks` cuts an Arrow batch into slices of
about ``CHUNK_BYTES`` bytes (a single longer text is a slice of its own, whole).
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
TOP = 0x110000
LF = 10

# The characters the consistent form drops or turns into a space.
INVISIBLE = (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
JOINERS = (0x200C, 0x200D)
SPACES = (0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
# Cyrillic and Greek letters and the Latin letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ά": "á", "ί": "í", "ό": "ó",
}

# Bits of the class table.
LETTER, MARK, DIGIT, LATIN, FOREIGN, DEVA, SUSPECT, NUMBER = 1, 2, 4, 8, 16, 32, 64, 128
WORD = LETTER | MARK | DIGIT


def _assigned() -> list[range]:
    """Planes that hold letters, marks or digits; the others are unassigned or private."""
    return [range(0, 0x1FFFF), range(0x20000, 0x323B0), range(0xE0000, 0xE01F0)]


@lru_cache(None)
def classes() -> np.ndarray:
    """Class bits of every code point."""
    out = np.zeros(TOP, np.uint8)
    bits = {"L": LETTER, "M": MARK}
    for span in _assigned():
        cats = list(map(unicodedata.category, map(chr, span)))
        out[span.start : span.stop] = [
            bits.get(c[0], 0) if c[0] != "N" else (DIGIT | NUMBER if c == "Nd" else NUMBER) for c in cats
        ]
    for cp in np.flatnonzero(out[:0x20000] & LETTER).tolist():
        name = unicodedata.name(chr(cp), "")
        if name.startswith(("LATIN ", "FULLWIDTH LATIN ")) or cp in (0x00AA, 0x00BA):
            out[cp] |= LATIN
        elif cp < 0x2000 and name.startswith(("CYRILLIC ", "GREEK ")):
            out[cp] |= FOREIGN | SUSPECT
    out[0x0900:0x0980] |= DEVA
    out[0xA8E0:0xA900] |= DEVA
    out[list(INVISIBLE)] |= SUSPECT
    out[list(SPACES)] |= SUSPECT
    out[list(wide())] |= SUSPECT
    out[ccc() > 0] |= SUSPECT
    return out


@lru_cache(None)
def wide() -> dict[int, int]:
    """Full-width characters and their plain ones, from the character database."""
    marked = ((cp, unicodedata.decomposition(chr(cp))) for cp in range(0xFF00, 0xFFF0))
    return {cp: int(d.split()[1], 16) for cp, d in marked if d.startswith("<wide>")}


@lru_cache(None)
def ccc() -> np.ndarray:
    """Canonical combining class of every code point."""
    out = np.zeros(TOP, np.uint8)
    for span in _assigned():
        out[span.start : span.stop] = list(map(unicodedata.combining, map(chr, span)))
    return out


@lru_cache(None)
def lower() -> np.ndarray:
    """Lower-case code point of every code point (the same one where it takes several)."""
    out = np.arange(TOP, dtype=np.uint32)
    for cp in range(0x1F000):
        low = chr(cp).lower()
        if len(low) == 1:
            out[cp] = ord(low)
    return out


@lru_cache(None)
def one_to_one() -> np.ndarray:
    """Plain character of a full-width one, the space of an odd one, else the same."""
    out = np.arange(TOP, dtype=np.uint32)
    for cp, plain in wide().items():
        out[cp] = plain
    out[list(SPACES)] = 32
    return out


@lru_cache(None)
def latin_of() -> np.ndarray:
    out = np.arange(TOP, dtype=np.uint32)
    for a, b in LOOKALIKES.items():
        out[ord(a)] = ord(b)
    return out


@lru_cache(None)
def compositions() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (first << 21 | second) of canonical compositions, and the single characters."""
    pairs = {}
    for cp in range(0xC0, 0x1FFFF):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.combining(chr(b)):
                pairs[a << 21 | b] = cp
    keys = np.array(sorted(pairs), np.uint64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


@lru_cache(None)
def decompositions() -> tuple[np.ndarray, np.ndarray]:
    """For every code point the length of its full canonical decomposition (1: none), and the code points (4 columns of those longer)."""
    length = np.ones(TOP, np.uint8)
    rows = {}
    for cp in range(0xC0, 0x1FFFF):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and not 0xAC00 <= cp < 0xD7A4:
            length[cp] = len(d)
            rows[cp] = [*map(ord, d), 0, 0, 0][:4]
    table = np.zeros((max(rows) + 1, 4), np.uint32)
    for cp, r in rows.items():
        table[cp] = r
    return length, table


def chunks(*arrays: pa.Array, limit: int = CHUNK_BYTES):
    """(start, stop) row slices with about ``limit`` bytes of text in all of ``arrays``."""
    n = len(arrays[0])
    if not n:
        return
    ends = np.zeros(n, np.int64)
    for array in arrays:
        ends += pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(ends)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def decode(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points and row offsets; each row ends with a line feed that is not part of it, and a null is empty.

    Row i is ``cps[off[i] : off[i + 1] - 1]``.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    array = pc.binary_join_element_wise(array, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if not len(array):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    cps = np.frombuffer(str(raw, "utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    off = bounds - bounds[0]
    if len(cps) != len(raw):
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        if int(np.count_nonzero(lead)) != len(cps):  # broken UTF-8: count what the decoder made of each row
            texts = [str(raw.slice(int(a), int(b - a)), "utf-8", "replace") for a, b in zip(off, off[1:])]
            cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            return cps, np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        count = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
        off = count[off]
    return cps, off.astype(np.int64)


def encode(cps: np.ndarray, off: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The inverse of :func:`decode`: an Arrow string array without the closing line feeds."""
    n = len(off) - 1
    keep = np.ones(len(cps), bool)
    keep[off[1:] - 1] = False
    flat = cps[keep]
    flat = np.where((flat >= 0xD800) & (flat < 0xE000), np.uint32(0xFFFD), flat)
    off = off - np.arange(n + 1)
    raw = flat.tobytes().decode("utf-32-le").encode()
    width = 1 + (flat >= 0x80).astype(np.uint8) + (flat >= 0x800) + (flat >= 0x10000)
    bounds = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[off]
    mask = None
    if null is not None and null.any():
        mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    kind, dtype = (pa.string(), np.int32) if len(raw) < 2**31 - 1 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, n, [mask, pa.py_buffer(bounds.astype(dtype).tobytes()), pa.py_buffer(raw)])


def take_rows(cps: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flat form of some of the rows."""
    size = off[rows + 1] - off[rows]
    new = np.concatenate([[0], np.cumsum(size)])
    return cps[np.repeat(off[rows] - new[:-1], size) + np.arange(new[-1])], new


def _compose(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and the combining marks after them, composed as far as single characters exist."""
    mark = ccc()[cps] > 0
    if not mark.any():
        return cps, off
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    first[0] = False
    at = np.flatnonzero(first)
    base = at - 1
    is_letter = classes()[cps[base]] & LETTER > 0
    at, base = at[is_letter], base[is_letter]
    if not len(at):
        return cps, off
    ends = np.flatnonzero(mark & ~np.append(mark[1:], False)) + 1
    stop = ends[np.searchsorted(ends, at, "right")]
    length, table = decompositions()
    head = length[cps[base]].astype(np.int64)
    size = head + stop - at  # code points of each cluster once its base is taken apart
    begin = np.concatenate([[0], np.cumsum(size)])
    group = np.repeat(np.arange(len(at)), size)
    k = np.arange(begin[-1]) - begin[group]
    own = cps[base][group]
    tail = cps[np.minimum(at[group] + np.maximum(k - head[group], 0), len(cps) - 1)]
    parts = np.where(k < head[group], np.where(head[group] > 1, table[np.minimum(own, len(table) - 1), np.minimum(k, 3)], own), tail)
    rank = ccc()[parts].astype(np.int64)
    order = np.lexsort((np.arange(len(parts)), rank, group))
    parts, rank = parts[order], rank[order]
    keys, single = compositions()
    now = parts[begin[:-1]].copy()
    last = np.zeros(len(at), np.int64)
    kept = np.ones(len(parts), bool)
    for j in range(1, int(size.max())):
        who = np.flatnonzero(size > j)
        p = begin[who] + j
        key = now[who].astype(np.uint64) << np.uint64(21) | parts[p].astype(np.uint64)
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        joins = (keys[i] == key) & ((last[who] == 0) | (last[who] < rank[p]))
        now[who[joins]] = single[i[joins]]
        kept[p[joins]] = False
        last[who[~joins]] = rank[p[~joins]]
    parts[begin[:-1]] = now
    # Put the clusters back: each takes the place of its base, its marks go.
    count = np.ones(len(cps), np.int64)
    inside = np.repeat(at, stop - at) + (np.arange((stop - at).sum()) - np.repeat(np.cumsum(stop - at) - (stop - at), stop - at))
    count[inside] = 0
    left = np.add.reduceat(kept.astype(np.int64), begin[:-1])
    count[base] = left
    place = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(place[-1], np.uint32)
    plain = count == 1
    plain[base] = False
    out[place[:-1][plain]] = cps[plain]
    where = np.repeat(place[base] - (np.cumsum(left) - left), left) + np.arange(left.sum())
    out[where] = parts[kept]
    return out, place[off]


def consistent(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The consistent form of every row, its offsets, and which rows changed.

    Rows without a character that could change are left as they are; the rest go
    through the tables: wide forms and spaces (one gather), invisible characters
    (a mask), look-alikes (by word), then the marks.
    """
    n = len(off) - 1
    changed = np.zeros(n, bool)
    hit = np.flatnonzero(classes()[cps] & SUSPECT)
    if not len(hit):
        return cps, off, changed
    rows = np.unique(np.searchsorted(off, hit, "right") - 1)
    old, at = take_rows(cps, off, rows)
    new, now = old, at
    bits = classes()[new]
    drop = np.isin(new, INVISIBLE)
    if drop.any():
        joiner = np.isin(new, JOINERS)
        deva = bits & DEVA > 0
        between = np.zeros(len(new), bool)
        between[1:-1] = joiner[1:-1] & deva[:-2] & deva[2:]
        keep = ~drop | between
        now = np.concatenate([[0], np.cumsum(keep)])[now]
        new = new[keep]
    new = one_to_one()[new]
    bits = classes()[new]
    foreign = bits & FOREIGN > 0
    if foreign.any():
        word = (bits & WORD > 0) | np.isin(new, JOINERS)
        start = word.copy()
        start[1:] &= ~word[:-1]
        which = np.cumsum(start)  # 1, 2 ... within words; the last word's number outside
        latin = np.zeros(int(which[-1]) + 1, bool)
        latin[which[word & (bits & LATIN > 0)]] = True
        mixed = foreign & latin[which]
        new = np.where(mixed, latin_of()[new], new)
    new, now = _compose(new, now)
    same = np.diff(at) == np.diff(now)
    if same.any():
        a, _ = take_rows(old, at, np.flatnonzero(same))
        b, ends = take_rows(new, now, np.flatnonzero(same))
        equal = np.add.reduceat((a != b).astype(np.int64), ends[:-1]) == 0
        same[np.flatnonzero(same)[~equal]] = False
    if same.all():
        return cps, off, changed
    changed[rows[~same]] = True
    size = np.diff(off)
    size[rows] = np.diff(now)
    out_off = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(out_off[-1], np.uint32)
    rest = np.ones(n, bool)
    rest[rows] = False
    for src, src_off, which_rows, dst in ((cps, off, np.flatnonzero(rest), None), (new, now, np.arange(len(rows)), rows)):
        if len(which_rows):
            flat, ends = take_rows(src, src_off, which_rows)
            target = which_rows if dst is None else dst
            out[np.repeat(out_off[target] - ends[:-1], np.diff(ends)) + np.arange(len(flat))] = flat
    return out, out_off, changed


# --- words ------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.append(np.ones(1, np.uint64), np.full(4095, BASE, np.uint64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slice_hashes(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the adjoining, non-empty slices of ``values`` that begin at ``begin``."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    pos = np.arange(len(values)) - np.repeat(begin, size)
    powers = POWERS if size.max() <= len(POWERS) else np.cumprod(np.append(np.ones(1, np.uint64), np.full(int(size.max()), BASE, np.uint64)))
    return mix(np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * powers[pos], begin) ^ (size.astype(np.uint64) << np.uint64(48)))


class Words:
    """The words of a batch of rows.

    ``row`` is each word's row, ``hash`` its 64-bit hash, ``begin``/``size`` its place
    in ``chars`` (lower-case code points of words only), and ``source`` the place of a
    word's first character in the consistent form (``cps``, ``off``).
    """

    def __init__(self, array: pa.Array):
        cps, off = decode(array)
        self.cps, self.off, _ = consistent(cps, off)
        cps, off = self.cps, self.off
        table = classes()[cps]
        word = table & WORD > 0
        if table.size and (table & DEVA).any():
            word |= (cps == JOINERS[0]) | (cps == JOINERS[1])
        at = np.flatnonzero(word)
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) != 1
        self.begin = np.flatnonzero(first)
        self.size = np.diff(np.append(self.begin, len(at)))
        chars = lower()[cps[at]]
        sigma = cps[at] == 0x03A3
        if sigma.any():  # a capital sigma that ends a word of several letters is the final one
            last = self.begin + self.size - 1
            last = last[(self.size > 1) & sigma[last]]
            chars[last] = 0x03C2
        self.chars = chars
        self.source = at[self.begin] if len(at) else at
        self.row = np.searchsorted(off, self.source, "right") - 1
        self.hash = slice_hashes(chars, self.begin, self.size)
        self.rows = len(off) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words with these numbers as an Arrow array."""
        size = self.size[which] + 1
        end = np.cumsum(size)
        flat = np.full(int(end[-1]) if len(end) else 0, LF, np.uint32)
        body = np.repeat(self.begin[which] - (end - size), size) + np.arange(len(flat))
        inside = np.ones(len(flat), bool)
        inside[end - 1] = False
        flat[inside] = self.chars[body[inside]]
        return encode(flat, np.concatenate([[0], end]).astype(np.int64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every n consecutive words of a row, and the number of the first word of each."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ok = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out += self.hash[k : k + m] * POWERS[k + 1]
        return mix(out[ok]), ok
