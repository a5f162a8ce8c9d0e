"""Problem 7: ids of a public byte-level vocabulary for whole texts.

Pre-tokenisation works on arrays: every code point gets a class, every class is a transition function of
a small automaton (nine states, packed in one integer), and the state behind each character is found by
an associative scan that composes these functions over windows of doubling length until they are
constant.  Class changes and the states that end a contraction give the boundaries.  Slices are hashed in
the arrays and looked up in a table kept by each worker; only slices not seen before are merged pair by
pair.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillon.llm.codepoints import TOP, chunks, decode, slice_hashes

L, N, S, O = 0, 1, 2, 3
# States behind a character: in letters, numbers, others, white space; an apostrophe that began a slice, followed by r or v,
# by l; a contraction just ended; a plain space.
LETTERS, NUMBERS, OTHERS, BLANK, MARK, MARK_RV, MARK_L, ENDED, PLAIN = range(9)
STATES = 9
# Classes of the automaton: those above (3 is others), then the letters that matter after an apostrophe, the apostrophe, the space.
STMD, RV, E, ELL, APOSTROPHE, SPACE = range(4, 10)
#: Slices remembered by a worker, and slots of the table that finds most of them at once.
REMEMBERED, SLOTS = 400_000, 1 << 19


@lru_cache(None)
def kinds() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(TOP, O, np.uint8)
    for span in (range(0, 0x20000), range(0x20000, 0x323B0)):
        cats = map(unicodedata.category, map(chr, span))
        out[span.start : span.stop] = [{"L": L, "N": N, "Z": S}.get(c[0], O) for c in cats]
    out[[9, 10, 11, 12, 13, 0x85]] = S
    return out


@lru_cache(None)
def steps() -> tuple[np.ndarray, np.ndarray]:
    """Automaton class of every code point, and the packed transition function of each class."""
    of = kinds().copy()
    for cls, signs in ((STMD, "stmd"), (RV, "rv"), (E, "e"), (ELL, "l"), (APOSTROPHE, "'"), (SPACE, " ")):
        of[[ord(c) for c in signs]] = cls
    to = {L: LETTERS, N: NUMBERS, S: BLANK, O: OTHERS, STMD: LETTERS, RV: LETTERS, E: LETTERS, ELL: LETTERS, APOSTROPHE: MARK, SPACE: PLAIN}
    special = {
        STMD: {MARK: ENDED}, RV: {MARK: MARK_RV}, E: {MARK_RV: ENDED}, ELL: {MARK: MARK_L, MARK_L: ENDED},
        APOSTROPHE: {OTHERS: OTHERS, MARK: OTHERS, PLAIN: OTHERS},
    }
    packed = [sum(special.get(c, {}).get(s, to[c]) << (4 * s) for s in range(STATES)) for c in range(10)]
    return of, np.array(packed, np.uint64)


def _constant(f: np.ndarray) -> np.ndarray:
    return f == (f & np.uint64(15)) * np.uint64(sum(1 << (4 * s) for s in range(STATES)))


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The function that applies ``first`` and then ``second``."""
    out = np.zeros(len(first), np.uint64)
    for s in range(STATES):
        middle = first >> np.uint64(4 * s) & np.uint64(15)
        out |= (second >> (middle << np.uint64(2)) & np.uint64(15)) << np.uint64(4 * s)
    return out


def states(cls: np.ndarray) -> np.ndarray:
    """State behind every character: prefix compositions by doubling; places whose function is constant are done."""
    f = steps()[1][cls]
    if len(f):
        f[0] = (f[0] >> np.uint64(4 * BLANK) & np.uint64(15)) * np.uint64(sum(1 << (4 * s) for s in range(STATES)))  # a text begins as behind white space
    left = np.flatnonzero(~_constant(f))
    width = 1
    while len(left):
        composed = _then(f[left - width], f[left])
        f[left] = composed
        left = left[~_constant(composed)]
        width *= 2
    return (f & np.uint64(15)).astype(np.uint8)


def split(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where a slice begins (for rows as :func:`decode` gives them, the closing line feed is a slice of its own).

    The pattern: a contraction ('s 't 're 've 'm 'll 'd), or an optional space and a run of letters, numbers
    or others, or a run of spaces, whose last one is left to the next slice if a character follows.
    """
    n = len(cps)
    kind = kinds()[cps]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[off[:-1]] = True
    closing = off[1:] - 1
    begin[closing] = True
    space = kind == S
    # The last space of a run before another character: a slice of its own, or, if it is the plain one, the head of the next slice.
    after = np.zeros(n, bool)
    after[:-1] = space[:-1] & ~space[1:]
    after[closing] = False
    begin[after] = True
    glue = np.flatnonzero(after & (cps == 32))
    begin[glue + 1] = False
    # A contraction is one slice; what follows its last letter begins another.
    end = np.flatnonzero(states(steps()[0][cps]) == ENDED)
    if len(end):
        long = cps[end - 1] != 39
        begin[end - long.astype(np.int64)] = False
        begin[end + 1] = True
    return np.flatnonzero(begin)


class Encoder:
    """Pair merging with the ranks of a vocabulary file, and what it has merged so far."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary  # takes a slice as one piece
        self.single = {k: [v] for k, v in ranks.items()}
        # The bytes of all tokens end to end, in the order of their ids.
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(k) for k in ranks]
        self.size = size
        self.place = np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        self.forget()

    def forget(self):
        self.number = {}  # hash of a slice -> its number
        self.ids: list[np.ndarray] = []
        self.count = np.zeros(1 << 12, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = self.end = 0
        self.slot_hash = np.zeros(SLOTS, np.uint64)
        self.slot_number = np.full(SLOTS, -1, np.int64)

    def learn(self, hashes: list[int], pieces: list[bytes]):
        for h, piece in zip(hashes, pieces):
            ids = self.single.get(piece) or self.merge(piece.decode())
            if self.used == len(self.count):
                self.count = np.concatenate([self.count, np.zeros_like(self.count)])
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            while self.end + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.end : self.end + len(ids)] = ids
            self.start[self.used], self.count[self.used] = self.end, len(ids)
            self.number[h] = self.used
            self.used += 1
            self.end += len(ids)

    def numbers(self, hashes: np.ndarray, raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of slices, which lie at begin:end in ``raw``."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        number = self.slot_number[slot]
        miss = np.flatnonzero((self.slot_hash[slot] != hashes) | (number < 0))
        if len(miss):
            new, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            known = self.number
            listed = new.tolist()
            fresh = [k for k, h in enumerate(listed) if h not in known]
            at = miss[first[fresh]]
            self.learn([listed[k] for k in fresh], [raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())])
            got = np.array([known[h] for h in listed], np.int64)
            number[miss] = got[inverse]
            slot = (new & np.uint64(SLOTS - 1)).astype(np.int64)
            self.slot_hash[slot], self.slot_number[slot] = new, got
        return number

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets of a chunk of texts."""
        if self.used > REMEMBERED:
            self.forget()
        cps, off = decode(text)
        begin = split(cps, off)
        size = np.diff(np.append(begin, len(cps)))
        hashes = slice_hashes(cps, begin, size)
        raw = cps.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
        if len(raw) == len(cps):
            place = np.append(begin, len(cps))
        else:
            width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            place = np.concatenate([[0], np.cumsum(width)])[np.append(begin, len(cps))]
        real = np.ones(len(begin), bool)
        closing = np.searchsorted(begin, off[1:] - 1)
        real[closing] = False
        number = self.numbers(hashes[real], raw, place[:-1][real], place[1:][real])
        count = self.count[number].astype(np.int64)
        end = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[number] - (end - count), count) + np.arange(int(end[-1]) if len(end) else 0)]
        per_slice = np.concatenate([[0], end])
        rows = np.concatenate([[0], closing + 1]) - np.arange(len(closing) + 1)  # slices before each row, without the closing ones
        return ids, per_slice[rows]


    def begins(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The byte of its text (in UTF-8) at which each id begins."""
        end = np.concatenate([[0], np.cumsum(self.size[ids])])
        return end[:-1] - np.repeat(end[off[:-1]], np.diff(off))

    def decode(self, ids: np.ndarray, off: np.ndarray, null: np.ndarray) -> pa.Array:
        """The texts of flat ids: one gather of all bytes."""
        size = self.size[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        flat = self.bytes[np.repeat(self.place[ids] - end[:-1], size) + np.arange(end[-1])]
        mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        raw = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [mask, pa.py_buffer(end[off].tobytes()), pa.py_buffer(flat.tobytes())])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that were not made from a text
            return pa.array([None if v is None else v.decode("utf-8", "replace") for v in raw.to_pylist()], pa.string())


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """(key, ids): the ids that the vocabulary file at ``vocabulary`` gives the text as stored.

    With ``offsets`` also an array ``begins``, the byte of the text (in UTF-8) at which each id begins.

    Strings that look like special tokens are ordinary text.  Null and empty texts both give an empty
    list.  One row for each row of ``df``, repeated or not; a null key is passed on; other columns are
    not read.  A text of any length is encoded whole.  No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            for a, b in chunks(batch.column(1), limit=1 << 19):
                ids, off = own.encode(batch.column(1).slice(a, b - a))
                columns = [ids, own.begins(ids, off).astype(np.int32)] if offsets else [ids]
                ends = pa.array(off.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns)], [key, "ids", "begins"][: 1 + len(columns)])

    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", begins array<int>" * offsets)


def token_texts(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the inverse of :func:`token_ids`; an empty list gives an empty text and a null list a null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), own.decode(flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), null)], [key, "text"])

    return df.select(f"`{key}`", f"`{ids}`").mapInArrow(run, f"`{key}` {kind}, text string")
