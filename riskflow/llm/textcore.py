"""Vectorised word hashing over Arrow batches of UTF-8 texts.

A word is a maximal run of bytes that a 256-entry class table maps to a
non-zero byte; the mapped bytes (A-Z lower-cased) are hashed as a polynomial
modulo 2^64 and mixed.  Work is done on byte buffers, so no Python string is
made per word.  Null texts read as empty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_ROWS = 512  # rows of one Arrow batch of whole texts

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
_INV_INT = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**n modulo 2^64 (grown on demand, kept per process)."""
    global _pow
    if len(_pow) <= n:
        size = max(256, 1 << int(n + 1).bit_length())
        steps = np.full(size, BASE, dtype=U64)
        steps[0] = 1
        _pow = np.cumprod(steps, dtype=U64)
    return _pow


def inverse_powers(n: int) -> np.ndarray:
    """BASE**-0 .. BASE**-n modulo 2^64."""
    global _inv
    if len(_inv) <= n:
        size = max(256, 1 << int(n + 1).bit_length())
        steps = np.full(size, _INV_INT, dtype=U64)
        steps[0] = 1
        _inv = np.cumprod(steps, dtype=U64)
    return _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def class_table(is_word) -> np.ndarray:
    """Byte table: 0 for separators, else the byte with A-Z lower-cased.
    ``is_word`` decides for the lower-cased byte value."""
    t = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if low and is_word(low):
            t[b] = low
    return t


#: [^\x20\x09-\x0D]+  (NUL is kept as a word byte through value 1, see ``space_words``)
SPACE_WORDS = class_table(lambda b: not (b == 32 or 9 <= b <= 13))
SPACE_WORDS[0] = 1
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM_WORDS = class_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off


def slices(offsets: np.ndarray, max_bytes: int = CHUNK_BYTES):
    """Row ranges [lo, hi) of about ``max_bytes`` each; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """Words of a run of texts: ``hash``, ``start``/``end`` (byte positions in
    the run's buffer), ``doc`` (row in the run) and ``first`` (n_docs + 1
    offsets of each text's words)."""

    __slots__ = ("hash", "start", "end", "doc", "first", "data", "offsets", "terms", "cum")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        base = offsets[0]
        self.data = data[base:offsets[-1]]
        self.offsets = offsets - base
        m = table[self.data]
        is_word = m != 0
        before = np.empty_like(is_word)
        if len(m):
            before[0] = False
            before[1:] = is_word[:-1]
            inner = self.offsets[:-1]
            before[inner[inner < len(m)]] = False  # a text never continues the one before
        self.start = np.flatnonzero(is_word & ~before)
        after = np.empty_like(is_word)
        if len(m):
            after[-1] = False
            after[:-1] = is_word[1:] & before[1:]
        self.end = np.flatnonzero(is_word & ~after) + 1
        lens = self.end - self.start
        self.cum = np.zeros(len(lens) + 1, dtype=np.int64)
        np.cumsum(lens, out=self.cum[1:])
        off = np.arange(self.cum[-1]) - np.repeat(self.cum[:-1], lens)
        pw = powers(int(lens.max()) if len(lens) else 0)
        self.terms = m[is_word].astype(U64) * pw[off]
        raw = np.add.reduceat(self.terms, self.cum[:-1]) if len(lens) else np.zeros(0, U64)
        self.hash = mix(raw + lens.astype(U64) * U64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def word_hash(word: str, table: np.ndarray = ALNUM_WORDS) -> int:
    """The hash that ``Words`` gives one word."""
    b = np.frombuffer(word.encode("utf-8"), dtype=np.uint8)
    w = Words(b, np.array([0, len(b)], dtype=np.int64), table)
    if len(w.hash) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(w.hash[0])


_SHINGLE = [U64(int(x) | 1) for x in mix(np.arange(1, 65, dtype=U64))]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one word sequence; the whole sequence
    as one when it is shorter; none for no words."""
    n = len(h)
    if n == 0:
        return np.zeros(0, dtype=U64)
    width = min(k, n)
    acc = np.zeros(n - width + 1, dtype=U64)
    for i in range(width):
        acc += h[i:n - width + 1 + i] * _SHINGLE[i % 64]
    return mix(acc + U64(width))


def in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each x in the sorted array ``table`` or -1."""
    if len(table) == 0:
        return np.full(len(x), -1, dtype=np.int64)
    i = np.searchsorted(table, x)
    i[i == len(table)] = 0
    return np.where(table[i] == x, i, -1)


class Lookup:
    """Membership of many hashes in a small sorted table: a bitmap over the
    top bits answers most, ``searchsorted`` the rest."""

    def __init__(self, table: np.ndarray, bits: int = 20):
        self.table = np.asarray(table, dtype=U64)
        self.shift = U64(64 - bits)
        self.bitmap = np.zeros(1 << bits, dtype=bool)
        self.bitmap[(self.table >> self.shift).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in x, index in table) of the members."""
        pos = np.flatnonzero(self.bitmap[(x >> self.shift).astype(np.int64)])
        idx = in_sorted(x[pos], self.table)
        ok = idx >= 0
        return pos[ok], idx[ok]


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)


class HashIndex:
    """Numbers 64-bit hashes 0, 1, .. in an open-addressing table kept in
    arrays, so that millions of look-ups are a few vector operations."""

    def __init__(self, capacity: int):
        self.bits = max(10, int(2 * capacity - 1).bit_length())
        self.capacity = capacity
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=U64)
        self.vals = np.full(1 << self.bits, -1, dtype=np.int32)
        self.size = 0

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash or -1.  (A hash of 0 reads as 1.)"""
        h = np.where(h == 0, U64(1), h)
        mask = len(self.keys) - 1
        at = self._home(h)
        out = self.vals[at]
        key = self.keys[at]
        todo = np.flatnonzero((key != h) & (key != 0))
        out[key == 0] = -1
        at = at[todo]
        while len(todo):
            at = (at + 1) & mask
            key = self.keys[at]
            hit = key == h[todo]
            out[todo[hit]] = self.vals[at[hit]]
            out[todo[key == 0]] = -1
            more = ~hit & (key != 0)
            todo, at = todo[more], at[more]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Number distinct hashes that are not in the table; their numbers."""
        if self.size + len(h) > len(self.keys) * 3 // 4:
            self._grow(self.size + len(h))
        numbers = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self._put(np.where(h == 0, U64(1), h), numbers)
        self.size += len(h)
        return numbers

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at, todo = self._home(h), np.arange(len(h))
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[todo[free]]
            won = free & (self.keys[at] == h[todo])
            self.vals[at[won]] = numbers[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & mask

    def _grow(self, need: int) -> None:
        keys, vals = self.keys, self.vals
        self.bits = int(2 * need - 1).bit_length()
        self.keys = np.zeros(1 << self.bits, dtype=U64)
        self.vals = np.full(1 << self.bits, -1, dtype=np.int32)
        used = keys != 0
        self._put(keys[used], vals[used])


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], .., begin[0] + size[0] - 1, begin[1], .."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def run_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of each run of consecutive bytes that tile ``data``."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    off = np.arange(len(data)) - np.repeat(start, size)
    terms = (data.astype(U64) + U64(1)) * powers(int(size.max()))[off]
    return mix(np.add.reduceat(terms, start) + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def text_batches(spark) -> None:
    """Keep Arrow batches of whole texts small (a session setting; results do
    not depend on it): the default of 10,000 rows holds tens of MB of text in
    the JVM's buffers and in each Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))
