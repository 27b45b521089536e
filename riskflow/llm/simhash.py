"""SimHash near-duplicate groups by bit-sliced comparison.

A document's fingerprint: bit b is 1 if bit b is set in more than half of the
XXH64 hashes of its k-word shingles (repeats included).  Equal fingerprints are
one class.  Two fingerprints that differ in at most ``radius`` bits agree in at
least two of radius + 2 segments, so each fingerprint joins one bucket for
every pair of segments and no link is lost.

Inside a task the buckets' fingerprints lie in bit planes: word w of plane b
holds bit b of 64 neighbouring fingerprints.  A plane XORed with itself shifted
by j compares every fingerprint with the j-th after it, 64 pairs a word; carry-save
adders sum three planes at a time into vertical counters that start so high
that a pair beyond the radius carries out of them.  A block (one word of pairs)
is abandoned once all its pairs have.  Pairs that already hang together inside
the task are not compared again, so a group of n similar fingerprints emits
n - 1 links.  A bucket beyond BLOCK members is dealt to a grid of cells.

Defined results: null text = empty; no words = fingerprint zero, linked like
any other; rows with a null id link with nothing and have a null
``component_id``; rows that share an id are one node; other columns of the
input are ignored."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.graph import connected_components
from riskflow.llm.textcore import U64, ranges, signed, slices, utf8
from riskflow.session import materialize

BLOCK = 4096  # fingerprints of one side of a cell
CHUNK = 8192  # fingerprints that a task compares at once (whole cells)
LANES = 1 << 19  # pairs whose masks are built at once

# fixed values: the five primes of XXH64
P1 = U64(0x9E3779B185EBCA87)
P2 = U64(0xC2B2AE3D27D4EB4F)
P3 = U64(0x165667B19E3779F9)
P4 = U64(0x85EBCA77C2B2AE63)
P5 = U64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte runs of one buffer, all runs a step at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at4 = np.ndarray((len(buf) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    seed_ = np.full(1, seed, dtype=U64)
    acc = np.full(len(start), (seed_ + P5)[0], dtype=U64)
    at = start.astype(np.int64).copy()
    left = size.astype(np.int64).copy()
    long = np.flatnonzero(left >= 32)
    if len(long):
        v = [np.repeat(s, len(long)) for s in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
        todo, pos, rest = np.arange(len(long)), at[long], left[long]
        while len(todo):
            for lane in range(4):
                v[lane][todo] = _round(v[lane][todo], at8[pos[todo] + 8 * lane])
            pos[todo] += 32
            rest[todo] -= 32
            todo = todo[rest[todo] >= 32]
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for lane in range(4):
            h = (h ^ _round(np.zeros(1, U64), v[lane])) * P1 + P4
        acc[long], at[long], left[long] = h, pos, rest
    acc += size.astype(U64)
    for _ in range(3):
        some = np.flatnonzero(left >= 8)
        if not len(some):
            break
        acc[some] = _rotl(acc[some] ^ _round(np.zeros(1, U64), at8[at[some]]), 27) * P1 + P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    acc[some] = _rotl(acc[some] ^ (at4[at[some]].astype(U64) * P1), 23) * P2 + P3
    at[some] += 4
    left[some] -= 4
    for _ in range(3):
        some = np.flatnonzero(left > 0)
        if not len(some):
            break
        acc[some] = _rotl(acc[some] ^ (padded[at[some]].astype(U64) * P5), 11) * P1
        at[some] += 1
        left[some] -= 1
    acc ^= acc >> U64(33)
    acc *= P2
    acc ^= acc >> U64(29)
    acc *= P3
    return acc ^ (acc >> U64(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: the bits of a byte as eight counters of one byte each
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the k-word shingles of a run of texts: lower-cased
    words, joined by one space; a shorter text is one shingle."""
    offsets = offsets - offsets[0]
    is_word = ~_SPACE[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = is_word[inner]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, offsets)
    word = np.cumsum(begins)[is_word] - 1  # the word of every byte that belongs to one
    size = np.bincount(word, minlength=len(start))
    joined = np.full(len(word) + len(start), 32, dtype=np.uint8)
    joined[np.arange(len(word)) + word] = _LOWER[data[is_word]]
    at = np.cumsum(size + 1) - (size + 1)
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, n > 0)
    out = np.concatenate([[0], np.cumsum(many)])
    head = ranges(first[:-1], many)
    tail = head + np.repeat(np.minimum(n, k) - 1, many)
    return xxh64(joined, at[head], at[tail] + size[tail] - at[head]), out


def majority_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each run h[first[i]:first[i + 1]]; zero for an empty run."""
    n = np.diff(first)
    runs = -(-n // 255)  # a one-byte counter holds 255
    run_first = np.concatenate([[0], np.cumsum(runs)])
    step = np.arange(run_first[-1]) - np.repeat(run_first[:-1], runs)
    begin = np.repeat(first[:-1], runs) + 255 * step
    out = np.zeros(len(n), dtype=U64)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for b in range(8):
        lanes = np.add.reduceat(_SPREAD[octets[:, b]], begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        count = np.add.reduceat(lanes, run_first[:-1][some], axis=0)
        bits = np.packbits(2 * count > n[some][:, None], axis=1, bitorder="little")[:, 0]
        out[some] |= bits.astype(U64) << U64(8 * b)
    return out


def _fingerprints(k: int):
    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            parts = [np.zeros(0, U64)]
            for lo, hi in slices(off):
                parts.append(majority_bits(*shingle_hashes(data[off[lo]:off[hi]], off[lo:hi + 1], k)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed(np.concatenate(parts)))], names=["id", "fp"])
    return run


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """(64, words + 1) bit planes of fingerprints, the last word empty."""
    words = -(-len(fp) // 64) + 1
    bits = np.zeros((64, words * 64), dtype=bool)
    bits[:, :len(fp)] = (fp[None, :] >> np.arange(64, dtype=U64)[:, None]) & U64(1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _carry_save(counters: list, over: np.ndarray, a, b, c) -> None:
    """Add three planes of ones to the vertical counters; what no counter holds sticks in ``over``."""
    ones, twos = a ^ b ^ c, (a & b) | (c & (a | b))
    carry = counters[0] & ones
    counters[0] ^= ones
    for i in range(1, len(counters)):
        x = counters[i]
        counters[i], carry, twos = x ^ carry ^ twos, (x & carry) | (twos & (x | carry)), np.zeros(1, U64)
    over |= carry | twos


def within(planes: np.ndarray, word: np.ndarray, lag: np.ndarray, mask: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of ``mask`` (one word of pairs i, i + lag each) that differ in at most ``radius`` bits."""
    bits = (radius + 1).bit_length()
    start = 2 ** bits - 1 - radius
    out = np.zeros(len(word), dtype=U64)
    live, alive = np.arange(len(word)), mask.copy()
    jump, shift = word + lag // 64, (lag % 64).astype(U64)
    full = ~U64(0)
    counters = [np.full(len(word), full if start >> i & 1 else U64(0)) for i in range(bits)]
    over = np.zeros(len(word), dtype=U64)
    last = planes.shape[1] - 1
    for plane in range(0, 66, 3):
        diff = []
        for p in planes[plane:min(plane + 3, 64)]:
            later = (p[jump] >> shift) | ((p[np.minimum(jump + 1, last)] << U64(1)) << (U64(63) - shift))
            diff.append(p[word] ^ later)
        while len(diff) < 3:
            diff.append(np.zeros(1, U64))
        _carry_save(counters, over, *diff)
        alive &= ~over
        keep = alive != 0
        if 4 * np.count_nonzero(keep) <= 3 * len(keep):  # abandon the blocks with no pair left
            live, alive, over = live[keep], alive[keep], over[keep]
            word, jump, shift = word[keep], jump[keep], shift[keep]
            counters = [c[keep] for c in counters]
            if not len(live):
                break
    out[live] = alive
    return out


def links(cell: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the nodes of equal cells (in different sides where the
    side is not -1) within the radius: a forest, not all pairs."""
    planes = bit_planes(fp)
    names, at = np.unique(node, return_inverse=True)
    up = np.arange(len(names))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    edges = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1, append=cell[-1] + 1)) if len(cell) else np.zeros(1, int)
    longest = int(np.diff(edges).max(initial=0))
    width = (planes.shape[1]) * 64
    pad = lambda x, fill: np.concatenate([x, np.full(2 * width - len(x), fill, dtype=x.dtype)])
    cells, sides = pad(cell, -1), pad(side, -1)
    label = pad(at, -1)
    out, lag = [], 1
    while lag < longest:
        many = min(longest - lag, max(1, LANES // width))
        lags = np.arange(lag, lag + many)
        other = lags[:, None] + np.arange(width)[None, :]
        ok = (cells[:width] == cells[other]) & (cells[:width] >= 0) & (label[:width] != label[other])
        ok &= (sides[:width] < 0) | (sides[:width] != sides[other])
        mask = np.packbits(ok, axis=1, bitorder="little").view("<u8")
        row, word = np.nonzero(mask)
        if len(row):
            hit = within(planes, word, lags[row], mask[row, word], radius)
            some = np.flatnonzero(hit)
            lanes = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(lanes)
            i = word[some[r]] * 64 + lane
            for x, y in zip(at[i].tolist(), at[i + lags[row[some[r]]]].tolist()):
                a, b = root(x), root(y)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((int(names[x]), int(names[y])))
            if len(i):
                while True:  # every node to its root
                    flat = up[up]
                    if (flat == up).all():
                        break
                    up = flat
                label = pad(up[at], -1)
        lag += many
    return out


def _linker(radius: int):
    """Links of whole cells; rows come sorted by cell, a cell may span batches."""
    def run(batches):
        def solved(rows):
            key, bi, bj, blk, fp, rep = rows
            cell = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)]))
            side = np.where(bi == bj, -1, (blk == bj).astype(np.int64))
            pairs = links(cell, side, fp.view(U64), rep, radius)
            a, b = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            while held is not None and len(held[0]) >= CHUNK:
                new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
                if not len(new):
                    break
                cut = int(new[max(0, np.searchsorted(new, CHUNK, "right") - 1)])
                yield solved([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield solved(held)
    return run


def bucket_keys(radius: int):
    """For every pair of radius + 2 segments of column ``fp``: pair number and the pair's bits as one long."""
    size, more = divmod(64, radius + 2)
    widths = [size + (i < more) for i in range(radius + 2)]
    begins = np.concatenate([[0], np.cumsum(widths)]).tolist()

    def segment(i):
        return F.shiftrightunsigned("fp", begins[i]).bitwiseAND(F.lit((1 << widths[i]) - 1))
    return [F.struct(F.lit(t).alias("t"), F.shiftleft(segment(i), widths[j]).bitwiseOR(segment(j)).alias("k"))
            for t, (i, j) in enumerate(combinations(range(radius + 2), 2))]


def near_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 4,
                      radius: int = 4) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits) and
    ``component_id`` (smallest id reachable over links of at most ``radius`` bits)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    prints = materialize(docs.mapInArrow(_fingerprints(k), "id bigint, fp bigint"), "sh-prints")
    real = prints.where("id is not null")
    classes = materialize(real.groupBy("fp").agg(F.min("id").alias("rep")), "sh-classes")
    keyed = classes.select("fp", "rep", F.explode(F.array(*bucket_keys(radius))).alias("x")).select(
        F.xxhash64("x.t", "x.k").alias("key"), "fp", "rep")
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(
        "key", F.ceil(F.col("c") / BLOCK).cast("int").alias("nb"))
    cells = (keyed.join(shared, "key").withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "fp", "rep")
             .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj"))
    near = cells.mapInArrow(_linker(radius), "a bigint, b bigint")
    repeated = (real.join(real.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x < y"), "id", "left_semi")
                .join(classes, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    labels = connected_components(materialize(near.union(repeated), "sh-links"))
    group = (classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
             .select("fp", F.coalesce("label", "rep").alias("component")))
    return (prints.join(group, "fp", "left")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id")))
