"""MinHash near-duplicate groups: bands, odd sketches, exact verification.

Method: k-word shingle sets; ``perms`` MinHash samples a document; bands of
``rows`` samples (tuned so that a pair at the threshold is missed with
probability below ``miss``); the samples also fold into a parity bitmap (odd
sketch) whose XOR population count estimates high similarities and screens
banded candidates; the rest is confirmed on full shingle sets.

Equal sets collapse to one representative first.  In a bucket every member is
compared with the bucket's smallest id; only buckets whose members are then
still in different components are compared block against block, inside tasks,
on full sets, and emit at most one link for two components.

Defined results: null text = empty; no words = empty set, linked with nothing;
rows with a null id keep ``component_id`` null and ``kept`` true; rows that
share an id are one node; other columns of the input are ignored."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.filters import bitmap, keys_of, marked
from riskflow.llm.graph import connected_components
from riskflow.llm.textcore import SPACE_WORDS, U64, Words, mix, ranges, shingles, signed, slices, utf8
from riskflow.session import materialize

PERMS = 128
SKETCH_BITS = 512
BLOCK = 1024  # members of one block in the bucket comparison ..
BLOCK_SHINGLES = 2_000_000  # .. and the shingles of them all


def tune_bands(threshold: float, perms: int = PERMS, miss: float = 1e-6) -> tuple[int, int]:
    """(rows, bands): the most selective banding of ``perms`` samples that
    misses a pair at ``threshold`` with probability at most ``miss``."""
    best = (1, perms)
    for rows in range(1, perms + 1):
        bands = perms // rows
        if (1 - threshold ** rows) ** bands <= miss:
            best = (rows, bands)
    return best


def _params(perms: int) -> tuple[np.ndarray, np.ndarray]:
    seq = mix(np.arange(1, 2 * perms + 1, dtype=U64) * U64(0x2545F4914F6CDD1D))
    return seq[:perms] | U64(1), seq[perms:]


def minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``len(a)`` MinHash samples of a non-empty set of hashes."""
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=U64)
    for lo in range(0, len(s), 4096):
        part = s[lo:lo + 4096]
        np.minimum(out, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=out)
    return out


def odd_sketch(mins: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of the samples as longs: bit hash(i, min_i) is toggled for each i."""
    at = mix(mins + np.arange(len(mins), dtype=U64) * U64(0xC2B2AE3D27D4EB4F)) % U64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def estimate(distance, perms: int = PERMS, bits: int = SKETCH_BITS):
    """Similarity that the population count of two XORed sketches stands for."""
    inside = np.maximum(1 - 2 * np.asarray(distance, dtype=float) / bits, 1e-9)
    return 1 + bits / (4 * perms) * np.log(inside)


def max_distance(threshold: float, perms: int = PERMS, bits: int = SKETCH_BITS) -> int:
    """Population count that a pair at ``threshold`` exceeds with probability
    below about 1e-9 (six standard deviations of the samples and of the folding)."""
    differ = perms * (1 - threshold)
    differ += 6 * np.sqrt(perms * threshold * (1 - threshold)) + 1
    toggles = 2 * differ
    mean = bits / 2 * (1 - np.exp(-2 * toggles / bits))
    return int(np.ceil(mean + 6 * np.sqrt(bits) / 4))


def _sets(data, off, k):
    """Distinct sorted shingle hashes of each text of a run."""
    for lo, hi in slices(off):
        w = Words(data, off[lo:hi + 1], SPACE_WORDS)
        for i in range(hi - lo):
            yield np.unique(shingles(w.hash[w.first[i]:w.first[i + 1]], k))


def _signer(k: int, perms: int, rows: int, bands: int):
    a, b = _params(perms)
    fold = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
    salt = mix(np.arange(101, 101 + bands, dtype=U64))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            n, h1, h2, sk, bd = [], [], [], [], []
            for s in _sets(*utf8(batch.column(1)), k):
                n.append(len(s))
                if len(s) == 0:
                    h1.append(0), h2.append(0), sk.append(np.zeros(0, np.int64)), bd.append(np.zeros(0, np.int64))
                    continue
                h1.append(int(signed(np.bitwise_xor.reduce(mix(s))[None])[0]))
                h2.append(int(signed(mix(s + U64(0x1234567)).sum(dtype=U64)[None])[0]))
                m = minhash(s, a, b)
                sk.append(odd_sketch(m))
                keys = (m[:rows * bands].reshape(bands, rows) * fold).sum(axis=1, dtype=U64)
                bd.append(signed(mix(keys + salt)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(sk, pa.list_(pa.int64())), pa.array(bd, pa.list_(pa.int64()))],
                names=["id", "n", "h1", "h2", "sketch", "bands"])
    return run


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, s): shingle sets of the documents in ``ids`` (and of the few that
    share a bit with one), made in the scan without moving texts."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(marked(sent.value, keys_of(batch.column(0)))))
            sets = [s.tobytes() for s in _sets(*utf8(batch.column(1)), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    return materialize(docs.where("id is not null").mapInArrow(run, "id bigint, s binary"), "nd-sets")


def _verifier(num: int, den: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                p = np.frombuffer(x.as_buffer(), dtype=U64)
                q = np.frombuffer(y.as_buffer(), dtype=U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(ok, pa.bool_()))
    return run


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold."""
    full = (pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"))
    return full.mapInArrow(_verifier(num, den), "a bigint, b bigint")


def _cross(num: int, den: int):
    """Links between different components in one cell of a bucket's block
    grid, by exact set sizes: members outside the cell's commonest component
    count their shared shingles with all others through an inverted list.  At
    most one link a pair of components is emitted."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(key[1]), int(key[2])
        sets = [np.frombuffer(s, dtype=U64) for s in pdf["s"]]
        rep, label, blk = (pdf[c].to_numpy().copy() for c in ("rep", "label", "blk"))
        lens = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        same = np.concatenate([[False], flat[order][1:] == flat[order][:-1]])
        group = np.cumsum(~same) - 1
        begin = np.flatnonzero(~same)
        size = np.diff(begin, append=len(flat))
        owner = np.repeat(np.arange(len(sets)), lens)[order]
        of = np.empty(len(flat), dtype=np.int64)
        of[order] = group
        ends = np.cumsum(lens)
        names, counts = np.unique(label, return_counts=True)
        out = []
        for x in np.flatnonzero(label != names[counts.argmax()]):
            other = (label != label[x]) & (True if bi == bj else blk != blk[x])
            if not other.any():
                continue
            g = of[ends[x] - lens[x]:ends[x]]
            both = np.bincount(owner[ranges(begin[g], size[g])], minlength=len(sets))
            for y in np.flatnonzero(other & (den * both >= num * (lens[x] + lens - both))):
                if label[y] != label[x]:
                    out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
                    label[label == label[y]] = label[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _distance(x: str, y: str, bits: int = SKETCH_BITS):
    """Population count of the XOR of two sketch columns."""
    return F.expr(" + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(bits // 64)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5,
                    num: int = 80, den: int = 100, perms: int = PERMS, miss: float = 1e-6) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id
    reachable over links ``den * |A n B| >= num * |A u B|``), ``kept``."""
    threshold = num / den
    rows, bands = tune_bands(threshold, perms, miss)
    limit = max_distance(threshold, perms)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    sig = materialize(docs.mapInArrow(
        _signer(k, perms, rows, bands),
        "id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>, bands array<bigint>"), "nd-sig")
    real = sig.where("n > 0 and id is not null")
    classes = materialize(real.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "nd-classes")
    one = classes.select(F.col("rep").alias("id"), "h1", "h2", "n")
    reps = materialize(
        real.join(one, ["id", "h1", "h2", "n"]).dropDuplicates(["id", "h1", "h2"])
        .select(F.col("id").alias("rep"), "n", "sketch", "bands"), "nd-reps")
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("c")).where("c > 1")
    members = materialize(keyed.join(shared, "key").select("key", "center", "c", "rep"), "nd-members")
    light = reps.select("rep", "n", "sketch")
    sets = _sets_of(docs, members.select("rep").distinct(), k)
    star = members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    star = (star.join(light.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka")), "a")
            .join(light.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb")), "b")
            .where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)"))
    star = materialize(star.where(_distance("ka", "kb") <= limit).select("a", "b").distinct(), "nd-star")
    twice = real.join(classes, ["h1", "h2", "n"]).select("id", "rep")
    repeated = twice.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y")
    same_id = twice.join(repeated.select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = materialize(_verify(star, sets, num, den).union(same_id), "nd-all-links")
    labels = connected_components(links)
    # buckets whose members are still apart: block against block on full sets
    apart = (members.where("c > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("label", F.coalesce("label", "rep")).join(light.select("rep", "n"), "rep"))
    mixed = (apart.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c"),
                                      F.sum("n").alias("total"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("who"))
             .where("x <> y").groupBy("c", "total", "who").agg(F.min("key").alias("key")))  # equal buckets count once
    mixed = mixed.select("key", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    rest = materialize(apart.select("key", "rep", "label").join(mixed, "key"), "nd-rest")
    if not rest.isEmpty():
        cells = (rest.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
                 .select("key", "rep", "label", "blk", F.least("blk", "other").alias("bi"),
                         F.greatest("blk", "other").alias("bj"))
                 .join(sets.withColumnRenamed("id", "rep"), "rep"))
        more = materialize(cells.groupBy("key", "bi", "bj").applyInPandas(_cross(num, den), "a bigint, b bigint"), "nd-cross")
        labels = connected_components(links.union(more))
    rep_label = (classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("h1", "h2", "n", F.coalesce("label", "rep").alias("component")))
    out = sig.select("id", "h1", "h2", "n").join(rep_label, ["h1", "h2", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    own = F.when(F.col("id").isNotNull(), own)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
