"""Vector similarity: top-k cosine search, thresholded search, k-NN distance
(JN-6, RT-3, RT-4, RT-5, OD-4, H4).

Library and queries are sorted by their nearest pivot and packed into rows of
bounded size.  Packs meet in a plain cross join, which replicates nothing on disk;
a task holds one query pack and one range of the library, keeps the k best rows of
each query as it goes and skips blocks that the triangle inequality rules out
against the query's k-th best so far.  A window over what the tasks kept (at most k
rows a query and range) gives the global top-k.  Shuffles grow with the rows, not
with their pairs; nothing that grows with the data is broadcast or collected.

A vector is kept as its entries other than 0 where that is shorter.  Queries that
are sparse are scored in the dimensions that their pack uses only, and a library
row is scored against the queries for which the largest and smallest entries of a
few alike queries let it be good enough.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.quantiles import quantile_values
from riskflow.session import materialize

# Fixed values that must equal the reference's defaults: similarity floor and
# display range of the rescale, band edges, over-fetch rule.
DEFAULT_MIN_COS = 0.50
DEFAULT_LOW, DEFAULT_HIGH = 0.55, 0.85
BAND_EDGES = [(0.75, "Strongest match"), (0.50, "Strong match"), (0.25, "Moderate match")]
WEAK_BAND = "Weak match"

_OUT_SCHEMA = "qid long, pid long, cos double"
_OUT_ARROW = pa.schema([("qid", pa.int64()), ("pid", pa.int64()), ("cos", pa.float64())])
_SLACK = 1e-9  # rounding room of the bounds
_NO_ID = np.iinfo(np.int64).min  # stands for a null id
_PACK_VALUES = 1 << 20  # numbers stored in a pack: 8 MB
_PACK_CELLS = 1 << 24  # rows of a pack times their dimensions
_RANGES = 16  # library ranges that a query pack meets, a task each
_ALIKE = 8  # queries that share a bound
_PART_ROWS = 256  # queries that rows are scored against together
_ROW_ARROW = pa.schema([("id", pa.int64()), ("idx", pa.binary()), ("val", pa.binary()), ("n", pa.int32()),
                        ("block", pa.int64()), ("d", pa.float64())])
_ROW_SCHEMA = "id long, idx binary, val binary, n int, block long, d double"
_PACK_FIELDS = ("ids", "own", "far", "lens", "idx", "vecs")


def _normalise(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / (n + 1e-9)


def first_k(sims: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's ``k`` largest finite entries, ties to the first."""
    kk = min(k, sims.shape[1])
    kth = np.partition(sims, sims.shape[1] - kk, axis=1)[:, sims.shape[1] - kk, None]
    above, tied = sims > kth, sims == kth
    keep = above | (tied & (np.cumsum(tied, axis=1) <= kk - above.sum(axis=1, keepdims=True)))
    return keep & np.isfinite(sims)


def may_hold(distance: np.ndarray, radius: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """(queries x blocks): whether a block can hold a row with a cosine of
    ``floor`` or more, by the triangle inequality: no row of the block is nearer
    than the pivot's distance less the block's radius, and the cosine of
    vectors of length up to one is at most 1 - distance^2 / 2."""
    nearest = np.maximum(distance - radius[None, :], 0.0)
    return 1.0 - nearest * nearest / 2 >= floor[:, None] - _SLACK


def _distances(m: np.ndarray, pivots: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """Distances to the pivots; of ``m`` only ``columns`` are given, all others are 0."""
    dot = m @ (pivots if columns is None else pivots[:, columns]).T
    return np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * dot, 0.0))


def _kind(dims: int):
    return np.uint16 if dims <= 1 << 16 else np.uint32


def _spread(n: int, sizes: np.ndarray, idx: np.ndarray, whole: np.ndarray, val: np.ndarray, dims: int, columns: np.ndarray | None = None) -> np.ndarray:
    """Stored entries, ``sizes`` of them a row, as a matrix of ``columns`` (all of
    them by default); rows that are ``whole`` store every dimension and no places."""
    if whole.all():
        m = val.reshape(n, dims)
        return m if columns is None else m[:, columns]
    if whole.any():
        at = np.repeat(whole, sizes)
        every = np.empty(len(val), np.int64)
        every[at], every[~at] = np.tile(np.arange(dims), int(whole.sum())), idx
        idx = every
    width = dims
    if columns is not None:
        width = len(columns) + 1  # the last for all other dimensions
        place = np.full(dims, width - 1)
        place[columns] = np.arange(width - 1)
        idx = place[idx]
    m = np.zeros(n * width)
    m[np.repeat(np.arange(n) * width, sizes) + idx] = val
    m = m.reshape(n, width)
    return m if columns is None else m[:, :-1]


def _listed(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """Columns ``idx`` (null for vectors given whole) and ``val`` of lists as a matrix."""
    idx, val = batch.column("idx"), batch.column("val")
    whole = idx.is_null().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(val).to_numpy(zero_copy_only=False)
    places = idx.flatten().to_numpy(zero_copy_only=False)
    if val.null_count or (sizes[whole] != dims).any() or (places >= dims).any():
        raise ValueError(f"vectors must not be null and must have {dims} dimensions")
    return _spread(batch.num_rows, sizes, places, whole, val.flatten().to_numpy(zero_copy_only=False).astype(np.float64), dims)


def _binary(sizes: np.ndarray, flat: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes) * flat.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def _assigned(pivots: np.ndarray):
    """Rows as unit vectors with their nearest pivot and its distance.  A vector's
    entries other than 0 are kept with their places, or all of them if that is shorter;
    one that is no number keeps one such entry, in the first dimension."""
    dims = pivots.shape[1]
    step = max(1, (1 << 20) // dims)

    def fn(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                b = batch.slice(lo, step)
                m = _normalise(_listed(b, dims))
                d = _distances(m, pivots)
                own = d.argmin(axis=1)
                bad = np.isnan(m).any(axis=1)
                if bad.any():
                    m[bad], m[bad, 0] = 0.0, np.nan
                kept = m != 0
                whole = kept.sum(axis=1) * 3 > dims * 2
                places = np.nonzero(kept & ~whole[:, None])[1].astype(_kind(dims))
                sizes = np.where(whole, dims, kept.sum(axis=1))
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), _binary(np.where(whole, 0, sizes), places), _binary(sizes, m[kept | whole[:, None]]),
                    pa.array(sizes.astype(np.int32)), pa.array(own.astype(np.int64)), pa.array(d[np.arange(len(m)), own])], schema=_ROW_ARROW)
    return fn


def _packed(prefix: str, rows: int, size: int):
    """Rows of one partition, in its order, as rows of at most ``rows`` vectors with
    ``size`` stored numbers: flat arrays as bytes.  A null id is kept as ``_NO_ID``."""
    schema = pa.schema([(prefix + f, pa.binary()) for f in _PACK_FIELDS])

    def pack(held: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        n = t["n"].to_numpy()
        whole = pc.binary_length(t["idx"]).to_numpy() == 0
        fields = (pc.fill_null(t["id"], int(_NO_ID)).to_numpy().astype(np.int64).tobytes(), t["block"].to_numpy().astype(np.int64).tobytes(),
                  t["d"].to_numpy().astype(np.float64).tobytes(), np.where(whole & (n > 0), -1, n).astype(np.int32).tobytes(),
                  b"".join(t["idx"].to_pylist()), b"".join(t["val"].to_pylist()))
        return pa.RecordBatch.from_arrays([pa.array([f], pa.binary()) for f in fields], schema=schema)

    def fn(batches):
        held, count, load = [], 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            lo = 0
            while lo < len(n):
                fit = min(int(np.searchsorted(np.cumsum(n[lo:]) + load, size, side="right")), rows - count)
                if not fit and held:
                    yield pack(held)
                    held, count, load = [], 0, 0
                    continue
                held.append(batch.slice(lo, max(1, fit)))
                count, load, lo = count + len(held[-1]), load + int(n[lo:lo + max(1, fit)].sum()), lo + max(1, fit)
        if held:
            yield pack(held)
    return fn


def _unpacked(r: dict, prefix: str, dims: int, columns: np.ndarray | None = None):
    """Ids, pivots, distances and vectors (of ``columns``) of a pack."""
    ids, own, far, lens, idx, val = (np.frombuffer(r[prefix + f], kind) for f, kind in
                                     zip(_PACK_FIELDS, (np.int64, np.int64, np.float64, np.int32, _kind(dims), np.float64)))
    whole = lens < 0
    return ids, own, far, _spread(len(ids), np.where(whole, dims, lens), idx, whole, val, dims, columns)


def _used(r: dict, prefix: str, dims: int) -> np.ndarray | None:
    """Dimensions that a pack's vectors use, and the first; None for all of them."""
    if (np.frombuffer(r[prefix + "lens"], np.int32) < 0).any():
        return None
    seen = np.zeros(dims, bool)
    seen[0] = seen[np.frombuffer(r[prefix + "idx"], _kind(dims))] = True
    return None if seen.all() else np.flatnonzero(seen)


def _alike(vecs: np.ndarray) -> np.ndarray:
    """An order in which vectors with the same entries other than 0 stand together,
    entries of many vectors first."""
    kept = vecs != 0
    bits = np.packbits(kept[:, np.argsort(-kept.sum(axis=0), kind="stable")], axis=1)
    words = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(">u8")
    return np.lexsort(words.T[::-1])


def _cuts(own: np.ndarray, most: int) -> np.ndarray:
    """Edges of the blocks of a pack: runs of one pivot, at most ``most`` rows each."""
    runs = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
    return np.unique(np.concatenate([runs, *[np.arange(lo, hi, most) for lo, hi in zip(runs, runs[1:])]]))


class _Best:
    """The k best rows of each query of one pack (cosine, ties by library id).  With
    ``columns``, only these dimensions of the queries and the library are given."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, pivots: np.ndarray, k: int, exclude_self: bool, min_cos: float | None,
                 columns: np.ndarray | None = None):
        self.groups = columns is not None
        if self.groups:
            order = _alike(vecs)
            ids, vecs = ids[order], vecs[order]
        self.ids, self.vecs, self.small = ids, vecs, vecs.astype(np.float32)
        if self.groups:
            first = np.arange(0, len(ids), _ALIKE)
            self.high, self.low = np.fmax.reduceat(self.small, first), np.fmin.reduceat(self.small, first)
            self.length = np.maximum(1.0, np.linalg.norm(np.maximum(abs(self.high), abs(self.low)), axis=1))
        self.to_pivot = _distances(vecs, pivots, columns)
        self.k, self.exclude_self = k, exclude_self
        self.least = -np.inf if min_cos is None else min_cos
        self.cos = np.full((len(ids), k), -np.inf)
        self.pid = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.slack = (vecs.shape[1] + 8) * 1.2e-7  # more than single precision can err on unit vectors

    def meet(self, pids: np.ndarray, own: np.ndarray, far: np.ndarray, vecs: np.ndarray, q_rows: int, p_rows: int) -> None:
        """All queries against a library pack, ``q_rows`` queries at a time."""
        if self.groups:
            return self._meet_alike(pids, vecs)
        edges = _cuts(own, p_rows)
        pivot, radius = own[edges[:-1]], np.fmax.reduceat(far, edges[:-1]) + _SLACK
        small = vecs.astype(np.float32)
        for s in range(0, len(self.ids), q_rows):
            part = slice(s, min(s + q_rows, len(self.ids)))
            d = self.to_pivot[part][:, pivot]
            order = np.argsort(d.mean(axis=0), kind="stable")
            step = max(1, 2_000_000 // (part.stop - part.start))  # bounds the scores in memory
            done = 0
            while done < len(order):  # nearest blocks first; the k-th best so far rules out others
                floor = np.maximum(self.cos[part, -1], max(self.least, -2.0))
                rest = order[done:]
                rest = rest[may_hold(d[:, rest], radius[rest], floor).any(axis=0)]
                if not len(rest):
                    break
                order = np.concatenate([order[:done], rest])
                most = min(step, 4096) if np.isneginf(self.cos[part, -1]).any() else step  # a first floor soon
                take = max(1, int(np.searchsorted(np.cumsum(edges[rest + 1] - edges[rest]), most, side="right")))
                rows = np.concatenate([np.arange(edges[b], edges[b + 1]) for b in np.sort(rest[:take])])
                for lo in range(0, len(rows), step):
                    self._score(part, rows[lo:lo + step], pids, vecs, small)
                done += take

    def _meet_alike(self, pids: np.ndarray, vecs: np.ndarray) -> None:
        """``meet`` by bounds of groups of alike queries: no cosine of a group is above
        the row's product with the group's largest entries, and for negative entries of
        the row with its smallest.  Rows of the highest bounds come first."""
        small = vecs.astype(np.float32)
        known = np.flatnonzero(~np.isnan(small[:, 0]))  # the others meet nothing
        signed = bool((small < 0).any())
        step = max(1, 8_000_000 // len(self.high))  # bounds the bounds in memory
        for lo in range(0, len(known), step):
            rows = known[lo:lo + step]
            at = small if len(rows) == len(small) else small[rows]
            bound = self.high @ np.maximum(at, 0).T + self.low @ np.minimum(at, 0).T if signed else self.high @ at.T
            edges = np.unique(np.linspace(0, len(rows), max(4, self.k) + 1).astype(int))
            tops = np.stack([a + bound[:, a:b].argmax(axis=1) for a, b in zip(edges, edges[1:])], axis=1)
            for s in range(0, len(self.ids), _PART_ROWS):
                part = slice(s, min(s + _PART_ROWS, len(self.ids)))
                group = slice(part.start // _ALIKE, -(-part.stop // _ALIKE))
                reached = self._reached(part, group, bound[group])
                first = np.unique(tops[group])
                if reached.sum() > 2 * len(first):
                    self._score(part, rows[first], pids, vecs, small)
                    reached = self._reached(part, group, bound[group])
                    reached[first] = False
                some = rows[reached]
                for at_ in range(0, len(some), 2_000_000 // _PART_ROWS):
                    self._score(part, some[at_:at_ + 2_000_000 // _PART_ROWS], pids, vecs, small)

    def _reached(self, part: slice, group: slice, bound: np.ndarray) -> np.ndarray:
        """Mask of the rows that may be good enough for a query of ``part``."""
        floor = np.minimum.reduceat(np.maximum(self.cos[part, -1], self.least), np.arange(0, part.stop - part.start, _ALIKE))
        return (bound >= (floor - self.slack * self.length[group]).astype(np.float32)[:, None]).any(axis=0)

    def _score(self, part: slice, rows: np.ndarray, pids: np.ndarray, vecs: np.ndarray, small: np.ndarray) -> None:
        sims = self.small[part] @ (small if len(rows) == len(small) else small[rows]).T
        if np.isnan(sims).any():  # vectors that are no numbers meet nothing
            sims[np.isnan(sims)] = -np.inf
        if self.exclude_self:
            q = self.ids[part]
            if np.isin(q, pids[rows]).any():
                sims[(q[:, None] == pids[rows][None, :]) & (q != _NO_ID)[:, None]] = -np.inf
        floor = np.maximum(self.cos[part, -1], self.least)
        open_ = np.flatnonzero(np.isneginf(self.cos[part, -1]))
        if len(open_) and sims.shape[1] > self.k:  # no k rows yet: the k-th of these scores
            kth = np.partition(sims[open_], sims.shape[1] - self.k, axis=1)[:, sims.shape[1] - self.k]
            floor[open_] = np.maximum(floor[open_], kth - self.slack)
        r, c = np.nonzero((sims >= (floor - self.slack).astype(np.float32)[:, None]) & (sims > -np.inf))
        step = max(1, 4_000_000 // vecs.shape[1])  # bounds the copies of candidates
        for lo in range(0, len(r), step):
            self._keep(part.start + r[lo:lo + step], rows[c[lo:lo + step]], pids, vecs)

    def _keep(self, q: np.ndarray, row: np.ndarray, pids: np.ndarray, vecs: np.ndarray) -> None:
        """Candidates scored in double precision and merged with the k best."""
        cos = np.einsum("ij,ij->i", self.vecs[q], vecs[row])
        ok = (cos >= self.least) & (cos >= self.cos[q, -1])
        q, row, cos = q[ok], row[ok], cos[ok]
        hit = np.unique(q)
        if not len(hit):
            return
        q = np.concatenate([np.repeat(hit, self.k), q])
        cos, pid = np.concatenate([self.cos[hit].ravel(), cos]), np.concatenate([self.pid[hit].ravel(), pids[row]])
        order = np.lexsort((pid, -cos, q))
        q, cos, pid = q[order], cos[order], pid[order]
        first = np.searchsorted(q, hit)
        keep = first[:, None] + np.arange(self.k)
        self.cos[hit], self.pid[hit] = cos[keep], pid[keep]

    def frame(self) -> pd.DataFrame:
        r, c = np.nonzero(np.isfinite(self.cos))
        return pd.DataFrame({"qid": self.ids[r], "pid": self.pid[r, c], "cos": self.cos[r, c]})


def _met(pivots: np.ndarray, k: int, exclude_self: bool, min_cos: float | None, q_rows: int, p_rows: int):
    """Pairs of packs -> the k best rows of each query over the library packs of
    this task; pairs of one query pack stand together."""
    dims = pivots.shape[1]

    def fn(batches):
        seen, best, columns = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_buffer() for n in batch.schema.names}
                if best is None or not all(seen[n].equals(r[n]) for n in ("q_ids", "q_idx", "q_vecs")):
                    if best is not None:
                        yield pa.RecordBatch.from_pandas(best.frame(), _OUT_ARROW, preserve_index=False)
                    columns = _used(r, "q_", dims)
                    ids, _, _, vecs = _unpacked(r, "q_", dims, columns)
                    seen, best = r, _Best(ids, vecs, pivots, k, exclude_self, min_cos, columns)
                best.meet(*_unpacked(r, "p_", dims, columns), q_rows, p_rows)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best.frame(), _OUT_ARROW, preserve_index=False)
    return fn


def top_k_cosine(queries: DataFrame, library: DataFrame, k: int, q_id: str = "vec_id",
                 q_vec: str = "embedding", p_id: str = "vec_id", p_vec: str = "embedding",
                 exclude_self: bool = False, min_cos: float | None = None,
                 q_block_rows: int = 4096, p_block_rows: int = 16384, pivots: int = 64) -> DataFrame:
    """JN-6 + RT-3: for every query, the ``k`` library rows of highest cosine
    (ties by library id), optionally ``>= min_cos`` and excluding the same id.
    Returns (qid, rank, pid, cos).  Vectors are arrays or Spark ML vectors.

    Exact: library rows belong to the nearest of ``pivots`` library rows drawn by
    hash (what the driver holds).  A block (``p_block_rows`` rows of one pivot at
    most) is scored against ``q_block_rows`` queries at a time, unless the triangle
    inequality shows that it holds nothing better than the k rows that each has.
    Queries that are sparse meet a row by bounds of groups of them instead, whatever
    the block sizes.  Scores are screened in single precision and decided in double.  Disk: queries
    and library once, then k rows a query for each of ``_RANGES`` library ranges."""
    def rows(df: DataFrame, i: str, v: str) -> DataFrame:
        if isinstance(df.schema[v].dataType, VectorUDT):
            at = F.unwrap_udt(v)
            size, idx, val = F.coalesce(at["size"], F.size(at["values"])), at["indices"], at["values"]
        else:
            val = F.col(v).cast("array<double>")
            size, idx = F.size(val), F.lit(None).cast("array<int>")
        return df.select(F.col(i).cast("long").alias("id"), idx.alias("idx"), val.alias("val"), size.alias("size"))

    p, q = rows(library, p_id, p_vec), rows(queries, q_id, q_vec)
    drawn = p.orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow()
    if not drawn.num_rows:
        return queries.sparkSession.createDataFrame([], "qid long, rank int, pid long, cos double")
    dims = drawn["size"][0].as_py() or 0
    centre = _normalise(_listed(drawn.combine_chunks().to_batches()[0], dims))
    finite = np.isfinite(centre).all(axis=1)
    centre = centre[finite] if finite.any() else np.zeros((1, dims))
    pack_rows = max(1, _PACK_CELLS // dims)

    def packs(df: DataFrame, prefix: str, name: str, most: int | None = None) -> DataFrame:
        at = materialize(df.drop("size").mapInArrow(_assigned(centre), _ROW_SCHEMA), name)
        stored, count = at.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        n = max(1, -(-stored // _PACK_VALUES), -(-count // pack_rows))
        n = n + n // 4 if most is None else min(n, most)  # ranges of rows are not of one size
        schema = ", ".join(f"{prefix}{f} binary" for f in _PACK_FIELDS)
        dealt = at.repartitionByRange(n, "block", F.xxhash64("id")).sortWithinPartitions("block", "id")
        return dealt.mapInArrow(_packed(prefix, pack_rows, _PACK_VALUES), schema).repartition(n).hint("shuffle_replicate_nl")

    pairs = packs(q, "q_", "nn-queries").crossJoin(packs(p, "p_", "nn-library", _RANGES))
    spark = queries.sparkSession
    # a row is two packs; a task's library range beyond a few packs is held where Spark can spill it
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2", "spark.sql.cartesianProductExec.buffer.in.memory.threshold": "8"}
    usual = {c: spark.conf.get(c) for c in held}
    try:
        for c, v in held.items():
            spark.conf.set(c, v)
        hits = materialize(pairs.mapInArrow(_met(centre, k, exclude_self, min_cos, q_block_rows, p_block_rows), _OUT_SCHEMA), "nn-hits")
    finally:
        for c, v in usual.items():
            spark.conf.set(c, v)
    w = Window.partitionBy("qid").orderBy(F.col("cos").desc(), F.col("pid"))
    return (hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select("qid", "rank", "pid", "cos"))


def rescale(cos, low: float = DEFAULT_LOW, high: float = DEFAULT_HIGH):
    """RT-4: clamp((cos - low) / (high - low), 0, 1); 0.5 when the span <= 0; 0 for null."""
    c = F.col(cos) if isinstance(cos, str) else cos
    span = high - low
    if span <= 0:
        return F.when(c.isNull(), F.lit(0.0)).otherwise(F.lit(0.5))
    return F.when(c.isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / span)))


def similarity_band(rescaled):
    """RT-4: band of a rescaled similarity."""
    r = F.col(rescaled) if isinstance(rescaled, str) else rescaled
    expr = None
    for edge, name in BAND_EDGES:
        expr = F.when(r >= edge, name) if expr is None else expr.when(r >= edge, name)
    return expr.otherwise(WEAK_BAND)


def search(queries: DataFrame, library: DataFrame, k: int = 3, min_cos: float = DEFAULT_MIN_COS,
           low: float = DEFAULT_LOW, high: float = DEFAULT_HIGH, **kw) -> DataFrame:
    """RT-3: top-k library matches per query at or above ``min_cos`` (the
    reference over-fetches max(2k, 6) and then filters; on a sorted list that is
    the same as top-k among those >= min_cos), with rescaled score and band."""
    hits = top_k_cosine(queries, library, k, min_cos=min_cos, **kw)
    return (hits.withColumn("similarity", rescale("cos", low, high))
                .withColumn("match_band", similarity_band("similarity")))


def knn_distance(queries: DataFrame, library: DataFrame, k: int = 5, exclude_self: bool = False,
                 **kw) -> DataFrame:
    """OD-4: mean cosine distance to the ``k`` nearest library rows (leave-one-out
    with ``exclude_self`` on the fit set)."""
    hits = top_k_cosine(queries, library, k, exclude_self=exclude_self, **kw)
    return hits.groupBy("qid").agg(F.avg(1.0 - F.col("cos")).alias("knn_distance"))


def calibrate_similarity(queries: DataFrame, library: DataFrame, k: int = 10, **kw) -> DataFrame:
    """RT-5: pool the top-``k`` cosines of in-domain probe queries; low = p10,
    high = p95, cutoff = p5 (plus the AG-21 summary of the pool)."""
    hits = materialize(top_k_cosine(queries, library, k, **kw).select("cos"), "calibration")
    c = F.col("cos")
    at = quantile_values(hits, [(c, {"calibrated_low": 0.10, "calibrated_high": 0.95, "calibrated_threshold": 0.05})])
    return hits.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"),
                    F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
                    *[F.lit(v).cast("double").alias(name) for name, v in at.items()])
