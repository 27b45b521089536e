"""Centroid clustering: exact nearest centroids by the threshold algorithm.

Vectors become integers floor(scale * x).  Each dimension keeps its centroids
in a sorted list.  From a vector's value the list is walked outward, one
centroid a step in every dimension at once; a centroid met for the first time
gets its exact distance.  A centroid not met yet stands at or beyond the
frontier in every dimension, so once the sum of the frontier's squared
distances strictly exceeds the best exact distance no other can win or tie,
and the walk stops.  Tasks walk all vectors of a batch together.

Every round sends one partial sum a task, cluster, dimension and 32-bit limb;
what reaches the driver is the new centroids (k x dimensions numbers).

Defined results: vectors that are null, of another length, or hold a null, NaN
or infinite component take no part and have no row; rows that share an id are
separate vectors (as starting centroids in the order of their components); a
row with a null id is clustered but never a starting centroid; with fewer than
k vectors with an id there are as many centroids as those; without any, no row;
distances and inertias beyond a long saturate; sums are exact at any size;
other columns of the input are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.session import materialize

LIMB = 32  # bits of one limb of a partial sum
SCORED = 1 << 20  # components of exact distances computed at a time
_LONG = 2 ** 63 - 1


def _narrow(top: float, dims: int) -> bool:
    """Whether squared distances of components up to ``top`` fit in 64 bits."""
    return top < 2 ** 28 / max(1, dims) ** 0.5


def floored(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exact: int64 while distances fit, else Python ints."""
    if _narrow(float(np.abs(rows).max(initial=0)) * abs(scale), rows.shape[1]):
        return np.floor(rows * scale).astype(np.int64)

    def whole(x: float) -> int:
        num, den = float(x).as_integer_ratio()
        return num * scale // den
    return np.vectorize(whole, otypes=[object])(rows)


class Lists:
    """The centroids' values of every dimension in ascending order."""

    def __init__(self, centroids: list[list[int]]):
        top = max((abs(v) for c in centroids for v in c), default=0)
        kind = np.int64 if _narrow(top, len(centroids[0])) else object
        self.points = np.array(centroids, dtype=kind).reshape(len(centroids), -1)
        self.order = np.argsort(self.points, axis=0, kind="stable").T  # (dims, k)
        self.values = np.take_along_axis(self.points, self.order.T, axis=0).T

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of integers; ties to the smaller number."""
        points, values = self.points, self.values
        if x.dtype == object or points.dtype == object:
            x, points, values = x.astype(object), points.astype(object), values.astype(object)
        n, dims, k = len(x), x.shape[1], len(points)
        kind = x.dtype
        best = np.full(n, -1, dtype=np.int64)
        dist = np.zeros(n, dtype=kind)
        exact = np.zeros((n, k), dtype=kind)
        seen = np.zeros((n, k), dtype=bool)
        after = np.stack([np.searchsorted(values[d], x[:, d]) for d in range(dims)], axis=1) if dims else np.zeros((n, 0), int)
        before = after - 1
        dim = np.arange(dims)[None, :]
        rows = np.arange(n)
        for step in range(k):
            v = x[rows]
            lo, hi = before[rows], after[rows]
            down = v - values[dim, np.maximum(lo, 0)]
            up = values[dim, np.minimum(hi, k - 1)] - v
            go_up = (lo < 0) | ((hi < k) & (up < down))
            at = self.order[dim, np.where(go_up, hi, lo)]
            gap = np.where(go_up, up, down)
            before[rows] = lo - ~go_up
            after[rows] = hi + go_up
            met = np.zeros((len(rows), k), dtype=bool)
            met[np.arange(len(rows))[:, None], at] = True
            if not dims:
                met[:] = True
            r, c = np.nonzero(met & ~seen[rows])
            for lo_ in range(0, len(r), max(1, SCORED // max(1, dims))):
                part = slice(lo_, lo_ + max(1, SCORED // max(1, dims)))
                diff = v[r[part]] - points[c[part]]
                exact[rows[r[part]], c[part]] = (diff * diff).sum(axis=1)
            seen[rows] |= met
            far = int(max(exact[rows].max(initial=0), 0)) + 1
            scored = np.where(seen[rows], exact[rows], far)
            best[rows] = scored.argmin(axis=1)
            dist[rows] = scored.min(axis=1)
            open_ = ~((gap * gap).sum(axis=1) > dist[rows]) & ~seen[rows].all(axis=1)
            rows = rows[open_]
            if not len(rows):
                break
        return best, dist


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("v"))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), dims)


def _partial_sums(lists: Lists, scale: int, dims: int):
    """One task's sums as limbs: (cluster, dim, limb, value); dim -1 holds the count."""
    def run(batches):
        k = len(lists.points)
        count = np.zeros(k, dtype=np.int64)
        total = np.zeros((k, dims), dtype=object)
        for batch in batches:
            x = floored(_rows(batch, dims), scale)
            own, _ = lists.nearest(x)
            order = np.argsort(own, kind="stable")
            names, begin = np.unique(own[order], return_index=True)
            if len(names):
                total[names] += np.add.reduceat(x[order], begin, axis=0).astype(object)
                count += np.bincount(own, minlength=k)
        out = [(c, -1, 0, int(count[c])) for c in range(k) if count[c]]
        for c, d in zip(*np.nonzero(total)):
            left, sign, limb = abs(int(total[c, d])), 1 if total[c, d] > 0 else -1, 0
            while left:
                out.append((int(c), int(d), limb, sign * (left & ((1 << LIMB) - 1))))
                left, limb = left >> LIMB, limb + 1
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(
            cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["c", "d", "limb", "s"])
    return run


def _assigner(lists: Lists, scale: int, dims: int):
    def run(batches):
        for batch in batches:
            own, dist = lists.nearest(floored(_rows(batch, dims), scale))
            exact = pa.array([min(int(x), _LONG) for x in dist], pa.int64()) if dist.dtype == object else pa.array(dist)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own.astype(np.int32)), exact], names=["id", "cluster", "distance"])
    return run


def centroid_digest(components) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in components).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector that takes part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = (vectors.where(v.isNotNull() & (F.size(v) == dims)).where(~bad)
            .select(F.col(id_col).cast("long").alias("id"), v.alias("v")))
    token = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = kept.where("id is not null").orderBy(token, "v").limit(k).collect()  # k rows
    centroids = [floored(np.array([r["v"]], dtype=np.float64).reshape(1, dims), scale)[0].tolist() for r in starts]
    result = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("cluster", T.IntegerType())] + [
        T.StructField(n, T.LongType()) for n in ("distance", "cluster_inertia", "inertia")] + [
        T.StructField("centroid_sha256", T.StringType())])
    spark = vectors.sparkSession
    if not centroids:
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        sums = (kept.mapInArrow(_partial_sums(Lists(centroids), scale, dims), "c int, d int, limb int, s bigint")
                .groupBy("c", "d", "limb").agg(F.sum("s").alias("s")).collect())  # k x dims x limbs rows
        count, total = {}, {}
        for r in sums:
            if r["d"] < 0:
                count[r["c"]] = r["s"]
            else:
                total[r["c"], r["d"]] = total.get((r["c"], r["d"]), 0) + (r["s"] << LIMB * r["limb"])
        centroids = [[total.get((c, d), 0) // count[c] for d in range(dims)] if c in count else old
                     for c, old in enumerate(centroids)]
    own = materialize(kept.mapInArrow(_assigner(Lists(centroids), scale, dims),
                                      "id bigint, cluster int, distance bigint"), "kc-own")
    per = own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()  # k rows
    whole = min(sum(int(r["part"]) for r in per), _LONG)
    facts = spark.createDataFrame(
        [(r["cluster"], min(int(r["part"]), _LONG), whole, centroid_digest(centroids[r["cluster"]])) for r in per],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return (own.join(F.broadcast(facts), "cluster")  # at most k rows
            .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
