"""Exact top-k by integer inner product: term-at-a-time accumulation.

Vectors become integers floor(scale * x).  Queries and candidates are dealt to
blocks and meet in a grid of cells (every query block with every candidate
block).  In a cell each dimension is a term: its postings (rows with a
non-zero weight) are scattered, weighted by the queries' components, into a
dense score array; a partition selection keeps each query's k best of the
cell; a window over k rows a cell merges them.

Defined results: vectors that are null, empty or hold a null, NaN or infinite
component take no part; vectors of different length share their common
dimensions; ties go to the smaller id; a row never meets rows of its own id;
rows that share an id all stay candidates and, as queries, are ranked as one
list per id; scores beyond a long saturate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
STRIPE = 256  # queries of one dense score array ..
SLAB = 512  # .. and its rows that are filled at a time
_LONG = 2 ** 63 - 1


def _matrix(weights: list, dims: int) -> np.ndarray:
    """Rows of floored weights (float64 integers), zero-padded to ``dims``."""
    out = np.zeros((len(weights), dims))
    for i, w in enumerate(weights):
        out[i, :len(w)] = w
    return out


def score_cell(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(candidates x queries) integer scores, one term after the other."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.int32 if bound < 2 ** 31 else np.int64 if bound < 2 ** 62 else object
    to = (lambda m: np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object)) if kind is object else (
        lambda m: m.astype(kind))
    q, c = to(q), to(c)
    acc = np.zeros((len(c), len(q)), dtype=kind)
    for lo in range(0, len(c), SLAB):
        part, score = c[lo:lo + SLAB], acc[lo:lo + SLAB]
        term = np.empty_like(score)
        for d in range(q.shape[1]):
            if 2 * np.count_nonzero(part[:, d]) >= len(part):  # nearly every row has a posting
                np.multiply(part[:, d, None], q[None, :, d], out=term)
                np.add(score, term, out=score)
            else:
                rows = np.flatnonzero(part[:, d])
                score[rows] += part[rows, d, None] * q[None, :, d]
    return acc if kind is not object else np.clip(acc, -_LONG - 1, _LONG).astype(np.int64)


def _cell(k: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["is_query"].to_numpy()
        ids = pdf["id"].to_numpy(np.int64)
        dims = max(map(len, pdf["w"]))
        w = _matrix(pdf["w"].to_list(), dims)
        order = np.argsort(ids[~is_query], kind="stable")
        cid, c = ids[~is_query][order], w[~is_query][order]  # ascending ids: an earlier row wins a tie
        qid, q = ids[is_query], w[is_query]
        out = []
        for lo in range(0, len(q) if len(c) else 0, STRIPE):
            scores = np.ascontiguousarray(score_cell(q[lo:lo + STRIPE], c).T)
            lows = np.searchsorted(cid, qid[lo:lo + STRIPE], "left")
            highs = np.searchsorted(cid, qid[lo:lo + STRIPE], "right")
            for j in range(len(scores)):
                own = cid[lows[j]:highs[j]]  # the query's own rows stand together
                s = scores[j] if not len(own) else np.delete(scores[j], slice(lows[j], highs[j]))
                m = min(k, len(s))
                if not m:
                    continue
                cut = np.partition(s, len(s) - m)[len(s) - m]
                sure = np.flatnonzero(s > cut)
                at = np.concatenate([sure, np.flatnonzero(s == cut)[:m - len(sure)]])
                s = s[at]
                at = at + len(own) * (at >= lows[j])
                out.append((np.full(len(at), qid[lo + j]), cid[at], s.astype(np.int64)))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row."""
    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        df = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad)
        scaled = F.transform(v, lambda x: F.floor(F.when(F.abs(x) < 1e17, x * scale)).cast("double"))
        far = F.transform(v, lambda x: x * scale)  # beyond 2^53 a double is already whole
        huge = F.exists(v, lambda x: F.abs(x) >= 1e15)
        return df.select(F.col(id_col).cast("long").alias("id"), F.when(huge, far).otherwise(scaled).alias("w"))

    cand, ask = whole(vectors), whole(queries)
    sizes = [int(df.count()) for df in (ask, cand)]
    qn, cn = -(-sizes[0] // QUERY_BLOCK) or 1, -(-sizes[1] // CANDIDATE_BLOCK) or 1
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.to_json(F.struct("w")), F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ask.withColumn("qb", block(qn, 1)).withColumn("cb", each(cn)).withColumn("is_query", F.lit(True))
    right = cand.withColumn("cb", block(cn, 2)).withColumn("qb", each(qn)).withColumn("is_query", F.lit(False))
    cells = left.unionByName(right).groupBy("qb", "cb").applyInPandas(
        _cell(k), T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")]))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
