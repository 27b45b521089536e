"""Out-of-domain gate: subspace error + k-NN distance (OD-1..OD-7, AG-27).

Fitting is distributed where the data is: the covariance behind the PCA is
Spark ML's (a tree aggregate of outer products), the mean is a ``Summarizer``
aggregate, thresholds are exact quantiles and the k-NN distances
come from the blocked cosine search.  Only the d x d eigen-decomposition
(d = 64..768) and the fitted matrices live on the driver - a bounded model,
shipped to tasks with the pandas UDF that applies it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.operators.quantiles import quantile_values
from riskflow.operators.vectors import knn_distance

# Fixed values that must equal the reference's defaults.
VARIANCE_TARGET = 0.80
OOD_PERCENTILE, BORDERLINE_PERCENTILE = 99.5, 80.0
K_NEIGHBORS = 5


@dataclass
class Detector:
    mean: np.ndarray
    components: np.ndarray          # (n, d), rows orthonormal
    n_components: int
    method: str
    pca_threshold: float = 0.0
    pca_borderline: float = 0.0
    id_pca_p50: float = 0.0
    knn_threshold: float = 0.0
    knn_borderline: float = 0.0
    k_neighbors: int = K_NEIGHBORS
    t_stats: list = field(default_factory=list)


def normalised(vec: Column) -> Column:
    """Row-wise L2 normalisation (``x / (|x| + 1e-9)``) as a Catalyst expression."""
    v = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / (norm + F.lit(1e-9)))


def _pca_parts(df: DataFrame, vec: str):
    """Mean and all principal axes (descending variance) of the normalised vectors."""
    from riskflow.session import materialize
    x = materialize(df.select(normalised(F.col(vec)).alias("a")), "pca-input").select(
        array_to_vector("a").alias("v"))
    mean = np.array(x.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray())
    d = len(mean)
    model = PCA(k=d, inputCol="v", outputCol="p").fit(x)
    comps = model.pc.toArray().T            # (d, d): row i = i-th axis
    explained = model.explainedVariance.toArray()
    return mean, comps, explained


def _n_by_variance(explained: np.ndarray, target: float) -> int:
    cum = np.cumsum(explained) / explained.sum()
    n = int(np.searchsorted(cum, target) + 1)
    return max(min(n, len(explained)), 1)


def _projector(mean: np.ndarray, comps: np.ndarray):
    @F.pandas_udf("array<double>")
    def project_abs(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype(np.float64)
        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
        return pd.Series(list(np.abs((m - mean) @ comps.T)))
    return project_abs


def error_udf(mean: np.ndarray, comps: np.ndarray):
    """OD-3: squared residual after projecting onto ``comps`` (a pandas UDF)."""
    @F.pandas_udf("double")
    def pca_error(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype(np.float64)
        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
        c = m - mean
        r = c - (c @ comps.T) @ comps
        return pd.Series(np.sum(r * r, axis=1))
    return pca_error


def select_by_separability(id_df: DataFrame, ood_df: DataFrame, vec: str, mean: np.ndarray,
                           comps: np.ndarray, n: int) -> tuple[np.ndarray, list]:
    """OD-2: Welch t of |projection| between in-domain and reference-OOD sets per
    axis; keep the top ``n`` axes, in original order.  Projections are computed
    in tasks; per-axis mean / variance are one grouped aggregate."""
    proj = _projector(mean, comps)
    both = (id_df.select(F.lit("id").alias("set"), proj(F.col(vec)).alias("a"))
                 .unionByName(ood_df.select(F.lit("ood").alias("set"), proj(F.col(vec)).alias("a"))))
    stats = (both.select("set", F.posexplode("a").alias("axis", "x"))
                 .groupBy("axis").agg(
                     F.avg(F.when(F.col("set") == "id", F.col("x"))).alias("m_id"),
                     F.avg(F.when(F.col("set") == "ood", F.col("x"))).alias("m_ood"),
                     (F.var_samp(F.when(F.col("set") == "id", F.col("x"))) + 1e-12).alias("v_id"),
                     (F.var_samp(F.when(F.col("set") == "ood", F.col("x"))) + 1e-12).alias("v_ood"),
                     F.count(F.when(F.col("set") == "id", 1)).alias("n_id"),
                     F.count(F.when(F.col("set") == "ood", 1)).alias("n_ood")))
    t = F.abs(F.col("m_id") - F.col("m_ood")) / F.sqrt(
        F.col("v_id") / F.col("n_id") + F.col("v_ood") / F.col("n_ood"))
    rows = stats.select("axis", t.alias("t")).collect()     # one row per axis: bounded by d
    ts = np.zeros(len(comps))
    for r in rows:
        ts[r["axis"]] = r["t"]
    top = np.sort(np.argsort(-ts, kind="stable")[:min(n, len(ts))])
    return comps[top], [float(x) for x in ts]


def fit_gate(id_df: DataFrame, ood_ref: DataFrame | None = None, vec: str = "embedding",
             id_col: str = "vec_id", variance_target: float = VARIANCE_TARGET,
             k: int = K_NEIGHBORS, **knn_kw) -> Detector:
    """OD-1 + OD-2 + OD-5: fit the subspace (by separability when a reference
    OOD set of >= 10 rows is given, else by explained variance) and calibrate
    both signals' thresholds on the in-domain fit set."""
    mean, comps, explained = _pca_parts(id_df, vec)
    n_target = _n_by_variance(explained, variance_target)
    ts = []
    if ood_ref is not None and ood_ref.count() >= 10:
        chosen, ts = select_by_separability(id_df, ood_ref, vec, mean, comps, n_target)
        method = "separability"
    else:
        chosen, method = comps[:n_target], "explained_variance"
    det = Detector(mean=mean, components=chosen, n_components=len(chosen), method=method,
                   k_neighbors=k, t_stats=ts)
    err = id_df.select(error_udf(mean, chosen)(F.col(vec)).alias("e"))
    edges = {"t": OOD_PERCENTILE / 100, "b": BORDERLINE_PERCENTILE / 100}
    q = quantile_values(err, [("e", edges | {"m": 0.5})])
    det.pca_threshold, det.pca_borderline, det.id_pca_p50 = q["t"], q["b"], q["m"]
    n_id = id_df.count()
    kk = min(k, n_id - 1)
    knn = knn_distance(id_df, id_df, kk, exclude_self=True, q_id=id_col, p_id=id_col, **knn_kw)
    q2 = quantile_values(knn, [("knn_distance", edges)])
    det.knn_threshold, det.knn_borderline = q2["t"], q2["b"]
    return det


def verdict(value: Column, borderline: float, threshold: float) -> Column:
    return (F.when(value >= threshold, "out_of_domain")
             .when(value >= borderline, "borderline").otherwise("in_domain"))


def apply_gate(queries: DataFrame, library: DataFrame, det: Detector, vec: str = "embedding",
               id_col: str = "vec_id", **knn_kw) -> DataFrame:
    """OD-6: both signals out -> out, both in -> in, else borderline; relative
    score = clamp((err - p50) / max(threshold - p50, 1e-9), 0, 2)."""
    err = queries.select(F.col(id_col).alias("qid"),
                         error_udf(det.mean, det.components)(F.col(vec)).alias("pca_error"))
    knn = knn_distance(queries, library, det.k_neighbors, q_id=id_col, p_id=id_col, **knn_kw)
    j = err.join(knn, "qid", "left")
    pv = verdict(F.col("pca_error"), det.pca_borderline, det.pca_threshold)
    kv = verdict(F.col("knn_distance"), det.knn_borderline, det.knn_threshold)
    both = (F.when((pv == "out_of_domain") & (kv == "out_of_domain"), "out_of_domain")
             .when((pv == "in_domain") & (kv == "in_domain"), "in_domain").otherwise("borderline"))
    denom = max(det.pca_threshold - det.id_pca_p50, 1e-9)
    rel = F.greatest(F.lit(0.0), F.least(F.lit(2.0), (F.col("pca_error") - det.id_pca_p50) / denom))
    return (j.withColumn("pca_verdict", pv).withColumn("knn_verdict", kv)
             .withColumn("verdict", both).withColumn("relative_score", rel))


def gate_report(verdicts: DataFrame, set_col: str = "set") -> DataFrame:
    """AG-27: share of in / borderline / out verdicts within each evaluation set."""
    from pyspark.sql import Window
    g = verdicts.groupBy(set_col, "verdict").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(set_col)))
