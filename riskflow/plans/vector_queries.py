"""Registered queries: similarity search and the out-of-domain gate
(JN-6, RT-3/4/5, OD-1..7, AG-27, ST-7).

Binding (SURVEY §2.15): ``embeddings`` labels 0-6 are in-domain patterns,
7-9 out-of-domain.  The pattern library is every in-domain vector; queries
are all vectors, matched against the library without themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow import bindings as B
from riskflow.operators import gate as G
from riskflow.operators import sampling as S
from riskflow.operators import vectors as V
from riskflow.plans.registry import register
from riskflow.plans.sqlhelp import rounded

IN_DOMAIN_MAX_LABEL = 6


def _emb(spark, sf):
    return B.table(spark, sf, "embeddings")


def _lib(spark, sf):
    return _emb(spark, sf).filter(F.col("label") <= IN_DOMAIN_MAX_LABEL)


_COS = ("list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) / "
        "((sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) + 1e-9) * "
        "(sqrt(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) + 1e-9))")


def _topk_sql(k, min_cos=None, queries="embeddings", exclude_self=True):
    cond = ["p.label <= 6"]
    if exclude_self:
        cond.append("q.vec_id <> p.vec_id")
    inner = (f"SELECT q.vec_id AS qid, p.vec_id AS pid, {_COS} AS cos FROM {queries} q, embeddings p "
             f"WHERE {' AND '.join(cond)}")
    flt = f"WHERE cos >= {min_cos}" if min_cos is not None else ""
    return (f"SELECT qid, CAST(rank AS BIGINT) AS rank, pid, cos FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, pid) AS rank "
            f"FROM ({inner}) {flt}) WHERE rank <= {k}")


@register("cosine_top5", ops=("JN-6", "H4"), sql=rounded(_topk_sql(5), ["cos"]))
def q_cosine_top5(spark, sf):
    return V.top_k_cosine(_emb(spark, sf), _lib(spark, sf), 5, exclude_self=True)


@register("cosine_top5_blocked", ops=("JN-6", "H4"), sql=rounded(_topk_sql(5), ["cos"]))
def q_cosine_top5_blocked(spark, sf):
    """Same answer with tiny blocks: many (query block, library block) groups."""
    return V.top_k_cosine(_emb(spark, sf), _lib(spark, sf), 5, exclude_self=True,
                          q_block_rows=64, p_block_rows=100)


# The driver vectors are random (cosines mostly under 0.4), so the floor and the
# display range are scaled to them; library defaults stay 0.50 / 0.55-0.85.
@register("pattern_search", ops=("RT-3", "RT-4"), sql=rounded(f"""
SELECT qid, rank, pid, cos,
       greatest(0.0, least(1.0, (cos - 0.2) / (0.5 - 0.2))) AS similarity,
       CASE WHEN greatest(0.0, least(1.0, (cos - 0.2) / (0.5 - 0.2))) >= 0.75 THEN 'Strongest match'
            WHEN greatest(0.0, least(1.0, (cos - 0.2) / (0.5 - 0.2))) >= 0.5 THEN 'Strong match'
            WHEN greatest(0.0, least(1.0, (cos - 0.2) / (0.5 - 0.2))) >= 0.25 THEN 'Moderate match'
            ELSE 'Weak match' END AS match_band
FROM ({_topk_sql(3, 0.25)})""", ["cos", "similarity"]))
def q_search(spark, sf):
    return V.search(_emb(spark, sf), _lib(spark, sf), 3, 0.25, low=0.2, high=0.5, exclude_self=True)


@register("knn_distance_loo", ops=("OD-4",), sql=rounded(
    f"SELECT qid, avg(1.0 - cos) AS knn_distance FROM ({_topk_sql(5)}) GROUP BY qid", ["knn_distance"]))
def q_knn(spark, sf):
    return V.knn_distance(_emb(spark, sf), _lib(spark, sf), 5, exclude_self=True)


@register("calibrate_similarity", ops=("RT-5", "AG-21"), sql=rounded(f"""
SELECT count(cos) AS n, min(cos) AS min, max(cos) AS max, avg(cos) AS mean, stddev_pop(cos) AS std,
       quantile_cont(cos, 0.10) AS calibrated_low, quantile_cont(cos, 0.95) AS calibrated_high,
       quantile_cont(cos, 0.05) AS calibrated_threshold
FROM ({_topk_sql(10, queries="(SELECT * FROM embeddings WHERE label <= 6)")})""",
    ["min", "max", "mean", "std", "calibrated_low", "calibrated_high", "calibrated_threshold"]))
def q_calibrate(spark, sf):
    probes = _lib(spark, sf)
    return V.calibrate_similarity(probes, _lib(spark, sf), 10, exclude_self=True)


@register("ood_gate_report", ops=("OD-1", "OD-2", "OD-3", "OD-5", "OD-6", "OD-7", "AG-27", "ST-7"))
def q_gate_report(spark, sf):
    """Fit on half the in-domain vectors (reference OOD: half the OOD vectors),
    gate the held-out halves; report verdict shares per set.  Rows-only check:
    the eigen-decomposition has no SQL oracle."""
    emb = _emb(spark, sf).withColumn("domain", F.when(F.col("label") <= IN_DOMAIN_MAX_LABEL, "id")
                                                .otherwise("ood"))
    halves = S.split_half(emb, "vec_id")
    fit_id = halves.filter((F.col("half") == "fit") & (F.col("domain") == "id"))
    fit_ood = halves.filter((F.col("half") == "fit") & (F.col("domain") == "ood"))
    det = G.fit_gate(fit_id, fit_ood)
    hold = halves.filter(F.col("half") == "holdout")
    v = G.apply_gate(hold, fit_id, det)
    v = v.join(hold.select(F.col("vec_id").alias("qid"), F.col("domain").alias("set")), "qid")
    return G.gate_report(v)


@register("ood_verdicts", ops=("OD-3", "OD-4", "OD-6"))
def q_gate_verdicts(spark, sf):
    """Per-vector gate verdicts of every embedding against a detector fitted on
    the whole in-domain library by explained variance (rows-only check)."""
    lib = _lib(spark, sf)
    det = G.fit_gate(lib)
    return G.apply_gate(_emb(spark, sf), lib, det)
