"""Score evaluation (AG-18, AG-19, ML-3, ML-4, ML-12, WN-10, H3).

Ranking metrics need prefix sums over scores in descending order.  A global
``Window.orderBy`` runs in one task, so instead:

1. ties collapse first: ``groupBy(score)`` with positive / negative counts
   (partial aggregation; a hot score value becomes one row);
2. the distinct scores are cut into ``buckets`` ranges at approximate
   quantiles (balanced whatever the score distribution);
3. per-bucket totals (a table of ``buckets`` rows) give each bucket its
   offset; inside a bucket a running sum adds the rest.

The result is exact whatever the edges are; the edges only balance work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.quantiles import quantile_values


def confusion(df: DataFrame, threshold: float = 0.6, score: str = "score",
              label: str = "is_fraud") -> DataFrame:
    """AG-18: tp / fp / fn / tn at ``score >= threshold`` and catch, FPR,
    precision with ``max(., 1)`` denominators."""
    flag = F.col(score) >= threshold
    y = F.col(label)

    def cnt(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")

    out = df.agg(cnt(flag & (y == 1)).alias("tp"), cnt(flag & (y == 0)).alias("fp"),
                 cnt(~flag & (y == 1)).alias("fn"), cnt(~flag & (y == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (out.withColumn("threshold", F.lit(float(threshold)))
               .withColumn("catch_rate", tp / F.greatest(tp + fn, F.lit(1)))
               .withColumn("fp_rate", fp / F.greatest(fp + tn, F.lit(1)))
               .withColumn("precision", tp / F.greatest(tp + fp, F.lit(1))))


def sweep_grid(start: float = 0.01, stop: float = 0.99, num: int = 50) -> list[float]:
    """The reference's threshold grid, bit for bit (``np.linspace``)."""
    return [float(x) for x in np.linspace(start, stop, num)]


def threshold_sweep(df: DataFrame, grid: list[float] | None = None, score: str = "score",
                    label: str = "is_fraud") -> DataFrame:
    """AG-19: catch rate and FPR at every grid threshold in ONE scan.

    Each row is assigned ``j`` = number of grid points <= score; counts per
    ``j`` (at most len(grid)+1 rows) are reverse-cumulated, so threshold i
    sees every row with ``j > i``.  The reference rescans the table per point.
    """
    grid = grid or sweep_grid()
    g = F.array(*[F.lit(x) for x in grid])
    j = F.size(F.filter(g, lambda x: x <= F.col(score)))
    counts = (df.filter(F.col(score).isNotNull())
                .groupBy(j.alias("j"))
                .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
                     F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg")))
    spark = df.sparkSession
    # thresholds as a bounded table (len(grid) rows); equi-join on the bucket index
    th = spark.createDataFrame([(i, x) for i, x in enumerate(grid)], "i int, threshold double")
    full = spark.range(len(grid) + 1).select(F.col("id").cast("int").alias("j")) \
                .join(counts, "j", "left").fillna(0, ["pos", "neg"])
    w = Window.orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = full.select("j", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                         F.sum("pos").over(Window.partitionBy()).alias("p"),
                         F.sum("neg").over(Window.partitionBy()).alias("n"))
    out = th.join(totals, th.i + 1 == totals.j).drop("j")
    return out.select("i", "threshold", F.col("tp").cast("long").alias("tp"),
                      F.col("fp").cast("long").alias("fp"),
                      (F.col("tp") / F.greatest(F.col("p"), F.lit(1)) * 100).alias("catch_pct"),
                      (F.col("fp") / F.greatest(F.col("n"), F.lit(1)) * 100).alias("fp_pct"))


def score_table(df: DataFrame, score: str = "score", label: str = "is_fraud",
                buckets: int = 64) -> DataFrame:
    """Distinct scores, descending, with exact cumulative tp / fp (``score >= s``).

    Columns: score, pos, neg, tp, fp, P, N.  See the module note for the plan.
    """
    d = (df.filter(F.col(score).isNotNull())
           .groupBy(F.col(score).alias("s"))
           .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("pos"),
                F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("long").alias("neg")))
    # bucket edges at approximate quantiles of the distinct scores: ONE scalar
    # subquery; bucket = number of edges below s, found by the position of s
    # in the sorted (edges + s) array (no higher-order function, which may not
    # hold a subquery, and no per-edge references to it)
    qs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = d.select(F.percentile_approx("s", qs, 10000)).scalar()
    d = d.withColumn("b", F.array_position(F.sort_array(F.concat(edges, F.array(F.col("s")))), F.col("s")) - 1)
    tot = d.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    # higher buckets hold higher scores: offsets accumulate from the top bucket down
    wb = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    off = tot.select("b", F.coalesce(F.sum("bp").over(wb), F.lit(0)).alias("op"),
                     F.coalesce(F.sum("bn").over(wb), F.lit(0)).alias("on"),
                     F.sum("bp").over(Window.partitionBy()).alias("P"),
                     F.sum("bn").over(Window.partitionBy()).alias("N"))
    w = Window.partitionBy("b").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", F.sum("pos").over(w).alias("ip"), F.sum("neg").over(w).alias("in_"))
    d = d.join(off, "b")
    return d.select(F.col("s").alias("score"), "pos", "neg",
                    (F.col("ip") + F.col("op")).cast("long").alias("tp"),
                    (F.col("in_") + F.col("on")).cast("long").alias("fp"),
                    F.col("P").cast("long").alias("P"), F.col("N").cast("long").alias("N"))


def ranking_metrics(df: DataFrame, score: str = "score", label: str = "is_fraud",
                    fpr_targets=(0.001, 0.01), buckets: int = 64) -> DataFrame:
    """ML-3 + ML-4: average precision (step sum, as sklearn), ROC AUC
    (trapezoids from (0, 0)) and recall at FPR targets (S12 ``mode="at_least"``:
    the first ROC point, by descending threshold, whose FPR >= target)."""
    st = score_table(df, score, label, buckets)
    # (ANSI mode: a zero denominator would raise; no positives / negatives -> null)
    P, N = F.nullif(F.col("P"), F.lit(0)), F.nullif(F.col("N"), F.lit(0))
    tpr = F.col("tp") / P
    fpr = F.col("fp") / N
    prev_tp = F.col("tp") - F.col("pos")
    ap_term = (F.col("pos") / P) * (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)))
    auc_term = (F.col("neg") / N) * ((F.col("tp") + prev_tp) / P) / 2
    aggs = [F.sum(ap_term).alias("average_precision"), F.sum(auc_term).alias("roc_auc"),
            F.max("P").alias("positives"), F.max("N").alias("negatives")]
    for tgt in fpr_targets:
        name = f"recall_at_fpr_{str(tgt).replace('.', '_')}"
        if tgt <= 0:
            aggs.append(F.lit(0.0).alias(name))
        else:
            # first point with fpr >= target = the highest such score
            aggs.append(F.max_by(tpr, F.when(fpr >= tgt, F.col("score"))).alias(name))
    return st.agg(*aggs)


def recall_at_fpr_at_most(df: DataFrame, target: float, score: str = "score",
                          label: str = "is_fraud", buckets: int = 64) -> DataFrame:
    """ML-4 ``mode="at_most"``: best recall among points whose FPR <= target."""
    st = score_table(df, score, label, buckets)
    P, N = F.nullif(F.col("P"), F.lit(0)), F.nullif(F.col("N"), F.lit(0))
    return st.agg(F.coalesce(F.max(F.when(F.col("fp") / N <= target, F.col("tp") / P)), F.lit(0.0))
                  .alias("recall"))


def recall_at_legit_quantile(df: DataFrame, err: str, label: str = "is_fraud",
                             q: float = 0.95) -> DataFrame:
    """ML-12: threshold = ``q`` quantile of the legit errors; share of fraud rows above it."""
    thr = F.lit(quantile_values(df, [(F.when(F.col(label) == 0, F.col(err)), {"q": q})])["q"]).cast("double")
    return df.agg(thr.alias("threshold"),
                  F.coalesce(F.avg(F.when(F.col(label) == 1,
                                          (F.col(err) > thr).cast("double"))), F.lit(0.0))
                  .alias("recall"))


def cumulative_share(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """WN-10: running share of the total in ``order`` (explained variance, ROC
    prefix).  Meant for bounded tables (components, buckets): one ordered window."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tot = df.select(F.sum(value)).scalar()
    return df.withColumn("cumulative", F.sum(value).over(w)).withColumn(
        "cumulative_share", F.col("cumulative") / tot)
