"""Evaluation operators against brute force (NumPy) on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from riskflow.operators import evaluate as EV


def _np_metrics(y, s, targets):
    order = np.argsort(-s, kind="stable")
    ys, ss = y[order], s[order]
    P, N = ys.sum(), (1 - ys).sum()
    # distinct thresholds
    idx = np.r_[np.nonzero(np.diff(ss))[0], len(ss) - 1]
    tp = np.cumsum(ys)[idx]
    fp = np.cumsum(1 - ys)[idx]
    tpr, fpr = tp / P, fp / N
    prec = tp / (tp + fp)
    ap = np.sum(np.diff(np.r_[0, tpr]) * prec)
    auc = np.trapezoid(np.r_[0, tpr], np.r_[0, fpr])
    fpr0, tpr0 = np.r_[0, fpr], np.r_[0, tpr]
    rec = [tpr0[min(np.searchsorted(fpr0, t), len(tpr0) - 1)] for t in targets]
    return ap, auc, rec


def test_ranking_metrics_match_bruteforce(spark):
    rng = np.random.default_rng(7)
    n = 3000
    y = (rng.random(n) < 0.1).astype(int)
    s = np.round(np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1), 3)   # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "is_fraud int, score double")
    got = EV.ranking_metrics(df, fpr_targets=(0.01, 0.1), buckets=7).first()
    ap, auc, rec = _np_metrics(y, s, (0.01, 0.1))
    assert abs(got["average_precision"] - ap) < 1e-9
    assert abs(got["roc_auc"] - auc) < 1e-9
    assert abs(got["recall_at_fpr_0_01"] - rec[0]) < 1e-9
    assert abs(got["recall_at_fpr_0_1"] - rec[1]) < 1e-9


def test_confusion_and_sweep(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(500) < 0.2).astype(int)
    s = rng.random(500)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "is_fraud int, score double")
    c = EV.confusion(df, 0.6).first()
    assert c["tp"] + c["fp"] + c["fn"] + c["tn"] == 500
    assert c["tp"] == int(((s >= 0.6) & (y == 1)).sum())
    sw = EV.threshold_sweep(df).orderBy("i").collect()
    grid = EV.sweep_grid()
    assert len(sw) == 50
    for r, t in zip(sw, grid):
        assert r["tp"] == int(((s >= t) & (y == 1)).sum())
        assert r["fp"] == int(((s >= t) & (y == 0)).sum())
    catch = [r["catch_pct"] for r in sw]
    assert all(a >= b for a, b in zip(catch, catch[1:]))     # non-increasing in the threshold


def test_no_positives_guard(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9)], "is_fraud int, score double")
    c = EV.confusion(df, 0.5).first()
    assert c["catch_rate"] == 0.0 and c["fp_rate"] == 0.5


def test_guards_no_positives_no_negatives(spark):
    only_neg = spark.createDataFrame([(0, 0.2), (0, 0.7)], "is_fraud int, score double")
    r = EV.ranking_metrics(only_neg).first()
    assert r["average_precision"] is None and r["roc_auc"] is None
    only_pos = spark.createDataFrame([(1, 0.2), (1, 0.7)], "is_fraud int, score double")
    r2 = EV.ranking_metrics(only_pos).first()
    assert r2["average_precision"] == 1.0
    one = spark.createDataFrame([(0, 5.0), (1, 5.0)], "is_fraud int, amount double")
    from riskflow.operators.aggregates import log_histogram
    assert log_histogram(one).count() >= 0
