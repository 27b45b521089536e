"""How often jobs compute their input, and that shared work gives the results of separate work."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskflow.operators import models as M
from riskflow.operators import sequence as Q
from riskflow.operators import windows as W
from riskflow.plans import incremental as INC
from riskflow.streaming import features as SF

NAMES = ["a", "b", "c"]


def _counted(spark, df, col):
    """``df`` and the number of rows that have been computed of it."""
    seen = spark.sparkContext.accumulator(0)

    def see(x):
        seen.add(1)
        return x
    return df.withColumn(col, F.udf(see, "double")(col)), seen


def _points(spark, n=400):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.7 > 0.4).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))],
                                 "txn_id long, a double, b double, c double, is_fraud int").repartition(2)


def test_learners_compute_their_input_once(spark):
    df = _points(spark, 60)
    for learn in (lambda d: M.train_classifier(d, NAMES, max_iter=1), lambda d: M.fit_linear_explainer(d, NAMES),
                  lambda d: M.tune(d, NAMES)):
        counted, seen = _counted(spark, df, "a")
        learn(counted)
        assert seen.value == 60


def test_trials_of_tuning_equal_separate_fits(spark):
    df = _points(spark)
    data = VectorAssembler(inputCols=NAMES, outputCol="features").transform(df.withColumn("label", F.col("is_fraud").cast("double"))).cache()
    ev = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderPR")
    long = GBTClassifier(labelCol="label", maxIter=6, maxDepth=3, stepSize=0.3, seed=42).fit(data)
    margins = M.staged_margins(data, long, [3, 6])
    for n in (3, 6):
        short = GBTClassifier(labelCol="label", maxIter=n, maxDepth=3, stepSize=0.3, seed=42).fit(data).transform(data)
        a, b = ([r[0] for r in d.orderBy("txn_id").collect()] for d in (
            margins.select(f"margin_{n}", "txn_id"), short.select(M.vector_to_array("rawPrediction")[1], "txn_id")))
        assert np.allclose(a, b, rtol=1e-12, atol=1e-12)
        assert ev.setRawPredictionCol(f"margin_{n}").evaluate(margins) == pytest.approx(
            BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderPR").evaluate(short), abs=1e-12)
    out = M.tune(df, NAMES).collect()
    assert [tuple(r)[:4] for r in out] == [(4 * i + 2 * j + k, d, n, s) for i, d in enumerate([3, 5])
                                           for j, n in enumerate([10, 20]) for k, s in enumerate([0.1, 0.3])]
    assert all(0 < r["area_under_pr"] <= 1 for r in out)


def test_drivers_of_equal_size_go_by_name(spark):
    ex = M.LinearExplainer(["b", "a", "c"], [0.0] * 3, [1.0] * 3, [1.0, -1.0, 2.0], 0.5)
    df = spark.createDataFrame([(1, 3.0, 3.0, 1.0), (2, float("nan"), 1.0, 9.0)], "txn_id long, a double, b double, c double")
    rows = {r["txn_id"]: r for r in M.attribute(df, ex, k=3).collect()}
    assert [d["feature"] for d in rows[1]["top_drivers"]] == ["a", "b", "c"]
    assert (rows[1]["total_positive_contribution"], rows[1]["total_negative_contribution"]) == (5.0, -3.0)
    assert [d["feature"] for d in rows[2]["top_drivers"]] == ["a", "c", "b"]  # not a number: first


def _steps(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 6, i * 100, int(i % 9 == 0), *map(float, rng.normal(size=len(Q.SEQ_FEATURES)))) for i in range(240)]
    return spark.createDataFrame(rows, "txn_id long, card long, t long, is_fraud int, " + ", ".join(f"{c} double" for c in Q.SEQ_FEATURES))


def test_trials_of_one_length_share_their_windows(spark, monkeypatch):
    feats, names = _steps(spark), []
    write = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name: names.append(name) or write(df, name))
    rows = Q.sweep_sequence_params(feats, ranks=(2, 4), lengths=(3, 5)).collect()
    assert names.count("seq-windows") == 2  # one a length, not one a trial
    for r in rows:
        m, win = Q.fit_sequence_model(feats, rank=r["rank"], n=r["seq_len"])
        scored = Q.score_windows(win.where("split = 'test' and is_fraud = 1"), m)
        assert r["threshold"] == pytest.approx(m.threshold, rel=1e-9)
        assert r["recall_at_legit_p95"] == pytest.approx(scored.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0])


def test_sequence_model_computes_its_input_once(spark):
    counted, seen = _counted(spark, _steps(spark), "amount")
    Q.fit_sequence_model(counted, n=3, rank=2)[1].count()
    assert seen.value == 240


def test_offsets_of_ranges_are_at_most_one_row_a_range(spark):
    rows = [(i, None if i % 4 == 0 else i % 4, i // 3, float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "txn_id long, card long, t long, amount double").withColumns({"channel": F.lit("w"), "addr": F.lit(1)})
    for got, want, cols in ((W.row_numbers(df, "card", split_seconds=W.ROWS), W.row_numbers(df, "card"), ["rn"]),
                            (W.prior_profile(df, split_seconds=W.ROWS), W.prior_profile(df), ["card_total_txns", "card_amt_mean", "card_amt_std"])):
        a, b = (d.select("txn_id", *cols).toPandas().sort_values("txn_id", ignore_index=True) for d in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().sparkPlan().toString()


def test_content_keys_deal_out_digests_only(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3, i, "x" * 50) for i in range(30)], "txn_id long, card long, t long, note string")
    dealt = []
    real = INC.row_ranges
    monkeypatch.setattr(INC, "row_ranges", lambda d, order, name: dealt.extend(d.columns) or real(d, order, name))
    keys = {r["txn_id"]: r["content_key"] for r in INC.content_keys(df).collect()}
    assert "note" not in dealt and len(set(keys.values())) == 30
    other = {r["txn_id"]: r["content_key"] for r in INC.content_keys(df.withColumn("note", F.when(F.col("txn_id") == 12, "y").otherwise(F.col("note")))).collect()}
    assert {i for i in keys if keys[i] != other[i]} == {i for i in range(12, 30) if i % 3 == 0}


def test_case_files_compute_their_features_once(spark, monkeypatch):
    from paths import SF001
    from riskflow.plans import check_queries as CQ
    seen, real = [], CQ._feat

    def feat(*args):
        df, n = _counted(spark, real(*args), "amount")
        seen.append((n, df.where("channel is not null").count()))
        n.value = 0
        return df
    monkeypatch.setattr(CQ, "_feat", feat)
    assert CQ.q_case_files(spark, SF001).count() > 0
    assert [n.value for n, _ in seen] == [rows for _, rows in seen]


def test_a_cards_turn_makes_one_frame(monkeypatch):
    """Rows that wait are kept as arrays: a frame a turn costs more than its arithmetic."""
    rows = pd.DataFrame({"txn_id": [3, 1, 2], "card": 1, "t": [50, 20, 20], "amount": [1.0, 2.0, 3.0], "channel": ["a", None, "b"],
                         "addr": [1.0, None, 1.0], "flag": [True, False, True]})
    made, real = [], pd.DataFrame.__init__
    monkeypatch.setattr(pd.DataFrame, "__init__", lambda self, *a, **k: made.append(1) or real(self, *a, **k))
    _, row, _ = SF.advance(1, rows, None, 0, {"7d": 604800}, 604800, "card", ["flag"], False)
    out, _, _ = SF.advance(1, None, row, 10 ** 9, {"7d": 604800}, 604800, "card", ["flag"], False)
    assert len(made) == 1
    assert out[["txn_id", "flag", "card_distinct_addr", "card_distinct_channel"]].to_numpy().tolist() == [
        [1, False, 0, 0], [2, True, 0, 0], [3, True, 1, 1]]
