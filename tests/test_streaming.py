"""Stream = batch: the stateful card processor equals the batch windows for
any arrival order and cut into batches; state ends; late and repeated rows are
kept as rows; scores of the stream equal those of the batch."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paths import SF001
from riskflow import bindings as B
from riskflow.operators.windows import prior_profile, velocity
from riskflow.streaming import features as SF
from riskflow.streaming import jobs as J
from staging import stage_in_slices

COLS = ["txn_id", "card_txn_count_1h", "card_txn_count_24h", "card_txn_count_7d",
        "card_amt_sum_24h", "card_amt_max_7d", "card_seconds_since_last"]
SPAN = 604800


def _stream(spark, files=1, **kw):
    ev = B.table(spark, SF001, "events")
    path = stage_in_slices(ev, B.epoch_seconds(F.col("ts")), 7 * 86400, **kw)
    return J.transactions_stream(J.read_stream(spark, path, J.EVENT_SCHEMA, files))


def _same_rows(got, want):
    """Equal rows by id, doubles up to the order of summation."""
    a, b = (d.toPandas().sort_values("txn_id", ignore_index=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


def _passed(df, delay):
    last = df.agg(F.max("t")).first()[0]
    return df.where(F.col("t") < last - delay)


def test_stream_equals_batch_both_engines(spark):
    batch = _passed(velocity(B.transactions(spark, SF001)), 3600).select(*COLS)
    for engine in ("applyInPandasWithState", "transformWithState"):
        out = J.run_to_table(SF.stream_card_features(_stream(spark), engine=engine), f"t-{engine}")
        _same_rows(out.select(*COLS), batch)


def test_shuffled_arrival_equals_batch_within_the_watermark(spark):
    """Weeks arrive out of order, one file a batch; the delay covers it."""
    delay = 30 * 86400
    txn = B.transactions(spark, SF001)
    cols = [*COLS, "card_total_txns", "card_distinct_channel", "card_distinct_addr", "card_amt_mean", "card_amt_std"]
    batch = velocity(prior_profile(txn))
    ahead = B.table(spark, SF001, "events").withColumn("ts", F.expr("ts + interval 60 days")).withColumn(
        "event_id", F.col("event_id") + 10_000_000).withColumn("user_id", F.col("user_id") + 10_000_000)
    path = stage_in_slices(B.table(spark, SF001, "events"), B.epoch_seconds(F.col("ts")), 7 * 86400, order=[2, 0, 3, 1, 4])
    ahead.write.mode("append").parquet(f"{path}/slice=99999")  # moves the watermark past all of the others
    stream = J.transactions_stream(J.read_stream(spark, path, J.EVENT_SCHEMA, 1))
    out = J.run_to_table(SF.stream_card_features(stream, delay=f"{delay} seconds"), "t-shuffled").where("txn_id < 10000000")
    _same_rows(out.select(*cols), batch.select(*cols))


def test_stream_profile_equals_prior_profile(spark):
    cols = ["txn_id", "card_total_txns", "card_distinct_channel", "card_distinct_addr"]
    batch = _passed(prior_profile(B.transactions(spark, SF001)), 3600).select(*cols)
    out = J.run_to_table(SF.stream_card_features(_stream(spark, files=None)), "t-prof").select(*cols)
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_registered_streams_give_every_row_as_the_batch(spark, tmp_path):
    """Rows of the last hour leave, and a card idle for longer than the longest window keeps its profile."""
    from riskflow.plans.registry import load_all
    day = 86400
    times = {1: [5, 5, 9 * day, 9 * day + 1, 30 * day, 30 * day + 3000], 2: [30 * day + 3599], 0: [0, 30 * day + 3600]}
    rows = [(c, 1_704_067_200 + t, f"k{c}", float(i + c)) for c, ts in times.items() for i, t in enumerate(ts)]
    ev = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "event_id long, user_id long, s long, event_type string, value double")
    ev = ev.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit('{"k": 3}').alias("props"))
    ev.write.parquet(f"{tmp_path}/events.parquet")
    batch = velocity(prior_profile(B.transactions(spark, str(tmp_path))))
    for name in ("stream_velocity", "stream_profile", "stream_engineer"):
        got = load_all()[name].fn(spark, str(tmp_path))
        assert got.count() == len(rows), name
        cols = [c for c in got.columns if c in batch.columns]
        a, b = (d.select(*cols).toPandas().sort_values("txn_id", ignore_index=True) for d in (got, batch))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1e-6)  # registered doubles have six digits
    gaps = [r["card_seconds_since_last"] for r in load_all()["stream_velocity"].fn(spark, str(tmp_path)).where("card = 1").orderBy("t", "txn_id").collect()]
    assert gaps == [-1, 0, 9 * day - 5, 1, 21 * day - 1, 3000]


def _rows(times, ids=None, amounts=None):
    n = len(times)
    return pd.DataFrame({"txn_id": ids or list(range(n)), "card": 1, "t": times, "amount": amounts or [1.0] * n,
                         "channel": "web", "addr": 1})


def test_an_idle_cards_state_is_gone():
    windows = {"7d": SPAN}
    out, row, timer = SF.advance(1, _rows([100, 50]), None, 0, windows, SPAN, "card", [])
    assert out is None and timer == 50_999  # both wait until the watermark has passed them
    out, row, timer = SF.advance(1, None, row, 51_000, windows, SPAN, "card", [])
    assert out["t"].tolist() == [50] and timer == 100_999
    out, row, timer = SF.advance(1, None, row, 200_000, windows, SPAN, "card", [])
    assert out["t"].tolist() == [100] and out["card_seconds_since_last"].tolist() == [50]
    assert timer == (100 + SPAN + 1) * 1000 - 1
    assert SF.advance(1, None, row, timer, windows, SPAN, "card", [])[1] is not None  # a row at the span's end still sees it
    assert SF.advance(1, None, row, timer + 1, windows, SPAN, "card", []) == (None, None, None)


def test_a_gap_ends_the_period_whenever_the_timer_fires():
    windows = {"7d": SPAN}
    times = [10, 20, 20 + SPAN, 21 + 2 * SPAN, 22 + 2 * SPAN]
    at_once, _, _ = SF.advance(1, _rows(times), None, 10 ** 12, windows, SPAN, "card", [])
    row, parts = None, []
    for i, t in enumerate(times):
        out, row, timer = SF.advance(1, _rows([t], [i]), row, (t + 1) * 1000, windows, SPAN, "card", [])
        parts.append(out)
        if timer is not None and i + 1 < len(times) and timer < times[i + 1] * 1000:
            out, row, _ = SF.advance(1, None, row, times[i + 1] * 1000, windows, SPAN, "card", [])
            assert out is None
    pd.testing.assert_frame_equal(at_once, pd.concat(parts, ignore_index=True))
    assert at_once["card_seconds_since_last"].tolist() == [-1, 10, SPAN, -1, 1]
    assert at_once["card_total_txns"].tolist() == [0, 1, 2, 0, 1]


def test_late_and_repeated_rows_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        t = int(rng.integers(0, 20_000))
        rows.append((i, t, t + int(rng.integers(0, 3000))))
        if i % 4 == 0:
            rows.append((i, t, rows[-1][2] + int(rng.choice([0, 500, 9000]))))
    rows += [(None, 5, 7), (None, 5, 7)]
    delay, ttl = 600, 5000
    want = []
    for n, (i, t, at) in enumerate(rows):
        before = [(a, u, m) for m, (j, u, a) in enumerate(rows) if i is not None and j == i and (a, u, m) < (at, t, n)]
        prev = max(before)[0] if before and at - max(before)[0] <= ttl else None
        top = max((u for _, u, a in rows if a < at), default=None)
        behind = top - t if prev is None and top is not None and top - t > delay else None
        want.append((i, t, at, prev, behind, "repeated" if prev is not None else "late" if behind is not None else "on_time"))
    df = spark.createDataFrame(rows, "txn_id long, t long, arrival long")
    for cuts in ([0, 10 ** 9], [0, 4000, 4001, 9000, 15_000, 10 ** 9]):
        out = J.scratch_path(spark, "t-router")
        route = J.arrival_router(delay, ttl)
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            for _ in range(2):  # a retried batch replaces its own output
                route(df.where((F.col("arrival") >= lo) & (F.col("arrival") < hi)), b, out)
        got = J.routed(spark, out).select("txn_id", "t", "arrival", "previous_arrival", "behind", "route").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r[-1] for r in want} == set(J.ROUTES)


def test_router_of_an_empty_batch(spark):
    out = J.scratch_path(spark, "t-router")
    empty = spark.createDataFrame([], "txn_id long, t long, arrival long")
    J.arrival_router(60, 60)(empty, 0, out)
    J.arrival_router(60, 60)(spark.createDataFrame([(1, 5, 9)], "txn_id long, t long, arrival long"), 1, out)
    assert [r["route"] for r in J.routed(spark, out).collect()] == ["on_time"]


def test_dedup_within_watermark(spark):
    n = B.table(spark, SF001, "events").count()
    out = J.run_to_table(J.dedup(_stream(spark, duplicate_next=True)), "t-dedup")
    assert out.count() == n and out.select("txn_id").distinct().count() == n


def test_streamed_scores_equal_batch_scores(spark):
    from riskflow.plans.registry import load_all
    row = load_all()["stream_model_scores"].fn(spark, SF001).first()
    assert row["n"] > 0 and row["n"] == row["equal_scores"] == row["equal_bands"]


def test_range_max_sparse_table():
    rng = np.random.default_rng(0)
    arr = rng.random(1000)
    lo = rng.integers(0, 1000, 500)
    hi = np.minimum(lo + rng.integers(0, 300, 500), 1000)
    got = SF._range_max(arr, lo, hi)
    want = np.array([arr[a:b].max() if b > a else 0.0 for a, b in zip(lo, hi)])
    assert np.array_equal(got, want)


def _large_amounts():
    rng = np.random.default_rng(5)
    return (1e9 + np.concatenate([rng.normal(size=40), [0.0] * 5, -1e9 + rng.normal(size=5), rng.normal(size=30) * 1e-3])).tolist()


def test_deviation_of_large_amounts_in_stream_window_and_profile(spark):
    """Amounts near 1e9 give the true deviation in all three."""
    from statistics import pstdev, stdev

    from riskflow.operators.profiles import card_profile
    x = _large_amounts()
    n, mean, m2 = SF.running_moments(np.array(x), 0, 0.0, 0.0)
    parts = (0, 0.0, 0.0)
    for lo in range(0, len(x), 7):
        a = SF.running_moments(np.array(x[lo:lo + 7]), *parts)
        parts = tuple(v[-1] for v in a)
    true = [0.0] + [pstdev(x[:i]) ** 2 * i for i in range(2, len(x) + 1)]
    assert np.allclose(m2, true, rtol=1e-6, atol=1e-6)
    assert np.isclose(parts[2], true[-1], rtol=1e-6) and parts[0] == len(x)
    rows = [(i, 1, "web", v, i * 90_000, 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "txn_id long, card long, channel string, amount double, t long, addr int")
    want = [0.0, 0.0] + [stdev(x[:i]) for i in range(2, len(x))]
    for split in (None, 7 * 86400, 100_000):
        got = [r["card_amt_std"] for r in prior_profile(df, split_seconds=split).orderBy("txn_id").collect()]
        assert np.allclose(got, want, rtol=1e-6, atol=1e-6), split
    out, _ = SF.score_rows(1, _rows([i * 9000 for i in range(len(x))], amounts=x), SF.CardState(), {"7d": SPAN}, SPAN, "card", [])
    assert np.allclose(out["card_amt_std"], want, rtol=1e-6, atol=1e-6)
    assert np.isclose(card_profile(df).first()["card_amt_std"], stdev(x), rtol=1e-9)


def test_prior_profile_keeps_null_keys(spark):
    rows = [(i, None if i % 2 else 1, "web", float(i), i * 50_000, i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "txn_id long, card long, channel string, amount double, t long, addr int")
    plain = prior_profile(df)
    assert plain.count() == 20
    _same_rows(prior_profile(df, split_seconds=86400).select(*plain.columns), plain)
