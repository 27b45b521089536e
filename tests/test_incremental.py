"""Content-addressed refresh: only reachable rows are computed again, and the
table equals a full build after changes, insertions and deletions."""

import pytest
from pyspark.sql import functions as F

from riskflow.functions.features import time_features
from riskflow.operators.windows import prior_profile
from riskflow.plans import incremental as INC
from riskflow.session import scratch_path


def build(rows):
    return prior_profile(time_features(rows))


def _rows(spark):
    rows = [(i, None if i % 7 == 6 else i % 7, ["web", "pos"][i % 2], float(i % 13), i * 40_000, i % 3) for i in range(140)]
    return spark.createDataFrame(rows, "txn_id long, card long, channel string, amount double, t long, addr int")


def _table(df):
    cols = ["txn_id", "card", "amount", "card_amt_mean", "card_amt_std", "card_total_txns", "card_distinct_addr"]
    return sorted(map(repr, df.select(*cols).collect()))


@pytest.mark.parametrize("change, reached", [
    (lambda d: d, lambda i: False),
    (lambda d: d.withColumn("amount", F.when(F.col("txn_id") == 73, 99.0).otherwise(F.col("amount"))),
     lambda i: i % 7 == 73 % 7 and i >= 73),
    (lambda d: d.where("txn_id <> 20"), lambda i: i % 7 == 6 and i > 20),
    (lambda d: d.withColumn("t", F.when(F.col("txn_id") == 75, 0).otherwise(F.col("t"))), lambda i: i % 7 == 5)])
def test_refresh_reaches_only_later_rows_of_the_card(spark, change, reached):
    txn = _rows(spark)
    path = scratch_path(spark, "t-refresh")
    assert INC.refresh(txn, path, build, exists=False) == {"recomputed": 140, "dropped": 0}
    after = change(txn)
    ids = {r["txn_id"] for r in after.collect()}
    counts = INC.refresh(after, path, build)
    assert counts == {"recomputed": sum(reached(i) for i in ids), "dropped": 140 - len(ids)}
    assert _table(spark.read.parquet(path)) == _table(build(after))
    assert INC.refresh(after, path, build) == {"recomputed": 0, "dropped": 0}
    assert _table(spark.read.parquet(path)) == _table(build(after))


def test_a_partition_that_lost_all_rows_goes(spark):
    txn = _rows(spark)
    path = scratch_path(spark, "t-refresh")
    INC.refresh(txn, path, build, exists=False)
    after = txn.where("t >= 20 * 86400")
    assert INC.refresh(after, path, build)["dropped"] == txn.where("t < 20 * 86400").count()
    assert _table(spark.read.parquet(path)) == _table(build(after))


def test_fingerprints_cover_all_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "txn_id long, amount double, V200 double")
    one = INC.feature_fingerprint(df).first()["cache_key"]
    assert one == INC.feature_fingerprint(df.withColumn("C8", F.lit(None).cast("double"))).first()["cache_key"]
    for c in INC.FINGERPRINT_FEATURES:
        assert INC.feature_fingerprint(df.withColumn(c, F.lit(77.5))).first()["cache_key"] != one
    assert len(set(INC.FINGERPRINT_FEATURES)) == 22
