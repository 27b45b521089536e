"""A third of all rows in one key and one hour: the split plans give the same
rows and no part is much larger than the others."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskflow.operators import windows as W
from riskflow.operators.profiles import context_window
from riskflow.operators.rules import islands


@pytest.fixture(scope="module")
def burst(spark):
    rng = np.random.default_rng(2)
    n = 6000
    hot = np.arange(n) < n // 3
    t = np.where(hot, 1_000_000 + rng.integers(0, 3600, n), rng.integers(0, 30 * 86400, n))
    card = np.where(hot, 7, rng.integers(100, 300, n)).astype(float)
    card[-200:] = np.nan  # a null key is a key
    pdf = pd.DataFrame({"txn_id": rng.permutation(n), "card": card, "t": t, "amount": rng.gamma(2, 40, n).round(2),
                        "channel": rng.choice(["web", "pos", "atm"], n), "addr": rng.integers(0, 9, n)})
    df = spark.createDataFrame(pdf).withColumn("card", F.when(F.isnan("card"), None).otherwise(F.col("card")).cast("long"))
    return df.repartition(8).cache()


def _same(a, b, cols):
    x, y = (d.select(*cols).toPandas().sort_values("txn_id", ignore_index=True) for d in (a, b))
    pd.testing.assert_frame_equal(x, y, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_velocity_of_a_burst(burst):
    plain = W.velocity(burst)
    for split in (7 * 86400, 3600):
        _same(W.velocity(burst, split_seconds=split), plain, plain.columns)
    # what a (key, bucket) holds is bounded by its seconds, not its rows
    per = burst.groupBy("card", F.floor(F.col("t") / 3600)).agg(F.count("*").alias("n"), F.countDistinct("t").alias("s"))
    assert per.agg(F.max("n")).first()[0] > 1000 and per.where("s > 3600").count() == 0


def test_running_profile_numbers_and_sequences_of_a_burst(burst):
    plain = W.prior_profile(burst)
    for split in (W.ROWS, 7 * 86400):
        _same(W.prior_profile(burst, split_seconds=split), plain, plain.columns)
    numbered = W.row_numbers(burst, "card")
    _same(W.row_numbers(burst, "card", split_seconds=W.ROWS), numbered, numbered.columns)
    step = F.array("amount")
    lists = W.rolling_lists(burst, "card", step, 5, split_seconds=None).select("txn_id", F.to_json("seq").alias("seq"))
    _same(W.rolling_lists(burst, "card", step, 5).select("txn_id", F.to_json("seq").alias("seq")), lists, ["txn_id", "seq"])


def test_ranges_of_rows_are_of_about_equal_size(spark, burst):
    keep = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = [r["count"] for r in W.row_ranges(burst, ["card", "t", "txn_id"], "p").groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep[1])
    assert len(sizes) == 12 and max(sizes) <= 3 * np.median(sizes)


def test_context_of_null_and_hot_keys(burst):
    targets = burst.where("txn_id % 500 = 0")
    out = context_window(burst, targets, before=3)
    pdf = burst.toPandas().sort_values(["card", "t", "txn_id"], na_position="first")
    want = set()
    for _, g in pdf.groupby("card", dropna=False):
        ids = g["txn_id"].tolist()
        for i, x in enumerate(ids):
            if x % 500 == 0:
                want |= {(x, y) for y in ids[max(0, i - 3):i + 1]}
    assert {(r["target_id"], r["txn_id"]) for r in out.select("target_id", "txn_id").collect()} == want


def test_islands_of_a_burst(burst):
    some = burst.where("card is not null")
    plain = islands(some, "card", 600)
    for split in (86400, 1800):
        _same(islands(some, "card", 600, split_seconds=split), plain, ["txn_id", "island_start"])
