"""Hash sampling equals a brute-force sort by (md5(seed:id), id)."""

import hashlib

from pyspark.sql import functions as F

from paths import SF01
from riskflow import bindings as B
from riskflow.operators import sampling as S


def _md5(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


def test_first_n_by_hash_matches_bruteforce(spark):
    ids = list(range(5000))
    df = spark.createDataFrame([(i, i % 3) for i in ids], "id long, g int")
    got = sorted(r[0] for r in S.first_n_by_hash(df, 700, "id").collect())
    want = sorted(sorted(ids, key=lambda i: (_md5(i), i))[:700])
    assert got == want
    per = S.first_n_by_hash(df, spark.createDataFrame([(0, 10), (1, 0), (2, 10000)], "g int, n long"),
                            "id", by="g")
    counts = {r[0]: r[1] for r in per.groupBy("g").count().collect()}
    assert counts.get(0) == 10 and counts.get(1) is None and counts[2] == len([i for i in ids if i % 3 == 2])


def test_sample_to_rate_and_split(spark):
    txn = B.transactions(spark, SF01)
    s = S.sample_to_rate(txn, 1000, 0.05)
    c = {r[0]: r[1] for r in s.groupBy("is_fraud").count().collect()}
    assert c[1] == 50 and c[0] == 950
    h = S.split_half(txn, "txn_id")
    c2 = {r[0]: r[1] for r in h.groupBy("half").count().collect()}
    assert c2["fit"] == 5000 and c2["holdout"] == 5000


def test_rows_are_not_shuffled_by_their_class(spark):
    """Two classes must not mean two tasks: no exchange of the rows hashes the class alone."""
    df = spark.range(20000).select(F.col("id").alias("txn_id"), (F.col("id") % 20 == 0).cast("int").alias("is_fraud"),
                                   F.repeat(F.lit("x"), 50).alias("wide"))
    want = sorted(sorted((i for i in range(20000) if i % 20), key=lambda i: (_md5(i), i))[:380]
                  + sorted(range(0, 20000, 20), key=lambda i: (_md5(i), i))[:20])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = S.sample_to_rate(df, 400, 0.05)
        split = S.stratified_split(df)
        assert sorted(r["txn_id"] for r in s.collect()) == want
        for x in (s, split):  # every join of rows with class boundaries carries the broadcast hint
            plan = x._jdf.queryExecution().optimizedPlan().toString().splitlines()
            of_rows = [i for i, line in enumerate(plan) if "Join " in line and "(is_fraud" in line and "txn_id" in plan[i + 1]]
            assert of_rows and all("rightHint=(strategy=broadcast)" in plan[i] for i in of_rows), "\n".join(plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
