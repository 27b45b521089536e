"""Domain views over the driver tables.

The driver tables hold no payment data, so every operator reads a fixed,
deterministic re-labelling of them.  Each view exists twice: as a Spark
DataFrame (what the library runs) and as DuckDB SQL text (the independent
oracle).  Both must stay in step; ``tests/test_bindings.py`` checks it.

Transactions come from ``events``:

=============  ==============================================================
txn_id         event_id
card           user_id
channel        event_type
amount         value
t              whole epoch seconds of ``ts`` (time-zone free)
addr           integer ``k`` of the ``props`` JSON
p_email        purchaser e-mail domain, chosen by ``event_id % 7``
r_email        recipient e-mail domain, chosen by ``event_id % 5``
is_fraud       ``(value >= 120 and event_id % 3 = 0) or event_id % 61 = 0``
score          ``least(1, value / 200)``
D1             ``event_id % 4``, null when ``event_id % 11 = 0``
=============  ==============================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# --- fixed values of the binding (our own choice, shared with the oracle) ---
# purchaser domains by event_id % 7 (index 0..6); '' and null both mean missing
P_EMAIL_DOMAINS = ["gmail.com", "yahoo.com", None, "protonmail.com", "hotmail.com", "", "anonymous.com"]
# recipient domains by event_id % 5 (index 0..4)
R_EMAIL_DOMAINS = ["gmail.com", None, "yahoo.com", "outlook.com", "hotmail.com"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(idx: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        val = F.lit(v).cast("string")
        expr = F.when(idx == i, val) if expr is None else expr.when(idx == i, val)
    return expr


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the session zone."""
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def transactions_from_events(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    return events.select(
        eid.alias("txn_id"),
        F.col("user_id").alias("card"),
        F.col("event_type").alias("channel"),
        F.col("value").alias("amount"),
        epoch_seconds(F.col("ts")).alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("addr"),
        _pick(eid % 7, P_EMAIL_DOMAINS).alias("p_email"),
        _pick(eid % 5, R_EMAIL_DOMAINS).alias("r_email"),
        (((F.col("value") >= 120) & (eid % 3 == 0)) | (eid % 61 == 0)).cast("int").alias("is_fraud"),
        F.least(F.lit(1.0), F.col("value") / 200.0).alias("score"),
        F.when(eid % 11 == 0, F.lit(None)).otherwise(eid % 4).cast("long").alias("D1"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(table(spark, sf_dir, "events"))


def _sql_pick(idx: str, values: list) -> str:
    arms = " ".join(
        f"WHEN {idx} = {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CAST(CASE {arms} END AS VARCHAR)"


TXN_SQL = f"""
SELECT event_id AS txn_id, user_id AS card, event_type AS channel, value AS amount,
       CAST(floor(epoch(ts)) AS BIGINT) AS t,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS addr,
       {_sql_pick('event_id % 7', P_EMAIL_DOMAINS)} AS p_email,
       {_sql_pick('event_id % 5', R_EMAIL_DOMAINS)} AS r_email,
       CAST(((value >= 120 AND event_id % 3 = 0) OR event_id % 61 = 0) AS BIGINT) AS is_fraud,
       least(1.0, value / 200.0) AS score,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 4 END AS "D1"
FROM events
"""


def with_txn(sql: str, extra_ctes: str = "") -> str:
    """Prefix an oracle query with the ``txn`` CTE (and optional more CTEs)."""
    more = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH txn AS ({TXN_SQL}){more}\n{sql}"
