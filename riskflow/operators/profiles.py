"""Per-key profiles and lookups (AG-1, JN-2, WN-3, AG-8..10, JN-4, JN-9).

Profiles are partial/final hash aggregates, so a hot key never sits in one task
before the final merge.  Joining a profile back is an N x 1 equi join on the key:
the profile side has one row per key, AQE picks broadcast while it is small
(``spark.sql.adaptive.autoBroadcastJoinThreshold``) and sort-merge with skew
splitting otherwise; we never force ``broadcast`` on a side that grows with data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.quantiles import with_quantiles
from riskflow.session import materialize


def card_profile(df: DataFrame, key: str = "card", amount: str = "amount",
                 id_col: str = "txn_id", product: str = "channel", addr: str = "addr",
                 prefix: str | None = None) -> DataFrame:
    """AG-1 (scope="global", S3): mean, sample std, count, distinct products and
    distinct addresses per key over the whole table."""
    p = prefix or key
    return df.groupBy(key).agg(
        F.avg(amount).alias(f"{p}_amt_mean"),
        F.stddev_samp(amount).alias(f"{p}_amt_std"),
        F.count(id_col).alias(f"{p}_total_txns"),
        F.countDistinct(product).alias(f"{p}_distinct_products"),
        F.countDistinct(addr).alias(f"{p}_distinct_addr"),
    )


def zscore(amount: Column, mean: Column, std: Column) -> Column:
    """WN-3: (amount - mean) / std, 0 when std is null or 0."""
    return F.when(std > 0, (amount - mean) / std).otherwise(F.lit(0.0))


def attach_card_stats(df: DataFrame, key: str = "card", amount: str = "amount",
                      id_col: str = "txn_id", product: str = "channel", addr: str = "addr",
                      prefix: str | None = None, how: str = "join") -> DataFrame:
    """JN-2 + WN-3: the key profile next to every row, and the amount z-score.

    ``how="join"``: partial/final aggregate joined back (skew-tolerant: a hot
    key is merged from map-side partial buffers).  ``how="window"``: the same
    numbers as whole-partition window aggregates, which reuse the exchange and
    sort of the velocity windows on the same key - one shuffle for the whole
    feature build; distinct counts are ``size(collect_set)`` (bounded by the
    key's distinct values)."""
    p = prefix or key
    if how == "window":
        w = Window.partitionBy(key)
        out = df.select("*",
                        F.avg(amount).over(w).alias(f"{p}_amt_mean"),
                        F.stddev_samp(amount).over(w).alias(f"{p}_amt_std"),
                        F.count(id_col).over(w).alias(f"{p}_total_txns"),
                        F.size(F.collect_set(product).over(w)).cast("long").alias(f"{p}_distinct_products"),
                        F.size(F.collect_set(addr).over(w)).cast("long").alias(f"{p}_distinct_addr"))
    else:
        prof = card_profile(df, key, amount, id_col, product, addr, prefix)
        out = df.join(prof, key, "left")
    return out.withColumn(f"{p}_amt_zscore",
                          zscore(F.col(amount), F.col(f"{p}_amt_mean"), F.col(f"{p}_amt_std")))


def merchant_profile(df: DataFrame, product: str = "channel", amount: str = "amount",
                     label: str = "is_fraud") -> DataFrame:
    """AG-8: per product count, fraud rate, mean, median and p95 amount."""
    df = materialize(df.filter(F.col(product).isNotNull()).select(product, amount, label), "merchant-profile")
    sums = df.groupBy(product).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("fraud_rate"),
                                   F.avg(amount).alias("amt_mean"))
    return with_quantiles(sums, df, [(amount, {"amt_median": 0.5, "amt_p95": 0.95})], [product])


def card_summary(df: DataFrame, key: str = "card", limit: int = 20, recent: int = 5,
                 t: str = "t", id_col: str = "txn_id", amount: str = "amount",
                 label: str = "is_fraud", product: str = "channel") -> DataFrame:
    """AG-9: per key, amount stats and fraud count over its latest ``limit``
    rows (std 0 for one row) plus the latest ``recent`` of them as a list of
    structs in time order."""
    w = Window.partitionBy(key).orderBy(F.col(t).desc(), F.col(id_col).desc())
    top = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    # sort key first so array_sort orders by time (position from the newest, descending)
    recent_struct = F.struct((-F.col("_rn")).alias("pos"), F.col(id_col).alias("txn_id"),
                             F.col(amount).alias("amount"), F.col(product).alias("channel"))
    return top.groupBy(key).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.avg(amount).alias("amt_mean"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("amt_std"),
        F.min(amount).alias("amt_min"),
        F.max(amount).alias("amt_max"),
        F.sum(label).alias("fraud_count_in_history"),
        F.array_sort(F.collect_list(F.when(F.col("_rn") <= recent, recent_struct)))
         .alias("recent_transactions"),
    )


def compare_to_pattern(df: DataFrame, key: str = "card", amount: str = "amount",
                       id_col: str = "txn_id", min_rows: int = 2) -> DataFrame:
    """AG-10: each row's amount against its key's whole history: z-score with
    std floored at 1e-6, verdict ``extreme_outlier`` (|z| > 4), ``outlier``
    (|z| > 2) or ``in_pattern``; keys with fewer than ``min_rows`` rows get
    ``insufficient_history`` and a null z-score."""
    prof = df.groupBy(key).agg(F.avg(amount).alias("historical_mean"),
                               F.stddev_samp(amount).alias("historical_std"),
                               F.count(F.lit(1)).alias("hist_n"))
    out = df.select(id_col, key, amount).join(prof, key, "left")
    std = F.greatest(F.coalesce(F.col("historical_std"), F.lit(0.0)), F.lit(1e-6))
    z = (F.col(amount) - F.col("historical_mean")) / std
    return (out.withColumn("z_score", F.when(F.col("hist_n") >= min_rows, z))
               .withColumn("verdict",
                           F.when(F.col("hist_n") < min_rows, "insufficient_history")
                            .when(F.abs(F.col("z_score")) > 4, "extreme_outlier")
                            .when(F.abs(F.col("z_score")) > 2, "outlier")
                            .otherwise("in_pattern")))


def latest_velocity(features: DataFrame, key: str = "card", t: str = "t",
                    id_col: str = "txn_id", prefix: str | None = None) -> DataFrame:
    """WN-4 (check_velocity): each key's latest row and its velocity features."""
    p = prefix or key
    w = Window.partitionBy(key).orderBy(F.col(t).desc(), F.col(id_col).desc())
    cols = [c for c in features.columns if c.startswith(f"{p}_txn_count_")
            or c.startswith(f"{p}_amt_sum_") or c == f"{p}_seconds_since_last"]
    return (features.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
                    .select(key, id_col, t, *cols))


def history_for(df: DataFrame, keys: DataFrame, key: str = "card") -> DataFrame:
    """JN-4: rows of the requested keys (semi join; the key table is the filter)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def context_window(df: DataFrame, targets: DataFrame, key: str = "card", before: int = 50,
                   t: str = "t", id_col: str = "txn_id", split_seconds: int | str | None = "rows") -> DataFrame:
    """JN-9: for each target row, the rows of its key up to ``before`` positions
    earlier (and itself).  Rows are numbered per key (skew-safe: per range of
    rows plus offsets), then range-joined on ``rn between r - before and r``
    as an equi join on (key, rn bin) with bins of ``before + 1`` rows: a target
    meets only the two bins its range can touch, never all rows of its key."""
    from riskflow.operators.windows import row_numbers
    width = before + 1
    numbered = row_numbers(df, key, t, id_col, split_seconds).withColumn("_bin", F.floor(F.col("rn") / width))
    tgt = (numbered.join(targets.select(F.col(id_col).alias("_tid")),
                         F.col(id_col) == F.col("_tid"), "left_semi")
                   .select(F.col(id_col).alias("target_id"), F.col(key).alias("_k"), F.col("rn").alias("_r")))
    tgt = tgt.withColumn("_bin", F.explode(F.array_distinct(F.array(
        F.floor((F.col("_r") - before) / width), F.floor(F.col("_r") / width)))))
    j = numbered.join(tgt, numbered[key].eqNullSafe(tgt["_k"]) & (numbered["_bin"] == tgt["_bin"])
                      & numbered["rn"].between(tgt["_r"] - before, tgt["_r"]), "inner")
    return j.withColumn("offset", F.col("_r") - F.col("rn")).drop("_k", "_r", "_bin")
