"""Analytics aggregates (AG-2..7, AG-11..16, AG-20/21, AG-25, AG-28/29).

The reference computes about twenty rates with one pandas filter each, and
fifty threshold scans; here each report is ONE aggregate pass of conditional sums (``sum(when(...))``) with
partial (map-side) merge; its quantiles share one distributed rank selection
(``operators.quantiles``), so no task holds a group's values.

Semantics kept from the reference:
* rates are ``num / den`` with 0 when the denominator is 0;
* quantiles interpolate linearly over non-null values and are 0 when empty
  (S9: as DuckDB ``quantile_cont``);
* ``flag != 1`` puts nulls on the "not" side (S8: ``~eqNullSafe(1)``);
* grouping keys drop nulls (S7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.quantiles import quantile_values, with_quantiles
from riskflow.session import materialize


def safe_mean(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.avg(c), F.lit(0.0))


def rate(cond: Column, label: str = "is_fraud") -> Column:
    """Fraud rate among rows where ``cond`` holds; 0 when no row does."""
    num = F.sum(F.when(cond, F.col(label)).otherwise(0))
    den = F.sum(F.when(cond, 1).otherwise(0))
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0)).cast("double")


def _rule_quantiles(label: str, prefix: str) -> list[tuple[Column, dict[str, float]]]:
    """The quantiles of AG-3 (velocity), AG-6 (identity hopping) and AG-7 (amounts)."""
    y = F.col(label)
    out = [(F.col(f"{prefix}_txn_count_{w}"), {f"velocity_{w}_p50": 0.5, f"velocity_{w}_p95": 0.95})
           for w in ("1h", "24h", "7d")]
    out.append((F.col("amount"), {"amount_p50": 0.5, "amount_p95": 0.95, "amount_p99": 0.99}))
    for name, cls in (("fraud", y == 1), ("legit", ~(y == 1))):
        for what in ("addr", "products"):
            out.append((F.when(cls, F.col(f"{prefix}_distinct_{what}")), {f"{name}_card_distinct_{what}_p95": 0.95}))
        for what, column in (("zscore", f"{prefix}_amt_zscore"), ("sum_24h", f"{prefix}_amt_sum_24h")):
            out.append((F.when(cls, F.col(column)), {f"amount_{what}_{name}_p95": 0.95}))
    return out


def rule_aggregates(df: DataFrame, label: str = "is_fraud", prefix: str = "card") -> DataFrame:
    """AG-2..AG-7: the aggregate record behind rule generation, one row.  The
    columns it reads are written once, then summed in one pass and ranked in one."""
    y = F.col(label)
    fraud, legit = y == 1, ~(y == 1)
    d1 = F.col("D1")
    reads = [label, "t", "amount", "D1", "p_email_is_highrisk", "emails_match", "p_email_isnull", "is_night",
             *[f"{prefix}_{c}" for c in ("txn_count_1h", "txn_count_24h", "txn_count_7d", "distinct_addr",
                                         "distinct_products", "amt_zscore", "amt_sum_24h")]]
    df = materialize(df.select(*reads), "rule-aggregates")
    q = quantile_values(df, _rule_quantiles(label, prefix))
    sums = df.agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.coalesce(F.sum(F.when(fraud, 1)), F.lit(0)).cast("long").alias("n_fraud"),
        F.coalesce(F.avg(F.when(fraud, 1.0).otherwise(0.0)), F.lit(0.0)).alias("fraud_rate"),
        F.min("t").alias("date_min"), F.max("t").alias("date_max"),
        safe_mean(F.when(fraud, F.col(f"{prefix}_txn_count_24h"))).alias("velocity_24h_fraud_mean"),
        safe_mean(F.when(legit, F.col(f"{prefix}_txn_count_24h"))).alias("velocity_24h_legit_mean"),
        # AG-4 conditional rates
        rate(F.col("p_email_is_highrisk") == 1, label).alias("email_high_risk_fraud_rate"),
        rate(~F.col("p_email_is_highrisk").eqNullSafe(1), label).alias("email_low_risk_fraud_rate"),
        rate(F.col("emails_match") == 0, label).alias("email_mismatch_fraud_rate"),
        rate(F.col("p_email_isnull") == 1, label).alias("email_null_fraud_rate"),
        rate(d1 == 0, label).alias("d1_zero_fraud_rate"),
        rate(d1.isNotNull() & (d1 != 0), label).alias("d1_nonzero_fraud_rate"),
        rate(F.col("is_night") == 1, label).alias("night_fraud_rate"),
        rate(~F.col("is_night").eqNullSafe(1), label).alias("day_fraud_rate"))
    return sums.select("*", *[F.lit(float(v or 0.0)).alias(name) for name, v in q.items()])


def top_groups(df: DataFrame, key: str, min_n: int = 1, k: int = 5,
               label: str = "is_fraud") -> DataFrame:
    """AG-5: fraud rate per group (null keys dropped), support floor ``min_n``,
    top ``k`` by rate (ties by key).  email: min 3, k 5; product: k 5; hour: min 5, k 1."""
    g = (df.filter(F.col(key).isNotNull()).groupBy(key)
           .agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("fraud_count"))
           .filter(F.col("n") >= min_n)
           .withColumn("fraud_rate", F.col("fraud_count") / F.col("n")))
    return g.orderBy(F.col("fraud_rate").desc(), F.col(key)).limit(k)


def overview_kpis(df: DataFrame, score: str = "score", amount: str = "amount") -> DataFrame:
    """AG-11: totals, high / critical counts, volume, at-risk volume, approval rate."""
    s = F.col(score)
    total = F.count(F.lit(1))
    high = F.sum(F.when(s >= 0.6, 1).otherwise(0))
    return df.agg(
        total.alias("total"),
        high.cast("long").alias("high_risk"),
        F.sum(F.when(s >= 0.85, 1).otherwise(0)).cast("long").alias("critical"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_amount"),
        F.coalesce(F.sum(F.when(s >= 0.6, F.col(amount))), F.lit(0.0)).alias("flagged_amount"),
        F.coalesce((total - high) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("approval_rate"),
    )


def recent_kpis(df: DataFrame, n: int = 100, min_score: float = 0.0, t: str = "t",
                id_col: str = "txn_id", score: str = "score", amount: str = "amount") -> DataFrame:
    """AG-12: over the last ``n`` rows of the view ``score >= min_score``: volume,
    mean ticket, flagged count and share, highest score.  Last-n is a global
    top-k (``TakeOrderedAndProject``), then one aggregate."""
    view = df.filter(F.col(score) >= min_score)
    recent = view.orderBy(F.col(t).desc(), F.col(id_col).desc()).limit(n)
    flagged = F.sum(F.when(F.col(score) >= 0.6, 1).otherwise(0))
    return recent.agg(
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("recent_volume"),
        F.avg(amount).alias("average_ticket"),
        flagged.cast("long").alias("flagged"),
        (flagged / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("flagged_share"),
        F.max(score).alias("highest_score"),
    )


def catch_rate(df: DataFrame, threshold: float = 0.6, score: str = "score",
               label: str = "is_fraud") -> DataFrame:
    """AG-13: caught / confirmed at a threshold."""
    conf = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    caught = F.sum(F.when((F.col(score) >= threshold) & (F.col(label) == 1), 1).otherwise(0))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col(score) >= threshold, 1).otherwise(0)).cast("long").alias("flagged"),
        conf.cast("long").alias("confirmed"), caught.cast("long").alias("caught"),
        F.coalesce(caught / F.nullif(conf, F.lit(0)), F.lit(0.0)).alias("catch_rate"))


def rate_by_hour(df: DataFrame, t: str = "t", label: str = "is_fraud") -> DataFrame:
    """AG-14: fraud rate per hour of day, tier against the overall rate
    (critical >= 1.3x, high >= 1x, else normal).  The overall rate is a scalar
    subquery, not a join."""
    overall = df.select(F.avg(label)).scalar()
    hour = F.floor(F.pmod(F.col(t), F.lit(86400)) / 3600).cast("int")
    g = df.groupBy(hour.alias("hour")).agg(F.count(label).alias("total"),
                                          F.sum(label).cast("long").alias("fraud"))
    r = F.col("fraud") / F.col("total")
    return (g.withColumn("fraud_rate", r).withColumn("overall_rate", overall)
             .withColumn("tier", F.when(r >= overall * 1.3, "critical")
                                  .when(r >= overall, "high").otherwise("normal")))


def log_histogram(df: DataFrame, bins: int = 30, amount: str = "amount",
                  label: str = "is_fraud") -> DataFrame:
    """AG-15: ``bins`` log-spaced edges from max(min, 0.1) to max; counts per bin
    and class and share within class.  bin = floor of the log position, last edge
    closed; values outside the edges are not counted (as ``np.histogram``)."""
    lo = F.log10(F.greatest(df.select(F.min(amount)).scalar(), F.lit(0.1)))
    hi = F.log10(df.select(F.max(amount)).scalar())
    x = F.log10(F.col(amount))
    nb = bins - 1
    pos = (x - lo) / F.nullif(hi - lo, F.lit(0.0)) * nb      # one distinct amount: no bins
    b = F.when(F.col(amount) == F.pow(F.lit(10.0), hi), nb - 1).otherwise(F.floor(pos))
    binned = (df.filter(F.col(amount) > 0)
                .withColumn("bin", b.cast("int"))
                .filter((F.col("bin") >= 0) & (F.col("bin") < nb)))
    g = binned.groupBy("bin", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label")
    return g.withColumn("share_pct", F.col("n") / F.sum("n").over(w) * 100)


def score_histogram(df: DataFrame, bins: int = 40, score: str = "score",
                    label: str = "is_fraud") -> DataFrame:
    """AG-16: equal-width score histogram on [0, 1] per class (last bin closed)."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return (df.filter(F.col(score).isNotNull())
              .groupBy(b.alias("bin"), F.col(label).alias("label"))
              .agg(F.count(F.lit(1)).alias("n")))


def distribution_stats(df: DataFrame, col: str, group: str | None = None,
                       qs=(0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """AG-21: n, min, max, mean, median, population std and percentiles."""
    c = F.col(col)
    aggs = [F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"),
            F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")]
    specs = [(c, {"median": 0.5} | {f"p{int(round(q * 100)):02d}": q for q in qs})]
    if group:
        df = materialize(df.select(group, col), "distribution")
        return with_quantiles(df.groupBy(group).agg(*aggs), df, specs, [group])
    df = materialize(df.select(col), "distribution")
    values = quantile_values(df, specs)
    return df.agg(*aggs).select("*", *[F.lit(v).cast("double").alias(k) for k, v in values.items()])


def class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """AG-28: negatives / max(positives, 1)."""
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    return df.agg(pos.cast("long").alias("pos"), neg.cast("long").alias("neg"),
                  (neg / F.greatest(pos, F.lit(1))).alias("scale_pos_weight"))


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG-29: mean and population std per column (zero std reported as 1), long form."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, mean, std)")
    return long.withColumn("std", F.when((F.col("std") == 0) | F.col("std").isNull(), 1.0)
                           .otherwise(F.col("std")))


def activity_summary(df: DataFrame, card: str = "card", t: str = "t", channel: str = "channel",
                     amount: str = "amount", email: str = "p_email") -> DataFrame:
    """AG-25: the discovery summary as a long table ``(section, key, n)`` built in
    one pass with GROUPING SETS: BIN prefix (top 10, n >= 2), hour of day
    (n >= 3), channel, amount bucket, top 5 e-mail domains (non-null)."""
    from riskflow.functions.features import amount_bucket, bin_prefix, hour_bucket
    base = df.select(bin_prefix(card).alias("bin"), hour_bucket(t).alias("hour"),
                     F.col(channel).alias("channel"), amount_bucket(amount).alias("amount_band"),
                     F.col(email).alias("email"))
    cols = ["bin", "hour", "channel", "amount_band", "email"]
    g = base.groupingSets([[c] for c in cols], *cols).agg(
        F.grouping_id(*cols).alias("gid"), F.count(F.lit(1)).alias("n"))
    section = (F.when(F.col("gid") == 15, "bin").when(F.col("gid") == 23, "hour")
                .when(F.col("gid") == 27, "channel").when(F.col("gid") == 29, "amount_band")
                .otherwise("email"))
    key = (F.when(F.col("gid") == 15, F.concat(F.col("bin").cast("string"), F.lit("xxx")))
            .when(F.col("gid") == 23, F.format_string("%02d:00", F.col("hour")))
            .when(F.col("gid") == 27, F.col("channel"))
            .when(F.col("gid") == 29, F.col("amount_band"))
            .otherwise(F.col("email")))
    long = g.select(section.alias("section"), key.alias("key"), F.col("n")).filter(
        F.col("key").isNotNull())
    w = Window.partitionBy("section").orderBy(F.col("n").desc(), F.col("key"))
    ranked = long.withColumn("rank", F.row_number().over(w))
    keep = (((F.col("section") == "bin") & (F.col("rank") <= 10) & (F.col("n") >= 2))
            | ((F.col("section") == "hour") & (F.col("n") >= 3))
            | F.col("section").isin("channel", "amount_band")
            | ((F.col("section") == "email") & (F.col("rank") <= 5)))
    return ranked.filter(keep)
