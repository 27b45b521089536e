"""Row-level feature columns: time of day, e-mail domains (PF-1, PF-2, PF-10, PF-11, PF-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference: high-risk purchaser domains.
HIGH_RISK_DOMAINS = ["protonmail.com", "mail.com", "outlook.com"]
# Night is hour >= 22 or hour <= 5 (fixed values).
NIGHT_START, NIGHT_END = 22, 5
# Reference origin of the seconds counter in the demo sample (fixed value).
DEFAULT_REF_DATE = "2017-12-01"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_features(df: DataFrame, t: str = "t") -> DataFrame:
    """PF-1: hour, day, day of week (day % 7) and night flag from whole seconds."""
    sec = F.col(t).cast("long")
    hour = (F.floor(sec / 3600) % 24).cast("int")
    day = F.floor(sec / 86400).cast("int")
    return (df.withColumn("txn_hour", hour)
              .withColumn("txn_day", day)
              .withColumn("txn_dayofweek", (F.col("txn_day") % 7).cast("int"))
              .withColumn("is_night", ((F.col("txn_hour") >= NIGHT_START)
                                       | (F.col("txn_hour") <= NIGHT_END)).cast("int")))


def is_missing(c) -> Column:
    """S5: one rule for both paths, null or empty string is missing."""
    c = _c(c)
    return c.isNull() | (c == "")


def email_features(df: DataFrame, p: str = "p_email", r: str = "r_email",
                   risky: list[str] | None = None) -> DataFrame:
    """PF-2: missing, high-risk and match flags for purchaser/recipient domains."""
    risky = risky or HIGH_RISK_DOMAINS
    out = df
    for c in (p, r):
        out = (out.withColumn(f"{c}_isnull", is_missing(c).cast("int"))
                  .withColumn(f"{c}_is_highrisk",
                              F.coalesce(F.col(c).isin(risky), F.lit(False)).cast("int")))
    match = (~is_missing(p)) & (F.col(p) == F.col(r))
    return out.withColumn("emails_match", F.coalesce(match, F.lit(False)).cast("int"))


def event_timestamp(t: str = "t", ref: str = DEFAULT_REF_DATE) -> Column:
    """PF-10: ``ref`` midnight plus ``t`` seconds, as a TIMESTAMP_NTZ (no zone shift)."""
    return F.expr(f"timestampadd(SECOND, `{t}`, TIMESTAMP_NTZ'{ref} 00:00:00')")


def bin_prefix(card: str = "card") -> Column:
    """PF-11: card BIN-like prefix, ``card // 1000``."""
    return F.floor(F.col(card) / 1000).cast("long")


def hour_bucket(t: str = "t") -> Column:
    """PF-11: hour of day from seconds, ``(t % 86400) // 3600``."""
    return F.floor(F.pmod(F.col(t), F.lit(86400)) / 3600).cast("int")


def amount_bucket(amount: str = "amount") -> Column:
    """PF-12: amount band <5, <50, <500, >=500 (fixed edges)."""
    a = F.col(amount)
    return (F.when(a < 5, "tiny_under_5").when(a < 50, "small_5_to_50")
             .when(a < 500, "medium_50_to_500").when(a >= 500, "large_500_plus"))
