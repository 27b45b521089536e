"""Score bands, decisions and band filters (PF-6, PF-7, PF-8, PF-9, ML-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference: band edges (inclusive from below, S20)
# and ensemble weights.
LOW_EDGE, MEDIUM_EDGE, HIGH_EDGE = 0.3, 0.6, 0.85
MODEL_WEIGHT, ANOMALY_WEIGHT = 0.6, 0.4


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk_band(score) -> Column:
    """PF-6: LOW / MEDIUM / HIGH / CRITICAL (null score stays null)."""
    s = _c(score)
    return (F.when(s >= HIGH_EDGE, "CRITICAL").when(s >= MEDIUM_EDGE, "HIGH")
             .when(s >= LOW_EDGE, "MEDIUM").when(s.isNotNull(), "LOW"))


def decision(score) -> Column:
    """PF-6: BLOCK for CRITICAL, REVIEW for HIGH/MEDIUM, APPROVE for LOW."""
    s = _c(score)
    return (F.when(s >= HIGH_EDGE, "BLOCK").when(s >= LOW_EDGE, "REVIEW")
             .when(s.isNotNull(), "APPROVE"))


def recommendation(score) -> Column:
    """PF-7: analyst recommendation by the same edges."""
    s = _c(score)
    return (F.when(s >= HIGH_EDGE, "Decline").when(s >= MEDIUM_EDGE, "Hold for review")
             .when(s >= LOW_EDGE, "Approve with monitoring").when(s.isNotNull(), "Approve"))


def combined_risk(model_score, anomaly_score) -> Column:
    """ML-11: 0.6 model + 0.4 anomaly, the model alone when the anomaly score is missing."""
    m, a = _c(model_score), _c(anomaly_score)
    return F.when(a.isNull(), m).otherwise(MODEL_WEIGHT * m + ANOMALY_WEIGHT * a)


def band_predicate(band: str, score: str = "score") -> Column:
    """PF-8 predicate: all / high ([0.6, 0.85)) / critical (>= 0.85) / high_critical (>= 0.6)."""
    s = F.col(score)
    if band == "critical":
        return s >= HIGH_EDGE
    if band == "high":
        return (s >= MEDIUM_EDGE) & (s < HIGH_EDGE)
    if band == "high_critical":
        return s >= MEDIUM_EDGE
    if band == "all":
        return F.lit(True)
    raise ValueError(f"unknown band {band!r}")


def filter_band(df: DataFrame, band: str, score: str = "score") -> DataFrame:
    """PF-8: keep the rows of a band."""
    return df if band == "all" else df.filter(band_predicate(band, score))


def at_or_above(df: DataFrame, band: str, score: str = "score") -> DataFrame:
    """PF-8 "X and above" view of the monitor (LOW = everything)."""
    edge = {"LOW": None, "MEDIUM": LOW_EDGE, "HIGH": MEDIUM_EDGE, "CRITICAL": HIGH_EDGE}[band]
    return df if edge is None else df.filter(F.col(score) >= edge)


def last_n_days(df: DataFrame, days: int, t: str = "t") -> DataFrame:
    """PF-9: rows with ``t >= max(t) - days * 86400`` (inclusive).  The max is a
    scalar subquery, evaluated once and pushed into the filter."""
    tmax = df.select(F.max(t)).scalar()
    return df.filter(F.col(t) >= tmax - F.lit(int(days) * 86400))
