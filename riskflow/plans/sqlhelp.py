"""Small helpers to write the DuckDB oracle texts."""

from __future__ import annotations

from riskflow.bindings import with_txn

DIGITS = 6


def round_sql(c: str, digits: int = DIGITS) -> str:
    """The Spark side's two-stage IEEE rounding (see ``registry.round_col``)."""
    s1, s2 = f"{10.0 ** (digits + 3)!r}", f"{10.0 ** digits!r}"
    return (f"CASE WHEN abs({c}) < 1e9 THEN floor(floor({c} * {s1} + 0.5) / {s1} * {s2} + 0.5) / {s2} "
            f"WHEN abs({c}) < 9e12 THEN floor({c} * {s2} + 0.5) / {s2} ELSE {c} END")


def rounded(sql: str, cols: list[str] | tuple, digits: int = DIGITS) -> str:
    """Wrap ``sql`` so the listed double columns are rounded like the Spark side."""
    if not cols:
        return sql
    rep = ", ".join(f"{round_sql(c, digits)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"


def txn_query(body: str, round_cols=(), extra_ctes: str = "") -> str:
    """``WITH txn AS (...) <body>`` with rounding of ``round_cols``."""
    return rounded(with_txn(body, extra_ctes), list(round_cols))


def feature_cte() -> str:
    """``feat`` CTE: the full engineered table (global scope), as the oracle sees it."""
    from riskflow.operators.windows import velocity_sql
    return f"""feat AS (
SELECT f.*, p.card_amt_mean, p.card_amt_std, p.card_total_txns, p.card_distinct_products,
       p.card_distinct_addr,
       CASE WHEN p.card_amt_std > 0 THEN (f.amount - p.card_amt_mean) / p.card_amt_std ELSE 0.0 END
         AS card_amt_zscore,
       CASE WHEN f.score >= 0.85 THEN 'CRITICAL' WHEN f.score >= 0.6 THEN 'HIGH'
            WHEN f.score >= 0.3 THEN 'MEDIUM' WHEN f.score IS NOT NULL THEN 'LOW' END AS risk_band
FROM (SELECT txn.*,
             CAST(floor(t / 3600) % 24 AS BIGINT) AS txn_hour,
             CAST(floor(t / 86400) AS BIGINT) AS txn_day,
             CAST(floor(t / 86400) % 7 AS BIGINT) AS txn_dayofweek,
             CAST((floor(t / 3600) % 24 >= 22 OR floor(t / 3600) % 24 <= 5) AS BIGINT) AS is_night,
             CAST((p_email IS NULL OR p_email = '') AS BIGINT) AS p_email_isnull,
             CAST(coalesce(p_email IN ('protonmail.com', 'mail.com', 'outlook.com'), false) AS BIGINT) AS p_email_is_highrisk,
             CAST((r_email IS NULL OR r_email = '') AS BIGINT) AS r_email_isnull,
             CAST(coalesce(r_email IN ('protonmail.com', 'mail.com', 'outlook.com'), false) AS BIGINT) AS r_email_is_highrisk,
             CAST(coalesce(NOT (p_email IS NULL OR p_email = '') AND p_email = r_email, false) AS BIGINT) AS emails_match,
             {velocity_sql()}
      FROM txn) f
LEFT JOIN (SELECT card, avg(amount) AS card_amt_mean, stddev_samp(amount) AS card_amt_std,
                  count(txn_id) AS card_total_txns, count(DISTINCT channel) AS card_distinct_products,
                  count(DISTINCT addr) AS card_distinct_addr
           FROM txn GROUP BY card) p USING (card))"""


def feat_query(body: str, round_cols=(), extra_ctes: str = "") -> str:
    """``WITH txn AS (...), feat AS (...) <body>``."""
    ctes = feature_cte() + (f",\n{extra_ctes}" if extra_ctes else "")
    return rounded(with_txn(body, ctes), list(round_cols))
