"""Detection rules measured on data (RU-1..RU-14, JN-8).

The reference asks a language model to write rule strings and guess their
catch rate; here a rule is a Spark SQL predicate and its numbers are
measured: every rule of a rule set is evaluated in ONE aggregate pass (one
conditional sum per rule and class), then unpivoted with ``stack``.

Rule sets are small catalogues (tens of predicates), so they live on the
driver as Python tuples; the data they are measured on never does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.quantiles import quantile_values

# Fixed values that must equal the reference's severity guidance:
# block when catch rate > 30% and FPR < 1%.
BLOCK_MIN_CATCH, BLOCK_MAX_FPR = 0.30, 0.01
# Our own: below this lift a rule is only worth monitoring.
MONITOR_MAX_LIFT = 1.5
MAX_RANKED = 8


def _pred(p: str) -> Column:
    return F.coalesce(F.expr(p), F.lit(False))


def evaluate_rules(df: DataFrame, rules: list[tuple], label: str = "is_fraud") -> DataFrame:
    """RU-1: ``rules`` = [(name, predicate, family), ...].  Returns one row per
    rule: fired, tp, fp, catch_rate, fp_rate, precision, lift, severity."""
    y = F.col(label)
    aggs = [F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("_P"),
            F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("_N")]
    for i, (_, pred, _fam) in enumerate(rules):
        fired = _pred(pred)
        aggs += [F.sum(F.when(fired & (y == 1), 1).otherwise(0)).cast("long").alias(f"_tp{i}"),
                 F.sum(F.when(fired & (y == 0), 1).otherwise(0)).cast("long").alias(f"_fp{i}")]
    wide = df.agg(*aggs)
    esc = [(n.replace("'", "''"), p.replace("'", "''"), f.replace("'", "''")) for n, p, f in rules]
    stack = ", ".join(f"'{n}', '{f}', '{p}', _tp{i}, _fp{i}" for i, (n, p, f) in enumerate(esc))
    long = wide.selectExpr("_P", "_N", f"stack({len(rules)}, {stack}) AS (rule_name, family, predicate, tp, fp)")
    return with_rule_metrics(long)


def with_rule_metrics(long: DataFrame) -> DataFrame:
    P, N, tp, fp = F.col("_P"), F.col("_N"), F.col("tp"), F.col("fp")
    catch = F.coalesce(tp / F.nullif(P, F.lit(0)), F.lit(0.0))
    fpr = F.coalesce(fp / F.nullif(N, F.lit(0)), F.lit(0.0))
    prec = F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0))
    base = F.coalesce(P / F.nullif(P + N, F.lit(0)), F.lit(0.0))
    lift = F.coalesce(prec / F.nullif(base, F.lit(0.0)), F.lit(0.0))
    out = (long.withColumn("fired", tp + fp).withColumn("catch_rate", catch)
               .withColumn("fp_rate", fpr).withColumn("precision", prec).withColumn("lift", lift))
    sev = (F.when((F.col("catch_rate") > BLOCK_MIN_CATCH) & (F.col("fp_rate") < BLOCK_MAX_FPR), "block")
            .when(F.col("lift") < MONITOR_MAX_LIFT, "monitor").otherwise("review"))
    return out.withColumn("severity", sev).drop("_P", "_N")


# Feature families the reference's rule workers use, on our column names.
NUMERIC_FAMILIES = {
    "velocity": ["card_txn_count_1h", "card_txn_count_24h", "card_txn_count_7d"],
    "amount": ["amount", "card_amt_zscore", "card_amt_sum_24h"],
    "device": ["card_distinct_addr", "card_distinct_products"],
}
FLAG_RULES = [
    ("email-high-risk-domain", "p_email_is_highrisk = 1", "email"),
    ("email-mismatch", "emails_match = 0", "email"),
    ("email-missing", "p_email_isnull = 1", "email"),
    ("recipient-high-risk-domain", "r_email_is_highrisk = 1", "email"),
    ("device-first-pairing", "D1 = 0", "device"),
    ("night-activity", "is_night = 1", "timing"),
]
CANDIDATE_QUANTILES = (0.5, 0.75, 0.9)


def candidate_rules(features: DataFrame, label: str = "is_fraud",
                    quantiles=CANDIDATE_QUANTILES, top_domains: int = 3,
                    min_domain_n: int = 5) -> list[tuple]:
    """RU-2 candidates: ``feature >= q`` at quantiles of the fraud class for
    every numeric feature, the fixed flag rules, and exact-domain rules for the
    highest-rate purchaser domains.  One aggregate pass gives all thresholds
    (a bounded list: features x quantiles)."""
    y = F.col(label)
    cols = [c for fam in NUMERIC_FAMILIES.values() for c in fam]
    at = quantile_values(features, [(F.when(y == 1, F.col(c)), {f"{c} {q}": q for q in quantiles}) for c in cols])
    rules = []
    for fam, fcols in NUMERIC_FAMILIES.items():
        for c in fcols:
            seen = set()
            for q, thr in ((q, at[f"{c} {q}"]) for q in quantiles):
                if thr is None or thr in seen:
                    continue
                seen.add(thr)
                rules.append((f"{c}-ge-p{int(q * 100)}", f"{c} >= {float(thr)!r}", fam))
    rules += FLAG_RULES
    from riskflow.operators.aggregates import top_groups
    for r in top_groups(features, "p_email", min_domain_n, top_domains, label).collect():
        d = r["p_email"].replace("'", "''")
        rules.append((f"domain-{r['p_email']}", f"p_email = '{d}'", "email"))
    return rules


def propose_rules(features: DataFrame, label: str = "is_fraud", materialize_input: bool = True) -> DataFrame:
    """RU-2: candidate rules with measured catch / FPR / lift and severity.

    Three passes read the features (thresholds, top domains, measurement), so
    the input is first written once as a Parquet table in the shared folder
    (only the columns the rules use) instead of being recomputed per pass."""
    if materialize_input:
        from riskflow.session import materialize
        cols = sorted({c for fam in NUMERIC_FAMILIES.values() for c in fam}
                      | {"p_email", "p_email_is_highrisk", "emails_match", "p_email_isnull",
                         "r_email_is_highrisk", "D1", "is_night", label})
        features = materialize(features.select(*[c for c in cols if c in features.columns]), "rule-input")
    return evaluate_rules(features, candidate_rules(features, label), label)


def rank_rules(evaluated: DataFrame, cap: int = MAX_RANKED) -> DataFrame:
    """RU-3: drop rules dominated by another (catch >= and FPR <=, one strict),
    keep the most conservative (lowest FPR) rule per feature, rank by lift
    (catch / FPR) and keep ``cap``.  The rule table is a bounded catalogue, so
    its windows run on one small partition."""
    feat = F.regexp_extract("predicate", r"^\s*([A-Za-z_][A-Za-z0-9_]*)", 1)
    r = evaluated.withColumn("feature", feat)
    # best (lowest) FPR among rules with strictly higher catch, and among equal catch
    by_catch = r.groupBy("catch_rate").agg(F.min("fp_rate").alias("_m_eq"))
    w = Window.orderBy(F.col("catch_rate").desc()).rowsBetween(Window.unboundedPreceding, -1)
    by_catch = by_catch.withColumn("_m_gt", F.min("_m_eq").over(w))
    r = r.join(by_catch, "catch_rate")
    dominated = (F.col("_m_gt") <= F.col("fp_rate")) | (F.col("_m_eq") < F.col("fp_rate"))
    r = r.filter(~F.coalesce(dominated, F.lit(False))).drop("_m_eq", "_m_gt")
    wf = Window.partitionBy("feature").orderBy(F.col("fp_rate"), F.col("catch_rate").desc(),
                                               F.col("rule_name"))
    r = r.withColumn("_k", F.row_number().over(wf)).filter(F.col("_k") == 1).drop("_k")
    ratio = F.col("catch_rate") / F.greatest(F.col("fp_rate"), F.lit(1e-6))
    wr = Window.orderBy(ratio.desc(), F.col("catch_rate").desc(), F.col("rule_name"))
    return r.withColumn("rank", F.row_number().over(wr)).filter(F.col("rank") <= cap)


def composite_rules(df: DataFrame, ranked: list[tuple], label: str = "is_fraud") -> DataFrame:
    """RU-4: AND of every pair of the given (already ranked, <= 8) rules."""
    pairs = []
    for i in range(len(ranked)):
        for j in range(i + 1, len(ranked)):
            (n1, p1, f1), (n2, p2, f2) = ranked[i], ranked[j]
            pairs.append((f"{n1}+{n2}", f"({p1}) AND ({p2})", f"{f1}+{f2}"))
    return evaluate_rules(df, pairs, label) if pairs else None


def coverage(df: DataFrame, rules: list[tuple], label: str = "is_fraud") -> DataFrame:
    """RU-5: catch rate and FPR of the union (any rule fires)."""
    anyf = F.lit(False)
    for _, p, _f in rules:
        anyf = anyf | _pred(p)
    y = F.col(label)
    tp = F.sum(F.when(anyf & (y == 1), 1).otherwise(0))
    fp = F.sum(F.when(anyf & (y == 0), 1).otherwise(0))
    P = F.sum(F.when(y == 1, 1).otherwise(0))
    N = F.sum(F.when(y == 0, 1).otherwise(0))
    return df.agg(F.lit(len(rules)).alias("n_rules"), tp.cast("long").alias("tp"),
                  fp.cast("long").alias("fp"),
                  F.coalesce(tp / F.nullif(P, F.lit(0)), F.lit(0.0)).alias("catch_rate"),
                  F.coalesce(fp / F.nullif(N, F.lit(0)), F.lit(0.0)).alias("fp_rate"))


# ----------------------------------------------------------------------------- checks
# "feature op number" at the start of an indicator (RU-7)
INDICATOR_RE = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*(>=|<=|==|!=|=|>|<)\s*(-?[0-9]+(?:\.[0-9]+)?)"


def parse_indicators(df: DataFrame, text: str = "indicator") -> DataFrame:
    """RU-7: numeric check (feature, operator, value) when the indicator opens
    with ``feature op number`` and the feature is known; otherwise manual."""
    feat = F.regexp_extract(text, INDICATOR_RE, 1)
    op = F.regexp_extract(text, INDICATOR_RE, 2)
    val = F.regexp_extract(text, INDICATOR_RE, 3)
    is_num = feat != ""
    return (df.withColumn("check_type", F.when(is_num, "numeric").otherwise("manual"))
              .withColumn("feature", F.when(is_num, feat))
              .withColumn("operator", F.when(is_num, F.when(op == "=", "==").otherwise(op)))
              .withColumn("value", F.when(is_num, val.cast("double"))))


def unpivot(df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """Long form ``(id, feature, actual)`` of numeric features (``stack``)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    return df.selectExpr(f"`{id_col}`", f"stack({len(features)}, {pairs}) AS (feature, actual)")


def auto_check(feature: Column, value: Column) -> Column:
    """RU-10: rule-based status for a (feature name, raw value) driver:
    1h count >= 5, 24h count >= 20, gap < 60 s, |z| >= 3, amount >= 500,
    high-risk flag = 1, emails differ (S16 fixed: 0 is present), night, hour 0-5.
    Everything else is manual; a missing value uses the reference's defaults."""
    f = feature
    v = value
    return (F.when(f.contains("txn_count_1h"), F.when(F.coalesce(v, F.lit(0.0)) >= 5, "present").otherwise("absent"))
             .when(f.contains("txn_count_24h"), F.when(F.coalesce(v, F.lit(0.0)) >= 20, "present").otherwise("absent"))
             .when(f.contains("seconds_since_last"), F.when(F.coalesce(v, F.lit(99999.0)) < 60, "present").otherwise("absent"))
             .when(f.contains("amt_zscore"), F.when(F.abs(F.coalesce(v, F.lit(0.0))) >= 3.0, "present").otherwise("absent"))
             .when(f == "amount", F.when(F.coalesce(v, F.lit(0.0)) >= 500, "present").otherwise("absent"))
             .when(f.contains("is_highrisk"), F.when(F.coalesce(v, F.lit(0.0)) == 1, "present").otherwise("absent"))
             .when(f.contains("emails_match"), F.when(F.coalesce(v, F.lit(1.0)) == 1, "absent").otherwise("present"))
             .when(f == "is_night", F.when(F.coalesce(v, F.lit(0.0)) == 1, "present").otherwise("absent"))
             .when(f == "txn_hour", F.when(F.coalesce(v, F.lit(-1.0)).between(0, 5), "present").otherwise("absent"))
             .otherwise("manual"))


# Fixed values (the reference's calibration anchors): feature, elevated, extreme.
ELEVATION_ANCHORS = [
    ("C1", 25.0, 50.0), ("C8", 15.0, 50.0), ("C11", 10.0, None), ("C13", 10.0, None),
    ("V200", 3.0, 6.0), ("card_amt_zscore", 1.5, 3.0), ("card_txn_count_24h", 10.0, 30.0),
]


def elevation(long_features: DataFrame) -> DataFrame:
    """RU-11: ``(id, feature, actual)`` joined to the anchor table (broadcast:
    a fixed 7-row table) -> extreme / elevated / normal."""
    spark = long_features.sparkSession
    anchors = spark.createDataFrame(ELEVATION_ANCHORS, "feature string, elevated double, extreme double")
    j = long_features.join(F.broadcast(anchors), "feature")
    a = F.col("actual")
    return j.withColumn("level", F.when(a.isNull(), "unknown")
                        .when(F.col("extreme").isNotNull() & (a > F.col("extreme")), "extreme")
                        .when(a > F.col("elevated"), "elevated").otherwise("normal"))


def triage(features: DataFrame, score: str = "score") -> DataFrame:
    """RU-14: investigate when HIGH or CRITICAL, or MEDIUM with any suspicious
    signal (an auto check present on the row's own features)."""
    from riskflow.functions.bands import risk_band
    sig = None
    for c in ("card_txn_count_1h", "card_txn_count_24h", "card_seconds_since_last",
              "card_amt_zscore", "amount", "p_email_is_highrisk", "emails_match", "is_night"):
        s = auto_check(F.lit(c), F.col(c).cast("double")) == "present"
        sig = s if sig is None else (sig | s)
    band = risk_band(score)
    inv = F.when(band.isin("HIGH", "CRITICAL"), True).when(band == "MEDIUM", sig).otherwise(False)
    return features.withColumn("risk_band", band).withColumn("suspicious_signal", sig) \
                   .withColumn("investigate", inv)


# ----------------------------------------------------------------------------- bursts
def islands(df: DataFrame, key: str, gap: int, t: str = "t", id_col: str = "txn_id",
            split_seconds: int | None = None) -> DataFrame:
    """Gaps-and-islands per key: a new island starts when the previous row of
    the key is more than ``gap`` seconds earlier.  Adds ``island_start`` (the
    start time, with the key it identifies the island).

    ``split_seconds`` partitions by ``(key, floor(t / split))`` over the key's
    seconds (rows of one second share their island), so a bucket holds at most its
    seconds; the previous second across a bucket edge and the island start carried
    over from earlier buckets come from a per-bucket table."""
    if split_seconds is None:
        w = Window.partitionBy(key).orderBy(t, id_col)
        prev = F.lag(t).over(w)
        x = df.withColumn("_start", F.when(prev.isNull() | (F.col(t) - prev > gap), F.col(t)))
        return x.withColumn("island_start", F.max("_start").over(
            w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")
    seconds = df.select(F.col(key).alias("_ik"), F.col(t).alias("_it")).distinct()
    x = seconds.withColumn("_ib", F.floor(F.col("_it") / int(split_seconds)))
    rows, key_, t_ = df, key, t
    key, t = "_ik", "_it"
    per = x.groupBy(key, "_ib").agg(F.max(t).alias("_bmax"), F.min(t).alias("_bmin"))
    wb = Window.partitionBy(key).orderBy("_ib")
    per = per.withColumn("_prev_max", F.lag("_bmax").over(wb))
    w = Window.partitionBy(key, "_ib").orderBy(t)
    x = x.join(per.select(key, "_ib", "_prev_max"), [key, "_ib"], "left")
    prev = F.coalesce(F.lag(t).over(w), F.col("_prev_max"))
    x = x.withColumn("_start", F.when(prev.isNull() | (F.col(t) - prev > gap), F.col(t)))
    x = x.withColumn("_in_start", F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # last island start of each bucket, carried forward over later buckets
    last = x.groupBy(key, "_ib").agg(F.max("_start").alias("_blast"))
    last = last.withColumn("_carry", F.max("_blast").over(
        wb.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.join(last.select(key, "_ib", "_carry"), [key, "_ib"], "left")
    x = x.select(key, t, F.coalesce("_in_start", "_carry").alias("island_start"))
    return rows.join(x, (F.col(key_) == F.col(key)) & (F.col(t_) == F.col(t))).drop(key, t)


def coordinated_clusters(df: DataFrame, min_score: float = 0.6, min_size: int = 3,
                         windows: dict | None = None, split_seconds: int | None = 86400) -> DataFrame:
    """RU-12: groups of >= ``min_size`` flagged rows sharing structure, each
    a gaps-and-islands run: same BIN prefix within 1 h, same channel within
    10 min, same amount band within 10 min.  Plus same hour of day across
    >= ``min_size`` distinct cards.  Returns (kind, key, island_start, n,
    n_cards, t_first, t_last, amount_sum); members are not collected."""
    from riskflow.functions.features import amount_bucket, bin_prefix, hour_bucket
    windows = windows or {"bin": 3600, "channel": 600, "amount_band": 600}
    f = (df.filter(F.col("score") >= min_score)
           .select("txn_id", "card", "t", "amount",
                   bin_prefix("card").cast("string").alias("bin"),
                   F.col("channel"), amount_bucket("amount").alias("amount_band")))
    outs = []
    for kind, gap in windows.items():
        isl = islands(f.filter(F.col(kind).isNotNull()), kind, gap, split_seconds=split_seconds)
        g = isl.groupBy(F.col(kind).alias("key"), "island_start").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("card").alias("n_cards"),
            F.min("t").alias("t_first"), F.max("t").alias("t_last"),
            F.sum("amount").alias("amount_sum"))
        outs.append(g.withColumn("kind", F.lit(kind)))
    hr = (f.groupBy(hour_bucket("t").cast("string").alias("key"))
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("card").alias("n_cards"),
                 F.min("t").alias("t_first"), F.max("t").alias("t_last"),
                 F.sum("amount").alias("amount_sum"))
            .withColumn("island_start", F.lit(-1).cast("long"))  # not a run: whole day-hour
            .withColumn("kind", F.lit("hour"))
            .filter(F.col("n_cards") >= min_size))
    out = outs[0]
    for o in outs[1:] + [hr]:
        out = out.unionByName(o)
    return out.filter(F.col("n") >= min_size)


def _half_up(c: str, d: int) -> Column:
    """Half-up rounding of the binary value (same arithmetic in any engine)."""
    s = 10.0 ** d
    return F.floor(F.col(c) * s + 0.5) / s


def compact_rows(df: DataFrame, n: int = 30, t: str = "t", id_col: str = "txn_id") -> DataFrame:
    """RU-13: the analyst listing of the latest ``n`` rows, rounded."""
    from riskflow.functions.features import hour_bucket
    return (df.orderBy(F.col(t).desc(), F.col(id_col).desc()).limit(n)
              .select(F.col(id_col).cast("string").alias("TransactionID"),
                      _half_up("amount", 2).alias("amount"),
                      F.floor(F.col("card") / 1000).cast("long").alias("card_bin"),
                      F.coalesce(F.col("channel"), F.lit("?")).alias("channel"),
                      hour_bucket(t).alias("hour"),
                      _half_up("score", 3).alias("score"),
                      F.coalesce(F.col("card_txn_count_24h"), F.lit(0)).cast("long").alias("velocity_24h")))
