"""Incremental reprocessing and the idempotent job chain (O-1, O-2), plus the
analyst checklist (RU-9) and subgroup statistics (AG-20)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.operators.quantiles import with_quantiles
from riskflow.operators.rules import auto_check
from riskflow.operators.windows import carried, row_ranges
from riskflow.session import materialize

CACHE_FORMAT_VERSION = "v2"
# The 22 features whose change invalidates a cached case file (our
# column names); a column that the table lacks reads as null.
FINGERPRINT_FEATURES = [
    "amount", "channel", "card", "card_amt_zscore", "card_txn_count_1h", "card_txn_count_24h",
    "card_txn_count_7d", "card_distinct_addr", "card_distinct_products", "p_email",
    "p_email_is_highrisk", "emails_match", "is_night", "txn_hour",
    "C1", "C8", "C11", "C13", "D1", "D4", "D15", "V200",
]


def _canon(df: DataFrame, c: str) -> Column:
    """Engine-independent text of a value: floats as integers of 1e-4 units
    (half-up on the binary value), other values as text, null as ``null``."""
    t = dict(df.dtypes).get(c, "void")
    col = F.col(c) if c in df.columns else F.lit(None)
    if t in ("double", "float"):
        txt = F.floor(col * 10000.0 + 0.5).cast("string")
    else:
        txt = col.cast("string")
    return F.concat(F.lit(f"{c}="), F.coalesce(txt, F.lit("null")))


def feature_fingerprint(df: DataFrame, cols: list[str] = FINGERPRINT_FEATURES, model_key: str = "rules-v1",
                        id_col: str = "txn_id") -> DataFrame:
    """O-1: ``version:id:feature_hash:model_hash`` - one key function for reads
    and writes (S19 fixed)."""
    fh = F.substring(F.sha2(F.concat_ws("|", *[_canon(df, c) for c in cols]), 256), 1, 16)
    mh = F.substring(F.sha2(F.lit(model_key), 256), 1, 8)
    return df.withColumn("feature_hash", fh).withColumn(
        "cache_key", F.concat_ws(":", F.lit(CACHE_FORMAT_VERSION), F.col(id_col).cast("string"), fh, mh))


def needs_recompute(current: DataFrame, cache: DataFrame) -> DataFrame:
    """O-1: rows whose cache key is not in the cache (anti join)."""
    return current.join(cache.select("cache_key"), "cache_key", "left_anti")


def upsert(cache: DataFrame, fresh: DataFrame, key: str = "txn_id", ts: str = "created_at") -> DataFrame:
    """O-1: union, then the latest row per key."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col("cache_key").desc())
    return (cache.unionByName(fresh).withColumn("_r", F.row_number().over(w))
                 .filter(F.col("_r") == 1).drop("_r"))


# ----------------------------------------------------------------------------- content-addressed refresh
def content_keys(txn: DataFrame, key: str = "card", t: str = "t", id_col: str = "txn_id") -> DataFrame:
    """Key, id and ``content_key`` of every row: a digest of the row and of all earlier
    rows of its key (order ``t, id``), the whole input of its prior-scope features.
    Sums of row digests run per range of rows and are carried over by a small table,
    so a hot key is many tasks; no feature is computed, and of the columns only the
    digests are dealt out."""
    text = F.to_json(F.struct(*sorted(txn.columns)), {"ignoreNullFields": "false"})
    narrow = txn.select(*dict.fromkeys([key, t, id_col]), *[F.xxhash64(F.lit(salt), text).alias(f"_d{i}") for i, salt in enumerate((1, 2))])
    halves = {f"_h{i}{j}": half for i in (0, 1)
              for j, half in enumerate((F.col(f"_d{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_d{i}", 32)))}
    x = row_ranges(narrow, [key, t, id_col], "_r").withColumns(halves)
    own = Window.partitionBy(key, "_r").orderBy(t, id_col).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = x.groupBy(F.col(key), "_r").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(h).alias(h) for h in halves])
    per = per.select(F.col(key).alias("_k"), F.col("_r").alias("_rr"), F.sum("_n").over(before).alias("_earlier"),
                     *[F.sum(h).over(before).alias(f"{h}_off") for h in halves])
    x = x.select(key, id_col, "_r", *[F.sum(h).over(own).alias(h) for h in halves])
    x = x.join(carried(per, "_earlier"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_rr")), "left")
    sums = [(F.col(h) + F.coalesce(f"{h}_off", F.lit(0))).cast("string") for h in halves]
    digest = F.substring(F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), *sums), 256), 1, 32)
    return x.select(key, id_col, digest.alias("content_key"))


def stale_features(txn: DataFrame, stored: DataFrame | None, build: Callable[[DataFrame], DataFrame], key: str = "card",
                   id_col: str = "txn_id") -> DataFrame:
    """Features, with ``content_key``, of the rows whose content no stored row
    has: a change reaches its own and later rows of its key, no others.  Only the
    rows of these keys are read again."""
    todo = materialize(content_keys(txn, key, id_col=id_col), "content-keys")
    if stored is not None:
        todo = materialize(todo.join(stored.select("content_key"), "content_key", "left_anti"), "content-new")
    rows = txn
    if stored is not None:
        touched = todo.select(F.col(key).alias("_k")).distinct()
        rows = txn.join(touched, F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    return build(rows).join(todo.select(id_col, "content_key"), id_col)


def refresh(txn: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], key: str = "card", id_col: str = "txn_id",
            part: str = "txn_day", exists: bool = True) -> dict[str, int]:
    """Bring the feature table at ``path`` (partitioned by ``part``) up to date
    with ``txn``: stale rows are recomputed, rows that went are dropped, and only
    the partitions of either are written anew.  A second run changes nothing."""
    spark = txn.sparkSession
    stored = spark.read.parquet(path) if exists else None
    fresh = materialize(stale_features(txn, stored, build, key, id_col), "refresh-new")
    if stored is None:
        changed, gone_n = fresh, 0
    else:
        gone = materialize(stored.select(id_col, part).join(txn.select(id_col), id_col, "left_anti"), "refresh-gone")
        gone_n = gone.count()
        old_place = stored.select(id_col, part).join(fresh.select(id_col), id_col, "left_semi")
        parts = fresh.select(part).unionByName(gone.select(part)).unionByName(old_place.select(part)).distinct()
        kept = (stored.join(parts, part, "left_semi").join(gone.select(id_col), id_col, "left_anti")
                .join(fresh.select(id_col), id_col, "left_anti"))
        changed = materialize(kept.select(*fresh.columns).unionByName(fresh), "refresh-parts")
        for r in parts.join(changed.select(part).distinct(), part, "left_anti").collect():  # partitions that lost their last row
            _drop_partition(spark, path, part, r[part])
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    spread(changed, part).write.mode("overwrite").partitionBy(part).parquet(path)
    return {"recomputed": fresh.count(), "dropped": gone_n}


def _drop_partition(spark: SparkSession, path: str, part: str, value) -> None:
    """Remove one partition's folder through the file system that Spark uses."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{part}={value}")
    folder.getFileSystem(conf).delete(folder, True)


def spread(df: DataFrame, part: str) -> DataFrame:
    """Rows dealt to writers by (partition, content), so that a partition of any
    size is written by its share of the tasks."""
    return df.repartitionByRange(F.col(part), F.xxhash64(*df.columns))


def run_chain(spark: SparkSession, stages: list[tuple[str, Callable[[], DataFrame], str, str]]) -> dict:
    """O-2: run ``(name, build, path, partition_col)`` stages in order.  Each
    writes with dynamic partition overwrite, so a re-run replaces exactly the
    partitions it recomputes (idempotent); counts come from ``observe`` on the
    same write, not a second pass."""
    from pyspark.sql import Observation
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    counts = {}
    for name, build, path, part in stages:
        obs = Observation(name)
        df = build().observe(obs, F.count(F.lit(1)).alias("rows"))
        spread(df, part).write.mode("overwrite").partitionBy(part).parquet(path)
        counts[name] = obs.get["rows"]
    return counts


# ----------------------------------------------------------------------------- RU-9
MIN_POSITIVE_SHAP, MAX_NEGATIVE_SHAP = 0.05, -0.3
# Checklist questions by feature, then by family.
FEATURE_QUESTIONS = [
    ("amount", "Does the cardholder usually spend such amounts?"),
    ("card_amt_zscore", "Is the amount within this card's range?"),
    ("card_txn_count_1h", "Did the cardholder make all purchases of the last hour?"),
    ("card_txn_count_24h", "Is the number of transactions of the last day normal for this card?"),
    ("card_seconds_since_last", "Is the time since the previous transaction plausible?"),
    ("is_night", "Does the cardholder buy at night?"),
    ("txn_hour", "Does the cardholder buy at this hour?"),
    ("p_email_is_highrisk", "Is the purchaser's e-mail provider trustworthy?"),
    ("r_email_is_highrisk", "Is the recipient's e-mail provider trustworthy?"),
    ("emails_match", "Do purchaser and recipient share an e-mail provider?"),
]
FAMILY_QUESTIONS = [
    ("device_identity", "Is the device known for this card?"),
    ("card_counter", "Are the card's counters in their usual range?"),
    ("engineered", "Does the transaction fit the card's history?"),
    ("verification", "Do address and identity checks hold on a second look?"),
    ("amount", "Does the amount fit the cardholder's habits?"),
    ("behavioral_velocity_timing", "Are the pace and the time of recent use normal?"),
    ("geographic", "Do billing place, delivery place and origin agree?"),
    ("card_metadata", "Do the card's data agree with its issuer's?"),
    ("email", "Are both e-mail addresses trustworthy?"),
]
AUTO_FAMILIES = ("amount", "email")
BASELINE_CHECKS = [
    "Can the cardholder be reached?",
    "Were there disputes on this card lately?",
    "Has the issuer blocked or flagged the card?",
]


def driver_checklist(attributions: DataFrame, k: int = 5, id_col: str = "txn_id") -> DataFrame:
    """RU-9: drivers kept when |shap| >= 0.05 and shap >= -0.3 (S18), the first
    ``k``; question by feature, else by family; status from the auto check when
    the rule has one, else manual; the driver's value and what it does to the
    score; plus three manual baseline checks per row.
    The question tables are fixed and tiny (broadcast)."""
    spark = attributions.sparkSession
    d = attributions.select(id_col, F.posexplode("top_drivers").alias("pos", "d")).select(
        id_col, "pos", F.col("d.feature").alias("feature"), F.col("d.family").alias("family"),
        F.col("d.shap").alias("shap"), F.col("d.value_raw").alias("value_raw"))
    d = d.filter(F.col("shap").isNotNull() & (F.abs("shap") >= MIN_POSITIVE_SHAP)
                 & (F.col("shap") >= MAX_NEGATIVE_SHAP))
    w = Window.partitionBy(id_col).orderBy("pos")
    d = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    fq = F.broadcast(spark.createDataFrame(FEATURE_QUESTIONS, "feature string, fq string"))
    gq = F.broadcast(spark.createDataFrame(FAMILY_QUESTIONS, "family string, gq string"))
    d = d.join(fq, "feature", "left").join(gq, "family", "left")
    has_auto = F.col("fq").isNotNull() | F.col("family").isin(*AUTO_FAMILIES)
    status = F.when(has_auto, auto_check(F.col("feature"), F.col("value_raw"))).otherwise("manual")
    effect = F.when(F.col("shap") > 0, "raises the score").otherwise("lowers the score")
    checks = d.select(id_col, "rank", "feature", F.coalesce("fq", "gq",
                      F.concat(F.lit("Review "), F.replace("feature", F.lit("_"), F.lit(" ")))).alias("question"),
                      effect.alias("rationale"), status.alias("status"), F.col("value_raw").cast("double").alias("actual_value"),
                      F.lit("Model-driven check").alias("category"))
    base = attributions.select(id_col, F.posexplode(F.array(*[F.lit(q) for q in BASELINE_CHECKS]))
                               .alias("i", "question")).select(
        id_col, (F.lit(100) + F.col("i")).alias("rank"), F.lit(None).cast("string").alias("feature"),
        "question", F.lit("asked for every flagged transaction").alias("rationale"), F.lit("manual").alias("status"),
        F.lit(None).cast("double").alias("actual_value"), F.lit("Baseline check").alias("category"))
    return checks.unionByName(base)


# ----------------------------------------------------------------------------- AG-20
SUBGROUP_FEATURES = ["amount", "card_txn_count_1h", "card_txn_count_24h", "card_amt_zscore",
                     "card_distinct_addr", "card_seconds_since_last", "D1", "emails_match"]


def subgroup_stats(feats: DataFrame, features: list[str] = SUBGROUP_FEATURES, top_n: int = 300,
                   score: str = "score", label: str = "is_fraud", id_col: str = "txn_id") -> DataFrame:
    """AG-20: median / p75 / p90 / p99 / mean / nonzero / n per feature for the
    top-``top_n`` by score, confirmed fraud and confirmed legit.  Features are
    unpivoted (``stack``) and aggregated per (subgroup, feature) in one pass."""
    top = feats.orderBy(F.col(score).desc(), F.col(id_col)).limit(top_n).withColumn("subgroup", F.lit("top_score"))
    fraud = feats.filter(F.col(label) == 1).withColumn("subgroup", F.lit("confirmed_fraud"))
    legit = feats.filter(F.col(label) == 0).withColumn("subgroup", F.lit("confirmed_legit"))
    allg = top.unionByName(fraud).unionByName(legit)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    long = allg.selectExpr("subgroup", f"stack({len(features)}, {pairs}) AS (feature, value)")
    long = materialize(long, "subgroups")
    v = F.col("value")
    sums = long.groupBy("subgroup", "feature").agg(
        F.avg(v).alias("mean"), F.count(F.when(v != 0, 1)).alias("count_nonzero"),
        F.count(v).alias("n"))
    return with_quantiles(sums, long, [(v, {"median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99})], ["subgroup", "feature"])
