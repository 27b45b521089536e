"""Model operators on Spark ML (ML-1, ML-2, ML-5..ML-8, ML-13, PF-4, PF-5,
PF-13..PF-15, AG-17, JN-3, WN-9).

Re-aims (SURVEY H8): boosted trees are Spark ML ``GBTClassifier``; the
per-row attribution is exact for a logistic model on standardised features,
``w_i (x_i - mean_i) / std_i`` (the SHAP value of a linear model under
feature independence), computed as column expressions - no Python per row.
Fitted state (coefficients, means, dictionaries) is small and bounded by the
number of features / categories.
"""

from __future__ import annotations

import re

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.session import materialize

MISSING_NUM, MISSING_CAT = -999.0, -1
#: search space of ``tune``: depths, iterations, step sizes
TUNE_GRID = [3, 5], [10, 20], [0.1, 0.3]

# Numeric model features of the engineered table.
MODEL_FEATURES = [
    "amount", "txn_hour", "txn_dayofweek", "is_night",
    "card_txn_count_1h", "card_txn_count_24h", "card_txn_count_7d",
    "card_amt_sum_1h", "card_amt_sum_24h", "card_amt_sum_7d", "card_amt_max_24h",
    "card_seconds_since_last", "card_amt_mean", "card_amt_std", "card_amt_zscore",
    "card_total_txns", "card_distinct_products", "card_distinct_addr",
    "p_email_isnull", "p_email_is_highrisk", "r_email_isnull", "r_email_is_highrisk",
    "emails_match", "D1",
]
CATEGORICAL = ["channel", "p_email", "r_email"]


# ----------------------------------------------------------------------------- PF-4 / PF-5
def align_schema(df: DataFrame, cols: list[str], default: float = MISSING_NUM,
                 keep: list[str] | None = None) -> DataFrame:
    """PF-4: exactly ``cols`` as doubles; absent or null -> ``default``."""
    have = set(df.columns)
    out = [F.coalesce(F.col(c).cast("double"), F.lit(default)).alias(c) if c in have
           else F.lit(default).alias(c) for c in cols]
    return df.select(*(keep or []), *out)


def fit_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """PF-5 (fit once, S11 fixed): codes 0.. in alphabetical order per column."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
               .filter(F.col("value").isNotNull()).distinct() for c in cols]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    w = Window.partitionBy("column").orderBy("value")
    return d.withColumn("code", (F.dense_rank().over(w) - 1).cast("int"))


def apply_dictionary(df: DataFrame, dictionary: DataFrame, cols: list[str]) -> DataFrame:
    """PF-5: replace each categorical column by its code; unseen or null -> -1.
    Adaptive execution picks the join by the dictionary's measured size."""
    out = df
    for c in cols:
        d = dictionary.filter(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}_code"))
        out = (out.join(d, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
                  .withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(MISSING_CAT)))
                  .drop(f"_v_{c}"))
    return out


# ----------------------------------------------------------------------------- ML-1/2/5/6
def with_class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """AG-28 as a row weight: positives weigh neg / max(pos, 1) (a scalar subquery)."""
    w = df.select((F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
                   / F.greatest(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.lit(1)))).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, w).otherwise(F.lit(1.0)))


def _training_table(df: DataFrame, name: str) -> DataFrame:
    """Iterative learners read their input many times: write it once as a
    compact Parquet table in the shared folder (lineage cut, few files).  The
    class weight, a sum over the label, is added to the written table, so that
    the input is computed once."""
    return materialize(df, name)


def train_classifier(df: DataFrame, features: list[str], label: str = "is_fraud",
                     kind: str = "gbt", max_iter: int = 30, seed: int = 42) -> PipelineModel:
    """ML-1: class-weighted boosted trees (``kind="gbt"``) or logistic regression."""
    data = with_class_weight(_training_table(align_schema(df, features, keep=[label]), "train"), label)
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    if kind == "gbt":
        clf = GBTClassifier(labelCol=label, weightCol="weight", maxIter=max_iter, maxDepth=5, seed=seed)
    else:
        clf = LogisticRegression(labelCol=label, weightCol="weight", maxIter=max_iter)
    return Pipeline(stages=[va, clf]).fit(data.withColumn(label, F.col(label).cast("double")))


def score(df: DataFrame, model: PipelineModel, features: list[str], out: str = "model_score",
          keep: list[str] | None = None) -> DataFrame:
    """ML-2: probability of the positive class, schema aligned first."""
    aligned = align_schema(df, features, keep=keep or [c for c in df.columns if c not in features])
    pred = model.transform(aligned)
    return pred.withColumn(out, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def tune(df: DataFrame, features: list[str], label: str = "is_fraud", parallelism: int = 4,
         seed: int = 42) -> DataFrame:
    """ML-5: grid search maximising area under PR on a validation split, models
    fitted in parallel.  Returns one row per grid point with its metric.

    Boosting adds one tree at a time, so the model of fewer iterations is the first
    trees of the one with more: one fit per (depth, step size) serves every number of
    iterations, and one pass over the validation rows gives the margins after each."""
    data = with_class_weight(_training_table(align_schema(df, features, keep=[label]), "tune"), label) \
        .withColumn(label, F.col(label).cast("double"))
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    data = va.transform(data.withColumn("_rand", F.rand(seed))).select(label, "weight", "_rand", "features")
    train, valid = data.where("_rand < 0.8"), data.where("_rand >= 0.8")  # read from the written table each time
    ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR", rawPredictionCol="margin")
    depths, iterations, steps = TUNE_GRID

    def fit(point):
        depth, step = point
        model = GBTClassifier(labelCol=label, weightCol="weight", seed=seed, maxDepth=depth, maxIter=max(iterations),
                              stepSize=step).fit(train)
        margins = materialize(staged_margins(valid, model, iterations).select(label, *[f"margin_{n}" for n in iterations]),
                              "tune-margins")
        return [ev.evaluate(margins.select(label, F.col(f"margin_{n}").alias("margin"))) for n in iterations]

    points = [(d, s) for d in depths for s in steps]
    with ThreadPool(parallelism) as pool:
        found = dict(zip(points, pool.map(inheritable_thread_target(df.sparkSession)(fit), points)))
    rows = [(d, n, s, float(found[d, s][iterations.index(n)])) for d in depths for n in iterations for s in steps]
    return df.sparkSession.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "trial int, max_depth int, max_iter int, step_size double, area_under_pr double")


def staged_margins(df: DataFrame, model: GBTClassificationModel, iterations: list[int]) -> DataFrame:
    """``df`` (with ``features``) with ``margin_<n>``: the weighted sum of the first n
    trees, what a model of n iterations gives as its raw prediction."""
    out, sums = df, F.lit(0.0)
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights), 1):
        out = tree.setPredictionCol(f"_tree_{i}").transform(out)
        sums = sums + F.col(f"_tree_{i}") * F.lit(float(weight))
        if i in iterations:
            out = out.withColumn(f"margin_{i}", sums)
    return out.drop(*[f"_tree_{i}" for i in range(1, len(model.trees) + 1)])


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """ML-6: (feature, importance) long table, largest first."""
    clf = model.stages[-1]
    vals = (clf.featureImportances.toArray().tolist() if hasattr(clf, "featureImportances")
            else [abs(x) for x in clf.coefficients.toArray().tolist()])
    from pyspark.sql import SparkSession
    return SparkSession.active().createDataFrame(list(zip(features, [float(v) for v in vals])),
                                 "feature string, importance double")


# ----------------------------------------------------------------------------- PF-13..15
# Attribution families, first match on the name wins.
FAMILIES = [
    ("^D[0-9]+$", "device_identity"),
    ("^C[0-9]+$", "card_counter"),
    ("^V[0-9]+$", "engineered"),
    ("^M[0-9]+$", "verification"),
    ("[aA][mM][tT]|^amount$", "amount"),
    ("txn_count|txn_hour|is_night|seconds_since", "behavioral_velocity_timing"),
    ("^addr|^dist", "geographic"),
    ("^card", "card_metadata"),
    ("email", "email"),
]
# Report categories, first match on the lower-cased name wins.
CATEGORIES = [
    ("txn_count|velocity|freq", "Velocity"),
    ("amt.*(zscore|ratio|mean|std)|(zscore|ratio|mean|std).*amt", "Amount anomaly"),
    ("transactionamt|^amt$|^amount$", "Amount"),
    ("^card", "Card"),
    ("emaildomain|^p_email|^r_email", "Email"),
    ("^addr|^dist[12]$", "Address / geo"),
    ("^device|^id_", "Device / identity"),
    ("transactiondt|hour|dow|day_of_week", "Time"),
    ("^product", "Channel"),
    ("^[vcdm][0-9]", "Anonymized (Vesta engineered)"),
]


def _first_match(name: Column, table: list[tuple[str, str]], default: str) -> Column:
    return F.coalesce(*[F.when(name.rlike(pattern), value) for pattern, value in table], F.lit(default))


def feature_family(name: Column) -> Column:
    """PF-13: attribution family of a feature name."""
    return _first_match(name, FAMILIES, "other")


def importance_category(name: Column) -> Column:
    """PF-14: report category of a feature name."""
    return _first_match(F.lower(name), CATEGORIES, "Other")


# Display names of the engineered features (our column names).
NICE_NAMES = [
    ("amount", "Transaction amount"), ("channel", "Channel"), ("card", "Card BIN"),
    ("addr", "Billing region"), ("p_email", "Purchaser email domain"),
    ("r_email", "Recipient email domain"),
    ("card_txn_count_1h", "Transactions on this card (1h)"),
    ("card_txn_count_24h", "Transactions on this card (24h)"),
    ("card_txn_count_7d", "Transactions on this card (7d)"),
    ("card_amt_zscore", "Amount vs card's typical (z-score)"),
    ("card_amt_sum_24h", "Total spend on card (24h)"),
    ("card_seconds_since_last", "Seconds since last txn"),
    ("card_total_txns", "Total card lifetime txns"),
    ("card_distinct_addr", "Distinct shipping regions on card"),
    ("card_distinct_products", "Distinct product types on card"),
    ("is_night", "Night-time transaction flag"), ("txn_hour", "Transaction hour of day"),
    ("txn_dayofweek", "Day of week"), ("emails_match", "Purchaser/recipient email match"),
    ("p_email_is_highrisk", "Purchaser email is high-risk domain"),
    ("r_email_is_highrisk", "Recipient email is high-risk domain"),
]


def humanize(long_df: DataFrame, name: str = "feature") -> DataFrame:
    """PF-15: display label via a fixed lookup table (broadcast: bounded, fixed
    size), else the D/C/V/M patterns, else underscores to spaces."""
    spark = long_df.sparkSession
    lut = F.broadcast(spark.createDataFrame(NICE_NAMES, f"{name} string, _nice string"))
    n = F.col(name)
    fallback = (F.when(n.rlike("^D[0-9]+$"), F.concat(n, F.lit(" (device/identity field)")))
                 .when(n.rlike("^C[0-9]+$"), F.concat(n, F.lit(" (card-related counter)")))
                 .when(n.rlike("^V[0-9]+$"), F.concat(n, F.lit(" (Vesta engineered feature)")))
                 .when(n.rlike("^M[0-9]+$"), F.concat(n, F.lit(" (match/verification flag)")))
                 .otherwise(F.regexp_replace(n, "_", " ")))
    return long_df.join(lut, name, "left").withColumn("label", F.coalesce("_nice", fallback)).drop("_nice")


def format_value(v: Column) -> Column:
    """PF-15: "missing" for null/NaN, "0" for |v| < 1e-9, else 4 significant
    digits in the ``%g`` style (fixed for exponents -4..3, else scientific,
    trailing zeros removed)."""
    def digits(sci: Column) -> Column:
        exp = F.regexp_extract(sci, r"e([+-][0-9]+)$", 1).cast("int")
        return F.transform(F.array(exp), lambda e: given(sci, e))[0]  # named once: not computed again for each case

    def given(sci: Column, exp: Column) -> Column:
        fixed = None
        for e in range(-4, 4):
            s = F.format_string(f"%.{3 - e}f", v)
            fixed = F.when(exp == e, s) if fixed is None else fixed.when(exp == e, s)
        fixed = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        sci_clean = F.regexp_replace(sci, r"\.?0+e", "e")
        return F.when((exp >= -4) & (exp < 4), fixed).otherwise(sci_clean)

    text = F.transform(F.array(F.format_string("%.3e", v)), digits)[0]
    return F.when(v.isNull() | F.isnan(v), "missing").when(F.abs(v) < 1e-9, "0").otherwise(text)


def importance_by_category(imp: DataFrame, top: int = 3) -> DataFrame:
    """AG-17 + JN-3: per category the importance sum, % of total, and the top
    ``top`` feature names (ties by name) joined to it."""
    x = imp.filter(F.col("importance") > 0).withColumn("category", importance_category(F.col("feature")))
    g = x.groupBy("category").agg(F.sum("importance").alias("importance"))
    tot = x.select(F.sum("importance")).scalar()
    g = g.withColumn("pct", F.col("importance") / tot * 100)
    w = Window.partitionBy("category").orderBy(F.col("importance").desc(), F.col("feature"))
    tops = (x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
              .groupBy("category").agg(F.array_sort(F.collect_list(F.struct("_r", "feature"))).alias("_t"))
              .select("category", F.array_join(F.transform("_t", lambda s: s["feature"]), ", ")
                      .alias("top_features")))
    return g.join(tops, "category", "left")


# ----------------------------------------------------------------------------- ML-7 / ML-8
@dataclass
class LinearExplainer:
    features: list[str]
    means: list[float]
    stds: list[float]
    weights: list[float]
    intercept: float


def fit_linear_explainer(df: DataFrame, features: list[str], label: str = "is_fraud",
                         max_iter: int = 50) -> LinearExplainer:
    """Standardise with population mean / std (AG-29, zero std -> 1), fit a
    class-weighted logistic model on the standardised columns.  ``df`` is computed once."""
    aligned = _training_table(align_schema(df, features, keep=[label]), "explainer")
    stats = aligned.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(features)],
                        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(features)]).first()
    means = [float(stats[f"m_{i}"] or 0.0) for i in range(len(features))]
    stds = [float(stats[f"s_{i}"]) if stats[f"s_{i}"] else 1.0 for i in range(len(features))]
    z = aligned.select(F.col(label).cast("double").alias(label), *[
        ((F.col(c) - means[i]) / stds[i]).alias(c) for i, c in enumerate(features)])
    z = with_class_weight(z, label)
    va = VectorAssembler(inputCols=features, outputCol="features")
    lr = LogisticRegression(labelCol=label, weightCol="weight", maxIter=max_iter, standardization=False)
    m = lr.fit(va.transform(z))
    return LinearExplainer(features, means, stds, m.coefficients.toArray().tolist(), float(m.intercept))


def attribute(df: DataFrame, ex: LinearExplainer, id_col: str = "txn_id", k: int = 8) -> DataFrame:
    """ML-7 + ML-8: per row, additive log-odds contributions of every feature,
    the top ``k`` drivers by |contribution|, totals per family, positive and
    negative sums, signal balance (2x rule) and the base value."""
    aligned = align_schema(df, ex.features, keep=[id_col])
    family = {c: next((f for p, f in FAMILIES if re.search(p, c)), "other") for c in ex.features}
    place = {c: i for i, c in enumerate(sorted(ex.features))}  # equal contributions go by name
    out = aligned.select("*", *[(F.lit(w) * (F.col(c) - F.lit(m)) / F.lit(s)).alias(f"_c_{c}")
                                for c, m, s, w in zip(ex.features, ex.means, ex.stds, ex.weights)])
    ranked = F.sort_array(F.array(*[F.struct(
        F.abs(F.col(f"_c_{c}")).alias("size"), F.lit(-place[c]).alias("place"), F.lit(c).alias("feature"),
        F.col(c).alias("value_raw"), F.col(f"_c_{c}").alias("shap"), F.lit(family[c]).alias("family"))
        for c in ex.features]), asc=False)
    top = F.transform(F.slice(ranked, 1, k), lambda s: F.struct(
        s["feature"].alias("feature"), s["value_raw"].alias("value_raw"), s["shap"].alias("shap"),
        F.when(s["shap"] > 0, "increased fraud probability").otherwise("decreased fraud probability")
         .alias("direction"),
        s["family"].alias("family")))
    fam_of = {}
    for c in ex.features:
        fam_of.setdefault(family[c], []).append(c)
    fam_cols = {f: sum((F.col(f"_c_{c}") for c in cs[1:]), F.col(f"_c_{cs[0]}")) for f, cs in fam_of.items()}
    pos = sum((F.greatest(F.col(f"_c_{c}"), F.lit(0.0)) for c in ex.features), F.lit(0.0))
    neg = sum((F.least(F.col(f"_c_{c}"), F.lit(0.0)) for c in ex.features), F.lit(0.0))
    res = out.select(
        id_col, top.alias("top_drivers"),
        F.map_from_arrays(F.array(*[F.lit(f) for f in fam_cols]), F.array(*fam_cols.values()))
         .alias("by_family"),
        pos.alias("total_positive_contribution"), neg.alias("total_negative_contribution"),
        F.lit(ex.intercept).alias("base_value"))
    bal = (F.when(F.abs("total_positive_contribution") > 2 * F.abs(F.col("total_negative_contribution")),
                  "fraud_signals_dominate")
            .when(F.abs("total_negative_contribution") > 2 * F.abs(F.col("total_positive_contribution")),
                  "legit_signals_dominate").otherwise("mixed"))
    return res.withColumn("signal_balance", bal).withColumn(
        "log_odds", F.col("base_value") + F.col("total_positive_contribution")
        + F.col("total_negative_contribution"))


# ----------------------------------------------------------------------------- ML-13 / WN-9
def cluster_nearest(df: DataFrame, features: list[str], id_col: str = "txn_id", max_k: int = 400,
                    seed: int = 42) -> DataFrame:
    """ML-13 + WN-9: scale (population std), k-means with k = min(400, n // 5),
    then per cluster the row nearest its centroid (``min_by``, ties by id)."""
    aligned = align_schema(df, features, keep=[id_col]).fillna(0.0)
    n = aligned.count()
    k = max(2, min(max_k, n // 5))
    stats = aligned.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    z = F.array(*[((F.col(c) - (stats[f"m{i}"] or 0.0)) / (stats[f"s{i}"] or 1.0))
                  for i, c in enumerate(features)])
    x = _training_table(aligned.select(id_col, z.alias("z")), "kmeans").select(
        id_col, array_to_vector("z").alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(x)
    centers = model.clusterCenters()
    pred = model.transform(x)
    spark = df.sparkSession
    cdf = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)],
                                "cluster int, center array<double>")
    j = pred.withColumn("v", vector_to_array("features")).join(F.broadcast(cdf), "cluster")
    dist = F.sqrt(F.aggregate(F.zip_with("v", "center", lambda a, b: (a - b) * (a - b)),
                              F.lit(0.0), lambda acc, y: acc + y))
    j = j.withColumn("dist", dist)
    return j.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.min_by(F.col(id_col), F.struct("dist", id_col)).alias(id_col),
        F.min("dist").alias("dist"))
