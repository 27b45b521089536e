"""Deterministic sampling and splits (ST-1..ST-7, H7).

Every row gets a seeded hash ``md5(seed || ':' || id)``; "the first n rows
by hash" is a reproducible sample that DuckDB (or any engine) can repeat.

Exact first-n per group without a global sort: the first 4 hex digits of the
hash give a bucket (65,536 buckets, uniform whatever the data, so no skew).
A per-(group, bucket) count table (bounded: groups x 65,536 rows) tells each
group its boundary bucket; rows below it are kept outright, and only rows of
the boundary bucket are ranked, by a window over that one bucket.  The rows
meet their group's boundary by a broadcast (one row a group), never by a shuffle
on the group: a class that holds most of the table stays spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.quantiles import quantile_values

DEFAULT_SEED = 42
_BUCKET_HEX = 4  # 16 bits


def seeded_hash(id_col: str, seed: int = DEFAULT_SEED) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def first_n_by_hash(df: DataFrame, n, id_col: str, seed: int = DEFAULT_SEED,
                    by: str | None = None) -> DataFrame:
    """Rows whose (hash, id) rank within group ``by`` is <= n.

    ``n`` is an int, or a DataFrame ``(by, n)`` giving one quota per group
    (a one-column, one-row DataFrame ``(n)`` when ``by`` is None), so quotas
    computed by Spark stay lazy.  Groups are classes: their boundaries, a row
    each, are broadcast.
    """
    gcol = by or "_g"
    cur = df if by else df.withColumn("_g", F.lit(0))
    h = seeded_hash(id_col, seed)
    cur = cur.withColumn("_h", h).withColumn(
        "_hb", F.conv(F.substring("_h", 1, _BUCKET_HEX), 16, 10).cast("int"))
    counts = cur.groupBy(gcol, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(gcol).orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_cum", F.sum("_c").over(w))
    if isinstance(n, DataFrame) and by is None:
        cum = cum.join(n.select(F.lit(0).alias("_g"), F.col(n.columns[0]).alias("_n")), gcol)
    elif isinstance(n, DataFrame):
        quota = n.select(F.col(n.columns[0]).alias(gcol), F.col(n.columns[1]).alias("_n"))
        cum = cum.join(quota, gcol)
    else:
        cum = cum.withColumn("_n", F.lit(int(n)))
    # boundary bucket per group: first bucket whose cumulative count reaches n
    bound = (cum.filter(F.col("_cum") >= F.col("_n"))
                .groupBy(gcol).agg(F.min(F.struct("_hb", "_cum", "_c", "_n")).alias("_b"))
                .select(gcol, F.col("_b._hb").alias("_bhb"),
                        (F.col("_b._n") - (F.col("_b._cum") - F.col("_b._c"))).alias("_need")))
    limits = cum.select(gcol, "_n").distinct().join(bound, gcol, "left")
    cur = cur.join(F.broadcast(limits), gcol)
    below = cur.filter(F.col("_bhb").isNull() | (F.col("_hb") < F.col("_bhb")))
    edge = cur.filter(F.col("_hb") == F.col("_bhb"))
    we = Window.partitionBy(gcol).orderBy("_h", id_col)
    edge = edge.withColumn("_r", F.row_number().over(we)).filter(F.col("_r") <= F.col("_need"))
    drop = ["_h", "_hb", "_bhb", "_need", "_n", "_r"] + ([] if by else ["_g"])
    return below.drop(*drop).unionByName(edge.drop(*drop))


def sample_to_rate(df: DataFrame, n: int, rate: float = 0.05, label: str = "is_fraud",
                   id_col: str = "txn_id", seed: int = DEFAULT_SEED) -> DataFrame:
    """ST-3: ``int(n * rate)`` positives and the rest negatives, each capped by
    what exists (a class with fewer rows is taken whole)."""
    n_pos = int(n * rate)
    spark = df.sparkSession
    quota = spark.createDataFrame([(1, n_pos), (0, n - n_pos)], f"{label} int, n long")
    return first_n_by_hash(df.filter(F.col(label).isin(0, 1)), quota, id_col, seed, by=label)


def baseline_sample(df: DataFrame, flagged: Column, multiplier: int = 5,
                    id_col: str = "txn_id", seed: int = DEFAULT_SEED) -> DataFrame:
    """ST-4: all flagged rows plus up to ``multiplier`` x as many unflagged rows."""
    f = df.filter(flagged)
    pool = df.filter(~flagged | flagged.isNull())
    quota = f.agg((F.count(F.lit(1)) * multiplier).alias("n"))
    return f.unionByName(first_n_by_hash(pool, quota, id_col, seed))


def stratified_split(df: DataFrame, test_frac: float = 0.2, label: str = "is_fraud",
                     id_col: str = "txn_id", seed: int = DEFAULT_SEED) -> DataFrame:
    """ST-5: per class, the first ``ceil(test_frac * n_class)`` rows by hash are
    ``test``; adds ``split`` in {train, test}."""
    sizes = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) * test_frac).cast("long").alias("n"))
    test = first_n_by_hash(df, sizes, id_col, seed, by=label).select(id_col).withColumn("_t", F.lit(1))
    return (df.join(test, id_col, "left")
              .withColumn("split", F.when(F.col("_t") == 1, "test").otherwise("train")).drop("_t"))


def time_split(df: DataFrame, test_frac: float = 0.2, t: str = "t") -> DataFrame:
    """ST-5 / S15: the latest ``test_frac`` of the time range is ``test``
    (cut at the exact quantile of t)."""
    cut = F.lit(quantile_values(df, [(t, {"cut": 1 - test_frac})])["cut"]).cast("double")
    return df.withColumn("split", F.when(F.col(t) >= cut, "test").otherwise("train"))


def cap_rows(df: DataFrame, n: int, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """ST-6: at most ``n`` rows, the first by seeded hash (whole table when smaller)."""
    return first_n_by_hash(df, n, id_col, seed)


def split_half(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """ST-7: ``fit`` = first ``floor(n / 2)`` rows by hash, the rest ``holdout``."""
    quota = df.agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("n"))
    fit = first_n_by_hash(df, quota, id_col, seed).select(id_col).withColumn("_f", F.lit(1))
    return (df.join(fit, id_col, "left")
              .withColumn("half", F.when(F.col("_f") == 1, "fit").otherwise("holdout")).drop("_f"))


def union_classes(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST-1: append two row sets by column name."""
    return a.unionByName(b, allowMissingColumns=True)
