"""Readers and writers (IO-1..IO-9).

* every reader declares its schema (no inference pass over the data);
* writers never ``coalesce(1)``: output parallelism follows the data, and
  feature tables are partitioned by day with dynamic partition overwrite so a
  re-run replaces only the days it recomputed;
* scratch output goes under the shared checkpoint folder, never a
  machine-local temporary directory.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.session import scratch_path

# Raw transaction columns the feature build uses (declared, not inferred).
RAW_TXN_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.LongType()),
    T.StructField("isFraud", T.IntegerType()),
    T.StructField("TransactionDT", T.LongType()),
    T.StructField("TransactionAmt", T.DoubleType()),
    T.StructField("ProductCD", T.StringType()),
    T.StructField("card1", T.IntegerType()),
    T.StructField("addr1", T.DoubleType()),
    T.StructField("P_emaildomain", T.StringType()),
    T.StructField("R_emaildomain", T.StringType()),
    T.StructField("D1", T.DoubleType()),
])

CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("narrative", T.StringType()),
    T.StructField("indicators", T.ArrayType(T.StringType())),
    T.StructField("indicator_explanations", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("txn_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("model", T.StringType()),
])


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_TXN_SCHEMA) -> DataFrame:
    """IO-1: header CSV, the schema's columns picked by header name whatever
    their order and whatever other columns stand beside them; a column that the
    header lacks and a value that does not parse are null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    have = set(raw.columns)
    return raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
                        .alias(f.name) for f in schema.fields])


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """IO-2: Parquet, pruned to ``columns`` (the scan reads only those)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_features(df: DataFrame, path: str, day_col: str = "txn_day") -> None:
    """IO-3: Parquet partitioned by day; dynamic partition overwrite.  Rows are
    clustered by day first so each task writes few files."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (df.repartition(day_col).sortWithinPartitions(day_col)
       .write.mode("overwrite").partitionBy(day_col).parquet(path))


def write_csv_preview(df: DataFrame, path: str, order: list, n: int = 100) -> None:
    """IO-4: the first ``n`` rows by ``order`` as a headed CSV (a top-k, so one small task)."""
    df.orderBy(*order).limit(n).write.mode("overwrite").option("header", True).csv(path)


def write_case_library(cases: DataFrame, path: str | None = None) -> str:
    """Write cases as JSON lines under the shared scratch folder; returns the path."""
    path = path or scratch_path(cases.sparkSession, "case-library")
    cases.write.mode("overwrite").json(path)
    return path


def read_case_library(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """IO-5: nested JSON cases with a declared schema; malformed records are
    kept aside by PERMISSIVE mode and dropped (the reference skips bad files).
    ``multiline=True`` reads one JSON document per file."""
    df = (spark.read.schema(CASE_SCHEMA).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", "_corrupt_record")
               .option("multiLine", multiline).json(path))
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def write_stats_json(stats: DataFrame, path: str) -> None:
    """IO-6: nested statistics (structs, maps, arrays) as JSON."""
    stats.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, ts: str = "ts") -> None:
    """IO-7: append-only log partitioned by UTC date (the reference rewrites the
    whole file per row)."""
    (df.withColumn("dt", F.to_date(F.col(ts))).write.mode("append")
       .partitionBy("dt").parquet(path))


def read_log(spark: SparkSession, path: str, hours: float, as_of: datetime,
             schema: T.StructType = RUN_LOG_SCHEMA, ts: str = "ts") -> DataFrame:
    """IO-8: rows of the last ``hours`` before ``as_of`` (passed in, never
    ``now()``, so results repeat); an empty typed frame when the log is absent.
    The date partition filter prunes whole folders."""
    dated = schema if "dt" in schema.fieldNames() else T.StructType([*schema.fields, T.StructField("dt", T.DateType())])
    try:
        df = spark.read.schema(dated).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    lo = F.lit(as_of) - F.expr(f"make_dt_interval(0, 0, 0, {float(hours) * 3600})")
    return (df.filter(F.col("dt") >= F.to_date(lo))
              .filter((F.col(ts) >= lo) & (F.col(ts) <= F.lit(as_of))).drop("dt"))


def flatten_queries(doc: DataFrame) -> DataFrame:
    """IO-9: ``queries array<struct<pattern_id, pattern, queries array<string>>>``
    -> one row per (pattern_id, pattern, query)."""
    q = doc.select(F.explode("queries").alias("q"))
    return q.select(F.col("q.pattern_id").alias("pattern_id"), F.col("q.pattern").alias("pattern"),
                    F.explode("q.queries").alias("query"))
