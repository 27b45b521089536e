"""Exact quantiles by distributed rank selection (AG-3, AG-6..8, AG-20/21, ST-5,
RT-5, OD-5, ML-9, ML-12, RU-2).

``F.percentile`` keeps every distinct value of a group in one final buffer.
Here no task holds more than its share, whatever the number of values:

1. every measure of every row becomes (group, value), equal values collapse to
   one row with a count (map-side first, so a value that a third of the rows
   hold is one row a task);
2. the distinct values are range-partitioned by (group, value) and written
   once; the partition number is kept with the row;
3. counts per (group, partition) give each partition's first rank, by a window
   over at most as many rows as there are partitions;
4. only partitions that hold a wanted rank are read again, each summing its
   counts in value order; the two neighbouring ranks are interpolated.

Many measures, quantiles and groups share these passes.  Rank arithmetic and
interpolation are those of ``percentile`` / ``quantile_cont``: position
``q * (n - 1)`` over non-null values, null without any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.session import materialize

#: a measure (column name or expression) and its quantiles by output name
Spec = tuple[Column | str, Mapping[str, float]]


def _ranges(df: DataFrame, specs: Sequence[Spec], by: Sequence[str]) -> DataFrame:
    """Distinct values with their counts and their partition: (g, v, c, pid)."""
    cells = [F.struct(F.struct(F.lit(i).alias("m"), *[F.col(b) for b in by]).alias("g"),
                      (F.col(c) if isinstance(c, str) else c).cast("double").alias("v"))
             for i, (c, _) in enumerate(specs)]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.g", "x.v").where("v is not null")
    counted = long.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    return materialize(counted.repartitionByRange("g", "v").withColumn("pid", F.spark_partition_id()), "quantile-ranges")


def quantile_table(df: DataFrame, specs: Sequence[Spec], by: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``by`` (nulls are a group) that has a value of any
    measure, with one column per name of ``specs``."""
    wanted = [(m, name, float(q)) for m, (_, qs) in enumerate(specs) for name, q in qs.items()]
    ranges = _ranges(df, specs, by)
    per = ranges.groupBy("g", "pid").agg(F.sum("c").alias("n"))
    before = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
           .withColumn("total", F.sum("n").over(Window.partitionBy("g"))))
    asked = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(j).alias("j"), F.lit(q).alias("q"))
                      for j, (m, _, q) in enumerate(wanted)])
    position = (F.col("total") - 1) * F.col("a.q")
    need = (per.withColumn("a", F.explode(F.filter(asked, lambda a: a["m"] == F.col("g.m"))))
            .withColumn("up", F.explode(F.array(F.lit(False), F.lit(True))))
            .withColumn("rank", F.when(F.col("up"), F.ceil(position)).otherwise(F.floor(position)))
            .where("rank >= base and rank < base + n")
            .groupBy("g", "pid", "base")
            .agg(F.collect_list(F.struct(F.col("a.j").alias("j"), "up", "rank",
                                         (position - F.floor(position)).alias("share"))).alias("need")))
    # at most two entries a quantile and group; at most that many partitions are read
    running = Window.partitionBy("g", "pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hit = (ranges.join(need, ["g", "pid"]).withColumn("to", F.col("base") + F.sum("c").over(running))
           .withColumn("x", F.explode(F.filter("need", lambda x: (x["rank"] >= F.col("to") - F.col("c"))
                                               & (x["rank"] < F.col("to"))))))
    keys = [F.col("g").getField(b).alias(b) for b in by]
    one = hit.select(*keys, "v", "x.j", "x.up", "x.share")
    aggs = []
    for j, (_, name, _) in enumerate(wanted):
        low = F.max(F.when((F.col("j") == j) & ~F.col("up"), F.col("v")))
        high = F.max(F.when((F.col("j") == j) & F.col("up"), F.col("v")))
        share = F.max(F.when(F.col("j") == j, F.col("share")))
        aggs.append(F.when(low == high, low).otherwise((1 - share) * low + share * high).alias(name))
    return one.groupBy(*by).agg(*aggs)


def quantile_values(df: DataFrame, specs: Sequence[Spec]) -> dict[str, float | None]:
    """The quantiles of the whole frame by name (one row reaches the driver)."""
    row = quantile_table(df, specs).first()
    return row.asDict() if row else {name: None for _, qs in specs for name in qs}


def with_quantiles(aggregated: DataFrame, df: DataFrame, specs: Sequence[Spec], by: Sequence[str]) -> DataFrame:
    """``aggregated`` (one row per group of ``by``) with the quantiles of ``df`` beside."""
    q = quantile_table(df, specs, by)
    same = None
    for b in by:
        eq = F.col(f"a.{b}").eqNullSafe(F.col(f"q.{b}"))
        same = eq if same is None else same & eq
    return aggregated.alias("a").join(q.alias("q"), same, "left").select(
        *[F.col(f"a.{c}") for c in aggregated.columns], *[F.col(f"q.{c}") for c in q.columns if c not in by])
