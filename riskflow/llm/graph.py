"""Connected components as rounds of joins (no vertex or edge list reaches the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; the label is the smallest
    node of its component.

    Every round hooks each label onto the smallest neighbouring label, moves
    labels along two hooks and contracts the edges to those between different
    labels.  A round at least halves the number of labels that still have
    neighbours, so the loop ends after O(log n) rounds; nothing caps it."""
    e = materialize(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "cc-edges")
    labels = e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("label", F.col("node"))
    while not e.isEmpty():
        hooks = e.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("y"))
        hooks = materialize(hooks, "cc-hooks")
        far = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
        jump = materialize(
            hooks.join(far, "y", "left").select("x", F.coalesce("z", "y").alias("to")), "cc-jump")
        labels = materialize(
            labels.join(jump, F.col("label") == F.col("x"), "left")
            .select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        ju = jump.select(F.col("x").alias("u"), F.col("to").alias("tu"))
        jv = jump.select(F.col("x").alias("v"), F.col("to").alias("tv"))
        moved = (e.join(ju, "u", "left").join(jv, "v", "left")
                 .select(F.coalesce("tu", "u").alias("p"), F.coalesce("tv", "v").alias("q"))
                 .unionByName(hooks.join(jump.select("x", F.col("to").alias("p")), "x")
                              .join(jump.select(F.col("x").alias("y"), F.col("to").alias("q")), "y", "left")
                              .select("p", F.coalesce("q", "y").alias("q"))))
        e = materialize(moved.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
                        .where("u < v").distinct(), "cc-edges")
    return labels
