"""A stand-in for a producer: writes a table as files that arrive one after
the other, so that tests can replay it in any order and with repeats."""

import os

from pyspark.sql import functions as F

from riskflow.session import scratch_path


def stage_in_slices(df, t, slice_seconds, order=None, duplicate_next=False):
    """One file per time slice (by the epoch-seconds expression ``t``), written
    oldest first or in ``order`` (slice numbers); ``duplicate_next`` delivers
    every slice again together with the next one."""
    path = scratch_path(df.sparkSession, "stream-in")
    x = df.withColumn("_t", t)
    lo, hi = x.agg(F.min("_t"), F.max("_t")).first()
    n = int((hi - lo) // slice_seconds) + 1

    def piece(k):
        return x.filter((F.col("_t") >= lo + k * slice_seconds) & (F.col("_t") < lo + (k + 1) * slice_seconds)).drop("_t")

    for out, k in enumerate(order or range(n)):
        part = piece(k)
        if duplicate_next and k > 0:
            part = part.unionByName(piece(k - 1))
        part.repartition(1).write.mode("append").parquet(os.path.join(path, f"slice={out:05d}"))
    return path
