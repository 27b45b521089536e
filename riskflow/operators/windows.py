"""Per-key window operators: rolling velocity, time since last, prior profile,
last-n / top-k per group, fixed-length sequences (WN-1..WN-11, H1).

All frames are declared with ``Window`` so Catalyst collapses frames that share
partition and order keys into one ``Window`` node behind one exchange.

Skew: a key (card) may hold a third of all rows, all in one hour.  Plain
``partitionBy(key)`` makes that key one task.  The ``split_seconds`` forms
partition by (key, bucket) instead and make every bucket self-sufficient.  A
bucket is a time range or, with ``ROWS``, a range of consecutive rows of about
equal number (``row_ranges``), so a burst is cut too:

* RANGE frames (velocity): windows are whole seconds, so rows first collapse to
  one per key and second; a (key, bucket) then holds at most its seconds, however
  many rows arrive in them.  Each second is also copied, as narrow context, into
  the ceil(W / split) following buckets, so every frame lies inside one
  (key, bucket) partition.
* running aggregates (prior profile): (n, mean, M2) per bucket are merged in
  order over the (small) per-bucket table and merged with the row's own bucket.
* gaps (time since last): the last time of the previous non-empty bucket comes
  from the same small per-bucket table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.session import materialize

ROWS = "rows"  # split by ranges of consecutive rows

# The reference's rolling windows (label -> seconds).
DEFAULT_WINDOWS = {"1h": 3600, "24h": 86400, "7d": 604800}


def row_ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` dealt to ranges of consecutive rows in ``order`` and written once,
    with the range's number: a key that leads the order is cut wherever its rows
    exceed a partition's share, whatever their times."""
    return materialize(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id().cast("long")), "row-ranges")


def carried(offsets: DataFrame, rows_before: str) -> DataFrame:
    """Offsets of (key, range) for ranges of consecutive rows whose order the key leads:
    only the first key of a range has rows in earlier ranges, so at most one row a
    range is left, and the rows meet it by a broadcast instead of a shuffle."""
    return F.broadcast(offsets.where(F.col(rows_before) > 0))


def _velocity_cols(w, windows: dict, prefix: str, id_col: str, amount: str) -> list[Column]:
    cols = []
    for label, sec in windows.items():
        wf = w.rangeBetween(-int(sec), -1)
        cols += [
            F.count(id_col).over(wf).alias(f"{prefix}_txn_count_{label}"),
            F.coalesce(F.sum(amount).over(wf), F.lit(0.0)).alias(f"{prefix}_amt_sum_{label}"),
            F.coalesce(F.max(amount).over(wf), F.lit(0.0)).alias(f"{prefix}_amt_max_{label}"),
        ]
    return cols


def velocity(df: DataFrame, key: str = "card", t: str = "t", amount: str = "amount",
             id_col: str = "txn_id", windows: dict | None = None, prefix: str | None = None,
             split_seconds: int | None = None) -> DataFrame:
    """WN-1 + WN-2: count / sum / max of ``amount`` over the prior windows
    ``RANGE [-W, -1]`` seconds (same-second peers excluded, S1) and seconds
    since the previous row (-1 when first; ties broken by ``id_col``, S2).

    ``split_seconds`` enables the skew-safe plan: one row per key and second,
    time buckets of any size (each second is also copied, narrow, into the
    ceil(W / split) later buckets its windows can reach), joined back.
    """
    windows = windows or DEFAULT_WINDOWS
    prefix = prefix or key
    since_name = f"{prefix}_seconds_since_last"
    if split_seconds is None:
        w = Window.partitionBy(key).orderBy(F.col(t))
        wl = Window.partitionBy(key).orderBy(F.col(t), F.col(id_col))
        since = F.coalesce(F.col(t) - F.lag(t).over(wl), F.lit(-1).cast("long"))
        # the (key, t, id) window first: its sort also satisfies the (key, t)
        # RANGE frames, so the whole block is one exchange and one sort
        return df.select("*", since.alias(since_name)).select(
            "*", *_velocity_cols(w, windows, prefix, id_col, amount))

    span = int(split_seconds)
    reach = -(-max(windows.values()) // span)          # buckets a window can look back
    sec = df.groupBy(F.col(key).alias("_k"), F.col(t).alias("_t")).agg(
        F.count(id_col).alias("_c"), F.sum(amount).alias("_s"), F.max(amount).alias("_m"), F.min(id_col).alias("_first"))
    sec = sec.withColumn("_vb", F.floor(F.col("_t") / span))
    # narrow context copies of each second into the `reach` following buckets
    ctx = (sec.select("_k", "_t", "_c", "_s", "_m", "_vb", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_o"))
           .withColumn("_vb", F.col("_vb") + F.col("_o")).drop("_o").withColumn("_ctx", F.lit(True)))
    both = sec.withColumn("_ctx", F.lit(False)).unionByName(ctx, allowMissingColumns=True)
    w = Window.partitionBy("_k", "_vb").orderBy("_t")
    cols = []
    for label, secs in windows.items():
        wf = w.rangeBetween(-int(secs), -1)
        cols += [F.coalesce(F.sum("_c").over(wf), F.lit(0)).alias(f"{prefix}_txn_count_{label}"),
                 F.coalesce(F.sum("_s").over(wf), F.lit(0.0)).alias(f"{prefix}_amt_sum_{label}"),
                 F.coalesce(F.max("_m").over(wf), F.lit(0.0)).alias(f"{prefix}_amt_max_{label}")]
    seen = both.select("_k", "_t", "_vb", "_first", "_ctx", (F.col("_t") - F.lag("_t").over(w)).alias("_gap"), *cols).filter(~F.col("_ctx"))
    # last second of the previous non-empty bucket, from a table of (key, bucket) rows
    per_bucket = sec.groupBy(F.col("_k").alias("_pk"), F.col("_vb").alias("_pb")).agg(F.max("_t").alias("_bmax"))
    prev = per_bucket.select("_pk", "_pb", F.lag("_bmax").over(Window.partitionBy("_pk").orderBy("_pb")).alias("_prev_t"))
    seen = seen.join(prev, F.col("_k").eqNullSafe(F.col("_pk")) & F.col("_vb").eqNullSafe(F.col("_pb")), "left")
    out = df.join(seen, F.col(key).eqNullSafe(F.col("_k")) & F.col(t).eqNullSafe(F.col("_t")))
    since = F.coalesce(F.col("_gap"), F.col(t) - F.col("_prev_t"), F.lit(-1).cast("long"))
    since = F.when(F.col(id_col) == F.col("_first"), since).otherwise(F.lit(0).cast("long"))  # the others follow in its second
    return out.withColumn(since_name, since).drop("_k", "_t", "_vb", "_first", "_ctx", "_gap", "_pk", "_pb", "_prev_t")


def row_numbers(df: DataFrame, key: str, t: str = "t", id_col: str = "txn_id",
                split_seconds: int | str | None = None, name: str = "rn") -> DataFrame:
    """Exact 1-based position of each row within its key by (t, id).  With
    ``split_seconds`` the numbering runs per (key, bucket) and adds the
    row counts of the key's earlier buckets (a small per-bucket table), so a
    hot key is numbered by many tasks (``ROWS``: of about equal size)."""
    if split_seconds is None:
        w = Window.partitionBy(key).orderBy(F.col(t), F.col(id_col))
        return df.withColumn(name, F.row_number().over(w))
    if split_seconds == ROWS:
        x = row_ranges(df, [key, t, id_col], "_rb")
    else:
        x = df.withColumn("_rb", F.floor(F.col(t) / int(split_seconds)))
    w = Window.partitionBy(key, "_rb").orderBy(F.col(t), F.col(id_col))
    cnt = x.groupBy(key, "_rb").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(key).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(F.col(key).alias("_ok"), F.col("_rb").alias("_ob"), F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_off"))
    if split_seconds == ROWS:
        off = carried(off, "_off")
    same = F.col(key).eqNullSafe(F.col("_ok")) & F.col("_rb").eqNullSafe(F.col("_ob"))
    return (x.withColumn("_in", F.row_number().over(w)).join(off, same, "left")
             .withColumn(name, (F.col("_in") + F.coalesce("_off", F.lit(0))).cast("int")).drop("_rb", "_in", "_off", "_ok", "_ob"))


def velocity_sql(windows: dict | None = None, key: str = "card", t: str = "t",
                 amount: str = "amount", id_col: str = "txn_id", prefix: str | None = None) -> str:
    """Oracle select-list for :func:`velocity` (DuckDB / ANSI RANGE frames)."""
    windows = windows or DEFAULT_WINDOWS
    prefix = prefix or key
    parts = []
    for label, sec in windows.items():
        w = f"OVER (PARTITION BY {key} ORDER BY {t} RANGE BETWEEN {int(sec)} PRECEDING AND 1 PRECEDING)"
        parts += [f"count({id_col}) {w} AS {prefix}_txn_count_{label}",
                  f"coalesce(sum({amount}) {w}, 0.0) AS {prefix}_amt_sum_{label}",
                  f"coalesce(max({amount}) {w}, 0.0) AS {prefix}_amt_max_{label}"]
    parts.append(f"coalesce({t} - lag({t}) OVER (PARTITION BY {key} ORDER BY {t}, {id_col}), -1) "
                 f"AS {prefix}_seconds_since_last")
    return ",\n       ".join(parts)


def prior_profile(df: DataFrame, key: str = "card", t: str = "t", amount: str = "amount",
                  id_col: str = "txn_id", distinct_cols: tuple = ("channel", "addr"),
                  prefix: str | None = None, split_seconds: int | str | None = None) -> DataFrame:
    """WN-11 (scope="prior", S3/S4): per key, mean / sample std / count and
    distinct counts of the strictly earlier rows (order ``t, id``).

    No history: mean = own amount, std = 0, counts = 0.  Std is 0 for one
    earlier row.  z-score is 0 when std is 0.  The deviation comes from (n,
    mean, M2), which merges without cancellation: two parts have M2 = M2a + M2b +
    (meanb - meana)^2 na nb / n.  Distinct counts are running sums of
    first-occurrence flags; with ``split_seconds`` (or ``ROWS``) everything is
    computed per bucket and merged with what earlier buckets hold, which keeps a hot key
    from being one task.  Rows with a null amount count but have no amount.
    """
    prefix = prefix or key
    cur = df
    firsts = []
    for c in distinct_cols:
        # first occurrence of (key, value): a partially aggregated min, joined back
        fo = f"_first_{c}"
        first = df.groupBy(F.col(key).alias("_fk"), F.col(c).alias("_fc")).agg(F.min(F.struct(t, id_col)).alias("_fo"))
        cur = (cur.join(first.where("_fc is not null"), F.col(key).eqNullSafe(F.col("_fk")) & (F.col(c) == F.col("_fc")), "left")
                  .drop("_fk", "_fc")
                  .withColumn(fo, F.when(F.struct(t, id_col) == F.col("_fo"), 1).otherwise(0))
                  .drop("_fo"))
        firsts.append((c, fo))
    # m: rows with an amount; s: their sum; v: their M2
    parts = {"_n": F.lit(1), "_m": F.col(amount).isNotNull().cast("long"), "_s": F.col(amount).cast("double")}
    parts.update({fo: F.col(fo) for _, fo in firsts})
    for name, expr in parts.items():
        if name not in cur.columns:
            cur = cur.withColumn(name, expr)
    zero = lambda c: F.coalesce(c, F.lit(0))
    earlier = Window.unboundedPreceding, -1
    bucket = [key] if split_seconds is None else [key, "_pb"]
    if split_seconds == ROWS:
        cur = row_ranges(cur, [key, t, id_col], "_pb")
    elif split_seconds is not None:
        cur = cur.withColumn("_pb", F.floor(F.col(t) / int(split_seconds)))
    w = Window.partitionBy(*bucket).orderBy(F.col(t), F.col(id_col)).rowsBetween(*earlier)
    cur = cur.select("*", *[zero(F.sum(k).over(w)).alias(f"_cum{k}") for k in parts],
                     zero(F.var_pop("_s").over(w)).alias("_cum_var"))
    cur = cur.withColumn("_cum_v", F.col("_cum_var") * F.col("_cum_m")).drop("_cum_var")

    def merged_m2(va, na, sa, vb, nb, sb):
        """M2 of two parts; an empty part adds nothing."""
        apart = sb / F.nullif(nb, F.lit(0)) - sa / F.nullif(na, F.lit(0))
        return va + vb + zero(apart * apart * na * nb / F.nullif(na + nb, F.lit(0)))

    if split_seconds is not None:
        per = cur.groupBy(*bucket).agg(*[zero(F.sum(k)).alias(f"_tot{k}") for k in parts],
                                       zero(F.var_pop("_s") * F.sum("_m")).alias("_tot_v"))
        wb = Window.partitionBy(key).orderBy("_pb").rowsBetween(*earlier)
        per = per.select("*", *[zero(F.sum(f"_tot{k}").over(wb)).alias(f"_off{k}") for k in parts])
        # what each bucket adds to M2 is never negative, so the running sum does not cancel
        adds = merged_m2(F.lit(0.0), F.col("_off_m"), F.col("_off_s"), F.col("_tot_v"), F.col("_tot_m"), F.col("_tot_s"))
        per = per.withColumn("_add", adds).withColumn("_off_v", zero(F.sum("_add").over(wb)))
        offsets = per.select(F.col(key).alias("_okey"), F.col("_pb").alias("_opb"), *[f"_off{k}" for k in parts], "_off_v")
        if split_seconds == ROWS:
            offsets = carried(offsets, "_off_n")
        cur = cur.join(offsets, F.col(key).eqNullSafe(F.col("_okey")) & (F.col("_pb") == F.col("_opb")), "left").drop("_okey", "_opb")
        if split_seconds == ROWS:
            cur = cur.withColumns({f"_off{k}": zero(F.col(f"_off{k}")) for k in [*parts, "_v"]})
        cur = cur.withColumn("_cum_v", merged_m2(F.col("_off_v"), F.col("_off_m"), F.col("_off_s"),
                                                 F.col("_cum_v"), F.col("_cum_m"), F.col("_cum_s")))
        for k in parts:
            cur = cur.withColumn(f"_cum{k}", F.col(f"_cum{k}") + F.col(f"_off{k}"))
    n, m, s, v = F.col("_cum_n"), F.col("_cum_m"), F.col("_cum_s").cast("double"), F.col("_cum_v")
    mean = F.when(m > 0, s / m).otherwise(F.col(amount))
    std = F.when(m > 1, F.sqrt(v / (m - 1))).otherwise(F.lit(0.0))
    out = (cur.withColumn(f"{prefix}_amt_mean", mean)
              .withColumn(f"{prefix}_amt_std", std)
              .withColumn(f"{prefix}_amt_zscore",
                          F.when(F.col(f"{prefix}_amt_std") > 0,
                                 (F.col(amount) - F.col(f"{prefix}_amt_mean"))
                                 / F.col(f"{prefix}_amt_std")).otherwise(0.0))
              .withColumn(f"{prefix}_total_txns", n.cast("long")))
    for c, fo in firsts:
        out = out.withColumn(f"{prefix}_distinct_{c}", F.col(f"_cum{fo}").cast("long"))
    drop = [c for c in out.columns if c.startswith(("_cum", "_in_", "_off", "_tot", "_first_"))]
    return out.drop(*drop, *parts.keys(), "_pb")


def last_n(df: DataFrame, key: str | None, n: int, order: str = "t", id_col: str = "txn_id") -> DataFrame:
    """WN-4 / SL-2: the ``n`` latest rows per key (global tail when key is None);
    ties broken by id, newest first.  Spark plans this as ``WindowGroupLimit``."""
    if key is None:
        return df.orderBy(F.col(order).desc(), F.col(id_col).desc()).limit(n)
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(id_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_k_per_group(df: DataFrame, key, k: int, order: list[Column]) -> DataFrame:
    """WN-8: first ``k`` rows per group by ``order`` (``WindowGroupLimit`` partial + final)."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sequences(df: DataFrame, key: str, features: list[str], n: int = 10, t: str = "t",
              id_col: str = "txn_id", complete_only: bool = True,
              split_seconds: int | str | None = ROWS) -> DataFrame:
    """WN-5: rolling windows of the last ``n`` rows per key (current included),
    as ``array<array<double>>`` (skew-safe via ``rolling_lists``).
    ``complete_only`` keeps windows of size ``n``; otherwise WN-6 left-pads
    with the first step."""
    step = F.array(*[F.col(c).cast("double") for c in features])
    out = rolling_lists(df, key, step, n, t, id_col, split_seconds=split_seconds, name="seq")
    if complete_only:
        return out.filter(F.size("seq") == n)
    return out.withColumn("seq", pad_sequence(F.col("seq"), n))


def pad_sequence(seq: Column, n: int) -> Column:
    """WN-6: left-pad a sequence to ``n`` steps by repeating its first step."""
    return F.concat(F.array_repeat(F.element_at(seq, 1), F.greatest(F.lit(0), F.lit(n) - F.size(seq))), seq)


def rolling_lists(df: DataFrame, key: str, step: Column, n: int, t: str = "t", id_col: str = "txn_id",
                  split_seconds: int | str | None = ROWS, rows_per_bucket: int = 4096,
                  name: str = "seq") -> DataFrame:
    """WN-5: per row, the list of ``step`` values of its key's last ``n`` rows
    (current included), in (t, id) order.

    Skew-safe: rows are numbered per key (``row_numbers``), cut into buckets
    of ``rows_per_bucket`` consecutive rows, and the last ``n - 1`` rows of
    each bucket are copied as context into the next one, so every frame lies
    in one (key, bucket) partition - a hot key becomes many tasks.  With
    ``split_seconds=None`` it is the plain ``rowsBetween(-(n-1), 0)`` window."""
    if split_seconds is None:
        w = Window.partitionBy(key).orderBy(F.col(t), F.col(id_col)).rowsBetween(-(n - 1), 0)
        return df.withColumn(name, F.collect_list(step).over(w))
    B = max(int(rows_per_bucket), n)
    x = row_numbers(df, key, t, id_col, split_seconds, "_rn").withColumn("_step", step)
    x = x.withColumn("_sb", F.floor((F.col("_rn") - 1) / B)).withColumn("_ctx", F.lit(False))
    ctx = (x.filter(F.pmod(F.col("_rn") - 1, F.lit(B)) >= B - (n - 1))
            .select(key, "_rn", "_step", (F.col("_sb") + 1).alias("_sb"), F.lit(True).alias("_ctx")))
    both = x.unionByName(ctx, allowMissingColumns=True)
    w = Window.partitionBy(key, "_sb").orderBy("_rn").rowsBetween(-(n - 1), 0)
    return (both.withColumn(name, F.collect_list("_step").over(w)).filter(~F.col("_ctx"))
                .drop("_rn", "_step", "_sb", "_ctx"))
