"""Sequence anomaly scoring (ML-9, ML-10, ML-12, ML-14, WN-5..WN-7).

Re-aim of the reference's LSTM autoencoder (SURVEY H8): each card's rolling
window of the last ``n`` transactions (WN-5, a ``rowsBetween(-(n-1), 0)``
frame) is scaled per feature (AG-29, fitted on legitimate rows), flattened,
and reconstructed by a linear autoencoder - Spark ML ``PCA`` fitted on
legitimate training windows.  Error = mean squared residual (S13: the mean
everywhere); threshold = p95 of legitimate errors on a *held-out* slice
(S14 fixed); score = logistic ``1 / (1 + exp(-3 (e / thr - 1)))``.

The covariance behind the PCA is a distributed aggregate; the (n*f x r)
components are a bounded model shipped with the pandas UDF that applies it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.operators.quantiles import quantile_values
from riskflow.operators.sampling import time_split
from riskflow.operators.windows import rolling_lists
from riskflow.session import materialize

# The reference's 16 step features, on our column names.
SEQ_FEATURES = [
    "amount", "txn_hour", "is_night", "card_txn_count_1h", "card_txn_count_24h",
    "card_txn_count_7d", "card_amt_sum_1h", "card_amt_sum_24h", "card_amt_max_24h",
    "card_seconds_since_last", "card_amt_mean", "card_amt_zscore", "card_distinct_products",
    "card_distinct_addr", "p_email_isnull", "emails_match",
]
SEQ_LEN = 10


@dataclass
class SequenceModel:
    features: list[str]
    n: int
    means: list[float]
    stds: list[float]
    mean_vec: np.ndarray
    components: np.ndarray      # (r, n * f)
    threshold: float


def scaled_windows(feats: DataFrame, model_means, model_stds, features=SEQ_FEATURES, n=SEQ_LEN,
                   key: str = "card", t: str = "t", id_col: str = "txn_id",
                   complete_only: bool = True) -> DataFrame:
    """WN-5 / WN-6: per row, its key's last ``n`` scaled steps flattened to
    ``n * f`` values (incomplete windows dropped, or left-padded with the
    first step)."""
    step = F.array(*[((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s)
                     for c, m, s in zip(features, model_means, model_stds)])
    x = rolling_lists(feats, key, step, n, t, id_col, name="_seq")
    if complete_only:
        x = x.filter(F.size("_seq") == n)
    else:
        x = x.withColumn("_seq", F.concat(
            F.array_repeat(F.element_at("_seq", 1), F.greatest(F.lit(0), F.lit(n) - F.size("_seq"))), "_seq"))
    return x.withColumn("window", F.flatten("_seq")).drop("_seq")


def _scaler(df: DataFrame, features, label: str):
    legit = df.filter(F.col(label) == 0)
    r = legit.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"m{i}")
                    for i, c in enumerate(features)],
                  *[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"s{i}")
                    for i, c in enumerate(features)]).first()
    means = [float(r[f"m{i}"] or 0.0) for i in range(len(features))]
    stds = [float(r[f"s{i}"]) if r[f"s{i}"] else 1.0 for i in range(len(features))]
    return means, stds


def error_udf(mean_vec: np.ndarray, comps: np.ndarray, n: int, f: int):
    """ML-9/ML-10: mean squared residual and the per-step errors of a window."""
    @F.pandas_udf("struct<err double, step_err array<double>>")
    def recon(v: pd.Series) -> pd.DataFrame:
        m = np.stack(v.to_numpy()).astype(np.float64)
        c = m - mean_vec
        r = c - (c @ comps.T) @ comps
        sq = r * r
        return pd.DataFrame({"err": sq.mean(axis=1),
                             "step_err": list(sq.reshape(len(m), n, f).mean(axis=2))})
    return recon


def sequence_windows(feats: DataFrame, label: str = "is_fraud", features=SEQ_FEATURES, n: int = SEQ_LEN,
                     key: str = "card", t: str = "t", id_col: str = "txn_id") -> tuple[list[float], list[float], DataFrame]:
    """The scaler, fitted on legitimate rows of the training time range, and the scaled
    windows with their split.  ``feats`` is read several times: pass a written table.
    The windows are built and written once; their split is read off what was written."""
    means, stds = _scaler(time_split(feats, 0.2, t).filter(F.col("split") == "train"), features, label)
    win = materialize(scaled_windows(feats.select(id_col, key, t, label, *[c for c in features if c not in (id_col, key, t, label)]),
                                     means, stds, features, n, key, t, id_col).select(id_col, key, t, label, "window"), "seq-windows")
    return means, stds, time_split(win, 0.2, t).select(id_col, key, t, label, "split", "window")


def fit_windows(means, stds, win: DataFrame, ranks, label: str = "is_fraud", features=SEQ_FEATURES,
                n: int = SEQ_LEN) -> list[SequenceModel]:
    """One model per rank on the legitimate training windows; threshold from the
    legitimate windows of the held-out range.  The components of a lower rank are the
    first of a higher one, so mean and covariance are computed once for all ranks, and
    the errors of all ranks in one pass."""
    train = win.filter((F.col("split") == "train") & (F.col(label) == 0)) \
               .select(array_to_vector("window").alias("v"))
    from pyspark.ml.stat import Summarizer
    mean_vec = np.array(train.select(Summarizer.mean(F.col("v"))).first()[0].toArray())
    ks = [min(r, len(features) * n) for r in ranks]
    pca = PCA(k=max(ks), inputCol="v", outputCol="p").fit(train)
    all_comps = pca.pc.toArray().T
    comps = [all_comps[:k] for k in ks]
    hold = win.filter((F.col("split") == "test") & (F.col(label) == 0))
    errors = hold.select(*[error_udf(mean_vec, c, n, len(features))("window")["err"].alias(f"e{i}") for i, c in enumerate(comps)])
    thr = quantile_values(errors, [(f"e{i}", {f"p{i}": 0.95}) for i in range(len(ks))])
    return [SequenceModel(list(features), n, means, stds, mean_vec, c, float(thr[f"p{i}"] or 0.0)) for i, c in enumerate(comps)]


def fit_sequence_model(feats: DataFrame, label: str = "is_fraud", rank: int = 8,
                       features=SEQ_FEATURES, n: int = SEQ_LEN, key: str = "card",
                       t: str = "t", id_col: str = "txn_id") -> tuple[SequenceModel, DataFrame]:
    """Fit on legitimate windows of the training time range; threshold from
    legitimate windows of the held-out range.  Returns the model and the
    windows with their split."""
    cols = dict.fromkeys([id_col, key, t, label, *features])
    feats = materialize(feats.select(*cols), "seq-features")   # read for the cut, the scaler and the windows
    means, stds, win = sequence_windows(feats, label, features, n, key, t, id_col)
    return fit_windows(means, stds, win, [rank], label, features, n)[0], win


def score_windows(win: DataFrame, m: SequenceModel, top_steps: int = 3) -> DataFrame:
    """ML-9 + ML-10 + WN-7: error, normalised score, anomaly flag, per-step
    errors, the rank of the current (last) step and the verdict
    (no_anomaly / anomaly_at_current / anomaly_earlier_in_window)."""
    udf = error_udf(m.mean_vec, m.components, m.n, len(m.features))
    x = win.withColumn("_r", udf("window")).withColumn("anomaly_score", F.col("_r.err")) \
           .withColumn("step_err", F.col("_r.step_err")).drop("_r", "window")
    thr = max(m.threshold, 1e-6)
    cur = F.element_at("step_err", m.n)
    # argsort descending with later positions first among ties (reversed stable argsort)
    cur_rank = 1 + F.size(F.filter("step_err", lambda e: e > cur))
    order = F.array_sort(F.transform("step_err", lambda e, i: F.struct((-e).alias("ne"), (-i).alias("ni"),
                                                                     i.alias("position"), e.alias("error"))))
    top = F.transform(F.slice(order, 1, top_steps), lambda s: F.struct(
        s["position"].alias("position"), s["error"].alias("error"),
        (s["position"] == m.n - 1).alias("is_current")))
    return (x.withColumn("normalized_score", 1.0 / (1.0 + F.exp(-(F.col("anomaly_score") / thr - 1.0) * 3.0)))
             .withColumn("is_anomaly", F.col("anomaly_score") > m.threshold)
             .withColumn("threshold", F.lit(m.threshold))
             .withColumn("current_step_rank", cur_rank)
             .withColumn("top_steps", top)
             .withColumn("verdict", F.when(~F.col("is_anomaly"), "no_anomaly")
                         .when(F.col("current_step_rank") == 1, "anomaly_at_current")
                         .otherwise("anomaly_earlier_in_window")))


def sweep_sequence_params(feats: DataFrame, ranks=(4, 8), lengths=(5, 10), label: str = "is_fraud"):
    """ML-14: each (rank, window length) trial scored by ML-12 on the held-out
    range; a small driver loop over a bounded grid.  The trials of one length share
    its windows, their covariance and the scoring pass."""
    cols = sorted(set(SEQ_FEATURES) | {"card", "t", "txn_id", label})
    feats = materialize(feats.select(*cols), "sweep-features")   # every length reads it several times
    rows = []
    for n in lengths:
        means, stds, win = sequence_windows(feats, label, n=n)
        models = fit_windows(means, stds, win, ranks, label, n=n)
        fraud = win.filter((F.col("split") == "test") & (F.col(label) == 1))
        hits = fraud.select(*[error_udf(m.mean_vec, m.components, n, len(m.features))("window")["err"].alias(f"e{i}")
                              for i, m in enumerate(models)])
        recalls = hits.agg(*[F.coalesce(F.avg((F.col(f"e{i}") > m.threshold).cast("double")), F.lit(0.0))
                             for i, m in enumerate(models)]).first()
        rows += [(int(n), int(r), float(m.threshold), float(rec)) for r, m, rec in zip(ranks, models, recalls)]
    return feats.sparkSession.createDataFrame(
        rows, "seq_len int, rank int, threshold double, recall_at_legit_p95 double")
