"""Live per-card features over an event stream (SS-1, SS-2, SS-3).

Events may arrive in any order within the watermark's delay: a card's new rows
wait in its state until the watermark has passed their second, and are then
scored in (t, txn_id) order, so the output equals the batch ``velocity`` and
``prior_profile`` whatever the arrival order and the cut into micro-batches.
Rows behind the watermark are left out by Spark (``jobs.arrival_router`` keeps
them as rows).

Per card the state holds

* the rows that wait, as one Arrow buffer;
* the last ``span`` seconds (the longest window) as per-second (count, sum, max),
  so the busiest card's state is bounded by the seconds of that window;
* count, mean and M2 (sum of squared deviations) of the amounts, the last time,
  and the channels and addresses seen.

An event-time timer releases waiting rows.  With ``forget_idle``, once a card has
been idle for longer than ``span`` a second timer removes its state; a later event
starts anew (``seconds_since_last`` -1, empty profile), also when both stand in one
batch, so results do not depend on when the timer fires.  Without it a card's profile
and last time are kept for good (the registered queries: every row as in the batch).

Scoring works on arrays of a card's rows; nothing loops over rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskflow.operators.windows import DEFAULT_WINDOWS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATE_SCHEMA = ("waiting binary, sec array<bigint>, sec_n array<bigint>, sec_s array<double>, sec_m array<double>, "
                "n bigint, mean double, m2 double, last_t bigint, chans array<string>, addrs array<bigint>")
BASE = ["txn_id", "card", "t", "amount", "channel", "addr"]


def _range_max(arr: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """max(arr[lo:hi]) per query (0 when empty) with a sparse table: O(m log m)
    to build, O(1) per query - a hot card's long windows stay cheap."""
    out = np.zeros(len(lo))
    m = len(arr)
    if m == 0:
        return out
    table = [arr]
    k = 1
    while (1 << k) <= m:
        prev, half = table[-1], 1 << (k - 1)
        table.append(np.maximum(prev[:-half], prev[half:]))
        k += 1
    length = hi - lo
    ok = length > 0
    lv = np.zeros(len(lo), dtype=np.int64)
    lv[ok] = np.floor(np.log2(length[ok])).astype(np.int64)
    for level in np.unique(lv[ok]):
        sel = ok & (lv == level)
        t = table[level]
        out[sel] = np.maximum(t[lo[sel]], t[hi[sel] - (1 << level)])
    return out


def _per_second(t: np.ndarray, a: np.ndarray):
    """Collapse rows in time order to per-second (second, count, sum, max)."""
    if len(t) == 0:
        return t, np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    uniq, start = np.unique(t, return_index=True)
    cnt = np.diff(np.append(start, len(t)))
    return uniq, cnt.astype(np.int64), np.add.reduceat(a, start), np.maximum.reduceat(a, start)


def running_moments(x: np.ndarray, n0: int, mean0: float, m20: float):
    """(n, mean, M2) after each of ``x``, from the moments before the first:
    the recurrence M2 += (x - mean before)(x - mean after), whose terms are
    never negative, so nothing cancels."""
    n = n0 + np.arange(1, len(x) + 1)
    shift = mean0 if n0 else (x[0] if len(x) else 0.0)
    mean = shift + np.cumsum(x - shift) / n
    before = np.concatenate([[mean0 if n0 else shift], mean[:-1]])
    return n, mean, m20 + np.cumsum(np.maximum((x - before) * (x - mean), 0.0))


def _seen_before(values: np.ndarray, known: set) -> tuple[np.ndarray, set]:
    """(distinct non-null values before each row, all values) given those known before."""
    valid = ~(np.isnan(values) if values.dtype.kind == "f" else pd.isna(values))
    kinds, first = np.unique(values[valid], return_index=True)
    fresh = np.array([k not in known for k in kinds.tolist()], dtype=bool)
    new = np.zeros(len(values), dtype=np.int64)
    new[np.flatnonzero(valid)[first[fresh]]] = 1
    return len(known) + np.cumsum(new) - new, known | set(kinds.tolist())


@dataclass
class CardState:
    """What a card's next rows need to know of its earlier ones."""

    sec: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sec_n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sec_s: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sec_m: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    last_t: int | None = None
    chans: set = field(default_factory=set)
    addrs: set = field(default_factory=set)

    @classmethod
    def of(cls, row) -> "CardState":
        kinds = (np.int64, np.int64, np.float64, np.float64)
        parts = [np.asarray(v if v is not None else [], dtype=k) for v, k in zip(row[1:5], kinds)]
        return cls(*parts, int(row[5]), float(row[6]), float(row[7]), row[8], set(row[9] or []), set(row[10] or []))

    def row(self, waiting: bytes | None) -> tuple:
        return (waiting, self.sec.tolist(), self.sec_n.tolist(), self.sec_s.tolist(), self.sec_m.tolist(), int(self.n),
                float(self.mean), float(self.m2), None if self.last_t is None else int(self.last_t),
                sorted(self.chans), sorted(self.addrs))


def _whole(addr: np.ndarray) -> np.ndarray:
    """Addresses as whole numbers, nulls kept (a column with nulls comes as doubles)."""
    if addr.dtype.kind in "iu":
        return addr.astype(np.int64)
    known = ~pd.isna(addr)
    if known.all():
        return pd.to_numeric(addr).astype(np.int64)
    out = np.full(len(addr), None, dtype=object)
    out[known] = pd.to_numeric(addr[known]).astype(np.int64)
    return out


def _score_run(card, rows: dict, st: CardState, windows: dict, span: int, prefix: str,
               passthrough: list[str]) -> tuple[pd.DataFrame, CardState]:
    """Rows (arrays by column) of one card in (t, txn_id) order without an idle gap beyond ``span``."""
    t, a = rows["t"].astype(np.int64), rows["amount"].astype(np.float64)
    parts = zip((st.sec, st.sec_n, st.sec_s, st.sec_m), _per_second(t, a))
    sec, cnt, total, top = (np.concatenate(p) for p in parts)
    order = np.argsort(sec, kind="stable")
    sec, cnt, total, top = sec[order], cnt[order], total[order], top[order]
    uniq, start = np.unique(sec, return_index=True)
    if len(uniq) < len(sec):  # a second seen in both: fold
        cnt, total, top = np.add.reduceat(cnt, start), np.add.reduceat(total, start), np.maximum.reduceat(top, start)
        sec = uniq
    ccnt, csum = np.concatenate([[0], np.cumsum(cnt)]), np.concatenate([[0.0], np.cumsum(total)])
    out = {"txn_id": rows["txn_id"].astype(np.int64), "card": np.full(len(t), card, dtype=np.int64), "t": t}
    for c in passthrough:
        out[c] = rows[c]
    for w, secs in windows.items():
        lo = np.searchsorted(sec, t - secs, side="left")
        hi = np.searchsorted(sec, t - 1, side="right")
        out[f"{prefix}_txn_count_{w}"] = (ccnt[hi] - ccnt[lo]).astype(np.int64)
        out[f"{prefix}_amt_sum_{w}"] = np.where(hi > lo, csum[hi] - csum[lo], 0.0)
        out[f"{prefix}_amt_max_{w}"] = _range_max(top, lo, hi)
    since = np.diff(t, prepend=t[0] + 1 if st.last_t is None else st.last_t)  # -1 for a first row
    out[f"{prefix}_seconds_since_last"] = since.astype(np.int64)
    n, mean, m2 = running_moments(a, st.n, st.mean, st.m2)
    n_, mean_, m2_ = (np.concatenate([[first], x[:-1]]) for first, x in ((st.n, n), (st.mean, mean), (st.m2, m2)))
    mean_ = np.where(n_ > 0, mean_, a)
    std = np.where(n_ > 1, np.sqrt(m2_ / np.maximum(n_ - 1, 1)), 0.0)
    out[f"{prefix}_amt_mean"], out[f"{prefix}_amt_std"] = mean_, std
    out[f"{prefix}_amt_zscore"] = np.where(std > 0, (a - mean_) / np.where(std > 0, std, 1.0), 0.0)
    out[f"{prefix}_total_txns"] = n_.astype(np.int64)
    out[f"{prefix}_distinct_channel"], chans = _seen_before(rows["channel"].astype(object), st.chans)
    out[f"{prefix}_distinct_addr"], addrs = _seen_before(_whole(rows["addr"]), st.addrs)
    keep = sec >= t[-1] - span  # evict beyond the longest window
    return pd.DataFrame(out, copy=False), CardState(sec[keep], cnt[keep], total[keep], top[keep], int(n[-1]), float(mean[-1]),
                                        float(m2[-1]), int(t[-1]), chans, addrs)


def _arrays(rows: pd.DataFrame | dict, passthrough: list[str]) -> dict:
    """What scoring reads of a card's rows, as arrays by column: a frame a card costs
    more than its arithmetic."""
    names = dict.fromkeys([c for c in BASE if c != "card"] + passthrough)
    return {c: rows[c] if isinstance(rows, dict) else rows[c].to_numpy() for c in names}


def _take(rows: dict, which) -> dict:
    return {c: v[which] for c, v in rows.items()}


def score_rows(card, rows: pd.DataFrame | dict, st: CardState, windows: dict, span: int, prefix: str,
               passthrough: list[str], forget_idle: bool = True) -> tuple[pd.DataFrame, CardState]:
    """Score one card's rows, which come in (t, txn_id) order and after all
    rows scored before; with ``forget_idle`` a gap beyond ``span`` starts anew."""
    rows = _arrays(rows, passthrough)
    if not forget_idle:
        return _score_run(card, rows, st, windows, span, prefix, passthrough)
    t = rows["t"].astype(np.int64)
    gaps = np.diff(t, prepend=t[0] if st.last_t is None else st.last_t)
    cuts = np.flatnonzero(gaps > span)
    out = []
    for lo, hi in zip(np.concatenate([[0], cuts]), np.append(cuts, len(t))):
        if lo < hi:
            begun = CardState() if lo in cuts else st
            part, st = _score_run(card, _take(rows, slice(lo, hi)), begun, windows, span, prefix, passthrough)
            out.append(part)
    return out[0] if len(out) == 1 else pd.concat(out, ignore_index=True), st


def _pack(rows: dict) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(v, from_pandas=True) for v in rows.values()], names=list(rows))
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(buf: bytes) -> dict:
    batch = pa.ipc.open_stream(buf).read_next_batch()
    return {name: v.to_numpy(zero_copy_only=False) for name, v in zip(batch.schema.names, batch.columns)}


def advance(card, new: pd.DataFrame | None, row, watermark_ms: int, windows: dict, span: int, prefix: str,
            passthrough: list[str], forget_idle: bool = True):
    """One card's turn: (scored rows or None, new state row or None when it
    ends, next timer in ms or None)."""
    st = CardState.of(row) if row is not None else CardState()
    waiting = [_unpack(row[0])] if row is not None and row[0] is not None else []
    waiting += [_arrays(new, passthrough)] if new is not None and len(new) else []
    out = None
    if waiting:
        rows = waiting[0] if len(waiting) == 1 else {c: np.concatenate([w[c] for w in waiting]) for c in waiting[0]}
        t = rows["t"].astype(np.int64)
        ready = (t + 1) * 1000 <= watermark_ms  # no earlier row can come any more
        if ready.any():
            order = np.lexsort((rows["txn_id"], t))
            out, st = score_rows(card, _take(rows, order[ready[order]]), st, windows, span, prefix, passthrough, forget_idle)
        if not ready.all():
            timer = (int(t[~ready].min()) + 1) * 1000 - 1
            return out, st.row(_pack(_take(rows, ~ready))), max(timer, watermark_ms + 1)
    if st.last_t is not None and not forget_idle:
        return out, st.row(None), None
    if st.last_t is None or (st.last_t + span + 1) * 1000 <= watermark_ms:  # nothing that can come sees it
        return out, None, None
    return out, st.row(None), max((st.last_t + span + 1) * 1000 - 1, watermark_ms + 1)


def output_schema(windows: dict = DEFAULT_WINDOWS, prefix: str = "card",
                  passthrough: list[tuple[str, str]] = ()) -> str:
    cols = ["txn_id long", "card long", "t long"] + [f"{n} {t}" for n, t in passthrough]
    for w in windows:
        cols += [f"{prefix}_txn_count_{w} long", f"{prefix}_amt_sum_{w} double", f"{prefix}_amt_max_{w} double"]
    cols += [f"{prefix}_seconds_since_last long", f"{prefix}_amt_mean double", f"{prefix}_amt_std double",
             f"{prefix}_amt_zscore double", f"{prefix}_total_txns long", f"{prefix}_distinct_channel long",
             f"{prefix}_distinct_addr long"]
    return ", ".join(cols)


class CardFeatureProcessor(StatefulProcessor):
    """SS-1 + SS-2 with the processor API: a card's turn at new rows and at its timers."""

    def __init__(self, windows: dict = DEFAULT_WINDOWS, prefix: str = "card", passthrough: tuple = (),
                 forget_idle: bool = True):
        self.forget_idle = forget_idle
        self.passthrough = [n for n, _ in passthrough]
        self.windows = dict(windows)
        self.span = max(self.windows.values())
        self.prefix = prefix

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("card", STATE_SCHEMA)

    def _turn(self, key, new, timerValues):
        row = self.state.get() if self.state.exists() else None
        out, row, timer = advance(key[0], new, row, timerValues.getCurrentWatermarkInMs(), self.windows, self.span,
                                  self.prefix, self.passthrough, self.forget_idle)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if row is None:
            self.state.clear()
        else:
            self.state.update(row)
            if timer is not None:
                self.handle.registerTimer(timer)
        if out is not None:
            yield out

    def handleInputRows(self, key, rows, timerValues):
        yield from self._turn(key, pd.concat(list(rows), ignore_index=True), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._turn(key, None, timerValues)

    def close(self) -> None:
        pass


def stream_card_features(events: DataFrame, windows: dict = DEFAULT_WINDOWS, prefix: str = "card",
                         passthrough: list[str] = (), engine: str = "applyInPandasWithState",
                         delay: str = "1 hour", forget_idle: bool = True) -> DataFrame:
    """SS-1/SS-2 on a streaming DataFrame of transactions (txn_id, card, t, ts,
    amount, channel, addr, plus ``passthrough`` columns copied to the output).
    ``delay`` bounds how late an event may arrive; a row leaves once the
    watermark has passed its second (``jobs.ended`` moves it past the last).
    ``forget_idle`` ends the state of a card that is idle for the longest window.

    ``engine="applyInPandasWithState"`` ships each card's state with its rows
    in the Arrow batch (one round trip per batch of groups);
    ``engine="transformWithState"`` uses the newer processor API, whose state
    calls are round trips per card.  Both keep state in RocksDB (local disk,
    bounded memory) and give the same rows."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    extra = [c for c in passthrough if c not in ("txn_id", "card", "t")]
    whole = "card is not null and t is not null and ts is not null and amount is not null"  # others have no features
    cols = events.withWatermark("ts", delay).select(*BASE, "ts", *[c for c in extra if c not in BASE]).where(whole)
    types = dict(cols.dtypes)
    pt = [(c, types[c]) for c in extra]
    windows = dict(windows)
    if engine == "transformWithState":
        return cols.groupBy("card").transformWithStateInPandas(
            statefulProcessor=CardFeatureProcessor(windows, prefix, tuple(pt), forget_idle),
            outputStructType=output_schema(windows, prefix, pt), outputMode="Append", timeMode="EventTime")
    span = max(windows.values())
    names = [n for n, _ in pt]

    def fn(key, pdfs, state):
        parts = list(pdfs)
        new = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True) if parts else None
        row = state.get if state.exists else None
        out, row, timer = advance(key[0], new, row, state.getCurrentWatermarkMs(), windows, span, prefix, names, forget_idle)
        if row is None:
            if state.exists:
                state.remove()
        else:
            state.update(row)
            if timer is not None:
                state.setTimeoutTimestamp(timer)
        if out is not None:
            yield out

    return cols.groupBy("card").applyInPandasWithState(
        fn, outputStructType=output_schema(windows, prefix, pt), stateStructType=STATE_SCHEMA,
        outputMode="Append", timeoutConf="EventTimeTimeout")


def stream_engineer(events: DataFrame, passthrough: list[str] = (), **kw) -> DataFrame:
    """SS-3: stateless time and e-mail columns computed per row before the
    stateful step and carried through it, so no stream-stream join is needed."""
    from riskflow.functions.features import email_features, time_features
    pre = email_features(time_features(events))
    keep = ["txn_hour", "txn_day", "txn_dayofweek", "is_night", "p_email_isnull", "p_email_is_highrisk",
            "r_email_isnull", "r_email_is_highrisk", "emails_match", "score", "is_fraud", *passthrough]
    return stream_card_features(pre, passthrough=list(dict.fromkeys(keep)), **kw)
