"""Toxicity with noisy-channel deobfuscation.

1. Character language model: trigram counts of the words of all input texts,
   summed by Spark; at most |alphabet|^3 counts reach the driver.
2. Deobfuscation: suspicious stretches (leet signs inside words, runs of one
   character, letters set apart by blanks or signs) become a character lattice:
   each observed sign may stand for its letters, a run for one or two of its
   letter, separators for nothing.  Viterbi decoding under the language model
   and the channel's costs restores the most probable word.
3. Score: words of the restored text are looked up, whole and by their first
   4, 5 and 6 bytes, in a table of log-odds learned from labelled texts; a
   logistic model on a text's strongest distinct log-odds gives the score.

Labels are learned from rows outside ``held_out`` only, from at most
``max_labelled`` of them (the first by a hash of the id).  Labels, lang, source
and doc_id are never inputs of a score.

Defined results: null text = empty = no words; labels null or other than 0 / 1
are ignored; rows with a null id are scored and never learned from; an id with
several labels counts once for each; other columns are ignored; without both
classes among the labelled rows every score is the share of toxic labels (0
without labels)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.textcore import U64, Lookup, Words, class_table, mix, signed, slices, utf8
from riskflow.session import materialize

MAX_LABELLED = 30_000
MAX_FEATURES = 20_000
MIN_DOCS = 4
TOP = 6  # strongest distinct features of a text that the logistic model sees
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)

#: What an observed sign may stand for besides itself (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
        "|": "il", "€": "e", "£": "l", "+": "t", "¡": "i"}
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß'"
_SIZE = len(ALPHABET) + 2  # 0: word edge, 1: any other character
_CODE = {c: i + 2 for i, c in enumerate(ALPHABET)}
_L = ALPHABET[:-1]
_SIGNS = re.escape("".join(LEET))
#: Stretches that may hide a word.
SUSPICIOUS = re.compile(
    rf"(?<![{_L}0-9])(?:[{_L}](?:[ .\-_*]{{1,2}}[{_L}{_SIGNS}]){{2,}})(?![{_L}0-9])"  # letters set apart
    rf"|(?<![{_L}{_SIGNS}])(?:[{_L}{_SIGNS}]*[{_L}][{_SIGNS}.\-_*]{{1,2}}(?=[{_L}])[{_L}{_SIGNS}.\-_*]*[{_L}]|[0-9@$|][{_L}][{_L}{_SIGNS}]+)"
    rf"|[{_L}]*([{_L}])\1\1[{_L}]*")
#: Cost (nats) of a written sign for a letter, of writing a letter twice or more, of a separator.
COST_SIGN, COST_RUN, COST_GAP = 1.0, 0.7, 0.3
#: Letters, digits and everything beyond ASCII are word bytes of the scorer.
WORDS = class_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts (edge, edge, c1 .. cn, edge) of the words of all texts."""
    table = np.zeros(65536, dtype=np.int64)
    for c, i in _CODE.items():
        table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = i

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(_SIZE ** 3, dtype=np.int64)
        for batch in batches:
            data, off = utf8(batch.column(0))
            for lo, hi in slices(off):
                run_ = bytes(data[off[lo]:off[hi]]).decode("utf-8")  # a text's last word may touch the next text's first
                cp = np.frombuffer(run_.encode("utf-16-le", "surrogatepass"), dtype="<u2")
                code = table[cp]
                code = code[(code > 0) | np.concatenate([[True], code[:-1] > 0])] if len(code) else code  # one edge between words
                seq = np.concatenate([[0], code, [0]])
                two = np.where((seq[1:-1] == 0), 0, seq[:-2])  # what stands before an edge is forgotten
                total += np.bincount((two * _SIZE + seq[1:-1]) * _SIZE + seq[2:], minlength=_SIZE ** 3)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["g", "n"])

    out = np.zeros(_SIZE ** 3, dtype=np.int64)
    for r in docs.select(F.col(text_col).cast("string")).mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():
        out[r["g"]] = r["n"]
    return out.reshape(_SIZE, _SIZE, _SIZE)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams backed off to bigrams and letters."""
    c3 = counts.astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 0.5) / (c1 + 0.5).sum()
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    return np.log((c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def lattice(seen: str) -> list[list[tuple[str, float]]]:
    """For each run of one character of a lower-cased stretch: the letter
    strings it may stand for, with costs."""
    out, i = [], 0
    while i < len(seen):
        c, j = seen[i], i
        while j < len(seen) and seen[j] == c:
            j += 1
        n, i = j - i, j
        if c in _CODE and c != "'":
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0 if n == 2 else COST_RUN), (c, COST_RUN)])
            continue
        ways = [("", COST_GAP)] if c in " .-_*" else []
        for letter in LEET.get(c, ""):
            ways.append((letter, COST_SIGN + (COST_RUN if n > 1 else 0)))
            if n > 1:
                ways.append((letter * 2, COST_SIGN + COST_RUN))
        out.append(ways or [("", COST_GAP)])
    return out


def decode(seen: str, model: np.ndarray) -> str:
    """Viterbi path of a stretch's lattice: the word of the highest
    probability under the model less the channel's costs."""
    best = {(0, 0): (0.0, "")}  # last two characters -> score, word
    for ways in lattice(seen):
        step: dict = {}
        for (a, b), (score, word) in best.items():
            for text, cost in ways:
                x, y, s = a, b, score - cost
                for ch in text:
                    z = _CODE.get(ch, 1)
                    s += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in step or s > step[x, y][0]:
                    step[x, y] = (s, word + text)
        best = step
    return max((score + float(model[a, b, 0]), word) for (a, b), (score, word) in best.items())[1]


class Restorer:
    """Restores suspicious stretches; a bounded table keeps what was decoded."""

    def __init__(self, model: np.ndarray, keep: int = 20_000):
        self.decode = lru_cache(maxsize=keep)(lambda s: decode(s, model))

    def __call__(self, text: str) -> str:
        return SUSPICIOUS.sub(lambda m: self.decode(m[0]), text.lower())


def _hashes(text_words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, text) of all words and of their prefixes."""
    w = text_words
    lens = w.end - w.start
    out, doc = [w.hash], [w.doc]
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(w.terms, dtype=U64)])
    for n in PREFIXES:
        long = np.flatnonzero(lens >= n)
        head = sums[w.cum[:-1][long] + n] - sums[w.cum[:-1][long]]
        out.append(mix(head + np.full(1, n, dtype=U64) * U64(0x8CB92BA72F3D8DD7)))
        doc.append(w.doc[long])
    return np.concatenate(out), np.concatenate(doc)


def _runs(column, restore: Restorer):
    """(lo, hi, words) of restored texts."""
    data, off = utf8(column)
    for lo, hi in slices(off):
        texts = [restore(bytes(data[off[i]:off[i + 1]]).decode("utf-8")).encode("utf-8") for i in range(lo, hi)]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        yield lo, hi, Words(np.frombuffer(b"".join(texts), dtype=np.uint8), ends, WORDS)


def _strongest(doc, weight, n, top=TOP):
    """(n x top) largest weights of each text, padded with 0."""
    order = np.lexsort((-weight, doc))
    doc, weight = doc[order], weight[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    out = np.zeros((n, top))
    ok = place < top
    out[doc[ok], place[ok]] = weight[ok]
    return out


class Toxicity:
    """A fitted scorer: language model, log-odds of features, logistic weights."""

    def __init__(self, model, features, odds, coef, prior):
        self.model, self.features, self.odds, self.coef, self.prior = model, features, odds, coef, prior

    def evidence(self, column) -> np.ndarray:
        """(texts x TOP) strongest distinct positive log-odds of each text."""
        out = np.zeros((len(column), TOP))
        find = Lookup(self.features)
        for lo, hi, w in _runs(column, Restorer(self.model)):
            h, doc = _hashes(w)
            pos, idx = find.find(h)
            key = np.unique(doc[pos] * max(1, len(self.odds)) + idx)
            if len(key):
                out[lo:hi] = _strongest(key // len(self.odds), self.odds[key % len(self.odds)], hi - lo)
        return out

    def score(self, column) -> np.ndarray:
        if self.coef is None:
            return np.full(len(column), self.prior)
        z = np.clip(self.evidence(column) @ self.coef[:-1] + self.coef[-1], -40, 40)
        return 1 / (1 + np.exp(-z))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps of a ridge logistic regression on TOP + 1 columns."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
        max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Toxicity:
    """Learn from labelled rows that are not held out."""
    spark = docs.sparkSession
    model = log_model(char_counts(docs, text_col))
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
             .where("id is not null and y in (0, 1) and crc32(cast(id as string)) % 3 <> 1").distinct())
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    train = materialize(texts.join(F.broadcast(known), "id").select("t", "y"), "tx-train")  # at most max_labelled rows
    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    empty = np.zeros(0, U64), np.zeros(0)
    if not n0 or not n1:
        return Toxicity(model, *empty, None, float(n1 > 0))

    def features(batches: Iterator[pa.RecordBatch]):
        restore = Restorer(model)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, hi, w in _runs(batch.column(0), restore):
                h, doc = _hashes(w)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                h, label = h[new], y[lo:hi][doc[new]]
                names, at = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(names)), pa.array(np.bincount(at, 1 - label, len(names)).astype(np.int64)),
                     pa.array(np.bincount(at, label, len(names)).astype(np.int64))], names=["f", "n0", "n1"])

    counts = train.mapInArrow(features, "f bigint, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    table = (counts.where(F.col("n1") >= MIN_DOCS).withColumn("odds", odds).where("odds > 1")
             .orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "f").limit(max_features).collect())
    rows = sorted((r["f"] & (2 ** 64 - 1), r["odds"]) for r in table)
    scorer = Toxicity(model, np.array([r[0] for r in rows], dtype=U64), np.array([r[1] for r in rows]), None, n1 / (n0 + n1))
    if not rows:
        return scorer
    sent = spark.sparkContext.broadcast(scorer)

    def evidence(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = sent.value.evidence(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    seen = train.mapInArrow(evidence, "y int, x array<double>").groupBy("y", "x").count().collect()  # at most max_labelled rows
    x = np.array([r["x"] for r in seen]).reshape(-1, TOP)
    y, n = np.array([r["y"] for r in seen], dtype=float), np.array([r["count"] for r in seen])
    scorer.coef = _logistic(np.repeat(x, n, axis=0), np.repeat(y, n))
    return scorer


def score_texts(docs: DataFrame, scorer: Toxicity, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(pa.array(t, pa.string(), from_pandas=True)))

    out = docs.withColumn("score", score(F.col(text_col).cast("string")))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    scored = score_texts(docs.select(id_col, text_col), fit(docs, labels, id_col, text_col), text_col)
    held = F.expr(f"crc32(cast({id_col} as string)) % 3 = 1")
    return scored.select(id_col, F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
