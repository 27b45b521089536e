"""Phrase collocations by stripes.

A stripe is the associative counter of the words that follow one prefix of
1 to 4 words.  Tasks keep the stripes of their texts in memory, merged
elementwise as batches arrive, and send their entries (prefix, next word,
count); Spark merges equal entries, so a stripe of any width and a prefix of
any frequency is spread over tasks.  The merged stripes give everything:

* an entry is an extension, a phrase one word longer with its frequency, and
  so a prefix total of the next level (a zero-word prefix gives the words);
* the largest entry of a prefix's stripe, and the largest entry among stripes
  whose words end alike, say whether a one-word extension subsumes a phrase.
  (Longer phrases need no look: none is more frequent than the extension that
  leads to it.)

A phrase can be frequent only if its prefix and its suffix are, so the scan of
a level passes over places where a bitmap of the level before (bounded; it
never leaves a member out) knows either to be rare.

Words are 64-bit hashes while counted; phrases are told apart by the hash of
the prefix and of the next word (V phrases hold an equal pair with probability
V^2 / 2^65).  Two tasks' words with equal hashes are noticed and raise.

Defined results: null text = empty; null lang = ``und``; a word may hold any
byte but space, tab and the piece separators; no phrase of two words or more
with ``min_count`` places = no row; null ids, repeated rows and other columns
make no difference (every row's places count)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.filters import bitmap, marked
from riskflow.llm.textcore import U64, HashIndex, Words, class_table, mix, signed, slices, utf8
from riskflow.session import materialize

ENTRIES = 1 << 20  # entries of a task's stripes that are merged or sent at a time
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"  # between pieces

#: bytes of words; NUL counts as 0xFF, which no UTF-8 text holds
_WORDS = class_table(lambda b: b not in BREAKS and b not in (9, 32))
_WORDS[0] = 255
_IS_BREAK = np.isin(np.arange(256), list(BREAKS))
_PLACE = [U64(int(x) | 1) for x in mix(np.arange(1001, 1065, dtype=U64))]


def _lang_hash(lang: str, cache: dict) -> np.uint64:
    if lang not in cache:
        cache[lang] = U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    return cache[lang]


def phrase_keys(lang: np.ndarray, words: np.ndarray, size: int, count: int) -> np.ndarray:
    """Key of the ``size`` words from each of the first ``count`` places on."""
    acc = lang[:count].copy()
    for i in range(size):
        acc += words[i:count + i] * _PLACE[i % 64]
    return mix(acc + U64(size))


def _merge(parts: list[tuple]) -> tuple:
    """Equal (prefix, next) entries summed."""
    prefix, nxt, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(prefix + mix(nxt), kind="stable")
    prefix, nxt, c = prefix[order], nxt[order], c[order]
    new = np.ones(len(prefix), dtype=bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (nxt[1:] != nxt[:-1])
    begin = np.flatnonzero(new)
    return prefix[begin], nxt[begin], np.add.reduceat(c, begin) if len(begin) else c


def _runs(batch: pa.RecordBatch, langs: dict):
    """(words, piece, lang hash of every word) of runs of texts."""
    data, off = utf8(batch.column(1))
    names = np.array([_lang_hash(x, langs) for x in batch.column(0).to_pylist()], dtype=U64)
    for lo, hi in slices(off):
        w = Words(data, off[lo:hi + 1], _WORDS)
        breaks = np.cumsum(_IS_BREAK[w.data])
        piece = breaks[w.start] if len(w.start) else np.zeros(0, np.int64)
        yield w, piece, names[lo:hi][w.doc]


class _Tally:
    """Words of one language with their counts."""

    def __init__(self):
        self.index, self.words, self.counts = HashIndex(1 << 14), [], np.zeros(1 << 14, dtype=np.int64)

    def add(self, w: Words, at: np.ndarray) -> None:
        h, first, c = np.unique(w.hash[at], return_index=True, return_counts=True)
        number = self.index.find(h)
        new = np.flatnonzero(number < 0)
        number[new] = self.index.add(h[new])
        for j in at[first[new]]:
            self.words.append(w.data[w.start[j]:w.end[j]].tobytes().lower().decode())
        if self.index.size > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(2 * self.index.size - len(self.counts), dtype=np.int64)])
        self.counts[number] += c

    def rows(self, lang: str) -> pa.RecordBatch:
        h = np.zeros(len(self.words), dtype=U64)
        used = self.index.keys != 0
        h[self.index.vals[used]] = self.index.keys[used]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(h), pa.string()), pa.array(self.words, pa.string()), pa.array(signed(h)),
             pa.array(self.counts[:len(h)])], names=["lang", "word", "h", "c"])


def _word_counts(batches):
    """(lang, word, h, c): one task's counts of words (a stripe under no prefix)."""
    tallies: dict[str, _Tally] = {}
    for batch in batches:
        spoken = batch.column(0).to_pylist()
        data, off = utf8(batch.column(1))
        for lo, hi in slices(off):
            w = Words(data, off[lo:hi + 1], _WORDS)
            kinds = {x: i for i, x in enumerate(dict.fromkeys(spoken[lo:hi]))}
            kind = np.array([kinds[x] for x in spoken[lo:hi]])[w.doc]
            for name, i in kinds.items():
                tallies.setdefault(name, _Tally()).add(w, np.flatnonzero(kind == i))
        for name in [x for x, t in tallies.items() if len(t.words) >= ENTRIES]:
            yield tallies.pop(name).rows(name)
    for name, tally in tallies.items():
        yield tally.rows(name)


def _stripes(size: int, known):
    """(prefix, next, c): one task's stripes of prefixes of size - 1 words."""
    def run(batches):
        langs: dict = {}
        held, waiting = None, []

        def rows(entries):
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(entries[0])), pa.array(signed(entries[1])), pa.array(entries[2])],
                names=["prefix", "next", "c"])

        for batch in batches:
            for w, piece, lang in _runs(batch, langs):
                places = len(w.hash) - size + 1
                if places < 1:
                    continue
                inner = phrase_keys(lang, w.hash, size - 1, places + 1)
                frequent = marked(known.value, mix(inner))
                at = np.flatnonzero(frequent[:-1] & frequent[1:] & (piece[:places] == piece[size - 1:])
                                    & (w.doc[:places] == w.doc[size - 1:]))
                waiting.append((inner[at], w.hash[at + size - 1], np.ones(len(at), dtype=np.int64)))
                if sum(len(x[0]) for x in waiting) >= ENTRIES:
                    held = _merge(waiting + ([held] if held else []))
                    waiting = []
                    if len(held[0]) >= ENTRIES:
                        yield rows(held)
                        held = None
        last = waiting + ([held] if held else [])
        if last:
            yield rows(_merge(last))
    return run


def _keyed(batches):
    """Adds the key of each phrase, from its language and word hashes."""
    langs: dict = {}
    for batch in batches:
        ws = batch.column(batch.schema.get_field_index("ws"))
        lang = np.array([_lang_hash(x, langs) for x in batch.column(0).to_pylist()], dtype=U64)
        words = ws.flatten().to_numpy(zero_copy_only=False).view(U64).reshape(len(batch), -1)
        acc = lang.copy()
        for i in range(words.shape[1]):
            acc += words[:, i] * _PLACE[i % 64]
        key = mix(acc + U64(words.shape[1]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(key))], names=[*batch.schema.names, "key"])


def _level(rows: DataFrame, name: str) -> DataFrame:
    kind = "lang string, phrase string, ws array<bigint>, f bigint, key bigint"
    return materialize(rows.select("lang", "phrase", "ws", "f").mapInArrow(_keyed, kind), name)


def count_phrases(docs: DataFrame, lang_col: str, text_col: str, longest: int, min_count: int):
    """(words, levels): all words with f, and per size 1 .. longest the frequent phrases."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).cast("string").alias("t"))
    words = materialize(texts.mapInArrow(_word_counts, "lang string, word string, h bigint, c bigint")
                        .groupBy("lang", "word", "h").agg(F.sum("c").alias("f")), "pc-words")
    if not words.groupBy("lang", "h").count().where("count > 1").isEmpty():
        raise ValueError("two words of one language have equal hashes")
    frequent = words.where(F.col("f") >= min_count)
    levels = [_level(frequent.select("lang", F.col("word").alias("phrase"), F.array("h").alias("ws"), "f"), "pc-level-1")]
    heads = materialize(frequent.select("lang", "word", F.col("h").alias("next")), "pc-heads")
    for size in range(2, longest + 1):
        before = levels[-1]
        known = spark.sparkContext.broadcast(bitmap(before.select("key")))  # 8 MB at any size
        entries = (texts.mapInArrow(_stripes(size, known), "prefix bigint, next bigint, c bigint")
                   .groupBy("prefix", "next").agg(F.sum("c").alias("f")).where(F.col("f") >= min_count))
        grown = (entries.join(before.select("lang", "phrase", "ws", F.col("key").alias("prefix")), "prefix")
                 .join(heads, ["lang", "next"])
                 .select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"),
                         F.concat("ws", F.array("next")).alias("ws"), "f"))
        levels.append(_level(grown, f"pc-level-{size}"))
    return words, levels


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, longest: int = 5,
                 min_count: int = 100, num: int = 100, den: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``
    phrases of 2 to ``longest`` words that no extension with
    ``den * f(extension) >= num * a`` holds, by their weakest cut's lift in
    thousandths.  Exact for counts up to 10^17."""
    words, levels = count_phrases(docs, lang_col, text_col, longest, min_count)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    every = levels[0].select("lang", "phrase", "f")
    for level in levels[1:]:
        every = every.unionByName(level.select("lang", "phrase", "f"))
    parts = lambda col: F.split(F.col(col), " ")
    longer = None
    for level in levels[2:]:
        one = level.select("lang", "f", F.explode(F.array(
            F.array_join(F.slice(parts("phrase"), 1, F.size(parts("phrase")) - 1), " "),
            F.array_join(F.slice(parts("phrase"), 2, F.size(parts("phrase")) - 1), " "))).alias("phrase"))
        longer = one if longer is None else longer.unionByName(one)
    found = levels[1].select("lang", "phrase", F.col("f").alias("a"), F.lit(2).alias("size"))
    for size, level in enumerate(levels[2:], 3):
        found = found.unionByName(level.select("lang", "phrase", F.col("f").alias("a"), F.lit(size).alias("size")))
    if longer is not None:
        longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        found = found.join(longer, ["lang", "phrase"], "left").where(
            F.col("most").isNull() | ~(F.expr(f"cast({den} as decimal(19,0)) * most") >= F.expr(f"cast({num} as decimal(19,0)) * a")))
    cuts = (found.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .withColumn("left", F.array_join(F.slice(parts("phrase"), F.lit(1), F.col("k")), " "))
            .withColumn("right", F.array_join(F.slice(parts("phrase"), F.col("k") + 1, F.col("size") - F.col("k")), " ")))
    cuts = (cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
            .join(total, "lang"))
    wide = lambda c: f"cast({c} as decimal(17,0))"
    score = F.expr(f"(({wide('a')} * {wide('n')}) * cast(1000 as decimal(4,0))) div ({wide('l')} * {wide('r')})")
    best = (cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("b")))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
            .withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
