"""Benchmark decontamination: a BM25 inverted index of the test items, searched
with block-max WAND by every training passage.

Index: items are the documents of BM25 (k1, b as parameters, idf over the
items); postings by item number, cut into blocks that keep their largest
impact.  Query: a passage, i.e. the training text's distinct words, since
verification takes an item's shingles over the whole text: question and answer
may stand any distance apart, and what is found does not depend on the shards.
A passage retrieves all items whose score reaches the item's score
against itself less the most that verification forgives: a passage that lost w
distinct words of an item lost w or more of its shingles (k - 1 fewer if the
item repeats a shingle), so an item that verifies misses at most the words of
``1 - overlap`` of its shingles, and these weigh at most as much as its
heaviest words.  No item that a passage holds to ``overlap`` is missed.

The question (an item's first line) may leak without its answer: a question of
``question_words`` words or more is an index entry of its own.  Retrieved
entries are verified exactly: the share of the item's, of the question's and of
the answer's k-word shingles that stand in the text.  An item is found if the
text holds ``overlap`` of the item's shingles or of such a question's.

Before WAND a passage passes a gate: whoever holds ``overlap`` of an entry's n
shingles holds one of any n - ceil(overlap n) + 1 of them, so texts that hold
none of these have nothing to retrieve.  Upper bounds of the others against all
item blocks are summed first; WAND with block maxima scores only where a bound
reaches a threshold.

The benchmark is sent to the tasks in shards of at most
``shard_items`` items and ``shard_chars`` characters; a larger benchmark means more shards and passes, never a larger broadcast.  An
item longer than ``shard_chars`` is a shard of its own.

Defined results: null and empty texts and items match nothing; equal items are
all reported; repeated rows repeat their result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.textcore import ALNUM_WORDS, Lookup, Words, shingles, slices, utf8

BLOCK_ITEMS = 2


def _words_of(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    return Words(b, np.array([0, len(b)], dtype=np.int64), ALNUM_WORDS).hash


class Bm25Index:
    """Postings with block maxima over one shard's entries: items, and their
    questions of ``question_words`` words or more."""

    def __init__(self, items: list[tuple[int, str]], overlap: float, k: int, question_words: int, k1: float = 1.2, b: float = 0.75):
        self.ids, self.parts, self.item_of, entries = [], [], [], []
        for i, text in items:
            words = _words_of(text or "")
            if not len(words):
                continue
            head, _, tail = (text or "").strip().partition("\n")
            q, a = _words_of(head), _words_of(tail)
            self.ids.append(i)
            # shingles of question, answer and item with their width
            self.parts.append([(np.unique(shingles(x, k)), min(k, len(x))) for x in (q, a, words)] + [len(q) >= question_words])
            for x in [words] + ([q] if len(a) and len(q) >= question_words else []):
                entries.append(x)
                self.item_of.append(len(self.ids) - 1)
        n = len(entries)
        self.vocab = np.unique(np.concatenate(entries)) if n else np.zeros(0, np.uint64)
        lens = np.array([len(x) for x in entries], dtype=float)
        self.impact = np.zeros((len(self.vocab), n), dtype=np.float32)
        for j, words in enumerate(entries):
            w, tf = np.unique(words, return_counts=True)
            self.impact[np.searchsorted(self.vocab, w), j] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[j] / lens.mean()))
        df = (self.impact > 0).sum(axis=1)
        self.impact *= np.log(1 + (n - df + 0.5) / (df + 0.5))[:, None].astype(np.float32)
        self.goal = np.zeros(n)
        gate: dict[int, list[np.ndarray]] = {}
        for j, words in enumerate(entries):
            distinct, width = np.unique(shingles(words, k)), min(k, len(words))
            forgiven = int((1 - overlap) * len(distinct) + 1e-9)
            gate.setdefault(width, []).append(distinct[:forgiven + 1])
            lost = forgiven + (k - 1 if len(distinct) < len(words) - width + 1 else 0)
            weights = np.sort(self.impact[:, j].astype(float))[::-1]
            self.goal[j] = weights[lost:].sum() - 1e-4  # with room for rounding
        self.gates = {width: Lookup(np.unique(np.concatenate(x))) for width, x in gate.items()}
        pad = -n % BLOCK_ITEMS
        blocks = np.pad(self.impact, ((0, 0), (0, pad))).reshape(len(self.vocab), -1, BLOCK_ITEMS)
        self.block_max = blocks.max(axis=2)
        self.block_goal = np.pad(self.goal, (0, pad), constant_values=np.inf).reshape(-1, BLOCK_ITEMS).min(axis=1)
        self.term_max = self.impact.max(axis=1) if n else np.zeros(0, np.float32)
        self.lists = [np.flatnonzero(row) for row in self.impact]
        self.find = Lookup(self.vocab)

    def passing(self, w: Words) -> np.ndarray:
        """Which texts of the run hold a gate's shingle."""
        out = np.zeros(len(w.offsets) - 1, dtype=bool)
        for width, gate in self.gates.items():
            if len(w.hash) >= width:
                at, _ = gate.find(shingles(w.hash, width))  # also across texts: sorted out below
                out[w.doc[at[w.doc[at] == w.doc[at + width - 1]]]] = True
        return out

    def wand(self, terms: np.ndarray, open_blocks: np.ndarray) -> list[int]:
        """Items whose score for a passage's distinct ``terms`` reaches their
        goal; ``open_blocks``: blocks whose bound reaches a goal."""
        lowest = float(self.block_goal[open_blocks].min())
        is_open = np.zeros(len(self.block_goal), dtype=bool)
        is_open[open_blocks] = True
        cursor = {int(t): 0 for t in terms if len(self.lists[t])}
        out = []
        while cursor:
            at = sorted((int(self.lists[t][c]), t) for t, c in cursor.items())
            bound, pivot = 0.0, None
            for item, t in at:  # the first item that the terms up to it could lift over the lowest goal
                bound += float(self.term_max[t])
                if bound >= lowest:
                    pivot = item
                    break
            if pivot is None:
                break
            block = pivot // BLOCK_ITEMS
            ahead = pivot
            if is_open[block] and sum(float(self.block_max[t, block]) for item, t in at if item <= pivot) >= lowest:
                score = sum(float(self.impact[t, pivot]) for item, t in at if item <= pivot)
                if score >= self.goal[pivot]:
                    out.append(pivot)
                ahead = pivot + 1
            else:  # no item of the block can reach a goal before another list enters it
                ahead = min([(block + 1) * BLOCK_ITEMS, *(item for item, _ in at if item > pivot)])
            for item, t in at:
                if item < ahead:
                    c = int(np.searchsorted(self.lists[t], ahead))
                    if c == len(self.lists[t]):
                        del cursor[t]
                    else:
                        cursor[t] = c
        return out

    def search(self, w: Words) -> list[tuple[int, int]]:
        """(text of the run, item) pairs that the texts retrieve."""
        inside = np.flatnonzero(self.passing(w)[w.doc])
        pos, term = self.find.find(w.hash[inside])
        if not len(pos):
            return []
        pos = inside[pos]
        key = np.unique(w.doc[pos] * len(self.vocab) + term)
        slot, term = key // len(self.vocab), key % len(self.vocab)
        cut = np.flatnonzero(np.diff(slot, prepend=-1))
        doc = slot[cut]
        size = np.diff(cut, append=len(slot))
        out = set()
        for lo in range(0, len(cut), 4096):
            hi = min(len(cut), lo + 4096)
            t = term[cut[lo]:cut[hi - 1] + size[hi - 1]]
            bound = np.add.reduceat(self.block_max[t], cut[lo:hi] - cut[lo], axis=0)
            reach = bound >= self.block_goal
            for i in np.flatnonzero(reach.any(axis=1)).tolist():
                terms = term[cut[lo + i]:cut[lo + i] + size[lo + i]]
                out.update((int(doc[lo + i]), self.item_of[j]) for j in self.wand(terms, np.flatnonzero(reach[i])))
        return sorted(out)


def _held(part: np.ndarray, text: np.ndarray) -> float:
    return float(np.isin(part, text, assume_unique=True).mean())


def _shards(bench: DataFrame, id_col: str, text_col: str, items: int, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in bounded shards; one shard at a time is on the driver."""
    rows = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null")
    now, size = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        if now and (len(now) >= items or size + len(r["t"] or "") > chars):
            yield now
            now, size = [], 0
        now.append((r["i"], r["t"]))
        size += len(r["t"] or "")
    if now:
        yield now


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", *, overlap: float = 0.8, k: int = 5, question_words: int = 12,
               shard_items: int = 2000, shard_chars: int = 4_000_000) -> DataFrame:
    """(id, item_id, overlap, question_overlap, answer_overlap) of every text and
    item with ``overlap`` or more of the item's k-word shingles in the text, or
    of its question's if that has ``question_words`` words or more."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = "id bigint, item_id bigint, overlap double, question_overlap double, answer_overlap double"

    def against(shard):
        sent = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch]):
            index = Bm25Index(sent.value, overlap, k, question_words)
            for batch in batches:
                ids, out = batch.column(0), []
                data, off = utf8(batch.column(1))
                for lo, hi in slices(off):
                    w = Words(data, off[lo:hi + 1], ALNUM_WORDS)
                    last, text = -1, None
                    for d, j in index.search(w):
                        if d != last:
                            h = w.hash[w.first[d]:w.first[d + 1]]
                            last, text = d, {n: np.unique(shingles(h, n)) for n in range(1, k + 1)}  # by width
                        *parts, long_question = index.parts[j]
                        q, a, all_ = (_held(part, text[width]) if width else 1.0 for part, width in parts)
                        if all_ >= overlap or long_question and q >= overlap:
                            out.append((ids[lo + d].as_py(), index.ids[j], all_, q, a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in out], t) for c, t in enumerate([pa.int64(), pa.int64()] + [pa.float64()] * 3)],
                    names=["id", "item_id", "overlap", "question_overlap", "answer_overlap"])

        return src.mapInArrow(run, schema)

    parts = [against(s) for s in _shards(bench, item_id, item_text, shard_items, shard_chars)]
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_col)
