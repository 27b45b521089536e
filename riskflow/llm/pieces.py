"""SentencePiece encoding and decoding by shared-prefix forward search.

Texts are cut into marked words (a blank, written as the word mark, belongs to
the word it precedes) and further wherever no piece of the vocabulary spans two
neighbouring characters.  The distinct words of a block are sorted, which is a
depth-first walk of their trie: a word keeps the forward states of the prefix it
shares with the word before and continues from there.

The vocabulary is a BPE model, whose ids are not a best-score path: Viterbi over
summed scores would give other ids than the model.  The forward search
therefore keeps, per prefix, the one last piece of that prefix's encoding: a
piece may follow another exactly if both together encode to themselves, and
every prefix has exactly one such end.  So the walk is Viterbi's, over the same
lattice, with that test in place of a sum, and the ids equal the model's.

Characters outside the vocabulary become byte pieces.  Decoding joins the bytes
of the pieces, turns the mark into a blank and drops the blank that encoding
put in front.

Defined results: null or empty text has no ids; ids survive decoding exactly
unless the text holds the mark character itself, which reads as a blank;
repeated rows repeat their result; other columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.llm.textcore import HashIndex, ranges, run_hashes, slices, utf8

MARK = "▁"
CACHE_WORDS = 1_000_000  # words whose ids a worker keeps: about 60 MB
CACHE_PAIRS = 300_000  # .. and pairs of pieces: about 80 MB


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece BPE model."""

    _loaded: dict = {}

    @classmethod
    def get(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.ids, self.score, self.byte_ids = {}, {}, [0] * 256
        spelled = [b""] * size
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                spelled[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                p = p.replace(MARK, " ")
                self.ids[p], self.score[p] = i, sp.get_score(i)
                spelled[i] = p.encode("utf-8")
        # lengths of the pieces that end in two given characters, longest first
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths_by_end = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        if any(" " in p.strip(" ") or p.endswith(" ") and p.strip(" ") for p in self.ids):
            raise ValueError("a piece has the word mark inside")
        self.lengths = np.array([len(b) for b in spelled], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        joined = np.zeros((256, 256), dtype=bool)  # neighbours inside some piece
        for b in spelled:
            a = np.frombuffer(b, np.uint8)
            joined[a[:-1], a[1:]] = True
        self.cut = ~joined
        self.cut[128:, :] = self.cut[:, 128:] = False  # never inside a character, nor beside one beyond ASCII
        self.index = HashIndex(1 << 17)  # grows as needed
        self._clear()

    def _clear(self) -> None:
        self.index.clear()
        self.flat, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: merge the best-scored (leftmost) neighbours while any are a piece."""
        out = list(text)
        score = self.score
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            out[at:at + 2] = [out[at] + out[at + 1]]
        return out

    def _may_follow(self, a: str, b: str) -> bool:
        ok = self.follows.get((a, b))
        if ok is None:
            ok = self.follows[a, b] = self.merge(a + b) == [a, b]
        return ok

    def _is_whole(self, p: str) -> bool:
        ok = self.whole.get(p)
        if ok is None:
            ok = self.whole[p] = len(p) == 1 or p in self.ids and self.merge(p) == [p]
        return ok

    def walk(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each word of a sorted list: a depth-first walk of its trie."""
        last: list[str] = [""]  # last[i]: last piece of the encoding of the first i characters
        before, lengths, ids, follows = "", self.lengths_by_end, self.ids, self.follows
        for word in words:
            n = min(len(word), len(before))
            same = 0
            while same < n and word[same] == before[same]:
                same += 1
            del last[same + 1:]
            for end in range(same + 1, len(word) + 1):
                for n in lengths.get(word[end - 2:end], ()) if end > 1 else ():
                    start = end - n
                    if start < 0:
                        continue
                    p = word[start:end]
                    if p in ids and self._is_whole(p):
                        if not start:
                            break
                        a = last[start]
                        ok = follows.get((a, p))
                        if ok or ok is None and self._may_follow(a, p):
                            break
                else:  # no longer piece may stand here
                    p = word[end - 1]
                last.append(p)
            before = word
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield out[::-1]

    def _ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of a run of UTF-8 texts."""
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        size = np.diff(offsets)
        full = size > 0
        lead = offsets[:-1][full]  # a blank goes before every text that is not empty
        text = np.insert(data, lead, 32)
        if bytes(text).find(MARK.encode()) >= 0:
            text, edges = self._unmarked(text, np.append(lead + np.arange(len(lead)), len(text)))
        else:
            edges = np.append(lead + np.arange(len(lead)), len(text))
        if not len(text):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(size), dtype=np.int64)
        new = np.empty(len(text), dtype=bool)
        new[1:] = self.cut[text[:-1], text[1:]] | (text[1:] == 32) & (text[:-1] != 32)
        new[edges[:-1]] = True
        start = np.flatnonzero(new)
        length = np.diff(start, append=len(text))
        if self.index.size > CACHE_WORDS:
            self._clear()
        if len(self.follows) > CACHE_PAIRS:
            self.follows.clear()
        h = run_hashes(text, start, length)
        at = self.index.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            names, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            where = missing[first]
            words = [bytes(text[s:s + n]).decode("utf-8") for s, n in zip(start[where].tolist(), length[where].tolist())]
            order = sorted(range(len(words)), key=words.__getitem__)
            ids = [self._ids_of(p) for p in self.walk([words[i] for i in order])]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.array([t for x in ids for t in x], dtype=np.uint32)])
            numbers = self.index.add(names[order])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])
            back = np.empty(len(words), dtype=np.int32)
            back[order] = numbers
            at[missing] = back[inverse]
        count = self.ends[at + 1] - self.ends[at]
        out = self.flat[ranges(self.ends[at], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        per = np.zeros(len(size), dtype=np.int64)
        per[full] = np.diff(total[np.searchsorted(start, edges)])
        return out, per

    @staticmethod
    def _unmarked(text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose mark characters are blanks."""
        parts = [bytes(text[a:b]).replace(MARK.encode(), b" ") for a, b in zip(edges[:-1], edges[1:])]
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 texts of runs of ids."""
        size = self.lengths[ids]
        joined = self.bytes[ranges(self.begins[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return [joined[a + 1 if joined[a:a + 1] == b" " else a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``exact`` (the ids decode
    to the text); columns of these names are replaced.  Rows go out in slices of
    about 1 MB of text, so memory follows the longest text, not the batch."""
    docs = docs.drop("token_ids", "n_tokens", "exact")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        vocab = Vocabulary.get(model_path)
        for batch in batches:
            data, off = utf8(batch.column(at))
            for lo, hi in slices(off):
                ids, counts = vocab.encode(data, off[lo:hi + 1])
                back = vocab.decode(ids, counts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                exact = [back[i] == data[off[lo + i]:off[lo + i + 1]].tobytes() for i in range(hi - lo)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))),
                     pa.array(counts), pa.array(exact, pa.bool_())], names=[*part.schema.names, "token_ids", "n_tokens", "exact"])
        vocab._clear()

    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def decode_texts(docs: DataFrame, model_path: str, ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of ``ids_col`` (null or unknown ids: nothing)."""
    @F.pandas_udf("string")
    def text(t: pd.Series) -> pd.Series:
        vocab = Vocabulary.get(model_path)
        out = []
        for ids in t:
            ids = np.array([] if ids is None else ids, dtype=np.int64)
            ids = ids[(ids >= 0) & (ids < len(vocab.lengths))]
            out.append(vocab.decode(ids, np.array([len(ids)]))[0].decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    return docs.withColumn("decoded", text(ids_col))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, exact): ids of every whole text (unsigned crc32
    of them as little-endian 32-bit integers) and whether decoding gives the text back."""
    def run(batches: Iterator[pa.RecordBatch]):
        vocab = Vocabulary.get(model_path)
        for batch in batches:
            data, off = utf8(batch.column(1))
            n, crc, exact = [], [], []
            for lo, hi in slices(off):
                ids, counts = vocab.encode(data, off[lo:hi + 1])
                back = vocab.decode(ids, counts)
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = ids.astype("<u4")
                for i in range(hi - lo):
                    n.append(int(counts[i]))
                    crc.append(zlib.crc32(raw[at[i]:at[i + 1]]))
                    exact.append(back[i] == data[off[lo + i]:off[lo + i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                                              pa.array(exact, pa.bool_())], names=["id", "n_tokens", "ids_crc32", "exact"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "id bigint, n_tokens bigint, ids_crc32 bigint, exact boolean").withColumnRenamed("id", id_col)
