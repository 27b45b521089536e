"""Token ids as directly addressable codes (DACs) in range-ordered segment files.

An id is split into 8-bit chunks.  Level 0 holds the low chunk of every id;
level l + 1 holds the next chunk of those ids of level l that need one.  Each
level has a continuation bitmap (bit set: the id goes on) and a rank directory
(set bits before every 512-bit block), so token i is read by following
``rank`` through the levels, without decoding a block.

File format: a Parquet folder of segments.  One row is one segment of whole
documents: ``part`` and ``seq`` (their order is the order of doc_id),
``before`` (ids of the same part before the segment), ``doc_ids``,
``doc_ends`` (end of each document inside the segment) and ``dac``, a
self-contained little-endian payload:

    magic 'DAC1' | levels u8 | ids u64 | per level: chunks u64, chunk bytes,
    bitmap bytes (ceil(chunks / 8)), rank u32 per 512-bit block

Defined results: null or empty text has the end id alone; rows with a null id
come first; repeated ids keep all their rows; other input columns are ignored."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.textcore import HashIndex, ranges, run_hashes, slices, utf8
from riskflow.session import scratch_path

MAGIC = b"DAC1"
RANK_BITS = 512
SEGMENT_BYTES = 1 << 20  # text bytes of one segment (a longer document stands alone)
CACHE_PIECES = 1_500_000  # kept per worker process: about 100 MB

#: UTF-8 of the Unicode white space beyond ASCII; texts with it are encoded whole.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _classes() -> np.ndarray:
    """Byte classes: 0 other, 1 ASCII letter, 2 digit, 3 sign, 4 apostrophe, 5 white space."""
    c = np.zeros(256, dtype=np.uint8)
    for b in range(128):
        ch = chr(b)
        c[b] = 1 if ch.isalpha() else 2 if ch.isdigit() else 4 if ch == "'" else 3 if 33 <= b < 127 else 0
    c[[9, 10, 11, 12, 13, 32]] = 5
    return c


_CLASS = _classes()
#: Class pairs between which the byte-level pre-tokeniser always cuts.
_CUT = np.zeros((6, 6), dtype=bool)
for _p, _c in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2)):
    _CUT[_p, _c] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pieces of a run of texts start: cuts that the
    byte-level pre-tokeniser makes for sure.  A blank before a word belongs to
    the word; the white space before that is a piece of its own."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    cls = _CLASS[data]
    ws = cls == 5
    head = np.zeros(n + 1, dtype=bool)
    head[offsets] = True
    cut = head[:n].copy()
    prev_ws, prev = ws[:-1], data[:-1]
    inner = ~prev_ws & ws[1:]
    inner |= ~ws[1:] & prev_ws & (prev != 32)
    inner |= _CUT[cls[:-1], cls[1:]]
    last = np.zeros(n - 1, dtype=bool)  # the last of two or more white-space bytes before a word
    last[:-1] = prev_ws[:-1] & ws[1:-1] & ~ws[2:] & ~head[2:n]
    cut[1:] |= inner | last
    return np.flatnonzero(cut)


def encode_dac(ids: np.ndarray) -> bytes:
    """The payload of a sequence of unsigned ids."""
    v = np.ascontiguousarray(ids, dtype=np.uint64)
    levels = []
    while True:
        rest = v >> np.uint64(8)
        more = rest > 0
        pad = np.zeros(-len(more) % RANK_BITS, dtype=bool)
        counts = np.concatenate([more, pad]).reshape(-1, RANK_BITS).sum(axis=1) if len(more) else np.zeros(0, np.int64)
        rank = (np.cumsum(counts) - counts).astype("<u4")
        levels.append((v & np.uint64(255)).astype(np.uint8).tobytes()
                      + np.packbits(more, bitorder="little").tobytes() + rank.tobytes())
        sizes = len(v)
        levels[-1] = struct.pack("<Q", sizes) + levels[-1]
        if not more.any():
            break
        v = rest[more]
    return MAGIC + struct.pack("<BQ", len(levels), len(ids)) + b"".join(levels)


class Dac:
    """Reader of one payload: ``d[i]`` is random access, ``decode()`` all ids."""

    def __init__(self, blob: bytes):
        if bytes(blob[:4]) != MAGIC:
            raise ValueError("not a DAC payload")
        levels, self.n = struct.unpack_from("<BQ", blob, 4)
        at, self.levels = 13, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bits = np.frombuffer(blob, np.uint8, -(-n // 8), at)
            at += len(bits)
            rank = np.frombuffer(blob, "<u4", -(-n // RANK_BITS), at)
            at += 4 * len(rank)
            self.levels.append((chunks, bits, rank))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out, shift = 0, 0
        for chunks, bits, rank in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            lo = block * RANK_BITS // 8
            inside = np.bitwise_count(bits[lo:i >> 3]).sum() + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i = int(rank[block]) + int(inside)
            shift += 8
        return out

    def decode(self) -> np.ndarray:
        out = np.zeros(self.n, dtype=np.uint32)
        at = np.arange(self.n)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


class PieceEncoder:
    """Ids of whole texts through the tokenizers library.  Distinct pieces are
    encoded once and kept in a bounded per-process table."""

    _loaded: dict = {}

    @classmethod
    def get(cls, path: str) -> PieceEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode("utf-8") for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None  # a text that holds one is encoded whole
        self.line_end = self._ids(["\n"])[0]
        if len(self.line_end) != 1:
            raise ValueError("the vocabulary has no id for a line end")
        self.index = HashIndex(CACHE_PIECES)
        self._clear()

    def _clear(self) -> None:
        self.index.clear()
        self.flat = np.zeros(0, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece).  Words go as one text, a line a
        word (a line end is always a piece of its own); white space goes alone."""
        words = [i for i, w in enumerate(pieces) if not w.isspace()]
        blank = [i for i, w in enumerate(pieces) if w.isspace()]
        lens = np.zeros(len(pieces), dtype=np.int64)
        ids = np.array(self._ids(["\n".join([pieces[i] for i in words])])[0] if words else [], dtype=np.uint32)
        cut = ids == self.line_end[0]
        if words:
            lens[words] = np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])) - 1
        alone = self._ids([pieces[i] for i in blank])
        lens[blank] = [len(x) for x in alone]
        order = np.array(words + blank, dtype=np.int64)
        begin = np.empty(len(pieces), dtype=np.int64)
        begin[order] = np.cumsum(lens[order]) - lens[order]
        flat = np.concatenate([ids[~cut], np.array([t for x in alone for t in x], dtype=np.uint32)])
        return flat[ranges(begin, lens)], lens

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text) of a run of UTF-8 texts."""
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        if WIDE_SPACE.search(data) or self.added and self.added.search(data):
            alone = self._ids([bytes(data[a:b]).decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:])])
            return (np.array([t for x in alone for t in x], dtype=np.uint32),
                    np.array([len(x) for x in alone], dtype=np.int64))
        if self.index.size > CACHE_PIECES:
            self._clear()
        start = piece_starts(data, offsets)
        length = np.diff(start, append=len(data))
        h = run_hashes(data, start, length)
        at = self.index.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            where = missing[first]
            flat, lens = self._encode_new(
                [bytes(data[s:s + n]).decode("utf-8") for s, n in zip(start[where].tolist(), length[where].tolist())])
            at[missing] = self.index.add(new)[inverse]
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])
        size = self.ends[at + 1] - self.ends[at]
        out = self.flat[ranges(self.ends[at], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return out, np.diff(total[np.searchsorted(start, offsets)])


_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()),
                      ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("dac", pa.binary())])


def _writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]):
        enc = PieceEncoder.get(path)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ids = batch.column(0)
            data, off = utf8(batch.column(1))
            for lo, hi in slices(off, SEGMENT_BYTES):
                flat, counts = enc.encode(data, off[lo:hi + 1])
                ends = np.cumsum(counts + 1)
                out = np.empty(len(flat) + len(counts), dtype=np.uint32)
                inside = np.ones(len(out), dtype=bool)
                inside[ends - 1] = False
                out[inside] = flat
                out[~inside] = end_id
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()),
                     pa.array([len(out)], pa.int64()), pa.array([ids.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                     pa.array([ends], pa.list_(pa.int64())), pa.array([encode_dac(out)], pa.binary())], schema=_SEGMENT)
                seq, before = seq + 1, before + len(out)
    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts and write segment files in ascending id order; the path."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    (src.repartitionByRange(parts, "id").sortWithinPartitions("id")
     .mapInArrow(_writer(tokenizer_path, end_id),
                 "part int, seq bigint, before bigint, n_ids bigint, doc_ids array<bigint>, doc_ends array<bigint>, dac binary")
     .write.parquet(path))
    return path


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part: one number a part (bounded by the number of partitions)."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    out, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        out[r["part"]] = at
        at += r["n"]
    return out


def read_tokens(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, ``start``, ``n_tokens``, ``ids_crc32``, ``last_id``."""
    starts = part_starts(spark, path)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, before, doc_ids, ends, blob in zip(*(batch.column(c) for c in ("part", "before", "doc_ids", "doc_ends", "dac"))):
                d = Dac(blob.as_buffer())
                ids = d.decode().astype("<u4")
                end = np.array(ends.as_py(), dtype=np.int64)
                begin = np.concatenate([[0], end[:-1]])
                crc = [zlib.crc32(ids[b:e]) for b, e in zip(begin, end)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(begin + (starts[part.as_py()] + before.as_py())),
                     pa.array(end - begin), pa.array(crc, pa.int64()), pa.array([d[int(e) - 1] for e in end], pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32", "last_id"])

    got = spark.read.parquet(path).select("part", "before", "doc_ids", "doc_ends", "dac").mapInArrow(
        run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, last_id bigint")
    return got.withColumnRenamed("id", id_name)


def tokens_between(spark: SparkSession, path: str, first: int, last: int) -> list[int]:
    """Ids [first, last) of the whole corpus by random access: only the segments
    that hold them are read, and of those only the asked positions."""
    starts = part_starts(spark, path)
    at = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("part")] + F.col("before")
    rows = (spark.read.parquet(path).withColumn("at", at)
            .where((F.col("at") < last) & (F.col("at") + F.col("n_ids") > first)).orderBy("at").select("at", "dac").collect())
    return [d[i - r["at"]] for r in rows for d in [Dac(bytes(r["dac"]))]
            for i in range(max(first, r["at"]), min(last, r["at"] + len(d)))]
