"""Bounded bitmaps of hashed keys: a scan can leave out rows that cannot join,
without a shuffle and whatever the number of keys.  A bitmap never leaves out a
row that belongs; when it fills up it only lets more rows through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.textcore import U64, mix, signed

BITS = 26  # 8 MB


def keys_of(column) -> np.ndarray:
    """A long column as hashes (null as 0)."""
    return mix(pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))


def _words(keys: DataFrame, bits: int) -> DataFrame:
    """(w, b): the words of the bitmap that are not zero."""
    def run(batches):
        words = np.zeros(1 << (bits - 6), dtype=U64)
        for batch in batches:
            at = keys_of(batch.column(0)) >> U64(64 - bits)
            np.bitwise_or.at(words, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(signed(words[full]))], names=["w", "b"])

    return keys.mapInArrow(run, "w bigint, b bigint").groupBy("w").agg(F.expr("bit_or(b)").alias("b"))


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap of the one long column of ``keys``; at most 2^(bits - 6) words reach the driver."""
    out = np.zeros(1 << (bits - 6), dtype=U64)
    for r in _words(keys, bits).collect():
        out[r["w"]] = r["b"] & (2 ** 64 - 1)
    return out


def full_bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """``bitmap`` for key sets that fill it: its words (16 bytes each) reach the driver as columns."""
    out = np.zeros(1 << (bits - 6), dtype=U64)
    words = _words(keys, bits).toArrow()
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(U64)
    return out


def marked(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (from ``keys_of``) may be in the bitmap."""
    at = hashes >> U64(64 - (len(words).bit_length() + 5))
    return ((words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).astype(bool)
