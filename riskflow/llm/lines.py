"""Line deduplication by a deletion-neighbourhood join.

Lines are the parts of a text between line ends, trimmed of ASCII white space;
blank lines always stay.  A line goes when an earlier line (by id, then line
number) is equal, or, for lines of at least ``min_chars`` characters, is within
one edit (insertion, deletion or substitution of a character), whether that
earlier line itself stays or goes.

Equal lines meet on 128-bit hashes.  For one edit, all variants of a line with
one character deleted are hashed; two lines are within one edit exactly when a
variant of one equals the other, or variants with the same deleted place are
equal.  Before variants are made, lines that have no partner are left out by
exact pigeonhole keys: the edit lies in one of s segments of the longer line,
so the rest before and after it is equal.  Two segments are tried on all
distinct lines, SEGMENTS on the survivors, and variants are made only for the
deletion places of segments that met.  The earliest of a bucket is found by
aggregation (no pairs); text decides each removal in the end.

Defined results: null text = empty = one blank line; rows with a null id are
returned unchanged; rows that share an id count as one text repeated, so equal
lines of theirs all stay or all go together; other columns are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.filters import bitmap, keys_of, marked
from riskflow.llm.textcore import U64, inverse_powers, mix, powers, ranges, signed
from riskflow.session import materialize

SEGMENTS = 16
MIN_CHARS = 20
_CHUNK = 1 << 19
_SPACE = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)


class _Lines:
    """Trimmed lines of some texts as code points with prefix hashes."""

    def __init__(self, texts: list[str]):
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        counts = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.cumsum(counts + 1) - counts - 1
        ends = np.append(np.flatnonzero(cp == 10), len(cp))
        start = np.append(0, ends[:-1] + 1)
        solid = np.flatnonzero(~np.isin(cp, _SPACE))
        lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, ends)
        full = lo < hi
        self.doc = np.searchsorted(begin, start, "right") - 1
        self.number = np.arange(len(start)) - np.searchsorted(start, begin)[self.doc]
        self.doc, self.number = self.doc[full], self.number[full]
        self.s, self.e = solid[lo[full]], solid[hi[full] - 1] + 1
        self.n = self.e - self.s
        self.cp = cp
        longest = int(self.n.max()) if len(self.n) else 0
        pw, self.inv = powers(longest + 1), inverse_powers(longest + 1)
        at = ranges(self.s, self.n)
        terms = np.zeros(len(cp), dtype=U64)
        own = (cp[at].astype(U64) + U64(1))
        power = pw[at - np.repeat(self.s, self.n)]
        terms[at] = own * power
        self.p = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
        terms[at] = mix(own) * power
        p2 = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
        size = self.n.astype(U64)
        self.h1 = mix(self.p[self.e] - self.p[self.s] + size * U64(0xA24BAED4963EE407))
        self.h2 = mix(p2[self.e] - p2[self.s] + size * U64(0x9FB21C651E98DF25))

    def keys(self, which: np.ndarray, segments: int, shorter: bool) -> np.ndarray:
        """(lines x segments) keys of all but one segment, where the line is
        the longer of a pair (or as long) or, ``shorter``, lacks a character
        of that segment."""
        n = self.n[which]
        length = n + 1 if shorter else n
        j = np.arange(segments)
        a = length[:, None] * j // segments  # the segment [a, b) of the longer line
        b = length[:, None] * (j + 1) // segments
        tail = length[:, None] - b
        s, e = self.s[which][:, None], self.e[which][:, None]
        head = self.p[s + a] - self.p[s]
        rest = (self.p[e] - self.p[e - tail]) * self.inv[n[:, None] - tail]
        key = mix(head) + mix(rest + U64(0x5851F42D4C957F2D)) * U64(3)
        return mix(key + length[:, None].astype(U64) * U64(0xD1342543DE82EF95) + (segments * 64 + j).astype(U64))

    def variants(self, i: int, at: np.ndarray) -> np.ndarray:
        """Hashes of line i without the character at each place of ``at``."""
        s, e = self.s[i], self.e[i]
        cut = self.p[s + at] - self.p[s] + (self.p[e] - self.p[s + at + 1]) * self.inv[1]
        return mix(cut + np.full(1, self.n[i] - 1, dtype=U64) * U64(0xA24BAED4963EE407))


def _chunks(batch: pa.RecordBatch, id_at: int = 0, text_at: int = 1):
    ids, texts = batch.column(id_at), [t or "" for t in batch.column(text_at).to_pylist()]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _CHUNK):
            size += len(texts[hi])
            hi += 1
        yield ids.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64), _Lines(texts[lo:hi])
        lo = hi


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for ids, x in _chunks(batch):
                key = mix(x.h1 + x.doc.astype(U64) * U64(0x9E3779B97F4A7C15))
                first = np.zeros(len(key), dtype=bool)
                first[np.unique(key, return_index=True)[1]] = True
                two = np.zeros((len(key), 4), dtype=U64)
                long = np.flatnonzero(first & (x.n >= min_chars))
                if len(long):
                    two[long] = np.concatenate([x.keys(long, 2, False), x.keys(long, 2, True)], axis=1)
                mask = ~np.isin(np.arange(len(key)), long)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[x.doc]), pa.array(x.number.astype(np.int32)), pa.array(signed(x.h1)), pa.array(signed(x.h2)),
                     pa.array(~first), *(pa.array(signed(two[:, c]), mask=mask) for c in range(4))],
                    names=["id", "line", "h1", "h2", "again", "k0", "k1", "k2", "k3"])
    return run


def _pair_key(h1, ids):
    return signed(mix(h1 ^ mix(ids.view(U64))))


def _texts_of(sent):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for ids, x in _chunks(batch):
                want = marked(sent.value, mix(_pair_key(x.h1, ids[x.doc]).view(U64)))
                at = np.flatnonzero(want)
                text = [x.cp[x.s[i]:x.e[i]].tobytes().decode("utf-32-le", "surrogatepass") for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[x.doc[at]]), pa.array(x.number[at].astype(np.int32)), pa.array(signed(x.h1[at])),
                     pa.array(signed(x.h2[at])), pa.array(text, pa.string())], names=["id", "line", "h1", "h2", "t"])
    return run


def _one_text_lines(texts: list[str]) -> _Lines:
    x = _Lines(texts)
    if len(x.n) != len(texts):
        raise ValueError("a line without text")
    return x


def _segment_keys(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _one_text_lines(batch.column("t").to_pylist())
        every = np.arange(len(x.n))
        keys = np.concatenate([x.keys(every, SEGMENTS, False), x.keys(every, SEGMENTS, True)], axis=1)
        which = np.repeat(every, 2 * SEGMENTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(keys.ravel())), batch.column("h1").take(pa.array(which)), batch.column("h2").take(pa.array(which)),
             pa.array(np.tile(np.arange(2 * SEGMENTS, dtype=np.int32), len(every)))], names=["key", "h1", "h2", "seg"])


def _variants(batches: Iterator[pa.RecordBatch]):
    """The line itself (place -1) and its variants in the segments that met."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _one_text_lines(batch.column("t").to_pylist())
        rows, places, hashes = [], [], []
        for i, segs in enumerate(batch.column("segs").to_pylist()):
            n = int(x.n[i])
            at = [np.arange(n * j // SEGMENTS, n * (j + 1) // SEGMENTS) for j in segs if j < SEGMENTS]
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            rows += [np.full(len(at) + 1, i)]
            places += [np.append(at, -1)]
            hashes += [np.append(x.variants(i, at), x.h1[i])]
        which = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(np.concatenate(hashes))), pa.array(np.concatenate(places).astype(np.int32)),
             *(batch.column(c).take(which) for c in ("h1", "h2", "id", "line"))],
            names=["v", "place", "h1", "h2", "id", "line"])


def within_one_edit(a: str, b: str) -> bool:
    """Edit distance of at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _check(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ok = [within_one_edit(a, b) for a, b in zip(batch.column("t").to_pylist(), batch.column("u").to_pylist())]
        yield batch.select(["h1", "h2"]).filter(pa.array(ok, pa.bool_()))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_edits: int = 1,
                   min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, line, near): the lines that go; ``near`` tells those without an equal earlier line."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    if min_chars < SEGMENTS:
        raise ValueError(f"min_chars is at least {SEGMENTS}")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("x")).where("id is not null")
    lines = materialize(src.mapInArrow(
        _hash_lines(min_chars), "id bigint, line int, h1 bigint, h2 bigint, again boolean, k0 bigint, k1 bigint, k2 bigint, "
                                "k3 bigint"), "ld-lines")
    ones = lines.where("not again")
    first = materialize(ones.groupBy("h1", "h2").agg(F.min("id").alias("first"), *(F.first(f"k{i}", True).alias(f"k{i}") for i in range(4))),
                        "ld-first")
    drops = lines.join(first.select("h1", "h2", "first"), ["h1", "h2"]).withColumn("equal", F.expr("again or id <> first"))
    if max_edits == 0:
        return drops.where("equal").select("id", "line", F.lit(False).alias("near"))
    keyed = first.where("k0 is not null").select("h1", "first", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("key")
    met = keyed.join(shared, "key").select("h1", "first").distinct()

    def pair_keys(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pair_key(
                b.column(0).to_numpy().view(U64), b.column(1).to_numpy().astype(np.int64)))], names=["k"])

    sent = spark.sparkContext.broadcast(bitmap(met.mapInArrow(pair_keys, "k bigint")))
    texts = materialize(
        src.mapInArrow(_texts_of(sent), "id bigint, line int, h1 bigint, h2 bigint, t string")
        .join(first.where("k0 is not null").select("h1", "h2", F.col("first").alias("id")), ["h1", "h2", "id"])
        .groupBy("h1", "h2", "id").agg(F.min("line").alias("line"), F.first("t").alias("t")), "ld-texts")
    segs = texts.mapInArrow(_segment_keys, "key bigint, h1 bigint, h2 bigint, seg int")
    close = segs.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("key")
    places = segs.join(close, "key").groupBy("h1", "h2").agg(F.collect_set("seg").alias("segs"))
    v = materialize(texts.join(places, ["h1", "h2"]).mapInArrow(
        _variants, "v bigint, place int, h1 bigint, h2 bigint, id bigint, line int"), "ld-variants")
    v = v.withColumn("o", F.struct("id", "line", "h1", "h2"))
    cut, whole = v.where("place >= 0"), v.where("place < 0")
    earlier = (cut.select("v", "place", "h1", "h2").join(cut.groupBy("v", "place").agg(F.min("o").alias("m")), ["v", "place"])
               .select("h1", "h2", "m")
               .union(cut.select("v", "h1", "h2").join(whole.select("v", F.col("o").alias("m")), "v").select("h1", "h2", "m"))
               .union(whole.select("v", "h1", "h2").join(cut.groupBy("v").agg(F.min("o").alias("m")), "v").select("h1", "h2", "m")))
    mates = (earlier.groupBy("h1", "h2").agg(F.min("m").alias("m")).join(texts, ["h1", "h2"])
             .where("struct(m.id, m.line) < struct(id, line)")
             .select("h1", "h2", "t", F.col("m.h1").alias("g1"), F.col("m.h2").alias("g2")))
    near = mates.join(texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("t").alias("u")), ["g1", "g2"]).select(
        "h1", "h2", "t", "u").mapInArrow(_check, "h1 bigint, h2 bigint").distinct().withColumn("near", F.lit(True))
    near = materialize(near, "ld-near")
    return (drops.join(near, ["h1", "h2"], "left").where("equal or near")
            .select("id", "line", F.expr("not equal").alias("near")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_edits: int = 1,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and ``n_lines``
    (lines with text), ``n_equal``, ``n_near`` (lines that went)."""
    drops = repeated_lines(docs, id_col, text_col, max_edits=max_edits, min_chars=min_chars)
    per = drops.groupBy("id").agg(F.collect_set(F.expr("if(near, null, line)")).alias("equal_"),
                                  F.collect_set(F.expr("if(near, line, null)")).alias("near_"))
    joined = docs.join(per.withColumnRenamed("id", "id_"), F.col(id_col).cast("long") == F.col("id_"), "left").drop("id_")

    @F.pandas_udf("struct<t:string,n:long>")
    def cut(text: pd.Series, equal: pd.Series, near: pd.Series) -> pd.DataFrame:
        out, solid = [], []
        for t, *gone in zip(text, equal, near):
            rows = [] if t is None else t.split("\n")
            solid.append(sum(bool(r.strip("\t\n\v\f\r ")) for r in rows))
            go = {int(i) for g in gone if g is not None for i in g}
            out.append("\n".join([r for i, r in enumerate(rows) if i not in go]) if go else t)
        return pd.DataFrame({"t": out, "n": solid})

    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    joined = joined.withColumn("cut_", cut(F.col(text_col).cast("string"), "equal_", "near_"))
    return joined.select(*[(F.col("cut_.t").alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns],
                         F.col("cut_.n").alias("n_lines"), count("equal_").alias("n_equal"), count("near_").alias("n_near"))
