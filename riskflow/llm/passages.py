"""Substring dedup: passages of more than ``min_words - 1`` words that repeat
across documents, whole paragraphs or parts of them.

Method: a paragraph is every window of ``window`` consecutive ANCHOR-word
shingles, taken at every word, so a passage inside a longer text is a paragraph
too.  Each paragraph's MinHash is a one-row band, tuned for recall: the windows
of a run of equal words hold equal shingles, so runs of window + ANCHOR - 1 = 25
words share a band key for certain.  A passage of 51 words or more without
repeated shingles whose Jaccard is 0.8 has such a run: an edit of it costs 8 or
more of the lost shingles (0.8 times for the other text's), a fifth of them may
be lost, so it has one edit up to 83 words, and its longer side 25 words.
(Neighbouring windows mostly share their minimum, which is emitted once.)
Paragraphs with a key of several documents are joined to the key's earliest
document.  The equal runs of both texts along the hits, and those past edits
beside them, are chained; the longest spans from run to run of exact Jaccard of
five-word shingles of at least ``overlap`` are the passages, so a passage begins
and ends with equal words.  Components of the verified pairs cluster the removals.

A star to the earliest document, not all pairs, is formed: a passage of n
documents gives n - 1 removals, each with the document that keeps it.

The earliest document of a key may hold only a shorter piece.  So places whose
key three or more documents hold, and that no verified passage covers, get a
second pass with longer keys: first PARTS long keys a place, together part of
each run of ``min_words`` words around it, then those runs themselves where a
long key met.  Equal runs of ``min_words`` words are thus found whatever shorter
pieces come before; not covered is a run whose key the earliest document holds
at several places, as only the first of them is compared.

Defined results: null or empty text has no passage; words are runs of other
than ASCII white space, A-Z lower-cased; repeats inside one document and rows
with a null id are not reported; rows that share an id count as one document
(one of their texts is compared); other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.filters import bitmap, full_bitmap, keys_of, marked
from riskflow.llm.graph import connected_components
from riskflow.llm.textcore import SPACE_WORDS, Words, shingles, signed, slices, utf8
from riskflow.session import materialize

ANCHOR = 10
WINDOW = 16
SHINGLE = 5
LONG = WINDOW + ANCHOR - 1  # words of a window
GAP = 56  # words between hits of one chain
REACH = 16  # words that an edit may take
END = 6  # words at a passage's end that are looked through for equal ones behind an edit
CONTEXT = 96  # words compared at a time
PARTS = 4


def window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the (leftmost) minimum of each window of ``h``, window after window."""
    at, width = np.arange(len(h)), 1
    while width < min(window, len(h)):  # windows of twice the width, or as much wider as is left
        step = min(width, min(window, len(h)) - width)
        left, right = at[:-step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        width += step
    return at


def _docs(batch):
    data, off = utf8(batch.column(1))
    for lo, hi in slices(off):
        w = Words(data, off[lo:hi + 1], SPACE_WORDS)
        for i in range(hi - lo):
            yield lo + i, w.hash[w.first[i]:w.first[i + 1]]


def _anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = utf8(batch.column(1))
            out = [(np.zeros(0, np.int64),) * 3]
            for lo, hi in slices(off):
                w = Words(data, off[lo:hi + 1], SPACE_WORDS)
                if len(w.hash) < LONG:
                    continue
                s = shingles(w.hash, ANCHOR)
                at = window_minima(s, WINDOW)
                whole = (w.doc[:len(at)] == w.doc[LONG - 1:]) & (np.diff(w.first)[w.doc[:len(at)]] >= min_words)
                at = at[whole]
                at = at[np.diff(at, prepend=-1) != 0]  # neighbouring windows mostly share theirs
                doc = w.doc[at]
                out.append((signed(s[at]), ids[lo + doc].astype(np.int64), at - w.first[doc]))
            key, doc, pos = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(pos.astype(np.int32))], names=["key", "id", "pos"])
    return run


def _chains(batches: Iterator[pa.RecordBatch]):
    """Runs of hits of one pair without shift and with small gaps (a run that a
    batch cuts in two is extended to the whole from both parts)."""
    for batch in batches:
        a, b, p, q = (batch.column(c).to_numpy().astype(np.int64) for c in ("id", "kid", "pos", "kpos"))
        if not len(a):
            continue
        part = np.ones(len(a), dtype=bool)
        part[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (p[1:] - p[:-1] > GAP) | (p[1:] - q[1:] != p[:-1] - q[:-1])
        s = np.flatnonzero(part)
        e = np.append(s[1:], len(a)) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (a[s], b[s], p[s], p[e] + ANCHOR, q[s], q[e] + ANCHOR)],
            names=["id", "kid", "s", "e", "ks", "ke"])


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """Words at the start of both that are equal."""
    n, at = min(len(x), len(y)), 0
    if n and x[0] != y[0]:
        return 0
    while at < n:
        diff = np.flatnonzero(x[at:min(n, at + CONTEXT)] != y[at:min(n, at + CONTEXT)])
        if len(diff):
            return at + int(diff[0])
        at += CONTEXT
    return n


def _walk(a: np.ndarray, b: np.ndarray, x: int, y: int) -> list[tuple[int, int, int, int]]:
    """Equal runs (s, e, ks, ke) in words from (x, y) on, each a shingle or longer
    and at most REACH words past the run before; ``a``, ``b`` are shingles."""
    out = []
    while x < len(a) and y < len(b):
        at, to = np.nonzero(a[x:x + REACH + 1, None] == b[y:y + REACH + 1])
        if not len(at):
            break
        near = int((at + to).argmin())
        x, y = x + int(at[near]), y + int(to[near])
        n = _equal(a[x:], b[y:]) + SHINGLE - 1
        out.append((x, x + n, y, y + n))
        x, y = x + n, y + n
    return out


def _aligned(wa: np.ndarray, wb: np.ndarray, sa: np.ndarray, sb: np.ndarray, spans) -> list[list[tuple[int, int, int, int]]]:
    """Chains of equal runs in the order of both texts: the runs on the spans'
    diagonals and those that lie between and around them past edits
    (``sa``, ``sb``: the texts' shingles)."""
    runs, done = set(), {}
    for s, e, ks, ke in sorted(spans):
        if e <= done.get(ks - s, 0):
            continue
        left, right = _equal(wa[:s][::-1], wb[:ks][::-1]), _equal(wa[e:], wb[ke:])
        s, e, ks, ke = s - left, e + right, ks - left, ke + right
        done[ks - s] = e
        same = wa[s:e] == wb[ks:ke]
        if same.all():
            runs.add((s, e, ks, ke))
            continue
        same = np.concatenate([[False], same, [False]]).astype(np.int8)
        for lo, hi in np.flatnonzero(np.diff(same)).reshape(-1, 2).tolist():
            if hi - lo >= SHINGLE:
                runs.add((s + lo, s + hi, ks + lo, ks + hi))
    chains, near = [], {}  # near: chains by the diagonal of their last run, in strips of REACH + 1
    for s, e, ks, ke in sorted(runs):
        strip, best = (s - ks) // (REACH + 1), None
        for i in sorted({i for d in (strip - 1, strip, strip + 1) for i in near.get(d, ())}):
            at, before, kat, kbefore = chains[i][-1]
            shift = abs((s - ks) - (at - kat))
            if s - before > GAP or shift > REACH or best is not None and shift >= best[0]:
                continue
            cut = max(before - s, kbefore - ks, 0)
            if e - s - cut >= SHINGLE:
                best = shift, cut, i
        if best:
            _, cut, i = best
            chains[i].append((s + cut, e, ks + cut, ke))
        else:
            i = len(chains)
            chains.append([(s, e, ks, ke)])
        held = near.setdefault(strip, [])
        held[:] = [j for j in held if s - chains[j][-1][1] <= GAP and j != i] + [i]
    out = []
    edge = SHINGLE - 1
    for c in chains:
        full, x, y = [], 0, 0
        for n, (s, e, ks, ke) in enumerate(c):
            if n:
                full += _walk(sa[:s - edge], sb[:ks - edge], x, y)
                x, y = full[-1][1], full[-1][3]
            back = _walk(sa[x:max(x, s - edge)][::-1], sb[y:max(y, ks - edge)][::-1], 0, 0)
            full += [(s - j, s - i, ks - v, ks - u) for i, j, u, v in back[::-1]] + [(s, e, ks, ke)]
            x, y = e, ke
        out.append(full + _walk(sa, sb, x, y))
    return out


def _maximal(chain, overlap: float) -> list[tuple[int, int, int, int]]:
    """The longest spans from run to run of a chain whose shingles on the runs
    are ``overlap`` of all, none inside another."""
    s, e, ks, ke = np.array(chain, dtype=np.int64).T
    held = np.concatenate([[0], np.cumsum(e - s - SHINGLE + 1)]) * (1 + overlap)
    gain = held[1:] - overlap * (e + ke)  # last - first >= 0: the span from first to last holds
    need = held[:-1] - overlap * (s + ks + 2 * (SHINGLE - 1)) - 1e-9
    best = np.maximum.accumulate(gain[::-1])  # ascending
    last = len(s) - 1 - np.searchsorted(best, need)
    out, far = [], -1
    for i, j in enumerate(last.tolist()):
        if j > far:
            out.append((int(s[i]), int(e[j]), int(ks[i]), int(ke[j])))
            far = j
    return out


def _share(wa, wb, s: int, e: int, ks: int, ke: int) -> float:
    p, q = np.unique(shingles(wa[s:e], SHINGLE)), np.unique(shingles(wb[ks:ke], SHINGLE))
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / (len(p) + len(q) - both)


def _ends(a: np.ndarray, b: np.ndarray, i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Words of both texts up to the equal words behind one-word edits."""
    out = [(i, j)]
    for x, y in ((i + 1, j + 1), (i, j + 1), (i + 1, j)):
        n = _equal(a[x:END], b[y:END])
        if n:
            out += _ends(a, b, x + n, y + n)
    return out


def _with_ends(wa, wb, span, min_words: int) -> list[tuple[int, int, int, int]]:
    """A span under ``min_words`` words with the few equal words that stand
    behind an edit at its ends (too few for a shingle), where that suffices."""
    s, e, ks, ke = span
    if e - s < min_words - 2 * END:
        return []
    left, right = _ends(wa[max(0, s - END):s][::-1], wb[max(0, ks - END):ks][::-1]), _ends(wa[e:e + END], wb[ke:ke + END])
    longer = [(s - i, e + x, ks - j, ke + y) for i, j in left for x, y in right if e - s + i + x >= min_words]
    return sorted(longer, key=lambda r: (-_share(wa, wb, *r), r))[:1]


def _inner(s: int, e: int, n: int, min_words: int) -> tuple[int, int]:
    """First and last anchor place whose runs of ``min_words`` words all lie in
    the span (a text of ``n`` words has none beyond its ends)."""
    return s + (min_words - ANCHOR if s else 0), e - (min_words if e < n else ANCHOR)


def _verified(a: int, b: int, wa, wb, sa, sb, spans, min_words: int, overlap: float) -> list[tuple]:
    """Result rows of the passages of one pair that hold."""
    out = set()

    def add(s, e, ks, ke):
        equal = e - s == ke - ks and bool((wa[s:e] == wb[ks:ke]).all())
        share = 1.0 if equal else _share(wa, wb, s, e, ks, ke)
        if share >= overlap:
            out.add((a, s, e, b, ks, share) + (_inner(s, e, len(wa), min_words) if equal else (None, None)))
        return share >= overlap

    for shift in sorted({ks - s for s, _, ks, _ in spans}):
        if 0 <= shift <= len(wb) - len(wa) and wa[0] == wb[shift] and (wa == wb[shift:shift + len(wa)]).all():
            add(0, len(wa), shift, shift + len(wa))  # a copy: all other passages of the pair lie inside
            return list(out)
    for chain in _aligned(wa, wb, sa, sb, spans):
        whole = (chain[0][0], chain[-1][1], chain[0][2], chain[-1][3])
        if whole[1] - whole[0] < min_words - 2 * END:  # too short with any ends
            continue
        if whole[1] - whole[0] >= min_words and add(*whole):
            continue
        for span in _maximal(chain, overlap):
            if span[1] - span[0] < min_words:
                for longer in _with_ends(wa, wb, span, min_words):
                    add(*longer)
            elif span == whole or not add(*span):  # shingles that repeat: else the equal runs
                for s, e, ks, ke in chain:
                    if e - s >= min_words and span[0] <= s and e <= span[1]:
                        add(s, e, ks, ke)
    return list(out)


def _verifier(min_words: int, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]):
        last = None
        for batch in batches:
            out = []
            spans = batch.column("spans")
            ends = spans.offsets.to_numpy().tolist()
            flat = spans.values
            parts = np.stack([flat.field(c).to_numpy() for c in ("s", "e", "ks", "ke")], axis=1).tolist()
            ids, kids = (batch.column(c).to_pylist() for c in ("id", "kid"))
            for n, (x, y) in enumerate(zip(batch.column("wa"), batch.column("wb"))):
                wa, wb = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if kids[n] != last:  # rows of one keeper follow each other
                    last, sb = kids[n], shingles(wb, SHINGLE)
                each = {tuple(r) for r in parts[ends[n]:ends[n + 1]]}
                out += _verified(ids[n], kids[n], wa, wb, shingles(wa, SHINGLE), sb, each, min_words, overlap)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate([pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 2)],
                names=["doc_id", "start_word", "end_word", "keep_doc_id", "keep_start_word", "similarity", "inner_from", "inner_to"])
    return run


def _long_keys(min_words: int):
    """Keys around open places: every run of ``min_words`` words that holds a
    place's anchor holds the stretch of one of the place's PARTS keys."""
    step = -(-(min_words - ANCHOR + 1) // PARTS)
    size = min_words - step + 1

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)]
            for i, places, w in zip(*(batch.column(c) for c in ("id", "places", "w"))):
                h = shingles(np.frombuffer(w.as_buffer(), np.uint64), size)
                pos = np.array([r["pos"] for r in places.as_py()], dtype=np.int64)
                opened = np.array([r["open"] for r in places.as_py()], dtype=bool)
                for part in range(PARTS):
                    at = pos - part * step
                    ok = (at >= 0) & (at < len(h))
                    out.append((signed(h[at[ok]]), np.full(ok.sum(), i.as_py()), at[ok], opened[ok]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "id", "at", "open"])
    return run


def _full_runs(min_words: int):
    """The runs of ``min_words`` words that hold a long key's stretch."""
    step = -(-(min_words - ANCHOR + 1) // PARTS)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)]
            for i, places, w in zip(*(batch.column(c) for c in ("id", "places", "w"))):
                h = shingles(np.frombuffer(w.as_buffer(), np.uint64), min_words)
                rows = places.as_py()
                at = (np.array([r["at"] for r in rows], dtype=np.int64)[:, None] - np.arange(step)).ravel()
                opened = np.repeat(np.array([r["open"] for r in rows], dtype=bool), step)
                ok = (at >= 0) & (at < len(h))
                start = np.unique(at[ok])
                out.append((signed(h[start]), np.full(len(start), i.as_py()), start, np.isin(start, at[ok & opened])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "id", "at", "open"])
    return run


def _only(held: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose first column a bitmap of ``ids`` marks, before any exchange."""
    needed = held.sparkSession.sparkContext.broadcast(full_bitmap(ids.distinct()))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.filter(pa.array(marked(needed.value, keys_of(batch.column(0)))))

    return held.mapInArrow(run, held.schema)


def _second_spans(hits: DataFrame, found: DataFrame, held: DataFrame, min_words: int) -> DataFrame:
    """Spans of equal runs between documents of which neither is the earliest
    of the keys in the run, for places that ``found`` does not cover.  A partner
    whose run equals an earlier document's is left to that document."""
    schema = "key bigint, id bigint, at bigint, open boolean"
    cover = found.select(F.col("doc_id").alias("id"), "start_word", "end_word").distinct()
    hit = hits.where("id <> kid").select("key", "id", F.col("pos").cast("long").alias("pos"))
    uncovered = hit.join(cover, [hit.id == cover.id, hit.pos >= cover.start_word, hit.pos + ANCHOR <= cover.end_word], "left_anti")
    wanted = uncovered.groupBy("key").agg(F.max("id").alias("last"))  # partners come before an open place
    several = hit.groupBy("key").agg((F.min("id") < F.max("id")).alias("several")).where("several").select("key")
    near = hit.join(wanted, "key").where("id <= last").drop("last").join(several, "key", "left_semi")
    inner = found.where("inner_from <= inner_to").select(F.col("doc_id").alias("id"), "inner_from", "inner_to").distinct()
    partners = near.join(inner, [near.id == inner.id, near.pos >= inner.inner_from, near.pos <= inner.inner_to], "left_anti")
    places = partners.select("id", "pos", F.lit(False).alias("open")).union(uncovered.join(several, "key", "left_semi").select("id", "pos", F.lit(True)))
    places = materialize(places.groupBy("id", "pos").agg(F.max("open").alias("open")), "pg-open")

    def met(keys: DataFrame, name: str) -> DataFrame:
        keys = materialize(keys, name)
        first = (keys.groupBy("key").agg(F.min(F.struct("id", "at")).alias("k"), F.max(F.when(F.col("open"), F.col("id"))).alias("last"))
                 .where("k.id < last").select("key", F.col("k.id").alias("kid"), F.col("k.at").alias("kat")))
        return keys.join(first, "key")

    def with_words(places: DataFrame) -> DataFrame:
        return places.join(_only(held, places.select("id")), "id")

    longer = met(with_words(places.groupBy("id").agg(F.collect_set(F.struct("pos", "open")).alias("places")))
                 .mapInArrow(_long_keys(min_words), schema), "pg-long")
    longer = materialize(longer, "pg-longer")
    runs = met(with_words(longer.groupBy("id").agg(F.collect_set(F.struct("at", "open")).alias("places")))
               .mapInArrow(_full_runs(min_words), schema), "pg-runs")
    return runs.where("open and id > kid").select("id", "kid", F.col("at").alias("s"), (F.col("at") + min_words).alias("e"),
                                                  F.col("kat").alias("ks"), (F.col("kat") + min_words).alias("ke"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 51,
                      overlap: float = 0.8) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, keep_doc_id, keep_start_word,
    similarity, cluster_id): the passages to remove, with who keeps them."""
    if min_words < WINDOW + ANCHOR:
        raise ValueError(f"min_words is at least {WINDOW + ANCHOR}")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    anchors = materialize(src.mapInArrow(_anchors(min_words), "key bigint, id bigint, pos int"), "pg-anchors")
    shared = anchors.groupBy("key").agg(F.min("id").alias("kid"), F.max("id").alias("last")).where("kid <> last").select("key", "kid")
    shared = materialize(shared, "pg-shared")
    hits = materialize(_only(anchors, shared.select("key")).join(shared, "key"), "pg-hits")  # most keys stay in one document
    places = hits.where("id = kid").groupBy("key").agg(F.min("pos").alias("kpos"))
    pairs = hits.where("id <> kid").join(places, "key").select("id", "kid", "pos", "kpos")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = materialize(
        pairs.repartition(parts, "id").sortWithinPartitions("id", "kid", "pos")
        .mapInArrow(_chains, "id bigint, kid bigint, s bigint, e bigint, ks bigint, ke bigint"), "pg-spans")
    context = docs.sparkSession.sparkContext
    needed = context.broadcast(bitmap(spans.select("id").union(spans.select("kid")).distinct()))
    several = context.broadcast(bitmap(src.groupBy("id").count().where("count > 1").select("id")))

    def words(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            batch = batch.filter(pa.array(marked(needed.value, keys_of(batch.column(0)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.tobytes() for _, h in _docs(batch)], pa.binary()),
                 pa.array(marked(several.value, keys_of(batch.column(0))))], names=["id", "w", "several"])

    made = materialize(src.mapInArrow(words, "id bigint, w binary, several boolean"), "pg-words")
    held = made.where("not several").select("id", "w").union(made.where("several").groupBy("id").agg(F.min("w").alias("w")))

    def verified(spans: DataFrame, name: str) -> DataFrame:
        each = spans.groupBy("id", "kid").agg(F.collect_list(F.struct("s", "e", "ks", "ke")).alias("spans"))
        rows = (each.join(_only(held, spans.select("id")).withColumnRenamed("w", "wa"), "id")
                .join(_only(held, spans.select("kid")).select(F.col("id").alias("kid"), F.col("w").alias("wb")), "kid")
                .mapInArrow(_verifier(min_words, overlap), "doc_id bigint, start_word bigint, end_word bigint, keep_doc_id bigint, "
                                                           "keep_start_word bigint, similarity double, inner_from bigint, inner_to bigint").distinct())
        return materialize(rows, name)

    found = verified(spans, "pg-found")
    second = materialize(_second_spans(hits, found, held, min_words), "pg-second")
    found = found.union(verified(second, "pg-found-long")).drop("inner_from", "inner_to")
    label = connected_components(found.select(F.col("keep_doc_id").alias("a"), F.col("doc_id").alias("b")))
    # a span inside another span of the same document says nothing new
    w = Window.partitionBy("doc_id").orderBy("start_word", F.desc("end_word"), "keep_doc_id", "keep_start_word").rowsBetween(
        Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.max("end_word").over(w)).where("before is null or end_word > before").drop("before")
    return (found.join(label.withColumnRenamed("node", "doc_id").withColumnRenamed("label", "cluster_id"), "doc_id")
            .select("doc_id", "start_word", "end_word", F.expr("end_word - start_word").alias("n_words"), "keep_doc_id",
                    "keep_start_word", "similarity", "cluster_id"))
