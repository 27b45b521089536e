"""Bit-sliced SimHash groups, stripe collocations and threshold-algorithm
clusters against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from riskflow.llm import simhash
from riskflow.llm.centroids import Lists, cluster, floored
from riskflow.llm.collocations import collocations
from riskflow.llm.simhash import bit_planes, links, majority_bits, near_fingerprints, within, xxh64

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ------------------------------------------------------------------ SimHash
def fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    """{doc_id: smallest reachable id} over all pairs."""
    ids = [i for i, _ in rows if i is not None]
    fps = [(i, fingerprint(t)) for i, t in rows if i is not None]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for n, (a, x) in enumerate(fps):
        for b, y in fps[:n]:
            if (x ^ y).bit_count() <= radius:
                a_, b_ = root(a), root(b)
                up[max(a_, b_)] = min(a_, b_)
    return {i: root(i) for i in ids}


def test_xxh64_of_every_length():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 5000, dtype=np.uint8)
    size = np.array(list(range(130)) * 3 + [4000])
    start = np.concatenate([rng.integers(0, 4000, len(size) - 1), [7]])
    got = xxh64(buf, start, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(buf[a:a + n].tobytes(), 42) for a, n in zip(start, size)]


def test_majority_over_long_and_empty_runs():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    first = np.array([0, 0, 1, 2, 258, 258, 1300, 3000])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a:z]) > z - a) if z > a else 0
            for a, z in zip(first, first[1:])]
    assert majority_bits(h, first).tolist() == want


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 9])
def test_bit_sliced_distances_equal_popcounts(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    fp = base.copy()
    fp[1::2] = base[::2]
    for i in range(1, 300, 2):
        for b in rng.choice(64, rng.integers(0, 12), replace=False):
            fp[i] ^= np.uint64(1) << np.uint64(b)
    planes = bit_planes(fp)
    for lag in (1, 2, 63, 64, 65, 130):
        words = np.arange(-(-(300 - lag) // 64))
        mask = np.full(len(words), ~np.uint64(0))
        mask[-1] = np.uint64((1 << ((300 - lag) - 64 * (len(words) - 1))) - 1) if (300 - lag) % 64 else mask[-1]
        hit = within(planes, words, np.full(len(words), lag), mask, radius)
        lanes = np.unpackbits(hit.view(np.uint8), bitorder="little")[:300 - lag]
        assert (lanes == (np.bitwise_count(fp[:-lag] ^ fp[lag:]) <= radius)).all()


def test_links_span_components_of_cells_and_sides():
    rng = np.random.default_rng(3)
    fp = np.repeat(rng.integers(0, 2 ** 63, 40, dtype=np.uint64), 10)
    fp ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    cell = np.repeat([0, 1], 200)
    node = np.arange(400)

    def groups(pairs):
        up = list(range(400))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in pairs:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(400)]

    for side in (np.full(400, -1), np.arange(400) % 2):
        got = links(cell, side, fp, node, 4)
        want = [(i, j) for i in range(400) for j in range(i) if cell[i] == cell[j]
                and (side[i] < 0 or side[i] != side[j]) and int(fp[i] ^ fp[j]).bit_count() <= 4]
        assert groups(got) == groups(want)
        assert len(got) < 400  # a forest
    assert links(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 4) == []


def _varied_texts():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words, rng.integers(1, 80)))
        rows.append((i * 3, text))
        if i % 3 == 0:
            rows.append((i * 3 + 1, text.upper()))
            rows.append((i * 3 + 2, text + " tail"))
    return rows


def test_groups_equal_brute_force(docs_of, spark, monkeypatch):
    rows = _varied_texts() + [
        (1000, None), (1001, ""), (1002, " \t\n"), (None, "w1 w2 w3"), (None, None),
        (1003, "one"), (1004, "ONE"), (1005, "Wörter ÄÖ\x00 drei vier fünf"), (1006, "x" * 100_000),
        (1007, "alpha beta gamma delta epsilon"), (1007, "quite different words stand in here")]
    got = near_fingerprints(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    prints = defaultdict(list)
    for i, t in rows:
        prints[i].append(f"{fingerprint(t):016x}")
    for r in got:
        assert r["fingerprint"] in prints[r["doc_id"]]
        assert r["component_id"] == want.get(r["doc_id"])
    # a bucket dealt to a grid of cells gives the same groups
    monkeypatch.setattr(simhash, "BLOCK", 2)
    again = {r["doc_id"]: r["component_id"] for r in near_fingerprints(docs_of(rows)).collect() if r["doc_id"] is not None}
    assert again == want


def test_simhash_of_an_empty_table(docs_of, spark):
    out = near_fingerprints(docs_of([(1, "a")]).where("doc_id < 0"))
    assert out.count() == 0 and out.columns == ["doc_id", "fingerprint", "component_id"]


def test_op11_on_given_documents(spark):
    from riskflow.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r["component_id"] for r in QUERIES["op11_bit_sliced_simhash"](spark, SF).collect()}
    assert got == brute_groups(rows)


# ------------------------------------------------------------- collocations
def brute_collocations(rows, longest=5, least=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(w[i:i + size] for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        most = {}
        for p, a in cand.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    part = p[i:i + size]
                    most[part] = max(most.get(part, 0), a)
        rows_ = []
        for p, a in cand.items():
            if 100 * most.get(p, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, le, ri) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, le, ri, n[lang], -score))
    return sorted(out)


def _spoken(spark, rows):
    return spark.createDataFrame([(l, t, 1, 2) for l, t in rows], "lang string, text string, n int, f int")


def _found(df):
    return sorted(tuple(r) for r in df.collect())


def test_collocations_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["a", "b", "of", "the", "Größe", "x\x00y", "é", "c-d", "the", "of"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for _ in range(60))
        rows.append(([None, "und", "en", "de"][i % 4], text))
    rows += [("en", None), (None, ""), ("fr", "one two"), ("en", "z " * 5000), ("en", "long" * 20_000)]
    rows += [("de", "In der That nur hier")] * 120  # every part of it is subsumed
    for least, longest, top in ((100, 5, 2000), (30, 5, 7), (40, 3, 2000)):
        got = _found(collocations(_spoken(spark, rows), longest=longest, min_count=least, top=top))
        assert got == brute_collocations(rows, longest, least, top)
        assert got


def test_collocations_of_nothing(spark):
    for rows in ([("en", None)], [("en", "a b c")], [(None, "  ")]):
        assert collocations(_spoken(spark, rows)).count() == 0
    assert collocations(_spoken(spark, [("en", "a")]).where("n < 0")).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, le = 3_000_000_000_001, 9_000_000_000_000_007, 3_000_000_000_011
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.lit(le).alias("l"), F.lit(le).alias("r"))
    wide = lambda c: f"cast({c} as decimal(17,0))"
    got = row.selectExpr(f"(({wide('a')} * {wide('n')}) * cast(1000 as decimal(4,0))) div ({wide('l')} * {wide('r')}) AS s")
    assert got.first()["s"] == 1000 * a * n // (le * le)


# ------------------------------------------------------------------ clusters
def whole(x, scale=64):
    v = Fraction(x) * scale
    return v.numerator // v.denominator


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, tuple(whole(x) for x in v)) for i, v in rows if v is not None and len(v) == dims
            and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cent = [list(v) for _, v in starts]
    if not cent:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        parts = defaultdict(list)
        for _, v in kept:
            parts[near(v)[1]].append(v)
        cent = [[sum(x) // len(parts[n]) for x in zip(*parts[n])] if parts[n] else c for n, c in enumerate(cent)]
    own = [(i, *near(v)) for i, v in kept]
    per = Counter()
    for _, d, c in own:
        per[c] += d
    cap = 2 ** 63 - 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted((-1 if i is None else i, c, min(d, cap), min(per[c], cap), min(sum(per.values()), cap), sha[c]) for i, d, c in own)


def _clustered(df, **kw):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, cluster(df, **kw).collect()))


def _vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0, "c") for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, cluster int, id string")


def test_threshold_walk_equals_all_distances():
    rng = np.random.default_rng(6)
    for k, dims in ((1, 3), (5, 1), (16, 64), (9, 2)):
        cent = rng.integers(-4, 5, (k, dims))
        x = rng.integers(-6, 7, (500, dims))
        own, dist = Lists(cent.tolist()).nearest(x)
        want = ((x[:, None, :] - cent[None]) ** 2).sum(axis=2)
        assert (own == want.argmin(axis=1)).all() and (dist == want.min(axis=1)).all()


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), (rng.normal(size=3) * rng.choice([0.01, 1, 5])).tolist()) for i in range(200)]
    rows += [(500 + i, [0.25, -0.5, 0.0]) for i in range(40)]  # ties and copies
    rows += [(600, None), (601, []), (602, [1.0, 2.0]), (603, [1.0, None, 2.0]), (604, [1.0, float("nan"), 2.0]),
             (605, [float("inf"), 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (3, [1.0, 1.0, 1.0])]
    assert _clustered(_vectors(spark, rows), dims=3) == brute_clusters(rows, dims=3)
    few = rows[:5]
    assert _clustered(_vectors(spark, few), dims=3) == brute_clusters(few, dims=3)


def test_clusters_of_huge_components_are_exact(spark):
    rows = [(i, [float(i % 5) * 1e9 + i, -1e17 if i % 2 else 3.5, 1e300 if i == 7 else 0.125]) for i in range(40)]
    assert _clustered(_vectors(spark, rows), dims=3, k=4) == brute_clusters(rows, dims=3, k=4)
    assert floored(np.array([[1e300, -0.3]]), 64).tolist() == [[int(1e300) * 64, -20]]


def test_clusters_of_nothing(spark):
    empty = cluster(_vectors(spark, [(1, None), (2, [1.0])]), dims=3)
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster(_vectors(spark, [(1, [1.0])]).where("vec_id < 0"), dims=1).count() == 0
