"""Blocked top-k cosine equals brute force, for any block sizes."""

import numpy as np

from riskflow.operators import vectors as V


def test_topk_blocked_equals_bruteforce(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(120, 8))
    p = rng.normal(size=(90, 8))
    p[5] = 0.0                                   # zero vector: cosine 0, no error
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))], "vec_id long, embedding array<double>")
    pdf = spark.createDataFrame([(i, p[i].tolist()) for i in range(len(p))], "vec_id long, embedding array<double>")
    qn = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-9)
    pn = p / (np.linalg.norm(p, axis=1, keepdims=True) + 1e-9)
    sims = qn @ pn.T
    want = {}
    for i in range(len(q)):
        order = sorted(range(len(p)), key=lambda j: (-sims[i, j], j))[:4]
        want[i] = order
    for qb, pb in [(4096, 16384), (7, 11), (1, 90)]:
        got = {}
        for r in V.top_k_cosine(qdf, pdf, 4, q_block_rows=qb, p_block_rows=pb).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["pid"]))
        got = {k: [p for _, p in sorted(v)] for k, v in got.items()}
        assert got == want


def _frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")


def test_pruned_search_equals_bruteforce_with_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 4
    p = np.repeat(centres, 40, axis=0) + rng.normal(size=(240, 5)) * 0.1
    p[40:80] = p[40]  # one vector forty times: ties go to the smaller ids
    q = np.concatenate([p[::7], rng.normal(size=(10, 5))])
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    sims = unit(q) @ unit(p).T
    for kw, floor in (({"pivots": 1}, -9), ({"pivots": 12, "p_block_rows": 9, "q_block_rows": 5}, -9), ({"pivots": 300, "min_cos": 0.9}, 0.9)):
        got = {}
        for r in V.top_k_cosine(_frame(spark, q), _frame(spark, p), 5, **kw).collect():
            got.setdefault(r["qid"], {})[r["rank"]] = (r["pid"], r["cos"])
        for i in range(len(q)):
            want = [j for j in sorted(range(len(p)), key=lambda j: (-round(sims[i, j], 12), j)) if sims[i, j] >= floor][:5]
            mine = [got.get(i, {}).get(n + 1) for n in range(len(want))]
            assert len(got.get(i, {})) == len(want)
            assert np.allclose([c for _, c in mine], [sims[i, j] for j in want], atol=1e-12)
            if 40 <= want[0] < 80 if want else False:
                assert [j for j, _ in mine] == [40, 41, 42, 43, 44]


def test_most_blocks_are_never_met_on_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = V._normalise(rng.normal(size=(64, 32)))
    x = V._normalise(np.repeat(centres, 50, axis=0) + rng.normal(size=(3200, 32)) * 0.02)
    d = V._distances(x, centres)
    own = d.argmin(axis=1)
    radius = np.array([d[own == b, b].max() for b in range(64)])
    q = x[::17]
    sims = q @ x.T
    floor = np.sort(sims, axis=1)[:, -5]
    go = V.may_hold(V._distances(q, centres), radius, floor)
    assert go.mean() < 0.1
    for i in range(len(q)):  # nothing as good stands in a block left out
        assert go[i][own[sims[i] >= floor[i]]].all()


def test_first_k_keeps_at_most_k():
    s = np.array([[1.0, 2.0, 2.0, 2.0, 0.0], [3.0, 3.0, 3.0, 3.0, 3.0], [-np.inf, 1.0, -np.inf, -np.inf, 0.0]])
    assert V.first_k(s, 2).tolist() == [[False, True, True, False, False], [True, True, False, False, False], [False, True, False, False, True]]
    assert V.first_k(s, 9).sum() == 12


def test_query_blocks_do_not_copy_the_library(spark, monkeypatch):
    """No side is exploded to meet the other, in any table that the search writes."""
    x = np.random.default_rng(8).normal(size=(700, 16))
    plans, write = [], V.materialize

    def seen(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, name)
    monkeypatch.setattr(V, "materialize", seen)
    rows = []
    for qb, pb in [(4096, 16384), (3, 5)]:
        got = V.top_k_cosine(_frame(spark, x), _frame(spark, x), 3, exclude_self=True, q_block_rows=qb, p_block_rows=pb)
        rows.append(sorted(map(tuple, got.select("qid", "rank", "pid").collect())))
        plans.append(got._jdf.queryExecution().toString())
    assert rows[0] == rows[1] and len(rows[0]) == 2100
    assert not any("Generate explode" in p for p in plans)


def test_running_best_equals_bruteforce_over_packs():
    rng = np.random.default_rng(9)
    x = V._normalise(np.concatenate([rng.normal(size=(300, 12)), np.repeat(rng.normal(size=(1, 12)), 30, axis=0)]))
    pivots = x[::40]
    own = V._distances(x, pivots).argmin(axis=1)
    order = np.argsort(own, kind="stable")
    ids = np.arange(1000, 1000 + len(x))
    far = V._distances(x, pivots)[np.arange(len(x)), own]
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    for q_rows, p_rows, cuts in ((400, 400, [0, 330]), (7, 5, [0, 3, 100, 330]), (64, 1, [0, 200, 330])):
        best = V._Best(ids, x, pivots, 4, True, None)
        for lo, hi in zip(cuts, cuts[1:]):
            o = order[lo:hi]
            best.meet(ids[o], own[o], far[o], x[o], q_rows, p_rows)
        for i in range(len(x)):
            want = sorted(range(len(x)), key=lambda j: (-round(sims[i, j], 10), j))[:4]
            assert np.allclose(best.cos[i], sims[i, want], atol=1e-12)
            if i < 300 - 1:
                assert sorted(best.pid[i]) == sorted(ids[want])


def _sparse(rng, n, dims, entries, signed=True):
    m = np.zeros((n, dims))
    for i in range(n):
        m[i, rng.choice(dims, entries, replace=False)] = rng.normal(size=entries) if signed else rng.random(entries)
    return m


def test_sparse_vectors_equal_bruteforce(spark):
    """Spark ML vectors, sparse and dense, with negative entries, a vector of zeros,
    copies, a null id and one that is no number."""
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import LongType, StructField, StructType
    rng = np.random.default_rng(11)
    p, q = _sparse(rng, 200, 300, 12), _sparse(rng, 90, 300, 6)
    q[:, 7] = 1.0
    q[4], q[5] = 0.0, rng.normal(size=300)
    p[50:60], p[61], p[62, 3] = p[50], rng.normal(size=300), np.nan
    kind = StructType([StructField("vec_id", LongType()), StructField("embedding", VectorUDT())])

    def ml(m, none=None):
        return spark.createDataFrame([(None if i == none else i, Vectors.dense(v) if i % 9 == 0 else Vectors.sparse(
            len(v), np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist())) for i, v in enumerate(m)], kind)

    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    sims = unit(q) @ unit(p).T
    sims[:, 62] = -np.inf
    for kw, own in (({}, False), ({"exclude_self": True, "min_cos": 0.05, "pivots": 7}, True)):
        got = {}
        for r in V.top_k_cosine(ml(q, 80), ml(p), 3, **kw).collect():
            got.setdefault(r["qid"], {})[r["rank"]] = (r["pid"], r["cos"])
        assert len(got) == len(q) if not own else 4 not in got
        for i in range(len(q)):
            ok = [j for j in range(len(p)) if sims[i, j] >= kw.get("min_cos", -9) and not (own and j == i != 80)]
            want = sorted(ok, key=lambda j: (-round(sims[i, j], 12), j))[:3]
            mine = got.get(V._NO_ID if i == 80 else i, {})
            assert [mine[n + 1][0] for n in range(len(mine))] == want, i
            assert np.allclose([mine[n + 1][1] for n in range(len(mine))], sims[i, want], atol=1e-12)


def test_alike_sparse_queries_skip_most_rows():
    """Queries of one template meet few library rows, and none that is better is left out."""
    rng = np.random.default_rng(12)
    shared = np.concatenate([rng.random(20) + 0.5, np.zeros(380)])
    q = V._normalise(shared + _sparse(rng, 600, 400, 2, signed=False))
    p = V._normalise(_sparse(rng, 3000, 400, 40))
    pivots = p[::300]
    for k, scale in ((1, 1.0), (4, -1.0)):  # second: libraries and queries of both signs
        lib, qs = p, q * np.where(np.arange(400) % 3, 1.0, scale)
        columns = np.flatnonzero((qs != 0).any(axis=0))
        best, met = V._Best(np.arange(600), qs[:, columns], pivots, k, False, None, columns), []
        score = best._score
        best._score = lambda part, rows, *a, score=score, met=met: (met.append((part.stop - part.start) * len(rows)), score(part, rows, *a))
        far = V._distances(lib, pivots)
        for lo in range(0, 3000, 1000):
            own = far[lo:lo + 1000].argmin(axis=1)
            best.meet(np.arange(lo, lo + 1000), own, far[lo:lo + 1000].min(axis=1), lib[lo:lo + 1000][:, columns], 4096, 16384)
        sims = qs @ lib.T
        want = -np.sort(-sims, axis=1)[:, :k]
        assert np.allclose(best.cos, want[best.ids], atol=1e-12)
        assert np.allclose(sims[best.ids[:, None], best.pid], best.cos, atol=1e-12)
        assert sum(met) < 0.5 * sims.size


def test_packs_hold_stored_entries_only():
    import pyarrow as pa
    rng = np.random.default_rng(13)
    m = _sparse(rng, 500, 1024, 5)
    lists = [np.flatnonzero(v) for v in m]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([x.tolist() for x in lists], pa.list_(pa.int32())),
                                        pa.array([v[x].tolist() for v, x in zip(m, lists)], pa.list_(pa.float64()))], ["id", "idx", "val"])
    rows = list(V._assigned(V._normalise(rng.normal(size=(4, 1024))))([batch.slice(0, 300), batch.slice(300)]))
    for most, size, packs in ((10_000, 1 << 20, 1), (10_000, 1000, 3), (100, 1 << 20, 5)):
        out = list(V._packed("p_", most, size)(rows))
        assert len(out) == packs and sum(b.nbytes for b in out) < 500 * 5 * 10 + 500 * 40
        back = [V._unpacked({n: b.column(n)[0].as_buffer() for n in b.schema.names}, "p_", 1024) for b in out]
        assert np.concatenate([b[0] for b in back]).tolist() == list(range(500))
        assert np.array_equal(np.concatenate([b[3] for b in back]), V._normalise(m))


def test_null_vectors_and_other_lengths_are_refused():
    import pyarrow as pa
    import pytest
    for idx, val in (([None], [None]), ([None, None], [[1.0] * 3, [1.0] * 5]), ([[0, 4]], [[1.0, 2.0]])):
        batch = pa.RecordBatch.from_arrays([pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64()))], ["idx", "val"])
        with pytest.raises(ValueError, match="4 dimensions"):
            V._listed(batch, 4)


def test_text_search_embeds_each_document_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from riskflow.operators import library as L
    from riskflow.plans import case_queries as Q
    words = "transaction amount channel risk card hours flagged gallery river stone window".split()
    texts = [" ".join(words[(i * j + j) % len(words)] for j in range(1, 9)) + "." for i in range(30)]
    spark.createDataFrame([(i, t, "en", f"source_{i % 3}") for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id))").alias("ts"),
                           (F.col("id") % 4).alias("user_id"), F.lit("click").alias("event_type"),
                           (F.lit(150.0) + F.col("id")).alias("value"), F.lit('{"k": 1}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x
    document = L.case_document
    monkeypatch.setattr(L, "case_document", lambda cases: document(cases).withColumn("document", F.udf(counted)("document")))
    got = Q.q_text_search(spark, str(tmp_path)).collect()
    assert made.value == 30
    assert len(got) == 20 and {r["rank"] for r in got} == {1}
    assert all(r["pattern_label"] == f"Source {r['pid'] % 3}" for r in got)


def test_search_of_nothing(spark):
    some, none = _frame(spark, np.ones((3, 2))), _frame(spark, np.ones((3, 2))).where("vec_id < 0")
    assert V.top_k_cosine(some, none, 2).count() == 0 and V.top_k_cosine(none, some, 2).count() == 0


def test_rescale_guards(spark):
    df = spark.createDataFrame([(0.4,), (0.7,), (0.99,), (None,)], "c double")
    got = [r[0] for r in df.select(V.rescale("c")).collect()]
    assert got[0] == 0.0 and abs(got[1] - 0.5) < 1e-12 and got[2] == 1.0 and got[3] == 0.0
    same = [r[0] for r in df.select(V.rescale("c", 0.5, 0.5)).collect()]
    assert same[:3] == [0.5, 0.5, 0.5]


def test_gate_verdict_monotone(spark):
    """Raising either signal never moves a verdict towards in-domain."""
    from pyspark.sql import functions as F
    from riskflow.operators.gate import verdict
    rank = {"in_domain": 0, "borderline": 1, "out_of_domain": 2}
    xs = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    v = [r[0] for r in df.orderBy("x").select(verdict(F.col("x"), 0.3, 0.7)).collect()]
    assert all(rank[a] <= rank[b] for a, b in zip(v, v[1:]))
