"""The registered queries of this subpackage: one a numbered operator, over
its whole table with production parameters, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as token ids in DAC segment files, read back per document."""
    from riskflow.llm.dac import read_tokens, write_tokens

    path = write_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text under the piece vocabulary, and whether they decode to it."""
    from riskflow.llm.pieces import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that an earlier document holds."""
    from riskflow.llm.passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals up to one edit."""
    from riskflow.llm.lines import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_equal", "n_near", "text")


def op9_odd_sketch_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    from riskflow.llm.odd_sketch import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from two thirds of the labelled ids."""
    from riskflow.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best integer inner products of every 20th vector against all others."""
    from riskflow.llm.topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


OP3_SQL = """
WITH v AS (
    SELECT vec_id, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
    SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS dim,
           unnest(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS w FROM v),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
    FROM c AS q JOIN c ON q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from riskflow.llm.html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op5_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the overlaps."""
    from riskflow.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template matches of every document."""
    from riskflow.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints of 4-word shingles differ in at most 4 bits."""
    from riskflow.llm.simhash import near_fingerprints

    return near_fingerprints(_table(spark, sf_dir, "documents"), k=4, radius=4)


def op12_stripe_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases of 2 to 5 words with at least 100 places."""
    from riskflow.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"), longest=5, min_count=100, top=2000)


OP12_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
    SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: list_slice(ws, i, i + size - 1))) AS ws
    FROM w, (SELECT unnest(range(1, 6)) AS size) WHERE len(ws) >= size),
f AS (SELECT lang, size, ws, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size >= 2 AND f >= 100),
inner_parts AS (
    SELECT lang, f, size, unnest(flatten(list_transform(range(2, size), lambda m: list_transform(
        range(1, size - m + 2), lambda i: list_slice(ws, i, i + m - 1))))) AS part
    FROM c WHERE size > 2),
longer AS (SELECT lang, part, max(f) AS most FROM inner_parts GROUP BY ALL),
kept AS (
    SELECT c.lang, c.size, c.ws, c.f FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.ws = longer.part
    WHERE longer.most IS NULL OR NOT 100 * longer.most >= 100 * c.f),
cut AS (SELECT lang, ws, f AS a, unnest(range(1, size)) AS k FROM kept),
scored AS (
    SELECT cut.lang, cut.ws, cut.k, cut.a, x.f AS l, y.f AS r, n.n,
           (CAST(1000 AS HUGEINT) * cut.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
    FROM cut JOIN f AS x ON x.lang = cut.lang AND x.ws = list_slice(cut.ws, 1, cut.k)
    JOIN f AS y ON y.lang = cut.lang AND y.ws = list_slice(cut.ws, cut.k + 1, len(cut.ws))
    JOIN n ON n.lang = cut.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS pos FROM scored),
ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank,
           array_to_string(ws, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best WHERE pos = 1)
SELECT * FROM ranked WHERE rank <= 2000
"""


def op13_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64-component vector's cluster after 3 rounds from 16 hashed starting centroids."""
    from riskflow.llm.centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dims=64, seed=1)


def _op13_sql(rounds: int = 3) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
    SELECT row, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (
        SELECT v.row, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS dist FROM v JOIN m{i} AS m USING (d) GROUP BY ALL)
    GROUP BY row)""")
        if i < rounds:
            steps.append(f"""m{i + 1} AS (
    SELECT c, d, CAST(coalesce(u.x, old.x) AS BIGINT) AS x FROM m{i} AS old LEFT JOIN (
        SELECT a.c, v.d, floor(CAST(sum(v.x) AS DOUBLE) / count(*)) AS x FROM v JOIN a{i} AS a USING (row) GROUP BY ALL) AS u USING (c, d))""")
    last = rounds
    return f"""
WITH k AS (
    SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (
    SELECT row, unnest(range(1, 65)) AS d,
           unnest(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS x FROM k),
s AS (
    SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) - 1 AS c FROM k
    WHERE vec_id IS NOT NULL QUALIFY c < 16),
m0 AS (SELECT s.c, v.d, v.x FROM s JOIN v USING (row)),
{", ".join(steps)},
i AS (SELECT c, CAST(sum(dist) AS BIGINT) AS cluster_inertia FROM a{last} GROUP BY c),
h AS (SELECT c, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256 FROM m{last} GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.dist AS distance, i.cluster_inertia,
       (SELECT CAST(sum(dist) AS BIGINT) FROM a{last}) AS inertia, h.centroid_sha256
FROM k JOIN a{last} AS a USING (row) JOIN i USING (c) JOIN h USING (c)
"""


QUERIES = {f.__name__: f for f in (
    op1_dac_tokens, op2_toxicity, op3_exact_top_k, op4_html_main_text, op5_bm25_decontamination, op6_sentencepiece, op7_passage_dedup, op8_line_dedup, op9_odd_sketch_near_dups,
    op10_license_scan, op11_bit_sliced_simhash, op12_stripe_collocations, op13_threshold_clusters)}
ORACLES = {"op3_exact_top_k": OP3_SQL, "op12_stripe_collocations": OP12_SQL, "op13_threshold_clusters": _op13_sql()}
