"""Registered queries: case-library quality over ``documents`` (X-1..X-9, JN-5,
JN-7, PF-21, PF-22, AG-24, RT-1, IO-5, IO-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow import bindings as B
from riskflow.operators import library as L
from riskflow.plans.registry import register
from riskflow.sources import io as IO

WS = L.WS


def _cases(spark, sf):
    return L.case_library(B.table(spark, sf, "documents"))


def wc(x: str) -> str:
    t = f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"
    return f"(CASE WHEN {x} IS NULL OR {t} = '' THEN 0 ELSE len(string_split_regex({t}, '{WS}')) END)"


CASES_CTE = """cases AS (
  SELECT case_id, category, title, narrative, indicators,
         list_transform(indicators, lambda x: regexp_replace(x, '^\\S+\\s*', '')) AS indicator_explanations,
         indicators[1] AS summary, indicators[-1] AS reasoning, lang
  FROM (SELECT doc_id AS case_id, source AS category,
               trim(regexp_extract(text, '^([^.!?\\n]*)', 1)) AS title, text AS narrative,
               list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS indicators,
               lang
        FROM documents))"""


def cases_query(body: str) -> str:
    return f"WITH {CASES_CTE}\n{body}"


def _specific(x: str) -> str:
    toks = " OR ".join(f"contains(lower({x}), '{t}')" for t in L.SPECIFIC_TOKENS)
    return f"(regexp_matches({x}, '[0-9]') OR {toks})"


_REASON = f"""CASE
  WHEN {wc('narrative')} < 80 THEN 'narrative_short:' || {wc('narrative')}
  WHEN {wc('narrative')} > 220 THEN 'narrative_long:' || {wc('narrative')}
  WHEN len(indicators) < 4 THEN 'indicators_few:' || len(indicators)
  WHEN len(indicators) > 8 THEN 'indicators_many:' || len(indicators)
  WHEN len(indicator_explanations) <> len(indicators)
    THEN 'explanations_count:' || len(indicator_explanations) || '/' || len(indicators)
  WHEN len(list_filter(indicator_explanations, lambda x: {wc('x')} < 4)) > 0 THEN 'explanation_short'
  WHEN len(list_filter(indicators, lambda x: NOT {_specific('x')})) > 1
    THEN 'indicators_vague:' || len(list_filter(indicators, lambda x: NOT {_specific('x')}))
  WHEN {wc('title')} < 4 OR {wc('title')} > 16 THEN 'title_length:' || {wc('title')}
  WHEN {wc('summary')} < 10 THEN 'summary_short'
  WHEN {wc('reasoning')} < 10 THEN 'reasoning_short'
END"""


@register("validate_cases", ops=("X-1",), sql=cases_query(
    f"SELECT case_id, category, reason, CAST(reason IS NULL AS BIGINT) AS valid FROM (SELECT *, {_REASON} AS reason FROM cases)"))
def q_validate(spark, sf):
    return L.validate_cases(_cases(spark, sf)).select("case_id", "category", "reason", "valid")


_SETS = """sets AS (
  SELECT case_id, category,
         list_distinct(list_transform(indicators, lambda x: lower(trim(x)))) AS ind,
         list_distinct(list_filter(list_transform(regexp_extract_all(title, '[\\p{L}\\p{N}_]+'), lambda x: lower(x)),
                                   lambda x: length(x) >= 4)) AS tt
  FROM cases)"""


def _jac(a, b):
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
            f"ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)")


@register("near_duplicates_first", ops=("X-2", "X-3", "ST-2", "JN-7", "H5"), sql=cases_query(f""",
{_SETS}
SELECT s.case_id, s.category, coalesce(min(o.case_id), -1) AS first_similar
FROM sets s LEFT JOIN sets o
  ON o.category = s.category AND o.case_id < s.case_id
 AND ({_jac('s.ind', 'o.ind')} >= 0.65 OR {_jac('s.tt', 'o.tt')} >= 0.75)
GROUP BY s.case_id, s.category"""))
def q_near_dup(spark, sf):
    """-1 when no earlier similar case exists."""
    return L.first_similar_earlier(_cases(spark, sf)).fillna(-1, ["first_similar"])


@register("title_token_pairs", ops=("JN-7", "ST-2", "H5"), sql=cases_query(f""",
{_SETS},
reps AS (SELECT category, min(case_id) AS case_id, list_sort(tt) AS tt FROM sets WHERE len(tt) > 0
         GROUP BY category, list_sort(tt))
SELECT a.category AS grp, a.case_id AS a, b.case_id AS b, {_jac('a.tt', 'b.tt')} AS jaccard
FROM reps a JOIN reps b ON a.category = b.category AND a.case_id < b.case_id
WHERE {_jac('a.tt', 'b.tt')} >= 0.5"""))
def q_title_pairs(spark, sf):
    c = _cases(spark, sf)
    sets = c.select(F.col("case_id").alias("id"), F.col("category").alias("grp"),
                    L.title_tokens(F.col("title")).alias("tokens"))
    reps = L.collapse_identical(sets).filter(F.col("id") == F.col("rep"))
    return L.similar_pairs(reps, 0.5)


@register("greedy_dedup", ops=("X-3", "H9"), sql=cases_query(f""",
{_SETS},
near AS (
  SELECT s.category, s.case_id, list(o.case_id) FILTER (WHERE o.case_id IS NOT NULL) AS earlier
  FROM sets s LEFT JOIN sets o
    ON o.category = s.category AND o.case_id < s.case_id
   AND ({_jac('s.ind', 'o.ind')} >= 0.65 OR {_jac('s.tt', 'o.tt')} >= 0.75)
  GROUP BY s.category, s.case_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY case_id) AS k FROM near),
walk AS (
  SELECT DISTINCT category, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM numbered
  UNION ALL
  SELECT w.category, n.k, CASE WHEN list_has_any(w.kept, coalesce(n.earlier, [])) THEN w.kept ELSE list_append(w.kept, n.case_id) END
  FROM walk w JOIN numbered n ON n.category = w.category AND n.k = w.k + 1),
done AS (SELECT category, unnest(kept) AS case_id FROM walk QUALIFY k = max(k) OVER (PARTITION BY category))
SELECT n.case_id, n.category, CAST(d.case_id IS NOT NULL AS BIGINT) AS keep
FROM numbered n LEFT JOIN done d ON d.category = n.category AND d.case_id = n.case_id""").replace("WITH ", "WITH RECURSIVE ", 1))
def q_greedy(spark, sf):
    """Exact order-dependent greedy keep (fixpoint rounds)."""
    return L.greedy_keep(_cases(spark, sf))


@register("assign_case_ids", ops=("X-4",), sql=cases_query("""
SELECT case_id, 'case_' || category || '_' || lpad(CAST(row_number() OVER (PARTITION BY category ORDER BY case_id) AS VARCHAR), 3, '0') AS new_id
FROM cases"""))
def q_assign(spark, sf):
    return L.assign_ids(_cases(spark, sf)).select("case_id", "new_id")


@register("plan_jobs", ops=("X-5",), sql="""
SELECT category, i, vectors[((i - 1) % len(vectors)) + 1] AS vector
FROM (SELECT source AS category, count(*) AS n, list_sort(list_distinct(list(lang))) AS vectors
      FROM documents GROUP BY source), range(1, n + 1) r(i)""")
def q_plan(spark, sf):
    plan = B.table(spark, sf, "documents").groupBy(F.col("source").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("lang")).alias("vectors"))
    return L.plan_jobs(plan).select("category", F.col("i").cast("long").alias("i"), "vector")


@register("pair_lists", ops=("X-6",), sql=cases_query("""
SELECT case_id, CAST(pos AS BIGINT) AS pos, indicators[pos + 1] AS indicator, indicator_explanations[pos + 1] AS explanation
FROM (SELECT *, unnest(range(len(indicators))) AS pos FROM cases WHERE len(indicators) > 0)"""))
def q_pairs(spark, sf):
    c = _cases(spark, sf).filter(F.size("indicators") > 0)
    return L.pair_lists(c)


@register("list_from_text", ops=("X-7", "S21"), sql="""
SELECT src, id,
       CASE WHEN c IS NULL OR trim(c) = '' THEN []::VARCHAR[]
            WHEN starts_with(trim(c), '[') AND json_valid(c)
              THEN from_json(CASE WHEN starts_with(trim(c), '[') AND json_valid(c) THEN c ELSE '[]' END, '["VARCHAR"]')
            WHEN json_valid(c) THEN []::VARCHAR[]
            ELSE [c] END AS items
FROM (SELECT 'props' AS src, event_id AS id, CAST(props AS VARCHAR) AS c FROM events
      UNION ALL SELECT 'text', doc_id, text FROM documents
      UNION ALL SELECT 'list', doc_id, CAST(to_json(string_split(text, chr(10))) AS VARCHAR) FROM documents
      UNION ALL SELECT 'blank', doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE NULL END FROM documents)""")
def q_list_from_text(spark, sf):
    """Inputs: event props (JSON objects -> []), whole document texts (not JSON
    -> [text]), every document's lines as a JSON list (-> the lines), blanks."""
    ev = B.table(spark, sf, "events").select(F.lit("props").alias("src"), F.col("event_id").alias("id"),
                                             F.col("props").alias("c"))
    docs = B.table(spark, sf, "documents")
    text = docs.select(F.lit("text").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("c"))
    lst = docs.select(F.lit("list").alias("src"), F.col("doc_id").alias("id"),
                      F.to_json(F.split(F.col("text"), "\n")).alias("c"))
    blank = docs.select(F.lit("blank").alias("src"), F.col("doc_id").alias("id"),
                        F.when(F.col("doc_id") % 2 == 0, F.lit("")).cast("string").alias("c"))
    allc = ev.unionByName(text).unionByName(lst).unionByName(blank)
    return allc.select("src", "id", L.list_from_text(F.col("c")).alias("items"))


@register("filter_queries", ops=("X-8", "IO-9"), sql=f"""
SELECT conv_id, turn, text FROM (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r
  FROM conversations WHERE role = 'user' AND {wc('text')} BETWEEN 4 AND 25)
WHERE r <= 2""")
def q_filter_queries(spark, sf):
    conv = B.table(spark, sf, "conversations").filter(F.col("role") == "user")
    return L.filter_queries(conv, "conv_id", "turn").select("conv_id", "turn", "text")


def _moji_sql(x, reverse=False):
    for bad, good in L.MOJIBAKE:
        a, b = (good, bad) if reverse else (bad, good)
        a = a.replace("'", "''")
        b = b.replace("'", "''")
        x = f"replace({x}, '{a}', '{b}')"
    return x


@register("repair_mojibake", ops=("X-9", "S22"), sql=f"""
SELECT doc_id, length(broken) AS broken_len, length(fixed) AS fixed_len, CAST(fixed = text AS BIGINT) AS restored
FROM (SELECT doc_id, text, broken, {_moji_sql('broken')} AS fixed
      FROM (SELECT doc_id, text, {_moji_sql('text', reverse=True)} AS broken FROM documents))""")
def q_mojibake(spark, sf):
    docs = B.table(spark, sf, "documents")
    broken = F.col("text")
    for bad, good in L.MOJIBAKE:
        broken = F.replace(broken, F.lit(good), F.lit(bad))
    d = docs.select("doc_id", "text", broken.alias("broken"))
    d = d.withColumn("fixed", L.repair_mojibake(F.col("broken")))
    return d.select("doc_id", F.length("broken").alias("broken_len"), F.length("fixed").alias("fixed_len"),
                    (F.col("fixed") == F.col("text")).cast("long").alias("restored"))


@register("search_cases", ops=("PF-21",), sql=cases_query("""
SELECT case_id, category FROM cases
WHERE coalesce(contains(lower(title), 'licensed') OR contains(lower(narrative), 'licensed')
   OR contains(lower(summary), 'licensed')
   OR len(list_filter(indicators, lambda x: contains(lower(x), 'licensed'))) > 0
   OR len(list_filter(indicator_explanations, lambda x: contains(lower(x), 'licensed'))) > 0, false)"""))
def q_search_cases(spark, sf):
    return L.search_cases(_cases(spark, sf), "Licensed").select("case_id", "category")


@register("page_cases", ops=("PF-22",), sql=cases_query(
    "SELECT case_id, title FROM cases ORDER BY case_id LIMIT 10 OFFSET 20"))
def q_page(spark, sf):
    return L.page(_cases(spark, sf), 3, 10, ["case_id"]).select("case_id", "title")


@register("library_counts", ops=("AG-24",), sql=cases_query("""
SELECT category, count(*) AS n_cases,
       count(CASE WHEN len(indicator_explanations) > 0 THEN 1 END) AS with_explanations,
       count(CASE WHEN len(indicator_explanations) = len(indicators) THEN 1 END) AS lists_equal,
       count(CASE WHEN summary IS NOT NULL AND summary <> '' THEN 1 END) AS with_summary
FROM cases GROUP BY category"""))
def q_library_counts(spark, sf):
    return L.library_counts(_cases(spark, sf))


@register("pending_unlabelled", ops=("JN-5",), sql="""
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_pending(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "source")
    return L.pending(docs, B.table(spark, sf, "labels"), "doc_id")


@register("case_documents", ops=("RT-1",), sql=cases_query("""
SELECT case_id, category, md5(doc) AS doc_md5, length(doc) AS doc_len FROM (
  SELECT case_id, category,
         concat_ws(chr(10) || chr(10), title, narrative, 'Indicators: ' || array_to_string(indicators, '; '),
                   'Explanations: ' || array_to_string(indicator_explanations, '; ')) AS doc
  FROM cases)"""))
def q_case_docs(spark, sf):
    d = L.case_document(_cases(spark, sf))
    return d.select("case_id", "category", F.md5("document").alias("doc_md5"),
                    F.length("document").alias("doc_len"))


@register("export_cases", ops=("IO-10",), sql="""
SELECT coalesce(CAST(CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS VARCHAR),
                'case_' || substr(sha256(coalesce(c, '')), 1, 12)) AS id,
       list_filter(list_transform(string_split(coalesce(c, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS indicators
FROM (SELECT doc_id, text AS c FROM documents)""")
def q_export(spark, sf):
    """Whole texts split on commas (every tenth id withheld to exercise the fallback)."""
    docs = B.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 10 == 0, F.lit(None)).otherwise(F.col("doc_id")).alias("case_id"),
        F.col("text").alias("indicators_csv"))
    return L.export_cases(docs).select("id", "indicators")


@register("case_library_json_roundtrip", ops=("IO-5", "IO-6"), sql=cases_query("""
SELECT category, count(*) AS n_cases, CAST(sum(len(indicators)) AS BIGINT) AS n_indicators FROM cases GROUP BY category"""))
def q_json_roundtrip(spark, sf):
    """Write the case library as JSON files to the shared scratch folder, read
    it back with a declared schema (PERMISSIVE, corrupt rows dropped)."""
    path = IO.write_case_library(_cases(spark, sf).drop("lang"))
    back = IO.read_case_library(spark, path)
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("n_cases"),
                                        F.sum(F.size("indicators")).alias("n_indicators"))
