"""Corpus pipeline: each stage works on all its predecessor kept.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``; ``run``
applies them to ``documents``.

Rows with a null doc_id pass the deduplicating and decontaminating stages
unchanged; null and empty texts stay null and empty and have no ids.  Further
columns pass through, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.textcore import text_batches
from riskflow.session import materialize


def _apart(docs: DataFrame):
    """``docs`` with names that no operator uses for all but doc_id and text, and
    the way back to the columns as they were."""
    own = {c: c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{new}`").alias(c) for c, new in own.items()])

    return docs.toDF(*own.values()), back


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go; it learns from the
    labelled documents that are not held out."""
    from riskflow.llm.toxicity import fit, score_texts

    text_batches(spark)
    plain, back = _apart(docs)
    scorer = fit(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(score_texts(plain, scorer).where("predicted = 0"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line of the corpus equals up to one edit go; a
    document whose every line went goes with them.  ``n_chars`` follows the text."""
    from riskflow.llm.lines import dedup_lines

    text_batches(spark)
    plain, back = _apart(docs)
    cut = dedup_lines(plain).where("n_lines = 0 or n_lines > n_equal + n_near")
    if "n_chars" in docs.columns:
        own = f"column {docs.columns.index('n_chars')}"
        cut = cut.withColumn(own, F.when(F.col("n_equal") + F.col("n_near") > 0, F.length("text").cast("long")).otherwise(F.col(f"`{own}`")))
    return back(cut)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8) stays."""
    from riskflow.llm.odd_sketch import near_duplicates

    text_batches(spark)
    gone = near_duplicates(docs, k=5, num=80, den=100).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    from riskflow.llm.decontaminate import find_leaks

    text_batches(spark)
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining text, and whether they decode to it."""
    from riskflow.llm.pieces import encode_texts
    from riskflow.llm.queries import tokenizer_file

    text_batches(spark)
    return encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: The stages fit a model, decode lattices and follow components, which SQL
#: cannot express; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with their token ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
