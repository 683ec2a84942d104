"""A table of graded cases that the evaluation queries run on, made from ``documents`` by arithmetic.

Spark and SQL build it independently from the same rules: reference and predicted scores by criterion,
a response text (valid, wrapped in prose, of a wrong type, cut off, …) and a few slice columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

CRITERIA = ("thesis", "contextualization", "evidence", "analysis_reasoning")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    d = load(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    i = F.col("doc_id")
    mod = lambda a, b, m: ((i * a + b) % m).cast("int")
    ref = [mod(1, 0, 2), ((i / 2).cast("long") % 2).cast("int"), ((i / 3).cast("long") % 3).cast("int"), ((i / 5).cast("long") % 3).cast("int")]
    pred = [mod(3, 1, 2), ((i / 4).cast("long") % 2).cast("int"), ((i / 2).cast("long") % 3).cast("int"), ((i / 7).cast("long") % 3).cast("int")]
    out = d.select(
        i.alias("case_id"), "source", "lang", "n_chars", "text",
        *[r.alias(c) for r, c in zip(ref, CRITERIA, strict=True)],
        *[F.when(i % 11 != 0, p).alias(f"p_{c}") for p, c in zip(pred, CRITERIA, strict=True)],
    )
    total = sum((F.col(c) for c in CRITERIA), F.lit(0)).cast("int")
    predicted = sum((F.col(f"p_{c}") for c in CRITERIA), F.lit(0)).cast("int")
    words = F.size(F.filter(F.split(F.regexp_replace(F.col("text"), "[ \\t\\n\\x0B\\f\\r]+", " "), " "), lambda w: w != ""))
    return out.select("*", total.alias("total"), predicted.alias("p_total"), words.alias("n_words"), F.when(F.col("case_id") % 13 == 0, "prompt_injection").when(F.col("case_id") % 7 == 0, "grade_inflation").otherwise("plain").alias("failure_type"))


CASES = """
base AS (
  SELECT doc_id AS case_id, source, lang, n_chars, text,
    (doc_id % 2)::INTEGER AS thesis, ((doc_id // 2) % 2)::INTEGER AS contextualization, ((doc_id // 3) % 3)::INTEGER AS evidence, ((doc_id // 5) % 3)::INTEGER AS analysis_reasoning,
    CASE WHEN doc_id % 11 <> 0 THEN ((doc_id * 3 + 1) % 2)::INTEGER END AS p_thesis,
    CASE WHEN doc_id % 11 <> 0 THEN ((doc_id // 4) % 2)::INTEGER END AS p_contextualization,
    CASE WHEN doc_id % 11 <> 0 THEN ((doc_id // 2) % 3)::INTEGER END AS p_evidence,
    CASE WHEN doc_id % 11 <> 0 THEN ((doc_id // 7) % 3)::INTEGER END AS p_analysis_reasoning
  FROM documents),
cases AS (
  SELECT *, thesis + contextualization + evidence + analysis_reasoning AS total,
    p_thesis + p_contextualization + p_evidence + p_analysis_reasoning AS p_total,
    len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::INTEGER AS n_words,
    CASE WHEN case_id % 13 = 0 THEN 'prompt_injection' WHEN case_id % 7 = 0 THEN 'grade_inflation' ELSE 'plain' END AS failure_type
  FROM base)
"""


def responses(df: DataFrame) -> DataFrame:
    """Adds ``response``: eight kinds of model output by ``case_id % 8``."""
    good = F.format_string('{"scores": {"thesis": %d, "contextualization": %d, "evidence": %d, "analysis_reasoning": %d}, "total": %d, "feedback": {"thesis": "a", "contextualization": "b", "evidence": "c", "analysis_reasoning": "d"}}', *[F.coalesce(F.col(f"p_{c}"), F.lit(0)) for c in CRITERIA], F.coalesce(F.col("p_total"), F.lit(0)))
    k = F.col("case_id") % 8
    return df.withColumn("response", F.when(k == 1, F.concat(F.lit("Here: "), good, F.lit(" done"))).when(k == 2, F.replace(good, F.lit('"total": '), F.lit('"total": 9'))).when(k == 3, F.substring(good, 1, 60)).when(k == 4, F.replace(good, F.lit('"feedback"'), F.lit('"notes"'))).when(k == 5, F.lit("no grade")).when(k == 6, F.regexp_replace(good, '"evidence": \\d', '"evidence": true')).when(k == 7, F.lit("[1, 2]")).otherwise(good))
