"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..functions import text as T
from ..operators import overlap as O
from ..sources.tables import durable, load
from .registry import register

#: DuckDB macros as text: the normal form of a text column.
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents")


def gram_sql(table: str, key: str, k: int, text: str = "text") -> str:
    """SQL for distinct (key, gram)."""
    leads = " || ' ' || ".join(["w", *[f"lead(w, {i}) OVER o" for i in range(1, k)]])
    norm = WORDS.format(NORM.format(text))
    return f"SELECT DISTINCT {key}, gram FROM (SELECT {key}, {leads} AS gram FROM (SELECT {key}, unnest({norm}) AS w, generate_subscripts({norm}, 1) AS p FROM {table}) WINDOW o AS (PARTITION BY {key} ORDER BY p)) WHERE gram IS NOT NULL"


@register("contamination_report", f"""
WITH d AS ({gram_sql('documents', 'doc_id', 8)}), b AS ({gram_sql('benchmark', 'item_id', 8)}),
hit AS (SELECT DISTINCT d.doc_id FROM d JOIN b USING (gram))
SELECT source, count(*) AS n_docs, count(hit.doc_id) AS n_contaminated, count(hit.doc_id)::DOUBLE / count(*) AS rate
FROM documents LEFT JOIN hit USING (doc_id) GROUP BY source""")
def contamination_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share an 8-word span with a benchmark item, by source."""
    d = docs(spark, folder)
    hit = O.shared_spans(d, load(spark, folder, "benchmark"), "doc_id", "item_id", 8).select("doc_id").distinct().withColumn("hit", F.lit(1))
    return d.select("doc_id", "source").join(hit, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("hit").alias("n_contaminated"), (F.count("hit") / F.count("*")).alias("rate"))


@register("text_normal_forms", f"""
SELECT doc_id, md5({NORM.format('text')}) AS normal, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS match_form,
  md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' +', ' ', 'g'))) AS unicode_form,
  md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS caseless FROM documents""")
def text_normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("text")
    return docs(spark, folder).select("doc_id", F.md5(T.normalize(x)).alias("normal"), F.md5(T.match_form(x)).alias("match_form"), F.md5(T.unicode_form(x)).alias("unicode_form"), F.md5(T.caseless(x)).alias("caseless"))


@register("text_fingerprint", f"""
SELECT doc_id, len(fp)::INTEGER AS n_words, md5(array_to_string(list_sort(fp), ' ')) AS digest
FROM (SELECT doc_id, list_distinct(list_filter({WORDS.format(NORM.format('text'))}, lambda w: length(w) >= 4)) AS fp FROM documents)""")
def text_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", T.fingerprint(F.col("text")).alias("fp")).select("doc_id", F.size("fp").alias("n_words"), F.md5(F.array_join(F.array_sort("fp"), " ")).alias("digest"))


@register("text_word_spans", f"""
SELECT k, count(*) AS n_spans, count(DISTINCT gram) AS n_distinct FROM (
  SELECT 8 AS k, gram FROM ({gram_sql('documents', 'doc_id', 8)}) UNION ALL SELECT 10, gram FROM ({gram_sql('documents', 'doc_id', 10)})
  UNION ALL SELECT 12, gram FROM ({gram_sql('documents', 'doc_id', 12)}) UNION ALL SELECT 14, gram FROM ({gram_sql('documents', 'doc_id', 14)})) GROUP BY k""")
def text_word_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Counted by hashes in passes: all spans of a corpus are many times as large as its texts."""
    d = docs(spark, folder).select("doc_id", T.normalize(F.col("text")).alias("norm"))
    words = durable(O.one_text_each(d, "doc_id", "norm").select("norm"))
    n = words.agg(F.sum(F.length("norm")).alias("chars"), F.sum(F.when(F.col("norm") != "", F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)).alias("words")).first()
    rows = [(k, *H.span_counts(words, k, n["words"] or 0, n["chars"] or 0)) for k in (8, 10, 12, 14)]
    return spark.createDataFrame([r for r in rows if r[1]], "k int, n_spans bigint, n_distinct bigint")


@register("text_sentences", """
SELECT doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''))::INTEGER AS n_sentences,
  len(list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) BETWEEN 12 AND 120))::INTEGER AS n_clauses,
  len(list_filter(list_transform(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n\\s*\\n'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''))::INTEGER AS n_blocks
FROM documents""")
def text_sentences(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("text")
    return docs(spark, folder).select("doc_id", F.size(T.sentences(x)).alias("n_sentences"), F.size(T.clauses(x)).alias("n_clauses"), F.size(F.filter(F.transform(F.split(T.strip(x), "\\n\\s*\\n"), T.strip), lambda p: p != "")).alias("n_blocks"))


@register("text_excerpts", """
SELECT doc_id, CASE WHEN length(flat) <= 400 THEN flat ELSE regexp_replace(substr(flat, 1, 400), ' [^ ]*$', '') || '...' END AS excerpt,
  length(regexp_replace(CASE WHEN regexp_matches(text, 'Licensed under') THEN regexp_extract(text, '(?s)^(.*?)Licensed under', 1) ELSE text END, '\\s+$', ''))::INTEGER AS n_before_license,
  coalesce(substr(list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 15)[1], 1, 70), '') AS anchor
FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents)""")
def text_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("text")
    return docs(spark, folder).select("doc_id", T.excerpt(x).alias("excerpt"), F.length(T.cut_at(x, "Licensed under")).alias("n_before_license"), T.anchor(x).alias("anchor"))


@register("page_text", """
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), '(?m)^[ \\t]*[0-9]+[ \\t]*$', '', 'g'), '\\s+', ' ', 'g'))) AS joined FROM pages""")
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("html")
    return load(spark, folder, "pages").select("page_id", F.md5(T.strip_tags(x)).alias("plain"), F.md5(T.page_text(x)).alias("joined"))


@register("text_scrub", f"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace({NORM.format('text')}, 'version 2 0|apache license|the', ' ', 'g'), '\\s+', ' ', 'g'))) AS scrubbed FROM documents""")
def text_scrub(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", F.md5(T.scrub(F.col("text"), ["the", "Apache License", "Version 2.0"])).alias("scrubbed"))


@register("text_years", """
WITH p AS (SELECT doc_id, 'In ' || (1400 + doc_id % 600) || ' and again from ' || (1500 + doc_id % 400) || CASE WHEN doc_id % 3 = 0 THEN ' to ' ELSE ', later ' END || (1550 + doc_id % 400) || ' of trade trade routes' AS prompt FROM documents),
y AS (SELECT *, list_transform(regexp_extract_all(prompt, '\\b(1[4-9][0-9]{2}|20[0-9]{2})\\b', 1), lambda v: v::INTEGER) AS ys FROM p)
SELECT doc_id, len(ys)::INTEGER AS n_years,
  CASE WHEN doc_id % 3 = 0 THEN least(1500 + doc_id % 400, 1550 + doc_id % 400) ELSE list_min(ys) END::INTEGER AS start_year,
  CASE WHEN doc_id % 3 = 0 THEN greatest(1500 + doc_id % 400, 1550 + doc_id % 400) ELSE list_max(ys) END::INTEGER AS end_year,
  CASE WHEN doc_id % 3 = 0 THEN 'trade-routes' ELSE 'later-trade-routes' END AS topic FROM y""")
def text_years(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    prompt = F.concat(F.lit("In "), (1400 + i % 600).cast("string"), F.lit(" and again from "), (1500 + i % 400).cast("string"), F.when(i % 3 == 0, " to ").otherwise(", later "), (1550 + i % 400).cast("string"), F.lit(" of trade trade routes"))
    p = docs(spark, folder).select("doc_id", prompt.alias("prompt"))
    span = T.year_range(F.col("prompt"))
    topic = F.regexp_replace(T.slug(F.col("prompt"), ["again", "from"]), "(-[0-9]{4})+$", "")
    return p.select("doc_id", F.size(T.years(F.col("prompt"))).alias("n_years"), span["start"].alias("start_year"), span["end"].alias("end_year"), topic.alias("topic"))


@register("repeated_spans", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM w),
g AS (SELECT doc_id, w || ' ' || lead(w,1) OVER o || ' ' || lead(w,2) OVER o || ' ' || lead(w,3) OVER o || ' ' || lead(w,4) OVER o || ' ' || lead(w,5) OVER o || ' ' || lead(w,6) OVER o || ' ' || lead(w,7) OVER o AS g FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, g FROM g WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) >= 3))
SELECT doc_id, (r.doc_id IS NOT NULL) AS repeats FROM documents LEFT JOIN r USING (doc_id)""")
def repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which an 8-word span occurs three times or more."""
    d = docs(spark, folder).select("doc_id", F.col("text"))
    w = d.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9']+)"), 1)).alias("p", "w"))
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("p")
    spans = w.select("doc_id", F.xxhash64("w", *[F.lead("w", i).over(order) for i in range(1, 8)]).alias("g"), F.lead("p", 7).over(order).alias("e")).where("e IS NOT NULL")
    hit = spans.groupBy("doc_id", "g").agg(F.count("*").alias("n")).where("n >= 3").select("doc_id").distinct().withColumn("repeats", F.lit(True))
    return d.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("repeats", F.lit(False)).alias("repeats"))


@register("text_identifiers", """
SELECT doc_id, source || '_' || lang || '_' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS sample_id,
  regexp_extract(source, '([0-9]+)', 1)::INTEGER AS source_no, regexp_extract(source || '_set' || (doc_id % 2 + 1), '_set([12])', 1)::INTEGER AS set_no,
  substr(sha256('seed:split:' || source), 1, 16) AS stable_key FROM documents""")
def text_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers built from tags and parsed back, and the stable hash key."""
    i = F.col("doc_id")
    return docs(spark, folder).select("doc_id", F.concat_ws("_", "source", "lang", F.lpad((i % 1000).cast("string"), 3, "0")).alias("sample_id"), F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("source_no"), F.regexp_extract(F.concat("source", F.lit("_set"), (i % 2 + 1).cast("string")), "_set([12])", 1).cast("int").alias("set_no"), F.substring(F.sha2(F.concat(F.lit("seed:split:"), "source"), 256), 1, 16).alias("stable_key"))


@register("chat_rows", """
SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles, last(role ORDER BY turn) = 'assistant' AS ends_with_assistant,
  max(length(text)) FILTER (role = 'assistant')::INTEGER AS longest_answer FROM conversations GROUP BY conv_id""")
def chat_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Message arrays by conversation, with the checks that a training row must pass."""
    m = load(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return m.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.array_join(F.col("messages.role"), ",").alias("roles"), (F.element_at("messages", -1)["role"] == "assistant").alias("ends_with_assistant"), F.array_max(F.transform(F.filter("messages", lambda x: x["role"] == "assistant"), lambda x: F.length(x["text"]))).alias("longest_answer"))
