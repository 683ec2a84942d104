"""Queries over gates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import jsonx as X
from ..functions import text as T
from ..sources.tables import load
from .cases import CASES, cases, responses
from .registry import register
from .text_queries import NORM


def d(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents")


def alternation(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


PLANTED = {0: " Here is a revised version", 1: " Scoring Commentary on page 2 of 9", 2: " my target score and the training dataset", 3: " according to document 4", 4: " from my notes with a pencil", 5: " running out of time, teachers say; classmates argued", 6: ""}


def planted(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id") % 7
    extra = F.lit("")
    for i, s in PLANTED.items():
        extra = F.when(k == i, s).otherwise(extra)
    return d(spark, folder).select("doc_id", F.concat("text", extra).alias("x"))


PLANTED_SQL = "planted AS (SELECT doc_id, text || CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in PLANTED.items()) + " END AS x FROM documents)"


@register("pattern_gates", f"WITH {PLANTED_SQL} SELECT doc_id, " + ", ".join(f"regexp_matches(x, '(?i){alternation(p)}') AS {n}" for n, p in (("rewrites", G.REWRITE), ("contaminated", G.CONTAMINATION), ("leaks", G.LEAKAGE), ("names_source", G.HALLUCINATION))) + " FROM planted")
def pattern_gates(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("x")
    return planted(spark, folder).select("doc_id", G.any_of(x, G.REWRITE).alias("rewrites"), G.any_of(x, G.SOURCE_CONTAMINATION).alias("contaminated"), G.any_of(x, G.LEAKAGE).alias("leaks"), G.any_of(x, G.HALLUCINATION).alias("names_source"))


@register("artifact_categories", f"WITH {PLANTED_SQL} SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(x, '(?i){alternation(p + G.LEAKAGE if c == 'prompt_or_instruction_leakage' else p)}') THEN '{c}' END" for c, p in G.ARTIFACTS.items()) + ") AS categories FROM planted")
def artifact_categories(spark: SparkSession, folder: str) -> DataFrame:
    return planted(spark, folder).select("doc_id", F.array_join(G.artifact_categories(F.col("x")), ",").alias("categories"))


STOPS = ", ".join(f"'{w}'" for w in G.STOP_WORDS)
CONTENT = "list_filter(list_distinct(list_transform(regexp_extract_all(lower({0}), '[a-z'']{{4,}}'), lambda w: trim(w, ''''))), lambda w: w <> '' AND w NOT IN (" + STOPS + "))"


@register("feedback_grounding", f"""
WITH f AS (SELECT doc_id, text AS essay, CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 80) WHEN 1 THEN 'completely unrelated remark' WHEN 2 THEN '' ELSE substr(text, 1, 12) END AS feedback FROM documents),
w AS (SELECT *, {CONTENT.format('feedback')} AS a, {CONTENT.format('essay')} AS b, list_filter(list_transform(string_split_regex(essay, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) BETWEEN 12 AND 120) AS c FROM f)
SELECT doc_id, len(a) > 0 AND len(b) > 0 AND (len(list_intersect(a, b)) >= 2 OR len(list_filter(c, lambda s: contains(lower(feedback), lower(s)))) > 0 OR len(list_filter(a, lambda x: length(x) > 5 AND contains(lower(essay), x))) > 0) AS grounded FROM w""")
def feedback_grounding(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.substring("text", 1, 80)).when(k == 1, "completely unrelated remark").when(k == 2, "").otherwise(F.substring("text", 1, 12))
    return d(spark, folder).select("doc_id", G.refers_to(said, F.col("text")).alias("grounded"))


@register("hallucinated_quotes", """
WITH f AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS form, '"' || CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(substr(text, 1, 40), '["\\n]', ' ', 'g')) ELSE 'never written in any text' END || '"' AS said FROM documents),
q AS (SELECT *, list_transform(regexp_extract_all(said, '"([^"]{12,})"', 1), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))) AS qs FROM f)
SELECT doc_id, len(list_filter(qs, lambda s: len(string_split(s, ' ')) >= 3 AND NOT contains(form, s))) > 0 AS strange FROM q""")
def hallucinated_quotes(spark: SparkSession, folder: str) -> DataFrame:
    own = F.trim(F.regexp_replace(F.substring("text", 1, 40), '["\\n]', " "))
    said = F.concat(F.lit('"'), F.when(F.col("doc_id") % 2 == 0, own).otherwise("never written in any text"), F.lit('"'))
    return d(spark, folder).select("doc_id", G.hallucinates(said, F.col("text")).alias("strange"))


@register("quality_gate", None)
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The composed gate with its reasons: uses look-behind, which the SQL engine lacks; tested on planted rows."""
    p = planted(spark, folder)
    return p.select("doc_id", F.array_join(G.essay_gate(F.col("x"), F.substring("x", 1, 100)), ",").alias("reasons"))


@register("length_gates", f"""WITH {CASES}, r AS (SELECT case_id, n_words, (case_id * 7) % 700 AS ref FROM cases),
b AS (SELECT *, CASE WHEN ref < 120 THEN greatest(70, round_even(greatest(1, ref) * 0.70::DOUBLE, 0)::INTEGER) WHEN ref > 420 THEN round_even(ref * 0.75::DOUBLE, 0)::INTEGER ELSE round_even(ref * 0.80::DOUBLE, 0)::INTEGER END AS low FROM r),
h AS (SELECT *, CASE WHEN ref < 120 THEN greatest(round_even(greatest(1, ref) * 1.40::DOUBLE, 0)::INTEGER, least(320, greatest(180, greatest(1, ref) + 100)), low + 25) WHEN ref > 420 THEN round_even(ref * 1.25::DOUBLE, 0)::INTEGER ELSE round_even(ref * 1.20::DOUBLE, 0)::INTEGER END AS high FROM b)
SELECT case_id, low::INTEGER AS low, high::INTEGER AS high, CASE WHEN ref <= 0 THEN '' WHEN n_words NOT BETWEEN low AND high THEN 'length_outside_reference_band' WHEN n_words < 40 THEN 'essay_too_short' ELSE '' END AS reason FROM h""")
def length_gates(spark: SparkSession, folder: str) -> DataFrame:
    c = cases(spark, folder).select("case_id", "n_words", ((F.col("case_id") * 7) % 700).cast("int").alias("ref"))
    low, high = G.length_band(F.col("ref"))
    return c.select("case_id", low.alias("low"), high.alias("high"), F.array_join(G.length_gate(F.col("n_words"), F.col("ref")), ",").alias("reason"))


@register("score_gates", f"WITH {CASES} SELECT case_id, concat_ws(',', CASE WHEN p_thesis IS NULL THEN 'missing_thesis' END, CASE WHEN p_evidence * 2 > 1 THEN 'out_of_range_thesis' END, CASE WHEN p_evidence IS NULL THEN 'missing_evidence' END, CASE WHEN total > 2 THEN 'out_of_range_evidence' END) AS reasons FROM (SELECT * REPLACE (CASE WHEN p_thesis IS NULL THEN NULL ELSE p_evidence END AS p_evidence) FROM cases)")
def score_gates(spark: SparkSession, folder: str) -> DataFrame:
    c = cases(spark, folder)
    zero = F.lit(0)
    s = {"thesis": F.col("p_evidence") * 2, "contextualization": zero, "evidence": F.when(F.col("p_thesis").isNotNull(), F.col("total")), "analysis_reasoning": zero}
    shown = F.array_join(G.score_gate(s), ",")
    bad = F.when(F.col("p_thesis").isNull() & (F.col("total") > 2), F.concat_ws(",", shown, F.lit("out_of_range_evidence"))).otherwise(shown)
    return c.select("case_id", bad.alias("reasons"))


@register("strict_payloads", f"WITH {CASES} SELECT case_id, CASE WHEN case_id % 8 IN (3, 5, 7) THEN NULL WHEN case_id % 8 = 4 THEN 'unexpected_top_level_keys,missing_feedback' WHEN case_id % 8 = 6 THEN 'unexpected_top_level_keys,invalid_score:evidence' ELSE 'unexpected_top_level_keys' END AS reasons FROM cases")
def strict_payloads(spark: SparkSession, folder: str) -> DataFrame:
    c = responses(cases(spark, folder)).select("case_id", X.parse_udf("response").alias("p"))
    return c.select("case_id", F.when(F.col("p.strict").isNotNull(), F.array_join("p.strict", ",")).alias("reasons"))


@register("reject_counts", f"WITH {PLANTED_SQL}, r AS (SELECT unnest(list_filter([CASE WHEN regexp_matches(x, '(?i){alternation(G.CONTAMINATION)}') THEN 'source_text_contamination' END, CASE WHEN regexp_matches(x, '(?i){alternation(G.LEAKAGE)}') THEN 'generation_prompt_leakage' END, CASE WHEN length(x) < 200 THEN 'short' END], lambda r: r IS NOT NULL)) AS reason FROM planted) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def reject_counts(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("x")
    r = G.sorted_reasons(G.reasons({"source_text_contamination": G.any_of(x, G.SOURCE_CONTAMINATION), "generation_prompt_leakage": G.any_of(x, G.LEAKAGE)}), G.reasons({"short": F.length(x) < 200}))
    return planted(spark, folder).select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("filler_density", f"WITH {PLANTED_SQL} SELECT doc_id, (" + " + ".join(f"contains(lower(x), '{p}')::INTEGER" for p in G.FILLER) + ") >= 2 AND len(string_split_regex(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' ')) <= 360 AS dense FROM planted")
def filler_density(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("x")
    hits = sum((F.contains(F.lower(x), F.lit(p)).cast("int") for p in G.FILLER), F.lit(0))
    return planted(spark, folder).select("doc_id", ((hits >= 2) & (T.word_count(x) <= 360)).alias("dense"))


@register("filler_density_three", f"WITH {PLANTED_SQL} SELECT doc_id, (" + " + ".join(f"contains(lower(x), '{p}')::INTEGER" for p in G.FILLER) + ") >= 3 AND len(string_split_regex(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' ')) <= 360 AS dense FROM planted")
def filler_density_three(spark: SparkSession, folder: str) -> DataFrame:
    """The reference's threshold of three markers; ``filler_density`` has the two of its SQL."""
    x = F.col("x")
    return planted(spark, folder).select("doc_id", G.filler_dense(x, T.word_count(x)).alias("dense"))


@register("fact_checks", """
WITH e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'too short' WHEN doc_id % 5 = 1 THEN 'In ' || (1700 + doc_id % 300) || ' the trade of many towns and ports grew without any change at all' WHEN doc_id % 5 = 2 THEN '1 2 3 4 5 6 7 8 9 10' ELSE 'The trade of many towns and ports grew in ' || (1750 + doc_id % 40) || ' and in other years' END AS essay FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'empty_or_too_short' WHEN doc_id % 5 = 2 THEN 'nonsense_text' WHEN doc_id % 5 = 1 AND 1700 + doc_id % 300 > 1840 THEN 'anachronistic_year' END AS reason FROM e""")
def fact_checks(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    essay = F.when(i % 5 == 0, "too short").when(i % 5 == 1, F.concat(F.lit("In "), (1700 + i % 300).cast("string"), F.lit(" the trade of many towns and ports grew without any change at all"))).when(i % 5 == 2, "1 2 3 4 5 6 7 8 9 10").otherwise(F.concat(F.lit("The trade of many towns and ports grew in "), (1750 + i % 40).cast("string"), F.lit(" and in other years")))
    return d(spark, folder).select("doc_id", G.fact_check(F.lit("Trade from 1750 to 1800"), essay).alias("reason"))


@register("candidate_gate", """
WITH r AS (SELECT doc_id, [doc_id % 3, (doc_id + 1) % 3, doc_id % 2] AS readers, [(doc_id % 10) / 10.0::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE] AS conf, doc_id % 4 = 0 AS adjudicated FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN len(list_distinct(readers)) < 2 THEN 'readers_not_independent' END, CASE WHEN (list_min(conf) < 0.85 OR len(list_distinct(readers)) > 2) AND NOT adjudicated THEN 'needs_adjudication' END) AS reasons FROM r""")
def candidate_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Readers as an array of structs: independence, confidence and the need to adjudicate."""
    i = F.col("doc_id")
    one = lambda reader, conf: F.struct(reader.alias("reader"), conf.alias("confidence"))
    readers = F.array(one(i % 3, (i % 10) / 10), one((i + 1) % 3, F.lit(0.9)), one(i % 2, F.lit(0.95)))
    c = d(spark, folder).select("doc_id", readers.alias("r"), (i % 4 == 0).alias("adjudicated"))
    distinct = F.size(F.array_distinct(F.col("r.reader")))
    low = F.exists("r", lambda x: x["confidence"] < 0.85)
    return c.select("doc_id", F.array_join(G.reasons({"readers_not_independent": distinct < 2, "needs_adjudication": (low | (distinct > 2)) & ~F.col("adjudicated")}), ",").alias("reasons"))


@register("golden_audit", """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, url, md5(html) AS h FROM pages),
a AS (SELECT *, count(*) OVER (PARTITION BY h) AS copies FROM p)
SELECT page_id, concat_ws(',', CASE WHEN NOT ends_with(host, '.org') THEN 'unexpected_host' END, CASE WHEN copies > 1 THEN 'duplicate_text' END, CASE WHEN page_id % 9 = 0 THEN 'low_confidence' END, CASE WHEN page_id NOT IN (SELECT doc_id FROM labels) THEN 'no_review' END) AS reasons FROM a""")
def golden_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Provenance, copies, confidence and reviews of each row, as reasons."""
    p = load(spark, folder, "pages").select("page_id", F.try_parse_url(F.col("url"), F.lit("HOST")).alias("host"), F.md5("html").alias("h"))
    p = p.withColumn("copies", F.count("*").over(Window.partitionBy("h")))
    reviews = load(spark, folder, "labels").select(F.col("doc_id").alias("page_id")).distinct().withColumn("seen", F.lit(True))
    j = p.join(reviews, "page_id", "left")
    return j.select("page_id", F.array_join(G.reasons({"unexpected_host": ~F.col("host").endswith(".org"), "duplicate_text": F.col("copies") > 1, "low_confidence": F.col("page_id") % 9 == 0, "no_review": F.col("seen").isNull()}), ",").alias("reasons"))


@register("orphan_reviews", "SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT page_id FROM pages)")
def orphan_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "labels").select("doc_id").join(load(spark, folder, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_anti")


@register("training_audit", f"""
WITH n AS (SELECT doc_id, source, lang, md5({NORM.format('text')}) AS h FROM documents), a AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM n),
x AS (SELECT doc_id, list_sort(list_filter([CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'split_not_allowed' END, CASE WHEN source IN ('src3', 'src4') THEN 'source_not_allowed' END, CASE WHEN doc_id <> first THEN 'exact_duplicate_of:' || first END, CASE WHEN h IN (SELECT md5({NORM.format('text')}) FROM benchmark) THEN 'leakage' END], lambda r: r IS NOT NULL)) AS r FROM a)
SELECT doc_id, array_to_string(r, ',') AS reasons, len(r) = 0 AS accepted FROM x""")
def training_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Collection audit: allowed values, first-seen duplicates (rejected rows count as seen) and leakage."""
    n = d(spark, folder).select("doc_id", "source", "lang", F.md5(T.normalize(F.col("text"))).alias("h")).withColumn("first", F.min("doc_id").over(Window.partitionBy("h")))
    held = load(spark, folder, "benchmark").select(F.md5(T.normalize(F.col("text"))).alias("h")).distinct().withColumn("held", F.lit(True))
    j = n.join(held, "h", "left")
    named = G.reasons({"split_not_allowed": ~F.col("lang").isin("en", "de", "fr"), "source_not_allowed": F.col("source").isin("src3", "src4"), "leakage": F.col("held")})
    copy = F.filter(F.array(F.when(F.col("doc_id") != F.col("first"), F.concat(F.lit("exact_duplicate_of:"), F.col("first").cast("string")))), lambda x: x.isNotNull())
    r = G.sorted_reasons(named, copy)
    return j.select("doc_id", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("accepted"))


@register("forbidden_rows", "SELECT count(*) FILTER (source IN ('real1', 'real2') OR doc_id < 0) AS n_forbidden, count(*) FILTER (source IN ('real1', 'real2') OR doc_id < 0) = 0 AS clean FROM documents")
def forbidden_rows(spark: SparkSession, folder: str) -> DataFrame:
    bad = F.col("source").isin("real1", "real2") | (F.col("doc_id") < 0)
    return d(spark, folder).agg(F.count_if(bad).alias("n_forbidden"), (F.count_if(bad) == 0).alias("clean"))


@register("hash_bound_approval", "SELECT source, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest, count(*) AS n, bool_and(doc_id % 97 <> 1) AS all_decided, bool_and(doc_id % 97 <> 1) AND count(*) >= 10 AS approved FROM documents GROUP BY source")
def hash_bound_approval(spark: SparkSession, folder: str) -> DataFrame:
    """Approval holds for exact content: a digest, a row count and a decision on every row."""
    g = d(spark, folder).groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ","), 256).alias("digest"), F.count("*").alias("n"), F.bool_and(F.col("doc_id") % 97 != 1).alias("all_decided"))
    return g.withColumn("approved", F.col("all_decided") & (F.col("n") >= 10))


@register("resume_checks", "WITH r AS (SELECT l_orderkey AS id, count(*) AS n, max(l_suppkey % 2) AS a, min(l_suppkey % 2) AS b FROM lineitem GROUP BY 1) SELECT CASE WHEN o_orderkey IS NULL THEN 'unknown_id' WHEN n > 5 THEN 'duplicate_id' WHEN a <> b THEN 'identity_mismatch' ELSE 'ok' END AS kind, count(*) AS n FROM r LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 20 <> 0) ON id = o_orderkey GROUP BY 1")
def resume_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What stops a resume: unknown, repeated and differently identified records."""
    x = F.col("l_suppkey") % 2
    r = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("k"), F.max(x).alias("a"), F.min(x).alias("b"))
    o = load(spark, folder, "orders").where("o_orderkey % 20 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(True).alias("known"))
    kind = F.when(F.col("known").isNull(), "unknown_id").when(F.col("k") > 5, "duplicate_id").when(F.col("a") != F.col("b"), "identity_mismatch").otherwise("ok")
    return r.join(o, "id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@register("release_gate", f"""WITH {CASES}, m AS (SELECT source, avg(abs(p_total - total)::DOUBLE) AS mae, avg((p_total IS NOT NULL)::INTEGER::DOUBLE) AS valid, avg((abs(p_total - total) <= 1)::INTEGER::DOUBLE) AS near, CASE WHEN source <> 'src7' THEN avg(p_total::DOUBLE) END AS pred_mean, avg(total::DOUBLE) AS ref_mean FROM cases GROUP BY source)
SELECT source, coalesce(mae <= 1.5, false) AS mae_ok, coalesce(valid >= 0.9, false) AS valid_ok, coalesce(near >= 0.6, false) AS within_one_ok, coalesce(abs(pred_mean - ref_mean) <= 0.5, false) AS bias_ok,
  coalesce(mae <= 1.5, false) AND coalesce(valid >= 0.9, false) AND coalesce(near >= 0.6, false) AND coalesce(abs(pred_mean - ref_mean) <= 0.5, false) AS released FROM m""")
def release_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds that fail closed on anything missing; the bias is of predicted totals, not of composites."""
    gap = F.abs(F.col("p_total") - F.col("total"))
    m = cases(spark, folder).groupBy("source").agg(F.avg(gap).alias("mae"), F.avg(F.col("p_total").isNotNull().cast("int")).alias("valid"), F.avg((gap <= 1).cast("int")).alias("near"), F.avg("p_total").alias("pm"), F.avg("total").alias("rm"))
    pm = F.when(F.col("source") != "src7", F.col("pm"))
    checks = {"mae_ok": G.at_most(F.col("mae"), 1.5), "valid_ok": G.at_least(F.col("valid"), 0.9), "within_one_ok": G.at_least(F.col("near"), 0.6), "bias_ok": G.at_most(F.abs(pm - F.col("rm")), 0.5)}
    out = m.select("source", *[c.alias(n) for n, c in checks.items()])
    return out.withColumn("released", F.col("mae_ok") & F.col("valid_ok") & F.col("within_one_ok") & F.col("bias_ok"))


@register("correction_whitelist", "SELECT doc_id, list_has_all(['scores', 'feedback'], ks) AS allowed FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['scores'] WHEN 1 THEN ['scores', 'feedback'] ELSE ['scores', 'text'] END AS ks FROM documents)")
def correction_whitelist(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id") % 3
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    keys = F.when(k == 0, a("scores")).when(k == 1, a("scores", "feedback")).otherwise(a("scores", "text"))
    return d(spark, folder).select("doc_id", G.all_known(keys, ("scores", "feedback")).alias("allowed"))


@register("packet_leak_check", "SELECT table_name AS packet, count(*) AS n_columns, count(*) FILTER (column_name IN ('toxic', 'quality')) AS n_forbidden FROM (VALUES ('documents', 'doc_id'), ('documents', 'text'), ('documents', 'lang'), ('documents', 'source'), ('documents', 'n_chars'), ('labels', 'doc_id'), ('labels', 'quality'), ('labels', 'toxic')) t(table_name, column_name) GROUP BY 1")
def packet_leak_check(spark: SparkSession, folder: str) -> DataFrame:
    """Forbidden columns in a packet's schema; nothing is read."""
    rows = [(n, len(c := load(spark, folder, n).columns), len({"toxic", "quality"} & set(c))) for n in ("documents", "labels")]
    return spark.createDataFrame(rows, "packet string, n_columns long, n_forbidden long")


@register("evidence_names", "SELECT DISTINCT p_name, length(p_name) BETWEEN 5 AND 90 AND NOT regexp_matches(lower(p_name), '^(the|a|an) ') AND regexp_matches(p_name, '^[A-Za-z]') AND NOT regexp_matches(p_name, '[a-z][A-Z]') AS usable FROM part")
def evidence_names(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("p_name")
    ok = F.length(n).between(5, 90) & ~F.lower(n).rlike("^(the|a|an) ") & n.rlike("^[A-Za-z]") & ~n.rlike("[a-z][A-Z]")
    return load(spark, folder, "part").select("p_name", ok.alias("usable")).distinct()


@register("score_rules", f"""WITH {CASES} SELECT case_id, CASE WHEN thesis = 0 THEN 'weak_thesis' WHEN contextualization = 0 AND total <= 3 THEN 'missing_context' WHEN evidence <= 1 AND analysis_reasoning = 0 THEN 'evidence_list' WHEN analysis_reasoning = 0 AND evidence = 2 THEN 'borderline_complexity' WHEN analysis_reasoning = 1 AND total <= 5 THEN 'borderline_complexity' WHEN total >= 5 THEN 'strong' WHEN evidence = 0 THEN 'wrong_period' ELSE 'borderline_complexity' END AS failure,
  CASE WHEN total <= 2 THEN 'weak' WHEN total <= 4 THEN 'borderline' ELSE 'strong' END AS difficulty, CASE WHEN 2020 + case_id % 7 <= 2023 THEN 'old' ELSE 'new' END AS version FROM cases""")
def score_rules(spark: SparkSession, folder: str) -> DataFrame:
    t, c, e, a, n = (F.col(x) for x in ("thesis", "contextualization", "evidence", "analysis_reasoning", "total"))
    rule = F.when(t == 0, "weak_thesis").when((c == 0) & (n <= 3), "missing_context").when((e <= 1) & (a == 0), "evidence_list").when((a == 0) & (e == 2), "borderline_complexity").when((a == 1) & (n <= 5), "borderline_complexity").when(n >= 5, "strong").when(e == 0, "wrong_period").otherwise("borderline_complexity")
    return cases(spark, folder).select("case_id", rule.alias("failure"), F.when(n <= 2, "weak").when(n <= 4, "borderline").otherwise("strong").alias("difficulty"), F.when(2020 + F.col("case_id") % 7 <= 2023, "old").otherwise("new").alias("version"))
