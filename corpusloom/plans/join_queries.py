"""Queries over joins, overlap operators and order-dependent acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import overlap as O
from ..sources.tables import load
from .registry import register
from .text_queries import NORM, WORDS, gram_sql

FP = f"list_distinct(list_filter({WORDS.format(NORM.format('text'))}, lambda w: length(w) >= 4))"
TOKENS = f"SELECT {{key}}, len({FP}) AS n, unnest({FP}) AS t FROM {{table}}"
ALL_WORDS = f"SELECT {{key}}, len(list_distinct({WORDS.format(NORM.format('text'))})) AS n, unnest(list_distinct({WORDS.format(NORM.format('text'))})) AS t FROM {{table}}"


def d(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents")


@register("near_duplicate_pairs", f"""
WITH t AS ({TOKENS.format(key='doc_id', table='documents')}), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, shared::INTEGER AS shared, na::INTEGER AS size_a, nb::INTEGER AS size_b FROM p WHERE shared >= 0.82 * (na + nb - shared)""")
def near_duplicate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return O.jaccard_pairs(d(spark, folder), "doc_id")


@register("duplicate_of_corpus", f"""
WITH t AS ({TOKENS.format(key='doc_id', table='documents')}), b AS ({TOKENS.format(key='item_id', table='benchmark')}),
p AS (SELECT doc_id, item_id, t.n, count(*) AS shared FROM t JOIN b USING (t) GROUP BY ALL),
hit AS (SELECT DISTINCT doc_id FROM p WHERE shared >= least(40, n * 0.75))
SELECT doc_id, CASE WHEN length({NORM.format('text')}) < 80 OR len({FP}) = 0 THEN 'too_short' WHEN hit.doc_id IS NOT NULL THEN 'duplicate' ELSE 'new' END AS verdict FROM documents LEFT JOIN hit USING (doc_id)""")
def duplicate_of_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Against texts of other prompts: an asymmetric overlap; too short texts count as duplicates."""
    x = d(spark, folder)
    hit = O.cross_overlap(x, load(spark, folder, "benchmark"), "doc_id", "item_id").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return x.join(hit, "doc_id", "left").select("doc_id", F.when(O.too_short(F.col("text")), "too_short").when(F.col("hit"), "duplicate").otherwise("new").alias("verdict"))


@register("verbatim_spans", f"""
WITH d AS ({gram_sql('documents', 'doc_id', 8)}), b AS ({gram_sql('benchmark', 'item_id', 8)}), i AS (SELECT DISTINCT gram FROM ({gram_sql('(SELECT * FROM benchmark WHERE item_id < 5)', 'item_id', 8)}))
SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (gram) WHERE gram NOT IN (SELECT gram FROM i)""")
def verbatim_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Shared 8-word spans, those of the texts to ignore aside."""
    b = load(spark, folder, "benchmark")
    return O.shared_spans(d(spark, folder), b, "doc_id", "item_id", 8, ignore=b.where("item_id < 5"))


@register("prompt_aware_leakage", f"""
WITH d AS ({gram_sql('documents', 'doc_id', 14)}), b AS ({gram_sql('benchmark', 'item_id', 14)}),
p AS (SELECT doc_id, {WORDS.format(NORM.format("substr(text, 1, 60)"))} AS ws FROM documents)
SELECT DISTINCT d.doc_id, item_id FROM d JOIN p USING (doc_id) JOIN b USING (gram) WHERE len(list_filter(string_split(gram, ' '), lambda w: list_contains(ws, w))) < 0.65 * 14""")
def prompt_aware_leakage(spark: SparkSession, folder: str) -> DataFrame:
    x = d(spark, folder)
    return O.leaked_spans(x, x.select("doc_id", F.substring("text", 1, 60).alias("prompt")), load(spark, folder, "benchmark"), "doc_id", "item_id", within=None)


FIRST_WORDS = f"array_to_string(list_slice({WORDS.format(NORM.format('text'))}, 1, 20), ' ')"


@register("prompt_leakage_reasons", f"""
WITH l AS (SELECT doc_id, text, {NORM.format('text')} AS norm, {FIRST_WORDS} AS n, {FP} AS fp FROM documents),
r AS (SELECT item_id, {FIRST_WORDS} AS n, {FP} AS fp FROM benchmark),
same AS (SELECT DISTINCT l.doc_id FROM l JOIN r USING (n) WHERE length(l.norm) < 80 OR len(l.fp) = 0
  OR CASE WHEN n <> '' THEN len(list_intersect(l.fp, r.fp)) >= 0.82 * (len(l.fp) + len(r.fp) - len(list_intersect(l.fp, r.fp))) ELSE len(list_intersect(l.fp, r.fp)) >= least(40, len(l.fp) * 0.75) END),
d AS ({gram_sql('documents', 'doc_id', 14)}), b AS (SELECT DISTINCT gram FROM ({gram_sql('benchmark', 'item_id', 14)})),
met AS (SELECT DISTINCT doc_id, gram, n FROM d JOIN b USING (gram) JOIN l USING (doc_id)),
span AS (SELECT DISTINCT doc_id FROM met WHERE len(list_filter(string_split(gram, ' '), lambda w: list_contains(string_split(n, ' '), w))) < 0.65 * 14
  AND len(list_filter([1, 2, 3, 4, 5, 6, 7], lambda i: contains(' ' || n || ' ', ' ' || array_to_string(list_slice(string_split(gram, ' '), i, i + 7), ' ') || ' '))) = 0)
SELECT doc_id, 'duplicate_of_eval_same_prompt' AS reason FROM same UNION ALL SELECT doc_id, 'verbatim_span_of_eval' FROM span""")
def prompt_leakage_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Both reasons in full; a text's first twenty words stand for its prompt."""
    prompt = F.array_join(F.slice(T.words(T.normalize(F.col("text"))), 1, 20), " ").alias("prompt")
    x, b = d(spark, folder).select("doc_id", "text", prompt), load(spark, folder, "benchmark").select("item_id", "text", prompt)
    return O.leakage_reasons(x, b, "doc_id", "item_id")


@register("first_overlap_reason", f"""
WITH n AS (SELECT doc_id, {NORM.format('text')} AS norm, trim(regexp_replace(regexp_replace({NORM.format('text')}, 'apache license|version 2 0', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents),
m AS (SELECT item_id, {NORM.format('text')} AS norm, trim(regexp_replace(regexp_replace({NORM.format('text')}, 'apache license|version 2 0', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM benchmark),
u AS (SELECT * FROM m WHERE length(norm) >= 80),
a AS (SELECT doc_id, len(list_distinct({WORDS.format('norm')})) AS n, unnest(list_distinct({WORDS.format('norm')})) AS t FROM n),
b AS (SELECT item_id, len(list_distinct({WORDS.format('norm')})) AS m, unnest(list_distinct({WORDS.format('norm')})) AS t FROM u),
near AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, item_id, n, m, count(*) AS x FROM a JOIN b USING (t) GROUP BY ALL) WHERE x >= 0.82 * (n + m - x)),
g AS ({gram_sql('n', 'doc_id', 8)}), h AS ({gram_sql('u', 'item_id', 8)}), verb AS (SELECT DISTINCT doc_id FROM g JOIN h USING (gram))
SELECT doc_id, CASE WHEN length(norm) < 80 THEN 'essay_too_short_for_overlap_audit' WHEN norm IN (SELECT norm FROM u) THEN 'exact_duplicate' WHEN doc_id IN (SELECT doc_id FROM near) THEN 'near_duplicate' WHEN doc_id IN (SELECT doc_id FROM verb) THEN 'verbatim_eight_word_overlap' END AS reason FROM n""")
def first_overlap_reason(spark: SparkSession, folder: str) -> DataFrame:
    return O.first_overlap_reason(d(spark, folder), load(spark, folder, "benchmark"), "doc_id", "item_id", ["Apache License", "Version 2.0"])


@register("prompt_similarity", f"""
WITH t AS ({ALL_WORDS.format(key='item_id', table='benchmark')}), s AS (SELECT * EXCLUDE n, count(*) OVER (PARTITION BY item_id) AS n FROM t WHERE t NOT IN ('the', 'of', 'and'))
SELECT a.item_id AS a, b.item_id AS b, count(*)::DOUBLE / (a.n + b.n - count(*)) AS similarity, CASE WHEN count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.72 THEN 'hard' WHEN count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.52 THEN 'review' ELSE 'ok' END AS level
FROM s a JOIN s b ON a.t = b.t AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id, a.n, b.n""")
def prompt_similarity(spark: SparkSession, folder: str) -> DataFrame:
    b = load(spark, folder, "benchmark")
    s = O.token_similarity(b.select(F.col("item_id").alias("a"), "text"), b.select(F.col("item_id").alias("b"), "text"), "a", "b", ("the", "of", "and")).where("a < b")
    return s.withColumn("level", F.when(F.col("similarity") >= 0.72, "hard").when(F.col("similarity") >= 0.52, "review").otherwise("ok"))


@register("greedy_accept", f"""
WITH RECURSIVE n AS (SELECT doc_id, md5({NORM.format('text')}) AS h FROM documents), e AS (SELECT b.doc_id AS later, a.doc_id AS earlier FROM n a JOIN n b ON a.h = b.h AND a.doc_id < b.doc_id)
SELECT doc_id, doc_id NOT IN (SELECT later FROM e) AS accepted FROM n""")
def greedy_accept(spark: SparkSession, folder: str) -> DataFrame:
    """Acceptance against accepted predecessors; equal texts conflict, so each group keeps its first."""
    n = d(spark, folder).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("h"))
    first = n.groupBy("h").agg(F.min("doc_id").alias("earlier"))
    edges = n.join(first, "h").where("doc_id > earlier").select(F.col("doc_id").alias("later"), "earlier")
    return O.greedy_accept(n.select("doc_id"), edges, "doc_id")


@register("greedy_accept_near", None)
def greedy_accept_near(spark: SparkSession, folder: str) -> DataFrame:
    """Acceptance with near-duplicate conflicts: order-dependent, so no SQL; tested against the sequential loop."""
    return O.greedy_accept_near(d(spark, folder), "doc_id")


@register("results_with_cases", "SELECT d.doc_id, d.source, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def results_with_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Results joined with cases; a result without a case is an error, a case without one is skipped."""
    return J.strict_inner(load(spark, folder, "labels").select("doc_id", "toxic"), d(spark, folder).select("doc_id", "source"), "doc_id").select("doc_id", "source", "toxic")


@register("assemble_with_rejects", "SELECT o_orderkey AS id, c_name AS name, l.n AS n_lines, CASE WHEN c_name IS NULL THEN 'missing_customer' WHEN l.n IS NULL THEN 'missing_lines' END AS reject FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1) l ON l_orderkey = o_orderkey")
def assemble_with_rejects(spark: SparkSession, folder: str) -> DataFrame:
    o = load(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    c = load(spark, folder, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    n = load(spark, folder, "lineitem").where("l_orderkey % 7 <> 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n_lines"))
    return J.assemble(o, [("customer", c, "k", "name"), ("lines", n, "id", "n_lines")]).select("id", "name", "n_lines", "reject")


@register("plan_against_returns", "WITH r AS (SELECT l_orderkey + 100 AS id FROM lineitem WHERE l_linenumber <= 2) SELECT 'duplicate' AS kind, count(*) AS n FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'missing', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM r) UNION ALL SELECT 'unknown', count(DISTINCT id) FROM r WHERE id NOT IN (SELECT o_orderkey FROM orders)")
def plan_against_returns(spark: SparkSession, folder: str) -> DataFrame:
    returned = load(spark, folder, "lineitem").where("l_linenumber <= 2").select((F.col("l_orderkey") + 100).alias("id"))
    return J.reconcile(load(spark, folder, "orders").select(F.col("o_orderkey").alias("id")), returned, "id").groupBy("kind").agg(F.count("*").alias("n"))


@register("packet_overrides", "SELECT c.c_custkey, coalesce(p.c_name, c.c_name) AS c_name, CASE WHEN p.c_custkey IS NOT NULL THEN p.c_acctbal ELSE c.c_acctbal END AS c_acctbal FROM customer c LEFT JOIN (SELECT c_custkey, 'corrected ' || c_name AS c_name, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_custkey % 10 = 0) p USING (c_custkey)")
def packet_overrides(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    packet = c.where("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("corrected "), "c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return J.override(c, packet, "c_custkey")


@register("reviews_last_wins", "SELECT o_custkey AS custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderstatus, o_orderkey) = 'O' AS open FROM orders GROUP BY 1")
def reviews_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    o = load(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    return J.last_by(o, "custkey", "o_orderkey").select("custkey", "status", (F.col("status") == "O").alias("open"))


@register("three_level_fallback", """
WITH own AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) END AS style FROM documents), fam AS (SELECT source, min_by(style, doc_id) FILTER (style IS NOT NULL AND source <> 'src3') AS style FROM own GROUP BY source),
longest AS (SELECT max_by(substr(text, 1, 20), length(text) * 1000000 - doc_id) AS style FROM documents)
SELECT doc_id, coalesce(CASE WHEN own.source <> 'src3' THEN own.style END, fam.style, (SELECT style FROM longest)) AS style FROM own LEFT JOIN fam USING (source)""")
def three_level_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A row's own style text, else its family's first, else the longest of all."""
    x = d(spark, folder).select("doc_id", "source", F.substring("text", 1, 20).alias("s"), F.length("text").alias("n"))
    x = x.withColumn("own", F.when((F.col("doc_id") % 3 == 0) & (F.col("source") != "src3"), F.col("s")))
    family = x.groupBy("source").agg(F.min_by("own", F.when(F.col("own").isNotNull(), F.col("doc_id"))).alias("fam"))
    longest = x.agg(F.max_by("s", F.struct("n", -F.col("doc_id"))).alias("any"))
    return x.join(family, "source", "left").crossJoin(F.broadcast(longest)).select("doc_id", F.coalesce("own", "fam", "any").alias("style"))


@register("range_overlap_conflicts", """
WITH p AS (SELECT p_partkey AS id, p_brand AS topic, p_partkey % 3 AS split, 1600 + p_size * 5 AS s, 1600 + p_size * 5 + p_partkey % 7 AS e FROM part)
SELECT a.id AS a, b.id AS b, a.topic FROM p a JOIN p b ON a.topic = b.topic AND a.split <> b.split AND a.id < b.id AND a.s <= b.e AND b.s <= a.e""")
def range_overlap_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of one topic in different splits whose ranges overlap."""
    p = load(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("topic"), (F.col("p_partkey") % 3).alias("split"), (1600 + F.col("p_size") * 5).alias("s"), (1600 + F.col("p_size") * 5 + F.col("p_partkey") % 7).alias("e"))
    return J.range_conflicts(p, "id", "topic", "split", "s", "e")


@register("period_by_overlap", """
WITH per AS (SELECT i AS ord, 1500 + i * 60 AS ps, 1500 + i * 60 + 79 AS pe FROM range(0, 8) t(i)), p AS (SELECT p_partkey AS id, 1500 + p_partkey % 450 AS s, 1500 + p_partkey % 450 + p_size AS e FROM part),
o AS (SELECT id, ord, least(e, pe) - greatest(s, ps) + 1 AS w FROM p JOIN per ON s <= pe AND ps <= e)
SELECT id, arg_max(ord, w * 100 - ord) AS period, max(w) AS years FROM o GROUP BY id""")
def period_by_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The period that shares most years with a range, the first on ties."""
    periods = spark.range(8).select(F.col("id").alias("ord"), (1500 + F.col("id") * 60).alias("ps"), (1500 + F.col("id") * 60 + 79).alias("pe"))
    p = load(spark, folder, "part").select(F.col("p_partkey").alias("id"), (1500 + F.col("p_partkey") % 450).alias("s"), (1500 + F.col("p_partkey") % 450 + F.col("p_size")).alias("e"))
    return J.best_range(p, periods, "id", "s", "e", "ord", "ps", "pe").select("id", F.col("ord").alias("period"), F.col("overlap").alias("years"))


@register("ranked_matches", f"""
WITH t AS ({TOKENS.format(key='doc_id', table='documents')}), b AS ({TOKENS.format(key='item_id', table='benchmark')}), s AS (SELECT item_id, doc_id, count(*) AS score FROM b JOIN t USING (t) GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 4""")
def ranked_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The four documents that share most words with each item: a top-k report."""
    b = O.token_sets(load(spark, folder, "benchmark"), "item_id").select("item_id", "token")
    s = b.join(O.token_sets(d(spark, folder), "doc_id").select("doc_id", "token"), "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return s.withColumn("place", place.cast("long")).where("place <= 4")


@register("source_priority", """
WITH r AS (SELECT c_nationkey AS k, c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 2 END AS pri, c_name AS t FROM customer), m AS (SELECT k, min(pri) AS pri FROM r GROUP BY k)
SELECT k, pri, count(DISTINCT t) > 1 AS conflict, arg_min(t, id) AS chosen FROM r JOIN m USING (k, pri) GROUP BY k, pri""")
def source_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The best source's text for each key, with conflicts at the same priority marked."""
    s = F.col("c_mktsegment")
    r = load(spark, folder, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.when(s == "BUILDING", 0).when(s == "MACHINERY", 1).otherwise(2).alias("pri"), F.col("c_name").alias("t"))
    return J.by_priority(r, "k", "pri", "t", "id").select("k", "pri", "conflict", "chosen")


@register("paired_comparison", "SELECT o_orderpriority AS p, count(*) AS n, sum((o_orderkey % 7 > o_orderkey % 5)::BIGINT)::BIGINT AS better, sum((o_orderkey % 7 - o_orderkey % 5))::BIGINT AS delta FROM orders GROUP BY 1")
def paired_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Base against tuned results; the ids must be equal."""
    o = load(spark, folder, "orders")
    base = o.select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 5).alias("base"))
    both = J.paired(base, o.select("o_orderkey", (F.col("o_orderkey") % 7).alias("tuned")), "o_orderkey")
    return both.groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"), F.sum((F.col("tuned") > F.col("base")).cast("long")).alias("better"), F.sum(F.col("tuned") - F.col("base")).alias("delta"))


@register("pending_cases", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def pending_cases(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select("o_orderkey").join(load(spark, folder, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@register("leakage_by_id_or_text", f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark WHERE item_id < 3) OR md5({NORM.format('text')}) IN (SELECT md5({NORM.format('text')}) FROM documents WHERE doc_id % 50 = 0)")
def leakage_by_id_or_text(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose id or whose text's hash a held-out table has."""
    x = d(spark, folder).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("h"))
    ids = load(spark, folder, "benchmark").where("item_id < 3").select(F.col("item_id").alias("doc_id"))
    return J.in_either(x, ids, x.where("doc_id % 50 = 0").select("h"), "doc_id", "h").select("doc_id")


@register("tag_intersection", "SELECT doc_id, len(list_intersect([source, lang, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END], ['src1', 'de', 'even']))::INTEGER AS n_shared FROM documents WHERE list_has_any([source, lang, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END], ['src1', 'de', 'even'])")
def tag_intersection(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.array("source", "lang", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    wanted = F.array(*[F.lit(x) for x in ("src1", "de", "even")])
    return d(spark, folder).where(F.arrays_overlap(tags, wanted)).select("doc_id", F.size(F.array_intersect(tags, wanted)).alias("n_shared"))


@register("composite_key_lookup", "SELECT l_orderkey, l_linenumber, p.n AS part_lines FROM lineitem LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) p USING (l_partkey, l_suppkey)")
def composite_key_lookup(spark: SparkSession, folder: str) -> DataFrame:
    x = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return x.join(x.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("part_lines")), ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "part_lines")


@register("contained_words", f"SELECT item_id, (SELECT count(DISTINCT t) FROM ({TOKENS.format(key='doc_id', table='documents')}) x WHERE list_contains({FP}, t)) AS n_shared FROM benchmark")
def contained_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each item that occur anywhere in the corpus."""
    words = O.token_sets(d(spark, folder), "doc_id").select("token").distinct()
    b = load(spark, folder, "benchmark")
    n = O.token_sets(b, "item_id").join(words, "token").groupBy("item_id").agg(F.count("*").alias("n"))
    return b.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_shared"))
