"""Queries over windows, rankings, quotas and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import select as S
from ..sources.tables import load
from .registry import register
from .text_queries import NORM


def d(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents")


NORMED = f"WITH n AS (SELECT doc_id, source, lang, n_chars, md5({NORM.format('text')}) AS h FROM documents) "


def normed(spark: SparkSession, folder: str) -> DataFrame:
    return d(spark, folder).select("doc_id", "source", "lang", "n_chars", F.md5(T.normalize(F.col("text"))).alias("h"))


@register("first_seen_duplicates", NORMED + "SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY h) THEN 'exact_duplicate_of:' || min(doc_id) OVER (PARTITION BY h) END AS reason FROM n")
def first_seen_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    x = J.first_seen(normed(spark, folder), "h", "doc_id")
    return x.select("doc_id", F.concat(F.lit("exact_duplicate_of:"), F.col("duplicate_of").cast("string")).alias("reason"))


@register("all_copies_flagged", NORMED + "SELECT doc_id, count(*) OVER (PARTITION BY h) > 1 AS copied, row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 AS later_copy FROM n")
def all_copies_flagged(spark: SparkSession, folder: str) -> DataFrame:
    x = normed(spark, folder)
    return x.select("doc_id", (F.count("*").over(Window.partitionBy("h")) > 1).alias("copied"), (F.row_number().over(Window.partitionBy("h").orderBy("doc_id")) > 1).alias("later_copy"))


@register("round_robin_quota", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s:pick:' || doc_id)) AS r FROM documents) ORDER BY r, source LIMIT 50")
def round_robin_quota(spark: SparkSession, folder: str) -> DataFrame:
    return S.round_robin(d(spark, folder).select("doc_id", "source"), "source", [S.stable_key(F.col("doc_id"), "s", "pick")], 50)


@register("renumbered_groups", "SELECT doc_id, source, 'n' || lpad((row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1)::VARCHAR, 3, '0') AS name FROM documents")
def renumbered_groups(spark: SparkSession, folder: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")) - 1
    return d(spark, folder).select("doc_id", "source", F.concat(F.lit("n"), F.lpad(place.cast("string"), 3, "0")).alias("name"))


@register("every_other_eligible", "SELECT doc_id, (n_chars > 1000) AND sum((n_chars > 1000)::INTEGER) OVER (PARTITION BY source ORDER BY doc_id) % 2 = 1 AS picked FROM documents")
def every_other_eligible(spark: SparkSession, folder: str) -> DataFrame:
    return S.every_other(d(spark, folder).select("doc_id", "source", "n_chars"), F.col("n_chars") > 1000, "source", "doc_id").select("doc_id", "picked")


@register("priority_sample", "SELECT doc_id FROM documents ORDER BY 4 * (doc_id % 3 = 0)::INTEGER + 2 * (doc_id % 5 = 0)::INTEGER + (doc_id % 7 = 0)::INTEGER DESC, doc_id LIMIT (SELECT greatest(1, ceil(0.1 * count(*)))::BIGINT FROM documents)")
def priority_sample(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    p = 4 * (i % 3 == 0).cast("int") + 2 * (i % 5 == 0).cast("int") + (i % 7 == 0).cast("int")
    return S.priority_sample(d(spark, folder).select("doc_id"), p, "doc_id", 0.1)


@register("marker_blocks", "WITH m AS (SELECT conv_id, turn, role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations WHERE role = 'user') SELECT conv_id, turn, coalesce(nxt, (SELECT max(turn) + 1 FROM conversations c WHERE c.conv_id = m.conv_id)) - turn AS length FROM m")
def marker_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks from one marker turn to the next."""
    c = load(spark, folder, "conversations").select("conv_id", "turn", "role")
    last = c.withColumn("stop", F.max("turn").over(Window.partitionBy("conv_id")) + 1).where("role = 'user'")
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return last.select("conv_id", "turn", (F.coalesce(nxt, "stop") - F.col("turn")).alias("length"))


@register("page_assembly", "WITH l AS (SELECT conv_id, turn % 4 AS page, arg_max(text, length(text) * 1000 - turn) AS text FROM conversations GROUP BY 1, 2) SELECT conv_id, count(*) AS n_pages, count(*) = max(page) + 1 AS complete, md5(string_agg(text, chr(10) ORDER BY page)) AS digest FROM l GROUP BY conv_id")
def page_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """The longest text of each page, joined in page order; complete if no page is missing."""
    c = load(spark, folder, "conversations")
    best = c.groupBy("conv_id", (F.col("turn") % 4).alias("page")).agg(F.max_by("text", F.length("text") * 1000 - F.col("turn")).alias("text"))
    return best.groupBy("conv_id").agg(F.count("*").alias("n_pages"), (F.count("*") == F.max("page") + 1).alias("complete"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")).alias("digest"))


@register("tolerant_ranking", "WITH s AS (SELECT source, avg(n_chars) AS m FROM documents GROUP BY source), c AS (SELECT *, m >= (SELECT max(m) FROM s) - 500 AS close FROM s) SELECT source, close AND row_number() OVER (ORDER BY close DESC, (source LIKE '%1%') DESC, m DESC, source) = 1 AS chosen FROM c")
def tolerant_ranking(spark: SparkSession, folder: str) -> DataFrame:
    s = d(spark, folder).groupBy("source").agg(F.avg("n_chars").alias("m"))
    return S.tolerant_best(s, "m", 500.0, F.col("source").contains("1"), "source").select("source", "chosen")


@register("multi_key_ranking", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY coalesce(CASE WHEN l_discount > 0.05 THEN l_quantity END, -1) DESC, l_extendedprice, l_orderkey, l_linenumber) AS place FROM lineitem QUALIFY place <= 100")
def multi_key_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """A top-100 report by mixed directions with nulls last."""
    top = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.coalesce(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")), F.lit(-1.0)).alias("q"))
    top = top.orderBy(F.desc("q"), "l_extendedprice", "l_orderkey", "l_linenumber").limit(100)
    return top.select("l_orderkey", "l_linenumber", F.row_number().over(Window.orderBy(F.desc("q"), "l_extendedprice", "l_orderkey", "l_linenumber")).cast("long").alias("place"))


@register("top_k_with_backfill", "WITH r AS (SELECT source, doc_id, CASE WHEN n_chars > 5000 THEN 0 WHEN n_chars > 1500 THEN 1 END AS tier, n_chars FROM documents) SELECT source, doc_id, tier FROM r WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY tier, n_chars DESC, doc_id) <= CASE WHEN tier = 0 THEN 10 ELSE 5 END")
def top_k_with_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """At most ten above a high threshold; below it, only as many as fill up to five."""
    n = F.col("n_chars")
    r = d(spark, folder).select("source", "doc_id", "n_chars", F.when(n > 5000, 0).when(n > 1500, 1).alias("tier")).where("tier IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("source").orderBy("tier", F.desc("n_chars"), "doc_id"))
    return r.withColumn("p", place).where(F.col("p") <= F.when(F.col("tier") == 0, 10).otherwise(5)).select("source", "doc_id", "tier")


@register("apportioned_quotas", "WITH w AS (SELECT lang, count(*) AS w FROM documents GROUP BY lang), e AS (SELECT lang, w * 137 / (SELECT sum(w) FROM w) AS exact FROM w), b AS (SELECT *, floor(exact)::BIGINT AS base FROM e), r AS (SELECT *, row_number() OVER (ORDER BY round(exact - base, 9) DESC, lang) AS r, 137 - sum(base) OVER () AS spare FROM b) SELECT lang, base + (r <= spare)::BIGINT AS quota FROM r")
def apportioned_quotas(spark: SparkSession, folder: str) -> DataFrame:
    return S.apportion_groups(d(spark, folder), "lang", F.lit(1), 137)


@register("stable_hash_order", "SELECT doc_id, sha256('seed:train:' || doc_id) AS k, row_number() OVER (ORDER BY sha256('seed:train:' || doc_id)) AS place FROM documents QUALIFY place <= 25")
def stable_hash_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first 25 in seeded hash order: a sample."""
    k = d(spark, folder).select("doc_id", S.stable_key(F.col("doc_id"), "seed", "train").alias("k")).orderBy("k").limit(25)
    return k.withColumn("place", F.row_number().over(Window.orderBy("k")).cast("long"))


@register("family_splits", None)
def family_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage-greedy family splits: sequential, so no SQL; tested for exact sizes, disjointness and order independence."""
    x = d(spark, folder).select("doc_id", F.concat_ws("-", "source", "lang").alias("family"), "source", "lang")
    return S.family_splits(x, "family", "source", "lang", {"train": 0.70, "dev": 0.15, "challenge": 0.15}, "seed").select("doc_id", "family", "split")


@register("matched_length_sample", None)
def matched_length_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Per language a sample whose lengths follow those of a target: tested for quota and quantiles."""
    x = d(spark, folder).select("doc_id", "lang", "n_chars")
    return S.matched_lengths(x.where("doc_id % 2 = 1"), "doc_id", "lang", "n_chars", x.where("doc_id % 2 = 0"), 20)


@register("complete_pairs", "SELECT source, pair FROM (SELECT source, pair, row_number() OVER (PARTITION BY source ORDER BY pair) AS r FROM (SELECT source, doc_id // 40 AS pair FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL HAVING count(DISTINCT (doc_id // 20) % 2) = 2)) WHERE r <= 15")
def complete_pairs(spark: SparkSession, folder: str) -> DataFrame:
    x = d(spark, folder).where("doc_id % 3 <> 0").select("source", F.floor(F.col("doc_id") / 40).alias("pair"), (F.floor(F.col("doc_id") / 20) % 2).alias("side"))
    return S.complete_pairs(x, "pair", "side", "source", 15)


@register("prefix_limits", "SELECT n, count(*) AS rows, max(doc_id) AS last_id, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest FROM (SELECT unnest([10, 25, 50]) AS n) p, (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) d WHERE r <= n GROUP BY n")
def prefix_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The first n rows for several n, with a digest of each prefix."""
    first = d(spark, folder).select("doc_id").orderBy("doc_id").limit(50).withColumn("r", F.row_number().over(Window.orderBy("doc_id")))
    each = first.withColumn("n", F.explode(F.array(F.lit(10), F.lit(25), F.lit(50)))).where("r <= n")
    return each.groupBy("n").agg(F.count("*").alias("rows"), F.max("doc_id").alias("last_id"), F.sha2(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ","), 256).alias("digest"))


@register("source_union", "SELECT 'document' AS kind, doc_id AS id, length(text)::INTEGER AS n FROM documents UNION ALL SELECT 'item', item_id, length(text)::INTEGER FROM benchmark UNION ALL SELECT 'page', page_id, length(html)::INTEGER FROM pages")
def source_union(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda kind, t, k, x: load(spark, folder, t).select(F.lit(kind).alias("kind"), F.col(k).alias("id"), F.length(x).alias("n"))
    return part("document", "documents", "doc_id", "text").unionByName(part("item", "benchmark", "item_id", "text")).unionByName(part("page", "pages", "page_id", "html"))


@register("key_sets", "SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'any', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)")
def key_sets(spark: SparkSession, folder: str) -> DataFrame:
    a, b = load(spark, folder, "orders").select(F.col("o_custkey").alias("k")), load(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    n = lambda name, x: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n("both", a.intersect(b)).unionByName(n("only_customers", b.subtract(a))).unionByName(n("any", a.union(b).distinct()))


@register("set_number_split", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 + 1 END, regexp_extract(source, '([0-9])$', 1)::BIGINT % 2 + 1) AS set_no FROM documents")
def set_number_split(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    return d(spark, folder).select("doc_id", F.coalesce(F.when(i % 3 != 0, i % 2 + 1), F.regexp_extract("source", "([0-9])$", 1).cast("long") % 2 + 1).alias("set_no"))


@register("mixture_with_top_up", "WITH b AS (SELECT doc_id, lang, 0 AS tier FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, lang, 1 FROM documents WHERE doc_id % 10 <> 0) SELECT doc_id, lang, tier FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY tier, doc_id) <= 40")
def mixture_with_top_up(spark: SparkSession, folder: str) -> DataFrame:
    x = d(spark, folder).select("doc_id", "lang")
    return S.with_top_up(x.where("doc_id % 10 = 0"), x.where("doc_id % 10 <> 0"), "lang", "doc_id", 40)


@register("task_categories", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('s:cat:' || doc_id)) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.15) THEN 'adversarial' WHEN r <= floor(n * 0.25) THEN 'boundary' ELSE 'plain' END AS category FROM r")
def task_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Shares by rank in stable hash order."""
    x = S.hash_ranks(d(spark, folder).select("doc_id"), "doc_id", "s", "cat")
    return x.select("doc_id", F.when(F.col("rank") < F.floor(F.col("n") * 0.15), "adversarial").when(F.col("rank") < F.floor(F.col("n") * 0.25), "boundary").otherwise("plain").alias("category"))


@register("balanced_shards", "SELECT doc_id, ntile(30) OVER (ORDER BY sha256('s:shard:' || doc_id))::INTEGER AS shard FROM documents")
def balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return S.hash_shards(d(spark, folder).select("doc_id"), "doc_id", 30, "s")


@register("pilot_selection", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('s:pilot:' || doc_id)) AS r FROM documents) WHERE r <= 2 + (regexp_extract(source, '([0-9]+)$', 1)::INTEGER < 6)::INTEGER")
def pilot_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Two rows of each source, and one more of the first six."""
    x = d(spark, folder).select("source", "doc_id")
    r = F.row_number().over(Window.partitionBy("source").orderBy(S.stable_key(F.col("doc_id"), "s", "pilot")))
    return x.withColumn("r", r).where(F.col("r") <= 2 + (F.regexp_extract("source", "([0-9]+)$", 1).cast("int") < 6).cast("int")).select("source", "doc_id")


@register("exact_subset", "SELECT source AS name, count(*) FILTER (doc_id % 2 = 0) AS g, count(*) FILTER (doc_id % 2 = 1) AS b FROM documents WHERE source IN ('src0', 'src1', 'src10') GROUP BY source")
def exact_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Groups whose two counts sum exactly to the wanted ones; here those of the first three groups by name."""
    g = d(spark, folder).groupBy("source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("g"), F.count_if(F.col("doc_id") % 2 == 1).alias("b"))
    rows = sorted((r["source"], r["g"], r["b"]) for r in g.collect())  # one row a source
    want = [r for r in rows if r[0] in ("src0", "src1", "src10")]
    names = S.exact_subset(rows, sum(r[1] for r in want), sum(r[2] for r in want)) or []
    return g.where(F.col("source").isin(names)).select(F.col("source").alias("name"), "g", "b")


@register("ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    m = load(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return m.select("conv_id", F.array_join(F.array_distinct(F.col("m.role")), ",").alias("roles"))
