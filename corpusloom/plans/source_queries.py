"""Queries over sources, sinks, parsers, seeded functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import noise as N
from ..functions import text as T
from ..operators import overlap as O
from ..sources import parsers as P
from ..sources import tables as R
from ..streaming import streams as K
from .registry import register


def d(spark: SparkSession, folder: str) -> DataFrame:
    return R.load(spark, folder, "documents")


@register("jsonl_round_trip", "SELECT doc_id, source, lang, md5(text) AS digest FROM documents")
def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus written as JSON lines and read back with a fixed schema."""
    path = K.scratch(spark, "jsonl")
    x = d(spark, folder)
    R.write_jsonl(x, path, mode="errorifexists")
    return R.read_jsonl(spark, path, x.schema).select("doc_id", "source", "lang", F.md5("text").alias("digest"))


@register("strict_lines", "SELECT l.line, l.ok FROM (VALUES (1, true), (2, false), (4, false), (5, true)) l(line, ok)")
def strict_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line numbers of JSON lines, and whether each is one object."""
    path = K.scratch(spark, "lines")
    spark.createDataFrame([('{"a": 1}\n{"a": 1} x\n\n[1]\n{"b": {"c": 2}}',)], "value string").coalesce(1).write.text(path)
    return R.read_jsonl_strict(spark, path).select("line", "ok")


@register("immutable_write", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def immutable_write(spark: SparkSession, folder: str) -> DataFrame:
    """A table written once after its audit; writing again is refused."""
    path = K.scratch(spark, "once")
    x = d(spark, folder).groupBy("lang").agg(F.count("*").alias("n"))
    R.write_immutable(x, path, rejects=d(spark, folder).where("doc_id < 0"))
    try:
        R.write_immutable(x, path)
    except Exception as e:
        if "ALREADY_EXISTS" not in str(e):
            raise
        return spark.read.schema(x.schema).parquet(path)
    raise AssertionError("a second write was not refused")


@register("artifact_manifest", "SELECT 'labels' AS name, count(*) AS rows, (SELECT count(*) FROM labels) > 0 AS hashed FROM labels")
def artifact_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a written table with digests, and its rows."""
    path = K.scratch(spark, "manifest")
    x = R.load(spark, folder, "labels")
    R.write_jsonl(x, path, mode="errorifexists")
    files = R.manifest(spark, path, "part-*")
    hashed = F.bool_and((F.length("sha256") == 64) & (F.col("bytes") >= 0)).alias("hashed")
    return R.read_jsonl(spark, path, x.schema).agg(F.count("*").alias("rows")).crossJoin(files.agg(hashed)).select(F.lit("labels").alias("name"), "rows", "hashed")


@register("parsed_sample_sheets", "SELECT doc_id::VARCHAR AS doc, unnest(['1A', '1B']) AS sample_id, unnest([(doc_id % 7)::INTEGER, 3]) AS total, unnest([NULL, CASE WHEN doc_id % 2 = 0 THEN 'missing_page' END]) AS error FROM documents")
def parsed_sample_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets made from documents: two samples, the second short of a page in every other sheet."""
    i = F.col("doc_id")
    one = F.translate(F.substring("text", 1, 200), "\n\r", "  ")
    second = F.when(i % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("\nSample 1B 1 of 2\n"), one))
    sheet = F.concat(F.lit("Sample 1A 1 of 1\nx"), one, second, F.lit("\nSample 1B 2 of 2\nsecond page\nSample: 1A\nTotal Score: "), (i % 7).cast("string"), F.lit("\nSample: 1B\nTotal Score: 3\n"))
    return P.parse_documents(d(spark, folder).select("doc_id", sheet.alias("sheet")), "doc_id", "sheet", P.parse_sheet).select("doc", "sample_id", "total", "error")


@register("parsed_labelled_samples", "SELECT doc_id::VARCHAR AS doc, '2' AS sample_id, (doc_id % 7)::INTEGER AS total FROM documents")
def parsed_labelled_samples(spark: SparkSession, folder: str) -> DataFrame:
    body = F.rpad(F.lit("word "), 150, "word ")
    text = F.concat(F.lit("Title\nSample 1: 5/6\ntoo short\nSample 2 - Score "), (F.col("doc_id") % 7).cast("string"), F.lit("\n"), body)
    return P.parse_documents(d(spark, folder).select("doc_id", text.alias("t")), "doc_id", "t", P.parse_labelled).select("doc", "sample_id", "total")


@register("parsed_card_sets", "SELECT doc_id::VARCHAR AS doc, '1' AS sample_id, 150 AS n FROM documents")
def parsed_card_sets(spark: SparkSession, folder: str) -> DataFrame:
    essay = F.rpad(F.lit("essay "), 150, "essay ")
    cards = F.to_json(F.struct(F.lit("Set").alias("title"), F.array(F.struct(F.lit("Prompt").alias("term"), F.col("lang").alias("definition")), F.struct(F.lit("Body").alias("term"), essay.alias("definition"))).alias("terms")))
    return P.parse_documents(d(spark, folder).select("doc_id", cards.alias("c")), "doc_id", "c", P.parse_cards).select("doc", "sample_id", (F.length("text") + 1).alias("n"))


@register("knowledge_facts", """
WITH s AS (SELECT item_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) BETWEEN 12 AND 120)) AS fact FROM benchmark),
r AS (SELECT item_id, fact, 2 * (length(fact) BETWEEN 40 AND 100)::INTEGER + contains(fact, ',')::INTEGER AS score FROM s)
SELECT item_id, fact, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, fact) AS place FROM (SELECT DISTINCT * FROM r) QUALIFY place <= 3""")
def knowledge_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The three best-scored sentences of each text: a top-k report."""
    s = R.load(spark, folder, "benchmark").select("item_id", F.explode(T.clauses(F.col("text"))).alias("fact")).distinct()
    s = s.withColumn("score", 2 * F.length("fact").between(40, 100).cast("int") + F.contains("fact", F.lit(",")).cast("int"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "fact")).cast("long")).where("place <= 3")


@register("keyword_index", "WITH w AS (SELECT item_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 4))) AS keyword FROM benchmark) SELECT keyword, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM w GROUP BY keyword")
def keyword_index(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword to item ids, over the benchmark."""
    t = O.token_sets(R.load(spark, folder, "benchmark"), "item_id")
    return t.groupBy(F.col("token").alias("keyword")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("ids"))


@register("style_copies", None)
def style_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Longest shared runs of pairs that share an 8-word span: no SQL form; tested against a plain search."""
    x, b = d(spark, folder), R.load(spark, folder, "benchmark")
    pairs = O.shared_spans(x, b, "doc_id", "item_id", 8)
    j = pairs.join(x.select("doc_id", F.col("text").alias("a")), "doc_id").join(b.select("item_id", F.col("text").alias("b")), "item_id")
    run = j.select("doc_id", "item_id", N.shared_run(T.normalize(F.col("a")), T.normalize(F.col("b"))).alias("run"), N.shared_sentences("a", "b").alias("hits"))
    return run.select("doc_id", "item_id", "run", "hits", F.array_join(N.style_copy(F.col("run"), F.col("hits")), ",").alias("reasons"))


@register("seeded_errors", None)
def seeded_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Seeded writing errors: a function of text and seed, tested for repeatability."""
    return d(spark, folder).select("doc_id", F.md5(N.with_errors("text", F.col("doc_id").cast("string"))).alias("digest"))


@register("entity_names", None)
def entity_names(spark: SparkSession, folder: str) -> DataFrame:
    return d(spark, folder).select("doc_id", F.size(N.entity_names("text")).alias("n_entities"))


@register("stream_resume", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_keys FROM events GROUP BY event_type")
def stream_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Events streamed into an append sink twice: the second run adds nothing."""
    sink = K.scratch(spark, "sink")
    for run in (1, 2):
        K.run_appending(K.open_stream(spark, folder, "events").select("event_id", "event_type"), sink, K.scratch(spark, f"progress{run}"), "event_id")
    return spark.read.schema("event_id long, event_type string").parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_keys"))


@register("stream_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly windows over the event stream, with a watermark (an extra)."""
    out = K.windowed_counts(K.open_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", "1 day", F.col("event_id"))
    return K.collect_stream(out, K.scratch(spark, "progress"), K.scratch(spark, "windows")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by user (an extra)."""
    return K.sessions(R.load(spark, folder, "events"), "user_id", "ts", "30 minutes")


@register("locked_evaluation", "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def locked_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """A result with a receipt that can be written once only."""
    receipt = K.scratch(spark, "receipt")
    r = R.load(spark, folder, "labels").groupBy("toxic").agg(F.count("*").alias("n"))
    K.once(spark, receipt, r)
    try:
        K.once(spark, receipt, r)
    except Exception as e:
        if "ALREADY_EXISTS" not in str(e):
            raise
        return spark.read.schema(r.schema).parquet(receipt)
    raise AssertionError("a second receipt was written")


@register("retry_tasks", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def retry_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of rejected rows, to run again."""
    rejected = R.load(spark, folder, "labels").where("toxic = 1").select("doc_id")
    return d(spark, folder).select("doc_id", "source").join(rejected, "doc_id", "left_semi")
