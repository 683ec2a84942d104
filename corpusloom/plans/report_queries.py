"""Queries over files, reports, splits, token lengths and outputs that are valid as given."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx as X
from ..functions import metrics as M
from ..functions import noise as N
from ..functions import text as T
from ..functions import tokens
from ..operators import select as S
from ..sources import parsers as P
from ..sources import tables as R
from ..streaming import streams as K
from .cases import CASES, CRITERIA, cases
from .registry import register


def d(spark: SparkSession, folder: str) -> DataFrame:
    return R.load(spark, folder, "documents")


OFFICIAL = """o AS (SELECT doc_id AS id, (doc_id % 50 + 1) % 3 + CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END AS set_number, 'p' || (doc_id % 40) AS prompt, (2020 + doc_id % 4) AS year, 's' || (doc_id // 400) AS sample FROM documents)"""


def official(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    return d(spark, folder).select(i.alias("id"), ((i % 50 + 1) % 3 + F.when(i % 50 == 1, 1).otherwise(0)).alias("set_number"), F.concat(F.lit("p"), (i % 40).cast("string")).alias("prompt"), (2020 + i % 4).alias("year"), F.concat(F.lit("S"), F.floor(i / 400).cast("string")).alias("sample"))


@register("split_violations", f"""WITH {OFFICIAL}
SELECT id::VARCHAR AS id, 'bad_set_number' AS reason FROM o WHERE set_number NOT IN (1, 2)
UNION ALL SELECT min(id)::VARCHAR, 'duplicate_sample' FROM o GROUP BY year, prompt, set_number, upper(sample) HAVING count(*) > 1
UNION ALL SELECT min(id) FILTER (set_number = 1)::VARCHAR, 'prompt_on_both_sides' FROM o GROUP BY prompt HAVING count(*) FILTER (set_number = 1) > 0 AND count(*) FILTER (set_number = 2) > 0
UNION ALL SELECT '2', 'wrong_count' FROM o HAVING count(*) FILTER (set_number = 2) <> 7""")
def split_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What forbids a split by released set: ids, sets, samples, prompts on both sides and counts."""
    return S.split_violations(official(spark, folder), ["year", "prompt"], "sample", {2: 7})


GOOD = "case_id % 4 IN (0, 1)"


@register("layered_raw_valid", f"WITH {CASES} SELECT failure_type, count(*) AS n, avg(({GOOD})::INTEGER::DOUBLE) AS raw_valid_rate, avg((case_id % 4 IN (0, 1, 2))::INTEGER::DOUBLE) AS layered_valid_rate, count(*) FILTER (case_id % 4 = 1) AS n_extracted FROM cases GROUP BY failure_type")
def layered_raw_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs whose first grade object is strictly valid as it stands, valid after repair, or neither."""
    feedback = F.struct(*[F.lit("said").alias(c) for c in CRITERIA])
    strict = F.to_json(F.struct(F.struct(*CRITERIA).alias("scores"), feedback.alias("feedback")))
    k = F.col("case_id") % 4
    text = F.when(k == 0, strict).when(k == 1, F.concat(F.lit("Grade: "), strict)).when(k == 2, F.replace(strict, F.lit('{"scores"'), F.lit('{"total":1,"scores"'))).otherwise(F.substring(strict, 1, 20))
    p = cases(spark, folder).select("failure_type", X.repair_udf(text).alias("p"))
    return p.groupBy("failure_type").agg(F.count("*").alias("n"), M.rate(F.col("p.raw_valid") == "valid").alias("raw_valid_rate"), M.rate(F.col("p.normalized").isNotNull()).alias("layered_valid_rate"), F.count_if(F.array_contains("p.actions", "extracted_balanced_object") & F.col("p.normalized").isNotNull()).alias("n_extracted"))


@register("token_lengths", None)
def token_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Least, greatest and mean tokens of whole texts by language, by a public vocabulary."""
    n = d(spark, folder).select("lang", tokens.token_count(F.coalesce("text", F.lit("")), "byte_bpe_50k.json").alias("n"))
    return n.groupBy("lang").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.sum(F.col("n").cast("long")).alias("total"))


@register("page_text_normal", None)
def page_text_normal(spark: SparkSession, folder: str) -> DataFrame:
    """Page text in its compatibility form, cleaned: the form has no SQL."""
    return R.load(spark, folder, "pages").select("page_id", F.md5(T.page_text(N.nfkc("html"))).alias("digest"))


@register("discovered_files", "SELECT 3::BIGINT AS n_files, count(*)::BIGINT AS n_rows FROM labels")
def discovered_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of two overlapping folders, each once, and their rows."""
    path = K.scratch(spark, "found")
    for part in range(3):
        R.write_jsonl(R.load(spark, folder, "labels").where(F.col("doc_id") % 3 == part), f"{path}/{'ab'[part > 0]}/{part}", mode="errorifexists", single=True)
    files = R.discover(spark, [path, f"{path}/b"], "part-*.json")
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.json").text(path)
    return files.agg(F.count("*").alias("n_files")).crossJoin(rows.agg(F.count("*").alias("n_rows")))  # one row each


@register("tree_digest", "SELECT true AS same_again, true AS differs")
def tree_digest(spark: SparkSession, folder: str) -> DataFrame:
    """One digest over written files: the same for the same files, another for other rows or another framing."""
    path = K.scratch(spark, "tree")
    R.write_jsonl(R.load(spark, folder, "labels"), path, mode="errorifexists")
    files = R.manifest(spark, path, "part-*")
    whole, fewer = R.tree_hash(files), R.tree_hash(files.withColumn("sha256", F.reverse("sha256")))
    return spark.createDataFrame([(whole == R.tree_hash(files.orderBy(F.desc("path"))), whole != fewer and whole != R.tree_hash(files, framed=False))], "same_again boolean, differs boolean")


@register("markdown_report", "SELECT '# By language' || chr(10) || chr(10) || '| lang | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) || chr(10) AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def markdown_report(spark: SparkSession, folder: str) -> DataFrame:
    """A small aggregate as a Markdown table."""
    return spark.createDataFrame([(R.markdown(d(spark, folder).groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang"), "By language"),)], "report string")


@register("allowed_phrases", "SELECT DISTINCT trim(p_name) AS phrase FROM part WHERE trim(p_name) <> ''")
def allowed_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of a file of plain and JSON lines, each once."""
    path = K.scratch(spark, "phrases")
    p = R.load(spark, folder, "part")
    plain, coded = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("  "), "p_name").alias("value")), p.select(F.to_json(F.struct(F.col("p_name").alias("phrase"))).alias("value"))
    plain.unionByName(coded).write.text(path)
    return spark.createDataFrame([(x,) for x in R.read_phrases(spark, path)], "phrase string")


@register("public_export", "SELECT count(*) AS n, false AS has_text, true AS refused FROM documents WHERE source <> 'src1'")
def public_export(spark: SparkSession, folder: str) -> DataFrame:
    """Rows exported without private columns; a row with a private tag refuses the whole export."""
    tagged = d(spark, folder).withColumn("tags", F.array(F.when(F.col("source") == "src1", "private").otherwise("open")))
    path = K.scratch(spark, "public")
    R.export_public(tagged.where("source <> 'src1'"), path, ["private"], private_columns=["text"])
    try:
        R.export_public(tagged.unionByName(tagged.limit(1).withColumn("tags", F.array(F.lit("private")))), f"{path}-no", ["private"])
        refused = False
    except ValueError:
        refused = True
    out = spark.read.json(path)
    return out.agg(F.count("*").alias("n")).select("n", F.lit("text" in out.columns).alias("has_text"), F.lit(refused).alias("refused"))


@register("resume_identity", "SELECT count(*) AS n, true AS refused FROM labels")
def resume_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Records appended under one run's identity; the same keys under another one stop the batch and change nothing."""
    sink = K.scratch(spark, "identity")
    x = R.load(spark, folder, "labels").dropDuplicates(["doc_id"]).withColumn("run_id", F.lit("a"))
    K.append_new(x.where("doc_id % 2 = 0"), sink, "doc_id", "run_id")
    K.append_new(x, sink, "doc_id", "run_id")
    try:
        K.append_new(x.withColumn("run_id", F.lit("b")), sink, "doc_id", "run_id")
        refused = False
    except ValueError:
        refused = True
    return spark.read.schema(x.schema).parquet(sink).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


def docx(lines: list[str]) -> bytes:
    """A minimal DOCX file of paragraphs."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@register("parsed_docx", "SELECT item_id::VARCHAR AS doc, unnest(['1', '2']) AS sample_id, unnest([item_id % 7, 4])::INTEGER AS total, unnest([CASE WHEN item_id % 7 <> 4 THEN 'row_sum_mismatch' END, NULL]) AS error, md5(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM benchmark")
def parsed_docx(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of two essays each, made from whole texts, packed as DOCX and parsed again."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "content": [docx(["Essay 1", t, f"Scores: 1 0 2 1 total {i % 7}", "Essay 2", t, "Scores: 1 0 2 1 total 4"]) for i, t in zip(b["item_id"], b["text"], strict=True)]})

    x = R.load(spark, folder, "benchmark").select("item_id", T.squash(F.coalesce("text", F.lit(""))).alias("text"))
    made = x.mapInPandas(pack, "item_id long, content binary")
    return P.parse_documents(made, "item_id", "content", P.parse_docx).select("doc", "sample_id", "total", "error", F.md5("text").alias("digest"))


@register("parsed_whole_sheets", None)
def parsed_whole_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets, labelled samples and card sets made from whole texts, with a digest of what each parser took from them."""
    x = d(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sheet = F.concat(F.lit("Sample 1A 1 of 2\n"), "text", F.lit("\nSample 1A 2 of 2\nlast page\nSample: 1A\nThesis: 1\nTotal Score: 1\n"))
    labelled = F.concat(F.lit("Sample 1: 3/6\n"), "text", F.lit("\nSample 2 - Score 4\n"), F.rpad(F.lit("word "), 150, "word "))
    cards = F.to_json(F.struct(F.lit("Set").alias("title"), F.array(F.struct(F.lit("Prompt 1").alias("term"), F.lit("Why?").alias("definition")), F.struct(F.lit("Body").alias("term"), F.col("text").alias("definition"))).alias("terms")))
    found = None
    for kind, made, parser in (("sheet", sheet, P.parse_sheet), ("labelled", labelled, P.parse_labelled), ("cards", cards, P.parse_cards)):
        part = P.parse_documents(x.select("doc_id", made.alias("made")), "doc_id", "made", parser).select(F.lit(kind).alias("kind"), "doc", "sample_id", "total", "error", F.md5("text").alias("digest"))
        found = part if found is None else found.unionByName(part)
    return found


@register("atomic_record", "SELECT count(*) AS n, true AS replaced FROM labels")
def atomic_record(spark: SparkSession, folder: str) -> DataFrame:
    """A small driver-side record, replaced in one step with the former one kept beside it."""
    import tempfile

    n = R.load(spark, folder, "labels").count()
    with tempfile.TemporaryDirectory() as here:  # the driver's own file, which no executor reads
        path = f"{here}/record.json"
        R.write_json_atomic(path, {"n": 0})
        R.write_json_atomic(path, {"n": n}, backup=True)
        with open(path) as now, open(f"{path}.bak") as before:
            row = (json.load(now)["n"], json.load(before)["n"] == 0)
    return spark.createDataFrame([row], "n long, replaced boolean")
