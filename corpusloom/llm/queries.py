"""The ``opN_<name>`` queries: thin contracts over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("bytes"))
    return sharding.assign_shards(docs).select("doc_id", "shard", "depth", "bytes", "shard_bytes")


def shards_of_256_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1`` with a limit that small tables split at too."""
    from . import sharding

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("bytes"))
    return sharding.assign_shards(docs, limit=1 << 18).select("doc_id", "shard", "depth", "bytes", "shard_bytes")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train_on(docs)).select("doc_id", "findings")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("findings", lambda f: f["kind"] != "learned")), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.read_documents(token_files.write_corpus(table(spark, sf_dir, "documents"), end_id=2))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"))[0]


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    read = media.read_media(media.encode_media(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("fp_times").cast("string"), F.lit(":"), F.sha2(F.concat(F.concat_ws(",", F.col("fp_times").cast("array<string>")), F.lit("|"), F.concat_ws(",", F.col("fp_codes").cast("array<string>"))), 256)).alias("feature"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("m")).select("conv_id", "m.turn", "m.role", F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chat(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    read = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)} | {"shards_of_256_kb": shards_of_256_kb}
