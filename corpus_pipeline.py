"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. ``toxicity`` drops documents that the classifier scores 0.5 or more.
2. ``near_duplicates`` keeps one document of each group that links at a Jaccard of 0.8 or more over 5-word shingles.
3. ``decontamination`` drops documents that hold a region of a benchmark item.
4. ``secrets`` redacts findings within texts; it keeps every document.
5. ``packing`` returns the packed pieces of all that is left.

Stages 1 to 4 return the columns of ``documents``, extra ones too, whatever their names. Null texts count as empty and
are kept, as are rows without an id; of repeated rows of one id all are kept or none; ties go to the least id; very
long texts are read whole; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from corpusloom.llm.common import stash, table

#: Shingles and least Jaccard (in percent) of stage 2; the contract of ``op3`` binds that query only.
NEAR_WORDS, NEAR_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs, secrets.train_on(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)[0]


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the learned and fuzzy stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
