"""Readers, writers, manifests and the shared folder."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that all machines share. Where it is unset, one of its own, but only in
    local mode: a temporary folder of one machine is no use to the others, so a cluster without the setting is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """A written copy in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/corpusloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped and a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """JSON lines; nulls are written. One file only for small exports."""
    (df.coalesce(1) if single else df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_jsonl_strict(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value, ok)`` of every non-blank line; ok if it is one JSON object.

    Line numbers count within a file, which must be read whole; parsing is done by an Arrow function
    because only a full parser tells valid JSON.
    """
    from ..functions.jsonx import parse_udf

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("p", "value"))
    lines = whole.where(F.trim("value") != "").select("file", (F.col("p") + 1).alias("line"), "value")
    return lines.withColumn("ok", F.size(parse_udf("value")["reasons"]) == 0)


def discover(spark: SparkSession, folders: Iterable[str], pattern: str = "*.jsonl") -> DataFrame:
    """``(path, bytes)`` of matching files under folders, each once."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return read.load(list(folders)).select("path", F.col("length").alias("bytes")).distinct()


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, sha256, bytes)`` of each file."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return read.load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def tree_hash(files: DataFrame, framed: bool = True) -> str:
    """One sha256 over a manifest, in path order: of path and digest with separators, or joined plainly."""
    digest = hashlib.sha256()
    for row in files.orderBy("path").select("path", "sha256").toLocalIterator():
        digest.update(f"{row['path']}\0{row['sha256']}\n".encode() if framed else f"{row['path']}{row['sha256']}".encode())
    return digest.hexdigest()


def write_immutable(df: DataFrame, path: str, rejects: DataFrame | None = None) -> None:
    """Writes once: refuses an existing path, and any row in ``rejects``."""
    if rejects is not None and rejects.head(1):
        raise ValueError("the audit has rejects; nothing was written")
    df.write.mode("errorifexists").parquet(path)


def write_json_atomic(path: str, value: Mapping, backup: bool = False) -> None:
    """A small driver-side JSON file, replaced in one step."""
    if backup and os.path.exists(path):
        os.replace(path, f"{path}.bak")
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w") as f:
        json.dump(value, f, sort_keys=True, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def prefix_tables(df: DataFrame, order: str, sizes: Iterable[int]) -> dict[int, tuple[DataFrame, str]]:
    """The first n rows by ``order`` for each n, with a digest of their JSON lines in that order."""
    found = {}
    for n in sizes:
        part = df.orderBy(order).limit(n)
        lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(F.struct(*part.columns)).alias("j"))))
        digest = part.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["j"]), "\n"), 256)).first()[0]
        found[n] = part, digest
    return found


def markdown(rows: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table."""
    escape = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(escape(v) for v in r) + " |" for r in rows.collect())]) + "\n"


def read_phrases(spark: SparkSession, path: str) -> list[str]:
    """Allowed phrases of a file of JSON lines with ``phrase``, or of plain lines; each once, in order."""
    lines = [r["value"].strip() for r in spark.read.text(path).collect()]
    found = [json.loads(x).get("phrase", "") if x.startswith("{") else x for x in lines]
    return list(dict.fromkeys(p.strip() for p in found if p.strip()))


def export_public(df: DataFrame, path: str, private_tags: Iterable[str], tags: str = "tags", private_columns: Iterable[str] = ()) -> DataFrame:
    """Writes rows without private columns and returns their manifest; any private tag refuses the export."""
    if df.where(F.arrays_overlap(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.array(*[F.lit(t) for t in private_tags]))).head(1):
        raise ValueError("rows that may not be redistributed are among these")
    df.drop(*private_columns).write.mode("errorifexists").json(path)
    return manifest(df.sparkSession, path, "part-*")
