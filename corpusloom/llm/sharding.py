"""Sharding by extendible hashing: byte-bounded shards named by hash-prefix bits.

Rows hash to 32 bits (the first of md5 of their key). A directory says, for each prefix, how many of its
bits name the shard: the fewest so that the shard fits the limit; only oversized buckets split on
another bit. Sizes are summed by prefix on the executors, ``STEP`` bits at a time, and only rows of
buckets that are still oversized are summed again.

Rows with one key share all their bits. A bucket of ``DEPTH`` bits that is still oversized is cut into
overflow pages by running sizes: rows are written once with running ids, blocks of ids are summed, then
each row adds its place in its block. A row of over half the limit has a page of its own, so only a row that is
itself larger passes the limit.

Edge cases: null text and sizes count 0 bytes and a null key hashes as the empty string; repeated rows and keys with
equal hashes count each and share a bucket; an empty table gives an empty result; a table within the limit is one
shard with no bits; very long texts count by their bytes; extra columns are kept, also those with names of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own, spare, stash

DEPTH, STEP, BLOCK = 32, 8, 4096

#: Bits of a directory level that is broadcast: 65,536 cells at most.
SMALL_LEVEL = 16

#: Bytes of text in a shard at most.
LIMIT = 32 << 20


def key_hash(key: Column) -> Column:
    """The first 32 bits of md5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, DEPTH - depth)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """``(cell, level, depth, bytes)``: the shard depth of each directory cell, a prefix of ``level`` bits.

    ``sizes``: ``(h, bytes)``. A cell's ``depth`` is at most its ``level``, or null if even that is oversized;
    such cells are split by the next level. A level has at most 2**STEP cells for each oversized bucket.
    """
    left, found, level = sizes, None, 0
    while level < DEPTH:
        below, level = level, level + STEP
        cells = stash(left.groupBy(prefix(F.col("h"), level).alias("cell")).agg(F.sum("bytes").alias("bytes")), "directory")
        depth, size = F.lit(None).cast("int"), F.col("bytes")
        for d in range(level, below, -1):
            at = f"_{d}"
            cells = cells.withColumn(at, F.sum("bytes").over(Window.partitionBy(F.shiftright("cell", level - d))))
            depth, size = F.when(F.col(at) <= limit, F.lit(d)).otherwise(depth), F.when(F.col(at) <= limit, F.col(at)).otherwise(size)
        if below == 0:
            whole = F.sum("bytes").over(Window.partitionBy(F.lit(0)))  # 256 cells at most
            cells = cells.withColumn("_0", whole)
            depth, size = F.when(F.col("_0") <= limit, F.lit(0)).otherwise(depth), F.when(F.col("_0") <= limit, F.col("_0")).otherwise(size)
        cells = stash(cells.select("cell", F.lit(level).alias("level"), depth.alias("depth"), size.alias("bytes")), "directory")
        found = cells if found is None else found.unionByName(cells)
        over = cells.where("depth IS NULL").select("cell")
        if level == DEPTH or not over.head(1):
            return found
        left = left.withColumn("cell", prefix(F.col("h"), level)).join(over, "cell", "left_semi").drop("cell")
    return found


def assign_shards(rows: DataFrame, key: str = "doc_id", size: str = "bytes", limit: int = LIMIT) -> DataFrame:
    """``rows`` and ``shard`` (prefix bits, then ``+page`` where a bucket overflows), ``depth``, ``page`` and ``shard_bytes``.

    Columns that ``rows`` has by these names are kept under their own names; the results then get ``_`` before theirs.
    Levels of up to ``SMALL_LEVEL`` bits have that many powers of two of cells at most, so they are broadcast and a row
    that ends there is read once; only rows of buckets that are still oversized meet the deeper levels by a shuffle.
    """
    names = {c: spare(rows, c) for c in ("shard", "depth", "page", "shard_bytes")}
    data = rows.select(F.struct(*own(rows)).alias("row"), key_hash(F.col(key)).alias("h"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("bytes"))
    cells = directory(data.select("h", "bytes"), limit)
    out, rest = None, data
    levels = [r["level"] for r in cells.select("level").distinct().orderBy("level").collect()]  # four at most
    at, known = data, []
    for level in (x for x in levels if x <= SMALL_LEVEL):
        held = cells.where(F.col("level") == level).select(F.col("cell").alias(f"cell_{level}"), F.struct("depth", "bytes").alias(f"at_{level}"))
        at = at.withColumn(f"cell_{level}", prefix(F.col("h"), level)).join(F.broadcast(held), f"cell_{level}", "left")
        known.append(F.when(F.col(f"at_{level}.depth").isNotNull(), F.col(f"at_{level}")))
    if known:
        at = at.withColumn("found", F.coalesce(*known))
        out = at.where("found IS NOT NULL").select("row", "h", "found.depth", F.lit(0).cast("long").alias("page"), F.col("found.bytes").alias("shard_bytes"))
        rest = at.where("found IS NULL").select("row", "h", "bytes")
    for level in (x for x in levels if x > SMALL_LEVEL):
        held = cells.where(F.col("level") == level).select("cell", "depth", F.col("bytes").alias("shard_bytes"))
        at = rest.withColumn("cell", prefix(F.col("h"), level)).join(held, "cell")
        out = out.unionByName(at.where("depth IS NOT NULL").select("row", "h", "depth", F.lit(0).cast("long").alias("page"), "shard_bytes"))
        rest = at.where("depth IS NULL").select("row", "h", "bytes")
    if cells.where((F.col("level") == DEPTH) & F.col("depth").isNull()).head(1):
        out = out.unionByName(_overflow(rest, limit))
    if out is None:  # an empty table has no cells
        out = data.limit(0).select("row", "h", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("shard_bytes"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(F.col("h")), DEPTH, "0"))
    name = F.concat(F.substring(bits, F.lit(1), F.col("depth")), F.when(F.col("page") > 0, F.concat(F.lit("+"), F.col("page").cast("string"))).otherwise(""))
    return out.select(*[F.col("row")[c].alias(c) for c in rows.columns], name.alias(names["shard"]), F.col("depth").alias(names["depth"]), F.col("page").alias(names["page"]), F.col("shard_bytes").alias(names["shard_bytes"]))


def _overflow(rest: DataFrame, limit: int) -> DataFrame:
    """Pages of buckets that no further bit splits: rows over half the limit have one each, the others share pages by running sizes."""
    rows = stash(rest.withColumn("id", F.monotonically_increasing_id()), "overflow").withColumn("large", F.col("bytes") * 2 > limit)
    rows = rows.withColumn("block", F.floor(F.col("id") / BLOCK))
    # a place among the bucket's small rows in bytes, and among its large ones by count
    blocks = rows.groupBy("h", "large", "block").agg(F.sum("bytes").alias("n"), F.count("*").alias("k"), F.max("bytes").alias("most"))
    everything = Window.partitionBy("h", "large")
    before = everything.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select("h", "large", "block", (F.sum("n").over(before) - F.col("n")).alias("n_before"), (F.sum("k").over(before) - F.col("k")).alias("k_before"), F.max("most").over(everything).alias("most"))
    inner = Window.partitionBy("h", "large", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("n_within", F.sum("bytes").over(inner)).withColumn("k_within", F.row_number().over(Window.partitionBy("h", "large", "block").orderBy("id"))).join(blocks, ["h", "large", "block"])
    # pages start at multiples of the limit less the largest small row, so that none passes the limit; large rows get odd pages, small ones even
    start = F.col("n_before") + F.col("n_within") - F.col("bytes")
    page = F.when(F.col("large"), 2 * (F.col("k_before") + F.col("k_within")) - 1).otherwise(2 * (F.floor(start / (F.lit(limit) - F.col("most"))) + 1))
    paged = placed.withColumn("page", page.cast("long"))
    sums = paged.groupBy("h", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return paged.join(sums, ["h", "page"]).select("row", "h", F.lit(DEPTH).alias("depth"), "page", "shard_bytes")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with shards sized by UTF-8 bytes of ``text``, which stand in a column ``bytes`` (with ``_`` before it where ``docs`` has one)."""
    size = spare(docs, "bytes")
    return assign_shards(docs.withColumn(size, F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))), key, size, limit)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Writes each shard as a Parquet partition of its own."""
    sharded = shard_documents(docs, key, text, limit)
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
