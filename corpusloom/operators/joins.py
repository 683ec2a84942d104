"""Joins with audit semantics: strict, rejecting, overriding, prioritized and by ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids in a list that ``range_conflicts`` joins as one at most, or about.
RANGE_IDS = 256


def strict_inner(results: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Inner join that fails at run time on a result without a case; cases without results are left out."""
    marked = results.join(cases.withColumn("_known", F.lit(True)), key, "left")
    return marked.where(F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("result without a case: "), F.col(key).cast("string"))).cast("boolean"))).drop("_known")


def assemble(tasks: DataFrame, parts: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Left joins of ``(name, table, key, required column)`` with ``reject``: the first part that is missing."""
    reject = F.lit(None).cast("string")
    for name, _, _, column in reversed(parts):
        reject = F.when(F.col(column).isNull(), f"missing_{name}").otherwise(reject)
    for _, part, key, _ in parts:
        tasks = tasks.join(part, key, "left")
    return tasks.withColumn("reject", reject)


def reconcile(plan: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """``(key, kind)``: planned keys that are missing, returned ones that are unknown or repeated."""
    n = returned.groupBy(key).agg(F.count("*").alias("_n"))
    both = plan.select(key).distinct().withColumn("_planned", F.lit(True)).join(n, key, "full_outer")
    kinds = F.array(F.when(F.col("_n").isNull(), "missing"), F.when(F.col("_planned").isNull(), "unknown"), F.when(F.col("_n") > 1, "duplicate"))
    return both.select(key, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def override(rows: DataFrame, packet: DataFrame, key: str) -> DataFrame:
    """Rows with a packet's row in place of their own where it has one."""
    rest = [c for c in rows.columns if c != key]
    other = packet.select(key, F.struct(*rest).alias("_p"))
    return rows.join(other, key, "left").select(key, *[F.when(F.col("_p").isNotNull(), F.col("_p")[c]).otherwise(F.col(c)).alias(c) for c in rest])


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an order, in one aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def by_priority(rows: DataFrame, key: str, priority: str, text: str, order: str) -> DataFrame:
    """``(key, priority, chosen, conflict)``: the best priority's first text; a conflict if that priority has several."""
    each = rows.groupBy(key, priority).agg(F.min_by(text, order).alias("chosen"), (F.min(text) != F.max(text)).alias("conflict"))
    return each.groupBy(key).agg(F.min_by(F.struct(priority, "chosen", "conflict"), priority).alias("_r")).select(key, f"_r.{priority}", "_r.chosen", "_r.conflict")


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails at run time unless both sides have the same keys."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full_outer")
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("key on one side only: "), F.col(key).cast("string"))).cast("boolean"))).drop("_l", "_r")


def in_either(rows: DataFrame, ids: DataFrame, hashes: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose key or digest is in a table: two left joins on small distinct tables, no union of rows."""
    a = ids.select(key).distinct().withColumn("_a", F.lit(True))
    b = hashes.select(digest).distinct().withColumn("_b", F.lit(True))
    return rows.join(a, key, "left").join(b, digest, "left").where("_a OR _b").drop("_a", "_b")


def range_conflicts(rows: DataFrame, key: str, topic: str, split: str, start: str, end: str) -> DataFrame:
    """``(a, b, topic)``: pairs of a topic in different splits with overlapping ranges.

    Rows of one topic, split and range meet others as one, ``RANGE_IDS`` ids at a time; all pairs between two such lists are conflicts
    or none is, so pairs are only made to be returned. Lists meet by topic and the blocks of values that their ranges cover, each pair
    in the first block that both have. A block is as wide as the widest range, so a list is in two at most; blocks of many rows are
    dealt to several tasks. A range that ends before it starts overlaps those that hold all between its ends, which have its blocks too.
    """
    spark = rows.sparkSession
    low, high = F.least("_s", "_e"), F.greatest("_s", "_e")
    rows = rows.select(F.col(key).alias("_id"), F.col(topic).alias("_t"), F.col(split).alias("_p"), F.col(start).alias("_s"), F.col(end).alias("_e")).dropna()
    size = int(rows.agg(F.max(high - low).alias("w")).first()["w"] or 0) + 1
    alike = ["_t", "_p", "_s", "_e"]
    many = rows.groupBy(*alike).agg(F.count("*").alias("_n")).where(F.col("_n") > RANGE_IDS)
    part = F.coalesce(F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / RANGE_IDS)), F.lit(0))
    lists = rows.join(many, alike, "left").withColumn("_c", part).groupBy(*alike, "_c").agg(F.collect_list("_id").alias("_ids"))
    held = lists.withColumn("_f", F.floor(low / size)).withColumn("_b", F.explode(F.sequence("_f", F.floor(high / size))))
    tasks = F.ceil(F.sqrt(F.sum(F.size("_ids"))) / 64).cast("int")
    held = held.join(held.groupBy("_t", "_b").agg(tasks.alias("_k")), ["_t", "_b"])
    left = held.select("_t", "_b", F.pmod(F.xxhash64("_p", "_s", "_e", "_c"), F.col("_k").cast("long")).cast("int").alias("_r"), F.col("_p").alias("p1"), F.col("_s").alias("s1"), F.col("_e").alias("e1"), F.col("_f").alias("f1"), F.col("_ids").alias("x"))
    right = held.select("_t", "_b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_r"), F.col("_p").alias("p2"), F.col("_s").alias("s2"), F.col("_e").alias("e2"), F.col("_f").alias("f2"), F.col("_ids").alias("y"))
    # few bytes make many pairs, so the number of tasks is not left to the bytes
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    by = ["_t", "_b", "_r"]
    fits = (F.col("p1") < F.col("p2")) & (F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")) & (F.col("_b") == F.greatest("f1", "f2"))
    met = left.repartition(n, *by).join(right.repartition(n, *by), by).where(fits)
    pairs = met.select("_t", F.explode("x").alias("x"), "y").select("_t", "x", F.explode("y").alias("y")).where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("_t").alias(topic))


def best_range(rows: DataFrame, ranges: DataFrame, key: str, start: str, end: str, order: str, low: str, high: str, most: int = 10_000) -> DataFrame:
    """Each row with the range that overlaps it most, the first by ``order`` on ties.

    A short list of ranges is broadcast; a longer one meets the rows by the blocks of values that either covers, each pair
    in the first block that both have.
    """
    met_at = (F.col(start) <= F.col(high)) & (F.col(low) <= F.col(end))
    if ranges.limit(most + 1).count() <= most:
        met = rows.join(F.broadcast(ranges), met_at)
    else:
        width = ranges.agg(F.max(F.col(high) - F.col(low)).alias("w")).first()["w"]
        size = max(1, int(width or 0) + 1)
        blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
        one, two = rows.withColumn("_b", blocks(start, end)), ranges.withColumn("_c", blocks(low, high))
        met = one.join(two, (F.col("_b") == F.col("_c")) & met_at).where(F.col("_b") == F.greatest(F.floor(F.col(start) / size), F.floor(F.col(low) / size))).drop("_b", "_c")
    width = F.least(end, high) - F.greatest(start, low) + 1
    return met.groupBy(key).agg(F.max_by(F.col(order), F.struct(width, -F.col(order))).alias(order), F.max(width).alias("overlap"))


def first_seen(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Adds ``duplicate_of``: the first key with the same value, null for the first itself. Every row counts as seen."""
    first = F.min(key).over(Window.partitionBy(value))
    return rows.withColumn("duplicate_of", F.when(F.col(key) != first, first))
