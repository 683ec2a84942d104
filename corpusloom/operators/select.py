"""Selection: quotas, apportionment, coverage, samples, splits, shards and exact subsets."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_key(key: Column, seed: str, purpose: str) -> Column:
    """sha256 of seed, purpose and key: an order that any engine can recompute."""
    return F.sha2(F.concat(F.lit(f"{seed}:{purpose}:"), key.cast("string")), 256)


def round_robin(df: DataFrame, bucket: str, order: Sequence[str | Column], quota: int) -> DataFrame:
    """Rows taken from buckets in turn until the quota: by place within the bucket, then bucket."""
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= quota).orderBy("_place", bucket).limit(quota).drop("_place")


def every_other(df: DataFrame, eligible: Column, group: str, order: str) -> DataFrame:
    """Adds ``picked``: every other eligible row of a group."""
    place = F.sum(F.when(eligible, 1).otherwise(0)).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("picked", eligible & (place % 2 == 1))


def priority_sample(df: DataFrame, priority: Column, key: str, share: float) -> DataFrame:
    """The ceil(share · n), at least one, rows of highest priority, by key on ties."""
    n = df.count()
    return df.orderBy(priority.desc(), key).limit(max(1, math.ceil(share * n)) if n else 0)


def apportion(n: int, ratios: Mapping[str, float], floor: int = 0) -> dict[str, int]:
    """Largest remainders: whole shares, then one more to the largest remainders, the earlier name first on ties."""
    exact = {k: n * r for k, r in ratios.items()}
    counts = {k: max(floor, math.floor(x + 1e-9)) for k, x in exact.items()}
    rank = sorted(ratios, key=lambda k: (-(exact[k] - math.floor(exact[k] + 1e-9)), list(ratios).index(k)))
    while (left := n - sum(counts.values())) != 0:
        for k in rank if left > 0 else reversed(rank):
            if left == 0:
                break
            if left > 0 or counts[k] > floor:
                counts[k] += 1 if left > 0 else -1
                left += -1 if left > 0 else 1
    return counts


def apportion_groups(df: DataFrame, group: str, weight: Column, total: int) -> DataFrame:
    """``(group, quota)``: ``total`` dealt out by summed weights with largest remainders, ties by group name."""
    sums = df.groupBy(group).agg(F.sum(weight).alias("w"))
    everything = Window.partitionBy(F.lit(0))
    exact = sums.withColumn("exact", F.col("w") * total / F.sum("w").over(everything)).withColumn("base", F.floor("exact"))
    left = exact.withColumn("left", F.lit(total) - F.sum("base").over(everything)).withColumn("r", F.row_number().over(everything.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), group)))
    return left.select(group, (F.col("base") + (F.col("r") <= F.col("left")).cast("long")).alias("quota"))


def coverage_greedy(rows: list[tuple], count: int, seed: str, purpose: str, taken: Sequence[tuple] = ()) -> list[tuple]:
    """``count`` of ``(key, a, b)``, each time the one whose a, b and pair were taken least, then by stable hash.

    Sequential by definition, so it runs on the driver over group representatives, not rows. Of one pair the least hash
    goes first, so a step looks at the pairs only.
    """
    import hashlib
    from collections import Counter

    by_a, by_b, by_pair = Counter(x[1] for x in taken), Counter(x[2] for x in taken), Counter(x[1:3] for x in taken)
    queues: dict[tuple, list[tuple]] = {}
    for x in rows:
        queues.setdefault(x[1:3], []).append((hashlib.sha256(f"{seed}:{purpose}:{x[0]}".encode()).hexdigest(), x))
    for queue in queues.values():
        queue.sort(key=lambda q: q[0], reverse=True)
    chosen: list[tuple] = []
    while queues and len(chosen) < count:
        pair = min(queues, key=lambda p: (by_a[p[0]], by_b[p[1]], by_pair[p], queues[p][-1][0]))
        chosen.append(queues[pair].pop()[1])
        if not queues[pair]:
            del queues[pair]
        by_a[pair[0]] += 1
        by_b[pair[1]] += 1
        by_pair[pair] += 1
    return chosen


#: Families whose splits are broadcast at most; more are joined by a shuffle.
MAX_FAMILIES = 1_000_000


def family_splits(df: DataFrame, family: str, a: str, b: str, ratios: Mapping[str, float], seed: str) -> DataFrame:
    """Adds ``split``: whole families to exact split sizes, coverage-aware. One row a family goes to the driver; rows don't."""
    heads = df.groupBy(family).agg(F.min_by(F.struct(a, b), F.col(a)).alias("r"))
    rows = sorted((r[family], r["r"][a], r["r"][b]) for r in heads.toLocalIterator())
    sizes = apportion(len(rows), ratios)
    first, *others = list(ratios)
    where: dict = {}
    for name in reversed(others):
        for x in coverage_greedy([x for x in rows if x[0] not in where], sizes[name], seed, name):
            where[x[0]] = name
    named = df.sparkSession.createDataFrame([(x[0], where.get(x[0], first)) for x in rows], heads.select(family).schema.add("split", "string"))
    return df.join(F.broadcast(named) if len(rows) <= MAX_FAMILIES else named, family)


def exact_subset(groups: Sequence[tuple[str, int, int]], want_g: int, want_b: int) -> list[str] | None:
    """Names of ``(name, g, b)`` whose sums are exactly the wanted ones: dynamic programming in name order, the first path kept."""
    states: dict[tuple[int, int], tuple[str, ...]] = {(0, 0): ()}
    for name, g, b in sorted(groups):
        for (x, y), path in list(states.items()):
            new = (x + g, y + b)
            if new[0] <= want_g and new[1] <= want_b and new not in states:
                states[new] = (*path, name)
    found = states.get((want_g, want_b))
    return None if found is None else list(found)


def split_violations(rows: DataFrame, group: Sequence[str], sample: str, expected: Mapping[int, int] | None = None) -> DataFrame:
    """``(id, reason)`` of what forbids a split of ``rows(id, set_number, prompt, ...)`` by released set.

    Ids are unique, sets are 1 or 2, a sample occurs once in a group, no prompt is on both sides, and the sides have their
    ``expected`` sizes (these reasons have the set as id). No rows: the split holds.
    """
    text = F.col("id").cast("string")
    n = lambda keys, name: rows.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > 1)
    twice = n(["id"], "_n").select(text.alias("id"), F.lit("duplicate_id").alias("reason"))
    odd = rows.where(~F.coalesce(F.col("set_number").isin(1, 2), F.lit(False))).select(text.alias("id"), F.lit("bad_set_number").alias("reason"))
    keyed = rows.withColumn("_s", F.upper(sample))
    again = keyed.groupBy(*group, "set_number", "_s").agg(F.count("*").alias("_n"), F.min("id").alias("id")).where("_n > 1").select(text.alias("id"), F.lit("duplicate_sample").alias("reason"))
    both = rows.groupBy("prompt").agg(F.min(F.when(F.col("set_number") == 1, F.col("id"))).alias("a"), F.min(F.when(F.col("set_number") == 2, F.col("id"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("string").alias("id"), F.lit("prompt_on_both_sides").alias("reason"))
    found = twice.unionByName(odd).unionByName(again).unionByName(both)
    if expected is not None:
        sizes = rows.agg(*[F.count_if(F.col("set_number") == s).alias(f"n_{s}") for s in expected])
        wrong = F.filter(F.array(*[F.when(F.col(f"n_{s}") != k, F.lit(str(s))) for s, k in expected.items()]), lambda x: x.isNotNull())
        found = found.unionByName(sizes.select(F.explode(wrong).alias("id"), F.lit("wrong_count").alias("reason")))
    return found


def split_by_set(rows: DataFrame, group: Sequence[str], sample: str, expected: Mapping[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(set 1, set 2); an error where ``split_violations`` has any."""
    bad = split_violations(rows, group, sample, expected).orderBy("reason", "id").first()
    if bad is not None:
        raise ValueError(f"{bad['id']}: {bad['reason']}")
    return rows.where("set_number = 1"), rows.where("set_number = 2")


def matched_lengths(df: DataFrame, key: str, bucket: str, length: str, target: DataFrame, quota: int) -> DataFrame:
    """For each bucket ``quota`` rows whose length ranks follow a target's: row i takes the target's quantile i.

    The target's quantiles are a fixed-size array a bucket; each row goes to its nearest quantile and the
    nearest row of each is kept, then gaps are filled by nearness.
    """
    points = [(i + 0.5) / quota for i in range(quota)]
    q = target.groupBy(bucket).agg(F.percentile(length, points).alias("_q"))
    near = F.array_min(F.transform("_q", lambda v: F.abs(v - F.col(length))))
    at = df.join(F.broadcast(q), bucket).withColumn("_d", near).withColumn("_i", F.array_position(F.transform("_q", lambda v: F.abs(v - F.col(length))), near))
    first = F.row_number().over(Window.partitionBy(bucket, "_i").orderBy("_d", key))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(F.when(F.col("_f") == 1, 0).otherwise(1), "_d", key))
    return at.withColumn("_f", first).withColumn("_r", rank).where(F.col("_r") <= quota).select(*df.columns)


def complete_pairs(df: DataFrame, pair: str, side: str, kind: str, most: int) -> DataFrame:
    """Pairs with both sides, the first ``most`` by name of each kind."""
    whole = df.groupBy(kind, pair).agg(F.count_distinct(side).alias("n")).where("n = 2")
    return whole.withColumn("r", F.row_number().over(Window.partitionBy(kind).orderBy(pair))).where(F.col("r") <= most).select(kind, pair)


def hash_ranks(df: DataFrame, key: str, seed: str, purpose: str) -> DataFrame:
    """Adds ``rank`` (from 0) in stable hash order and ``n``, the number of rows, without a global sort.

    The first three digits of the hash deal rows into 4,096 buckets that are in order already; a row's
    rank is its place in its bucket after the sizes of the buckets before it.
    """
    keyed = df.withColumn("_k", stable_key(F.col(key), seed, purpose)).withColumn("_b", F.substring("_k", 1, 3))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_c"))
    everything = Window.partitionBy(F.lit(0))
    before = counts.select("_b", (F.sum("_c").over(everything.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(everything).alias("n"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_k", key)) - 1
    return keyed.withColumn("_p", place).join(F.broadcast(before), "_b").withColumn("rank", F.col("_before") + F.col("_p")).drop("_k", "_b", "_p", "_before")


def hash_shards(df: DataFrame, key: str, shards: int, seed: str) -> DataFrame:
    """Adds ``shard`` from 1: parts of equal size, the first ones one larger, in stable hash order."""
    size, more = F.floor(F.col("n") / shards), F.col("n") % shards
    large = more * (size + 1)
    shard = F.when(F.col("rank") < large, F.floor(F.col("rank") / (size + 1))).otherwise(more + F.floor((F.col("rank") - large) / F.greatest(size, F.lit(1)))) + 1
    return hash_ranks(df, key, seed, "shard").withColumn("shard", shard.cast("int")).drop("rank", "n")


def with_top_up(first: DataFrame, filler: DataFrame, group: str, order: str, quota: int) -> DataFrame:
    """At most ``quota`` rows a group from the first table, topped up from the second; ``tier`` says which."""
    both = first.withColumn("tier", F.lit(0)).unionByName(filler.withColumn("tier", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("tier", order))).where(F.col("_r") <= quota).drop("_r")


def tolerant_best(df: DataFrame, metric: str, tolerance: float, prefer: Column, order: str) -> DataFrame:
    """Adds ``chosen``: within tolerance of the best, the preferred first, then by order."""
    best = F.max(metric).over(Window.partitionBy(F.lit(0)))
    close = df.withColumn("_c", F.col(metric) >= best - tolerance)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_c"), F.desc(prefer), F.desc_nulls_last(metric), order))
    return close.withColumn("chosen", F.col("_c") & (rank == 1)).drop("_c")
