"""Agreement, calibration and distribution metrics as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa(ref: Column, pred: Column, low: int = 0, high: int = 6, least: int = 2) -> Column:
    """Quadratic weighted kappa as an aggregate, from moments alone: no matrix.

    Values are clamped to the scale; pairs with a null or negative prediction are left out; null below
    ``least`` pairs or where one category holds every pair.
    """
    ok = ref.isNotNull() & (pred >= 0)
    r = F.when(ok, F.greatest(F.lit(low), F.least(F.lit(high), ref)).cast("long"))
    p = F.when(ok, F.greatest(F.lit(low), F.least(F.lit(high), pred)).cast("long"))
    n = F.count(p)
    apart = n * F.sum((r - p) * (r - p))
    chance = n * F.sum(r * r) + n * F.sum(p * p) - 2 * F.sum(r) * F.sum(p)
    return F.when((n >= least) & (chance != 0), 1 - apart.cast("double") / chance)


def rate(condition: Column) -> Column:
    """Share of rows where a condition holds; null counts as false."""
    return F.avg(F.coalesce(condition.cast("double"), F.lit(0.0)))


def agreement(pairs: Mapping[str, tuple[Column, Column]], total_ref: Column, total_pred: Column, penalty: int = 6) -> list[Column]:
    """Row and total agreement; an unparsable total costs ``penalty`` in the error."""
    n = len(pairs)
    exact = sum((F.coalesce((p == r).cast("int"), F.lit(0)) for r, p in pairs.values()), F.lit(0))
    near = sum((F.coalesce((F.abs(p - r) <= 1).cast("int"), F.lit(0)) for r, p in pairs.values()), F.lit(0))
    return [
        F.count("*").alias("n"),
        (F.sum(exact) / (F.count("*") * n)).alias("exact_rate"),
        (F.sum(near) / (F.count("*") * n)).alias("within_one_rate"),
        rate(total_pred == total_ref).alias("total_exact_rate"),
        rate(F.abs(total_pred - total_ref) <= 1).alias("total_within_one_rate"),
        F.avg(F.coalesce(F.abs(total_pred - total_ref), F.lit(penalty))).alias("total_mae"),
        F.when(F.count("*") >= 5, kappa(total_ref, total_pred)).alias("qwk"),
        *[rate(p == r).alias(f"exact_{name}") for name, (r, p) in pairs.items()],
    ]


def bias(ref: Column, pred: Column) -> list[Column]:
    """Mean signed error and over- and under-rating among rows with a prediction."""
    gap = pred - ref
    return [F.avg(gap).alias("mean_signed_error"), F.avg((gap > 0).cast("double")).alias("over_rate"), F.avg((gap < 0).cast("double")).alias("under_rate")]


def slices(df: DataFrame, dimensions: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """``(dimension, value, …)`` for each of several one-column groupings, in one shuffle."""
    sets = df.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions])
    out = sets.agg(F.grouping_id().alias("_id"), *aggregates)
    full = (1 << len(dimensions)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        own = F.col("_id") == (full ^ (1 << (len(dimensions) - 1 - i)))
        name, value = F.when(own, F.lit(d)).otherwise(name), F.when(own, F.col(d).cast("string")).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), *[c for c in out.columns if c not in dimensions and c != "_id"])


def distribution(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    return slices(df, dimensions, [F.count("*").alias("n")])


def dense(counts: DataFrame, column: str, values: Sequence[int]) -> DataFrame:
    """``counts(column, n)`` with a zero for each missing value of a fixed scale."""
    grid = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} int")
    return grid.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def confusion(df: DataFrame, ref: str, pred: str, scale: Sequence[int]) -> DataFrame:
    """Dense ``(ref, pred, n)``."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in scale for b in scale], "ref int, pred int")
    counts = df.groupBy(F.col(ref).cast("int").alias("ref"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["ref", "pred"], "left").select("ref", "pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def bootstrap(df: DataFrame, key: str, ref: str, pred: str, samples: int = 2000) -> DataFrame:
    """``(metric, low_95, high_95)`` from Poisson resamples whose weights are a hash of sample and row.

    Rows are first summed by (ref, pred) within each sample, so what is shuffled has a few dozen rows a
    sample and partition, whatever the size of the table. The weight's digest can be recomputed anywhere.
    """
    draws = df.select(key, F.col(ref).cast("long").alias("r"), F.col(pred).cast("long").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("b").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = sum(((u >= F.lit(c)).cast("int") for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)), F.lit(0))  # Poisson(1) quantiles
    cells = draws.withColumn("w", weight).where("w > 0").groupBy("b", "r", "p").agg(F.sum("w").alias("w"))
    n, total = F.sum("w"), lambda x: F.sum(F.col("w") * x)
    r, p = F.col("r"), F.col("p")
    chance = n * total(r * r) + n * total(p * p) - 2 * total(r) * total(p)
    each = cells.groupBy("b").agg((total(F.abs(r - p)) / n).alias("total_mae"), (total((F.abs(r - p) <= 1).cast("int")) / n).alias("within_one_rate"), F.when(chance != 0, 1 - n * total((r - p) * (r - p)) / chance).alias("qwk"))
    stacked = each.selectExpr("stack(3, 'qwk', qwk, 'total_mae', total_mae, 'within_one_rate', within_one_rate) AS (metric, v)").where("v IS NOT NULL")
    ranked = stacked.groupBy("metric").agg(F.array_sort(F.collect_list("v")).alias("v"))
    at = lambda q: F.get("v", F.floor(F.lit(q) * (F.size("v") - 1)).cast("int"))
    return ranked.select("metric", at(0.025).alias("low_95"), at(0.975).alias("high_95"))


def bootstrap_cells(df: DataFrame, ref: str, pred: str, samples: int = 2000, seed: int = 13) -> DataFrame:
    """``(metric, low_95, high_95)`` from resamples of all rows with replacement.

    The metrics depend on the counts of (ref, pred) only, and a resample of n rows has multinomial counts, so
    each draw is one multinomial of n over the cells: the law of drawing rows, at a cost free of n.
    """
    cells = df.where(F.col(ref).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(ref).cast("long").alias("r"), F.col(pred).cast("long").alias("p")).agg(F.count("*").alias("n")).orderBy("r", "p").collect()
    out = []
    if cells:
        r, p, n = (np.array([c[k] for c in cells], np.int64) for k in ("r", "p", "n"))
        for metric, found in bootstrap_values(r, p, np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=samples)).items():
            v = np.sort(found)
            if len(v):
                out.append((metric, float(v[int(0.025 * (len(v) - 1))]), float(v[int(0.975 * (len(v) - 1))])))
    return df.sparkSession.createDataFrame(out, "metric string, low_95 double, high_95 double")


def bootstrap_values(r: np.ndarray, p: np.ndarray, draws: np.ndarray) -> dict[str, np.ndarray]:
    """Metrics of each draw, a row of counts over the cells (r, p); a kappa of one category is left out."""
    w = draws.astype(np.float64)
    n = w.sum(axis=1)
    chance = n * (w @ (r * r)) + n * (w @ (p * p)) - 2 * (w @ r) * (w @ p)
    some = chance != 0
    return {
        "qwk": 1 - (n * (w @ ((r - p) ** 2)))[some] / chance[some],
        "total_mae": w @ np.abs(r - p) / n,
        "within_one_rate": w @ (np.abs(r - p) <= 1) / n,
    }


def upper_median(x: Column) -> Column:
    """The upper of the two middle values."""
    return F.element_at(F.array_sort(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))


def majority(values: Column) -> Column:
    """The most frequent value of an array; on ties the median, cut to an integer."""
    ordered = F.array_sort(values)
    count = lambda v: F.size(F.filter(values, lambda x: x == v))
    most = F.array_max(F.transform(values, count))
    winners = F.array_distinct(F.filter(ordered, lambda v: count(v) == most))
    n = F.size(ordered)
    low, high = F.get(ordered, ((n - 1) / 2).cast("int")), F.get(ordered, (n / 2).cast("int"))
    return F.when(F.size(winners) == 1, F.get(winners, F.lit(0))).otherwise(((low + high) / 2).cast("int"))
