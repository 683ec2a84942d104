"""Bootstrap intervals of 2000 resamples against plain loops."""

import inspect
import random

import numpy as np

from corpusloom.functions import metrics as M
from corpusloom.plans import registry
from corpusloom.plans.cases import cases


def plain(rows):
    n, refs, preds = len(rows), [a for a, _ in rows], [b for _, b in rows]
    observed = sum((a - b) ** 2 for a, b in rows) / n
    chance = sum((a - b) ** 2 for a in refs for b in preds) / n**2
    return {
        "qwk": 1 - observed / chance if chance else None,
        "total_mae": sum(abs(a - b) for a, b in rows) / n,
        "within_one_rate": sum(abs(a - b) <= 1 for a, b in rows) / n,
    }


def interval(values):
    v = sorted(x for x in values if x is not None)
    return v[int(0.025 * (len(v) - 1))], v[int(0.975 * (len(v) - 1))]


def shown(df):
    return {r["metric"]: (r["low_95"], r["high_95"]) for r in df.collect()}


def test_defaults_are_the_references():
    for f in (M.bootstrap, M.bootstrap_cells):
        assert inspect.signature(f).parameters["samples"].default == 2000


def test_cells_equal_rows(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(30)]
    got = shown(M.bootstrap_cells(spark.createDataFrame([*rows, (3, None)], "a int, b int"), "a", "b"))
    cells = sorted(set(rows))
    counts = np.array([rows.count(c) for c in cells])
    draws = np.random.default_rng(13).multinomial(30, counts / 30, size=2000)
    each = [plain([c for c, k in zip(cells, d, strict=True) for _ in range(k)]) for d in draws]
    for metric, (low, high) in got.items():
        want = interval([e[metric] for e in each])
        assert abs(low - want[0]) < 1e-9 and abs(high - want[1]) < 1e-9
    loop = [plain([rows[rng.randrange(30)] for _ in rows]) for _ in range(2000)]  # the reference's way
    for metric, (low, high) in got.items():
        want = interval([e[metric] for e in loop])
        assert abs(low - want[0]) < 0.08 and abs(high - want[1]) < 0.08


def test_one_category_and_no_rows(spark):
    got = shown(M.bootstrap_cells(spark.createDataFrame([(2, 2)] * 3, "a int, b int"), "a", "b"))
    assert got == {"total_mae": (0.0, 0.0), "within_one_rate": (1.0, 1.0)}
    assert M.bootstrap_cells(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_query_runs_2000(spark, data):
    got = shown(registry.queries()["bootstrap_full"](spark, data))
    assert got == shown(M.bootstrap_cells(cases(spark, data), "total", "p_total", 2000)) and len(got) == 3
