"""Volumes, selections and search plans on small cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.operators import stats


def test_volume(spark):
    r = np.random.default_rng(4)
    p = np.round(r.random((9, 3)) * 5) / 5
    df = spark.createDataFrame([("a", *map(float, q)) for q in p] + [("a", 2.0, 0.0, 0.0), ("b", 0.5, None, 0.5)], "g string, x double, y double, z double")
    cells = [(np.array(c) + 0.5) / 5 for c in itertools.product(range(5), repeat=3)]
    want = sum(any((q <= c).all() for q in p) for c in cells) / 125
    assert [(x["g"], x["hypervolume"]) for x in stats.hypervolume_3d(df, ["g"], ["x", "y", "z"], (1.0, 1.0, 1.0)).collect()] == [("a", pytest.approx(want))]
    assert stats.hypervolume_3d(df.where("g = 'none'"), ["g"], ["x", "y", "z"], (1.0, 1.0, 1.0)).collect() == []


def test_selection(spark):
    df = spark.createDataFrame([("a", True)] * 3 + [("a", False)] + [("b", True)] + [("b", False)] * 3, "g string, s boolean")
    r = stats.selection_fairness(df, F.col("s")).first()
    assert tuple(r) == pytest.approx((0.25, 0.5, 0.25, 0.75, 0.5))
    assert tuple(stats.selection_fairness(df, F.lit(False)).first()) == (0,) * 5


def test_intersections(spark):
    df = spark.createDataFrame([("x", "u")] * 3 + [("y", "v"), (None, "u")], "a string, b string")
    assert {(r["a"], r["b"]): (r["n"], r["score"]) for r in stats.intersections(df, "a", "b").collect()} == {("x", "u"): (3, 1.0), ("x", "v"): (0, 0.0), ("y", "u"): (0, 0.0), ("y", "v"): (1, 0.5)}
    assert stats.intersections(df.where("a = 'none'"), "a", "b").collect() == []


def test_hypercube(spark):
    rows = stats.latin_hypercube(spark, 17, ["p", "q"]).collect()
    assert len(rows) == 17 and all(sorted(int(r[c] * 17) for r in rows) == list(range(17)) for c in ("p", "q"))


def test_halving(spark):
    df = spark.createDataFrame([(i, r, float(i // 3 if r == 0 else -i)) for i in range(20) for r in (0, 1, 2) if r < 2 or i < 13], "id long, rung long, score double")
    got = {}
    for r in stats.successive_halving(df).collect():
        got.setdefault(r["rung"], []).append((r["rank"], r["id"], r["survives"]))
    first = sorted(range(20), key=lambda i: (-(i // 3), i))
    assert [i for _, i, _ in sorted(got[0])] == first and [s for *_, s in sorted(got[0])] == [True] * 10 + [False] * 10
    second = sorted(first[:10])
    assert [i for _, i, _ in sorted(got[1])] == second
    assert [i for _, i, _ in sorted(got[2])] == [i for i in second[:5] if i < 13]
    assert stats.successive_halving(df.where("id < 0")).collect() == []
