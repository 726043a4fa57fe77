"""Fronts by sweep and by comparison, dominance ranks and references, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.operators import inference as nf
from motley.operators import stats as st
from motley.operators.results import pareto_front


def front(points):
    return {i for i, p in points.items() if not any(all(a >= b for a, b in zip(q, p)) and any(a > b for a, b in zip(q, p)) for q in points.values())}


@pytest.fixture
def clouds():
    rng = np.random.default_rng(4)
    return {g: {100 * k + i: tuple(float(x) for x in rng.integers(0, 12, 3)) for i in range(90)} for k, g in enumerate("ab")}


@pytest.mark.parametrize("objectives", [["x", "y"], ["x", "y", "z"]])
def test_front(spark, clouds, objectives):
    df = spark.createDataFrame([(g, i, *p) for g, c in clouds.items() for i, p in c.items()] + [("a", 999, None, 1.0, 1.0)], "g string, id long, x double, y double, z double")
    got = {r["id"] for r in pareto_front(df, objectives, ["g"]).collect()}
    want = {i for c in clouds.values() for i in front({i: p[: len(objectives)] for i, p in c.items()})}
    assert got == want | {999}


def test_ranks_peel_fronts(spark, clouds):
    df = spark.createDataFrame([(g, i, *p) for g, c in clouds.items() for i, p in c.items()], "g string, id long, x double, y double, z double")
    got = {r["id"]: r["rank"] for r in nf.dominance_ranks(df, ["g"], ["x", "y"]).collect()}
    for c in clouds.values():
        left, rank = {i: p[:2] for i, p in c.items()}, 0
        while left:
            best = front(left)
            assert {i for i in left if got[i] == rank} == best
            left, rank = {i: p for i, p in left.items() if i not in best}, rank + 1


def test_ranks_of_long_chains_copies_and_null_groups(spark):
    # a chain of 3000 ranks took a pass for each; ranges of 500 pairs hand on what they have found
    chain = [("a", k, float(k), float(k)) for k in range(3000)] + [("a", 10_000 + k, 7.0, 7.0) for k in range(5)]
    odd = [(None, k, float(k % 3), -0.0 if k % 2 else 0.0) for k in range(20_000, 20_012)] + [("a", 30_000, None, 1.0)]
    df = spark.createDataFrame(chain + odd, "g string, id long, x double, y double")
    got = {r["id"]: r["rank"] for r in nf.dominance_ranks(df, ["g"], ["x", "y"], size=500).collect()}
    want = {i: 2999 - int(x) for _, i, x, _ in chain} | {i: 2 - int(x) for g, i, x, _ in odd if g is None} | {30_000: 0}
    assert got == want


def test_ranks_by_ranges_are_those_of_passes(spark, clouds):
    rows = [(g, i, *p) for g, c in clouds.items() for i, p in c.items()]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, z double")
    ranks = lambda size: {(r["id"], r["rank"]) for r in nf.dominance_ranks(df, ["g"], ["x", "z"], size).collect()}
    assert ranks(7) == ranks(10**6)


@pytest.mark.parametrize("columns", [["x"], ["x", "y"], ["x", "y", "z"]])
def test_nearest_points_by_tiles(spark, columns):
    rng = np.random.default_rng(8)
    far = [("a", k, *(1e6 + float(v) for v in rng.normal(size=3))) for k in range(1000, 1040)]
    rows = [(g, k, *(float(v) for v in rng.integers(0, 9, 3) ** 3)) for g in "ab" for k in range(300)] + far + [("a", 1000, 0.5, 0.5, 0.5), ("c", 1, 1.0, 1.0, 1.0), ("d", 1, 1.0, 2.0, 3.0), ("d", 2, None, 1.0, 1.0), ("e", 7, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, z double")
    at = lambda r: [r[2 + "xyz".index(c)] for c in columns]
    for left, right in ((rows, rows), ([r for r in rows if r[1] % 2], [r for r in rows if r[1] % 2 == 0])):
        want = {}
        for r in left:
            gaps = [None if None in at(r) + at(o) else sum((p - q) ** 2 for p, q in zip(at(r), at(o))) ** 0.5 for o in right if o[0] == r[0] and o[1] != r[1]]
            if gaps:
                seen = [x for x in [*gaps, want.get(r[:2])] if x is not None]
                want[r[:2]] = min(seen) if seen else None
        a, b = (df.where("id % 2 = 1"), df.where("id % 2 = 0")) if left is not rows else (df, df)
        found = st.nearest_distances(a, b, ["g"], columns, size=16)
        got = {(r["g"], r["id"]): r["distance"] for r in found.collect()}
        assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, rel=1e-12)


def test_few_tiles_of_points_meet(spark, monkeypatch):
    df = spark.range(40_000).select(F.lit("a").alias("g"), "id", (F.col("id") / 7).alias("x"), (F.hash("id") / 1e9).alias("y"))
    met, near = [], st._tile_distances
    monkeypatch.setattr(st, "_tile_distances", lambda pairs, d: met.append(pairs.count()) or near(pairs, d))
    d = st.nearest_distances(df.where("id % 2 = 1"), df.where("id % 2 = 0"), ["g"], ["x", "y"])
    assert d.count() == 20_000 and sum(met) < 20_000  # their pairs are 400,000,000


def test_knee_and_spread(spark):
    front = spark.createDataFrame([("g", k, x, y) for k, (x, y) in enumerate([(0.0, 1.0), (0.1, 0.2), (1.0, 0.0)])], "g string, id long, x double, y double")
    assert nf.knee_point(front, ["g"], "x", "y").first()["id"] == 1
    even = spark.createDataFrame([("g", k, float(k), 0.0) for k in range(5)], "g string, id long, x double, y double")
    assert nf.front_spread(even, ["g"], "x", "y").first()["spread"] == pytest.approx(2 / 6)
