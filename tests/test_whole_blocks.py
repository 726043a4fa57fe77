"""Measures over all pairs come from blocks that meet once; pairs are no rows."""

import itertools

import numpy as np
import pytest

from motley.operators import blocks as bl
from motley.operators import cluster, evaluate


def frame(spark, x, g=lambda k: "a"):
    return spark.createDataFrame([(g(k), k, v.tolist()) for k, v in enumerate(x)], "g string, id long, v array<double>")


def test_two_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 3)
    met = []
    x = np.random.default_rng(1).normal(size=(60, 4))
    monkeypatch.setattr(bl, "blocked", lambda *a, f=bl.blocked, **b: met.append(b.get("once")) or f(*a, **b))
    for name in bl.DISTANCES:
        r = bl.distance_summary(frame(spark, x), name).first()
        d = [float(bl.DISTANCES[name](x[[a]], x[[b]])[0, 0]) for a, b in itertools.combinations(range(60), 2)]
        assert r["n_pairs"] == len(d) and r["median"] == pytest.approx(np.median(d), abs=1e-8) and r["total"] == pytest.approx(sum(d)) and r["spread"] == pytest.approx(min(d))
    assert all(met)


def test_distances_of_near_rows_are_exact():
    x = np.random.default_rng(2).normal(size=(40, 8)) * 1000
    y = np.concatenate([x[:20] + 1e-6, x[20:]])
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    assert np.allclose(bl.DISTANCES["euclidean"](x, y), d, rtol=1e-9, atol=0)
    assert np.allclose(bl.DISTANCES["manhattan"](x, y), np.abs(x[:, None] - y[None]).sum(2)) and np.allclose(bl.DISTANCES["chebyshev"](x, y), np.abs(x[:, None] - y[None]).max(2))


def test_alike_pairs_are_the_only_rows(spark, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 4)
    x = np.random.default_rng(3).normal(size=(50, 3))
    x[7] = 0
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    df = bl.alike_pairs(frame(spark, x), 0.3)
    assert {(r["a"], r["b"]) for r in df.collect()} == {(a, b) for a, b in itertools.combinations(range(50), 2) if u[a] @ u[b] >= 0.3}


def test_dbscan_by_hand(spark, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 5)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 2)), rng.normal(size=(40, 2)) + 6, [[3.0, 3.0], [50.0, 50.0]]])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.7
    core = near.sum(1) >= 3
    label = np.arange(len(x))
    for _ in x:
        label = np.array([min(label[j] for j in range(len(x)) if near[i, j] and core[j]) if core[i] else label[i] for i in range(len(x))])
    want = {i: int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(near[i] & core)), default=None) for i in range(len(x))}
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(frame(spark, x), 0.7, 3).collect()}
    assert got == want


def test_novelty_of_items_makes_no_pair_a_row(spark):
    x = np.random.default_rng(5).normal(size=(30, 3))
    rows = frame(spark, x).withColumnRenamed("g", "u")
    df = evaluate.novelty_of_items(rows.where("id % 3 = 1"), rows.where("id % 3 <> 1").select("u", "v"))
    past = x[[k for k in range(30) if k % 3 != 1]]
    for r in df.collect():
        assert r["novelty"] == pytest.approx(np.linalg.norm(past - x[r["id"]], axis=1).min()) and r["surprise"] == pytest.approx(np.linalg.norm(past.mean(0) - x[r["id"]]))
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
