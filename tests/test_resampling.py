"""Bootstrap intervals against a plain computation with the same weights."""

import numpy as np
import pytest

from motley.operators import resampling as rs


def test_intervals_equal_a_plain_computation(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.exponential(size=120), "b": rng.normal(size=40), "c": np.array([2.0, 2.0, 2.0]), "one": np.array([5.0])}
    rows = [(g, i, float(v)) for g, x in data.items() for i, v in enumerate(x)] + [("a", 999, None)]
    got = {r["g"]: r for r in rs.bootstrap_mean(spark.createDataFrame(rows, "g string, id long, x double").repartition(3), 400).collect()}
    for g, x in data.items():
        w = rs.weights(np.arange(len(x)), 400, rs.SEED)
        means = (x @ w)[w.sum(0) > 0] / w.sum(0)[w.sum(0) > 0]
        out = np.array([np.delete(x, i).mean() for i in range(len(x))]) if len(x) > 1 else np.zeros(1)
        d = out.mean() - out
        a = (d**3).sum() / (6 * (d**2).sum() ** 1.5) if (d**2).sum() > 1e-20 else 0.0
        want = rs.intervals(means, x.mean(), a, 0.95)
        assert got[g]["n"] == len(x) and got[g]["mean"] == pytest.approx(x.mean())
        assert all(got[g][b] == pytest.approx(want[b], abs=1e-9) for b in rs.BOUNDS), g


def test_weights_are_poisson_and_intervals_cover():
    w = rs.weights(np.arange(2000), 200, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1
    rng, hit = np.random.default_rng(5), 0
    for trial in range(200):
        x = rng.exponential(size=60)
        w = rs.weights(np.arange(60), 400, trial)
        d = x - x.mean()
        b = rs.intervals((x @ w) / w.sum(0), x.mean(), (d**3).sum() / (6 * (d**2).sum() ** 1.5), 0.9)
        hit += b["bca_low"] <= 1.0 <= b["bca_high"]
    assert 0.8 <= hit / 200 <= 0.97


def test_empty(spark):
    assert rs.bootstrap_mean(spark.createDataFrame([], "g string, id long, x double")).count() == 0
