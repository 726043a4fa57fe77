"""Samples of determinantal processes: frequencies against exact chances by enumeration."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.operators import dpp

DRAWS = 3000


def data(n=6, d=3, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d))


def frame(spark, groups):
    return spark.createDataFrame([(g, i, [float(a) for a in v]) for g, x in groups.items() for i, v in enumerate(x)], "g string, id long, v array<double>").repartition(4)


def chances(x, sizes):
    kernel = x @ x.T
    weight = {s: max(np.linalg.det(kernel[np.ix_(s, s)]), 0) if s else 1.0 for k in sizes for s in combinations(range(len(x)), k)}
    total = sum(weight.values())
    return {s: w / total for s, w in weight.items()}


def drawn(df, g):
    sets = {}
    for r in df.where(F.col("g") == g).collect():
        sets.setdefault(r["draw"], []).append(r["id"])
    return Counter(tuple(sorted(v)) for v in sets.values())


def close(found, want, draws):
    """Chi square of the frequencies, cells of small expectation together, within four deviations."""
    rest_want, rest_found, stat, cells = 0.0, 0, 0.0, -1
    for s, p in want.items():
        if p * draws < 8:
            rest_want, rest_found = rest_want + p * draws, rest_found + found[s]
        else:
            stat, cells = stat + (found[s] - p * draws) ** 2 / (p * draws), cells + 1
    if rest_want > 8:
        stat, cells = stat + (rest_found - rest_want) ** 2 / rest_want, cells + 1
    return stat < cells + 4 * np.sqrt(2 * cells)


def test_samples_of_k(spark):
    x, y = data(), data(5, 3, 1)
    got = dpp.sample(frame(spark, {"x": x, "y": y}), 2, DRAWS)
    for g, m in (("x", x), ("y", y)):
        found = drawn(got, g)
        assert sum(found.values()) == DRAWS and all(len(s) == 2 for s in found)
        assert close(found, chances(m, [2]), DRAWS)


def test_samples_of_any_size_and_marginals(spark):
    x = data(5, 3, 2) * 0.8
    df = frame(spark, {"x": x})
    found = drawn(dpp.sample(df, None, DRAWS), "x")
    found[()] = DRAWS - sum(found.values())
    want = chances(x, range(6))
    assert close(found, want, DRAWS)
    exact = [sum(p for s, p in want.items() if i in s) for i in range(5)]
    got = {r["id"]: r["chance"] for r in dpp.marginals(df).collect()}
    assert np.allclose([got[i] for i in range(5)], exact)
    chosen = spark.createDataFrame([("x", 1), ("x", 3)], "g string, id long")
    assert dpp.log_probability(df, chosen).first()["log_probability"] == pytest.approx(np.log(want[1, 3]))
    many = spark.createDataFrame([("x", i) for i in range(4)], "g string, id long")
    assert dpp.log_probability(df, many).first()["log_probability"] is None


def test_samples_given_rows(spark):
    x = data(6, 4, 3)
    rest = dpp.given(frame(spark, {"x": x, "free": x}), spark.createDataFrame([("x", 2)], "g string, id long"))
    got = dpp.sample(rest, 2, DRAWS)
    all_ = chances(x, [3])
    total = sum(p for s, p in all_.items() if 2 in s)
    want = {tuple(i for i in s if i != 2): p / total for s, p in all_.items() if 2 in s}
    assert close(drawn(got, "x"), want, DRAWS)
    assert close(drawn(got, "free"), chances(x, [2]), DRAWS)


def test_more_than_the_rank_and_repeats(spark):
    df = frame(spark, {"x": np.concatenate([data(4, 2), data(4, 2)]), "zero": np.zeros((3, 2))})
    found = drawn(dpp.sample(df, 5, 20), "x")
    assert all(len(s) == 2 for s in found) and drawn(dpp.sample(df, 5, 20), "zero") == Counter()
    assert drawn(dpp.sample(df, 5, 20), "x") == found


def test_kernels(spark):
    x = data(6, 3, 4)
    df = frame(spark, {"x": x})
    f = {r["id"]: np.array(r["v"]) for r in dpp.fourier_features(df, 600, 1.5).collect()}
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 1.5**2))
    assert np.abs(np.array([[f[i] @ f[j] for j in range(6)] for i in range(6)]) - want).max() < 0.15
    w = {r["id"]: np.array(r["v"]) for r in dpp.weighted(df, F.col("id") + 1).collect()}
    assert np.allclose(w[3], x[3] * 4)
