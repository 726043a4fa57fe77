"""Kernel values of two blocks are summed once for both orders of their pairs."""

import numpy as np
import pytest

from motley.operators import blocks as bl


def test_kernels_of_blocks_that_meet_once(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(70, 5)) / 2
    x[9] = x[4]
    met = []
    monkeypatch.setattr(bl, "blocked", lambda l, r, k, s, block=None, **b: met.append(b.get("once")) or blocked(l, r, k, s, 9, **{**b, "most": None}))
    monkeypatch.setattr(bl, "SUMMED", 4, raising=False)
    df = spark.createDataFrame([("a", k, v.tolist()) for k, v in enumerate(x)], "g string, id long, v array<double>")
    got = {(r["kernel"], r["bandwidth"]): r["epd"] for r in bl.kernel_distances(df).collect()}
    sq, l1, dots, off = ((x[:, None] - x[None]) ** 2).sum(2), np.abs(x[:, None] - x[None]).sum(2), x @ x.T, ~np.eye(70, dtype=bool)
    u = np.linalg.norm(x, axis=1)
    for h in (0.5, 1.0, 2.0):
        want = {"rbf": np.exp(-sq / (2 * h * h)), "imq": 1 / np.sqrt(1 + sq / (h * h)), "laplacian": np.exp(-l1 / h), "cosine": dots / np.outer(u, u), "polynomial": (dots + 1) ** 2}
        for name, value in want.items():
            assert got[name, h] == pytest.approx(1 - value[off].mean(), abs=1e-9)
    assert met == [True]


blocked = bl.blocked
