"""All pairs of groups above the old cap, against numpy."""

import numpy as np
import pytest

from motley.operators import vectors
from motley.plans import registry


def test_pairs_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=(50, 3))
    df = spark.createDataFrame([("g", k, v.tolist()) for k, v in enumerate(x)] + [("one", 0, [0.0] * 3)], "g string, id long, v array<double>")
    rows = vectors.pairs(df, block=7).collect()
    assert len(rows) == 50 * 49 // 2
    assert {(r["a"], r["b"]): pytest.approx(r["d"]) for r in rows} == {(a, b): np.linalg.norm(x[a] - x[b]) for a in range(50) for b in range(a + 1, 50)}


def test_fairness_of_more_embeddings_than_the_cap(spark, tmp_path):
    n = 5060
    x, label = np.random.default_rng(5).normal(size=(n, 2)), np.arange(n) % 3
    spark.createDataFrame([(k, int(label[k]), v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    same, upper = label[:, None] == label[None], np.triu(np.ones((n, n), bool), 1)
    got = registry.QUERIES["individual_fairness"](spark, str(tmp_path)).first()["ratio"]
    assert got == pytest.approx(d[same & upper].mean() / d[~same & upper].mean(), abs=2e-5)
