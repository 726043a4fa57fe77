"""Pareto fronts of all experiments and novelty with all embeddings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.plans import registry
from motley.plans.results import runs


def test_fronts_of_all_experiments(spark, sf_dir):
    every = {r["experiment_id"] for r in runs(spark, sf_dir).where(F.col("elapsed").isNotNull()).select("experiment_id").distinct().collect()}
    rows = registry.QUERIES["pareto_front"](spark, sf_dir).collect()
    assert len(every) > 1 and {r["experiment_id"] for r in rows} == every


def test_every_embedding_counts(spark, tmp_path):
    x = np.random.default_rng(4).random((60, 3))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r for r in registry.QUERIES["item_novelty"](spark, str(tmp_path)).collect()}
    assert set(got) == {k for k in range(60) if k % 3 == 1}
    for k, r in got.items():
        past = x[[j for j in range(60) if j % 3 != 1 and j % 10 == k % 10]]
        assert r["novelty"] == pytest.approx(np.linalg.norm(past - x[k], axis=1).min(), abs=1e-5)
        assert r["surprise"] == pytest.approx(np.linalg.norm(past.mean(0) - x[k]), abs=1e-5)
