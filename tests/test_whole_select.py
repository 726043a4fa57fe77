"""Selection over groups above the bound, against the kernels over all rows."""

import numpy as np
import pytest

from motley.operators import select


@pytest.mark.parametrize("method", ["mmr", "fair"])
def test_large_groups_are_chosen_from_whole(spark, method):
    rng = np.random.default_rng(6)
    sizes, rows, want = {"big": 300, "small": 20}, [], {}
    for g, n in sizes.items():
        x, relevance, label = rng.normal(size=(n, 3)) * rng.random((n, 1)), rng.random(n) * 3, rng.integers(0, 3, n)
        rows += [(g, k, x[k].tolist(), float(relevance[k]), int(label[k])) for k in range(n)]
        want[g] = select.run(method, x, 8, relevance, label)
    df = spark.createDataFrame(rows, "g string, id long, v array<double>, relevance double, label long")
    got = select.select(df, 8, method, bound=40).collect()
    for g in sizes:
        assert [r["id"] for r in sorted(got, key=lambda r: r["step"]) if r["g"] == g] == want[g]
