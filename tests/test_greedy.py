"""Selection over whole groups by passes: the same choices as the kernels that see a group at once."""

import numpy as np
import pytest

from motley.operators import greedy, select


def frame(spark, groups, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for g, (n, d) in groups.items():
        x = rng.normal(size=(n, d)) + rng.integers(0, 4, size=(n, 1))
        rows += [(g, k, [float(a) for a in v], float(rng.random()), int(rng.integers(3))) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "g string, id long, v array<double>, relevance double, label long").repartition(5)


def chosen(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("method", select.METHODS)
def test_passes_choose_as_the_kernels(spark, method):
    df = frame(spark, {"a": (220, 5), "b": (150, 5), "small": (20, 5)})
    got = chosen(select.select(df, 6, method, bound=100))
    assert got == chosen(select.select(df, 6, method, bound=1000))
    assert len(got) == 18


@pytest.mark.parametrize("method", ["facility", "k_medoids"])
def test_lazy_steps_look_past_their_first_candidates(spark, method, monkeypatch):
    monkeypatch.setattr(greedy, "CANDIDATES", 25)
    df = frame(spark, {"a": (120, 3)}, 3)
    assert chosen(select.select(df, 3, method, bound=100)) == chosen(select.select(df, 3, method, bound=1000))


@pytest.mark.parametrize("method", ["facility", "k_medoids"])
def test_a_lazy_step_takes_two_batches_at_most(spark, method, monkeypatch):
    asked, gains = [], greedy._gains
    monkeypatch.setattr(greedy, "CANDIDATES", 2)
    monkeypatch.setattr(greedy, "_gains", lambda *a: asked.append(1) or gains(*a))
    df = frame(spark, {"a": (120, 3)}, 3)
    assert chosen(select.select(df, 3, method, bound=100)) == chosen(select.select(df, 3, method, bound=1000))
    assert len(asked) <= 1 + 2 * 2


@pytest.mark.parametrize("method", ["farthest", "mmr", "fair", "dpp"])
def test_thousands_of_rows_in_one_group(spark, method):
    df = frame(spark, {"a": (20_000 if method == "farthest" else select.BOUND + 200, 4)}, 5)
    rows = df.toPandas().sort_values("id")
    x = np.array(rows["v"].tolist())
    if method == "dpp":
        width = float(df.transform(lambda d: greedy._with_width(d)).first()["width"])
        left, factor, want = np.ones(len(x)), [], []
        for _ in range(8):
            pick = int(np.where(np.isin(np.arange(len(x)), want), -np.inf, left).argmax())
            row = np.exp(-((x - x[pick]) ** 2).sum(1) / (2 * width**2))
            for f in factor:
                row = row - f * f[pick]
            factor.append(row / np.sqrt(left[pick]))
            left = left - factor[-1] ** 2
            want.append(pick)
    elif method == "farthest":
        want = select.farthest_point(x, 8)
    elif method == "mmr":
        want = select.mmr(x, 8, rows["relevance"].to_numpy())
    else:
        near, want, labels = np.full(len(x), np.inf), [], rows["label"].to_numpy()
        for label in [0, 0, 1, 1, 2, 2, None, None]:
            value = np.where((labels == label) if label is not None else True, near, -1.0)
            value[want] = -1
            want.append(int(value.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[want[-1]], axis=1))
    assert [r[1] for r in sorted(chosen(select.select(df, 8, method)), key=lambda r: r[2])] == want


def test_groups_of_equal_rows_and_fewer_labels(spark):
    df = spark.createDataFrame([("e", k, [1.0, 2.0], 0.5, 0) for k in range(30)], "g string, id long, v array<double>, relevance double, label long")
    for method in select.METHODS:
        got = chosen(select.select(df, 4, method, bound=10))
        assert got == chosen(select.select(df, 4, method, bound=100)), method


def test_the_width_needs_no_sums_over_pairs_and_blocks_grow_with_a_group(spark, monkeypatch):
    from motley.operators import blocks

    monkeypatch.setattr(blocks, "distance_sums", lambda *a: pytest.fail("all pairs met once more"))
    df = frame(spark, {"a": (301, 5), "b": (90, 5)}, 4)
    got = {r["g"]: r["width"] for r in greedy._with_width(df).select("g", "width").distinct().collect()}
    for g, rows in df.toPandas().groupby("g"):
        d = select.distances(np.array(rows["v"].tolist()))
        assert got[g] == pytest.approx(np.median(d[np.triu_indices(len(d), 1)]), rel=1e-9)
    pairs = lambda most: blocks.blocked(df, df, lambda ids, x, others, y: {"n": [len(x) * len(y)]}, "n long", 4, most=most).where("g = 'a'")
    few, many = pairs(100).collect(), pairs(None).collect()
    assert len(few) <= blocks.PARTS**2 < len(many)
    assert sum(r["n"] for r in few) == sum(r["n"] for r in many) == 301**2
