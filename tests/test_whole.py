"""Queries that do the whole job, against brute force on fixtures."""

import numpy as np
import pytest

from motley.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    """Writes (name, rows, schema) as a table of a folder of its own."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_sequence_distances_of_whole_texts(spark, tables):
    from motley.operators.kernels import char_distance, edit_distance

    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abé\U0001f600"), rng.integers(0, 90))) for _ in range(2))
        assert char_distance(a, b) == edit_distance(list(a), list(b)), (a, b)
    head = "same words " * 30  # 330 characters
    texts = {1: head + "one tail", 2: head + "another tail é", 3: "", 4: "日本 語", 6: "no neighbour below"}
    got = {r["id"]: r for r in registry.QUERIES["sequence_distances"](spark, tables(documents=(list(texts.items()), "doc_id long, text string"))).collect()}
    assert set(got) == {1, 2, 3}
    for k in got:
        a, b = texts[k], texts[k + 1]
        x, y = a.split(), b.split()
        n = max(len(x), len(y), 1)
        assert got[k]["hamming"] == pytest.approx(sum(i >= len(x) or i >= len(y) or x[i] != y[i] for i in range(n)) / n, abs=1e-6)
        assert got[k]["jaccard"] == pytest.approx(1 - len({*x} & {*y}) / len({*x} | {*y}), abs=1e-6)
        assert got[k]["edit"] == pytest.approx(edit_distance(list(a), list(b)) / max(len(a), len(b)), abs=1e-3)
    assert 0 < got[1]["edit"] < 0.05


def test_lsh_pairs_of_all_members_of_a_bucket(spark):
    from pyspark.sql import functions as F

    from motley.functions.tokens import space_tokens
    from motley.operators.cluster import minhash_pairs

    words = [f"w{k}" for k in range(100)]
    texts = [words[:k] + words[k + 1 :] for k in range(40)]  # similarity of any two: 98 / 100
    texts += [list(reversed(texts[5])), texts[7], texts[7], ["alone"], []]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string")
    want = {(i, j): 0.98 for i in range(40) for j in range(i + 1, 40)} | {(5, 40): 1.0, (7, 41): 1.0, (7, 42): 1.0}
    for block in (64, 8):
        rows = minhash_pairs(df, space_tokens(F.col("text")), 0.8, block=block).collect()
        assert len(rows) == len(want)
        assert {(r["a"], r["b"]): round(r["similarity"], 6) for r in rows} == want
