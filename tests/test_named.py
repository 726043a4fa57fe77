"""Operators without SQL by name: ratings, strengths and samplers against plain computations and exact chances."""

import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.operators import evaluate, logits, select


def test_elo_ratings(spark):
    rng = np.random.default_rng(1)
    rows = [("x", int(s), *rng.choice(list("pqr"), 2, replace=False).tolist(), float(rng.choice([0, 0.5, 1]))) for s in rng.permutation(60)]
    got = {r["system"]: r["rating"] for r in evaluate.elo(spark.createDataFrame(rows, "g string, step long, a string, b string, score double").repartition(3)).collect()}
    want = dict.fromkeys("pqr", 1500.0)
    for _, _, a, b, s in sorted(rows, key=lambda r: r[1]):
        e = 1 / (1 + 10 ** ((want[b] - want[a]) / 400))
        want[a], want[b] = want[a] + 32 * (s - e), want[b] - 32 * (s - e)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(4500)


def test_bradley_terry_is_the_likeliest(spark):
    wins = [("a", "b", 7.0), ("b", "a", 3.0), ("b", "c", 6.0), ("c", "b", 4.0), ("a", "c", 8.0), ("c", "a", 1.0)]
    got = {r["system"]: r["strength"] for r in evaluate.bradley_terry(spark.createDataFrame(wins, "a string, b string, n double")).collect()}
    likely = lambda s: sum(n * math.log(s[a] / (s[a] + s[b])) for a, b, n in wins)
    best = likely(got)
    assert sum(got.values()) == pytest.approx(1)
    for a in "abc":
        for f in (0.97, 1.03):
            assert likely({**got, a: got[a] * f}) < best + 1e-6


def test_compression_diversity(spark):
    texts = {"s": ["the same words again"] * 5, "d": ["alpha beta", "gamma delta", "one two three"], "one": ["only"]}
    df = spark.createDataFrame([(g, i, t) for g, x in texts.items() for i, t in enumerate(x)], "g string, id long, text string").repartition(3)
    for r in evaluate.compression_diversity(df).collect():
        data = [t.encode() for t in texts[r["g"]]]
        joined = len(zlib.compress(b"\n".join(data)))
        assert r["ratio"] == pytest.approx(joined / len(b"\n".join(data)), abs=0.1)
        assert r["crd"] == pytest.approx(min(joined / sum(len(zlib.compress(d)) for d in data), 1.0) if len(data) > 1 else 0.0, abs=0.05)


def test_compression_of_large_groups_in_parts(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(400)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 900))) for _ in range(120)] + ["", "x" * 300_000, "end"]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)] + [("null", 0, None), ("null", 1, "a")], "g string, id long, text string")
    whole, parts = ({x["g"]: x for x in evaluate.compression_diversity(df, b).collect()} for b in (64 << 20, 100_000))
    joined = "\n".join(texts).encode()
    assert len(joined) > 500_000 and whole["g"]["ratio"] == pytest.approx(len(zlib.compress(joined)) / len(joined))
    assert whole["g"]["crd"] == pytest.approx(len(zlib.compress(joined)) / sum(len(zlib.compress(t.encode())) for t in texts))
    assert parts["g"]["ratio"] == pytest.approx(whole["g"]["ratio"], rel=0.01) and parts["g"]["crd"] == pytest.approx(whole["g"]["crd"], rel=0.01)
    assert whole["null"] == parts["null"] and whole["null"]["ratio"] == len(zlib.compress(b"\na")) / 2


def test_random_sample_is_even_and_repeats(spark):
    rows = spark.range(24)
    first = [r["id"] for r in select.random_sample(rows, 6, 3).collect()]
    assert first == [r["id"] for r in select.random_sample(rows.repartition(5), 6, 3).collect()] and len(set(first)) == 6
    seeds = [r["s"] for r in spark.range(400).selectExpr("id as s").collect()]
    order = rows.crossJoin(spark.createDataFrame([(s,) for s in seeds], "s int")).select("s", "id", F.xxhash64("s", "id").alias("h")).collect()
    taken = Counter()
    for s in seeds:
        taken.update(i for _, i in sorted((r["h"], r["id"]) for r in order if r["s"] == s)[:6])
    assert sum((taken[i] - 100) ** 2 / 100 for i in range(24)) < 60


def test_stratified_sample(spark):
    rows = spark.range(200).select((F.col("id") % 7 * (F.col("id") % 3)).alias("g"), "id")
    got = select.stratified(rows, 31, 5).collect()
    sizes, groups = Counter(r["g"] for r in rows.collect()), sorted({r["g"] for r in rows.collect()})
    quota = {g: 31 // len(groups) + (k < 31 % len(groups)) for k, g in enumerate(groups)}
    assert Counter(r["g"] for r in got) == Counter({g: min(quota[g], sizes[g]) for g in groups})
    assert sorted((r["g"], r["id"]) for r in got) == sorted((r["g"], r["id"]) for r in select.stratified(rows.repartition(6), 31, 5).collect())


def test_gumbel_top_k_draws_without_replacement(spark):
    p = [0.5, 0.3, 0.15, 0.05]
    n = 4000
    probs = spark.range(n).select(F.col("id").alias("row_id"), F.posexplode(F.array(*map(F.lit, p))).alias("token_id", "p"))
    found = Counter(tuple(r["t"]) for r in logits.gumbel_top_k(probs, 2, 9).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "token_id"))), lambda s: s["token_id"]).alias("t")).collect())
    want = {(a, b): p[a] * p[b] / (1 - p[a]) for a, b in permutations(range(4), 2)}
    assert sum((found[s] - w * n) ** 2 / (w * n) for s, w in want.items()) < 35
