"""Spectra, block kernels and alignments against plain loops."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.operators import blocks as bl
from motley.operators import texteval as tx
from motley.operators import vectors as vc


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(7)
    rows = [("a", k, r.normal(size=4)) for k in range(23)] + [("b", 100 + k, r.normal(size=4)) for k in range(5)]
    rows += [("a", 50, rows[0][2]), ("a", 51, np.zeros(4)), ("c", 200, r.normal(size=4))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(g, k, [float(x) for x in v]) for g, k, v in rows], "g string, id long, v array<double>").repartition(5)


def cosine(x, y):
    both = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / both) if both else 0.0


def spectrum_score(rows, weights=None):
    q = np.ones(len(rows)) if weights is None else np.array(weights, float)
    k = np.array([[cosine(x, y) * math.sqrt(a * b) for y, b in zip(rows, q)] for x, a in zip(rows, q)])
    values = np.linalg.eigvalsh(k)
    p = values[values > 1e-9] / values[values > 1e-9].sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def groups(points):
    out = {}
    for g, k, v in points:
        out.setdefault(g, []).append((k, v))
    return out


def test_vendi(spark, points):
    df = frame(spark, points)
    got = {r["g"]: r["vendi"] for r in vc.vendi(df).collect()}
    heavy = {r["g"]: r["vendi"] for r in vc.vendi(df, weight=F.col("id") % 3 + 1).collect()}
    for g, rows in groups(points).items():
        assert got[g] == pytest.approx(spectrum_score([v for _, v in rows]), abs=1e-6)
        assert heavy[g] == pytest.approx(spectrum_score([v for _, v in rows], [k % 3 + 1 for k, _ in rows]), abs=1e-6)


def test_vendi_of_sets(spark, points):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), ("a", "none")], "a string, b string")
    got = {(r["a"], r["b"]): r for r in vc.vendi_of_sets(frame(spark, points), pairs).collect()}
    sets = {g: [v for _, v in rows] for g, rows in groups(points).items()}
    assert set(got) == {("a", "b"), ("b", "c"), ("a", "a")}
    for (a, b), r in got.items():
        va, vb, u = spectrum_score(sets[a]), spectrum_score(sets[b]), spectrum_score(sets[a] + sets[b])
        assert (r["vendi_a"], r["vendi_b"], r["vendi_union"]) == pytest.approx((va, vb, u), abs=1e-6)
        assert r["synergy"] == pytest.approx(u - va - vb + min(va, vb), abs=1e-6)


def test_similarity_scores(spark, points, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 4)
    got = {(r["g"], r["id"]): r for r in bl.similarity_scores(frame(spark, points)).collect()}
    assert len(got) == len(points)
    for g, rows in groups(points).items():
        for k, v in rows:
            others = [cosine(v, w) for j, w in rows if j != k]
            r = got[g, k]
            assert r["novelty"] == pytest.approx(min(max(1 - max(others), 0), 1) if others else 0, abs=1e-9)
            assert r["redundant"] == (bool(others) and max(others) >= 0.9)
            take = min(3, len(rows) - 1)
            assert r["redundancy"] == pytest.approx(sum(sorted(others + [0.0])[-take:]) / take if others else 0, abs=1e-9)


def test_blocks_meet_once(spark, points):
    def count(ids, x, others, y):
        return {"n": [int((ids[:, None] < others[None, :]).sum())]}

    df = frame(spark, points)
    got = bl.blocked(df, df, count, "n long", block=3).groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert {r["g"]: r["n"] for r in got} == {g: len(r) * (len(r) - 1) // 2 for g, r in groups(points).items()}


def test_kernels_and_coverage(spark, points):
    df = frame(spark, points)
    got = {(r["g"], r["kernel"], r["bandwidth"]): r["epd"] for r in bl.kernel_distances(df, (2.0,)).collect()}
    rows = [v for _, v in groups(points)["a"]]
    mean = np.mean([math.exp(-np.abs(x - y).sum() / 2.0) for x, y in itertools.combinations(rows, 2)])
    assert got["a", "laplacian", 2.0] == pytest.approx(1 - mean, abs=1e-9)
    assert got["c", "rbf", 2.0] == 0
    even, odd = [v for k, v in groups(points)["a"] if k % 2 == 0], [v for k, v in groups(points)["a"] if k % 2]
    r = bl.coverage(df.where("id % 2 = 0"), df.where("id % 2 = 1"), [1.0]).where("g = 'a'").first()
    near = lambda xs, ys: np.mean([min(np.linalg.norm(x - y) for y in ys) <= 1.0 for x in xs])
    assert (r["precision"], r["recall"]) == pytest.approx((near(even, odd), near(odd, even)))


def test_no_vectors(spark):
    none = spark.createDataFrame([], "g string, id long, v array<double>")
    assert vc.vendi(none).collect() == [] and bl.similarity_scores(none).collect() == [] and bl.kernel_distances(none).collect() == []
    one = spark.createDataFrame([("a", 1, None), ("a", 2, [0.0, 0.0])], "g string, id long, v array<double>")
    assert [tuple(r) for r in vc.vendi(one).collect()] == [("a", 1, 1.0)]


def plain_alignment(text, reference):
    used, met = set(), []
    for same in (lambda a, b: a == b, lambda a, b: tx.stem(a) == tx.stem(b)):
        for i, w in enumerate(text):
            if i in {p for p, _ in met}:
                continue
            for j, x in enumerate(reference):
                if j not in used and same(w, x):
                    met.append((i, j))
                    used.add(j)
                    break
    return sorted(met)


def test_alignment():
    r = random.Random(3)
    words = "run running runs quick quickly nation national nations happiness happy x the".split()
    for _ in range(200):
        a, b = r.choices(words, k=r.randint(0, 12)), r.choices(words, k=r.randint(0, 12))
        assert tx.alignment(a, b)[0] == plain_alignment(a, b)
    assert tx.stem("national") == "nate"
    assert tx.stem("quickly") == "quick" and tx.stem("was") == "was"


def test_pair_scores(spark):
    rows = [(1, "the cat sat", "the cat sat"), (2, "cats sat", "the cat sat"), (3, "", ""), (4, None, "a b"), (5, "xy", "xyxyxyx"), (6, "The, a!", "an")]
    df = spark.createDataFrame(rows, "id long, text string, reference string")
    a = {r["id"]: r for r in tx.alignment_scores(df).collect()}
    assert a[1]["meteor"] == pytest.approx(1 - 0.5 / 27) and a[1]["edit_rate"] == 0 and a[1]["chunks"] == 1
    assert a[3]["meteor"] == a[4]["meteor"] == 0 and a[3]["edit_rate"] == 0 and a[4]["edit_rate"] == 1
    c = {r["id"]: r["chrf"] for r in tx.chrf(df).collect()}
    assert c[1] == pytest.approx(1) and c[3] == c[4] == 0 and 0 < c[5] < 1
    e = {r["id"]: (r["exact"], r["f"]) for r in tx.answer_scores(df).collect()}
    assert e[3] == e[6] == (True, 1.0) and e[4] == (False, 0.0) and e[1] == (True, 1.0)
    s = {r["id"]: r["f"] for r in tx.rouge_s(df).collect()}
    assert s[1] == pytest.approx(1) and s[2] == s[3] == s[4] == 0


def test_reference_metrics_move_no_grams(spark, monkeypatch):
    monkeypatch.setattr(tx, "TALLY", 40)
    r = random.Random(5)
    text = lambda: " ".join(r.choices(["a", "bb", "c", "é", "\U0001f600"], k=r.randint(0, 25)))
    rows = [(i, text(), text()) for i in range(60)] + [(60, "ab", "abc"), (61, None, None)]

    def counted(x, n):
        return Counter(zip(*[x[k:] for k in range(n)]))

    def bleu(h, f):
        p = [sum((counted(h, n) & counted(f, n)).values()) / (len(h) - n + 1) for n in range(1, 5) if len(h) >= n]
        return math.exp(sum(map(math.log, p)) / len(p)) * (math.exp(1 - len(f) / len(h)) if len(h) < len(f) else 1) if p and min(p) > 0 else 0

    def chrf(h, f):
        bags = [(counted(h, n) if len(h) >= n else Counter([h]), counted(f, n) if len(f) >= n else Counter([f])) for n in range(1, 7)]
        p, q = (sum(sum((x & y).values()) / sum((x, y)[k].values()) for x, y in bags) / 6 if h and f else 0 for k in (0, 1))
        return 5 * p * q / (4 * p + q) if p + q else 0

    df = spark.createDataFrame(rows, "id long, text string, reference string")
    for out, want in ((tx.bleu_with_brevity(df), lambda h, f: bleu(h.split(), f.split())), (tx.chrf(df), lambda h, f: chrf(tuple(h.strip()), tuple(f.strip())))):
        assert {x[0]: x[1] for x in out.collect()} == pytest.approx({i: want(h or "", f or "") for i, h, f in rows})
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_sets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bl, "SETS", 7)
    monkeypatch.setattr(bl, "COLUMNS", 3)
    r = random.Random(2)
    sets = {i: sorted({min(int(r.expovariate(0.05)), 90) for _ in range(r.randint(0, 30))}) for i in range(60)}
    df = spark.createDataFrame([("g", i, s, 1 + i % 3) for i, s in sets.items()], "g string, id long, v array<long>, weight int")
    likeness = lambda a, b: len({*a} & {*b}) / max(len({*a} | {*b}), 1)
    past = bl.greatest_jaccard(df, df, past=True)
    assert {x["id"]: x["best"] for x in past.collect()} == pytest.approx({i: max((likeness(s, sets[j]) for j in range(i)), default=0) for i, s in sets.items()})
    known = df.where("id < 9")
    assert {x["id"]: x["best"] for x in bl.greatest_jaccard(df, known).collect()} == pytest.approx({i: max(likeness(s, sets[j]) for j in range(9)) for i, s in sets.items()})
    want = sum(likeness(sets[i], sets[j]) * (1 + i % 3) * (1 + j % 3) for i, j in itertools.combinations(sets, 2))
    assert bl.jaccard_sums(df).first()["alike"] == pytest.approx(want)
    one = (np.arange(5000) % 700, np.full(50, 100))
    assert (bl.shared_members(one, one) == [[len({*one[0][a : a + 100]} & {*one[0][b : b + 100]}) for b in range(0, 5000, 100)] for a in range(0, 5000, 100)]).all()


def test_nearest_and_furthest_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(bl, "WIDE", 20)
    gen = np.random.default_rng(6)
    v = np.vstack([gen.normal(size=(70, 5)), np.tile(gen.normal(size=5), (9, 1)), 1e3 + gen.normal(size=(20, 5)) / 1e3])
    df = spark.createDataFrame([("g", i, x.tolist()) for i, x in enumerate(v)] + [("one", 500, [0.0] * 5)], "g string, id long, v array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    want = {(i, int(j), r + 1) for i in range(len(v)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(v)), np.round(d[i], 9))) if j != i][:3])}
    assert {(x["id"], x["neighbour"], x["rank"]) for x in bl.nearest_rows(df, 3).collect()} == want
    pairs = sorted(itertools.combinations(range(len(v)), 2), key=lambda p: (-d[p], p))[:10]
    assert sorted((x["a"], x["b"]) for x in bl.furthest_pairs(df, 10).collect()) == sorted(pairs)


def test_distance_summary(spark, points, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 5)
    df = frame(spark, points)
    got = {r["g"]: r for r in bl.distance_summary(df, "manhattan").collect()}
    spread = {r["g"]: r["entropy"] for r in bl.distance_entropy(df, "manhattan", 6).collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        d = np.array([np.abs(x - y).sum() for (_, x), (_, y) in itertools.combinations(groups(points)[g], 2)])
        r = got[g]
        assert (r["n_pairs"], r["spread"], r["diameter"]) == (len(d), pytest.approx(d.min()), pytest.approx(d.max()))
        assert (r["mean"], r["median"], r["variance"]) == pytest.approx((d.mean(), np.median(d), d.var()), abs=1e-8)
        c = np.histogram(d, 6, (d.min(), d.max()))[0] / len(d)
        assert spread[g] == pytest.approx(-(c[c > 0] * np.log(c[c > 0])).sum() / np.log(6), abs=1e-9)


def test_equal_distances(spark):
    df = spark.createDataFrame([("a", k, [1.0, 2.0]) for k in range(4)] + [("z", 9, [0.0, 1.0])], "g string, id long, v array<double>")
    r = bl.distance_summary(df).collect()
    assert [(x["g"], x["n_pairs"], x["median"], x["diameter"], x["variance"]) for x in r] == [("a", 6, 0.0, 0.0, 0.0)]
    assert [tuple(x) for x in bl.distance_entropy(df).collect()] == [("a", 0.0)]
