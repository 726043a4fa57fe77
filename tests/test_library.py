"""Golden values, invariants, kernels, readers and streams."""

import json
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.functions import clean, tokens
from motley.operators import dedup, lexical, results, select, series, stats, vectors
from motley.operators.query import Query
from motley.sources import readers
from motley.streaming import online

FOX = ["the quick brown fox jumps over the lazy dog", "a fast auburn fox leaps above a sleepy hound", "the quick brown fox jumps over the sleeping cat"]


def groups(spark, **named):
    return spark.createDataFrame([(g, k, t) for g, ts in named.items() for k, t in enumerate(ts)], "g string, id long, text string")


def value(df, column="value"):
    return {r["g"]: r[column] for r in df.collect()}


def test_tokenizers(spark):
    df = spark.createDataFrame([("Don't stop, Café 3.5!",)], "text string")
    want = {
        "punct": ["don", "'", "t", "stop", ",", "café", "3", ".", "5", "!"], "space": ["don't", "stop,", "café", "3.5!"], "word": ["don", "t", "stop", "café", "3", "5"],
        "alnum": ["don", "t", "stop", "caf", "3", "5"], "placeholder": ["don", r"\1", "t", "stop", r"\1", "café", "3", r"\1", "5", r"\1"], "letter": ["dont", "stop", "caf"],
        "spaced": ["don", "t", "stop", "café", "3", "5"], "quality": ["Don't", "stop", ",", "Caf", "é", "3.5", "!"],
    }
    for name, expected in want.items():
        assert df.select(tokens.TOKENIZERS[name](F.col("text")).alias("t")).first()["t"] == expected, name
    assert df.select(tokens.ngrams(F.array(F.lit("a")), 2).alias("t")).first()["t"] == []
    assert df.select(tokens.char_ngrams(F.lit("ab"), 4).alias("t")).first()["t"] == ["ab"]
    assert df.select(tokens.content_tokens(F.lit("the cat is a dog"), ["the", "is"]).alias("t")).first()["t"] == ["cat", "dog"]


def brute_self_bleu(texts):
    from collections import Counter

    split, scores = [t.lower().split() for t in texts], []
    for i, hyp in enumerate(split):
        logs = 0.0
        for n in range(1, 5):
            grams = lambda t: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))  # noqa: B023, E731
            h, ref = grams(hyp), Counter()
            for j, other in enumerate(split):
                if j != i:
                    ref |= grams(other)
            total = sum(h.values())
            logs += math.log(max((sum(min(c, ref[g]) for g, c in h.items()) + 1e-10) / (total + 1e-10) if total else 0.0, 1e-10))
        scores.append(math.exp(logs / 4))
    return sum(scores) / len(scores)


def test_lexical_metrics(spark):
    texts = groups(spark, fox=FOX, same=["one two three four"] * 4)
    assert value(lexical.self_bleu(texts)) == pytest.approx({"fox": brute_self_bleu(FOX), "same": 1.0})
    assert value(lexical.distinct_n(texts, 2, "space"))["same"] == 0.25
    assert value(lexical.mean_jaccard_distance(texts))["same"] == 0 == pytest.approx(value(lexical.mean_cosine_distance(texts))["same"] - 1)
    assert value(lexical.unique_text_ratio(texts)) == {"fox": 1.0, "same": 0.25}
    kl = lexical.divergence(groups(spark, a=FOX, b=FOX)).collect()
    assert all(abs(r["kl"]) < 1e-6 for r in kl)


def test_jaccard_counts_copies_once_and_all_pairs(spark):
    from itertools import combinations

    from motley.operators import lexical as lx

    texts = ["a b c"] * 30 + ["a b d"] * 20 + ["x y", "", "", "a"]
    df = spark.createDataFrame([("g", k, t) for k, t in enumerate(texts)], "g string, id long, text string")
    sets = [set(t.split()) for t in texts]
    for empty in (0.0, 1.0):
        want = [1 - len(a & b) / len(a | b) if a | b else empty for a, b in combinations(sets, 2)]
        assert abs(lx.mean_jaccard_distance(df, 1, "space", empty).first()["value"] - sum(want) / len(want)) < 1e-9



def test_cleaning(spark):
    text = "  <b>See</b> https://a.example.com/x?y and me@b.org &amp; “more”​   now — 1,234,567 1ST "
    row = spark.createDataFrame([(text,)], "t string").select(clean.clean(F.col("t"), lower=True).alias("c"), clean.plain_numbers(F.col("t")).alias("n"), clean.pad(F.lit("ab"), 4).alias("p"), clean.syllables(F.lit("Readable")).alias("s")).first()
    assert row["c"] == "see and & “more” now — 1,234,567 1st" and "1234567 1st" in row["n"] and row["p"] == "ab  " and row["s"] == 2


def test_dedup(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words[(k % 6) * 4 : (k % 6) * 4 + 9], 7, replace=False)) for k in range(60)]
    df = groups(spark, g=texts)
    sets = [set(t.split()) for t in texts]
    want = {(a, b) for a, b in combinations(range(60), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    edges = dedup.similar_pairs(df, tokens.space_tokens(F.col("text")), 0.5)
    assert {(r["a"], r["b"]) for r in edges.collect()} == want
    kept = []
    for k in range(60):
        if not any((j, k) in want for j in kept):
            kept.append(k)
    assert sorted(r["id"] for r in dedup.greedy_keep(df, edges).where("kept").collect()) == kept
    label = list(range(60))
    for _ in range(60):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["cluster"] for r in dedup.clusters(df, edges).collect()} == dict(enumerate(label))


def test_query_builder(spark):
    df = spark.range(10).withColumn("name", F.concat(F.lit("Row"), "id"))
    q = lambda: Query(spark).table(df)
    assert q().where("name", "LIKE", "row1%").count() == 1 and q().where("id", "IN", []).count() == 0 and q().where("id", "NOT IN", []).count() == 10
    assert [r["id"] for r in q().select("id").order_by("id", "DESC").limit(2).offset(1).build().collect()] == [8, 7]
    with pytest.raises(ValueError):
        q().offset(1).build()
    with pytest.raises(ValueError):
        q().where("id", "~", 1)


def test_pareto_and_hypervolume(spark):
    rng = np.random.default_rng(1)
    pts = rng.random((60, 2))
    df = spark.createDataFrame([("g", k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "g string, id long, x double, y double")
    front = {r["id"] for r in results.pareto_front(df, ["x", "y"], ["g"]).collect()}
    assert front == {k for k, p in enumerate(pts) if not ((pts >= p).all(1) & (pts > p).any(1)).any()}
    grid = np.stack(np.meshgrid(np.linspace(0, 1, 400), np.linspace(0, 1, 400)), -1).reshape(-1, 2)
    covered = np.zeros(len(grid), bool)
    for p in pts:
        covered |= (grid >= p).all(1)
    assert stats.hypervolume_2d(df, ["g"], "x", "y", (1.0, 1.0)).first()["hypervolume"] == pytest.approx(covered.mean(), abs=0.01)


def test_vendi_equals_primal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 6))
    df = spark.createDataFrame([(0, k, [float(a) for a in v]) for k, v in enumerate(x)], "g int, id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = np.maximum(np.linalg.eigvalsh(unit @ unit.T / 20), 0)
    p = p[p > 1e-10]
    assert vectors.vendi(df).first()["vendi"] == pytest.approx(math.exp(-(p * np.log(p)).sum()))
    same = spark.createDataFrame([(0, k, [1.0, 2.0]) for k in range(5)], "g int, id long, v array<double>")
    assert vectors.vendi(same).first()["vendi"] == pytest.approx(1.0)
    mean, axes, share = vectors.principal_axes(df, 6)
    assert share.sum() == pytest.approx(1.0) and np.allclose(mean, x.mean(0)) and np.allclose(axes @ axes.T, np.eye(6))


def spread(x, chosen):
    return min(np.linalg.norm(x[a] - x[b]) for a, b in combinations(chosen, 2))


@pytest.mark.parametrize("method", select.METHODS)
def test_selection_kernels(method):
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(60, 5)), np.arange(60) % 3
    found = select.run(method, x, 9, rng.random(60), labels)
    assert len(found) == len(set(found)) == 9 and found == select.run(method, x, 9, np.random.default_rng(3).random(60), labels) or method == "mmr"
    if method == "fair":
        assert [sum(labels[k] == c for k in found) for c in range(3)] == [3, 3, 3]


def test_certified_is_exact_on_small_sets():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 3))
    best = max(spread(x, c) for c in combinations(range(12), 4))
    chosen, value_, bound, sure = select.certified(x, 4)
    assert value_ == pytest.approx(best) == pytest.approx(bound) and sure and spread(x, chosen) == pytest.approx(best)
    big = rng.normal(size=(80, 3))
    chosen, value_, bound, _ = select.certified(big, 6)
    assert bound >= value_ == pytest.approx(spread(big, chosen)) and value_ >= spread(big, select.farthest_point(big, 6)) - 1e-12


def test_series(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(v)], "g string, t long, v double")
    smooth = [r["smooth"] for r in series.ewma(df, 0.5).orderBy("t").collect()]
    s = v[0]
    for k, x in enumerate(v):
        s = x if k == 0 else 0.5 * x + 0.5 * s
        assert smooth[k] == pytest.approx(s)
    assert [r["v"] for r in series.difference(df).orderBy("t").collect()] == [b - a for a, b in zip(v, v[1:])]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('model,response\nm1,"a, b"\nm2,"say ""hi"""\n')
    (tmp_path / "b.jsonl").write_text('{"text": "x", "model": "m"}\n\n{"output": "y"}\n')
    (tmp_path / "c.json").write_text(json.dumps({"data": ["one", {"text": "two"}]}))
    (tmp_path / "d.json").write_text(json.dumps({"g1": ["p", "q"], "g2": ["r"]}))
    (tmp_path / "e.txt").write_text("first\n\n  second \n")
    rows = lambda df: sorted((r["g"], r["text"]) for r in df.collect())
    read = lambda name, **o: rows(readers.read_texts(spark, f"{tmp_path}/{name}", **o))
    assert read("a.csv") == [("m1", "a, b"), ("m2", 'say "hi"')]
    assert sorted(t for _, t in read("b.jsonl")) == ["x", "y"]
    assert read("c.json") == [("default", "one"), ("default", "two")]
    assert rows(readers.read_grouped_json(spark, f"{tmp_path}/d.json")) == [("g1", "p"), ("g1", "q"), ("g2", "r")]
    assert read("e.txt") == [("default", "first"), ("default", "second")]
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, f"{tmp_path}/b.jsonl", field="nothing")
    df = readers.read_texts(spark, f"{tmp_path}/a.csv")
    for kind, write in (("csv", readers.write_csv), ("json", readers.write_json)):
        write(df, f"{tmp_path}/out.{kind}")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out.csv").count() == 2
    with pytest.raises(Exception, match="too few"):
        readers.validate_groups(df).collect()


def test_experiment_round_trip(spark):
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, name string")
    metrics = spark.createDataFrame([(1, "x", 0.5), (1, "y", 1.5), (2, "x", 2.5)], "run_id long, metric string, value double")
    back = readers.load_experiments(readers.dump_experiments(runs, metrics))
    assert sorted(back[0].collect()) == sorted(runs.collect()) and sorted(back[1].collect()) == sorted(metrics.collect())


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_streams_match_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    got = {(r["start"], r["event_type"]): r["n"] for r in drain(online.event_counts(stream), "counts", "complete")}
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").count().collect()
    assert got == {(r["window"]["start"], r["event_type"]): r["count"] for r in want}


def test_online_sets(spark, tmp_path):
    texts = [f"sentence number {k} about topic {k % 4} and some more" for k in range(30)] + ["", "totally different words live here now"]
    df = spark.createDataFrame([("g", k, k, t) for k, t in enumerate(texts)], "g string, ts long, id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/texts")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/texts")
    keeper = online.DiverseSet(5, 0.2)
    want = {k: keeper.offer(t)[0] for k, t in enumerate(texts)}
    assert {r["id"]: r["accepted"] for r in drain(online.diverse_set(stream, 5, 0.2), "diverse")} == want
    assert want[31] and not want[30] and sum(want.values()) >= 6
    first = {r["id"]: r["accepted"] for r in drain(online.reservoir(stream, 5), "reservoir_a")}
    assert first == {r["id"]: r["accepted"] for r in drain(online.reservoir(stream, 5), "reservoir_b")} and all(first[k] for k in range(5))


def test_rerankers(spark):
    from motley.operators import rerank

    rng = np.random.default_rng(8)
    items = [(f"i{k}", "abcd"[k % 4 if k > 5 else 0], float(rng.random() + (k <= 5))) for k in range(40)]
    candidates = spark.createDataFrame([(q, i, r) for q in (1, 2) for i, _, r in items], "q long, item string, relevance double")
    topics = spark.createDataFrame([(i, t) for i, t, _ in items], "item string, topic string")
    of = {i: t for i, t, _ in items}
    for method in rerank.METHODS:
        rows = rerank.rerank(candidates, topics, 8, method).collect()
        for q in (1, 2):
            mine = [r["item"] for r in sorted(rows, key=lambda r: r["rank"]) if r["q"] == q]
            assert len(mine) == len(set(mine)) == 8
            assert len({of[i] for i in mine}) >= (2 if method == "xquad" else 4), method  # xquad weighs relevance as much


def test_redundant_metrics(spark):
    from motley.operators.audit import redundant_metrics

    tau = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.75)], "a string, b string, tau double")
    assert redundant_metrics(tau) == ([["a", "b"], ["c"]], [("a", "c")])


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert entry.entry(spark).count() > 0


def test_lsh_recall_and_shapes(spark):
    from motley.operators import cluster

    rng = np.random.default_rng(9)
    base = [[f"w{rng.integers(5000)}" for _ in range(40)] for _ in range(30)]
    texts = [" ".join(b[: 40 - j] + [f"n{k}{j}{i}" for i in range(j)]) for k, b in enumerate(base) for j in range(3)]
    found = {(r["a"], r["b"]) for r in cluster.minhash_pairs(groups(spark, g=texts), tokens.space_tokens(F.col("text")), 0.8).collect()}
    assert {(3 * k, 3 * k + 1) for k in range(30)} <= found
    assert cluster.band_shape(0.5)[0] * cluster.band_shape(0.5)[1] == 128


def test_clusters_of_vectors(spark):
    from motley.operators import cluster

    df = cluster.synthetic_clusters(spark, 120, 3, 4, 11, 0.05).cache()
    label = {r["id"]: r["g"] for r in df.collect()}
    for found in (cluster.dbscan(df, 0.5, 3), cluster.k_means(df, 4, 3)):
        got = {r["id"]: r["cluster"] for r in found.collect()}
        assert len({(label[i], c) for i, c in got.items()}) == 4
    both = df.select("g", "id").join(cluster.k_means(df, 4, 3), "id")
    assert cluster.adjusted_rand(both, "g", "cluster").first()["ari"] == pytest.approx(1.0)
    assert cluster.silhouette(df).first()["silhouette"] > 0.9
    bits = df.select(cluster.sign_bits(F.col("v"), 3, 16, 1).alias("b"), "g").collect()
    assert all(len(r["b"]) == 16 for r in bits)
    assert spark.range(1).select(cluster.sign_agreement(F.lit("1100"), F.lit("1000")).alias("x")).first()["x"] == 0.75


def test_kernels(spark):
    from motley.operators import kernels

    rng = np.random.default_rng(12)

    def slow(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        e = np.zeros_like(d)
        e[:, 0], e[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = d[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(d[i - 1, j], d[i, j - 1])
                e[i, j] = min(e[i - 1, j] + 1, e[i, j - 1] + 1, e[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1, -1], e[-1, -1]

    for _ in range(30):
        a, b = list(rng.integers(0, 5, rng.integers(0, 12))), list(rng.integers(0, 5, rng.integers(0, 12)))
        assert (kernels.lcs(a, b), kernels.edit_distance(a, b)) == slow(a, b)
    pair = spark.createDataFrame([(1, "the cat sat", "the cat lay on the mat"), (2, "", "x")], "id long, text string, reference string")
    assert {r["id"]: round(r["f"], 4) for r in kernels.rouge_l(pair).collect()} == {1: 0.4444, 2: 0.0}
    assert value(kernels.tag_sequence_diversity(groups(spark, g=["the dog barked", "a cat slept"])))["g"] == pytest.approx(1 / 3)
    step = np.concatenate((np.zeros(30), np.full(30, 5.0))) + rng.normal(size=60) * 0.1
    assert kernels.segments(step) == [30]
    ar = np.zeros(3000)
    for k in range(1, 3000):
        ar[k] = 0.7 * ar[k - 1] + rng.normal()
    p = kernels.pacf(ar, 4)
    assert p[1] == pytest.approx(0.7, abs=0.08) and all(abs(x) < 0.08 for x in p[2:])
    df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(step)], "g string, t long, v double")
    assert [r["change"] for r in kernels.per_series(df, kernels.segments, "change").collect()] == [30.0]


def test_ranks_take_no_group_as_one(spark):
    from motley.operators import results, stats

    r = random.Random(8)
    rows = [(r.choice("ab"), i, float(r.randint(0, 9)), float(r.randint(0, 30)), r.choice("xy")) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, value double, v double, s string").cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x["g"]: x["rho"] for x in stats.spearman(df, "value", "v", ["g"]).collect()}
        effects = {x["g"]: x["cles"] for x in stats.two_sample_effects(df, ["g"], "s", "v", "x", "y").collect()}
        percentile = stats.running_sums(df, ["g"], ["value", "id"], F.lit(1))
        assert "Window [count" not in results.percentile_rank(df, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
        found = {x["id"]: x["percentile"] for x in results.percentile_rank(df, ["g"], ["id"]).collect()}
        p = {x["id"]: x for x in stats.corrected_p(df.select("id", (F.col("v") / 40).alias("p"))).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert percentile.count() == 400

    def ranks(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    for g in "ab":
        mine = [x for x in rows if x[0] == g]
        x, y = ranks([m[2] for m in mine]), ranks([m[3] for m in mine])
        mx = (len(mine) + 1) / 2
        dot = lambda a, b: sum((p - mx) * (q - mx) for p, q in zip(a, b))
        assert got[g] == pytest.approx(dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5)
        first, second = [m[3] for m in mine if m[4] == "x"], [m[3] for m in mine if m[4] == "y"]
        assert effects[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in first for b in second) / len(first) / len(second))
        for place, m in enumerate(sorted(mine, key=lambda m: (m[2], m[1]))):
            assert found[m[1]] == pytest.approx(place / (len(mine) - 1) * 100)
    order = sorted(rows, key=lambda m: (m[3], m[1]))
    n, h, high, low = len(order), sum(1 / k for k in range(1, len(order) + 1)), 0.0, 1e9
    for k, m in enumerate(order, 1):
        high = max(high, m[3] / 40 * (n - k + 1))
        assert p[m[1]]["holm"] == pytest.approx(min(high, 1))
    for k, m in reversed(list(enumerate(order, 1))):
        low = min(low, m[3] / 40 * n / k)
        assert (p[m[1]]["bh"], p[m[1]]["by"]) == pytest.approx((min(low, 1), min(low * h, 1)))
