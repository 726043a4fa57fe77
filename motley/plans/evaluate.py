"""Queries of reference metrics, ratings, votes, archives and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from motley.operators import evaluate as ev
from motley.plans.common import Registry, docs, read
from motley.plans.stats import DAILY, VOTES, _daily, _votes
from motley.plans.text import T, _texts, count_sql

R = Registry()

#: Every document as the reference of a benchmark item; items are numbered from 0.
PAIRS = "pairs AS (SELECT doc_id AS id, b.text AS text, d.text AS reference FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"


def _pairs(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("reference"))
    return d.join(items, F.col("item_id") == F.col("id") % max(items.count(), 1)).select("id", "text", "reference")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _side(column: str, n: int, name: str) -> str:
    tokens = T["spaced"].replace("text", column)
    return f"(SELECT id, gram, count(*) AS {name} FROM (SELECT id, {'unnest(t)' if n == 1 else f'unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], chr(32))))'} AS gram FROM (SELECT id, {tokens} AS t FROM pairs)) GROUP BY ALL)"


for _n in (1, 2):

    def _rouge(spark, sf_dir, n=_n):
        return _rounded(ev.rouge_n(_pairs(spark, sf_dir), n), "precision", "recall", "f")

    R.add(
        f"rouge_{_n}",
        f"""WITH {PAIRS}, h AS {_side("text", _n, "h")}, r AS {_side("reference", _n, "r")}, k AS (SELECT id, sum(least(h, r)) AS k FROM h JOIN r USING (id, gram) GROUP BY id),
        s AS (SELECT id, coalesce(k / nh, 0) AS p, coalesce(k / nr, 0) AS r FROM pairs LEFT JOIN (SELECT id, sum(h) AS nh FROM h GROUP BY id) USING (id) LEFT JOIN (SELECT id, sum(r) AS nr FROM r GROUP BY id) USING (id) LEFT JOIN k USING (id))
        SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM s""",
    )(_rouge)


@R.add(
    "corpus_bleu",
    f"WITH {PAIRS}, "
    + ", ".join(f"p{n} AS (SELECT sum(least(h, coalesce(r, 0))) / sum(h) AS p{n} FROM {_side('text', n, 'h')} h LEFT JOIN {_side('reference', n, 'r')} r USING (id, gram))" for n in (1, 2))
    + f", l AS (SELECT sum(len({T['spaced']})) AS c, sum(len({T['spaced'].replace('text', 'reference')})) AS r FROM pairs) SELECT round(CASE WHEN p1 > 0 AND p2 > 0 THEN (CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c) END) * exp((ln(p1) + ln(p2)) / 2) ELSE 0 END, 6) AS bleu FROM p1, p2, l",
)
def corpus_bleu(spark, sf_dir):
    return _rounded(ev.corpus_bleu(_pairs(spark, sf_dir), 2), "bleu")


@R.add("bigram_perplexity", f"WITH t AS (SELECT g, gram, c, split_part(gram, ' ', 1) AS a FROM ({count_sql(2, 'word')})), f AS (SELECT g, a, sum(c) AS ca FROM t GROUP BY ALL), v AS (SELECT g, count(*) AS v FROM ({count_sql(1, 'word')}) GROUP BY g) SELECT g, round(2 ** (-sum(c * log2((c + 1) / (ca + v))) / sum(c)), 3) AS perplexity FROM t JOIN f USING (g, a) JOIN v USING (g) GROUP BY g")
def perplexity(spark, sf_dir):
    return _rounded(ev.bigram_perplexity(_texts(spark, sf_dir)), "perplexity", digits=3)


@R.add("mutual_information", f"WITH t AS (SELECT g, c, split_part(gram, ' ', 1) AS a, split_part(gram, ' ', 2) AS b FROM ({count_sql(2, 'word')})), w AS (SELECT g, c, sum(c) OVER (PARTITION BY g) AS n, sum(c) OVER (PARTITION BY g, a) AS ca, sum(c) OVER (PARTITION BY g, b) AS cb FROM t) SELECT g, round(sum(c / n * log2(c * n / (ca * cb))), 5) AS mi FROM w GROUP BY g")
def mutual_information(spark, sf_dir):
    return _rounded(ev.mutual_information(_texts(spark, sf_dir)), "mi", digits=5)


@R.add("compression_diversity")
def compression(spark, sf_dir):
    return _rounded(ev.compression_diversity(_texts(spark, sf_dir)), "crd", "ratio")


def _matches(spark, sf_dir):
    d = _daily(spark, sf_dir)
    other = d.select("item", F.col("system").alias("b"), F.col("score").alias("w"))
    m = d.withColumnRenamed("system", "a").join(other, "item").where("a < b")
    return m.select(F.lit("all").alias("g"), F.concat_ws(" ", "item", "a", "b").alias("step"), "a", "b", F.when(F.col("score") > F.col("w"), 1.0).when(F.col("score") < F.col("w"), 0.0).otherwise(0.5).alias("score"))


@R.add("elo_ratings")
def elo(spark, sf_dir):
    return _rounded(ev.elo(_matches(spark, sf_dir)), "rating")


@R.add("bradley_terry")
def bradley_terry(spark, sf_dir):
    m = _matches(spark, sf_dir)
    return _rounded(ev.bradley_terry(m.select("a", "b", F.col("score").alias("n")).union(m.select("b", "a", 1 - F.col("score")))), "strength")


@R.add("majority_vote", f"WITH {VOTES}, c AS (SELECT item, vote, count(*)::DOUBLE AS w FROM votes GROUP BY ALL) SELECT item, vote AS winner, w AS support FROM c QUALIFY row_number() OVER (PARTITION BY item ORDER BY w DESC, vote) = 1")
def majority(spark, sf_dir):
    return ev.plurality(_votes(spark, sf_dir))


@R.add("weighted_vote", f"WITH {VOTES}, c AS (SELECT item, vote, round(sum(1 / (model + 1)), 9) AS w FROM votes GROUP BY ALL) SELECT item, vote AS winner, round(w, 6) AS support FROM c QUALIFY row_number() OVER (PARTITION BY item ORDER BY w DESC, vote) = 1")
def weighted(spark, sf_dir):
    return _rounded(ev.plurality(_votes(spark, sf_dir), 1 / (F.col("model") + 1)), "support")


@R.add("quality_diversity_archive", "WITH p AS (SELECT p_partkey AS id, p_retailprice AS score, greatest(least(floor(p_size / 51 * 8), 7), 0)::BIGINT * 8 + greatest(least(floor((p_partkey % 100) / 100 * 8), 7), 0)::BIGINT AS cell FROM part) SELECT cell, id, score FROM p QUALIFY row_number() OVER (PARTITION BY cell ORDER BY score DESC, id) = 1")
def qd_archive(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), (F.col("p_size") / 51).alias("x"), (F.col("p_partkey") % 100 / 100).alias("y"))
    return ev.archive(p, ["x", "y"], 8)


_PAIRED = f"WITH {DAILY}, p AS (SELECT a.system AS g, a.score AS x, b.score AS y FROM daily a JOIN daily b ON a.item = b.item AND b.system = 'view' AND a.system <> 'view')"


@R.add(
    "wilcoxon_signed_rank",
    f"""{_PAIRED}, d AS (SELECT g, round(x - y, 12) AS d FROM p WHERE round(x - y, 12) <> 0), r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2 AS r FROM d),
    s AS (SELECT g, count(*)::DOUBLE AS n, coalesce(sum(r) FILTER (d > 0), 0) AS plus, coalesce(sum(r) FILTER (d < 0), 0) AS minus FROM r GROUP BY g) SELECT g, plus, minus, round((plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s""",
)
def wilcoxon(spark, sf_dir):
    d = _daily(spark, sf_dir)
    p = d.where("system <> 'view'").select("item", F.col("system").alias("g"), F.col("score").alias("x")).join(d.where("system = 'view'").select("item", F.col("score").alias("y")), "item")
    return _rounded(ev.wilcoxon(p, ["g"]), "z")


@R.add("friedman_test", f"WITH {DAILY}, r AS (SELECT system, rank() OVER (PARTITION BY item ORDER BY score DESC) + (count(*) OVER (PARTITION BY item, score) - 1) / 2 AS r FROM daily), m AS (SELECT system, sum(r) AS s, count(*) AS n FROM r GROUP BY 1), c AS (SELECT 12 / (max(n) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * max(n) * (count(*) + 1) AS chi, max(n) * (count(*) - 1) AS d FROM m) SELECT round(chi, 5) AS chi_square, round(chi / d, 6) AS w FROM c")
def friedman(spark, sf_dir):
    return _rounded(_rounded(ev.friedman(_daily(spark, sf_dir)), "chi_square", digits=5), "w")


@R.add("bootstrap_interval")
def bootstrap(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("g"), F.col("event_id").alias("id"), "value")
    return _rounded(ev.bootstrap_mean(rows, ["g"], "value", 100, 42), "mean", "low", "high")


@R.add(
    "item_novelty",
    """WITH v AS (SELECT vec_id % 10 AS u, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), h AS (SELECT * FROM v WHERE id % 3 <> 1), i AS (SELECT * FROM v WHERE id % 3 = 1),
    c AS (SELECT u, list(m ORDER BY k) AS c FROM (SELECT u, k, avg(x) AS m FROM (SELECT u, unnest(v) AS x, unnest(range(len(v))) AS k FROM h) GROUP BY ALL) GROUP BY u)
    SELECT i.u, i.id, round(any_value(list_distance(i.v, c.c)), 5) AS surprise, round(min(list_distance(i.v, h.v)), 5) AS novelty FROM i JOIN c USING (u) JOIN h USING (u) GROUP BY i.u, i.id""",
)
def item_novelty(spark, sf_dir):
    """Every embedding is an item or in a history."""
    v = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("u"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return _rounded(ev.novelty_of_items(v.where("id % 3 = 1"), v.where("id % 3 <> 1").select("u", "v")), "surprise", "novelty", digits=5)


@R.add("sequence_distances")
def distances(spark, sf_dir):
    """Of whole texts and all neighbours; no SQL, since DuckDB's Levenshtein counts bytes."""
    d = docs(spark, sf_dir)
    p = d.select(F.col("doc_id").alias("id"), F.col("text").alias("a")).join(d.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("b")), "id")
    return _rounded(_rounded(ev.sequence_distances(p), "hamming", "jaccard"), "edit", digits=3)
