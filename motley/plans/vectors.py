"""Queries over embeddings, and ranked lists made from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from motley.operators import blocks as bl
from motley.operators import ranking as rk
from motley.operators import rerank as rr
from motley.operators import vectors as vc
from motley.plans.common import Registry, read

R = Registry()

VECTORS = "v AS (SELECT label AS g, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
LONG = f"{VECTORS}, x AS (SELECT g, id, unnest(v) AS x, unnest(range(len(v))) AS k FROM v)"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _rounded(df, *columns, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@R.add("embedding_moments", f"WITH {LONG}, p AS (SELECT g, k, count(*) AS n, avg(x) AS m, var_pop(x) AS vp, var_samp(x) AS vs FROM x GROUP BY ALL) SELECT g, max(n) AS n, round(sqrt(sum(vp)), 5) AS gyration, round(avg(vs), 5) AS dispersion, round(sqrt(sum(m * m)), 5) AS centroid_norm FROM p GROUP BY g")
def moments(spark, sf_dir):
    return _rounded(vc.moments(_vectors(spark, sf_dir)), "gyration", "dispersion", "centroid_norm")


@R.add("centroid_distance", f"WITH {LONG}, c AS (SELECT g, k, avg(x) AS m FROM x GROUP BY ALL), d AS (SELECT x.g, id, sqrt(sum((x - m) ** 2)) AS d FROM x JOIN c ON c.g = x.g AND c.k = x.k GROUP BY ALL) SELECT g, round(avg(d), 5) AS mean, round(max(d), 5) AS radius FROM d GROUP BY g")
def centroid(spark, sf_dir):
    return _rounded(vc.centroid_distance(_vectors(spark, sf_dir)), "mean", "radius")


@R.add("mean_cosine_distance", f"WITH {VECTORS} SELECT a.g, round(avg(1 - list_cosine_similarity(a.v, b.v)), 5) AS value FROM v a JOIN v b ON a.g = b.g AND a.id < b.id GROUP BY a.g")
def mean_cosine(spark, sf_dir):
    return _rounded(vc.mean_cosine_distance(_vectors(spark, sf_dir)), "value")


_DISTANCES = {"euclidean": "list_distance(a.v, b.v)", "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))", "chebyshev": "list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))", "cosine": "1 - list_cosine_similarity(a.v, b.v)"}


def pairs_sql(expression: str) -> str:
    return f"pairs AS (SELECT a.g, a.id AS a, b.id AS b, {expression} AS d FROM v a JOIN v b ON a.g = b.g AND a.id < b.id)"


for _name, _sql in _DISTANCES.items():

    def _pairs(spark, sf_dir, distance=_name):
        return _rounded(bl.distance_summary(_vectors(spark, sf_dir), distance), "mean", "median", "spread", "diameter", "variance", "total", digits=4)

    R.add(f"pairwise_{_name}", f"WITH {VECTORS}, {pairs_sql(_sql)} SELECT g, count(*) AS n_pairs, round(avg(d), 4) AS mean, round(median(d), 4) AS median, round(min(d), 4) AS spread, round(max(d), 4) AS diameter, round(var_pop(d), 4) AS variance, round(sum(d), 4) AS total FROM pairs GROUP BY g")(_pairs)


@R.add("distance_entropy", f"WITH {VECTORS}, {pairs_sql('list_distance(a.v, b.v)')}, l AS (SELECT g, min(d) AS low, (max(d) - min(d)) / 30 AS w FROM pairs GROUP BY g), c AS (SELECT g, least(floor((d - low) / w), 29) AS bin, count(*)::DOUBLE AS c FROM pairs JOIN l USING (g) GROUP BY ALL) SELECT g, round((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(30), 4) AS entropy FROM c GROUP BY g")
def distance_entropy(spark, sf_dir):
    return _rounded(bl.distance_entropy(_vectors(spark, sf_dir)), "entropy", digits=4)


@R.add("nearest_neighbours", f"WITH {VECTORS}, n AS (SELECT a.g, a.id, b.id AS neighbour, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY round(d, 9), neighbour) AS rank FROM n) SELECT g, id, neighbour, round(d, 5) AS d, rank FROM r WHERE rank <= 3")
def neighbours(spark, sf_dir):
    return _rounded(bl.nearest_rows(_vectors(spark, sf_dir), 3), "d")


@R.add("certified_upper_bound", f"WITH {VECTORS}, {pairs_sql('list_distance(a.v, b.v)')}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d DESC, a, b) AS r FROM pairs) SELECT g, round(sum(d), 4) AS sum_bound, round(min(d), 5) AS spread_bound FROM r WHERE r <= 10 GROUP BY g")
def upper_bound(spark, sf_dir):
    top = bl.furthest_pairs(_vectors(spark, sf_dir), 10)
    return top.groupBy("g").agg(F.round(F.sum("d"), 4).alias("sum_bound"), F.round(F.min("d"), 5).alias("spread_bound"))


@R.add("threshold_dedup_edges", f"WITH {VECTORS}, {pairs_sql('list_cosine_similarity(a.v, b.v)')} SELECT g, a, b, round(d, 5) AS similarity FROM pairs WHERE d >= 0.3")
def dedup_edges(spark, sf_dir):
    return _rounded(bl.alike_pairs(_vectors(spark, sf_dir), 0.3), "similarity")


@R.add("individual_fairness", f"WITH {VECTORS}, p AS (SELECT list_distance(a.v, b.v) AS d, a.g = b.g AS same FROM v a JOIN v b ON a.id < b.id) SELECT round(avg(d) FILTER (same) / avg(d) FILTER (NOT same), 5) AS ratio FROM p")
def individual_fairness(spark, sf_dir):
    return _rounded(bl.fairness_ratio(_vectors(spark, sf_dir)), "ratio")


@R.add("vendi_score")
def vendi(spark, sf_dir):
    return _rounded(vc.vendi(_vectors(spark, sf_dir)), "vendi")


_SQUARES = "c AS (SELECT a.g, b.g AS h, a.id % 4 + 1 AS qa, b.id % 4 + 1 AS qb, list_cosine_similarity(a.v, b.v) ** 2 AS c FROM v a JOIN v b ON {on})"


@R.add("vendi_order_2", f"WITH {VECTORS}, {_SQUARES.format(on='a.g = b.g')} SELECT g, sqrt(count(*))::BIGINT AS n, round(count(*) / sum(c), 5) AS vendi FROM c GROUP BY g")
def vendi_2(spark, sf_dir):
    return _rounded(vc.vendi(_vectors(spark, sf_dir), 2.0), "vendi")


@R.add("vendi_weighted", f"WITH {VECTORS}, {_SQUARES.format(on='a.g = b.g')}, q AS (SELECT g, sum(id % 4 + 1)::DOUBLE AS n FROM v GROUP BY g) SELECT g, n, round(n * n / sum(qa * qb * c), 5) AS vendi FROM c JOIN q USING (g) GROUP BY g, n")
def vendi_weighted(spark, sf_dir):
    return _rounded(vc.vendi(_vectors(spark, sf_dir), 2.0, weight=F.col("id") % 4 + 1), "vendi")


@R.add(
    "vendi_of_sets",
    f"""WITH {VECTORS}, {_SQUARES.format(on='b.g BETWEEN a.g - 1 AND a.g + 1')}, s AS (SELECT g AS a, h AS b, sum(c) AS s, count(*) AS k FROM c GROUP BY ALL), n AS (SELECT g, count(*) AS n FROM v GROUP BY g),
    x AS (SELECT p.a, p.b, na.n ** 2 / sa.s AS va, nb.n ** 2 / sb.s AS vb, (na.n + nb.n) ** 2 / (sa.s + sb.s + 2 * p.s) AS u FROM s p JOIN s sa ON sa.a = p.a AND sa.b = p.a JOIN s sb ON sb.a = p.b AND sb.b = p.b JOIN n na ON na.g = p.a JOIN n nb ON nb.g = p.b WHERE p.b = p.a + 1)
    SELECT a, b, round(va, 5) AS vendi_a, round(vb, 5) AS vendi_b, round(u, 5) AS vendi_union, round(u - va, 5) AS b_adds, round(u - vb, 5) AS a_adds, round(u - va - vb + least(va, vb), 5) AS synergy, round(greatest(1 - u / (va + vb), 0), 5) AS redundancy FROM x""",
)
def vendi_of_sets(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    follow = v.select(F.col("g").alias("a"), (F.col("g") + 1).alias("b")).distinct()
    out = vc.vendi_of_sets(v, follow, 2.0)
    return _rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


@R.add(
    "similarity_scores",
    f"""WITH {VECTORS}, c AS (SELECT a.g, a.id, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id), n AS (SELECT g, count(*) AS n FROM v GROUP BY g), l AS (SELECT g, id, max(c) AS m, list_reverse_sort(list_append(list(c), 0)) AS l FROM c GROUP BY ALL)
    SELECT v.g, v.id, round(coalesce(greatest(least(1 - m, 1), 0), 0), 5) AS novelty, coalesce(m >= 0.9, false) AS redundant, round(CASE WHEN n > 1 THEN list_avg(l[1:least(3, n - 1)]) ELSE 0 END, 5) AS redundancy FROM v JOIN n USING (g) LEFT JOIN l ON l.g = v.g AND l.id = v.id""",
)
def similarity_scores(spark, sf_dir):
    return _rounded(bl.similarity_scores(_vectors(spark, sf_dir)), "novelty", "redundancy")


@R.add("neighbour_uniformity", f"WITH {VECTORS}, d AS (SELECT a.g, a.id, min(list_distance(a.v, b.v)) AS d FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id GROUP BY ALL) SELECT g, round(avg(d), 5) AS mean, round(stddev_pop(d), 5) AS deviation, round(stddev_pop(d) / greatest(avg(d), 1e-12), 5) AS cv FROM d GROUP BY g")
def neighbour_uniformity(spark, sf_dir):
    return _rounded(bl.neighbour_uniformity(_vectors(spark, sf_dir)), "mean", "deviation", "cv")


_KERNELS = {"rbf": "exp(-sq / (2 * h * h + 1e-12))", "imq": "1 / sqrt(1 + sq / (h * h + 1e-12))", "laplacian": "exp(-l1 / (h + 1e-12))", "cosine": "c", "polynomial": "(dot + 1) ** 2"}


@R.add(
    "kernel_sensitivity",
    f"""WITH {VECTORS}, p AS (SELECT a.g, list_distance(a.v, b.v) ** 2 AS sq, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) AS l1, list_inner_product(a.v, b.v) AS dot, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.g = b.g AND a.id < b.id), w AS (SELECT p.*, h FROM p, (VALUES (0.5::DOUBLE), (1.0), (2.0)) t(h))
    """
    + " UNION ALL ".join(f"SELECT g, '{name}' AS kernel, h AS bandwidth, round(1 - avg({sql}), 4) AS epd FROM w GROUP BY g, h" for name, sql in _KERNELS.items()),
)
def kernel_sensitivity(spark, sf_dir):
    return _rounded(bl.kernel_distances(_vectors(spark, sf_dir)), "epd", digits=4)


@R.add(
    "coverage_precision_recall",
    f"""WITH {VECTORS}, d AS (SELECT a.g, a.id, min(list_distance(a.v, b.v)) AS d FROM v a JOIN v b ON a.g = b.g AND a.id % 2 <> b.id % 2 GROUP BY ALL), s AS (SELECT g, r AS radius, avg((d <= r)::INT) FILTER (id % 2 = 0) AS p, avg((d <= r)::INT) FILTER (id % 2 = 1) AS c FROM d, (VALUES (0.5::DOUBLE), (1.0), (1.25)) t(r) GROUP BY ALL)
    SELECT g, radius, round(p, 6) AS precision, round(c, 6) AS recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 6) AS f FROM s""",
)
def coverage_precision_recall(spark, sf_dir):
    """Even ids are the selected rows, odd ids the reference."""
    v = _vectors(spark, sf_dir)
    return _rounded(bl.coverage(v.where("id % 2 = 0"), v.where("id % 2 = 1"), (0.5, 1.0, 1.25)), "precision", "recall", "f", digits=6)


@R.add("mean_pooling", "SELECT doc_group AS g, k, round(avg(x), 5) AS mean, round(max(x), 5) AS high, round(min(x), 5) AS low FROM (SELECT vec_id % 16 AS doc_group, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY ALL")
def pooling(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 16).alias("g"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    return x.groupBy("g", F.col("k").cast("long").alias("k")).agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.max("x"), 5).alias("high"), F.round(F.min("x"), 5).alias("low"))


LISTS = "ranked AS (SELECT user_id AS q, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 20), topics AS (SELECT event_id AS item, event_type AS topic FROM events UNION SELECT event_id, 'k' || event_id % 7 FROM events)"


def _ranked(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = e.select(F.col("user_id").alias("q"), F.col("event_id").alias("item"), F.row_number().over(order).alias("rank")).where("rank <= 20")
    topics = e.select(F.col("event_id").alias("item"), F.col("event_type").alias("topic")).union(e.select("event_id", F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string"))))
    return ranked, topics


_SEEN = "row_number() OVER (PARTITION BY q, topic ORDER BY rank, item) - 1"


@R.add("alpha_dcg", f"WITH {LISTS} SELECT q, round(sum(g), 5) AS alpha_dcg FROM (SELECT q, 0.5 ** ({_SEEN}) / log2(rank + 1) AS g FROM ranked JOIN topics USING (item) WHERE rank <= 10) GROUP BY q")
def alpha_dcg(spark, sf_dir):
    return _rounded(rk.alpha_dcg(*_ranked(spark, sf_dir), 0.5, 10), "alpha_dcg")


@R.add("subtopic_recall", f"WITH {LISTS} SELECT q, round(count(DISTINCT topic) / (SELECT count(DISTINCT topic) FROM topics), 5) AS s_recall FROM ranked JOIN topics USING (item) WHERE rank <= 10 GROUP BY q")
def subtopic_recall(spark, sf_dir):
    return _rounded(rk.subtopic_recall(*_ranked(spark, sf_dir), 10), "s_recall")


@R.add("err_intent_aware", f"WITH {LISTS} SELECT q, round(sum(g) / (SELECT count(DISTINCT topic) FROM topics), 5) AS err_ia FROM (SELECT q, 0.5 ** ({_SEEN}) * 0.5 / rank AS g FROM ranked JOIN topics USING (item) WHERE rank <= 10) GROUP BY q")
def err_ia(spark, sf_dir):
    return _rounded(rk.err_ia(*_ranked(spark, sf_dir), 0.5, 10), "err_ia")


@R.add(
    "calibration_kl",
    f"""WITH {LISTS}, t AS (SELECT event_type AS topic, count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1), c AS (SELECT q, topic, count(*) AS c FROM ranked JOIN topics USING (item) GROUP BY ALL),
    f AS (SELECT q, topic, p, coalesce(c, 0) AS c FROM (SELECT DISTINCT q FROM ranked) CROSS JOIN t LEFT JOIN c USING (q, topic)), s AS (SELECT *, greatest(c / sum(c) OVER (PARTITION BY q), 1e-10) AS l FROM f), n AS (SELECT q, p / sum(p) OVER (PARTITION BY q) AS t, l / sum(l) OVER (PARTITION BY q) AS l FROM s)
    SELECT q, round(sum(t * ln(t / l)), 5) AS kl FROM n GROUP BY q""",
)
def calibration(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    target = e.groupBy(F.col("event_type").alias("topic")).agg((F.count(F.lit(1)) / F.sum(F.count(F.lit(1))).over(Window.partitionBy(F.lit(0)))).alias("p"))
    return _rounded(rk.calibration(*_ranked(spark, sf_dir), target), "kl")


@R.add("exposure_fairness", f'WITH {LISTS}, e AS (SELECT event_type AS "group", sum(1 / log2(rank + 1)) AS w FROM ranked JOIN events ON event_id = item GROUP BY 1), s AS (SELECT "group", w / sum(w) OVER () AS share FROM e) SELECT "group", round(share, 5) AS share, round(1 - (max(share) OVER () - min(share) OVER ()), 5) AS fairness FROM s')
def exposure(spark, sf_dir):
    groups = read(spark, sf_dir, "events").select(F.col("event_id").alias("item"), F.col("event_type").alias("group"))
    return _rounded(rk.exposure(_ranked(spark, sf_dir)[0], groups), "share", "fairness")


@R.add("item_coverage", f"WITH {LISTS} SELECT round(count(DISTINCT item) / (SELECT count(*) FROM events), 5) AS coverage FROM ranked")
def item_coverage(spark, sf_dir):
    return _rounded(rk.item_coverage(_ranked(spark, sf_dir)[0], read(spark, sf_dir, "events")), "coverage")


for _method in rr.METHODS:

    def _rerank(spark, sf_dir, method=_method):
        e = read(spark, sf_dir, "events")
        candidates = e.select(F.col("user_id").alias("q"), F.col("event_id").alias("item"), F.col("value").alias("relevance"))
        return rr.rerank(candidates, _ranked(spark, sf_dir)[1], 10, method)

    R.add(f"rerank_{_method}")(_rerank)
