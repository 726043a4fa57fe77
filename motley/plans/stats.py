"""Statistics, ranking, agreement and multi-objective queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motley.operators import stats as st
from motley.operators.results import pareto_front
from motley.plans.common import Registry, docs, read

R = Registry()


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


def _daily(spark, sf_dir):
    """Mean event value of each day and type: (item, system, score)."""
    return read(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("item"), F.col("event_type").alias("system")).agg(F.avg("value").alias("score"))


DAILY = "daily AS (SELECT strftime(ts, '%Y-%m-%d') AS item, event_type AS system, avg(value) AS score FROM events GROUP BY ALL)"
RANK = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2"


@R.add("pearson_correlation", "SELECT l_returnflag AS g, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson(spark, sf_dir):
    return _rounded(_lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("g")).agg(st.safe_corr(F.col("l_quantity"), F.col("l_extendedprice")).alias("r")), "r")


@R.add("spearman_correlation", f"SELECT g, round(corr(x, y), 6) AS rho FROM (SELECT l_returnflag AS g, {RANK.format(by='l_returnflag', v='l_quantity')} AS x, {RANK.format(by='l_returnflag', v='l_extendedprice')} AS y FROM lineitem) GROUP BY g")
def spearman(spark, sf_dir):
    return _rounded(st.spearman(_lines(spark, sf_dir).withColumnRenamed("l_returnflag", "g"), "l_quantity", "l_extendedprice", ["g"]), "rho")


@R.add("partial_correlation", "SELECT g, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM (SELECT l_returnflag AS g, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem GROUP BY 1)")
def partial(spark, sf_dir):
    return _rounded(st.partial_correlation(_lines(spark, sf_dir).withColumnRenamed("l_returnflag", "g"), "l_quantity", "l_extendedprice", "l_discount", ["g"]), "partial")


@R.add(
    "kendall_tau_matrix",
    f"""WITH {DAILY}, s AS (SELECT x.item AS i, y.item AS j, x.system AS m, sign(x.score - y.score) AS s FROM daily x JOIN daily y ON x.system = y.system AND x.item < y.item)
    SELECT a.m AS a, b.m AS b, round(sum(a.s * b.s) / sqrt(sum(abs(a.s)) * sum(abs(b.s))), 6) AS tau FROM s a JOIN s b ON a.i = b.i AND a.j = b.j AND a.m < b.m GROUP BY ALL""",
)
def kendall(spark, sf_dir):
    return _rounded(st.kendall_tau_b(_daily(spark, sf_dir), "item", "system", "score"), "tau")


@R.add(
    "multiple_test_corrections",
    """WITH t AS (SELECT s_suppkey AS id, (s_acctbal + 1000) / 12000 AS p, (count(*) OVER ())::DOUBLE AS n, row_number() OVER (ORDER BY (s_acctbal + 1000) / 12000, s_suppkey) AS r FROM supplier),
    h AS (SELECT sum(1.0::DOUBLE / k) AS h FROM range(1, (SELECT count(*) + 1 FROM supplier)) x(k))
    SELECT id, round(least(p * n, 1), 6) AS bonferroni, round(least(max(p * (n - r + 1)) OVER (ORDER BY r), 1), 6) AS holm,
    round(least(min(p * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS bh,
    round(least(min(p * n / r * h) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS by FROM t, h""",
)
def corrections(spark, sf_dir):
    tests = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_acctbal") + 1000) / 12000).alias("p"))
    return _rounded(st.corrected_p(tests), "bonferroni", "holm", "bh", "by")


@R.add(
    "two_sample_effects",
    f"""WITH v AS (SELECT l_returnflag AS g, l_linestatus AS s, l_extendedprice AS v FROM lineitem), r AS (SELECT *, {RANK.format(by="g", v="v")} AS r FROM v),
    a AS (SELECT g, (count(*) FILTER (s = 'F'))::DOUBLE AS nx, (count(*) FILTER (s = 'O'))::DOUBLE AS ny, avg(v) FILTER (s = 'F') AS mx, avg(v) FILTER (s = 'O') AS my, var_samp(v) FILTER (s = 'F') AS vx, var_samp(v) FILTER (s = 'O') AS vy, sum(r) FILTER (s = 'F') AS rx FROM r GROUP BY g),
    d AS (SELECT *, (mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)) AS d, rx - nx * (nx + 1) / 2 AS u FROM a)
    SELECT g, round(d, 6) AS cohens_d, round(d * (1 - 3 / (4 * (nx + ny - 2) - 1)), 6) AS hedges_g, round((mx - my) / sqrt(vy), 6) AS glass_delta, round(2 * u / (nx * ny) - 1, 6) AS cliffs_delta, round(u / (nx * ny), 6) AS cles, round(1 - 2 * u / (nx * ny), 6) AS rank_biserial FROM d""",
)
def effects(spark, sf_dir):
    out = st.two_sample_effects(_lines(spark, sf_dir).withColumnRenamed("l_returnflag", "g"), ["g"], "l_linestatus", "l_extendedprice", "F", "O")
    return _rounded(out, "cohens_d", "hedges_g", "glass_delta", "cliffs_delta", "cles", "rank_biserial")


@R.add(
    "outlier_flags",
    """WITH q AS (SELECT c_mktsegment AS g, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2, quantile_cont(c_acctbal, 0.75) AS q3, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1),
    x AS (SELECT c_custkey AS id, c_mktsegment AS g, c_acctbal AS v, q.* EXCLUDE (g) FROM customer JOIN q ON q.g = c_mktsegment), d AS (SELECT g, median(abs(v - q2)) AS mad FROM x GROUP BY g)
    SELECT id, g, v, v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS by_iqr, abs(v - m) / s > 3 AS by_z, abs(0.6745 * (v - q2) / mad) > 3.5 AS by_mad FROM x JOIN d USING (g)""",
)
def outliers(spark, sf_dir):
    return st.outliers(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("v")), ["g"], "v")


@R.add("concordance_correlation", "SELECT g, round(2 * r * sx * sy / (sx * sx + sy * sy + (mx - my) ** 2), 6) AS ccc FROM (SELECT l_returnflag AS g, corr(l_discount, l_tax) AS r, stddev_samp(l_discount) AS sx, stddev_samp(l_tax) AS sy, avg(l_discount) AS mx, avg(l_tax) AS my FROM lineitem GROUP BY 1)")
def ccc(spark, sf_dir):
    return _rounded(st.concordance(_lines(spark, sf_dir).withColumnRenamed("l_returnflag", "g"), "l_discount", "l_tax", ["g"]), "ccc")


@R.add(
    "rank_summary",
    f"""WITH {DAILY}, r AS (SELECT *, rank() OVER (PARTITION BY item ORDER BY score DESC) + (count(*) OVER (PARTITION BY item, score) - 1) / 2 AS r, count(*) OVER (PARTITION BY item) AS k FROM daily),
    w AS (SELECT a.system, b.system AS o, avg((a.score > b.score)::INT) AS win FROM daily a JOIN daily b ON a.item = b.item AND a.system <> b.system GROUP BY ALL), c AS (SELECT system, sum(CASE WHEN win > 0.5 THEN 1 WHEN win < 0.5 THEN -1 ELSE 0 END)::BIGINT AS copeland FROM w GROUP BY 1)
    SELECT system, round(avg(r), 6) AS mean_rank, round(avg(1 / r), 6) AS mrr, round(stddev_samp(r), 6) AS rank_std, round(sum(k - r), 6) AS borda, max(copeland) AS copeland FROM r JOIN c USING (system) GROUP BY system""",
)
def ranks(spark, sf_dir):
    return _rounded(st.rank_summary(_daily(spark, sf_dir), "item", "system", "score"), "mean_rank", "mrr", "rank_std", "borda")


@R.add(
    "head_to_head",
    f"WITH {DAILY} SELECT a.system AS a, b.system AS b, count(*) FILTER (a.score - b.score >= 1e-12) AS wins, count(*) FILTER (a.score - b.score <= -1e-12) AS losses, count(*) FILTER (abs(a.score - b.score) < 1e-12) AS ties, round((count(*) FILTER (a.score - b.score >= 1e-12) + count(*) FILTER (abs(a.score - b.score) < 1e-12) / 2) / count(*), 6) AS win_rate FROM daily a JOIN daily b ON a.item = b.item AND a.system <> b.system GROUP BY ALL",
)
def duels(spark, sf_dir):
    return _rounded(st.head_to_head(_daily(spark, sf_dir), "item", "system", "score"), "win_rate")


VOTES = "votes AS (SELECT doc_id AS item, k AS model, (quality + (doc_id % (k + 3) = 0)::INT) % 2 AS vote, quality AS truth FROM labels, range(5) r(k))"


def _votes(spark, sf_dir):
    models = read(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return models.select(F.col("doc_id").alias("item"), F.col("k").cast("long").alias("model"), ((F.col("quality") + (F.col("doc_id") % (F.col("k") + 3) == 0).cast("int")) % 2).alias("vote"), F.col("quality").alias("truth"))


@R.add(
    "ensemble_diversity",
    f"""WITH {VOTES}, t AS (SELECT a.model AS a, b.model AS b, avg((a.vote <> b.vote)::INT) AS disagreement, (count(*) FILTER (a.vote = a.truth AND b.vote = b.truth))::DOUBLE AS p, (count(*) FILTER (a.vote <> a.truth AND b.vote <> b.truth))::DOUBLE AS q,
    (count(*) FILTER (a.vote = a.truth AND b.vote <> b.truth))::DOUBLE AS r, (count(*) FILTER (a.vote <> a.truth AND b.vote = b.truth))::DOUBLE AS s, count(*) AS n FROM votes a JOIN votes b ON a.item = b.item AND a.model < b.model GROUP BY ALL)
    SELECT a, b, round(disagreement, 6) AS disagreement, round(CASE WHEN abs(p * q + r * s) < 1e-15 THEN 0 ELSE (p * q - r * s) / (p * q + r * s) END, 6) AS q_statistic, round(CASE WHEN (p + r) * (p + s) * (q + r) * (q + s) <= 0 THEN 0 ELSE (p * q - r * s) / sqrt((p + r) * (p + s) * (q + r) * (q + s)) END, 6) AS rho, round(q / n, 6) AS double_fault FROM t""",
)
def ensemble(spark, sf_dir):
    return _rounded(st.ensemble_diversity(_votes(spark, sf_dir)), "disagreement", "q_statistic", "rho", "double_fault")


@R.add(
    "vote_entropy",
    f"""WITH {VOTES}, c AS (SELECT item, truth, vote, count(*) AS c FROM votes GROUP BY ALL), m AS (SELECT item, arg_max(vote, c * 10 - vote) AS majority FROM c GROUP BY item),
    p AS (SELECT item, truth, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h, coalesce(sum(c) FILTER (vote = truth), 0) / sum(c) AS p FROM c GROUP BY ALL)
    SELECT round(avg(h), 6) AS vote_entropy, round(avg(p * (1 - p)), 6) AS kw_variance, round(avg((majority = truth)::INT), 6) AS majority_accuracy FROM p JOIN m USING (item)""",
)
def votes(spark, sf_dir):
    return _rounded(st.vote_entropy(_votes(spark, sf_dir)), "vote_entropy", "kw_variance", "majority_accuracy")


RATINGS = "ratings AS (SELECT doc_id AS item, quality + toxic AS a, (quality + doc_id % 3)::INT AS b FROM labels)"


def _ratings(spark, sf_dir):
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), (F.col("quality") + F.col("toxic")).alias("a"), (F.col("quality") + F.col("doc_id") % 3).cast("int").alias("b"))


for _w in (False, True):
    _cost = "(x.a - y.b) ** 2" if _w else "(x.a <> y.b)::INT"

    def _kappa(spark, sf_dir, weighted=_w):
        return _rounded(st.cohen_kappa(_ratings(spark, sf_dir), weighted), "kappa")

    R.add("cohen_kappa_weighted" if _w else "cohen_kappa", f"WITH {RATINGS} SELECT round(1 - (SELECT avg({_cost.replace('y.b', 'x.b')}) FROM ratings x) / (SELECT avg({_cost}) FROM ratings x, ratings y), 6) AS kappa")(_kappa)


@R.add(
    "krippendorff_compat",
    f"WITH {RATINGS} SELECT round(1 - avg((a - b) ** 2) / (SELECT var_pop(v) FROM (SELECT a AS v FROM ratings UNION ALL SELECT b FROM ratings)), 6) AS alpha FROM ratings",
)
def krippendorff(spark, sf_dir):
    both = _ratings(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("v"), F.lit(0).alias("k")).agg(F.var_pop("v").alias("v"))
    return _ratings(spark, sf_dir).agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("d")).crossJoin(both).select(F.round(1 - F.col("d") / F.col("v"), 6).alias("alpha"))


@R.add(
    "fleiss_kappa",
    f"""WITH {VOTES}, c AS (SELECT item, vote, count(*)::DOUBLE AS c FROM votes GROUP BY ALL), s AS (SELECT avg(x) AS seen FROM (SELECT sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) AS x FROM c GROUP BY item)),
    e AS (SELECT sum(p * p) AS chance FROM (SELECT sum(c) / (SELECT sum(c) FROM c) AS p FROM c GROUP BY vote)) SELECT round((seen - chance) / (1 - chance), 6) AS kappa FROM s, e""",
)
def fleiss(spark, sf_dir):
    return _rounded(st.fleiss_kappa(_votes(spark, sf_dir).select("item", F.col("vote").alias("category"))), "kappa")


@R.add(
    "intraclass_correlation",
    """WITH g AS (SELECT n_name AS g, count(*)::DOUBLE AS n, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS ss FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
    a AS (SELECT count(*)::DOUBLE AS k, sum(n) AS nn, sum(n * n) AS n2, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM g), m AS (SELECT (b - s * s / nn) / (k - 1) AS msb, (ss - b) / (nn - k) AS msw, (nn - n2 / nn) / (k - 1) AS n0 FROM a)
    SELECT round(msb, 2) AS ms_between, round(msw, 2) AS ms_within, round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc FROM m""",
)
def icc(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return _rounded(_rounded(st.icc_oneway(rows, "n_name", "c_acctbal"), "ms_between", "ms_within", digits=2), "icc")


@R.add("gini_coefficient", "SELECT g, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT o_orderstatus AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS i FROM orders) GROUP BY g")
def gini(spark, sf_dir):
    return _rounded(st.gini(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_totalprice").alias("v")), ["g"], "v"), "gini")


@R.add("group_balance", "WITH c AS (SELECT label AS g, count(*) AS n FROM embeddings GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k, max(n) / min(n) AS ratio FROM c) SELECT g, n, round(n / t - 1 / k, 4) AS parity, round((SELECT sum((n - t / k) ** 2 / (t / k)) FROM c, t), 6) AS chi_square, round(ratio, 6) AS ratio FROM c, t")
def balance(spark, sf_dir):
    return _rounded(st.group_balance(read(spark, sf_dir, "embeddings"), "label"), "chi_square", "ratio")


POINTS = "points AS (SELECT p_brand AS g, p_partkey AS id, p_retailprice / 2000 AS x, p_size / 50 AS y FROM part)"
FRONT = f"{POINTS}, front AS (SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM points q WHERE q.g = p.g AND q.x >= p.x AND q.y >= p.y AND (q.x > p.x OR q.y > p.y)))"


def _points(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("x"), (F.col("p_size") / 50).alias("y"))


@R.add(
    "hypervolume_2d",
    f"""WITH {POINTS}, p AS (SELECT g, x, min(y) AS y FROM points WHERE x < 1.2 AND y < 1.2 GROUP BY ALL), s AS (SELECT g, coalesce(lead(x) OVER (PARTITION BY g ORDER BY x), 1.2) - x AS w, min(y) OVER (PARTITION BY g ORDER BY x) AS low FROM p)
    SELECT g, round(sum(w * (1.2 - low)), 6) AS hypervolume FROM s GROUP BY g""",
)
def hypervolume(spark, sf_dir):
    return _rounded(st.hypervolume_2d(_points(spark, sf_dir), ["g"], "x", "y", (1.2, 1.2)), "hypervolume")


@R.add(
    "crowding_distance",
    f"""WITH {FRONT}, w AS (SELECT g, id, count(*) OVER (PARTITION BY g) AS n, max(x) OVER (PARTITION BY g) - min(x) OVER (PARTITION BY g) AS rx, max(y) OVER (PARTITION BY g) - min(y) OVER (PARTITION BY g) AS ry,
    lead(x) OVER (PARTITION BY g ORDER BY x, id) - lag(x) OVER (PARTITION BY g ORDER BY x, id) AS gx, lead(y) OVER (PARTITION BY g ORDER BY y, id) - lag(y) OVER (PARTITION BY g ORDER BY y, id) AS gy FROM front)
    SELECT g, id, n > 2 AND (rx <= 0 OR gx IS NOT NULL) AND (ry <= 0 OR gy IS NOT NULL) AS inner_point, CASE WHEN inner_point THEN round(CASE WHEN rx > 0 THEN gx / rx ELSE 0 END + CASE WHEN ry > 0 THEN gy / ry ELSE 0 END, 6) END AS crowding FROM w""",
)
def crowding(spark, sf_dir):
    """All points of the fronts; where the distance is infinite, at the ends, it is null and ``inner_point`` false."""
    found = st.crowding_distance(pareto_front(_points(spark, sf_dir), ["x", "y"], ["g"]), ["g"], ["x", "y"])
    inner = F.col("crowding") < float("inf")
    return found.select("g", "id", inner.alias("inner_point"), F.when(inner, F.round("crowding", 6)).alias("crowding"))


@R.add(
    "front_spacing",
    f"WITH {FRONT}, d AS (SELECT a.g, a.id, sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM front a JOIN front b ON a.g = b.g AND a.id <> b.id GROUP BY ALL) SELECT g, round(coalesce(stddev_samp(d), 0), 6) AS spacing FROM d GROUP BY g",
)
def spacing(spark, sf_dir):
    front = pareto_front(_points(spark, sf_dir), ["x", "y"], ["g"])
    return st.nearest_distances(front, front, ["g"], ["x", "y"]).groupBy("g").agg(F.round(F.coalesce(F.stddev_samp("distance"), F.lit(0.0)), 6).alias("spacing"))


@R.add(
    "generational_distance",
    f"""WITH {POINTS}, d AS (SELECT a.g, a.id, sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM points a JOIN points b ON a.g = b.g AND a.id <> b.id AND b.id % 2 = 0 WHERE a.id % 2 = 1 GROUP BY ALL)
    SELECT g, round(sqrt(sum(d * d) / count(*)), 6) AS gd, round(avg(d), 6) AS igd FROM d GROUP BY g""",
)
def generational(spark, sf_dir):
    p = _points(spark, sf_dir)
    d = st.nearest_distances(p.where("id % 2 = 1"), p.where("id % 2 = 0"), ["g"], ["x", "y"])
    return d.groupBy("g").agg(F.round(F.sqrt(F.sum(F.col("distance") * F.col("distance")) / F.count(F.lit(1))), 6).alias("gd"), F.round(F.avg("distance"), 6).alias("igd"))


@R.add(
    "selection_fairness",
    """WITH g AS (SELECT source AS g, count(*)::DOUBLE AS n, count(*) FILTER (lang = 'en')::DOUBLE AS k FROM documents GROUP BY 1), s AS (SELECT k / sum(k) OVER () AS s, n / sum(n) OVER () AS r FROM g)
    SELECT round(max(abs(s - r)), 6) AS parity_gap, round(min(s / r), 6) AS least_ratio, round(min(s), 6) AS least_share, round(max(s), 6) AS greatest_share, round(max(s) - min(s), 6) AS share_gap FROM s""",
)
def selection_fairness(spark, sf_dir):
    """The English documents are the selected ones."""
    out = st.selection_fairness(docs(spark, sf_dir).select(F.col("source").alias("g"), "lang"), F.col("lang") == "en")
    return _rounded(out, *out.columns)


_CELLS = "c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL), cells AS (SELECT x.a, y.b, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b)"


def _cells(spark, sf_dir):
    return st.intersections(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")), "a", "b")


@R.add("intersections", f"WITH {_CELLS} SELECT a, b, n, round(least(n / (sum(n) OVER () / count(*) OVER ()), 2) / 2, 4) AS score FROM cells")
def intersections(spark, sf_dir):
    return _cells(spark, sf_dir)


@R.add("intersection_evenness", f"WITH {_CELLS} SELECT round((ln(sum(n)) - sum(CASE WHEN n > 0 THEN n * ln(n) ELSE 0 END) / sum(n)) / ln(count(*)), 6) AS evenness FROM cells")
def intersection_evenness(spark, sf_dir):
    return _rounded(st.intersection_evenness(_cells(spark, sf_dir)), "evenness")


@R.add(
    "hypervolume_3d",
    """WITH p AS (SELECT p_brand AS g, p_retailprice / 2000 AS x, p_size / 50 AS y, (p_partkey % 97) / 97 AS z FROM part), b AS (SELECT g, x, y, min(z) AS z FROM p WHERE x < 1.2 AND y < 1.2 AND z < 1.2 GROUP BY ALL),
    xs AS (SELECT g, x, coalesce(lead(x) OVER (PARTITION BY g ORDER BY x), 1.2) - x AS w FROM (SELECT DISTINCT g, x FROM b)), ys AS (SELECT g, y, coalesce(lead(y) OVER (PARTITION BY g ORDER BY y), 1.2) - y AS h FROM (SELECT DISTINCT g, y FROM b)),
    c AS (SELECT xs.g, xs.x, ys.y, any_value(w * h) AS a, min(z) AS z FROM xs JOIN ys USING (g) JOIN b ON b.g = xs.g AND b.x <= xs.x AND b.y <= ys.y GROUP BY ALL) SELECT g, round(sum(a * (1.2 - z)), 6) AS hypervolume FROM c GROUP BY g""",
)
def hypervolume_3d(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("z", F.col("id") % 97 / 97).withColumns({f"less_{c}": -F.col(c) if c != "z" else -(F.col("id") % 97 / 97) for c in "xyz"})
    front = pareto_front(points, ["less_x", "less_y", "less_z"], ["g"])
    return _rounded(st.hypervolume_3d(front, ["g"], ["x", "y", "z"], (1.2, 1.2, 1.2)), "hypervolume")


def _axis(name: str) -> str:
    of = lambda what: f"('0x' || left(md5('42:{what}:{name}:' || id), 8))::BIGINT"
    return f"round((row_number() OVER (ORDER BY {of('order')}, id) - 1 + {of('place')} / 4294967296) / 200, 9) AS {name}"


@R.add("latin_hypercube", f"SELECT id, {_axis('temperature')}, {_axis('top_p')}, {_axis('penalty')} FROM range(200) r(id)")
def latin_hypercube(spark, sf_dir):
    names = ["temperature", "top_p", "penalty"]
    return _rounded(st.latin_hypercube(spark, 200, names), *names, digits=9)


_RUNGS = "s AS (SELECT user_id AS id, month(ts)::BIGINT % 3 AS rung, round(sum(value), 4) AS score FROM events GROUP BY ALL)"


def _halving_sql() -> str:
    out, alive = [], "SELECT DISTINCT id FROM s"
    for k in range(3):
        out.append(f"m{k} AS (SELECT s.rung, s.id, s.score, row_number() OVER (ORDER BY s.score DESC, s.id) AS rank, row_number() OVER (ORDER BY s.score DESC, s.id) <= greatest(floor(count(*) OVER () / 2), 1) AS survives FROM s JOIN ({alive}) a ON a.id = s.id WHERE s.rung = (SELECT DISTINCT rung FROM s ORDER BY rung LIMIT 1 OFFSET {k}))")
        alive = f"SELECT id FROM m{k} WHERE survives"
    return f"WITH {_RUNGS}, {', '.join(out)} " + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(3))


@R.add("successive_halving", _halving_sql())
def successive_halving(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), (F.month("ts").cast("long") % 3).alias("rung")).agg(F.round(F.sum("value"), 4).alias("score"))
    return st.successive_halving(e)
