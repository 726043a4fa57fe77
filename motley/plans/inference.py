"""Queries of intervals, tests, pooled effects, fronts against references, forecasts and sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from motley.operators import inference as nf
from motley.operators.results import pareto_front
from motley.plans.common import Registry, read
from motley.plans.series import SERIES, _series
from motley.plans.stats import DAILY, VOTES, _daily, _points, _votes

R = Registry()
Z, B = nf.Z95, nf.Z80


def _rounded(df, digits=5):
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").withColumn("g", F.col("o_orderpriority"))


@R.add("mean_intervals", f"SELECT g, n, round(m, 5) AS mean, round(m - {Z} * s / sqrt(n), 5) AS low, round(m + {Z} * s / sqrt(n), 5) AS high FROM (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice / 1000) AS m, stddev_samp(o_totalprice / 1000) AS s FROM orders GROUP BY 1)")
def mean_intervals(spark, sf_dir):
    return _rounded(nf.mean_interval(_orders(spark, sf_dir).withColumn("v", F.col("o_totalprice") / 1000), ["g"], "v"))


@R.add(
    "share_intervals",
    f"""WITH a AS (SELECT o_orderpriority AS g, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n, k / n AS p, {Z} * {Z} AS z2, (k + z2 / 2) / (n + z2) AS q FROM orders GROUP BY 1)
    SELECT g, k, n, round(greatest((p + z2 / (2 * n) - {Z} * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n), 0), 5) AS wilson_low, round(least((p + z2 / (2 * n) + {Z} * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n), 1), 5) AS wilson_high,
    round(greatest(q - {Z} * sqrt(q * (1 - q) / (n + z2)), 0), 5) AS agresti_low, round(least(q + {Z} * sqrt(q * (1 - q) / (n + z2)), 1), 5) AS agresti_high FROM a""",
)
def share_intervals(spark, sf_dir):
    return _rounded(nf.share_interval(_orders(spark, sf_dir), ["g"], F.col("o_orderstatus") == "F"))


_TWO = "SELECT l_linestatus AS g, count(*) FILTER (l_returnflag = 'R') AS nx, count(*) FILTER (l_returnflag <> 'R') AS ny, avg(l_quantity) FILTER (l_returnflag = 'R') AS mx, avg(l_quantity) FILTER (l_returnflag <> 'R') AS my, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS vx, var_samp(l_quantity) FILTER (l_returnflag <> 'R') AS vy FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 1 AND count(*) FILTER (l_returnflag <> 'R') > 1"


def _lines(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("g", F.col("l_linestatus"))
    both = rows.groupBy("g").agg(F.count_if(F.col("l_returnflag") == "R").alias("x"), F.count_if(F.col("l_returnflag") != "R").alias("y")).where("x > 1 AND y > 1").select("g")
    return rows.join(both, "g", "left_semi")


@R.add("welch_difference", f"SELECT g, round(mx - my, 5) AS diff, round(sqrt(vx / nx + vy / ny), 5) AS se, round((vx / nx + vy / ny) ** 2 / ((vx / nx) ** 2 / (nx - 1) + (vy / ny) ** 2 / (ny - 1)), 2) AS df, round((mx - my) / sqrt(vx / nx + vy / ny), 5) AS t, round(sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2) * (1 / nx + 1 / ny)), 5) AS pooled_se FROM ({_TWO})")
def welch_difference(spark, sf_dir):
    out = nf.welch(_lines(spark, sf_dir), ["g"], F.col("l_returnflag") == "R", F.col("l_returnflag") != "R", "l_quantity")
    return _rounded(out.withColumn("df", F.round("df", 2)))


@R.add("required_sample_size", f"SELECT g, round(d, 5) AS d, greatest(ceil((({Z} + {B}) / d) ** 2), 2)::BIGINT AS n FROM (SELECT g, (mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)) AS d FROM ({_TWO}))")
def required_sample_size(spark, sf_dir):
    return _rounded(nf.sample_size(_lines(spark, sf_dir), ["g"], F.col("l_returnflag") == "R", F.col("l_returnflag") != "R", "l_quantity"))


@R.add(
    "meta_analysis",
    """WITH s AS (SELECT avg(c_acctbal / 1000) AS e, stddev_samp(c_acctbal / 1000) / sqrt(count(*)) AS se, 1 / (stddev_samp(c_acctbal / 1000) / sqrt(count(*))) ** 2 AS w FROM customer GROUP BY c_nationkey HAVING count(*) > 2),
    f AS (SELECT count(*) AS k, sum(w * e) / sum(w) AS mu, 1 / sqrt(sum(w)) AS fse, sum(w) - sum(w * w) / sum(w) AS c FROM s), q AS (SELECT any_value(k) AS k, any_value(mu) AS mu, any_value(fse) AS fse, any_value(c) AS c, sum(w * (e - mu) ** 2) AS q FROM s, f),
    t AS (SELECT *, CASE WHEN q > 0 THEN greatest((q - (k - 1)) / q * 100, 0) ELSE 0 END AS i2, CASE WHEN c > 0 THEN greatest((q - (k - 1)) / c, 0) ELSE 0 END AS tau2 FROM q)
    SELECT any_value(k) AS k, round(any_value(mu), 5) AS fixed, round(any_value(fse), 5) AS fixed_se, round(any_value(q), 4) AS q, round(any_value(i2), 4) AS i2, round(any_value(tau2), 5) AS tau2, round(sum(e / (se * se + tau2)) / sum(1 / (se * se + tau2)), 5) AS random, round(1 / sqrt(sum(1 / (se * se + tau2))), 5) AS random_se FROM s, t""",
)
def meta_analysis(spark, sf_dir):
    v = F.col("c_acctbal") / 1000
    studies = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg(v).alias("effect"), (F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("n")).where("n > 2")
    out = nf.meta_analysis(studies)
    return _rounded(out.withColumns({"q": F.round("q", 4), "i2": F.round("i2", 4)}))


@R.add(
    "descriptive_statistics",
    """WITH m AS (SELECT l_returnflag AS g, l_discount * 100 AS x, avg(l_discount * 100) OVER (PARTITION BY l_returnflag) AS m FROM lineitem), a AS (SELECT g, count(*) AS n, any_value(m) AS mean, stddev_samp(x) AS std, min(x) AS low, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS high,
    avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 AS sk, avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3 AS ku FROM m GROUP BY g)
    SELECT g, n, round(mean, 5) AS mean, round(std, 5) AS std, round(low, 5) AS low, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3, round(high, 5) AS high, round(q3 - q1, 5) AS iqr, round(sk, 5) AS skewness, round(ku, 5) AS kurtosis, round(std / sqrt(n), 5) AS se, round(std / abs(mean), 5) AS cv,
    round(n / 6 * (sk * sk + ku * ku / 4), 2) AS jarque_bera, round(exp(-n / 12 * (sk * sk + ku * ku / 4)), 5) AS p_normal FROM a""",
)
def descriptive_statistics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_discount") * 100).alias("x"))
    return _rounded(nf.describe(rows, ["g"], "x").withColumn("jarque_bera", F.round("jarque_bera", 2)))


@R.add(
    "equal_variances",
    """WITH r AS (SELECT l_returnflag AS g, l_quantity::DOUBLE AS x, median(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem), v AS (SELECT g, count(*)::DOUBLE AS n, var_samp(x) AS v, sum(abs(x - m)) AS s, sum((x - m) ** 2) AS ss FROM r GROUP BY g),
    a AS (SELECT count(*)::DOUBLE AS k, sum(n) AS t, sum((n - 1) * v) AS p, sum((n - 1) * ln(v)) AS l, sum(1 / (n - 1)) AS i, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM v)
    SELECT round(((t - k) * ln(p / (t - k)) - l) / (1 + (i - 1 / (t - k)) / (3 * (k - 1))), 4) AS bartlett, round((t - k) / (k - 1) * (b - s * s / t) / (ss - b), 4) AS levene FROM a""",
)
def equal_variances(spark, sf_dir):
    return _rounded(nf.equal_variances(read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x")), "l_returnflag", "x"), 4)


@R.add(
    "kruskal_wallis",
    f"""WITH {DAILY}, r AS (SELECT system, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r, count(*) OVER (PARTITION BY score) AS c FROM daily), g AS (SELECT sum(r) AS s, count(*)::DOUBLE AS n, sum(c * c - 1) AS ties FROM r GROUP BY system),
    a AS (SELECT count(*) AS k, sum(n) AS n, sum(s * s / n) AS b, sum(ties) AS ties FROM g), h AS (SELECT k, n, (12 / (n * (n + 1)) * b - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM a) SELECT round(h, 4) AS h, round((h - k + 1) / (n - k), 5) AS eta_squared FROM h""",
)
def kruskal_wallis(spark, sf_dir):
    return _rounded(nf.kruskal_wallis(_daily(spark, sf_dir), "system", "score").withColumn("h", F.round("h", 4)))


@R.add(
    "cochran_q",
    f"""WITH {VOTES}, r AS (SELECT item, model, (vote = truth)::BIGINT AS x FROM votes), m AS (SELECT count(*)::DOUBLE AS k, sum(c) AS t, sum(c * c) AS cc FROM (SELECT sum(x) AS c FROM r GROUP BY model)), i AS (SELECT sum(r) AS s, sum(r * r) AS rr FROM (SELECT sum(x) AS r FROM r GROUP BY item))
    SELECT round(CASE WHEN k * s - rr > 0 THEN (k - 1) * (k * cc - t * t) / (k * s - rr) ELSE 0 END, 4) AS q, (k - 1)::BIGINT AS df FROM m, i""",
)
def cochran_q(spark, sf_dir):
    return _rounded(nf.cochran_q(_votes(spark, sf_dir).select("item", "model", (F.col("vote") == F.col("truth")).alias("right"))), 4)


_Q = "CASE k " + " ".join(f"WHEN {k} THEN {q}" for k, q in nf.NEMENYI_05.items()) + f" ELSE {nf.NEMENYI_05[10]} + 0.03 * (k - 10) END"


@R.add(
    "nemenyi_pairs",
    f"""WITH {DAILY}, r AS (SELECT system, rank() OVER (PARTITION BY item ORDER BY score) + (count(*) OVER (PARTITION BY item, score) - 1) / 2 AS r FROM daily), m AS (SELECT system, avg(r) AS m, count(*) AS n, count(*) OVER () AS k FROM r GROUP BY system),
    p AS (SELECT a.system AS a, b.system AS b, abs(a.m - b.m) AS d, sqrt(a.k * (a.k + 1) / (6 * a.n)) AS se, a.k AS k FROM m a JOIN m b ON a.system < b.system) SELECT a, b, round(d, 5) AS diff, round(d / se, 5) AS z, round({_Q} * se, 5) AS critical, d >= {_Q} * se AS significant FROM p""",
)
def nemenyi_pairs(spark, sf_dir):
    return _rounded(nf.nemenyi(_daily(spark, sf_dir), "item", "system", "score"))


_PAIRED = f"{DAILY}, p AS (SELECT a.item AS item, a.system AS g, a.score AS x, b.score AS y FROM daily a JOIN daily b ON a.item = b.item AND b.system = 'view' AND a.system <> 'view')"


def _paired(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return d.where("system <> 'view'").select("item", F.col("system").alias("g"), F.col("score").alias("x")).join(d.where("system = 'view'").select("item", F.col("score").alias("y")), "item")


@R.add("bayesian_sign_test", f"WITH {_PAIRED}, a AS (SELECT g, count(*) FILTER (x - y > 0.01) AS w, count(*) FILTER (x - y < -0.01) AS l, count(*) AS n FROM p GROUP BY g) SELECT g, w AS wins, n - w - l AS ties, l AS losses, round((w + 1) / (n + 3), 6) AS p_x, round((n - w - l + 1) / (n + 3), 6) AS p_equal, round((l + 1) / (n + 3), 6) AS p_y FROM a")
def bayesian_sign_test(spark, sf_dir):
    return _rounded(nf.bayesian_sign(_paired(spark, sf_dir), ["g"]), 6)


@R.add(
    "permutation_test",
    f"""WITH {_PAIRED}, s AS (SELECT g, round(abs(avg(x - y)), 9) AS seen FROM p GROUP BY g), f AS (SELECT g, k, round(abs(avg(CASE WHEN substr(md5('42:' || k || ':' || item), 1, 1) < '8' THEN x - y ELSE y - x END)), 9) AS m FROM p, range(1, 201) r(k) GROUP BY ALL)
    SELECT g, round(seen, 6) AS difference, round((count(*) FILTER (m >= seen) + 1) / 201, 6) AS p FROM f JOIN s USING (g) GROUP BY g, seen""",
)
def permutation_test(spark, sf_dir):
    return _rounded(nf.sign_flips(_paired(spark, sf_dir), ["g"]), 6)


@R.add("correlation_intervals", f"SELECT g, round(r, 6) AS r, round(tanh(atanh(r) - {Z} / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + {Z} / sqrt(n - 3)), 6) AS high FROM (SELECT l_returnflag AS g, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1)")
def correlation_intervals(spark, sf_dir):
    return _rounded(nf.correlation_interval(read(spark, sf_dir, "lineitem").withColumn("g", F.col("l_returnflag")), ["g"], "l_quantity", "l_extendedprice"), 6)


@R.add(
    "independence_test",
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), w AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
    k AS (SELECT count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM c), x AS (SELECT any_value(t) * sum(n * n / (na * nb)) - any_value(t) AS chi, any_value(t) AS t FROM w)
    SELECT round(chi, 4) AS chi_square, (ka - 1) * (kb - 1) AS df, round(sqrt(chi / (t * (least(ka, kb) - 1))), 4) AS cramers_v FROM x, k""",
)
def independence_test(spark, sf_dir):
    return _rounded(nf.independence(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), 4)


@R.add("grubbs_statistic", "WITH m AS (SELECT s_nationkey AS g, s_suppkey AS id, round(abs(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey)) / stddev_samp(s_acctbal) OVER (PARTITION BY s_nationkey), 9) AS d, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT g, id, round(d, 5) AS g_statistic FROM m WHERE n > 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY d DESC, id) = 1")
def grubbs_statistic(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), "s_acctbal")
    many = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("g")
    return _rounded(nf.grubbs(rows.join(many, "g", "left_semi"), ["g"], "s_acctbal", "id"))


@R.add(
    "unit_root_test",
    f"""WITH {SERIES}, d AS (SELECT g, lag(v) OVER w AS x, v - lag(v) OVER w AS y FROM s WINDOW w AS (PARTITION BY g ORDER BY t)), a AS (SELECT g, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d WHERE x IS NOT NULL GROUP BY g),
    t AS (SELECT g, b / sqrt(greatest(greatest(syy - b * sxy, 0) / (n - 2) / sxx, 1e-30)) AS t FROM a)
    SELECT g, round(t, 4) AS statistic, round(CASE WHEN t < -3.43 THEN 0.005 WHEN t < -2.86 THEN 0.03 WHEN t < -2.57 THEN 0.07 ELSE least(1, 0.1 + 0.15 * (t + 2.57)) END, 4) AS p, t < -2.86 AS stationary FROM t""",
)
def unit_root_test(spark, sf_dir):
    return _rounded(nf.unit_root(_series(spark, sf_dir), ["g"], "t", "v"), 4)


@R.add(
    "trend_forecast",
    f"""WITH {SERIES}, a AS (SELECT g, regr_slope(v, t) AS b, regr_intercept(v, t) AS i, max(t) AS last, 1.96 * sqrt(greatest(regr_syy(v, t) - regr_slope(v, t) * regr_sxy(v, t), 0) / (count(*) - 2)) AS band FROM s GROUP BY g)
    SELECT g, k AS step, round(i + b * (last + k), 3) AS forecast, round(i + b * (last + k) - band, 3) AS low, round(i + b * (last + k) + band, 3) AS high FROM a, range(1, 8) r(k)""",
)
def trend_forecast(spark, sf_dir):
    return _rounded(nf.trend_forecast(_series(spark, sf_dir), ["g"], "t", "v", 7), 3)


@R.add("bandit_ucb1", "WITH a AS (SELECT event_type AS arm, count(*) AS n, avg(value) AS m FROM events GROUP BY 1), s AS (SELECT arm, n, m, m + sqrt(2 * ln(sum(n) OVER ()) / n) AS score FROM a) SELECT arm, n, round(m, 5) AS mean, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, arm) AS rank FROM s")
def bandit_ucb1(spark, sf_dir):
    return _rounded(nf.ucb1(read(spark, sf_dir, "events"), "event_type", "value"))


@R.add("weighted_reservoir", "SELECT event_id, round(ln((('0x' || substr(md5('42:' || event_id), 1, 12))::BIGINT + 1.0::DOUBLE) / (16.0::DOUBLE ** 12 + 1)) / value, 9) AS priority FROM events WHERE value > 0 ORDER BY priority DESC, event_id LIMIT 50")
def weighted_reservoir(spark, sf_dir):
    return _rounded(nf.weighted_reservoir(read(spark, sf_dir, "events"), "event_id", F.col("value"), 50), 9)


@R.add("scaling_fit", "SELECT p_brand AS g, round(regr_slope(ln(p_retailprice), ln(p_size)), 5) AS exponent, round(exp(regr_intercept(ln(p_retailprice), ln(p_size))), 3) AS factor, round(regr_r2(ln(p_retailprice), ln(p_size)), 5) AS r2 FROM part WHERE p_size > 0 AND p_retailprice > 0 GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def scaling_fit(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("g", F.col("p_brand"))
    several = rows.groupBy("g").agg(F.countDistinct("p_size").alias("n")).where("n > 1").select("g")
    out = nf.power_law(rows.join(several, "g", "left_semi"), ["g"], "p_size", "p_retailprice")
    return _rounded(out.withColumn("factor", F.round("factor", 3)))


_LOW = "points AS (SELECT p_brand AS g, p_partkey AS id, p_retailprice / 2000 AS x, p_size / 50 AS y FROM part), low AS (SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM points q WHERE q.g = p.g AND q.id % 2 = p.id % 2 AND q.x <= p.x AND q.y <= p.y AND (q.x < p.x OR q.y < p.y)))"


def _low(points):
    turned = points.select("g", "id", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))
    return pareto_front(turned, ["x", "y"], ["g"]).select("g", "id", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))


@R.add(
    "front_against_reference",
    f"""WITH {_LOW}, e AS (SELECT b.g, b.id, sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d, sqrt(min(greatest(a.x - b.x, 0) ** 2 + greatest(a.y - b.y, 0) ** 2)) AS dp, min(greatest(a.x - b.x, a.y - b.y)) AS e FROM low a JOIN low b ON a.g = b.g AND a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY ALL)
    SELECT g, round(sqrt(sum(d * d) / count(*)), 6) AS igd, round(sqrt(sum(dp * dp) / count(*)), 6) AS igd_plus, round(max(d), 6) AS greatest_error, round(count(*) FILTER (e <= 0) / count(*), 6) AS coverage, round(max(e), 6) AS epsilon FROM e GROUP BY g""",
)
def front_against_reference(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _rounded(nf.front_quality(_low(p.where("id % 2 = 1")), _low(p.where("id % 2 = 0")), ["g"], ["x", "y"]), 6)


_ALL_LOW = _LOW.replace("q.id % 2 = p.id % 2 AND ", "")


@R.add(
    "front_spread",
    f"""WITH {_ALL_LOW}, d AS (SELECT g, row_number() OVER w AS k, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM low WINDOW w AS (PARTITION BY g ORDER BY x, id)), m AS (SELECT *, avg(d) OVER (PARTITION BY g) AS m FROM d WHERE d IS NOT NULL),
    a AS (SELECT g, any_value(m) AS m, min_by(d, k) + max_by(d, k) AS ends, sum(abs(d - m)) AS off, count(*) AS n FROM m GROUP BY g) SELECT g, round(CASE WHEN m > 0 THEN (ends + off) / (ends + n * m) ELSE 0 END, 6) AS spread FROM a""",
)
def front_spread(spark, sf_dir):
    return _rounded(nf.front_spread(_low(_points(spark, sf_dir)), ["g"], "x", "y"), 6)


@R.add(
    "knee_point",
    f"""WITH {_ALL_LOW}, e AS (SELECT g, min((x, y)) AS a, max((x, y)) AS b FROM low GROUP BY g), f AS (SELECT g, a[1] AS ax, a[2] AS ay, b[1] - a[1] AS dx, b[2] - a[2] AS dy FROM e),
    d AS (SELECT g, id, round(CASE WHEN dx * dx + dy * dy > 0 THEN abs(dx * (ay - y) - (ax - x) * dy) / sqrt(dx * dx + dy * dy) ELSE 0 END, 9) AS d FROM low JOIN f USING (g)) SELECT g, id, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY g ORDER BY d DESC, id) = 1""",
)
def knee_point(spark, sf_dir):
    return _rounded(nf.knee_point(_low(_points(spark, sf_dir)), ["g"], "x", "y"), 6)


@R.add("dominance_ranks")
def dominance_ranks(spark, sf_dir):
    return nf.dominance_ranks(_points(spark, sf_dir), ["g"], ["x", "y"])


@R.add(
    "odds_gap",
    "WITH r AS (SELECT lang, source, avg(quality::DOUBLE) AS rate, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT lang AS g, count(*) AS n_groups, round(max(rate) - min(rate), 4) AS gap, round(max(rate), 6) AS high, round(min(rate), 6) AS low FROM r GROUP BY 1",
)
def odds_gap(spark, sf_dir):
    labelled = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    rates = labelled.groupBy("lang", "source").agg(F.avg(F.col("quality").cast("double")).alias("rate"))
    return rates.groupBy(F.col("lang").alias("g")).agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.max("rate") - F.min("rate"), 4).alias("gap"), F.round(F.max("rate"), 6).alias("high"), F.round(F.min("rate"), 6).alias("low"))
