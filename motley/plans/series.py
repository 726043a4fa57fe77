"""Queries over daily event series and over logits made from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from motley.operators import logits as lg
from motley.operators import series as sr
from motley.plans.common import Registry, read

R = Registry()

SERIES = "s AS (SELECT event_type AS g, datediff('day', DATE '2024-01-01', ts::DATE) AS t, sum(value) AS v FROM events GROUP BY ALL)"


def _series(spark, sf_dir):
    t = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("g"), t.alias("t")).agg(F.sum("value").alias("v"))


def _rounded(df, *columns, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_W = "OVER (PARTITION BY g ORDER BY t ROWS BETWEEN {a} AND {b})"
_MA = _W.format(a="3 PRECEDING", b="3 FOLLOWING")
_SOFAR = _W.format(a="UNBOUNDED PRECEDING", b="CURRENT ROW")


@R.add("rolling_statistics", f"WITH {SERIES} SELECT g, t, round(avg(v) {_MA}, 5) AS mean, round(coalesce(stddev_samp(v) {_MA}, 0), 5) AS std FROM s")
def rolling(spark, sf_dir):
    return _rounded(sr.rolling(_series(spark, sf_dir), 7), "mean", "std")


@R.add("second_difference", f"WITH {SERIES}, a AS (SELECT g, t, v - lag(v) OVER (PARTITION BY g ORDER BY t) AS v FROM s QUALIFY v - lag(v) OVER (PARTITION BY g ORDER BY t) IS NOT NULL) SELECT g, t, round(v - lag(v) OVER (PARTITION BY g ORDER BY t), 5) AS v FROM a QUALIFY lag(v) OVER (PARTITION BY g ORDER BY t) IS NOT NULL")
def second_difference(spark, sf_dir):
    return _rounded(sr.difference(_series(spark, sf_dir), 2), "v")


@R.add("autocorrelation", f"WITH {SERIES}, d AS (SELECT g, t, v - avg(v) OVER (PARTITION BY g) AS d FROM s), q AS (SELECT g, avg(d * d) AS var FROM d GROUP BY g) SELECT a.g, k AS lag, round(avg(a.d * b.d) / max(var), 5) AS r FROM d a, range(6) x(k), d b, q WHERE a.g = b.g AND a.t = b.t + k AND q.g = a.g GROUP BY a.g, k")
def autocorrelation(spark, sf_dir):
    return _rounded(sr.autocorrelation(_series(spark, sf_dir), 5), "r")


@R.add(
    "cusum_changes",
    f"""WITH {SERIES}, z AS (SELECT g, t, count(*) OVER (PARTITION BY g) AS n, (v - avg(v) OVER (PARTITION BY g)) / stddev_pop(v) OVER (PARTITION BY g) AS z FROM s), c AS (SELECT g, t, n, sum(z) {_SOFAR} AS c FROM z),
    n AS (SELECT *, abs(lag(c) OVER (PARTITION BY g ORDER BY t)) AS b, abs(lead(c) OVER (PARTITION BY g ORDER BY t)) AS a FROM c)
    SELECT g, t, round(c, 4) + 0.0 AS cusum, b IS NOT NULL AND a IS NOT NULL AND abs(c) > b AND abs(c) >= a AND abs(c) > 0.3 * sqrt(n) AS change FROM n""",
)
def cusum(spark, sf_dir):
    return sr.cusum(_series(spark, sf_dir), 0.3).withColumn("cusum", F.round("cusum", 4) + 0.0)


@R.add("window_change_point", f"WITH {SERIES}, w AS (SELECT g, t, avg(v) {_W.format(a='5 PRECEDING', b='1 PRECEDING')} AS a, avg(v) {_W.format(a='CURRENT ROW', b='4 FOLLOWING')} AS b, var_samp(v) {_W.format(a='5 PRECEDING', b='1 PRECEDING')} AS va, var_samp(v) {_W.format(a='CURRENT ROW', b='4 FOLLOWING')} AS vb, count(v) {_W.format(a='5 PRECEDING', b='1 PRECEDING')} AS na, count(v) {_W.format(a='CURRENT ROW', b='4 FOLLOWING')} AS nb FROM s) SELECT g, t, round((b - a) / sqrt((va + vb) / 5), 5) AS stat FROM w WHERE na = 5 AND nb = 5")
def change_point(spark, sf_dir):
    return _rounded(sr.window_shift(_series(spark, sf_dir), 5), "stat")


@R.add("diversity_trend", f"WITH {SERIES} SELECT g, round(regr_slope(v, t), 5) AS slope, round(regr_intercept(v, t), 4) AS intercept, round(regr_r2(v, t), 5) AS r2, CASE WHEN regr_slope(v, t) > 0.01 THEN 'up' WHEN regr_slope(v, t) < -0.01 THEN 'down' ELSE 'flat' END AS direction FROM s GROUP BY g")
def trend(spark, sf_dir):
    return _rounded(_rounded(sr.trend(_series(spark, sf_dir)), "slope", "r2"), "intercept", digits=4)


@R.add(
    "seasonal_decomposition",
    f"""WITH {SERIES}, l AS (SELECT *, avg(v) {_MA} AS level, t % 7 AS phase FROM s), r AS (SELECT *, avg(v - level) OVER (PARTITION BY g, phase) AS raw FROM l), q AS (SELECT *, raw - avg(raw) OVER (PARTITION BY g) AS season FROM r)
    SELECT g, t, round(level, 5) AS level, round(season, 5) AS season, round(v - level - season, 5) AS rest FROM q""",
)
def seasonal(spark, sf_dir):
    return _rounded(sr.seasonal(_series(spark, sf_dir), 7), "level", "season", "rest")


@R.add(
    "exponential_smoothing",
    f"""WITH RECURSIVE {SERIES}, o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t) AS i FROM s), r AS (SELECT g, t, i, v AS x FROM o WHERE i = 1 UNION ALL SELECT o.g, o.t, o.i, 0.3 * o.v + 0.7 * r.x FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
    SELECT g, t, round(x, 5) AS smooth FROM r""",
)
def smoothing(spark, sf_dir):
    return _rounded(sr.ewma(_series(spark, sf_dir), 0.3), "smooth")


@R.add("running_best", f"WITH {SERIES}, b AS (SELECT *, max(v) {_SOFAR} AS best FROM s), c AS (SELECT *, lag(best) OVER (PARTITION BY g ORDER BY t) AS before FROM b) SELECT g, t, round(best, 5) AS best, sum((before IS NULL OR v > before)::INT) {_SOFAR}::BIGINT AS improvements FROM c")
def running_best(spark, sf_dir):
    return _rounded(sr.crossings(_series(spark, sf_dir)), "best")


@R.add("windowed_event_counts", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed(spark, sf_dir):
    w = read(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.col("window.start").alias("start"), "n", "total")


@R.add(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


LOGITS = "l AS (SELECT vec_id AS row_id, i AS token_id, embedding[i + 1]::DOUBLE * 10 AS logit FROM embeddings, range(64) x(i)), e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row_id)) AS e FROM l), p AS (SELECT row_id, token_id, logit, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e)"


def _logits(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token_id", "x")).select("row_id", F.col("token_id").cast("long").alias("token_id"), (F.col("x").cast("double") * 10).alias("logit"))


def _probs(spark, sf_dir):
    return lg.with_probability(_logits(spark, sf_dir))


_CUM = "SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY p DESC, token_id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, token_id) AS r FROM p"


@R.add("softmax_temperature", f"WITH {LOGITS.replace('exp(logit - max(logit) OVER (PARTITION BY row_id))', 'exp((logit - max(logit) OVER (PARTITION BY row_id)) / 0.7)')} SELECT row_id, token_id, round(p, 6) AS p FROM p")
def temperature(spark, sf_dir):
    return _rounded(lg.with_probability(_logits(spark, sf_dir), 0.7).select("row_id", "token_id", "p"), "p", digits=6)


_FILTERS = {
    "top_k_filter": (lambda p: lg.top_k(p, 10), f"SELECT row_id, token_id FROM ({_CUM}) WHERE r <= 10"),
    "top_p_exclusive": (lambda p: lg.top_p_exclusive(p, 0.8), f"SELECT row_id, token_id FROM ({_CUM}) WHERE cum <= 0.8 OR r = 1"),
    "top_p_inclusive": (lambda p: lg.top_p_inclusive(p, 0.8), f"SELECT row_id, token_id FROM ({_CUM}) WHERE cum - p < 0.8 OR r = 1"),
    "min_p_filter": (lambda p: lg.min_p(p, 0.1), "SELECT row_id, token_id FROM (SELECT *, max(p) OVER (PARTITION BY row_id) AS m FROM p) WHERE p >= 0.1 * m"),
    "eta_filter": (lambda p: lg.eta(p, 0.01), "SELECT row_id, token_id FROM (SELECT *, sum(-p * ln(p)) OVER (PARTITION BY row_id) AS h, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, token_id) AS r FROM p) WHERE p >= 0.01 * h OR r = 1"),
    "typical_filter": (lambda p: lg.typical(p, 0.7), "SELECT row_id, token_id FROM (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY d, token_id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY row_id ORDER BY d, token_id) AS r FROM (SELECT *, round(abs(-ln(p) - h), 12) AS d FROM (SELECT *, sum(-p * ln(p)) OVER (PARTITION BY row_id) AS h FROM p))) WHERE cum <= 0.7 OR r = 1"),
    "tail_free_filter": (lambda p: lg.tail_free(p, 0.9), f"SELECT row_id, token_id FROM (SELECT *, min(CASE WHEN s >= 0.9 THEN r END) OVER (PARTITION BY row_id) AS cut FROM (SELECT *, sum(coalesce(c, 0)) OVER (PARTITION BY row_id ORDER BY r) / sum(coalesce(c, 0)) OVER (PARTITION BY row_id) AS s FROM (SELECT *, abs(lead(p, 2) OVER (PARTITION BY row_id ORDER BY r) - 2 * lead(p, 1) OVER (PARTITION BY row_id ORDER BY r) + p) AS c FROM ({_CUM})))) WHERE r <= cut + 1"),
}
for _name, (_keep, _sql) in _FILTERS.items():

    def _filter(spark, sf_dir, keep=_keep):
        return keep(_probs(spark, sf_dir)).select("row_id", "token_id")

    R.add(_name, f"WITH {LOGITS} {_sql}")(_filter)


@R.add("logit_summary", f"WITH {LOGITS}, h AS (SELECT *, -ln(p) AS i, sum(-p * ln(p)) OVER (PARTITION BY row_id) AS h FROM p) SELECT row_id, round(max(h), 5) AS entropy, round(sum(p * (i - h) ** 2), 5) AS varentropy, round(exp(max(h)), 5) AS perplexity, round(max(p), 5) AS top FROM h GROUP BY row_id")
def summary(spark, sf_dir):
    return _rounded(lg.row_summary(_probs(spark, sf_dir)), "entropy", "varentropy", "perplexity", "top")


@R.add(
    "logit_divergences",
    f"""WITH {LOGITS}, f AS (SELECT row_id, token_id, exp(logit / 2) AS e FROM l), q AS (SELECT row_id, token_id, e / sum(e) OVER (PARTITION BY row_id) AS q FROM f)
    SELECT row_id, round(sum(p * ln(p / q)), 5) AS kl, round(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2, 5) AS js, round(sqrt(sum((sqrt(p) - sqrt(q)) ** 2) / 2), 5) AS hellinger, round(sum(abs(p - q)) / 2, 5) AS total_variation FROM p JOIN q USING (row_id, token_id) GROUP BY row_id""",
)
def divergences(spark, sf_dir):
    return _rounded(lg.row_divergences(_probs(spark, sf_dir), lg.with_probability(_logits(spark, sf_dir), 2.0)), "kl", "js", "hellinger", "total_variation")


@R.add(
    "repetition_penalty",
    f"""WITH {LOGITS}, h AS (SELECT row_id, (row_id * 7 + k * k) % 64 AS token_id FROM (SELECT DISTINCT row_id FROM l), range(8) x(k)), c AS (SELECT row_id, token_id, count(*) AS n FROM h GROUP BY ALL)
    SELECT row_id, token_id, round(CASE WHEN n IS NULL THEN logit WHEN logit > 0 THEN logit / 1.2 ELSE logit * 1.2 END - 0.1 * coalesce(n, 0) - 0.2 * (n IS NOT NULL)::INT, 5) AS logit FROM l LEFT JOIN c USING (row_id, token_id)""",
)
def repetition(spark, sf_dir):
    logits = _logits(spark, sf_dir)
    history = logits.select("row_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("row_id", ((F.col("row_id") * 7 + F.col("k") * F.col("k")) % 64).alias("token_id"))
    return _rounded(lg.repetition_penalty(logits, history, 1.2, 0.1, 0.2), "logit")


@R.add("gumbel_top_k")
def gumbel(spark, sf_dir):
    return lg.gumbel_top_k(_probs(spark, sf_dir), 5, 17).select("row_id", "token_id", F.col("draw").cast("long").alias("draw"))
