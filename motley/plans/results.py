"""Results-store queries: orders stand for runs and line items for their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from motley.operators import results as rs
from motley.operators.query import Query
from motley.plans.common import Registry, read

R = Registry()

VIEWS = """WITH runs AS (SELECT o_orderkey AS run_id, o_custkey % 20 AS experiment_id, o_orderpriority AS algorithm, o_orderstatus AS task, o_orderdate AS started, o_totalprice AS elapsed, o_custkey % 7 AS seed,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders),
    metrics AS (SELECT l_orderkey AS run_id, l_returnflag AS name, l_linestatus AS type, l_extendedprice AS value, l_partkey AS a, l_suppkey AS b, l_linenumber AS c, l_shipdate AS computed_at FROM lineitem),
    joined AS (SELECT * FROM runs JOIN metrics USING (run_id))"""


def runs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 20).alias("experiment_id"), F.col("o_orderpriority").alias("algorithm"), F.col("o_orderstatus").alias("task"), F.col("o_orderdate").alias("started"), F.col("o_totalprice").alias("elapsed"), (F.col("o_custkey") % 7).alias("seed"), status.alias("status"))


def metrics(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("type"), F.col("l_extendedprice").alias("value"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("c"), F.col("l_shipdate").alias("computed_at"))


def joined(spark, sf_dir):
    return runs(spark, sf_dir).join(metrics(spark, sf_dir), "run_id")


def _rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_STD = "coalesce(round(stddev_samp(value), 4), 0)"


@R.add("algorithm_comparison", f"{VIEWS} SELECT algorithm, name, type, count(value) AS n, round(avg(value), 4) AS mean, {_STD} AS std, min(value) AS low, max(value) AS high FROM joined GROUP BY ALL")
def algorithm_comparison(spark, sf_dir):
    return _rounded(rs.algorithm_comparison(joined(spark, sf_dir)), "mean", "std")


@R.add(
    "metric_statistics",
    f"""{VIEWS}, m AS (SELECT name, avg(value) AS mu FROM joined GROUP BY name),
    k AS (SELECT name, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM joined JOIN m USING (name) GROUP BY name)
    SELECT name, count(value) AS n, round(avg(value), 4) AS mean, {_STD} AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75,
    round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, round(max(m3 / m2 ** 1.5), 5) AS skew, round(max(m4 / m2 ** 2 - 3), 5) AS kurtosis FROM joined JOIN k USING (name) GROUP BY name""",
)
def metric_statistics(spark, sf_dir):
    out = rs.metric_statistics(joined(spark, sf_dir), "name")
    return _rounded(_rounded(out, "mean", "std", "q25", "median", "q75", "iqr"), "skew", "kurtosis", digits=5)


@R.add("metric_aggregates", f"{VIEWS} SELECT algorithm, task, name, count(value) AS n, round(avg(value), 4) AS mean, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM joined GROUP BY ALL")
def metric_aggregates(spark, sf_dir):
    return joined(spark, sf_dir).groupBy("algorithm", "task", "name").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))


@R.add("summary_by_type", f"{VIEWS} SELECT type, count(value) AS n, round(avg(value), 4) AS mean, {_STD} AS std, min(value) AS low, max(value) AS high FROM joined GROUP BY GROUPING SETS ((), (type))")
def summary_by_type(spark, sf_dir):
    return _rounded(rs.summary_by_type(joined(spark, sf_dir)), "mean", "std")


@R.add("pairwise_differences", f"{VIEWS}, m AS (SELECT name, algorithm, avg(value) AS m FROM joined GROUP BY ALL) SELECT x.name, x.algorithm AS a, y.algorithm AS b, round(x.m - y.m, 4) AS difference FROM m x JOIN m y ON x.name = y.name AND x.algorithm <> y.algorithm")
def pairwise_differences(spark, sf_dir):
    return _rounded(rs.pairwise_differences(joined(spark, sf_dir)), "difference")


@R.add(
    "effect_sizes",
    f"""{VIEWS}, s AS (SELECT name, algorithm, avg(value) AS mean, stddev_samp(value) AS std FROM joined GROUP BY ALL)
    SELECT s.name, s.algorithm, round(s.mean, 4) AS mean, round(s.std, 4) AS std, round((s.mean - b.mean) / sqrt((s.std ** 2 + b.std ** 2) / 2), 6) AS cohens_d, round(s.mean - b.mean, 4) AS difference, round((s.mean - b.mean) / abs(b.mean), 6) AS relative
    FROM s JOIN s b ON s.name = b.name AND b.algorithm = '1-URGENT' WHERE s.algorithm <> '1-URGENT'""",
)
def effect_sizes(spark, sf_dir):
    return _rounded(_rounded(rs.effect_sizes(joined(spark, sf_dir), "1-URGENT"), "mean", "std", "difference"), "cohens_d", "relative", digits=6)


@R.add("seed_analysis", f"{VIEWS} SELECT seed, algorithm, round(avg(value), 4) AS mean, count(value) AS n, {_STD} AS std FROM joined GROUP BY ALL")
def seed_analysis(spark, sf_dir):
    return _rounded(rs.seed_analysis(joined(spark, sf_dir)), "mean", "std")


@R.add("pivot_table", f"{VIEWS} SELECT algorithm, round(avg(value) FILTER (task = 'F'), 4) AS F, round(avg(value) FILTER (task = 'O'), 4) AS O, round(avg(value) FILTER (task = 'P'), 4) AS P FROM joined GROUP BY algorithm")
def pivot_table(spark, sf_dir):
    return _rounded(rs.pivot_table(joined(spark, sf_dir), ["F", "O", "P"]), "F", "O", "P")


@R.add("metric_histogram", f"{VIEWS}, l AS (SELECT name, min(value) AS low, max(value) AS high FROM joined GROUP BY name) SELECT name, least(floor((value - low) / ((high - low) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM joined JOIN l USING (name) GROUP BY ALL")
def metric_histogram(spark, sf_dir):
    return rs.histogram(joined(spark, sf_dir), 20, "name")


@R.add("metric_correlations", f"{VIEWS}, m AS (SELECT run_id, name, avg(value) AS m FROM joined GROUP BY ALL) SELECT x.name AS a, y.name AS b, count(*) AS n, round(corr(x.m, y.m), 6) AS correlation FROM m x JOIN m y ON x.run_id = y.run_id AND x.name < y.name GROUP BY ALL")
def metric_correlations(spark, sf_dir):
    return _rounded(rs.metric_correlations(joined(spark, sf_dir)), "correlation", digits=6)


@R.add("percentile_rank", f"{VIEWS} SELECT run_id, a, b, c, round((row_number() OVER (PARTITION BY name ORDER BY value, run_id, a, b, c) - 1) / (count(*) OVER (PARTITION BY name) - 1) * 100, 6) AS percentile FROM metrics")
def percentile_rank(spark, sf_dir):
    return rs.percentile_rank(metrics(spark, sf_dir), ["name"], ["run_id", "a", "b", "c"]).select("run_id", "a", "b", "c", F.round("percentile", 6).alias("percentile"))


@R.add("rank_algorithms", f"{VIEWS}, m AS (SELECT name, algorithm, avg(value) AS mean FROM joined GROUP BY ALL) SELECT name, algorithm, round(mean, 4) AS mean, row_number() OVER (PARTITION BY name ORDER BY mean DESC, algorithm) AS rank FROM m")
def rank_algorithms(spark, sf_dir):
    return _rounded(rs.rank_algorithms(joined(spark, sf_dir)), "mean")


@R.add("leaderboard", f"{VIEWS}, m AS (SELECT run_id, algorithm, avg(value) AS mean, min(value) AS low, max(value) AS high, count(value) AS n FROM joined GROUP BY ALL) SELECT run_id, algorithm, round(mean, 4) AS mean, low, high, n, row_number() OVER (ORDER BY mean DESC, run_id) AS rank FROM m QUALIFY rank <= 25")
def leaderboard(spark, sf_dir):
    return _rounded(rs.leaderboard(joined(spark, sf_dir), 25), "mean")


@R.add("best_run", f"{VIEWS} SELECT name, run_id, value FROM joined QUALIFY row_number() OVER (PARTITION BY name ORDER BY value DESC, run_id) = 1")
def best_run(spark, sf_dir):
    return rs.best_run(joined(spark, sf_dir))


@R.add("metric_time_series", f"{VIEWS} SELECT algorithm, run_id, a, b, c, computed_at, row_number() OVER (PARTITION BY algorithm, name ORDER BY computed_at, run_id, a, b, c) AS step FROM joined")
def metric_time_series(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("algorithm", "name").orderBy("computed_at", "run_id", "a", "b", "c")
    return joined(spark, sf_dir).select("algorithm", "run_id", "a", "b", "c", "computed_at", F.row_number().over(order).cast("long").alias("step"))


_TIMELINE = f"""{VIEWS}, g AS (SELECT l_orderkey AS run_id FROM lineitem WHERE l_linenumber <= 2), m AS (SELECT run_id FROM metrics WHERE type = 'F')"""


@R.add("run_timeline", f"{_TIMELINE}, mc AS (SELECT run_id, count(*) AS n FROM m GROUP BY 1), gc AS (SELECT run_id, count(*) AS n FROM g GROUP BY 1) SELECT run_id, started, coalesce(mc.n, 0) AS n_metrics, coalesce(gc.n, 0) AS n_generations FROM runs LEFT JOIN mc USING (run_id) LEFT JOIN gc USING (run_id)")
def run_timeline(spark, sf_dir):
    m, g = metrics(spark, sf_dir).where("type = 'F'"), metrics(spark, sf_dir).where("c <= 2")
    return rs.timeline(runs(spark, sf_dir).select("run_id", "started"), m, g)


@R.add("run_timeline_compat", f"{_TIMELINE} SELECT runs.run_id, started, count(m.run_id) AS n_metrics, count(g.run_id) AS n_generations FROM runs LEFT JOIN m ON runs.run_id = m.run_id LEFT JOIN g ON runs.run_id = g.run_id GROUP BY ALL")
def run_timeline_compat(spark, sf_dir):
    m, g = metrics(spark, sf_dir).where("type = 'F'"), metrics(spark, sf_dir).where("c <= 2")
    return rs.timeline_compat(runs(spark, sf_dir).select("run_id", "started"), m, g)


@R.add("orphaned_metrics", f"{VIEWS} SELECT run_id, count(*) AS n FROM metrics WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.run_id = metrics.run_id AND algorithm <> '5-LOW') GROUP BY run_id")
def orphaned_metrics(spark, sf_dir):
    return rs.orphans(metrics(spark, sf_dir), runs(spark, sf_dir).where("algorithm <> '5-LOW'")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@R.add("duplicate_runs", f"{VIEWS} SELECT experiment_id, algorithm, task, seed, count(*) AS n, string_agg(run_id::VARCHAR, ',' ORDER BY run_id) AS runs FROM runs GROUP BY ALL HAVING count(*) > 1")
def duplicate_runs(spark, sf_dir):
    return rs.duplicate_runs(runs(spark, sf_dir), "experiment_id", "algorithm", "task", "seed")


@R.add("experiment_progress", f"{VIEWS} SELECT experiment_id, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'completed') / count(*), 6) AS rate FROM runs GROUP BY 1")
def experiment_progress(spark, sf_dir):
    return _rounded(rs.progress(runs(spark, sf_dir)), "rate", digits=6)


@R.add("search_runs", f"{VIEWS} SELECT run_id, algorithm, started FROM runs WHERE algorithm ILIKE '%high%' AND status IN ('completed', 'running') AND elapsed BETWEEN 1000 AND 200000 ORDER BY started DESC, run_id LIMIT 100")
def search_runs(spark, sf_dir):
    return Query(spark).table(runs(spark, sf_dir)).where("algorithm", "LIKE", "%high%").where("status", "IN", ["completed", "running"]).where("elapsed", "BETWEEN", (1000, 200000)).select("run_id", "algorithm", "started").order_by("started", "DESC").order_by("run_id").limit(100).build()


@R.add("query_builder_groups", f"{VIEWS} SELECT task, name, count(*) AS n, round(sum(value), 2) AS total FROM joined WHERE type <> 'O' AND seed IS NOT NULL AND NOT algorithm ILIKE '%low%' GROUP BY ALL HAVING count(*) > 10")
def query_builder_groups(spark, sf_dir):
    return Query(spark).table(runs(spark, sf_dir)).join(metrics(spark, sf_dir), "run_id").where("type", "!=", "O").where("seed", "IS NOT NULL").where("algorithm", "NOT LIKE", "%low%").group_by("task", "name").select(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).having("n > 10").build()


@R.add("query_builder_page", f"{VIEWS} SELECT DISTINCT task, seed FROM runs ORDER BY seed, task LIMIT 7 OFFSET 5")
def query_builder_page(spark, sf_dir):
    return Query(spark).table(runs(spark, sf_dir)).select("task", "seed").distinct().order_by("seed").order_by("task").limit(7).offset(5).build()


@R.add("merge_experiments", f"{VIEWS} SELECT 100 AS experiment_id, count(*) AS n, count(DISTINCT algorithm) AS algorithms FROM runs WHERE experiment_id IN (1, 2)")
def merge_experiments(spark, sf_dir):
    r = runs(spark, sf_dir)
    merged = r.where("experiment_id = 1").unionByName(r.where("experiment_id = 2")).withColumn("experiment_id", F.lit(100))
    return merged.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("algorithm").alias("algorithms"))


@R.add("pareto_front", f"{VIEWS}, p AS (SELECT experiment_id, algorithm, run_id AS id, elapsed AS quality, -extract(epoch FROM started)::DOUBLE AS early FROM runs) SELECT experiment_id, algorithm, id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.experiment_id = p.experiment_id AND q.algorithm = p.algorithm AND q.quality >= p.quality AND q.early >= p.early AND (q.quality > p.quality OR q.early > p.early))")
def pareto_front(spark, sf_dir):
    points = runs(spark, sf_dir).select("experiment_id", "algorithm", F.col("run_id").alias("id"), F.col("elapsed").alias("quality"), (-F.unix_timestamp("started").cast("double")).alias("early"))
    return rs.pareto_front(points, ["quality", "early"], ["experiment_id", "algorithm"]).select("experiment_id", "algorithm", "id")
