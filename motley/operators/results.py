"""Analytics over a results store: runs (run_id, experiment_id, algorithm, task, ...) and metrics (run_id, name, type, value, ...).

``joined`` is runs joined to metrics.  Each function is one grouped query; where
a per-run or per-metric loop would be natural, it is a join or a window here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.operators.stats import running_sums


def std(value: Column) -> Column:
    """Sample standard deviation; 0 of a single value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def algorithm_comparison(joined: DataFrame) -> DataFrame:
    return joined.groupBy("algorithm", "name", "type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), std(F.col("value")).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))


def metric_statistics(joined: DataFrame, *by: str) -> DataFrame:
    """Moments, quartiles, skewness and excess kurtosis (population forms) of each group."""
    v = F.col("value")
    out = joined.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), std(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"))
    return out.select(*by, "n", "mean", "std", "low", "high", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "skew", "kurtosis")


def summary_by_type(joined: DataFrame) -> DataFrame:
    """Over everything (type null) and for each type, in one pass of grouping sets."""
    return joined.groupingSets([[], ["type"]], "type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), std(F.col("value")).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))


def pairwise_differences(joined: DataFrame) -> DataFrame:
    """mean(a) - mean(b) for every ordered pair of algorithms and metric."""
    means = joined.groupBy("name", "algorithm").agg(F.avg("value").alias("m"))
    a, b = means.select("name", F.col("algorithm").alias("a"), F.col("m").alias("ma")), means.select("name", F.col("algorithm").alias("b"), F.col("m").alias("mb"))
    return a.join(b, "name").where("a <> b").select("name", "a", "b", (F.col("ma") - F.col("mb")).alias("difference"))


def effect_sizes(joined: DataFrame, baseline: str) -> DataFrame:
    """Against one algorithm: Cohen's d with the root mean of both variances, difference, relative improvement."""
    sd = F.when(F.count("value") > 1, F.stddev_samp("value")).otherwise(1e-10)
    stats = joined.groupBy("name", "algorithm").agg(F.avg("value").alias("mean"), sd.alias("std"))
    base = stats.where(F.col("algorithm") == baseline).select("name", F.col("mean").alias("bm"), F.col("std").alias("bs"))
    pooled = F.greatest(F.sqrt((F.col("bs") * F.col("bs") + F.col("std") * F.col("std")) / 2), F.lit(1e-15))
    change = F.col("mean") - F.col("bm")
    return stats.where(F.col("algorithm") != baseline).join(base, "name").select("name", "algorithm", "mean", "std", (change / pooled).alias("cohens_d"), change.alias("difference"), F.when(F.abs("bm") > 1e-15, change / F.abs("bm")).otherwise(0.0).alias("relative"))


def seed_analysis(joined: DataFrame) -> DataFrame:
    return joined.groupBy("seed", "algorithm").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), std(F.col("value")).alias("std"))


def pivot_table(joined: DataFrame, tasks: list[str]) -> DataFrame:
    return joined.groupBy("algorithm").pivot("task", tasks).agg(F.avg("value"))


def histogram(joined: DataFrame, bins: int, *by: str) -> DataFrame:
    """Equal-width bins between a group's least and greatest value, the last closed on the right."""
    limits = joined.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return joined.join(F.broadcast(limits) if not by else limits, list(by)).groupBy(*by, place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def metric_correlations(joined: DataFrame) -> DataFrame:
    """Pearson correlation of two metrics' means over the runs that have both; null below two runs or without spread."""
    means = joined.groupBy("run_id", "name").agg(F.avg("value").alias("m"))
    a, b = means.select("run_id", F.col("name").alias("a"), F.col("m").alias("x")), means.select("run_id", F.col("name").alias("b"), F.col("m").alias("y"))
    spread = (F.stddev_pop("x") >= 1e-15) & (F.stddev_pop("y") >= 1e-15)
    return a.join(b, "run_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.when(spread, F.nanvl(F.corr("x", "y"), F.lit(None).cast("double"))).alias("correlation"))


def percentile_rank(metrics: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """rank / (n - 1) * 100 in value order, ties broken by ``tie``; 100 for a single value.  A group is ranked in ranges."""
    placed = running_sums(metrics, by, ["value", *tie], F.lit(1))
    n = F.col("_all")
    return placed.withColumn("percentile", F.when(n > 1, F.col("_below") / F.greatest(n - 1, F.lit(1)) * 100).otherwise(100.0)).drop("_all", "_below")


def rank_algorithms(joined: DataFrame, descending: bool = True) -> DataFrame:
    means = joined.groupBy("name", "algorithm").agg(F.avg("value").alias("mean"))
    key = F.desc("mean") if descending else F.asc("mean")
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(key, "algorithm")).cast("long"))


def leaderboard(joined: DataFrame, k: int) -> DataFrame:
    """The k best runs by mean value: a bounded top-k, then their ranks."""
    runs = joined.groupBy("run_id", "algorithm").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))
    top = runs.orderBy(F.desc("mean"), "run_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "run_id")).cast("long"))


def best_run(joined: DataFrame) -> DataFrame:
    """The run of each metric's greatest value, the least run_id among equals."""
    return joined.groupBy("name").agg(F.max(F.struct("value", (-F.col("run_id")).alias("neg"))).alias("b")).select("name", (-F.col("b.neg")).alias("run_id"), F.col("b.value").alias("value"))


def timeline(runs: DataFrame, metrics: DataFrame, generations: DataFrame) -> DataFrame:
    """Runs with their numbers of metrics and generations, each counted before the join."""
    m = metrics.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_metrics"))
    g = generations.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_generations"))
    return runs.join(m, "run_id", "left").join(g, "run_id", "left").fillna(0, ["n_metrics", "n_generations"])


def timeline_compat(runs: DataFrame, metrics: DataFrame, generations: DataFrame) -> DataFrame:
    """As two plain left joins count: each number is the product of both, where both are not 0."""
    t = timeline(runs, metrics, generations)
    m, g = F.col("n_metrics"), F.col("n_generations")
    return t.withColumns({"n_metrics": m * F.greatest(g, F.lit(1)), "n_generations": g * F.greatest(m, F.lit(1))})


def orphans(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    return metrics.join(runs.select("run_id"), "run_id", "left_anti")


def duplicate_runs(runs: DataFrame, *config: str) -> DataFrame:
    """Configurations with more than one run, and their runs in order."""
    grouped = runs.groupBy(*config).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("run_id")).cast("array<string>"), ",").alias("runs"))
    return grouped.where("n > 1")


def progress(runs: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return runs.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), (done / F.count(F.lit(1))).alias("rate"))


SALTS = 64


def _sweep(points: DataFrame, objectives: list[str], by: list[str]) -> DataFrame:
    """The front of two objectives: of each x the greatest y, if no greater x has as great a y."""
    x, y = objectives
    tops = points.groupBy(*by, x).agg(F.max(y).alias("_top"))
    above = F.max("_top").over(Window.partitionBy(*by).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    best = tops.withColumn("_above", above).where("_above IS NULL OR _top > _above")
    best = best.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(x).alias("_x"), "_top")
    condition = (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_top"))
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return points.join(best, condition, "left_semi")


def _undominated(points: DataFrame, objectives: list[str], by: list[str]) -> DataFrame:
    """The front of any number of objectives by comparing the points of a group."""
    other = points.select(*[F.col(c).alias(f"_{c}") for c in (*by, *objectives)])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    weak = [F.col(f"_{c}") >= F.col(c) for c in objectives]
    strict = [F.col(f"_{c}") > F.col(c) for c in objectives]
    condition = reduce(lambda a, b: a | b, strict)
    for c in (*same, *weak):
        condition = condition & c
    return points.join(other, condition, "left_anti")


def pareto_front(points: DataFrame, objectives: list[str], by: list[str] = (), key: str = "id") -> DataFrame:
    """Points that no other of their group dominates (all objectives at least as great, one greater).

    A group is dealt by a salt first, and only the fronts of these parts meet, so
    a group of a third of all rows is no single task's.  Two objectives take a
    sweep in the order of the first, more of them comparisons.  Points without a
    value neither dominate nor are dominated.
    """
    by = list(by)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in objectives])
    front = _sweep if len(objectives) == 2 else _undominated
    part = points.where(~missing).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    return front(front(part, objectives, [*by, "_salt"]).drop("_salt"), objectives, by).unionByName(points.where(missing))
