"""Intervals, tests and pooled effects from moments and counts: one aggregation per group, no resampling on the driver."""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quantiles of the normal distribution (two-sided 95 %, power 80 %) and of the studentised range
#: over the square root of two at 5 % for 2 to 10 systems.
Z95, Z80 = 1.959963984540054, 0.8416212335729143
NEMENYI_05 = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def mean_interval(rows: DataFrame, by: list[str], value: str, z: float = Z95) -> DataFrame:
    a = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    half = z * F.col("_s") / F.sqrt("n")
    return a.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def share_interval(rows: DataFrame, by: list[str], success: Column, z: float = Z95) -> DataFrame:
    """Wilson and Agresti-Coull intervals of a share, cut to 0 and 1."""
    a = rows.groupBy(*by).agg(F.count_if(success).alias("k"), F.count(F.lit(1)).alias("n"))
    n, p = F.col("n"), F.col("k") / F.col("n")
    down, centre = 1 + z * z / n, p + z * z / (2 * n)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    more = n + z * z
    q = (F.col("k") + z * z / 2) / more
    half = z * F.sqrt(q * (1 - q) / more)
    cut = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return a.select(*by, "k", "n", cut((centre - margin) / down).alias("wilson_low"), cut((centre + margin) / down).alias("wilson_high"), cut(q - half).alias("agresti_low"), cut(q + half).alias("agresti_high"))


def _two(rows: DataFrame, by: list[str], is_x: Column, is_y: Column, value: str) -> DataFrame:
    side = lambda f, c, name: f(F.when(c, F.col(value))).alias(name)
    return rows.groupBy(*by).agg(F.count_if(is_x).alias("nx"), F.count_if(is_y).alias("ny"), side(F.avg, is_x, "mx"), side(F.avg, is_y, "my"), side(F.var_samp, is_x, "vx"), side(F.var_samp, is_y, "vy"))


def welch(rows: DataFrame, by: list[str], is_x: Column, is_y: Column, value: str) -> DataFrame:
    """Difference of means with Welch's and the pooled standard error, t and degrees of freedom."""
    a = _two(rows, by, is_x, is_y, value)
    ex, ey = F.col("vx") / F.col("nx"), F.col("vy") / F.col("ny")
    diff, se = F.col("mx") - F.col("my"), F.sqrt(ex + ey)
    pooled = ((F.col("nx") - 1) * F.col("vx") + (F.col("ny") - 1) * F.col("vy")) / (F.col("nx") + F.col("ny") - 2)
    df = (ex + ey) * (ex + ey) / (ex * ex / (F.col("nx") - 1) + ey * ey / (F.col("ny") - 1))
    return a.select(*by, diff.alias("diff"), se.alias("se"), df.alias("df"), (diff / se).alias("t"), F.sqrt(pooled * (1 / F.col("nx") + 1 / F.col("ny"))).alias("pooled_se"))


def sample_size(rows: DataFrame, by: list[str], is_x: Column, is_y: Column, value: str) -> DataFrame:
    """Cohen's d and the observations that a two-sided test at 5 % needs for 80 % power (two at least; a million if d is 0)."""
    a = _two(rows, by, is_x, is_y, value)
    pooled = F.sqrt(((F.col("nx") - 1) * F.col("vx") + (F.col("ny") - 1) * F.col("vy")) / (F.col("nx") + F.col("ny") - 2))
    d = (F.col("mx") - F.col("my")) / pooled
    need = F.ceil(((Z95 + Z80) / d) * ((Z95 + Z80) / d)).cast("long")
    return a.select(*by, d.alias("d"), F.when(d == 0, F.lit(1_000_000).cast("long")).otherwise(F.greatest(need, F.lit(2).cast("long"))).alias("n"))


def meta_analysis(studies: DataFrame) -> DataFrame:
    """studies (effect, se): fixed effects, heterogeneity, DerSimonian-Laird random effects."""
    w = 1 / (F.col("se") * F.col("se"))
    s = studies.select("effect", "se", w.alias("w"))
    a = s.agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("w1"), F.sum(F.col("w") * F.col("w")).alias("w2"), F.sum(F.col("w") * F.col("effect")).alias("we"), F.sum(F.col("w") * F.col("effect") * F.col("effect")).alias("wee"))
    mu = F.col("we") / F.col("w1")
    q = F.greatest(F.col("wee") - F.col("we") * mu, F.lit(0.0))
    spare, c = q - (F.col("k") - 1), F.col("w1") - F.col("w2") / F.col("w1")
    a = a.select("k", mu.alias("fixed"), (1 / F.sqrt("w1")).alias("fixed_se"), q.alias("q"), F.when(q > 0, F.greatest(spare / q * 100, F.lit(0.0))).otherwise(0.0).alias("i2"), F.when(c > 0, F.greatest(spare / c, F.lit(0.0))).otherwise(0.0).alias("tau2"))
    v = 1 / (F.col("se") * F.col("se") + F.col("tau2"))
    r = s.crossJoin(F.broadcast(a)).groupBy(*a.columns).agg(F.sum(v).alias("v1"), F.sum(v * F.col("effect")).alias("ve"))  # one row is broadcast
    return r.select("k", "fixed", "fixed_se", "q", "i2", "tau2", (F.col("ve") / F.col("v1")).alias("random"), (1 / F.sqrt("v1")).alias("random_se"))


def describe(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Moments and quartiles; skewness and excess kurtosis of the population, Jarque-Bera's statistic and its p."""
    x = F.col(value)
    a = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    return a.select(*by, "n", "mean", "std", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high", (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "skewness", "kurtosis", (F.col("std") / F.sqrt("n")).alias("se"), F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(0.0).alias("cv"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p_normal"))


def equal_variances(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Bartlett's statistic and Levene's from the medians."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.var_samp(value).alias("v"), F.median(value).alias("m"))
    a = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum((F.col("n") - 1) * F.col("v")).alias("s"), F.sum((F.col("n") - 1) * F.log("v")).alias("logs"), F.sum(1 / (F.col("n") - 1)).alias("inverse"))
    free = F.col("total") - F.col("k")
    bartlett = (free * F.log(F.col("s") / free) - F.col("logs")) / (1 + (F.col("inverse") - 1 / free) / (3 * (F.col("k") - 1)))
    z = rows.join(g.select(group, "m"), group).groupBy(group).agg(F.count(value).alias("n"), F.sum(F.abs(F.col(value) - F.col("m"))).alias("s"), F.sum((F.col(value) - F.col("m")) ** 2).alias("ss"))
    b = z.agg(F.count(F.lit(1)).alias("k2"), F.sum("n").alias("total2"), F.sum("s").alias("s2"), F.sum("ss").alias("ss2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b2"))
    levene = (F.col("total2") - F.col("k2")) / (F.col("k2") - 1) * (F.col("b2") - F.col("s2") * F.col("s2") / F.col("total2")) / (F.col("ss2") - F.col("b2"))
    return a.crossJoin(b).select(bartlett.alias("bartlett"), levene.alias("levene"))


def _ranked(rows: DataFrame, value: str) -> DataFrame:
    """Average ranks over all rows, from the counts of each different value."""
    c = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    below = F.sum("_c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    return rows.join(c.select(F.col(value).alias("_v"), "_c", (below + (F.col("_c") + 1) / 2).alias("_rank")), F.col(value) == F.col("_v"))


def kruskal_wallis(rows: DataFrame, group: str, value: str) -> DataFrame:
    """H with the correction for ties, and eta squared (H - k + 1) / (n - k)."""
    r = _ranked(rows, value)
    g = r.groupBy(group).agg(F.sum("_rank").alias("s"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("_c") * F.col("_c") - 1).alias("ties"))
    a = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("ties").alias("ties"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("b") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return a.select(h.alias("h"), ((h - F.col("k") + 1) / (n - F.col("k"))).alias("eta_squared"))


def cochran_q(votes: DataFrame) -> DataFrame:
    """votes (item, model, right): whether models are right equally often."""
    r = F.col("right").cast("long")
    models = votes.groupBy("model").agg(F.sum(r).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    items = votes.groupBy("item").agg(F.sum(r).alias("r")).agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    k = F.col("k")
    down = k * F.col("s") - F.col("rr")
    return models.crossJoin(items).select(F.when(down > 0, (k - 1) * (k * F.col("cc") - F.col("t") * F.col("t")) / down).otherwise(0.0).alias("q"), (k - 1).cast("long").alias("df"))


def nemenyi(scores: DataFrame, item: str, system: str, score: str) -> DataFrame:
    """Differences of mean ranks (ascending, ties averaged) of every pair of systems against the critical difference."""
    by = Window.partitionBy(item)
    rank = F.rank().over(by.orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(item, score)) - 1) / 2
    means = scores.withColumn("_r", rank).groupBy(system).agg(F.avg("_r").alias("m"), F.count(F.lit(1)).alias("n"))
    k = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))  # as many rows as systems
    means = means.withColumn("k", k)
    q = reduce(lambda c, kv: c.when(F.col("k") == kv[0], F.lit(kv[1])), NEMENYI_05.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(NEMENYI_05[10] + 0.03 * (F.col("k") - 10))
    pairs = means.select(F.col(system).alias("a"), "m", "n", "k").join(means.select(F.col(system).alias("b"), F.col("m").alias("o")), F.col("a") < F.col("b"))
    se = F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("n")))
    diff = F.abs(F.col("m") - F.col("o"))
    return pairs.select("a", "b", diff.alias("diff"), (diff / se).alias("z"), (q * se).alias("critical"), (diff >= q * se).alias("significant"))


def bayesian_sign(pairs: DataFrame, by: list[str], rope: float = 0.01) -> DataFrame:
    """pairs (by, x, y): posterior means of x better, equivalent, y better, from a uniform Dirichlet prior."""
    d = F.col("x") - F.col("y")
    a = pairs.groupBy(*by).agg(F.count_if(d > rope).alias("wins"), F.count_if(d < -rope).alias("losses"), F.count(F.lit(1)).alias("n"))
    ties, total = F.col("n") - F.col("wins") - F.col("losses"), F.col("n") + 3
    return a.select(*by, "wins", ties.alias("ties"), "losses", ((F.col("wins") + 1) / total).alias("p_x"), ((ties + 1) / total).alias("p_equal"), ((F.col("losses") + 1) / total).alias("p_y"))


def sign_flips(pairs: DataFrame, by: list[str], rounds: int = 200, seed: int = 42) -> DataFrame:
    """pairs (by, item, x, y): permutation test of a mean difference; the sign of an item in a round is a bit of an md5."""
    rows = pairs.select(*by, "item", (F.col("x") - F.col("y")).alias("d"))
    seen = rows.groupBy(*by).agg(F.round(F.abs(F.avg("d")), 9).alias("seen"))
    flipped = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    bit = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), "item")), 1, 1) < "8"
    means = flipped.groupBy(*by, "round").agg(F.round(F.abs(F.avg(F.when(bit, F.col("d")).otherwise(-F.col("d")))), 9).alias("m"))
    return means.join(seen, by).groupBy(*by, "seen").agg(((F.count_if(F.col("m") >= F.col("seen")) + 1) / (rounds + 1)).alias("p")).select(*by, F.col("seen").alias("difference"), "p")


def correlation_interval(rows: DataFrame, by: list[str], x: str, y: str, z: float = Z95) -> DataFrame:
    """Pearson's r with the interval of Fisher's transform."""
    a = rows.groupBy(*by).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    t, half = F.atanh("r"), z / F.sqrt(F.col("n") - 3)
    return a.select(*by, "r", F.tanh(t - half).alias("low"), F.tanh(t + half).alias("high"))


def independence(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of a contingency table, degrees of freedom, Cramer's V."""
    c = rows.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    left, right = c.groupBy(a).agg(F.sum("n").alias("na")), c.groupBy(b).agg(F.sum("n").alias("nb"))
    total = c.agg(F.sum("n").alias("t"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    # sum (n - e)^2 / e = sum n^2 / e - t, over the cells that have rows
    s = c.join(left, a).join(right, b).agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"))
    chi = F.col("t") * F.col("s") - F.col("t")
    least = F.least("ka", "kb") - 1
    return s.crossJoin(total).select(chi.alias("chi_square"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), F.sqrt(chi / (F.col("t") * least)).alias("cramers_v"))


def grubbs(rows: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """The row farthest from its group's mean, in standard deviations."""
    m = rows.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    d = rows.join(m, by).withColumn("_d", F.abs(F.col(value) - F.col("_m")) / F.col("_s"))
    best = d.groupBy(*by).agg(F.max(F.struct(F.round("_d", 9).alias("d"), (-F.col(key)).alias("k"))).alias("best"))
    return best.select(*by, (-F.col("best.k")).alias(key), F.col("best.d").alias("g_statistic"))


def unit_root(series: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """Dickey-Fuller with an intercept: t of the slope of the change on the value before, and a stepwise p."""
    order = Window.partitionBy(*by).orderBy(t)
    d = series.withColumn("_x", F.lag(value).over(order)).withColumn("_y", F.col(value) - F.col("_x")).where("_x IS NOT NULL")
    a = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    stat = F.col("slope") / F.sqrt(F.greatest(rest / (F.col("n") - 2) / F.col("sxx"), F.lit(1e-30)))
    p = F.when(stat < -3.43, 0.005).when(stat < -2.86, 0.03).when(stat < -2.57, 0.07).otherwise(F.least(F.lit(1.0), 0.1 + 0.15 * (stat + 2.57)))
    return a.select(*by, stat.alias("statistic"), p.alias("p"), (stat < -2.86).alias("stationary"))


def trend_forecast(series: DataFrame, by: list[str], t: str, value: str, horizon: int) -> DataFrame:
    """The linear trend carried on, with a band of 1.96 residual deviations."""
    a = series.groupBy(*by).agg(F.regr_slope(value, t).alias("s"), F.regr_intercept(value, t).alias("i"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n"), F.regr_syy(value, t).alias("syy"), F.regr_sxy(value, t).alias("sxy"))
    steps = a.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    forecast = F.col("i") + F.col("s") * (F.col("last") + F.col("step"))
    band = 1.96 * F.sqrt(F.greatest(F.col("syy") - F.col("s") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2))
    return steps.select(*by, F.col("step").cast("long").alias("step"), forecast.alias("forecast"), (forecast - band).alias("low"), (forecast + band).alias("high"))


def ucb1(rewards: DataFrame, arm: str, value: str, weight: float = 2.0) -> DataFrame:
    """Mean reward plus sqrt(weight ln N / n) of every arm, and its rank."""
    a = rewards.groupBy(F.col(arm).alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    everything = Window.partitionBy(F.lit(0))  # as many rows as arms
    score = F.col("mean") + F.sqrt(weight * F.log(F.sum("n").over(everything)) / F.col("n"))
    scored = a.withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "arm")).cast("long"))


def weighted_reservoir(rows: DataFrame, key: str, weight: Column, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement in proportion to weight: the greatest u ** (1 / w), u from an md5 of seed and key."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    return rows.select(key, (F.log(u) / weight).alias("priority")).where(weight > 0).orderBy(F.desc("priority"), key).limit(k)


def power_law(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Exponent, factor and fit of y = a x ** b by least squares on logarithms."""
    a = rows.where((F.col(x) > 0) & (F.col(y) > 0)).select(*by, F.log(x).alias("_x"), F.log(y).alias("_y")).groupBy(*by)
    return a.agg(F.regr_slope("_y", "_x").alias("exponent"), F.exp(F.regr_intercept("_y", "_x")).alias("factor"), F.regr_r2("_y", "_x").alias("r2"))


def front_quality(a: DataFrame, b: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Approximation ``a`` against reference ``b``, both (by, id, columns) to be minimised: IGD, IGD+, greatest error,
    share of b weakly dominated, additive epsilon.  Both are fronts, hence small; pairs are made inside a group."""
    left = a.select(*by, *[F.col(c).alias(f"_{c}") for c in columns])
    pairs = b.join(left, by)
    gap = [F.col(f"_{c}") - F.col(c) for c in columns]
    square, plus = sum(g * g for g in gap), sum(F.greatest(g, F.lit(0.0)) * F.greatest(g, F.lit(0.0)) for g in gap)
    each = pairs.groupBy(*by, "id").agg(F.sqrt(F.min(square)).alias("d"), F.sqrt(F.min(plus)).alias("dp"), F.min(F.greatest(*gap)).alias("e"))
    n = F.count(F.lit(1))
    return each.groupBy(*by).agg(F.sqrt(F.sum(F.col("d") * F.col("d")) / n).alias("igd"), F.sqrt(F.sum(F.col("dp") * F.col("dp")) / n).alias("igd_plus"), F.max("d").alias("greatest_error"), (F.count_if(F.col("e") <= 0) / n).alias("coverage"), F.max("e").alias("epsilon"))


def front_spread(front: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The spread indicator: how unlike the steps along a front are (0: equal)."""
    order = Window.partitionBy(*by).orderBy(x, "id")
    step = F.sqrt((F.lead(x).over(order) - F.col(x)) ** 2 + (F.lead(y).over(order) - F.col(y)) ** 2)
    d = front.withColumn("_d", step).withColumn("_k", F.row_number().over(order)).where("_d IS NOT NULL")
    a = d.groupBy(*by).agg(F.avg("_d").alias("m"), F.min_by("_d", "_k").alias("first"), F.max_by("_d", "_k").alias("last"), F.count(F.lit(1)).alias("n"))
    off = d.join(a, by).groupBy(*by).agg(F.sum(F.abs(F.col("_d") - F.col("m"))).alias("off"))
    ends = F.col("first") + F.col("last")
    return a.join(off, by).select(*by, F.when(F.col("m") > 0, (ends + F.col("off")) / (ends + F.col("n") * F.col("m"))).otherwise(0.0).alias("spread"))


def knee_point(front: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The point of a front farthest from the line between its ends (least and greatest x)."""
    ends = front.groupBy(*by).agg(F.min(F.struct(x, y)).alias("a"), F.max(F.struct(x, y)).alias("b"))
    dx, dy = F.col(f"b.{x}") - F.col(f"a.{x}"), F.col(f"b.{y}") - F.col(f"a.{y}")
    size = F.sqrt(dx * dx + dy * dy)
    away = F.when(size > 0, F.abs(dx * (F.col(f"a.{y}") - F.col(y)) - (F.col(f"a.{x}") - F.col(x)) * dy) / size).otherwise(0.0)
    best = front.join(ends, by).withColumn("_d", F.round(away, 9)).groupBy(*by).agg(F.max(F.struct("_d", (-F.col("id")).alias("k"))).alias("best"))
    return best.select(*by, (-F.col("best.k")).alias("id"), F.col("best._d").alias("distance"))


#: Different points that a task ranks at a time.
RANKED = 200_000


def _in_order(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of ``values``; nan is the greatest, as in Spark, and both zeros are one."""
    if values.dtype.kind in "iu":
        return values.astype(np.int64)
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return np.where(np.isnan(values), np.iinfo(np.int64).max, np.where(bits < 0, np.iinfo(np.int64).min - bits, bits))


def _chained(x: np.ndarray, y: np.ndarray, tops: list[int]) -> np.ndarray:
    """Ranks of different points, the greatest x first.  ``tops``, for each rank the greatest y of it so far, negated: no
    point met later has a greater x, so it follows every rank whose top is at least its y."""
    rank = np.empty(len(x), np.int64)
    for i, v in zip(order := np.lexsort((y, x))[::-1], (~y[order]).tolist()):
        k = bisect_right(tops, v)
        rank[i] = k
        tops[k : k + 1] = [v]
    return rank


def _ranked_pairs(points: DataFrame, by: list[str], x: str, y: str, size: int) -> DataFrame:
    """(by, x, y, rank) of the different pairs, in ranges of the order; a group's ranges follow one another, those of many groups run at once."""
    from motley.session import kept

    pairs = kept(points.select(*by, x, y).distinct())
    parts = max(1, math.ceil(pairs.count() / size))
    placed = kept(pairs.repartitionByRange(parts, *by, F.desc(x), F.desc(y)).withColumn("_part", F.spark_partition_id()))
    ranges = placed.select(*by, "_part").distinct()  # as many rows as groups and ranges
    turns = kept(ranges.withColumn("_turn", F.row_number().over(Window.partitionBy(*by).orderBy("_part"))))
    placed = placed.join(turns, reduce(lambda a, b: a & b, [placed[c].eqNullSafe(turns[c]) for c in [*by, "_part"]])).select(*[placed[c] for c in [*by, x, y]], "_turn")
    shape = T.StructType([*pairs.schema.fields, T.StructField("rank", T.LongType())])
    last = turns.agg(F.max("_turn").alias("n")).first()["n"] or 0
    tops, out = pairs.select(*by, y, F.lit(0).cast("long").alias("rank")).limit(0), None

    def rank(known: pa.Table, new: pa.Table) -> pa.Table:
        numbers = lambda t, c: _in_order(t.column(c).to_numpy())
        if not new.num_rows:
            return pa.table([*[pa.array([], f.type) for f in new.schema], pa.array([], pa.int64())], names=[*new.column_names, "rank"])
        known = known.sort_by("rank")
        return new.append_column("rank", pa.array(_chained(numbers(new, x), numbers(new, y), (~numbers(known, y)).tolist())))

    for turn in range(1, last + 1):
        # null groups meet as well: cogroup() takes nulls as equal
        now = placed.where(F.col("_turn") == turn).select(*by, x, y)
        found = kept(tops.groupBy(*by).cogroup(now.groupBy(*by)).applyInArrow(rank, shape))
        out = found if out is None else out.unionByName(found)
        if turn < last:
            tops = kept(tops.unionByName(found.select(*by, y, "rank")).groupBy(*by, "rank").agg(F.max(y).alias(y)).select(*by, y, "rank"))
    return out if out is not None else pairs.withColumn("rank", F.lit(0).cast("long"))


def dominance_ranks(points: DataFrame, by: list[str], objectives: list[str], size: int = RANKED) -> DataFrame:
    """(by, id, rank): rank 0 is the front, rank 1 the front without it, and so on.

    A rank is the length of the longest chain of points above, which for two numbers comes from one sweep over the different
    pairs, in ranges of some ``size``; other objectives take a pass for each rank, cut by checkpoint().  Points without a
    value have rank 0."""
    from motley.operators.results import pareto_front
    from motley.session import checkpoints

    checkpoints(points.sparkSession)
    kinds = {type(points.schema[c].dataType) for c in objectives}
    if len(objectives) == 2 and kinds <= {T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType}:
        x, y = objectives
        missing = F.col(x).isNull() | F.col(y).isNull()
        whole = points.select(*by, "id", x, y)
        ranks = _ranked_pairs(whole.where(~missing), by, x, y, size).select(*[F.col(c).alias(f"_{c}") for c in [*by, x, y]], "rank")
        met = whole.where(~missing).join(ranks, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, x, y]]))
        return met.select(*by, "id", "rank").unionByName(whole.where(missing).select(*by, "id", F.lit(0).cast("long").alias("rank")))
    left, out, rank = points.select(*by, "id", *objectives).checkpoint(), None, 0
    while not left.isEmpty():
        front = pareto_front(left, objectives, by).select(*by, "id").withColumn("rank", F.lit(rank).cast("long")).checkpoint()
        out = front if out is None else out.unionByName(front)
        left = left.join(front.select(*[F.col(c).alias(f"_{c}") for c in (*by, "id")]), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "id")]), "left_anti").checkpoint()
        rank += 1
    return out if out is not None else points.select(*by, "id", F.lit(0).cast("long").alias("rank"))
