"""Time series of diversity and other values: rolling windows, differences, correlation, change points, seasons.

A series has a group g, an order t (gap-free integers) and a value v.  All
windows are partitioned by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(by: str = "g", t: str = "t"):
    return Window.partitionBy(by).orderBy(t)


def rolling(series: DataFrame, width: int) -> DataFrame:
    """Centred mean and deviation over [t - width/2, t + width/2], clipped at the ends."""
    w = order().rowsBetween(-(width // 2), width // 2)
    return series.select("g", "t", F.avg("v").over(w).alias("mean"), F.coalesce(F.stddev_samp("v").over(w), F.lit(0.0)).alias("std"))


def difference(series: DataFrame, d: int = 1) -> DataFrame:
    for _ in range(d):
        series = series.withColumn("v", F.col("v") - F.lag("v").over(order())).where("v IS NOT NULL")
    return series.select("g", "t", "v")


def autocorrelation(series: DataFrame, lags: int) -> DataFrame:
    """(g, lag, r): mean of the products n - lag terms long, over the population variance; 0 without variance."""
    by = Window.partitionBy("g")
    x = series.withColumn("d", F.col("v") - F.avg("v").over(by))
    shifted = x.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(lags + 1)]))).select("g", (F.col("t") + F.col("_k")).alias("t"), "_k", F.col("d").alias("e"))
    both = x.join(shifted, ["g", "t"])
    var = x.groupBy("g").agg(F.avg(F.col("d") * F.col("d")).alias("var"))
    return both.groupBy("g", F.col("_k").cast("long").alias("lag")).agg(F.avg(F.col("d") * F.col("e")).alias("c")).join(var, "g").select("g", "lag", F.when(F.col("var") < 1e-15, 0.0).otherwise(F.col("c") / F.col("var")).alias("r"))


def cusum(series: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Standardised cumulative sums; a change is a local extremum beyond threshold * sqrt(n)."""
    by = Window.partitionBy("g")
    s = series.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("z", (F.col("v") - F.avg("v").over(by)) / F.stddev_pop("v").over(by))
    s = s.withColumn("c", F.sum("z").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    size, before, after = F.abs("c"), F.abs(F.lag("c").over(order())), F.abs(F.lead("c").over(order()))
    return s.select("g", "t", F.col("c").alias("cusum"), (before.isNotNull() & after.isNotNull() & (size > before) & (size >= after) & (size > threshold * F.sqrt("n"))).alias("change"))


def window_shift(series: DataFrame, width: int) -> DataFrame:
    """t statistic between the ``width`` values before and from each point."""
    left, right = order().rowsBetween(-width, -1), order().rowsBetween(0, width - 1)
    s = series.select("g", "t", F.avg("v").over(left).alias("a"), F.avg("v").over(right).alias("b"), F.var_samp("v").over(left).alias("va"), F.var_samp("v").over(right).alias("vb"), F.count("v").over(left).alias("na"), F.count("v").over(right).alias("nb"))
    error = F.sqrt((F.col("va") + F.col("vb")) / width)
    return s.where((F.col("na") == width) & (F.col("nb") == width)).select("g", "t", F.when(error > 0, (F.col("b") - F.col("a")) / error).otherwise(0.0).alias("stat"))


def trend(series: DataFrame, flat: float = 0.01) -> DataFrame:
    slope = F.regr_slope("v", "t")
    return series.groupBy("g").agg(slope.alias("slope"), F.regr_intercept("v", "t").alias("intercept"), F.regr_r2("v", "t").alias("r2")).withColumn("direction", F.when(F.col("slope") > flat, "up").when(F.col("slope") < -flat, "down").otherwise("flat"))


def seasonal(series: DataFrame, period: int) -> DataFrame:
    """Additive parts: centred moving average, mean of its residual by phase (centred on zero), remainder."""
    w = order().rowsBetween(-(period // 2), period // 2)
    s = series.withColumn("level", F.avg("v").over(w)).withColumn("phase", F.pmod("t", F.lit(period)))
    by_phase = Window.partitionBy("g", "phase")
    s = s.withColumn("raw", F.avg(F.col("v") - F.col("level")).over(by_phase))
    s = s.withColumn("season", F.col("raw") - F.avg("raw").over(Window.partitionBy("g")))
    return s.select("g", "t", F.col("level"), "season", (F.col("v") - F.col("level") - F.col("season")).alias("rest"))


def ewma(series: DataFrame, alpha: float) -> DataFrame:
    """Exponential smoothing s_t = a v_t + (1 - a) s_(t-1), started at the first value, as one fold over each group's ordered values."""
    grouped = series.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("x"))
    start = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<struct<t:bigint,s:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = F.when(a["s"].isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * a["s"])
        return F.struct(s.alias("s"), F.concat(a["out"], F.array(F.struct(x["t"].cast("long").alias("t"), s.alias("s")))).alias("out"))

    return grouped.select("g", F.explode(F.aggregate("x", start, step)["out"]).alias("o")).select("g", "o.t", F.col("o.s").alias("smooth"))


def crossings(series: DataFrame) -> DataFrame:
    """Running best value and how often it was improved."""
    best = F.max("v").over(order().rowsBetween(Window.unboundedPreceding, 0))
    s = series.withColumn("best", best).withColumn("_before", F.lag("best").over(order()))
    return s.select("g", "t", "best", F.sum(F.when(F.col("v") > F.coalesce("_before", F.lit(float("-inf"))), 1).otherwise(0)).over(order().rowsBetween(Window.unboundedPreceding, 0)).alias("improvements"))
