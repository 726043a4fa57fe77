"""Rank statistics, corrections, effect sizes, agreement and multi-objective measures as aggregates and windows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.session import kept


def average_rank(value: Column, by: list[str], descending: bool = False) -> Column:
    """1-based rank with ties averaged."""
    order = Window.partitionBy(*by).orderBy(value.desc() if descending else value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; 0 below two rows or without spread."""
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by equal keys, nulls being equal; the columns of ``b`` without its keys follow."""
    b = b.select(*[F.col(c).alias(f"_of_{c}") if c in keys else F.col(c) for c in b.columns])
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return a.join(b, met, how).drop(*[f"_of_{k}" for k in keys])


def in_ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` as a table with ``_part``, the ranges of (by, order) that they were dealt out to: no group is one task."""
    return rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).transform(kept)


def before_part(parts: DataFrame, by: list[str], total: str) -> DataFrame:
    """Adds ``_before`` and ``_all``: the sum of ``total`` in earlier ranges of the group, and in all of them."""
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum(total).over(ahead), F.lit(0))).withColumn("_all", F.sum(total).over(every))


def running_sums(rows: DataFrame, by: list[str], order: list[str], count: Column) -> DataFrame:
    """Adds ``_below``, the sum of ``count`` over the rows of the group before a row in ``order`` (which leaves no ties), and
    ``_all``, that over the group.  Ranges are summed apart; only their totals meet."""
    rows = in_ranges(rows.withColumn("_count", count.cast("long")), by, order)
    keys = [*by, "_part"]
    parts = before_part(rows.groupBy(*keys).agg(F.sum("_count").alias("_total")), by, "_total").drop("_total")
    inside = F.sum("_count").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_count")
    return same_keys(rows.withColumn("_inside", inside), parts, keys).withColumn("_below", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside", "_count")


def ranked_values(counts: DataFrame, by: list[str], value: str, count: Column) -> DataFrame:
    """counts (by, value, ...), one row a value, with ``_rank`` (1-based, ties averaged, ``count`` rows a value) and ``_all``."""
    return running_sums(counts, by, [value], count).withColumn("_rank", F.col("_below") + (count + 1) / 2).drop("_below")


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of the average ranks.  Values are counted before they are ranked, so a group is not sorted as one."""
    cells = rows.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_c")).transform(kept)

    def ranks(c: str, name: str) -> DataFrame:
        ranked = ranked_values(cells.groupBy(*by, c).agg(F.sum("_c").alias("_n")), by, c, F.col("_n"))
        return ranked.select(*by, c, (F.col("_rank") - (F.col("_all") + 1) / 2).alias(name))  # 0 is the mean

    both = same_keys(same_keys(cells, ranks("_x", "_dx"), [*by, "_x"]), ranks("_y", "_dy"), [*by, "_y"])
    total = lambda a, b: F.sum(F.col("_c") * F.col(a) * F.col(b))
    sums = both.groupBy(*by).agg(total("_dx", "_dy").alias("_xy"), total("_dx", "_dx").alias("_xx"), total("_dy", "_dy").alias("_yy"))
    spread = F.sqrt("_xx") * F.sqrt("_yy")
    return sums.select(*by, F.when(spread > 0, F.col("_xy") / spread).otherwise(0.0).alias("rho"))


def partial_correlation(rows: DataFrame, x: str, y: str, z: str, by: list[str]) -> DataFrame:
    """Of x and y given z; 0 if the denominator is below 1e-15."""
    c = rows.groupBy(*by).agg(safe_corr(F.col(x), F.col(y)).alias("xy"), safe_corr(F.col(x), F.col(z)).alias("xz"), safe_corr(F.col(y), F.col(z)).alias("yz"))
    down = F.sqrt(F.greatest((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")), F.lit(0.0)))
    return c.select(*by, F.when(down < 1e-15, 0.0).otherwise((F.col("xy") - F.col("xz") * F.col("yz")) / down).alias("partial"))


def kendall_tau_b(long: DataFrame, item: str, metric: str, value: str) -> DataFrame:
    """(a, b, tau) for every pair of metrics, from signs of differences over pairs of items."""
    v = long.select(F.col(item).alias("i"), F.col(metric).alias("m"), F.col(value).alias("v"))
    w = v.select(F.col("i").alias("j"), F.col("m").alias("n"), F.col("v").alias("w"))
    signs = v.join(w, (v.m == w.n) & (v.i < w.j)).select("i", "j", "m", F.signum(F.col("v") - F.col("w")).alias("s"))
    other = signs.select("i", "j", F.col("m").alias("b"), F.col("s").alias("t"))
    both = signs.withColumnRenamed("m", "a").join(other, ["i", "j"]).where("a < b")
    up = F.sum(F.col("s") * F.col("t"))
    down = F.sqrt(F.sum(F.abs("s")) * F.sum(F.abs("t")))
    return both.groupBy("a", "b").agg(F.when(down > 0, up / down).otherwise(0.0).alias("tau"))


def corrected_p(tests: DataFrame, p: str = "p", key: str = "id") -> DataFrame:
    """Bonferroni, Holm, Benjamini-Hochberg and Benjamini-Yekutieli p-values over all rows of a table of tests.

    Rows are ranked in ranges of (p, key); the running greatest and least values come from those of the ranges before and behind.
    """
    order, one = [p, key], F.lit(1.0)
    t = running_sums(tests.select(key, p), [], order, F.lit(1)).withColumn("_r", F.col("_below") + 1).withColumn("_n", F.col("_all"))
    t = t.withColumn("_down", F.col(p) * (F.col("_n") - F.col("_r") + 1)).withColumn("_up", F.col(p) * F.col("_n") / F.col("_r"))
    t = in_ranges(t.select(key, p, "_r", "_n", "_down", "_up"), [], order)
    parts, every = t.groupBy("_part").agg(F.max("_down").alias("_high"), F.min("_up").alias("_low")), Window.partitionBy(F.lit(0)).orderBy("_part")  # a row a range
    parts = parts.select("_part", F.max("_high").over(every.rowsBetween(Window.unboundedPreceding, -1)).alias("_high"), F.min("_low").over(every.rowsBetween(1, Window.unboundedFollowing)).alias("_low"))
    harmonic = t.agg(F.sum(1 / F.col("_r")).alias("_h"))
    inside = lambda *keys: Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    # from the other end: a frame up to the last row is summed anew for every row
    down, up = F.max("_down").over(inside(*order)), F.min("_up").over(inside(F.desc(p), F.desc(key)))
    near = t.withColumn("_down", down).withColumn("_up", up).join(parts, "_part").crossJoin(F.broadcast(harmonic))  # one row is broadcast
    step = F.least("_up", "_low")
    return near.select(key, F.least(F.col(p) * F.col("_n"), one).alias("bonferroni"), F.least(F.greatest("_down", "_high"), one).alias("holm"), F.least(step, one).alias("bh"), F.least(step * F.col("_h"), one).alias("by"))


def two_sample_effects(rows: DataFrame, by: list[str], group: str, value: str, x: str, y: str) -> DataFrame:
    """Cohen's d (pooled), Hedges' g, Glass' delta (y's deviation), Cliff's delta, CLES, rank-biserial (negative if x is larger)."""
    v = rows.where(F.col(group).isin(x, y)).select(*by, F.col(group).alias("_g"), F.col(value).alias("_v"))
    is_x, is_y = F.col("_g") == x, F.col("_g") == y
    a = v.groupBy(*by).agg(
        F.count_if(is_x).alias("nx"), F.count_if(is_y).alias("ny"), F.avg(F.when(is_x, F.col("_v"))).alias("mx"), F.avg(F.when(is_y, F.col("_v"))).alias("my"),
        F.coalesce(F.var_samp(F.when(is_x, F.col("_v"))), F.lit(0.0)).alias("vx"), F.coalesce(F.var_samp(F.when(is_y, F.col("_v"))), F.lit(0.0)).alias("vy"),
    )
    # the ranks of x are summed value by value
    c = v.groupBy(*by, "_v").agg(F.count_if(is_x).alias("_cx"), F.count(F.lit(1)).alias("_c"))
    r = ranked_values(c, by, "_v", F.col("_c")).groupBy(*by).agg(F.sum(F.col("_cx") * F.col("_rank")).alias("rx"))
    a = same_keys(a, r, by)
    nx, ny = F.col("nx"), F.col("ny")
    df, diff = nx + ny - 2, F.col("mx") - F.col("my")
    pooled = F.sqrt(((nx - 1) * F.col("vx") + (ny - 1) * F.col("vy")) / df)
    d = F.when(pooled > 0, diff / pooled).otherwise(0.0)
    u = F.col("rx") - nx * (nx + 1) / 2  # pairs with x above y, ties one half
    return a.select(*by, d.alias("cohens_d"), (d * (1 - 3 / (4 * df - 1))).alias("hedges_g"), F.when(F.col("vy") > 0, diff / F.sqrt("vy")).otherwise(0.0).alias("glass_delta"), (2 * u / (nx * ny) - 1).alias("cliffs_delta"), (u / (nx * ny)).alias("cles"), (1 - 2 * u / (nx * ny)).alias("rank_biserial"))


def outliers(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Flags by the interquartile, z-score and median-deviation rules."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    x = rows.join(q, by)
    spread = F.col("_q")[2] - F.col("_q")[0]
    mad = rows.join(q, by).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_q")[1])).alias("_mad"))
    v = F.col(value)
    return x.join(mad, by).select(*rows.columns, ((v < F.col("_q")[0] - 1.5 * spread) | (v > F.col("_q")[2] + 1.5 * spread)).alias("by_iqr"), ((F.col("_s") > 0) & (F.abs(v - F.col("_m")) / F.col("_s") > 3)).alias("by_z"), ((F.col("_mad") > 0) & (F.abs(0.6745 * (v - F.col("_q")[1]) / F.col("_mad")) > 3.5)).alias("by_mad"))


def concordance(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    a = rows.groupBy(*by).agg(safe_corr(F.col(x), F.col(y)).alias("r"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    gap = F.col("mx") - F.col("my")
    return a.select(*by, (2 * F.col("r") * F.col("sx") * F.col("sy") / (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + gap * gap)).alias("ccc"))


def rank_summary(scores: DataFrame, item: str, system: str, score: str) -> DataFrame:
    """Per system: mean rank (descending, ties averaged), mean reciprocal rank, rank deviation, Borda and Copeland scores."""
    r = scores.withColumn("_r", average_rank(F.col(score), [item], descending=True))
    k = scores.groupBy(item).agg(F.count(F.lit(1)).alias("_k"))
    base = r.join(k, item).groupBy(system).agg(F.avg("_r").alias("mean_rank"), F.avg(1 / F.col("_r")).alias("mrr"), F.coalesce(F.stddev_samp("_r"), F.lit(0.0)).alias("rank_std"), F.sum(F.col("_k") - F.col("_r")).alias("borda"))
    other = scores.select(item, F.col(system).alias("_o"), F.col(score).alias("_w"))
    duel = scores.join(other, item).where(F.col(system) != F.col("_o")).groupBy(system, "_o").agg(F.avg((F.col(score) > F.col("_w")).cast("double")).alias("_win"))
    copeland = duel.groupBy(system).agg(F.sum(F.when(F.col("_win") > 0.5, 1).when(F.col("_win") < 0.5, -1).otherwise(0)).alias("copeland"))
    return base.join(copeland, system)


def head_to_head(scores: DataFrame, item: str, system: str, score: str) -> DataFrame:
    """(a, b, wins, losses, ties, win_rate with ties as one half)."""
    other = scores.select(item, F.col(system).alias("b"), F.col(score).alias("_w"))
    d = F.col(score) - F.col("_w")
    pairs = scores.withColumnRenamed(system, "a").join(other, item).where("a <> b")
    wins, ties = F.count_if(d >= 1e-12), F.count_if(F.abs(d) < 1e-12)
    return pairs.groupBy("a", "b").agg(wins.alias("wins"), F.count_if(d <= -1e-12).alias("losses"), ties.alias("ties"), ((wins + ties / 2) / F.count(F.lit(1))).alias("win_rate"))


def ensemble_diversity(votes: DataFrame) -> DataFrame:
    """votes (item, model, vote, truth): disagreement, Q statistic, double fault, correlation of every pair of models."""
    a = votes.select("item", F.col("model").alias("a"), F.col("vote").alias("va"), "truth")
    b = votes.select("item", F.col("model").alias("b"), F.col("vote").alias("vb"))
    p = a.join(b, "item").where("a < b").withColumn("x", F.col("va") == F.col("truth")).withColumn("y", F.col("vb") == F.col("truth"))
    n11, n00 = F.count_if(F.col("x") & F.col("y")), F.count_if(~F.col("x") & ~F.col("y"))
    n10, n01 = F.count_if(F.col("x") & ~F.col("y")), F.count_if(~F.col("x") & F.col("y"))
    t = p.groupBy("a", "b").agg(F.avg((F.col("va") != F.col("vb")).cast("double")).alias("disagreement"), n11.cast("double").alias("p"), n00.cast("double").alias("q"), n10.cast("double").alias("r"), n01.cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
    up, down = F.col("p") * F.col("q") - F.col("r") * F.col("s"), F.col("p") * F.col("q") + F.col("r") * F.col("s")
    spread = F.sqrt((F.col("p") + F.col("r")) * (F.col("p") + F.col("s")) * (F.col("q") + F.col("r")) * (F.col("q") + F.col("s")))
    return t.select("a", "b", "disagreement", F.when(F.abs(down) < 1e-15, 0.0).otherwise(up / down).alias("q_statistic"), F.when(spread < 1e-15, 0.0).otherwise(up / spread).alias("rho"), (F.col("q") / F.col("n")).alias("double_fault"))


def vote_entropy(votes: DataFrame) -> DataFrame:
    """Mean entropy (bits) of the votes on an item, Kohavi-Wolpert variance of being right, majority vote accuracy (ties: smallest label)."""
    c = votes.groupBy("item", "truth", "vote").agg(F.count(F.lit(1)).alias("c"))
    per = c.groupBy("item", "truth").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"), (F.sum(F.when(F.col("vote") == F.col("truth"), F.col("c")).otherwise(0)) / F.sum("c")).alias("p"), F.min_by("vote", F.struct(-F.col("c"), F.col("vote"))).alias("majority"))
    return per.agg(F.avg("h").alias("vote_entropy"), F.avg(F.col("p") * (1 - F.col("p"))).alias("kw_variance"), F.avg((F.col("majority") == F.col("truth")).cast("double")).alias("majority_accuracy"))


def cohen_kappa(ratings: DataFrame, weighted: bool) -> DataFrame:
    """ratings (item, a, b) of two raters: kappa, with squared weights if ``weighted``, from the joint and marginal counts."""
    pair = ratings.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = ratings.count()
    left, right = pair.groupBy("a").agg(F.sum("n").alias("na")), pair.groupBy("b").agg(F.sum("n").alias("nb"))
    weight = (lambda a, b: (a - b) * (a - b)) if weighted else (lambda a, b: (a != b).cast("double"))
    seen = pair.agg((F.sum(weight(F.col("a"), F.col("b")) * F.col("n")) / total).alias("seen"))
    chance = left.crossJoin(right).agg((F.sum(weight(F.col("a"), F.col("b")) * F.col("na") * F.col("nb")) / total / total).alias("chance"))
    return seen.crossJoin(chance).select(F.when(F.col("chance") > 0, 1 - F.col("seen") / F.col("chance")).otherwise(1.0).alias("kappa"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """ratings (item, category), the same number for each item."""
    c = ratings.groupBy("item", "category").agg(F.count(F.lit(1)).cast("double").alias("c"))
    per = c.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree")).agg(F.avg(F.col("agree") / (F.col("n") * (F.col("n") - 1))).alias("seen"))
    share = c.groupBy("category").agg(F.sum("c").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(0)))).agg(F.sum(F.col("p") * F.col("p")).alias("chance"))
    return per.crossJoin(share).select(((F.col("seen") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


def icc_oneway(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One-way intraclass correlation from the analysis of variance, with the mean group size corrected for imbalance."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    a = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("N")) / (F.col("k") - 1)
    within = (F.col("ss") - F.col("b")) / (F.col("N") - F.col("k"))
    n0 = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("k") - 1)
    return a.select(between.alias("ms_between"), within.alias("ms_within"), ((between - within) / (between + (n0 - 1) * within)).alias("icc"))


def gini(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(value)
    r = rows.withColumn("_i", F.row_number().over(order))
    n, total = F.count(F.lit(1)), F.sum(value)
    return r.groupBy(*by).agg(F.when(total > 0, 2 * F.sum(F.col("_i") * F.col(value)) / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def group_balance(rows: DataFrame, group: str) -> DataFrame:
    """Shares of groups, their distance to equal shares (4 digits), chi-square to uniform, max/min ratio."""
    c = rows.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    k, total = F.count(F.lit(1)).over(everything), F.sum("n").over(everything)
    even = total / k
    return c.select("g", "n", F.round(F.col("n") / total - 1 / k, 4).alias("parity"), F.sum((F.col("n") - even) * (F.col("n") - even) / even).over(everything).alias("chi_square"), (F.max("n").over(everything) / F.min("n").over(everything)).alias("ratio"))


def hypervolume_2d(points: DataFrame, by: list[str], x: str, y: str, ref: tuple[float, float]) -> DataFrame:
    """Dominated area of points to be minimised: the staircase of running minima of y in x order."""
    p = points.where((F.col(x) < ref[0]) & (F.col(y) < ref[1])).groupBy(*by, x).agg(F.min(y).alias(y))
    order = Window.partitionBy(*by).orderBy(x)
    step = p.withColumn("_next", F.coalesce(F.lead(x).over(order), F.lit(ref[0]))).withColumn("_low", F.min(y).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return step.groupBy(*by).agg(F.sum((F.col("_next") - F.col(x)) * (ref[1] - F.col("_low"))).alias("hypervolume"))


def crowding_distance(points: DataFrame, by: list[str], objectives: list[str], key: str = "id") -> DataFrame:
    """Sum over objectives of (next - previous) / range; infinite at the ends and for two points or fewer."""
    out, n = points, F.count(F.lit(1)).over(Window.partitionBy(*by))
    total = F.lit(0.0)
    for o in objectives:
        order = Window.partitionBy(*by).orderBy(o, key)
        whole = Window.partitionBy(*by)
        spread = F.max(o).over(whole) - F.min(o).over(whole)
        gap = F.lead(o).over(order) - F.lag(o).over(order)
        total = total + F.when(spread <= 0, 0.0).otherwise(F.when(gap.isNull(), F.lit(float("inf"))).otherwise(gap / spread))
    return out.select(*by, key, F.when(n <= 2, F.lit(float("inf"))).otherwise(total).alias("crowding"))


#: Points of a tile, and bits of a place on the curve that deals them out.
TILE, CURVE = 512, 52


def _on_curve(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Z-order curve: the bits of all columns by turns."""
    place = np.zeros(len(cells), np.int64)
    for bit in range(bits):
        for k, column in enumerate(cells.T):
            place |= ((column >> bit) & 1) << (bit * cells.shape[1] + k)
    return place


def _tiles(points: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Different points (g, columns) as tiles (g, tile, low, high, p), each at most ``size`` neighbours on a curve, packed point by point."""
    d, kind = len(columns), points.schema["g"].dataType.simpleString()
    bits = CURVE // d
    box = points.groupBy("g").agg(*[f(c).alias(f"_{n}{k}") for k, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))])
    part = lambda k, c: F.when(F.col(f"_b{k}") > F.col(f"_a{k}"), (F.col(c) - F.col(f"_a{k}")) / (F.col(f"_b{k}") - F.col(f"_a{k}"))).otherwise(0.0)
    cells = [F.floor(part(k, c) * (2**bits - 1)).cast("long").alias(f"_c{k}") for k, c in enumerate(columns)]
    placed = points.join(box, "g").select("g", F.to_json("g").alias("name"), F.array(*columns).alias("p"), *cells)

    def place(batches):
        for b in batches:
            at = _on_curve(np.stack([b.column(f"_c{k}").to_numpy() for k in range(d)], axis=1), bits)
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("name"), pa.array(at), b.column("p")], ["g", "name", "at", "p"])

    def cut(batches):
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("p").flatten().to_numpy().reshape(-1, d)
            g = b.column("name").dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.append(True, np.diff(g) != 0))
            starts = np.concatenate([np.arange(a, e, size) for a, e in zip(new, np.append(new[1:], len(g)))]).astype(np.int32)
            lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), d).cast(pa.list_(pa.float64()))
            packed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(g)).astype(np.int32) * d), pa.array(x.ravel()))
            tile = pa.array(base + n + np.arange(len(starts)))
            n += len(starts)
            yield pa.RecordBatch.from_arrays([b.column("g").take(pa.array(starts)), tile, lists(np.minimum.reduceat(x, starts)), lists(np.maximum.reduceat(x, starts)), packed], ["g", "tile", "low", "high", "p"])

    curve = placed.mapInArrow(place, f"g {kind}, name string, at long, p array<double>")
    sorted_ = curve.repartitionByRange("name", "at").sortWithinPartitions("name", "at")
    return sorted_.mapInArrow(cut, f"g {kind}, tile long, low array<double>, high array<double>, p array<double>")


def _tile_distances(pairs: DataFrame, d: int) -> DataFrame:
    """(g, tile, place, square, bound) for pairs (g, tile, p, r, bound): squares from each point of p to the nearest of r that is elsewhere, below ``bound``."""
    kind = pairs.schema["g"].dataType.simpleString()

    def near(batches):
        for b in batches:
            out = []
            for k in range(b.num_rows):
                x, y = (b.column(c)[k].values.to_numpy().reshape(-1, d) for c in ("p", "r"))
                gaps = [x[:, None, j] - y[None, :, j] for j in range(d)]
                square = gaps[0] * gaps[0]
                for gap in gaps[1:]:
                    square += gap * gap
                square[np.logical_and.reduce([gap == 0 for gap in gaps])] = np.inf
                least = square.min(axis=1)
                some = np.flatnonzero(least < b.column("bound")[k].as_py())
                out.append((np.full(len(some), k), some, least[some]))
            row, at, square = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column("g").take(pa.array(row)), b.column("tile").take(pa.array(row)), pa.array(at.astype(np.int64)), pa.array(square)], ["g", "tile", "place", "square"])

    return pairs.mapInArrow(near, f"g {kind}, tile long, place long, square double")


def _nearest_elsewhere(a: DataFrame, b: DataFrame, columns: list[str], size: int) -> DataFrame:
    """(g, columns, square) of the different points ``a``: to the nearest of the different points ``b`` that is elsewhere.

    Each tile of ``a`` meets the two tiles of ``b`` whose boxes are nearest, which bounds its distances, and then those
    whose boxes lie within the bound.  Boxes meet all boxes of their group: a pair for ``size`` * ``size`` pairs of points."""
    d = len(columns)
    left, right = kept(_tiles(a, columns, size)), kept(_tiles(b, columns, size).withColumnsRenamed({"tile": "other", "low": "rlow", "high": "rhigh", "p": "r"}))
    axis = lambda k: F.greatest(F.get("rlow", F.lit(k)) - F.get("high", F.lit(k)), F.get("low", F.lit(k)) - F.get("rhigh", F.lit(k)), F.lit(0.0))
    # the sum is rounded, so a box counts as a little nearer than it is
    gap = sum((axis(k) * axis(k) for k in range(1, d)), axis(0) * axis(0)) * (1 - 1e-12)
    salts = F.explode(F.array(*[F.lit(k) for k in range(32)]))
    boxes = left.drop("p").withColumn("_s", F.pmod("tile", F.lit(32)).cast("int")).join(right.drop("r").withColumn("_s", salts), ["g", "_s"]).select("g", "tile", "other", gap.alias("gap"))
    # a single point's own place is no neighbour, so one tile may hold nothing for it: two hold at least one point elsewhere
    nearest = boxes.groupBy("g", "tile").agg(F.min_by("other", F.struct("gap", "other")).alias("o1"))
    second = boxes.join(nearest, ["g", "tile"]).where("other <> o1").groupBy("g", "tile").agg(F.min_by("other", F.struct("gap", "other")).alias("other"))
    first = kept(nearest.select("g", "tile", F.col("o1").alias("other")).unionByName(second))
    full = lambda pairs: pairs.join(left.select("g", "tile", "p"), ["g", "tile"]).join(right.select("g", "other", "r"), ["g", "other"])
    met = kept(_tile_distances(full(first).withColumn("bound", F.lit(float("inf"))), d).groupBy("g", "tile", "place").agg(F.min("square").alias("square")))
    sizes = left.select("g", "tile", (F.size("p") / d).alias("n"))
    bound = sizes.join(met.groupBy("g", "tile").agg(F.max("square").alias("worst"), F.count(F.lit(1)).alias("k")), ["g", "tile"], "left")
    bound = bound.select("g", "tile", F.when(F.col("k") == F.col("n"), F.col("worst")).otherwise(float("inf")).alias("bound"))
    rest = boxes.join(bound, ["g", "tile"]).where("gap < bound").join(first, ["g", "tile", "other"], "left_anti").select("g", "tile", "other", "bound")
    every = met.unionByName(_tile_distances(full(rest), d)).groupBy("g", "tile", "place").agg(F.min("square").alias("square"))
    points = left.select("g", "tile", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("p") / d - 1).cast("int")), lambda i: F.slice("p", (i * d + 1).cast("int"), d))).alias("place", "x"))
    return every.join(points, ["g", "tile", "place"]).select("g", *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate(columns)], "square")


def nearest_distances(a: DataFrame, b: DataFrame, by: list[str], columns: list[str], size: int = TILE) -> DataFrame:
    """For each point of ``a`` the Euclidean distance to the nearest other point of ``b``, null where a value is missing; values are finite.

    Points at one place are compared once: a place that ``b`` has under another id is at distance 0, for the others the
    different places meet tile by tile."""
    values = [F.col(c).cast("double").alias(c) for c in columns]
    rows = kept(a.select(F.struct(*by).alias("g"), "id", *values))
    others = kept(b.select(F.struct(*by).alias("g"), "id", *values))
    known = reduce(lambda x, y: x & y, [F.col(f"g.{c}").isNotNull() for c in by])
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns])
    ids = lambda *keys: others.where(known).groupBy(*keys).agg(F.min("id").alias("_least"), F.max("id").alias("_most"))
    another = (F.col("_least") != F.col("id")) | (F.col("_most") != F.col("id"))
    some = rows.join(ids("g"), "g").where(another).select("g", "id", *columns)
    placed = kept(some.where(whole).join(ids("g", *columns), ["g", *columns], "left").select("g", "id", *columns, F.coalesce(another, F.lit(False)).alias("_met")))
    found = _nearest_elsewhere(placed.where("NOT _met").select("g", *columns).distinct(), others.where(known & whole).select("g", *columns).distinct(), columns, size)
    far = placed.where("NOT _met").join(found, ["g", *columns], "left").select("g", "id", F.sqrt("square").alias("distance"))
    zero = placed.where("_met").select("g", "id", F.lit(0.0).alias("distance"))
    none = some.where(~whole).select("g", "id", F.lit(None).cast("double").alias("distance"))
    return far.unionByName(zero).unionByName(none).groupBy("g", "id").agg(F.min("distance").alias("distance")).select("g.*", "id", "distance")


def selection_fairness(rows: DataFrame, selected: Column) -> DataFrame:
    """rows (g, ...) to one row: the greatest difference between a group's share of the selected rows and of all rows, the least
    ratio of both shares, the least and greatest share of the selected and their gap.  Nothing selected: all 0."""
    g = rows.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(selected).cast("double").alias("k"))
    total = g.agg(F.sum("n").alias("all"), F.sum("k").alias("chosen"))  # one row is broadcast
    share, ratio = F.col("k") / F.col("chosen"), F.col("n") / F.col("all")
    parts = g.crossJoin(F.broadcast(total)).where("chosen > 0")
    of = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return parts.agg(of(F.max(F.abs(share - ratio)), "parity_gap"), of(F.min(share / ratio), "least_ratio"), of(F.min(share), "least_share"), of(F.max(share), "greatest_share"), of(F.max(share) - F.min(share), "share_gap"))


def intersections(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, score): how many rows each combination of the values of two columns has, absent ones too; the score is half of
    the count over an equal share, at most 1 (4 digits).  Rows without one of the values are left out.  Every value of ``a`` meets
    every value of ``b``: the columns are axes of few values."""
    c = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    grid = c.select(a).distinct().withColumn("_one", F.lit(1)).join(c.select(b).distinct().withColumn("_one", F.lit(1)), "_one")
    total = c.agg(F.sum("n").alias("_rows"), (F.countDistinct(a) * F.countDistinct(b)).alias("_cells"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(c, [a, b], "left").crossJoin(F.broadcast(total)).select(a, b, n.alias("n"), F.round(F.least(n / (F.col("_rows") / F.col("_cells")), F.lit(2.0)) / 2, 4).alias("score"))


def intersection_evenness(cells: DataFrame) -> DataFrame:
    """One row: the entropy of the counts of ``intersections`` over the logarithm of their number; 1 for one cell."""
    n = F.col("n").cast("double")
    h = F.log(F.sum(n)) - F.sum(F.when(n > 0, n * F.log(n)).otherwise(0.0)) / F.sum(n)
    return cells.agg(F.when(F.count(F.lit(1)) > 1, h / F.log(F.count(F.lit(1)))).otherwise(1.0).alias("evenness"))


def hypervolume_3d(points: DataFrame, by: list[str], columns: list[str], ref: tuple[float, float, float]) -> DataFrame:
    """Dominated volume of points to be minimised: between two values of the third objective, the area of the staircase of all
    points up to the lower one.  Points that are not better than ``ref`` in every objective, or not numbers, count nothing.  The work is the square of the points: give a front."""
    x, y, z = columns
    inside = points.where((F.col(x) < ref[0]) & (F.col(y) < ref[1]) & (F.col(z) < ref[2]))
    best = inside.groupBy(*by, x, y).agg(F.min(z).alias(z))
    levels = best.select(*by, F.col(z).alias("_z")).distinct().withColumn("_height", F.coalesce(F.lead("_z").over(Window.partitionBy(*by).orderBy("_z")), F.lit(ref[2])) - F.col("_z"))
    slabs = levels.join(best, by).where(F.col(z) <= F.col("_z"))
    area = hypervolume_2d(slabs, [*by, "_z", "_height"], x, y, (ref[0], ref[1]))
    return area.groupBy(*by).agg(F.sum(F.col("hypervolume") * F.col("_height")).alias("hypervolume"))


def latin_hypercube(spark, n: int, names: list[str], seed: int = 42) -> DataFrame:
    """(id, names...) of n points in the unit cube, one in every n-th of each axis: an axis orders the points by a seeded hash
    and places each inside its part by another one."""
    out = spark.range(n).select("id")
    of = lambda what, name: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{what}:{name}"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double")
    for name in names:
        place = F.row_number().over(Window.orderBy(of("order", name), "id")) - 1
        out = out.withColumn(name, (place + of("place", name) / float(1 << 32)) / n)
    return out


def _places(rows: DataFrame, score: str) -> DataFrame:
    """``_place`` from 1 in descending order of the score, ties by id: buckets between 200 quantiles are numbered by themselves,
    behind the counts of the buckets before them."""
    cuts = rows.agg(F.percentile_approx(score, [k / 200 for k in range(1, 200)], 10000).alias("_cuts"))  # one row is broadcast
    b = rows.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c > F.col(score)))).drop("_cuts")
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).alias("_before"))  # 200 rows
    place = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(score), "id"))
    return b.withColumn("_place", place).join(F.broadcast(before), "_b").withColumn("_place", F.col("_place") + F.col("_before")).drop("_b", "_before")


def successive_halving(scores: DataFrame, keep: int = 2) -> DataFrame:
    """scores (id, rung, score) to (rung, id, score, rank, survives): a rung ranks those that survived all before it, and the best
    1 / keep of them, at least one, go on (greater is better, ties to the lesser id).  One pass for every rung."""
    rungs = [r[0] for r in scores.select("rung").distinct().orderBy("rung").collect()]  # a few budgets
    alive, out = scores.select("id").distinct(), None
    for rung in rungs:
        mine = scores.where(F.col("rung") == rung).join(alive, "id")
        n = mine.agg(F.greatest(F.floor(F.count(F.lit(1)) / keep), F.lit(1)).alias("_most"))
        ranked = _places(mine, "score").withColumn("rank", F.col("_place").cast("long")).crossJoin(F.broadcast(n))
        ranked = ranked.select("rung", "id", "score", "rank", (F.col("rank") <= F.col("_most")).alias("survives"))
        alive = ranked.where("survives").select("id")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else scores.select("rung", "id", "score", F.lit(0).cast("long").alias("rank"), F.lit(False).alias("survives"))
