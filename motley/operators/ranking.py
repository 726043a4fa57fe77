"""Diversity of ranked lists: rows (q, rank from 1, item) with topics (item, topic)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alpha_dcg(ranked: DataFrame, topics: DataFrame, alpha: float, k: int) -> DataFrame:
    """Gain of an item: sum over its topics of (1 - alpha)^(times seen before), discounted by log2(rank + 1)."""
    hits = ranked.where(F.col("rank") <= k).join(topics, "item")
    seen = F.row_number().over(Window.partitionBy("q", "topic").orderBy("rank", "item")) - 1
    return hits.withColumn("_g", F.pow(F.lit(1 - alpha), seen) / F.log2(F.col("rank") + 1)).groupBy("q").agg(F.sum("_g").alias("alpha_dcg"))


def subtopic_recall(ranked: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    n = topics.agg(F.countDistinct("topic").alias("n"))
    return ranked.where(F.col("rank") <= k).join(topics, "item").groupBy("q").agg(F.countDistinct("topic").alias("c")).crossJoin(F.broadcast(n)).select("q", (F.col("c") / F.col("n")).alias("s_recall"))


def err_ia(ranked: DataFrame, topics: DataFrame, grade: float, k: int) -> DataFrame:
    """Intent-aware expected reciprocal rank: every topic weighs the same; ``grade``: chance to be satisfied by a relevant item.

    The trust left before an item is (1 - grade)^(relevant items before it), so no running product is needed.
    """
    hits = ranked.where(F.col("rank") <= k).join(topics, "item")
    before = F.row_number().over(Window.partitionBy("q", "topic").orderBy("rank", "item")) - 1
    n = topics.agg(F.countDistinct("topic").alias("n"))
    return hits.withColumn("_g", F.pow(F.lit(1 - grade), before) * grade / F.col("rank")).groupBy("q").agg(F.sum("_g").alias("s")).crossJoin(F.broadcast(n)).select("q", (F.col("s") / F.col("n")).alias("err_ia"))


def calibration(ranked: DataFrame, topics: DataFrame, target: DataFrame) -> DataFrame:
    """KL (natural) of a list's topic shares from target shares (topic, p), both floored at 1e-10 and renormalised."""
    counts = ranked.join(topics, "item").groupBy("q", "topic").agg(F.count(F.lit(1)).alias("c"))
    full = ranked.select("q").distinct().crossJoin(target).join(counts, ["q", "topic"], "left").fillna(0, ["c"])
    by = Window.partitionBy("q")
    s = full.withColumn("l", F.greatest(F.col("c") / F.sum("c").over(by), F.lit(1e-10))).withColumn("t", F.greatest("p", F.lit(1e-10)))
    s = s.withColumn("l", F.col("l") / F.sum("l").over(by)).withColumn("t", F.col("t") / F.sum("t").over(by))
    return s.groupBy("q").agg(F.sum(F.col("t") * F.log(F.col("t") / F.col("l"))).alias("kl"))


def exposure(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """Share of position weight 1 / log2(rank + 1) of every group (item, group), and 1 - the widest gap."""
    e = ranked.join(groups, "item").groupBy("group").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("w"))
    everything = Window.partitionBy(F.lit(0))
    e = e.withColumn("share", F.col("w") / F.sum("w").over(everything))
    return e.select("group", "share", (1 - (F.max("share").over(everything) - F.min("share").over(everything))).alias("fairness"))


def item_coverage(ranked: DataFrame, catalogue: DataFrame) -> DataFrame:
    n = catalogue.agg(F.count(F.lit(1)).alias("n"))
    return ranked.agg(F.countDistinct("item").alias("c")).crossJoin(n).select((F.col("c") / F.col("n")).alias("coverage"))
