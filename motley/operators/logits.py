"""Decoding filters over logits: rows (row_id, token_id, logit), one per vocabulary entry.

A filter keeps tokens; each is a window over the row, the partition key, so
rows spread over tasks whatever the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _row():
    return Window.partitionBy("row_id")


def with_probability(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds p: the softmax of logit / temperature, shifted by the row's maximum."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    z = logits.withColumn("_e", F.exp((F.col("logit") - F.max("logit").over(_row())) / temperature))
    return z.withColumn("p", F.col("_e") / F.sum("_e").over(_row())).drop("_e")


def _sorted():
    return _row().orderBy(F.desc("p"), "token_id")


def _mass(probs: DataFrame) -> DataFrame:
    return probs.withColumn("_cum", F.sum("p").over(_sorted().rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(_sorted()))


def top_k(probs: DataFrame, k: int) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    return probs.withColumn("_rank", F.row_number().over(_sorted())).where(F.col("_rank") <= k).drop("_rank")


def top_p_exclusive(probs: DataFrame, p: float) -> DataFrame:
    """Without the token that takes the mass beyond p; the first stays."""
    return _mass(probs).where((F.col("_cum") <= p) | (F.col("_rank") == 1)).drop("_cum", "_rank")


def top_p_inclusive(probs: DataFrame, p: float) -> DataFrame:
    """With the token that takes the mass to p."""
    return _mass(probs).where((F.col("_cum") - F.col("p") < p) | (F.col("_rank") == 1)).drop("_cum", "_rank")


def typical(probs: DataFrame, mass: float) -> DataFrame:
    """Tokens by closeness of their surprise to the entropy, up to ``mass``; the closest stays."""
    x = probs.withColumn("_i", -F.log("p")).withColumn("_d", F.abs(F.col("_i") - F.sum(F.col("p") * F.col("_i")).over(_row())))
    order = _row().orderBy(F.round("_d", 12), "token_id")
    x = x.withColumn("_cum", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(order))
    return x.where((F.col("_cum") <= mass) | (F.col("_rank") == 1)).drop("_i", "_d", "_cum", "_rank")


def min_p(probs: DataFrame, share: float) -> DataFrame:
    return probs.withColumn("_m", F.max("p").over(_row())).where(F.col("p") >= share * F.col("_m")).drop("_m")


def eta(probs: DataFrame, eta: float) -> DataFrame:
    """p of at least eta times the row's entropy; the likeliest stays."""
    x = probs.withColumn("_h", F.sum(-F.col("p") * F.log("p")).over(_row())).withColumn("_rank", F.row_number().over(_sorted()))
    return x.where((F.col("p") >= eta * F.col("_h")) | (F.col("_rank") == 1)).drop("_h", "_rank")


def tail_free(probs: DataFrame, z: float) -> DataFrame:
    """Tokens until the normalised absolute second differences of the sorted probabilities sum up to z."""
    x = probs.withColumn("_rank", F.row_number().over(_sorted()))
    by_rank = _row().orderBy("_rank")
    x = x.withColumn("_c", F.abs(F.lead("p", 2).over(by_rank) - 2 * F.lead("p", 1).over(by_rank) + F.col("p")))
    x = x.withColumn("_share", F.sum(F.coalesce("_c", F.lit(0.0))).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(F.coalesce("_c", F.lit(0.0))).over(_row()))
    cut = F.min(F.when(F.col("_share") >= z, F.col("_rank"))).over(_row())
    return x.withColumn("_cut", cut).where(F.col("_rank") <= F.col("_cut") + 1).drop("_rank", "_c", "_share", "_cut")


def repetition_penalty(logits: DataFrame, history: DataFrame, penalty: float, frequency: float = 0.0, presence: float = 0.0) -> DataFrame:
    """Divides positive and multiplies negative logits of tokens in the history, then subtracts frequency and presence penalties."""
    seen = history.groupBy("row_id", "token_id").agg(F.count(F.lit(1)).alias("_n"))
    x = logits.join(seen, ["row_id", "token_id"], "left")
    scaled = F.when(F.col("_n").isNull(), F.col("logit")).when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return x.withColumn("logit", scaled - frequency * F.coalesce("_n", F.lit(0)) - presence * F.col("_n").isNotNull().cast("double")).drop("_n")


def row_summary(probs: DataFrame) -> DataFrame:
    """Entropy, varentropy, perplexity and the greatest probability of each row (natural logarithm)."""
    x = probs.withColumn("_i", -F.log("p")).withColumn("_h", F.sum(F.col("p") * F.col("_i")).over(_row()))
    return x.groupBy("row_id").agg(F.first("_h").alias("entropy"), F.sum(F.col("p") * (F.col("_i") - F.col("_h")) * (F.col("_i") - F.col("_h"))).alias("varentropy"), F.exp(F.first("_h")).alias("perplexity"), F.max("p").alias("top"))


def row_divergences(p: DataFrame, q: DataFrame) -> DataFrame:
    """KL, Jensen-Shannon, Hellinger and total variation between rows with equal ids of two tables."""
    j = p.select("row_id", "token_id", "p").join(q.select("row_id", "token_id", F.col("p").alias("q")), ["row_id", "token_id"])
    m = (F.col("p") + F.col("q")) / 2
    return j.groupBy("row_id").agg(
        F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"), (F.sum(F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)) / 2).alias("js"),
        F.sqrt(F.sum((F.sqrt("p") - F.sqrt("q")) * (F.sqrt("p") - F.sqrt("q"))) / 2).alias("hellinger"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"),
    )


def gumbel_top_k(probs: DataFrame, k: int, seed: int) -> DataFrame:
    """k tokens of each row without replacement, by log p + Gumbel noise drawn from a hash of seed, row and token."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "row_id", "token_id"), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    keyed = probs.withColumn("_g", F.log("p") - F.log(-F.log(u)))
    order = _row().orderBy(F.desc("_g"), "token_id")
    return keyed.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= k).drop("_g")
