"""Diversified reranking of the candidates of every query.

Of candidates (q, item, relevance) a kernel sees the k most relevant of every
set of aspects, which gives the same picks as all of them; votes are counted
over all.  Aspects (item, topic, p) come along as a map.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pm2(aspects: np.ndarray, votes: np.ndarray, k: int, trade: float = 0.5) -> list[int]:
    """Seats for topics in proportion to their votes: the topic with the greatest quotient is served next."""
    seats, chosen = np.zeros(len(votes)), []
    while len(chosen) < min(k, len(aspects)):
        quotient = votes / (2 * seats + 1)
        best = int(quotient.argmax())
        others = aspects @ quotient - aspects[:, best] * quotient[best]
        value = trade * quotient[best] * aspects[:, best] + (1 - trade) * others
        value[chosen] = -np.inf
        pick = int(value.argmax())
        chosen.append(pick)
        total = aspects[pick].sum()
        if total > 0:
            seats += aspects[pick] / total
    return chosen


def xquad(aspects: np.ndarray, votes: np.ndarray, relevance: np.ndarray, k: int, trade: float = 0.5) -> list[int]:
    """(1 - trade) relevance + trade * sum over topics of vote * p * chance that none chosen covers it."""
    left, chosen = np.ones(len(votes)), []
    while len(chosen) < min(k, len(aspects)):
        value = (1 - trade) * relevance + trade * (aspects * votes * left).sum(1)
        value[chosen] = -np.inf
        pick = int(value.argmax())
        chosen.append(pick)
        left = left * (1 - aspects[pick])
    return chosen


def ia_select(aspects: np.ndarray, votes: np.ndarray, relevance: np.ndarray, k: int) -> list[int]:
    """Greatest marginal chance that a random user finds something: topics' unmet votes times p times relevance."""
    unmet, chosen = votes.astype(float).copy(), []
    while len(chosen) < min(k, len(aspects)):
        gain = relevance * (aspects @ unmet)
        gain[chosen] = -np.inf
        pick = int(gain.argmax())
        chosen.append(pick)
        unmet = unmet * (1 - relevance[pick] * aspects[pick])
    return chosen


def topic_cover(aspects: np.ndarray, relevance: np.ndarray, k: int) -> list[int]:
    """Most topics not yet covered, then relevance."""
    covered, chosen = np.zeros(aspects.shape[1], bool), []
    while len(chosen) < min(k, len(aspects)):
        fresh = ((aspects > 0) & ~covered).sum(1) + relevance / (1 + relevance.max(initial=1))
        fresh[chosen] = -np.inf
        pick = int(fresh.argmax())
        chosen.append(pick)
        covered |= aspects[pick] > 0
    return chosen


METHODS = ("pm2", "xquad", "ia_select", "topic_cover")


def rerank(candidates: DataFrame, topics: DataFrame, k: int, method: str) -> DataFrame:
    """(q, item, rank): k of all candidates of each query.

    Candidates with the same aspects differ in relevance only, so a greedy step
    takes the most relevant of them left: k of every set of aspects are enough.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    p = topics.columns.count("p") and F.col("p") or F.lit(1.0)
    aspects = topics.groupBy("item").agg(F.map_from_entries(F.collect_set(F.struct("topic", p.cast("double").alias("p")))).alias("aspects"))
    each = candidates.select("q", "item", "relevance").join(aspects.select("item", F.array_sort(F.map_entries("aspects")).alias("aspects")), "item", "left")
    best = Window.partitionBy("q", "aspects").orderBy(F.desc("relevance"), "item")
    top = each.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("q", "item", "relevance", F.map_from_entries("aspects").alias("aspects"))
    votes = each.select("q", F.explode("aspects").alias("a")).groupBy("q", F.col("a.key").alias("topic")).agg(F.sum("a.value").alias("n"))
    votes = votes.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("votes"))
    full = top.join(votes, "q", "left")
    shape = T.StructType([candidates.schema["q"], candidates.schema["item"], T.StructField("rank", T.LongType())])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "item"], ascending=[False, True]).reset_index(drop=True)
        maps = [dict(a) if a is not None else {} for a in pdf["aspects"]]
        count = dict(pdf["votes"].iloc[0]) if pdf["votes"].iloc[0] is not None else {}
        names = sorted(count)
        grid = np.array([[a.get(t, 0.0) for t in names] for a in maps]).reshape(len(pdf), len(names))
        relevance = pdf["relevance"].to_numpy(float)
        relevance = relevance / max(relevance.max(initial=0), 1e-12)
        votes = np.array([count[t] for t in names], float)
        votes = votes / max(votes.sum(), 1e-12)
        found = {"pm2": lambda: pm2(grid, votes, k), "xquad": lambda: xquad(grid, votes, relevance, k), "ia_select": lambda: ia_select(grid, votes, relevance, k), "topic_cover": lambda: topic_cover(grid, relevance, k)}[method]()
        return pdf.iloc[found][["q", "item"]].assign(rank=np.arange(1, len(found) + 1, dtype="int64"))

    return full.groupBy("q").applyInPandas(choose, shape)
