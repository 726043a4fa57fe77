"""Diverse subset selection.

Kernels are numpy over one bounded candidate set.  ``select`` runs one per group
up to ``bound`` rows; in larger groups ``greedy`` makes the same choices by
passes over all rows.  Nothing is left out at any size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motley.operators import blocks, greedy

BOUND = 4000


def distances(x: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def farthest_point(x: np.ndarray, k: int, start: int = 0) -> list[int]:
    """Greedy max-min; the lowest index among equals."""
    k = min(k, len(x))
    chosen, near = [start], np.linalg.norm(x - x[start], axis=1)
    while len(chosen) < k:
        near[chosen[-1]] = -1
        pick = int(near.argmax())
        chosen.append(pick)
        near = np.minimum(near, np.linalg.norm(x - x[pick], axis=1))
    return chosen[:k]


def mmr(x: np.ndarray, k: int, relevance: np.ndarray, trade: float = 0.5) -> list[int]:
    """trade * relevance - (1 - trade) * greatest cosine to the chosen."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    best, open_, chosen = np.full(len(x), -np.inf), np.ones(len(x), bool), []
    while len(chosen) < min(k, len(x)):
        value = trade * relevance - (1 - trade) * np.where(np.isinf(best), 0, best)
        pick = int(np.where(open_, value, -np.inf).argmax())
        chosen.append(pick)
        open_[pick] = False
        best = np.maximum(best, unit @ unit[pick])
    return chosen


def rbf_kernel(x: np.ndarray, width: float | None = None) -> np.ndarray:
    d = distances(x)
    width = width or float(np.median(d[np.triu_indices(len(x), 1)])) or 1.0
    return np.exp(-(d**2) / (2 * width**2))


def dpp_map(kernel: np.ndarray, k: int) -> list[int]:
    """Greedy MAP of a determinantal process: the largest conditional variance next, by incremental Cholesky rows."""
    n = len(kernel)
    left, rows, chosen = kernel.diagonal().copy(), np.zeros((min(k, n), n)), []
    while len(chosen) < min(k, n):
        masked = left.copy()
        masked[chosen] = -np.inf
        pick = int(masked.argmax())
        if masked[pick] <= 1e-12:
            break
        m = len(chosen)
        rows[m] = (kernel[pick] - rows[:m, pick] @ rows[:m]) / math.sqrt(left[pick])
        left = left - rows[m] ** 2
        chosen.append(pick)
    return chosen


def facility_location(similarity: np.ndarray, k: int) -> list[int]:
    """Greedy sum of each row's similarity to its nearest chosen one; stops when nothing is gained."""
    best, chosen = np.zeros(len(similarity)), []
    while len(chosen) < min(k, len(similarity)):
        gain = np.maximum(similarity - best[:, None], 0).sum(0)
        gain[chosen] = -1
        pick = int(gain.argmax())
        if gain[pick] <= 0:
            break
        chosen.append(pick)
        best = np.maximum(best, similarity[:, pick])
    return chosen


def max_sum(x: np.ndarray, k: int) -> list[int]:
    """Greedy sum of distances, then swaps while one improves it."""
    d = distances(x)
    chosen = [int(d.sum(0).argmax())]
    while len(chosen) < min(k, len(x)):
        gain = d[chosen].sum(0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    for _ in range(10 * k):
        total = d[chosen].sum(0)
        inside = np.array(chosen)
        delta = total[None, :] - d[inside] - total[inside][:, None]
        delta[:, inside] = -1
        a, b = np.unravel_index(delta.argmax(), delta.shape)
        if delta[a, b] <= 1e-12:
            break
        chosen[a] = int(b)
    return chosen


def k_medoids(x: np.ndarray, k: int) -> list[int]:
    """Greedy medoids, then the best swap while one lowers the sum of distances."""
    d = distances(x)
    chosen = [int(d.sum(0).argmin())]
    while len(chosen) < min(k, len(x)):
        near = d[:, chosen].min(1)
        gain = np.maximum(near[:, None] - d, 0).sum(0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    for _ in range(len(x) * k):
        inside = d[:, chosen]
        place, first = inside.argmin(1), inside.min(1)
        second = np.partition(inside, 1, axis=1)[:, 1] if len(chosen) > 1 else np.full(len(d), np.inf)
        common = np.minimum(d - first[:, None], 0)
        moved = np.minimum(d, second[:, None]) - first[:, None] - common
        change = common.sum(0)[None, :] + (place[None, :] == np.arange(len(chosen))[:, None]).astype(float) @ moved
        change[:, chosen] = np.inf
        slot, swap = np.unravel_index(change.argmin(), change.shape)
        if -change[slot, swap] <= greedy.ROOM * max(1.0, first.sum()):
            break
        chosen[slot] = int(swap)
    return chosen


def fair(x: np.ndarray, k: int, labels: np.ndarray, quota: dict) -> list[int]:
    """First each label's quota by max-min inside it (labels in order), then max-min over all."""
    d, chosen = distances(x), []
    near = np.full(len(x), np.inf)

    def take(allowed):
        nonlocal near
        value = np.where(allowed, near, -1.0)
        value[chosen] = -1
        pick = int(value.argmax())
        chosen.append(pick)
        near = np.minimum(near, d[pick])

    for label in sorted(quota):
        mine = labels == label
        for _ in range(min(quota[label], int(mine.sum()), k - len(chosen))):
            take(mine)
    while len(chosen) < min(k, len(x)):
        take(np.ones(len(x), bool))
    return chosen


def exact_max_min(x: np.ndarray, k: int) -> list[int]:
    """The subset of greatest spread, by search for a clique over descending distance thresholds (small n only)."""
    d = distances(x)
    values = np.unique(d[np.triu_indices(len(x), 1)])
    low, high, best = 0, len(values) - 1, list(range(min(k, len(x))))

    def clique(threshold):
        fits = d >= threshold - 1e-12

        def grow(chosen, open_):
            if len(chosen) == k:
                return chosen
            if len(chosen) + len(open_) < k:
                return None
            for i, v in enumerate(open_):
                found = grow([*chosen, v], [u for u in open_[i + 1 :] if fits[v, u]])
                if found:
                    return found
            return None

        return grow([], list(range(len(x))))

    while low <= high:
        mid = (low + high) // 2
        found = clique(values[mid])
        if found:
            best, low = found, mid + 1
        else:
            high = mid - 1
    return best


def certified(x: np.ndarray, k: int, exact_up_to: int = 24) -> tuple[list[int], float, float, bool]:
    """(chosen, spread, upper bound, certified).  Exact for few rows; else farthest points with swaps, and the bound that
    the k(k-1)/2-th largest pair distance puts on any spread."""
    if len(x) <= exact_up_to:
        chosen = exact_max_min(x, k)
        spread = float(distances(x[chosen])[np.triu_indices(len(chosen), 1)].min()) if len(chosen) > 1 else 0.0
        return chosen, spread, spread, True
    d = distances(x)
    chosen = farthest_point(x, k)
    for _ in range(5 * k):
        inner = d[np.ix_(chosen, chosen)] + np.diag(np.full(len(chosen), np.inf))
        slot = int(inner.min(1).argmin())
        rest = chosen[:slot] + chosen[slot + 1 :]
        near = d[rest].min(0)
        near[chosen] = -1
        pick = int(near.argmax())
        rest_spread = (d[np.ix_(rest, rest)] + np.diag(np.full(len(rest), np.inf))).min() if len(rest) > 1 else np.inf
        if min(near[pick], rest_spread) <= inner.min() + 1e-12:
            break
        chosen[slot] = pick
    spread = float(d[np.ix_(chosen, chosen)][np.triu_indices(len(chosen), 1)].min())
    pairs = np.sort(d[np.triu_indices(len(x), 1)])[::-1]
    bound = float(pairs[k * (k - 1) // 2 - 1])
    return chosen, spread, bound, spread >= bound - 1e-12


METHODS = ("farthest", "mmr", "dpp", "facility", "max_sum", "k_medoids", "fair")


def run(method: str, x: np.ndarray, k: int, relevance: np.ndarray, labels: np.ndarray) -> list[int]:
    if method == "farthest":
        return farthest_point(x, k)
    if method == "mmr":
        return mmr(x, k, relevance)
    if method == "dpp":
        return dpp_map(rbf_kernel(x), k)
    if method == "facility":
        return facility_location(rbf_kernel(x), k)
    if method == "max_sum":
        return max_sum(x, k)
    if method == "k_medoids":
        return k_medoids(x, k)
    if method == "fair":
        kinds = np.unique(labels)
        return fair(x, k, labels, {v: k // len(kinds) for v in kinds})
    raise ValueError(f"unknown method {method!r}; one of {METHODS}")


def select(vectors: DataFrame, k: int, method: str = "farthest", bound: int = BOUND) -> DataFrame:
    """(g, id, step): k rows of every group in the order chosen; ids are unique in a group.  Optional columns: relevance double, label."""
    columns = vectors.columns
    full = vectors.withColumn("relevance", F.col("relevance") if "relevance" in columns else F.lit(0.0)).withColumn("label", F.col("label") if "label" in columns else F.lit(0))
    shape = T.StructType([vectors.schema["g"], vectors.schema["id"], T.StructField("step", T.LongType())])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        found = run(method, np.array(pdf["v"].tolist(), dtype=float), k, pdf["relevance"].to_numpy(float), pdf["label"].to_numpy())
        return pdf.iloc[found][["g", "id"]].assign(step=np.arange(len(found), dtype="int64"))

    sizes = full.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > bound).select("g")
    if large.isEmpty():
        return full.groupBy("g").applyInPandas(choose, shape)
    large = blocks.kept(large)
    found = greedy.METHODS[method](full.join(large, "g", "left_semi"), k)
    return full.join(large, "g", "left_anti").groupBy("g").applyInPandas(choose, shape).union(found)


def random_sample(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """k rows in the order of a seeded hash of their id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)


def stratified(rows: DataFrame, budget: int, seed: int) -> DataFrame:
    """budget // groups rows of each group by seeded hash, the remainder to the first groups in order; fewer where a group is smaller."""
    from pyspark.sql import Window

    order = Window.partitionBy("g").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    groups = rows.select("g").distinct()
    places = groups.withColumn("_p", F.row_number().over(Window.orderBy("g")) - 1).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    quota = places.select("g", (F.floor(F.lit(budget) / F.col("_k")) + (F.col("_p") < F.lit(budget) % F.col("_k")).cast("long")).alias("_quota"))
    return rows.join(quota, "g").withColumn("_r", F.row_number().over(order)).where("_r <= _quota").drop("_r", "_quota")
