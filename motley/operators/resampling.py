"""Bootstrap intervals of means: rows (g, id long, x double), null values left out."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, LEVEL, SEED = 1000, 0.95, 42
#: Rows whose weights for all rounds are held at a time.
STEP = 256
_CHANCES = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))


def weights(ids: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Poisson(1) counts of each row in each round, from a hash of (seed, id, round): how often a resample of a large group takes the row."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[:, None] ^ (np.arange(rounds, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return np.searchsorted(_CHANCES, (h >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def _sums(rounds: int, seed: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("id").to_numpy(zero_copy_only=False), batch.column("x").to_numpy(zero_copy_only=False)
            keys = batch.column("g").dictionary_encode()
            code = keys.indices.to_numpy(zero_copy_only=False)
            out = []
            for k in range(len(keys.dictionary)):
                total, count = np.zeros(rounds), np.zeros(rounds)
                mine = np.flatnonzero(code == k)
                for at in range(0, len(mine), STEP):
                    part = mine[at : at + STEP]
                    w = weights(ids[part], rounds, seed)
                    total, count = total + x[part] @ w, count + w.sum(0)
                out.append(np.concatenate([total, count]).tolist())
            yield pa.RecordBatch.from_arrays([keys.dictionary, pa.array(out, pa.list_(pa.float64()))], ["g", "sums"])

    return run


def intervals(means: np.ndarray, mean: float, acceleration: float, level: float) -> dict[str, float]:
    """Percentile, basic and bias-corrected accelerated bounds from the resampled means."""
    normal, low, high = NormalDist(), (1 - level) / 2, (1 + level) / 2
    p = np.quantile(means, [low, high])
    below = ((means < mean).sum() + 0.5 * (means == mean).sum()) / len(means)
    shift = normal.inv_cdf(min(max(below, 0.5 / len(means)), 1 - 0.5 / len(means)))
    turned = []
    for q in (low, high):
        z = shift + normal.inv_cdf(q)
        turned.append(normal.cdf(shift + z / (1 - acceleration * z)) if acceleration * z < 1 else float(q > 0.5))
    b = np.quantile(means, turned)
    return {"percentile_low": p[0], "percentile_high": p[1], "basic_low": 2 * mean - p[1], "basic_high": 2 * mean - p[0], "bca_low": b[0], "bca_high": b[1]}


BOUNDS = ("percentile_low", "percentile_high", "basic_low", "basic_high", "bca_low", "bca_high")


def _bounds(rounds: int, level: float):
    def run(batches):
        for batch in batches:
            found = []
            for sums, mean, acceleration in zip(*(batch.column(c).to_pylist() for c in ("sums", "mean", "acceleration")), strict=True):
                total, count = np.array(sums[:rounds]), np.array(sums[rounds:])
                found.append(intervals(total[count > 0] / count[count > 0], mean, acceleration, level) if (count > 0).any() else dict.fromkeys(BOUNDS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "n", "mean")), *[pa.array([f[b] for f in found], pa.float64()) for b in BOUNDS]], ["g", "n", "mean", *BOUNDS])

    return run


def bootstrap_mean(values: DataFrame, rounds: int = ROUNDS, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """(g, n, mean, and the bounds of three kinds of intervals).

    Rows are not multiplied by rounds: a partition sums weights and weighted values of all rounds in Arrow batches, 2 x rounds
    numbers a group.  The acceleration needs all means but one row, which for a mean is the third central moment over the
    second to the power 1.5: two aggregates.  Ids that repeat in a group are resampled together."""
    kind = values.schema["g"].dataType.simpleString()
    rows = values.where("x IS NOT NULL").select("g", F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"))
    parts = rows.mapInArrow(_sums(rounds, seed), f"g {kind}, sums array<double>")
    sums = parts.select("g", F.posexplode("sums").alias("k", "s")).groupBy("g", "k").agg(F.sum("s").alias("s")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda c: c["s"]).alias("sums"))
    moments = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.skewness("x").alias("skew"))
    # the sum of cubes over the sum of squares to 1.5 is skewness / sqrt(n)
    acceleration = F.when(F.isnan("skew") | F.col("skew").isNull(), 0.0).otherwise(F.col("skew") / (6 * F.sqrt("n")))
    return sums.join(moments, "g").select("g", "n", "mean", "sums", acceleration.alias("acceleration")).mapInArrow(_bounds(rounds, level), f"g {kind}, n long, mean double, " + ", ".join(f"{b} double" for b in BOUNDS))
