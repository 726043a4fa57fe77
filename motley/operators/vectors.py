"""Diversity of vectors: rows (g, id, v array<double>).

Means over pairs come from moments where an identity exists; other sums over
pairs are in ``blocks``, results that are pairs come from joins of blocks.  Spectral
measures sum d x d Gram matrices on the executors, where their eigenvalues are
taken too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups whose d x d sums a task holds before it writes them out.
MOST_SUMS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def _long(vectors: DataFrame) -> DataFrame:
    return vectors.select("g", "id", F.posexplode("v").alias("k", "x"))


def moments(vectors: DataFrame) -> DataFrame:
    """Per group: radius of gyration, mean per-dimension variance (dispersion), norm of the centroid."""
    per = _long(vectors).groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("vp"), F.var_samp("x").alias("vs"))
    return per.groupBy("g").agg(F.max("n").alias("n"), F.sqrt(F.sum("vp")).alias("gyration"), F.avg("vs").alias("dispersion"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("centroid_norm"))


def centroid_distance(vectors: DataFrame) -> DataFrame:
    """Mean distance to the group's mean vector."""
    x = _long(vectors)
    c = x.groupBy("g", "k").agg(F.avg("x").alias("m"))
    d = x.join(c, ["g", "k"]).groupBy("g", "id").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("d"))
    return d.groupBy("g").agg(F.avg("d").alias("mean"), F.max("d").alias("radius"))


def mean_cosine_distance(vectors: DataFrame) -> DataFrame:
    """1 - (|sum of unit vectors|^2 - m) / (n (n - 1)), m the vectors with length; without any pair built."""
    x = vectors.withColumn("l", norm(F.col("v")))
    n = x.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("l") > 0).alias("m"))
    s = x.where("l > 0").select("g", "l", F.posexplode("v").alias("k", "x")).groupBy("g", "k").agg(F.sum(F.col("x") / F.col("l")).alias("s")).groupBy("g").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    return n.join(s, "g", "left").select("g", F.when(F.col("n") < 2, 0.0).otherwise(1 - (F.coalesce("square", F.lit(0.0)) - F.col("m")) / (F.col("n") * (F.col("n") - 1))).alias("value"))


def pairs(vectors: DataFrame, distance=euclidean, block: int = 1000) -> DataFrame:
    """(g, a, b, d) over all pairs of a group, for results that are pairs (sums over pairs: ``blocks``).  A group is cut into
    blocks, and each pair of blocks is a join key of its own."""
    n = vectors.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    sized = vectors.join(n, "g").where("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("long"))
    own = sized.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    a = own.select("g", F.col("id").alias("a"), F.col("v").alias("va"), F.col("_own").alias("_x"), every.alias("_y"))
    b = own.select("g", F.col("id").alias("b"), F.col("v").alias("vb"), every.alias("_x"), F.col("_own").alias("_y"))
    return a.join(b, ["g", "_x", "_y"]).where("a < b").select("g", "a", "b", distance(F.col("va"), F.col("vb")).alias("d"))


def neighbours(vectors: DataFrame, k: int, distance=euclidean) -> DataFrame:
    """(g, id, neighbour, d, rank) of the k nearest others in the group."""
    p = pairs(vectors, distance)
    both = p.select("g", F.col("a").alias("id"), F.col("b").alias("neighbour"), "d").union(p.select("g", "b", "a", "d"))
    order = Window.partitionBy("g", "id").orderBy(F.round("d", 9), "neighbour")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _partial_grams(batches):
    """Sums of q u u^T and of q over a partition, by group; written out early where there are many groups."""
    sums, kind = {}, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["g", "m"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("g").type
        q = batch.column("q").to_numpy(zero_copy_only=False)
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        length = np.sqrt((x * x).sum(axis=1))
        u = x / np.where(length > 0, length, 1.0)[:, None]
        keys = np.array(batch.column("g").to_pylist(), dtype=object)
        for g in set(keys.tolist()):
            mine = keys == g
            cells = np.append((u[mine].T @ (u[mine] * q[mine, None])).ravel(), q[mine].sum())
            sums[g] = cells if g not in sums else sums[g] + cells
        if len(sums) > MOST_SUMS:
            yield out()
            sums.clear()
    if sums:
        yield out()


def gram(vectors: DataFrame, weight: Column | None = None) -> DataFrame:
    """(g, m): the d * d cells of the sum of q u u^T over unit vectors u, and behind them the sum of q (1 without ``weight``).

    A partition's sums are made in Arrow batches, d * d + 1 numbers for each of its groups are shuffled.  A vector without
    length counts only in the sum of q; rows without a vector are left out."""
    rows = vectors.where("v IS NOT NULL").select("g", (F.lit(1.0) if weight is None else weight.cast("double")).alias("q"), "v")
    parts = rows.mapInArrow(_partial_grams, f"g {rows.schema['g'].dataType.simpleString()}, m array<double>")
    cells = parts.select("g", F.posexplode("m").alias("k", "x")).groupBy("g", "k").agg(F.sum("x").alias("x"))
    return cells.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("m"))


def _spectrum(cells: np.ndarray) -> np.ndarray:
    """Eigenvalues of a row of ``gram``, over its sum of q, in descending order."""
    d = int(round((len(cells) - 1) ** 0.5))
    values = np.linalg.eigvalsh(cells[:-1].reshape(d, d) / max(cells[-1], 1e-300))
    return np.sort(np.maximum(values, 0))[::-1]


def entropy_of(values: np.ndarray, alpha: float = 1.0) -> float:
    """exp of the Renyi entropy (Shannon for alpha 1) of eigenvalues that sum to one."""
    p = values[values > 1e-10]
    if not len(p):
        return 1.0
    p = p / p.sum()
    if alpha == 1.0:
        return float(np.exp(-(p * np.log(p)).sum()))
    if np.isinf(alpha):
        return float(1 / p.max())
    return float((p**alpha).sum() ** (1 / (1 - alpha)))


def vendi(vectors: DataFrame, alpha: float = 1.0, top: int | None = None, weight: Column | None = None) -> DataFrame:
    """(g, n, vendi) with the cosine kernel, from the dual d x d matrix; ``top``: only so many eigenvalues, renormalised;
    ``weight``: the kernel is multiplied by the roots of both rows' weights, and n is their sum."""
    sums = gram(vectors, weight)

    def score(batches):
        for batch in batches:
            cells = [np.array(m) for m in batch.column("m").to_pylist()]
            found = [pa.array([float(c[-1]) for c in cells], pa.float64()), pa.array([entropy_of(_spectrum(c)[:top], alpha) for c in cells], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("g"), *found], ["g", "n", "vendi"])

    out = sums.mapInArrow(score, f"g {sums.schema['g'].dataType.simpleString()}, n double, vendi double")
    return out if weight is not None else out.withColumn("n", F.round("n").cast("long"))


def vendi_of_sets(vectors: DataFrame, pairs_: DataFrame, alpha: float = 1.0) -> DataFrame:
    """pairs_ (a, b) of groups to their Vendi scores, that of their union, what each adds, synergy and redundancy.

    The union's matrix is the sum of both, so vectors are read once however many pairs are asked for."""
    sums = gram(vectors)
    both = pairs_.join(sums.select(F.col("g").alias("a"), F.col("m").alias("ma")), "a").join(sums.select(F.col("g").alias("b"), F.col("m").alias("mb")), "b").select("a", "b", "ma", "mb")

    def score(batches):
        for batch in batches:
            ma, mb = ([np.array(m) for m in batch.column(c).to_pylist()] for c in ("ma", "mb"))
            found = [pa.array([entropy_of(_spectrum(c), alpha) for c in side], pa.float64()) for side in (ma, mb, [x + y for x, y in zip(ma, mb)])]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *found], ["a", "b", "vendi_a", "vendi_b", "vendi_union"])

    kind = sums.schema["g"].dataType.simpleString()
    scored = both.mapInArrow(score, f"a {kind}, b {kind}, vendi_a double, vendi_b double, vendi_union double")
    va, vb, u = F.col("vendi_a"), F.col("vendi_b"), F.col("vendi_union")
    redundancy = F.when(va + vb > 0, F.greatest(F.least(1 - u / (va + vb), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    return scored.select("a", "b", va, vb, u, (u - va).alias("b_adds"), (u - vb).alias("a_adds"), (u - va - vb + F.least(va, vb)).alias("synergy"), redundancy.alias("redundancy"))


def principal_axes(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, explained share) from sums of x and x x^T over all rows."""
    one = vectors.select(F.lit(0).alias("g"), "id", "v")
    x = _long(one).groupBy("k").agg(F.avg("x").alias("m")).orderBy("k").collect()
    mean = np.array([r["m"] for r in x])
    cells = one.select("v", F.posexplode("v").alias("i", "x")).select("i", "x", F.posexplode("v").alias("j", "y")).groupBy("i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("s")).collect()
    c = np.zeros((len(mean), len(mean)))
    for i, j, s in cells:
        c[i, j] = s
    values, axes = np.linalg.eigh(c - np.outer(mean, mean))
    order = np.argsort(values)[::-1][:k]
    return mean, axes[:, order].T, values[order] / max(values.sum(), 1e-300)
