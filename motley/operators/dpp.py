"""Determinantal point processes over rows (g, id, v array<double>) with the kernel L = V V^T: ids unique in a group.

L is never built.  Its spectrum is that of the d x d dual matrix V^T V, summed in Arrow batches and taken apart on the
executors; a draw chooses eigenvectors there (each alone, or exactly k of them by elementary symmetric polynomials).  Rows
then carry their coordinates in the chosen eigenvectors, and every item of a draw is one pass: the row of greatest
log squared residual plus Gumbel noise is a draw in proportion to the squared residual, and all rows lose their share along
it.  Noise is a hash of (seed, id, draw, step), so a draw does not depend on partitions and can be made again.
Qualities are factors of the vectors; a Gaussian kernel is V of random Fourier features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motley.operators import greedy
from motley.operators.blocks import kept
from motley.operators.vectors import dot

#: A residual below this share of the row's squared length is rounding.
NOTHING = 1e-9


def fourier_features(vectors: DataFrame, size: int, width: float, seed: int = 42) -> DataFrame:
    """Rows whose dot products approach exp(-|x - y|^2 / (2 width^2)): ``size`` cosines and sines of seeded Gaussian directions."""
    d = vectors.where("v IS NOT NULL").select(F.size("v").alias("d")).first()
    if d is None:
        return vectors
    directions = np.random.default_rng(seed).normal(size=(size, d["d"])) / width
    dots = F.array(*[dot(F.col("v"), F.array(*[F.lit(float(x)) for x in w])) for w in directions])
    scale = float(1 / np.sqrt(size))
    return vectors.withColumn("_dots", dots).withColumn("v", F.concat(F.transform("_dots", lambda x: F.cos(x) * scale), F.transform("_dots", lambda x: F.sin(x) * scale))).drop("_dots")


def weighted(vectors: DataFrame, quality: Column) -> DataFrame:
    """The quality-diversity kernel q_i q_j v_i v_j."""
    return vectors.withColumn("_q", quality.cast("double")).withColumn("v", F.transform("v", lambda x: x * F.col("_q"))).drop("_q")


def _partial(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        keys = batch.column("g").dictionary_encode()
        code = keys.indices.to_numpy(zero_copy_only=False)
        found = [(x[code == c].T @ x[code == c]).ravel().tolist() for c in range(len(keys.dictionary))]
        yield pa.RecordBatch.from_arrays([keys.dictionary, pa.array(found, pa.list_(pa.float64()))], ["g", "m"])


def dual(vectors: DataFrame) -> DataFrame:
    """(g, m array<double>): the d x d cells of V^T V."""
    rows = vectors.where("v IS NOT NULL").select("g", "v")
    cells = rows.mapInArrow(_partial, f"g {rows.schema['g'].dataType.simpleString()}, m array<double>").select("g", F.posexplode("m").alias("k", "x")).groupBy("g", "k").agg(F.sum("x").alias("x"))
    return cells.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("m"))


def _square(cells) -> np.ndarray:
    d = int(round(len(cells) ** 0.5))
    return np.asarray(cells, float).reshape(d, d)


def symmetric_polynomials(values: np.ndarray, k: int) -> np.ndarray:
    """e[l, n]: the l-th elementary symmetric polynomial of the first n values."""
    e = np.zeros((k + 1, len(values) + 1))
    e[0] = 1
    for n, value in enumerate(values, 1):
        e[1:, n] = e[1:, n - 1] + value * e[:-1, n - 1]
    return e


def chosen_axes(cells, k: int | None, rng: np.random.Generator) -> np.ndarray:
    """d x m: the eigenvectors of a draw, scaled so that V times it has orthonormal columns."""
    values, axes = np.linalg.eigh(_square(cells))
    real = values > NOTHING * max(values.max(initial=0), 1e-300)
    values, axes = values[real], axes[:, real]
    if k is None:
        take = rng.random(len(values)) < values / (1 + values)
    else:
        left, take = min(k, len(values)), np.zeros(len(values), bool)
        scaled = values / max(values.max(initial=0), 1e-300)  # the choice does not depend on a common factor
        e = symmetric_polynomials(scaled, left)
        for n in range(len(values), 0, -1):
            if left and (n == left or rng.random() < scaled[n - 1] * e[left - 1, n - 1] / e[left, n]):
                take[n - 1], left = True, left - 1
    return axes[:, take] / np.sqrt(values[take])


def sample(vectors: DataFrame, k: int | None = None, draws: int = 1, seed: int = 42) -> DataFrame:
    """(g, draw, id, step): for each group and draw a sample of the process, or of exactly k rows (as many as the rank allows)."""
    kind = vectors.schema["g"].dataType
    sums = dual(vectors).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    sums = sums.withColumn("seed", F.xxhash64(F.lit(seed), "g", "draw"))
    shape = T.StructType([T.StructField("g", kind), T.StructField("draw", T.IntegerType()), T.StructField("axes", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def axes(frames):
        for pdf in frames:
            found = [chosen_axes(m, k, np.random.default_rng(s & (2**63 - 1))).T.tolist() for m, s in zip(pdf["m"], pdf["seed"], strict=True)]
            yield pd.DataFrame({"g": pdf["g"], "draw": pdf["draw"], "axes": found})

    plan = kept(sums.mapInPandas(axes, shape))
    rows = vectors.where("v IS NOT NULL").select("g", "id", "v").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(greedy.SALTS)).cast("int"))
    dealt = plan.where(F.size("axes") > 0).withColumn("_s", F.explode(F.array(*[F.lit(s) for s in range(greedy.SALTS)])))
    left = F.transform("axes", lambda a: dot(F.col("v"), a))
    state = rows.join(dealt, ["g", "_s"]).select(F.struct("g", "draw").alias("g"), "id", left.alias("left")).withColumn("whole", dot(F.col("left"), F.col("left"))).withColumn("done", F.lit(0))
    along = dot(F.col("left"), F.col("_p_left")) / dot(F.col("_p_left"), F.col("_p_left"))
    update = {"left": F.zip_with("left", F.transform("_p_left", lambda x: x * along), lambda x, y: x - y), "done": F.col("done") + 1}
    size = dot(F.col("left"), F.col("left"))
    noise = (F.pmod(F.xxhash64(F.lit(seed), "id", "g.draw", "done", F.lit("pick")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    score = F.when(size > NOTHING * F.greatest("whole", F.lit(1e-12)), F.log(size) - F.log(-F.log(noise))).otherwise(float("-inf"))
    most = plan.agg(F.max(F.size("axes"))).first()[0] or 0
    picks, _ = greedy._steps(kept(state), most, score, update, carried=("id", "left"), stop=F.col("score") > float("-inf"))
    return greedy._all(picks, state).select("g.g", "g.draw", "id", "step")


def given(vectors: DataFrame, fixed: DataFrame) -> DataFrame:
    """The rows of each group without those of ``fixed`` (g, id), with what these span taken out: samples of it are those of
    the process given that the fixed rows are in.  A group's fixed rows are at most as many as dimensions, or they have chance 0."""
    width = len(vectors.columns)
    rows = vectors.where("v IS NOT NULL")
    shape = T.StructType([vectors.schema["g"], T.StructField("axes", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), float)
        _, values, axes = np.linalg.svd(x, full_matrices=False)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "axes": [axes[values > 1e-10 * values.max(initial=1e-300)].tolist()]})

    spans = kept(rows.join(fixed.select("g", "id").distinct(), ["g", "id"]).select("g", "id", "v").groupBy("g").applyInPandas(span, shape))
    dealt = spans.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in range(greedy.SALTS)])))
    open_ = rows.join(fixed.select("g", "id").distinct(), ["g", "id"], "left_anti").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(greedy.SALTS)).cast("int"))
    joined = open_.join(dealt, ["g", "_s"], "left")
    outside = F.aggregate("axes", F.col("v"), lambda v, a: F.zip_with(v, F.transform(a, lambda x: x * dot(v, a)), lambda p, q: p - q))
    return joined.withColumn("v", F.when(F.col("axes").isNull(), F.col("v")).otherwise(outside)).select(*vectors.columns[:width])


def marginals(vectors: DataFrame) -> DataFrame:
    """(g, id, chance): how likely each row is in a sample, v^T (I + V^T V)^-1 v."""
    kind = vectors.schema["g"].dataType

    def inverse(frames):
        for pdf in frames:
            yield pd.DataFrame({"g": pdf["g"], "inverse": [np.linalg.inv(np.eye(len(s)) + s).tolist() for s in map(_square, pdf["m"])]})

    of = dual(vectors).mapInPandas(inverse, T.StructType([T.StructField("g", kind), T.StructField("inverse", T.ArrayType(T.ArrayType(T.DoubleType())))]))
    dealt = of.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in range(greedy.SALTS)])))
    rows = vectors.where("v IS NOT NULL").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(greedy.SALTS)).cast("int"))
    return rows.join(dealt, ["g", "_s"]).select("g", "id", dot(F.col("v"), F.transform("inverse", lambda r: dot(F.col("v"), r))).alias("chance"))


def log_probability(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """(g, log_probability): ln det L_S - ln det(I + L) of the rows ``chosen`` (g, id); null where the chance is 0 (so of more rows than dimensions)."""
    shape = T.StructType([vectors.schema["g"], T.StructField("inside", T.DoubleType())])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), float)
        sign, value = np.linalg.slogdet(x @ x.T) if len(x) <= x.shape[1] else (0, 0.0)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "inside": [float(value) if sign > 0 else None]})

    def whole(frames):
        for pdf in frames:
            yield pd.DataFrame({"g": pdf["g"], "whole": [float(np.linalg.slogdet(np.eye(len(s)) + s)[1]) for s in map(_square, pdf["m"])]})

    rows = vectors.where("v IS NOT NULL")
    mine = rows.join(chosen.select("g", "id").distinct(), ["g", "id"]).select("g", "id", "v")
    # more chosen rows than dimensions have no volume: d + 1 of a group settle it
    counted = mine.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"))
    few = mine.join(counted.where("n <= d").select("g"), "g", "left_semi").groupBy("g").applyInPandas(inside, shape)
    all_ = dual(vectors).mapInPandas(whole, T.StructType([vectors.schema["g"], T.StructField("whole", T.DoubleType())]))
    return counted.join(all_, "g").join(few, "g", "left").select("g", (F.col("inside") - F.col("whole")).alias("log_probability"))
