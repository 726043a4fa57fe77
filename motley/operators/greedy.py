"""Greedy selection over whole groups of any size, by passes over all their rows: rows (g, id, v array<double>), ids unique in a group.

No pass holds a group in one task, no row is left out and nothing but loop conditions reaches the driver.  What has been
chosen is a table of one row for each group and step; it meets the rows by a join over (group, salt), so that a hot group is
dealt out.  Three kinds of passes:

* farthest, mmr, fair, dpp and the first phase of max_sum carry a few numbers on every row (least distance, greatest
  cosine, the row's incremental Cholesky row, distances to the chosen) and read all rows once a step;
* facility and k_medoids need sums over all rows for every candidate.  Their gains only fall, so a gain of an earlier step
  bounds the present one: after one comparison of all pairs, a step evaluates the best-bounded candidates and then at once
  all whose bounds reach the best gain found, which gives the plain greedy choice;
* swaps of max_sum read all rows once for each swap, those of k_medoids compare all pairs of a group (by blocks).

State is kept after every pass, so that a task of the next has one Python worker, not one for each pass since.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motley.operators import blocks

SALTS = 32
#: Candidates of a group that a lazy step evaluates at a time.
CANDIDATES = 128
#: Rows of a block that are compared at a time.
ROWS = 256
#: Bounds are compared with this much room for rounding; a swap must gain more than this share of the cost.
ROOM = 1e-9


def _by_row(kernel):
    """A function of two columns of vectors, taken row by row in Arrow batches; null where one of them is."""

    def run(v: pa.Array, p: pa.Array) -> pa.Array:
        both = np.asarray(v.is_valid()) & np.asarray(p.is_valid())
        out, n = np.zeros(len(both)), int(both.sum())
        if n:
            x, y = (np.asarray(c.filter(pa.array(both)).flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) for c in (v, p))
            out[both] = kernel(x, y)
        return pa.array(out, pa.float64(), mask=~both)

    return F.arrow_udf(run, T.DoubleType())


def dot(v, p) -> Column:
    return _by_row(lambda x, y: (x * y).sum(axis=1))(v, p)


def square(v, p) -> Column:
    return _by_row(lambda x, y: ((x - y) ** 2).sum(axis=1))(v, p)


def euclidean(v, p) -> Column:
    return F.sqrt(square(v, p))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))


def _told(rows: DataFrame, picks: DataFrame, *columns: str) -> DataFrame:
    """Rows with ``columns`` of their group's pick as ``_p_...``; groups without a pick are done and go."""
    told = picks.select("g", *[F.col(c).alias(f"_p_{c}") for c in columns], F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("_s"))
    return rows.join(told, ["g", "_s"])


def _best(rows: DataFrame, score: Column, *columns: str, keys=("g",)) -> DataFrame:
    """The row of greatest score of each group, the least id among equals."""
    best = F.min_by(F.struct(*columns, score.alias("score")), F.struct((-score).alias("a"), F.col("id").alias("b")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def _steps(state: DataFrame, k: int, score: Column, update: dict, carried=("id", "v"), stop: Column | None = None, wanted: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame]:
    """k picks of the greatest ``score``, each followed by ``update`` of the state; (picks by step, last state).

    ``wanted``: rows (g, step, label) of steps that may only take that label."""
    state, picks = _salted(state).withColumn("slot", F.lit(None).cast("int")), []
    fixed = [c for c in state.columns if c not in update and c != "slot"]
    for step in range(k):
        open_ = state.where("slot IS NULL")
        if wanted is None:
            best = _best(open_, score, *carried)
        else:
            of = wanted.where(F.col("step") == step).select("g", F.col("label").alias("_want"), F.lit(True).alias("_bound"))
            each = _best(open_, score, *carried, keys=("g", "label")).join(of, "g", "left").where("_bound IS NULL OR label <=> _want")
            best = _best(each, F.col("score"), *[c for c in carried if c != "g"])
        if stop is not None:
            best = best.where(stop)
        pick = blocks.kept(best)
        if pick.isEmpty():
            break
        picks.append(pick.select("g", "id", F.lit(step).cast("long").alias("step")))
        told = _told(state, pick, *carried)
        state = told.select(*fixed, *[c.alias(n) for n, c in update.items()], F.when(F.col("id") == F.col("_p_id"), step).otherwise(F.col("slot")).alias("slot"))
        if step < k - 1:
            state = blocks.kept(state)
    return picks, state


def _all(picks: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0).select("g", "id", F.lit(0).cast("long").alias("step"))
    for pick in picks:
        out = out.union(pick)
    return out


def farthest(rows: DataFrame, k: int) -> DataFrame:
    """Greedy max-min from the row of the least id."""
    near = F.least(F.col("near"), euclidean(F.col("v"), F.col("_p_v")))
    return _all(_steps(rows.withColumn("near", F.lit(float("inf"))), k, F.col("near"), {"near": near})[0], rows)


def mmr(rows: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """Greedy trade * relevance - (1 - trade) * greatest cosine to the chosen."""
    length = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    best = F.greatest(F.col("best"), dot(F.col("v"), F.col("_p_v")) / (length(F.col("v")) * length(F.col("_p_v"))))
    score = trade * F.col("relevance") - (1 - trade) * F.coalesce("best", F.lit(0.0))
    return _all(_steps(rows.withColumn("best", F.lit(None).cast("double")), k, score, {"best": best})[0], rows)


def fair(rows: DataFrame, k: int) -> DataFrame:
    """First k // labels rows of each label by max-min, labels in order, then max-min over all."""
    n = rows.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    quota = n.join(n.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")), "g").select("g", "label", F.least("n", F.floor(F.lit(k) / F.col("kinds"))).alias("quota")).where("quota > 0")
    # quotas of a group are at least 1 each and k in all, so at most k rows meet here
    before = F.sum("quota").over(Window.partitionBy("g").orderBy("label")) - F.col("quota")
    wanted = blocks.kept(quota.select("g", "label", before.alias("from"), "quota").select("g", "label", F.explode(F.sequence("from", F.col("from") + F.col("quota") - 1)).alias("step")))
    near = F.least(F.col("near"), euclidean(F.col("v"), F.col("_p_v")))
    return _all(_steps(rows.withColumn("near", F.lit(float("inf"))), k, F.col("near"), {"near": near}, wanted=wanted)[0], rows)


def _with_width(rows: DataFrame) -> DataFrame:
    """Adds the width of the Gaussian kernel, the median distance of a group's pairs (1 if that is 0)."""
    width = blocks.median_distance(rows).select("g", F.when(F.col("median") > 0, F.col("median")).otherwise(1.0).alias("width"))
    told = width.withColumn("_s", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return _salted(rows).join(told, ["g", "_s"]).drop("_s")


def dpp(rows: DataFrame, k: int) -> DataFrame:
    """Greedy MAP of a determinantal process with a Gaussian kernel: the largest conditional variance next."""
    cell = F.exp(-square(F.col("v"), F.col("_p_v")) / (2 * F.col("width") * F.col("width")))
    entry = (cell - dot(F.col("factor"), F.col("_p_factor"))) / F.sqrt("_p_left")
    update = {"factor": F.concat("factor", F.array(entry)), "left": F.col("left") - entry * entry}
    state = _with_width(rows).withColumns({"factor": F.array().cast("array<double>"), "left": F.lit(1.0)})
    return _all(_steps(state, k, F.col("left"), update, carried=("id", "v", "factor", "left"), stop=F.col("score") > 1e-12)[0], rows)


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = x @ y.T
    square *= -2
    square += (x * x).sum(1)[:, None]
    square += (y * y).sum(1)[None, :]
    return np.maximum(square, 0, out=square)


def _matrix_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = _square_distances(x, y)
    return np.sqrt(square, out=square)


def _slices(x: np.ndarray):
    return (x[k : k + ROWS] for k in range(0, len(x), ROWS))


def _distance_totals(rows: DataFrame) -> DataFrame:
    """(g, id, total): the sum of distances to all rows of the group."""
    kernel = lambda ids, x, others, y: {"id": ids, "total": np.concatenate([_matrix_distances(part, y).sum(1) for part in _slices(x)])}
    return blocks.blocked(rows, rows, kernel, "id long, total double", blocks.WIDE).groupBy("g", "id").agg(F.sum("total").alias("total"))


def max_sum(rows: DataFrame, k: int) -> DataFrame:
    """Greedy sum of distances, then the best swap while one improves it."""
    d = euclidean(F.col("v"), F.col("_p_v"))
    far = F.concat("far", F.array(d))
    state = rows.join(_distance_totals(rows), ["g", "id"]).withColumn("far", F.array().cast("array<double>"))
    picks, state = _steps(state, k, F.col("total"), {"far": far, "total": F.when(F.size("far") == 0, d).otherwise(F.col("total") + d)})
    added = lambda: F.aggregate("far", F.lit(0.0), lambda s, x: s + x)
    state = state.withColumn("total", added())
    for done in range(10 * k):
        chosen = state.where("slot IS NOT NULL").groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "total"))), lambda c: c["total"]).alias("totals"))
        told = _told(state.where("slot IS NULL"), blocks.kept(chosen), "totals")
        offers = F.zip_with(F.sequence(F.lit(0), F.size("far") - 1), F.zip_with("far", "_p_totals", lambda f, t: f + t), lambda s, x: F.struct((F.col("total") - x).alias("gain"), (-s).alias("order"), s.alias("place")))
        offer = told.withColumn("offer", F.array_max(offers))
        order = F.struct((-F.col("offer.gain")).alias("a"), F.col("offer.place").alias("b"), F.col("id").alias("c"))
        swap = offer.groupBy("g").agg(F.min_by(F.struct("id", "v", "offer.place", "offer.gain"), order).alias("b")).select("g", "b.*").where("gain > 1e-12")
        swap = blocks.kept(swap)
        if swap.isEmpty():
            break
        told = _told(state, swap, "id", "v", "place").unionByName(state.join(swap, "g", "left_anti").withColumns({"_p_id": F.lit(None).cast(state.schema["id"].dataType), "_p_v": F.lit(None).cast("array<double>"), "_p_place": F.lit(None).cast("int")}))
        told = told.withColumn("_d", d)
        new = F.transform("far", lambda x, j: F.when(j == F.col("_p_place"), F.col("_d")).otherwise(x))
        slot = F.when(F.col("id") == F.col("_p_id"), F.col("_p_place")).when(F.col("slot") == F.col("_p_place"), None).otherwise(F.col("slot"))
        state = told.select("g", "id", "v", "_s", new.alias("far"), slot.alias("slot")).withColumn("total", added())
        state = blocks.kept(state)
    return state.where("slot IS NOT NULL").select("g", "id", F.col("slot").cast("long").alias("step"))


def _gains(candidates: DataFrame, rows: DataFrame, similar: bool) -> DataFrame:
    """(g, id, gain): what each candidate adds to the similarities ``near`` (or takes off the distances ``near``) of all rows."""

    def kernel(ids, x, others, y):
        y, near, width = np.ascontiguousarray(y[:, :-2]), y[:, -2], y[0, -1]
        gains = []
        for part in _slices(x[:, :-2]):
            if similar:
                value = _square_distances(part, y)
                value /= -2 * width * width
                value = np.exp(value, out=value)
                value -= near
            else:
                value = near - _matrix_distances(part, y)
            gains.append(np.maximum(value, 0, out=value).sum(1))
        return {"id": ids, "gain": np.concatenate(gains)}

    tailed = rows.select("g", "id", F.concat("v", F.array("near", "width")).alias("v"))
    asked = candidates.select("g", "id", F.concat("v", F.array(F.lit(0.0), F.lit(0.0))).alias("v"))
    return blocks.blocked(asked, tailed, kernel, "id long, gain double", blocks.WIDE).groupBy("g", "id").agg(F.sum("gain").alias("gain"))


def _leaders(bounds: DataFrame) -> DataFrame:
    """The ``CANDIDATES`` greatest bounds of each group, first of each salt."""
    order = [F.col("bound").desc(), F.col("id")]
    part = _salted(bounds).withColumn("_r", F.row_number().over(Window.partitionBy("g", "_s").orderBy(*order))).where(F.col("_r") <= CANDIDATES)
    return part.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("_r") <= CANDIDATES).drop("_r", "_s")


def _lazy(rows: DataFrame, k: int, similar: bool) -> tuple[list[DataFrame], DataFrame]:
    """Lazy greedy over gains that only fall; (picks by step, rows with near and far, their values to each pick)."""
    if similar:
        rows = _with_width(rows).withColumn("near", F.lit(0.0))
        value, near = F.exp(-F.pow(euclidean(F.col("v"), F.col("_p_v")), 2) / (2 * F.col("width") * F.col("width"))), F.greatest
    else:
        rows = rows.withColumns({"width": F.lit(1.0), "near": F.lit(float("inf"))})
        value, near = euclidean(F.col("v"), F.col("_p_v")), F.least
    rows = blocks.kept(_salted(rows.select("g", "id", "v", "width", "near")).withColumn("far", F.array().cast("array<double>")))
    bounds, picks = None, []
    for step in range(k):
        if not similar and step == 0:
            first = rows.select("g", "id", "v").join(_distance_totals(rows), ["g", "id"])
            pick = blocks.kept(_best(first, -F.col("total"), "id", "v"))
        else:
            if bounds is None:  # the one comparison of all pairs
                taken = picks[0] if picks else None
                bounds = rows.select("g", "id", "v").join(_gains(rows, rows, similar), ["g", "id"]).select("g", "id", "v", F.col("gain").alias("bound"), F.lit(step).alias("stamp"))
                bounds = blocks.kept(bounds if taken is None else bounds.join(taken, ["g", "id"], "left_anti"))
            for again in itertools.count():
                told = bounds.groupBy("g").agg(F.max(F.when(F.col("stamp") == step, F.col("bound"))).alias("found"), F.max(F.when(F.col("stamp") < step, F.col("bound"))).alias("left"))
                behind = blocks.kept(told.where(F.col("left").isNotNull() & (F.col("found").isNull() | (F.col("left") * (1 + ROOM) + 1e-300 >= F.col("found")))).select("g", "found"))
                if behind.isEmpty():
                    break
                old = bounds.where(F.col("stamp") < step).join(behind, "g")
                # the first batch finds a good gain, the second holds all whose bounds reach it: no others can be better
                asked = blocks.kept(old.where(F.col("bound") * (1 + ROOM) + 1e-300 >= F.col("found")).drop("found") if again else _leaders(old.drop("found")))
                known = _gains(asked, rows, similar)
                bounds = blocks.kept(bounds.join(known, ["g", "id"], "left").select("g", "id", "v", F.coalesce("gain", "bound").alias("bound"), F.when(F.col("gain").isNotNull(), step).otherwise(F.col("stamp")).alias("stamp")))
            best = _best(bounds.where(F.col("stamp") == step), F.col("bound"), "id", "v")
            pick = blocks.kept(best.where("score > 0") if similar else best)
        if pick.isEmpty():
            break
        picks.append(pick.select("g", "id", F.lit(step).cast("long").alias("step")))
        # groups without a pick have nothing left to gain
        rows = blocks.kept(_told(rows, pick, "v").select("g", "id", "v", "width", near(F.col("near"), value).alias("near"), F.concat("far", F.array(value)).alias("far"), "_s"))
        if bounds is not None:
            bounds = bounds.join(pick.select("g", "id"), ["g", "id"], "left_anti").join(pick.select("g"), "g", "left_semi")
    return picks, rows


def facility(rows: DataFrame, k: int) -> DataFrame:
    """Greedy sum of each row's Gaussian similarity to its nearest chosen row; ends when nothing is gained."""
    return _all(_lazy(rows, k, similar=True)[0], rows)


def _swap_costs(rows: DataFrame, k: int) -> DataFrame:
    """(g, id, change, place): for every row the medoid whose exchange for it lowers the cost most, and by how much."""

    def kernel(ids, x, others, y):
        y, (first, place, second) = np.ascontiguousarray(y[:, :-3]), y[:, -3:].T
        holds, each = (place[:, None] == np.arange(k)[None, :]).astype(float), []
        for part in _slices(x[:, :-3]):
            d = _matrix_distances(part, y)
            common = np.minimum(d - first, 0)
            moved = np.minimum(d, second, out=d)
            moved -= first
            moved -= common
            each.append(common.sum(1)[:, None] + moved @ holds)
        each = np.concatenate(each)
        return {"id": ids} | {f"c{j}": each[:, j] for j in range(k)}

    order = F.array_sort(F.transform("far", lambda x, j: F.struct(x.alias("d"), j.alias("j"))))
    tail = F.array(order[0]["d"], order[0]["j"].cast("double"), F.coalesce(F.get(order, F.lit(1))["d"], F.lit(1e300)))
    tailed = rows.select("g", "id", F.concat("v", tail).alias("v"))
    asked = rows.where("slot IS NULL").select("g", "id", F.concat("v", F.array(*[F.lit(0.0)] * 3)).alias("v"))
    sums = blocks.blocked(asked, tailed, kernel, "id long, " + ", ".join(f"c{j} double" for j in range(k)), blocks.WIDE).groupBy("g", "id").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)])
    least = F.array_min(F.array(*[F.struct(F.col(f"c{j}").alias("change"), F.lit(j).alias("place")) for j in range(k)]))
    return sums.select("g", "id", least.alias("b")).select("g", "id", "b.*")


def k_medoids(rows: DataFrame, k: int) -> DataFrame:
    """Medoids by greedy building and best swaps while one lowers the sum of distances."""
    picks, state = _lazy(rows, k, similar=False)
    state = blocks.kept(state.join(_all(picks, rows), ["g", "id"], "left").select("g", "id", "v", "far", "_s", F.col("step").cast("int").alias("slot")))
    open_ = state
    while True:
        cost = open_.groupBy("g").agg(F.sum(F.array_min("far")).alias("cost"))
        offers = _swap_costs(open_, k)
        order = F.struct(F.col("change").alias("a"), F.col("place").alias("b"), F.col("id").alias("c"))
        best = offers.groupBy("g").agg(F.min_by(F.struct("id", "change", "place"), order).alias("b")).select("g", "b.*").join(cost, "g")
        best = best.where(-F.col("change") > ROOM * F.greatest(F.lit(1.0), F.col("cost")))
        swap = blocks.kept(best.join(open_.select("g", "id", "v"), ["g", "id"]).select("g", "id", "v", "place"))
        if swap.isEmpty():
            return state.where("slot IS NOT NULL").select("g", "id", F.col("slot").cast("long").alias("step"))
        new = F.transform("far", lambda x, j: F.when(j == F.col("_p_place"), F.col("_d")).otherwise(x))
        slot = F.when(F.col("id") == F.col("_p_id"), F.col("_p_place")).when(F.col("slot") == F.col("_p_place"), None).otherwise(F.col("slot"))
        told = _told(open_, swap, "id", "v", "place").withColumn("_d", euclidean(F.col("v"), F.col("_p_v")))
        open_ = blocks.kept(told.select("g", "id", "v", new.alias("far"), "_s", slot.alias("slot")))
        state = blocks.kept(state.join(swap, "g", "left_anti").unionByName(open_))


METHODS = {"farthest": farthest, "mmr": mmr, "fair": fair, "dpp": dpp, "facility": facility, "max_sum": max_sum, "k_medoids": k_medoids}
