"""Measures over pairs of vectors that come as sums or per-row results of blocks, so that no pair is ever a row.

A group of ``left`` and a group of ``right``, rows (g, id, v), are cut into blocks of about ``block`` rows; every pair of
blocks is one key with its own task, whose result is reduced afterwards.  Work grows with the square of a group, as the
measures demand; memory and shuffled results do not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motley.session import kept

#: Rows of a block, and how many of them that are compared at a time.
BLOCK = 512
STEP = 32
#: Blocks of a group while they are below ``LARGE`` rows, for kernels that hold only tiles of ``TILE`` columns: a group is then
#: sent ``PARTS`` times, whatever its size.
PARTS, LARGE, TILE = 16, 16384, 4096
#: Blocks that a group of sets is cut into even where it would fit fewer, for the sake of its cores.
FEW = 3


def blocked(left: DataFrame, right: DataFrame, kernel, schema: str, block: int | None = None, unpack=None, once: bool = False, most: int | None = None, members: int | None = None) -> DataFrame:
    """(g, schema...) of ``kernel(ids a, A, ids b, B)``, a dict of columns, for all pairs of blocks of a group; rows without a vector are left out.

    ``unpack`` makes A and B from a column of lists, a matrix by default.  ``once`` is for a table with itself: two different
    blocks meet one time, not in both orders.  With ``most`` a group of more than ``PARTS`` blocks has larger ones, up to that size.
    With ``members`` a group is cut into as many blocks as hold that many members of its lists.
    """
    alone = once and left is right  # a block that meets itself is sent once
    block, left, right = block or BLOCK, left.where("v IS NOT NULL"), right.where("v IS NOT NULL")
    of = lambda size: F.ceil(F.count(F.lit(1)) / size).cast("long")
    if members:
        held = F.greatest(F.ceil(F.sum(F.size("v")) / members), F.lit(1)).cast("long")
        number = F.greatest(held, F.least(of(block), F.lit(FEW)))
    else:
        number = F.greatest(F.least(of(block), F.lit(PARTS)), of(most)) if most else of(block)
    count = lambda d, name: d.groupBy("g").agg(number.alias(name))
    sizes = count(left, "_nx").join(count(right, "_ny"), "g")
    own = lambda d, n: d.select("g", "id", "v").join(sizes, "g").withColumn("_own", F.pmod(F.xxhash64("id"), F.col(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fresh = lambda d: d.select(*[F.col(c).alias(c) for c in d.columns])  # noqa: E731  (both sides may be one table)
    a = own(left, "_nx").select("g", "id", "v", F.col("_own").alias("_x"), every("_ny").alias("_y"))
    b = fresh(own(right, "_ny").select("g", "id", "v", every("_nx").alias("_x"), F.col("_own").alias("_y")))
    if once:
        a, b = a.where("_x <= _y"), b.where("_x < _y" if alone else "_x <= _y")
    kind = a.schema["g"].dataType.simpleString()
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}

    def matrix(t: pa.Table) -> np.ndarray:
        if unpack:
            return unpack(t.column("v").combine_chunks())
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        g = x.schema.field("g").type
        if alone and x.num_rows and x.column("_x")[0] == x.column("_y")[0]:
            y = x
        empty = not (x.num_rows and y.num_rows)
        found = {n: [] for n, _ in fields} if empty else kernel(x.column("id").to_numpy(), matrix(x), y.column("id").to_numpy(), matrix(y))
        size = len(found[fields[0][0]])
        key = [] if empty else [x.column("g")[0].as_py()] * size
        return pa.table([pa.array(key, g), *[pa.array(found[n], types[k]) for n, k in fields]], names=["g", *[n for n, _ in fields]])

    return a.groupBy("g", "_x", "_y").cogroup(b.groupBy("g", "_x", "_y")).applyInArrow(run, f"g {kind}, {schema}")


#: Sets that are compared at a time, columns that are multiplied at a time, and members of a block of sets (8 bytes each): a group is
#: sent once for each block of it.
SETS = 2048
COLUMNS = 2048
MEMBERS = 1 << 24


def _sets(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(members of all sets one after another, their sizes)."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def shared_members(one: tuple, other: tuple) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of hashes: frequent members by a product of matrices, rare ones pair by pair."""
    (x, nx), (y, ny) = one, other
    common = np.intersect1d(x, y)
    out = np.zeros((len(nx), len(ny)), np.float32)
    if not len(common):
        return out

    def held(v, n):
        at = np.minimum(np.searchsorted(common, v), len(common) - 1)
        hit = common[at] == v
        column, row = at[hit], np.repeat(np.arange(len(n)), n)[hit]
        order = np.argsort(column, kind="stable")
        return column[order], row[order], np.bincount(column, minlength=len(common))

    (cx, rx, fx), (cy, ry, fy) = held(x, nx), held(y, ny)
    rare = fx * fy * 512 < len(nx) * len(ny)
    start_x, start_y = np.cumsum(fx) - fx, np.cumsum(fy) - fy
    # every holder on the left meets all holders on the right of its rare member, a bounded number of pairs at a time
    at = np.flatnonzero(rare[cx])
    pairs = fy[cx[at]]
    part = np.cumsum(pairs) // (1 << 21)
    edges = np.searchsorted(part, np.unique(part)) if len(at) else []
    for low, high in zip(edges, [*edges[1:], len(at)]):
        a, k = at[low:high], pairs[low:high]
        b = np.repeat(start_y[cx[a]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        np.add.at(out.reshape(-1), np.repeat(rx[a], k) * len(ny) + ry[b], np.float32(1))
    often = np.flatnonzero(~rare)
    for k in range(0, len(often), COLUMNS):
        columns = often[k : k + COLUMNS]
        number = np.full(len(common), -1)
        number[columns] = np.arange(len(columns))

        def dense(c, r, rows):
            m, hit = np.zeros((rows, len(columns)), np.float32), number[c] >= 0
            m[r[hit], number[c][hit]] = 1
            return m

        out += dense(cx, rx, len(nx)) @ dense(cy, ry, len(ny)).T
    return out


def jaccards(one: tuple, other: tuple) -> np.ndarray:
    """Similarities of all pairs of sets; 0 where both are empty."""
    k = shared_members(one, other).astype(np.float64)
    return k / np.maximum(one[1][:, None] + other[1][None, :] - k, 1)


def _spans(sets: tuple):
    """(rows, these sets) of some sets at a time; what else is known of each set goes with it."""
    end = np.cumsum(sets[1])
    for low in range(0, len(sets[1]), SETS):
        s = slice(low, low + SETS)
        yield s, (sets[0][end[low] - sets[1][low] : end[s][-1]], *[x[s] for x in sets[1:]])


def greatest_jaccard(left: DataFrame, right: DataFrame, past: bool = False) -> DataFrame:
    """(g, id, best) of every set of ``left``: its greatest similarity to one of ``right``, with ``past`` to one of a lesser id."""

    def best(ids, x, others, y):
        if same := past and ids[0] in others:
            others, y = ids, x  # in the same order, so that two of its parts meet once
        top, back = np.zeros(len(ids)), np.zeros(len(others))
        for i, one in _spans(x):
            for j, two in _spans(y):
                if same and j.start < i.start:
                    continue
                s = jaccards(one, two)
                if past:
                    before = np.where(others[None, j] > ids[i, None], s, 0)
                    back[j] = np.maximum(back[j], before.max(axis=0))
                    s = np.where(others[None, j] < ids[i, None], s, 0)
                top[i] = np.maximum(top[i], s.max(axis=1))
        return {"id": np.concatenate([ids, others]), "best": np.concatenate([top, back])} if past else {"id": ids, "best": top}

    return blocked(left, right, best, "id long, best double", SETS, _sets, once=past, members=MEMBERS if past else None).groupBy("g", "id").agg(F.max("best").alias("best"))


def jaccard_sums(sets: DataFrame) -> DataFrame:
    """sets (g, id, v, weight), each set once a group, to (g, alike): the sum over pairs of similarity times both weights."""

    def bare(column):
        flat, sizes = _sets(column)
        end = np.cumsum(sizes) - 1  # the weight rides behind the members
        return np.delete(flat, end), sizes - 1, flat[end]

    def sums(ids, x, others, y):
        if same := ids[0] in others:
            others, y = ids, x  # in the same order, so that two of its parts meet once
        total = 0.0
        for i, one in _spans(x):
            for j, two in _spans(y):
                if same and j.start < i.start:
                    continue
                s = jaccards(one[:2], two[:2]) * one[2][:, None] * two[2][None, :]
                total += float(s[ids[i, None] < others[None, j]].sum() if same and i == j else s.sum())
        return {"s": [total]}

    rows = sets.select("g", "id", F.concat("v", F.array(F.col("weight").cast("long"))).alias("v"))
    return blocked(rows, rows, sums, "s double", SETS, bare, once=True, members=MEMBERS).groupBy("g").agg(F.sum("s").alias("alike"))


def _steps(x: np.ndarray):
    return (slice(k, k + STEP) for k in range(0, len(x), STEP))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1.0)


def nearest_distance(left: DataFrame, right: DataFrame, apart: bool = True) -> DataFrame:
    """(g, id, d): the distance of every row of ``left`` to the nearest row of ``right``, with ``apart`` of those with another id.
    A product of matrices finds the rows that may be nearest, whose distances are then taken exactly."""

    def nearest(ids, x, others, y):
        least = []
        for low in range(0, len(x), 256):
            s = slice(low, low + 256)
            rough, slack = _rough(x[s], y)
            if apart:
                rough[ids[s][:, None] == others[None, :]] = np.inf
            rows, columns = np.nonzero((rough <= rough.min(axis=1)[:, None] + slack) & (rough < np.inf))
            d = np.full(len(rough), np.inf)
            np.minimum.at(d, rows, _exact(x[s], y, rows, columns))
            least.append(d)
        return {"id": ids, "d": np.concatenate(least)}

    found = blocked(left, right, nearest, "id long, d double", 4 * BLOCK).groupBy("g", "id").agg(F.min("d").alias("d"))
    return found.where(F.col("d") < float("inf"))


#: Rows of a block whose pairs are told apart by one product of matrices.
WIDE = 4096


def _rough(x, y):
    """Squared distances from a product of matrices, and by how much they may be wrong."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return xx[:, None] + yy[None, :] - 2 * (x @ y.T), 1e-8 * (1 + xx.max() + yy.max())


def _exact(x, y, rows, columns):
    d = np.zeros(len(rows))
    for low in range(0, len(rows), 1 << 16):  # copies may leave every pair of a step
        s = slice(low, low + (1 << 16))
        d[s] = ((x[rows[s]] - y[columns[s]]) ** 2).sum(axis=1)
    return np.sqrt(d)


def nearest_rows(vectors: DataFrame, k: int) -> DataFrame:
    """(g, id, neighbour, d, rank) of the k nearest others in the group, ties at nine digits by id.  A product of matrices
    finds the rows that may be among them, whose distances are then taken exactly; a pair of blocks gives k a row at most."""

    def near(ids, x, others, y):
        found = [[], [], []]
        for low in range(0, len(x), 256):
            s = slice(low, low + 256)
            rough, slack = _rough(x[s], y)
            rough[ids[s][:, None] == others[None, :]] = np.inf
            limit = np.partition(rough, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
            rows, columns = np.nonzero((rough <= limit[:, None] + slack) & (rough < np.inf))
            d = _exact(x[s], y, rows, columns)
            order = np.lexsort((others[columns], np.round(d, 9), rows))
            rows, columns, d = rows[order], columns[order], d[order]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            for part, v in zip(found, (ids[s][rows[first]], others[columns[first]], d[first])):
                part.append(v)
        return dict(zip(("id", "neighbour", "d"), map(np.concatenate, found)))

    order = Window.partitionBy("g", "id").orderBy(F.round("d", 9), "neighbour")
    return blocked(vectors, vectors, near, "id long, neighbour long, d double", WIDE).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def furthest_pairs(vectors: DataFrame, k: int) -> DataFrame:
    """(g, a, b, d) of the k pairs a < b of each group that are furthest apart; a pair of blocks gives k of them."""

    def far(ids, x, others, y):
        a, b, d = np.zeros(0, ids.dtype), np.zeros(0, ids.dtype), np.zeros(0)
        same = ids[0] in others
        for low in range(0, len(x), 256):
            s = slice(low, low + 256)
            rough, slack = _rough(x[s], y)
            if same:
                rough[ids[s][:, None] >= others[None, :]] = -np.inf
            limit = np.partition(rough, -k, axis=None)[-k] if rough.size > k else -np.inf
            # what is below the k-th so far need not be looked at
            limit = max(limit - slack, d[-1] ** 2 - slack if len(d) == k else -np.inf)
            rows, columns = np.nonzero((rough >= limit) & (rough > -np.inf))
            one, two = ids[s][rows], others[columns]
            a, b, d = np.concatenate([a, np.minimum(one, two)]), np.concatenate([b, np.maximum(one, two)]), np.concatenate([d, _exact(x[s], y, rows, columns)])
            best = np.lexsort((b, a, -d))[:k]
            a, b, d = a[best], b[best], d[best]
        return {"a": a, "b": b, "d": d}

    order = Window.partitionBy("g").orderBy(F.desc("d"), "a", "b")
    found = blocked(vectors, vectors, far, "a long, b long, d double", WIDE, once=True)
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def alike_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(g, a, b, similarity) of the pairs a < b of each group whose cosine is at least ``threshold``, 0 without length; other pairs
    are no rows.  Near the threshold what counts is the sum of products, not the product of matrices."""

    def alike(ids, x, others, y):
        u, w, same, found = _unit(x), _unit(y), ids[0] in others, [[], [], []]
        for s in _steps(x):
            rough = u[s] @ w.T
            if same:
                rough[ids[s][:, None] >= others[None, :]] = -np.inf
            rows, columns = np.nonzero(rough >= threshold - 1e-9)
            one, two, length = ids[s][rows], others[columns], np.sqrt((x[s][rows] ** 2).sum(axis=1) * (y[columns] ** 2).sum(axis=1))
            c = (x[s][rows] * y[columns]).sum(axis=1) / np.where(length > 0, length, 1.0)
            hit = c >= threshold
            for part, v in zip(found, (np.minimum(one, two)[hit], np.maximum(one, two)[hit], c[hit])):
                part.append(v)
        return dict(zip(("a", "b", "similarity"), map(np.concatenate, found)))

    return blocked(vectors, vectors, alike, "a long, b long, similarity double", 2 * BLOCK, once=True)


def _within(x, y, eps: float) -> np.ndarray:
    """Which pairs are within ``eps``; those that a product of matrices cannot tell are taken exactly."""
    rough, slack = _rough(x, y)
    near = rough <= eps * eps
    rows, columns = np.nonzero(np.abs(rough - eps * eps) <= slack)
    near[rows, columns] = _exact(x, y, rows, columns) <= eps
    return near


def neighbour_counts(vectors: DataFrame, eps: float) -> DataFrame:
    """(g, id, n): rows within ``eps``, the row itself included."""

    def count(ids, x, others, y):
        near = _within(x, y, eps)
        if ids[0] in others:
            return {"id": ids, "n": near.sum(axis=1)}
        return {"id": np.concatenate([ids, others]), "n": np.concatenate([near.sum(axis=1), near.sum(axis=0)])}

    return blocked(vectors, vectors, count, "id long, n long", 4 * BLOCK, once=True).groupBy("g", "id").agg(F.sum("n").alias("n"))


def linked_within(vectors: DataFrame, eps: float) -> DataFrame:
    """(g, a, b), a < b: edges with the components of the pairs within ``eps``; two blocks give one edge a row at most."""

    def link(ids, x, others, y):
        near, most = _within(x, y, eps), np.iinfo(np.int64).max
        one, two = ids.astype(np.int64), others.astype(np.int64)
        while True:
            low = np.minimum(two, np.where(near, one[:, None], most).min(axis=0))
            up = np.minimum(one, np.where(near, low[None, :], most).min(axis=1))
            if (low == two).all() and (up == one).all():
                break
            one, two = up, low
        a, b = np.concatenate([one, two]), np.concatenate([ids, others])
        return {"a": a[a != b], "b": b[a != b]}

    return blocked(vectors, vectors, link, "a long, b long", 2 * BLOCK, once=True).distinct()


def least_label_within(vectors: DataFrame, labelled: DataFrame, eps: float) -> DataFrame:
    """(g, id, label): the least ``label`` (long) of a labelled row within ``eps``, where there is one."""
    # the halves of the label ride behind the vector, exact as doubles
    halves = F.array(F.shiftright("label", 32).cast("double"), F.col("label").bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"))
    right = labelled.select("g", "id", F.concat("v", halves).alias("v"))

    def least(ids, x, others, y):
        near, most = _within(x, y[:, :-2], eps), np.iinfo(np.int64).max
        label = (y[:, -2].astype(np.int64) << 32) | y[:, -1].astype(np.int64)
        found = np.where(near, label[None, :], most).min(axis=1)
        hit = near.any(axis=1)
        return {"id": ids[hit], "label": found[hit]}

    return blocked(vectors, right, least, "id long, label long", 4 * BLOCK).groupBy("g", "id").agg(F.min("label").alias("label"))


def neighbour_uniformity(vectors: DataFrame) -> DataFrame:
    """(g, mean, deviation, cv): how unlike the distances to the nearest neighbours of a group are."""
    d = nearest_distance(vectors, vectors).groupBy("g").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("deviation"))
    return d.withColumn("cv", F.col("deviation") / F.greatest("mean", F.lit(1e-12)))


def similarity_scores(vectors: DataFrame, threshold: float = 0.9, k: int = 3) -> DataFrame:
    """(g, id, novelty, redundant, redundancy): 1 - the greatest cosine to another row, cut to 0..1; whether one reaches
    ``threshold``; the mean of the min(k, n - 1) greatest of them and a 0 for the row itself.  Alone: 0, false, 0."""

    def top(ids, x, others, y):
        u, w, best = _unit(x), _unit(y), []
        for s in _steps(x):
            c = np.where(ids[s][:, None] == others[None, :], -np.inf, u[s] @ w.T)
            best.extend(sorted((v for v in row if v > -np.inf), reverse=True)[:k] for row in np.sort(c, axis=1)[:, -k:].tolist())
        return {"id": ids, "best": best}

    n = vectors.where("v IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rows = blocked(vectors, vectors, top, "id long, best array<double>").groupBy("g", "id").agg(F.flatten(F.collect_list("best")).alias("best")).join(n, "g")
    most = F.array_max("best")
    take = F.least(F.lit(k), F.col("n") - 1).cast("int")
    kept = F.slice(F.sort_array(F.concat("best", F.array(F.lit(0.0))), asc=False), 1, F.greatest(take, F.lit(1)))
    mean = F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.greatest(take, F.lit(1))
    return rows.select("g", "id", F.when(most.isNull(), 0.0).otherwise(F.greatest(F.least(1 - most, F.lit(1.0)), F.lit(0.0))).alias("novelty"), F.coalesce(most >= threshold, F.lit(False)).alias("redundant"), F.when(F.col("n") > 1, mean).otherwise(0.0).alias("redundancy"))


#: Columns of a tile of kernel values, so that all of them stay in a core's cache.
SUMMED = 1024


def kernel_distances(vectors: DataFrame, bandwidths=(0.5, 1.0, 2.0)) -> DataFrame:
    """(g, kernel, bandwidth, epd): 1 - the mean kernel value over pairs for rbf, imq, laplacian, cosine and polynomial."""

    def sums(ids, x, others, y):
        total, (u, w) = {}, (_unit(x), _unit(y))
        # two blocks meet once, and stand for both orders of their pairs
        same = ids[0] in others
        times = 1.0 if same else 2.0
        for t in (slice(k, k + SUMMED) for k in range(0, len(y), SUMMED)):
            for s in _steps(x):
                other = ids[s][:, None] != others[None, t] if same else ...
                sq, l1, dots, cos = _euclidean(x[s], y[t]) ** 2, DISTANCES["manhattan"](x[s], y[t]), x[s] @ y[t].T, u[s] @ w[t].T
                sq, l1, dots, cos = (v[other] for v in (sq, l1, dots, cos))
                fixed = {"cosine": float(cos.sum())}
                for h in bandwidths:
                    kernels = {"rbf": np.exp(-sq / (2 * h * h + 1e-12)), "imq": 1 / np.sqrt(1 + sq / (h * h + 1e-12)), "laplacian": np.exp(-l1 / (h + 1e-12))}
                    power = max(2, round(h))
                    if power not in fixed:
                        fixed[power] = float(((dots + 1) ** power).sum())
                    for name, value in [*((k, float(v.sum())) for k, v in kernels.items()), ("cosine", fixed["cosine"]), ("polynomial", fixed[power])]:
                        total[name, h] = total.get((name, h), 0.0) + times * value
        return {"kernel": [name for name, _ in total], "bandwidth": [float(h) for _, h in total], "s": list(total.values())}

    n = vectors.where("v IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = blocked(vectors, vectors, sums, "kernel string, bandwidth double, s double", 4 * BLOCK, once=True, most=LARGE).groupBy("g", "kernel", "bandwidth").agg(F.sum("s").alias("s")).join(n, "g")
    return each.select("g", "kernel", "bandwidth", F.when(F.col("n") > 1, 1 - F.col("s") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("epd"))


def coverage(selected: DataFrame, reference: DataFrame, radii) -> DataFrame:
    """(g, radius, precision, recall, f): shares of the selected rows near a reference row and of the reference rows near a
    selected one.  Ids of both sides differ."""
    radius = F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius")
    share = lambda a, b, name: nearest_distance(a, b).select("g", "d", radius).groupBy("g", "radius").agg(F.avg((F.col("d") <= F.col("radius")).cast("double")).alias(name))
    both = share(selected, reference, "precision").join(share(reference, selected, "recall"), ["g", "radius"])
    p, r = F.col("precision"), F.col("recall")
    return both.select("g", "radius", p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"))


def _euclidean(x, y):
    """From a product of matrices; what it tells badly, pairs that are very near, is taken from the differences."""
    rough, slack = _rough(x, y)
    # 1e-8 of the squared lengths may be lost, so below 1e-3 of them the distance would be off in the sixth digit
    rows, columns = np.nonzero(rough < slack * 1e5)
    d = np.sqrt(np.maximum(rough, 0))
    d[rows, columns] = _exact(x, y, rows, columns)
    return d


def _by_dimension(take):
    """Distances from one dimension after another, without an array of all differences."""

    def distance(x, y):
        total, gap = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
        for p, q in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
            np.subtract(p[:, None], q[None, :], out=gap)
            np.abs(gap, out=gap)
            take(total, gap, out=total)
        return total

    return distance


def _cosine(x, y):
    return 1 - _unit(x) @ _unit(y).T


DISTANCES = {"euclidean": _euclidean, "manhattan": _by_dimension(np.add), "chebyshev": _by_dimension(np.maximum), "cosine": _cosine}

#: Bins of a pass over the distances, and passes that narrow a rank down: to 2 ** -36 of the range.
BINS = 4096
PASSES = 3


def _tiles(y: np.ndarray):
    return (slice(k, k + TILE) for k in range(0, len(y), TILE))


def _each(ids, x, others, y, distance):
    """Distances of the pairs of two blocks, of one block with itself those with the lesser id on the left, some rows at a time."""
    same = ids[0] in others
    for t in _tiles(y):
        for s in _steps(x):
            d = distance(x[s], y[t])
            yield d[ids[s][:, None] < others[None, t]] if same else d.ravel()


def distance_sums(vectors: DataFrame, distance: str = "euclidean") -> DataFrame:
    """(g, n_pairs, total, squares, low, high) over all pairs of a group; groups of one row have none."""
    d = DISTANCES[distance]

    def sums(ids, x, others, y):
        n, s, ss, low, high = 0, 0.0, 0.0, np.inf, -np.inf
        for v in _each(ids, x, others, y, d):
            if len(v):
                n, s, ss, low, high = n + len(v), s + float(v.sum()), ss + float((v * v).sum()), min(low, float(v.min())), max(high, float(v.max()))
        return {k: [v] if n else [] for k, v in zip(("n", "s", "ss", "low", "high"), (n, s, ss, low, high))}

    parts = blocked(vectors, vectors, sums, "n long, s double, ss double, low double, high double", 4 * BLOCK, once=True, most=LARGE)
    return parts.groupBy("g").agg(F.sum("n").alias("n_pairs"), F.sum("s").alias("total"), F.sum("ss").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))


def distance_bins(vectors: DataFrame, limits: DataFrame, distance: str = "euclidean", bins: int = BINS) -> DataFrame:
    """limits (g, spans array<struct<low, width, high>>) to (g, span, bin, c): how many distances of pairs fall into which of ``bins``
    bins of that width from ``low``.  A distance of ``high`` belongs to the last bin; at width 0 all equal ``low`` to bin 0."""
    d = DISTANCES[distance]
    spans = F.flatten(F.transform("spans", lambda s: F.array(s["low"], s["width"], s["high"])))
    # the limits ride behind the vectors of the left side, so that a task has those of its group
    left = vectors.where("v IS NOT NULL").join(limits, "g").select("g", "id", F.concat("v", spans, F.array(F.size("spans").cast("double"))).alias("v"))

    def count(ids, x, others, y):
        k = int(x[0, -1])
        at, x, found = x[0, -1 - 3 * k : -1].reshape(k, 3), x[:, : -1 - 3 * k], np.zeros((k, bins), np.int64)
        kinds, kind = np.unique(at, axis=0, return_inverse=True)  # the two middle ranks mostly share a span
        for v in _each(ids, x, others, y, d):
            for j, (low, width, high) in enumerate(kinds):
                v_in = v[(v >= low) & (v <= high)] if width > 0 else v[v == low]
                place = (v_in - low) / width if width > 0 else np.zeros(len(v_in))
                found[j] += np.bincount(np.minimum(place, bins - 1).astype(np.int64), minlength=bins)
        found = found[kind.ravel()]
        span, place = np.nonzero(found)
        return {"span": span, "bin": place, "c": found[span, place]}

    return blocked(left, vectors, count, "span long, bin long, c long", 4 * BLOCK, once=True, most=LARGE).groupBy("g", "span", "bin").agg(F.sum("c").alias("c"))


def _median(vectors: DataFrame, ranges: DataFrame, distance: str) -> DataFrame:
    """(g, median) from ranges (g, n_pairs, low, high) that hold all distances of a group."""
    state = ranges.select("g", *[F.array(*[F.struct(F.lit(j).cast("long").alias("span"), F.col("low").alias("low"), ((F.col("high") - F.col("low")) / BINS).alias("width"), F.col("high").alias("high"), rank.cast("long").alias("rank")) for j, rank in enumerate((F.floor((F.col("n_pairs") - 1) / 2), F.floor(F.col("n_pairs") / 2)))]).alias("s")]).select("g", F.inline("s"))
    for step in range(PASSES):
        limits = state.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("span", "low", "width", "high"))), lambda s: F.struct(s["low"].alias("low"), s["width"].alias("width"), s["high"].alias("high"))).alias("spans"))
        order = Window.partitionBy("g", "span").orderBy("bin")
        below = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        found = distance_bins(vectors, limits, distance).withColumn("below", below).join(state, ["g", "span"]).where("below <= rank")
        # the last bin that starts at or below the rank
        best = found.groupBy("g", "span").agg(F.max_by(F.struct((F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.col("width").alias("width"), (F.col("rank") - F.col("below")).alias("rank")), "bin").alias("b"))
        state = best.select("g", "span", "b.low", (F.col("b.width") / BINS).alias("width"), (F.col("b.low") + F.col("b.width")).alias("high"), "b.rank").transform(kept)
    # the middle of the last bin
    return state.groupBy("g").agg(F.avg(F.col("low") + F.col("width") * BINS / 2).alias("median"))


def median_distance(vectors: DataFrame) -> DataFrame:
    """(g, median) of the Euclidean distances of all pairs.  Twice the greatest distance to one row bounds them, so all pairs meet
    only to be counted."""
    rows = vectors.where("v IS NOT NULL").select("g", "id", "v")
    one = rows.groupBy("g").agg(F.min_by("v", "id").alias("_p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    square = F.aggregate(F.zip_with("v", "_p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    ranges = rows.join(one, "g").groupBy("g", "n").agg((2.000001 * F.sqrt(F.max(square))).alias("high"))
    ranges = ranges.select("g", (F.col("n") * (F.col("n") - 1) / 2).alias("n_pairs"), F.lit(0.0).alias("low"), "high").transform(kept)
    return _median(rows, ranges, "euclidean")


def distance_summary(vectors: DataFrame, distance: str = "euclidean") -> DataFrame:
    """(g, n_pairs, mean, median, spread, diameter, variance, total) over all pairs.  The two middle distances are narrowed down
    by passes of bin counts, to the 2 ** -36th part of the range."""
    sums = distance_sums(vectors, distance).transform(kept)
    median = _median(vectors, sums, distance)
    mean = F.col("total") / F.col("n_pairs")
    return sums.join(median, "g").select("g", "n_pairs", mean.alias("mean"), "median", F.col("low").alias("spread"), F.col("high").alias("diameter"), F.greatest(F.col("squares") / F.col("n_pairs") - mean * mean, F.lit(0.0)).alias("variance"), "total")


def distance_entropy(vectors: DataFrame, distance: str = "euclidean", bins: int = 30) -> DataFrame:
    """(g, entropy) of the distances in equal bins of their range, over ln(bins); 0 where all are equal."""
    sums = distance_sums(vectors, distance)
    limits = sums.select("g", F.array(F.struct("low", ((F.col("high") - F.col("low")) / bins).alias("width"), "high")).alias("spans"))
    c = distance_bins(vectors, limits, distance, bins).withColumn("c", F.col("c").cast("double"))
    h = (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")) / float(np.log(bins))
    return c.groupBy("g").agg(F.greatest(h, F.lit(0.0)).alias("entropy"))  # rounding may leave less than 0


def fairness_ratio(vectors: DataFrame) -> DataFrame:
    """One row: the mean distance of pairs within a group over that of pairs across groups; null if there are none of a kind."""
    number = vectors.select("g").distinct().select("g", F.xxhash64("g").alias("_h"))
    # the halves of the group's hash ride behind the vector, exact as doubles
    marks = F.array(F.shiftright("_h", 32).cast("double"), F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"))
    rows = vectors.where("v IS NOT NULL").join(number, "g").select(F.lit(0).alias("g"), "id", F.concat("v", marks).alias("v"))

    def sums(ids, x, others, y):
        total, one = np.zeros((2, 2)), ids[0] in others
        for s in _steps(x):
            d, less = _euclidean(x[s, :-2], y[:, :-2]), (ids[s][:, None] < others[None, :]) if one else True
            same = (x[s, None, -2] == y[None, :, -2]) & (x[s, None, -1] == y[None, :, -1])
            for k, where in enumerate((same & less, ~same & less)):
                total[k] += d[where].sum(), where.sum()
        return {"same": [total[0, 0]], "n_same": [int(total[0, 1])], "across": [total[1, 0]], "n_across": [int(total[1, 1])]}

    t = blocked(rows, rows, sums, "same double, n_same long, across double, n_across long", 4 * BLOCK, once=True).agg(*[F.sum(c).alias(c) for c in ("same", "n_same", "across", "n_across")])
    return t.select(F.when((F.col("n_same") > 0) & (F.col("n_across") > 0) & (F.col("across") > 0), F.col("same") / F.col("n_same") / (F.col("across") / F.col("n_across"))).alias("ratio"))
