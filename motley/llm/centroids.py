"""Operator 11, centroid clustering of integer vectors (Lloyd's rounds with exact arithmetic).

Vectors are kept if they have exactly ``dims`` components, none null or
non-finite; a component x becomes the integer floor(scale * x).  Blocks of
vectors are packed once into a written table, in the narrowest number type that
holds a block.  Every round expands |x|^2 - 2 x.c + |c|^2 block by block with
float64 BLAS.  That is exact while dims * (max|x| + max|c|)^2 stays below 2^53,
which bounds every partial sum in any order; a block beyond it is computed in
64-bit integers, and beyond 2^63 in unbounded ones.  The sums of a round meet in
an RDD treeAggregate; k x dims integers reach the driver, whatever the input.

Edge cases: an empty table, or one without a kept vector, gives no rows; fewer
kept vectors than ``k`` make fewer centroids; repeated rows count and are
returned each; rows with a null id are clustered, but become first centroids
only after all others; first centroids of equal digest (repeated ids) are ordered
by their components; equal distances go to the smaller centroid number; a
distance or an inertia above the range of a long is null, with the assignment
still exact; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motley.llm.shared import written
from motley.session import ship

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
EXACT, LONG = 1 << 53, 1 << 63
BLOCK_ROWS = 4096
_NARROW = (np.int8, np.int16, np.int32, np.int64)


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as exact integers: int64, or Python integers where those are too narrow."""
    with np.errstate(over="ignore"):
        q = np.floor(x * float(scale))
    if not len(q) or np.abs(q).max() < EXACT:
        return q.astype(np.int64)
    return np.array([[floor(Fraction(v) * scale) for v in row] for row in x.tolist()], dtype=object)


def pack(q: np.ndarray) -> tuple[str, bytes]:
    """The name of the narrowest type and the bytes of a block; integers wider than 64 bits as decimal text."""
    if q.dtype == object:
        return "text", " ".join(map(str, q.ravel())).encode()
    low, high = (int(q.min()), int(q.max())) if q.size else (0, 0)
    kind = next(t for t in _NARROW if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return np.dtype(kind).name, q.astype(kind).tobytes()


def unpack(kind: str, data: bytes, dims: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in data.split()], dtype=object).reshape(-1, dims)
    return np.frombuffer(data, kind).reshape(-1, dims).astype(np.int64)


def _largest(m: np.ndarray) -> int:
    return max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (smaller number on ties) and its squared distance, exact."""
    bound = x.shape[1] * (_largest(x) + _largest(centroids)) ** 2
    kind = np.float64 if bound < EXACT else np.int64 if bound < LONG else object
    a, c = x.astype(kind), centroids.astype(kind)
    if kind is object:
        far = np.array([[sum((p - r) ** 2 for p, r in zip(row, other, strict=True)) for other in c] for row in a], dtype=object).reshape(len(a), len(c))
    else:
        far = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
    near = np.array([min(range(len(c)), key=row.__getitem__) for row in far], dtype=np.int64) if kind is object else far.argmin(axis=1)
    best = far[np.arange(len(a)), near]
    return near, best if kind is object else best.astype(np.int64)


class Sums:
    """Componentwise sums, counts and summed distances of clusters as unbounded integers."""

    def __init__(self, k: int, dims: int):
        self.sums, self.counts, self.inertia = np.zeros((k, dims), object), np.zeros(k, object), np.zeros(k, object)

    def add(self, x: np.ndarray, near: np.ndarray, distance: np.ndarray) -> "Sums":
        k = len(self.counts)
        if x.dtype != object and _largest(x) * max(1, len(x)) < EXACT:
            member = (near[None, :] == np.arange(k)[:, None]).astype(np.float64)
            self.sums += (member @ x.astype(np.float64)).astype(np.int64).astype(object)
        else:
            np.add.at(self.sums, near, x.astype(object))
        self.counts += np.bincount(near, minlength=k).astype(object)
        if distance.dtype != object and _largest(distance) * max(1, len(x)) < LONG:
            inertia = np.zeros(k, np.int64)
            np.add.at(inertia, near, distance)
            self.inertia += inertia.astype(object)
        else:
            np.add.at(self.inertia, near, distance.astype(object))
        return self

    def merge(self, other: "Sums") -> "Sums":
        self.sums, self.counts, self.inertia = self.sums + other.sums, self.counts + other.counts, self.inertia + other.inertia
        return self


def _blocks(dims: int, scale: int, width: pa.DataType):
    def run(batches):
        for batch in batches:
            values = batch.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            for at in range(0, len(values), BLOCK_ROWS):
                part = values[at : at + BLOCK_ROWS]
                kind, data = pack(quantised(part, scale))
                ids = batch.column("id").slice(at, len(part))
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.cast(width))
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([data], pa.binary())], names=["ids", "kind", "data"])

    return run


def _assigned(centroids: np.ndarray, dims: int, inertia: list[int], digests: list[str]):
    total = sum(inertia)
    long = lambda v: int(v) if v < LONG else None

    def run(batches):
        for batch in batches:
            for ids, kind, data in zip(batch.column("ids"), batch.column("kind"), batch.column("data"), strict=True):
                near, distance = assign(unpack(kind.as_py(), data.as_py(), dims), centroids)
                n = len(near)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(near, pa.int32()), pa.array([long(d) for d in distance.tolist()], pa.int64()), pa.array([long(inertia[c]) for c in near], pa.int64()), pa.array([long(total)] * n, pa.int64()), pa.array([digests[c] for c in near], pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    ship(spark)
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = plain.where((F.size("v") == dims) & ~bad)
    width = kept.schema["id"].dataType
    shape = T.StructType([T.StructField("ids", T.ArrayType(width)), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = written(kept.mapInArrow(_blocks(dims, scale, to_arrow_type(width)), shape), "vector-blocks")
    # At most k rows, chosen by a top-k of every partition first.
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], T.StructType([T.StructField("vec_id", width)])).selectExpr("vec_id", "cast(null as int) cluster", "cast(null as long) distance", "cast(null as long) cluster_inertia", "cast(null as long) inertia", "cast(null as string) centroid_sha256")
    centroids = quantised(np.array([r["v"] for r in first], np.float64), scale)
    rows = blocks.select("kind", "data").rdd

    def passed(centroids: np.ndarray) -> Sums:
        def seq(sums: Sums, row) -> Sums:
            x = unpack(row["kind"], bytes(row["data"]), dims)
            return sums.add(x, *assign(x, centroids))

        return rows.treeAggregate(Sums(len(centroids), dims), seq, Sums.merge)

    for _ in range(rounds):
        sums = passed(centroids)
        moved = [[s // int(n) for s in row] if n else list(old) for row, n, old in zip(sums.sums, sums.counts, centroids, strict=True)]
        wide = max(abs(int(v)) for row in moved for v in row) >= LONG
        centroids = np.array([[int(v) for v in row] for row in moved], dtype=object if wide else np.int64)
    inertia = [int(v) for v in passed(centroids).inertia]
    digests = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in centroids]
    out = f"vec_id {width.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return blocks.mapInArrow(_assigned(centroids, dims, inertia, digests), out)


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    squares = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))".format(d=dims)
    parts = [
        f"v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS q FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS c, q FROM (SELECT * FROM v ORDER BY sha256('{seed}:' || vec_id), q LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"f{n} AS (SELECT v.r, v.vec_id, v.q, c.c, {squares} AS d FROM v, c{n} c)")
        parts.append(f"a{n} AS (SELECT r, vec_id, q, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS p FROM f{n}) WHERE p = 1)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, i, floor(sum(q[i])::DOUBLE / count(*))::BIGINT AS m FROM a{n}, (SELECT unnest(range(1, {dims} + 1)) AS i) GROUP BY c, i)")
            parts.append(f"m{n} AS (SELECT c, list(m ORDER BY i) AS q FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m ON c.c = m.c)")
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(parts)} SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} c ON a.c = c.c"
    )


#: Means by double division: exact while sums stay below 2^53, as on the test tables.
ORACLE = _oracle()
