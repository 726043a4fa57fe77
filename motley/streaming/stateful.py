"""Stateful streaming operators whose state is a bounded summary of a group (``transformWithState``; RocksDB keeps it).

Every operator first reduces a batch's rows inside their partitions, so a hot group sends its task a few summaries instead
of its rows.  Each has a batch twin built from the same functions:

* ``online_vendi``: Gram sums of unit vectors, d^2 numbers a group; rows with sign -1 are taken out again.
* ``streaming_coreset``: a merge tree of weighted k-center coresets, k rows for each of log(n / k) levels, with a radius
  that bounds how far any row may be from the coreset.
* ``streaming_dpp``: at most k vectors of large determinant; only rows with a gain over the batch's start are offered.
* ``incremental_minhash``: signatures by band key with a time to live; equal signatures are held once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from motley.operators.vectors import _spectrum, entropy_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Chooses the state store that transformWithState needs, where the session still has the default one."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _kind(df: DataFrame) -> T.DataType:
    return df.schema["g"].dataType


class _Stored(StatefulProcessor):
    """A processor with one value: bytes of a numpy array."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("summary", "data binary")

    def load(self) -> np.ndarray | None:
        return np.frombuffer(self.value.get()[0], np.float64) if self.value.exists() else None

    def store(self, data: np.ndarray) -> None:
        self.value.update((np.ascontiguousarray(data, np.float64).tobytes(),))

    def close(self) -> None:
        pass


# --- Vendi score ---


def _gram_parts(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        u, sign = x / np.where(length > 0, length, 1.0), batch.column("sign").to_numpy(zero_copy_only=False)
        keys = batch.column("g").dictionary_encode()
        code = keys.indices.to_numpy(zero_copy_only=False)
        cells = [np.append((u[code == c].T @ (u[code == c] * sign[code == c, None])).ravel(), sign[code == c].sum()).tolist() for c in range(len(keys.dictionary))]
        yield pa.RecordBatch.from_arrays([keys.dictionary, pa.array(cells, pa.list_(pa.float64()))], ["g", "m"])


class _Vendi(_Stored):
    def handleInputRows(self, key, rows, timerValues):
        total = self.load()
        for pdf in rows:
            for cells in pdf["m"]:
                total = np.array(cells) if total is None else total + np.array(cells)
        self.store(total)
        n = round(total[-1])
        yield pd.DataFrame({"g": [key[0]], "n": [n], "vendi": [entropy_of(_spectrum(total)) if n > 0 else 0.0]})


def online_vendi(stream: DataFrame) -> DataFrame:
    """A stream (g, v array<double>, optional sign +1 or -1) to (g, n, vendi) after every batch that names the group."""
    prepare(stream.sparkSession)
    sign = F.col("sign").cast("double") if "sign" in stream.columns else F.lit(1.0)
    rows = stream.where("v IS NOT NULL").select("g", "v", sign.alias("sign"))
    parts = rows.mapInArrow(_gram_parts, T.StructType([T.StructField("g", _kind(rows)), T.StructField("m", T.ArrayType(T.DoubleType()))]))
    out = T.StructType([T.StructField("g", _kind(rows)), T.StructField("n", T.LongType()), T.StructField("vendi", T.DoubleType())])
    return parts.groupBy("g").transformWithStateInPandas(_Vendi(), out, "Update", "None")


# --- coresets ---


def k_center(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(ids, rows, weights, radius): greedy k-center from the least id, every row's weight given to its nearest center; rows of distance 0 are one."""
    order = np.argsort(ids, kind="stable")
    ids, x, weight = ids[order], x[order], weight[order]
    chosen, near = [0], np.linalg.norm(x - x[0], axis=1)
    of = np.zeros(len(x), np.int64)
    while len(chosen) < k and near.max() > 0:
        pick = int(near.argmax())
        d = np.linalg.norm(x - x[pick], axis=1)
        of[d < near] = len(chosen)
        near = np.minimum(near, d)
        chosen.append(pick)
    return ids[chosen], x[chosen], np.bincount(of, weight, len(chosen)), float(near.max())


def _coreset_parts(k: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids, keys = batch.column("id").to_numpy(), batch.column("g").dictionary_encode()
            code = keys.indices.to_numpy(zero_copy_only=False)
            cores = [k_center(ids[code == c], x[code == c], np.ones((code == c).sum()), k) for c in range(len(keys.dictionary))]
            wide = pa.list_(pa.float64())
            columns = [pa.array([c[0].tolist() for c in cores], pa.list_(pa.int64())), pa.array([c[1].ravel().tolist() for c in cores], wide), pa.array([c[2].tolist() for c in cores], wide), pa.array([c[3] for c in cores])]
            yield pa.RecordBatch.from_arrays([keys.dictionary, *columns], ["g", "ids", "vs", "weights", "radius"])

    return run


def _merged(one, two, k: int):
    """The coreset of two coresets; a row is within the larger of their radii, plus the new one, of it."""
    ids, x, weight, radius = k_center(np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), np.concatenate([one[2], two[2]]), k)
    return ids, x, weight, radius + max(one[3], two[3])


class _Coresets(StatefulProcessor):
    """Levels of a merge tree: level j holds a coreset of 2^j batch parts or nothing."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "level int", "ids array<long>, vs array<double>, weights array<double>, radius double")

    def read(self, level: int):
        ids, vs, weights, radius = self.levels.getValue((level,))
        return np.array(ids), np.array(vs).reshape(len(ids), -1), np.array(weights), radius

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for r in pdf.itertuples():
                core, level = (np.array(r.ids), np.array(r.vs).reshape(len(r.ids), -1), np.array(r.weights), r.radius), 0
                while self.levels.containsKey((level,)):
                    core = _merged(self.read(level), core, self.k)
                    self.levels.removeKey((level,))
                    level += 1
                self.levels.updateValue((level,), (core[0].tolist(), core[1].ravel().tolist(), core[2].tolist(), float(core[3])))
        whole = None
        for level in sorted(k[0] for k in self.levels.keys()):
            whole = self.read(level) if whole is None else _merged(whole, self.read(level), self.k)
        yield pd.DataFrame({"g": [key[0]], "ids": [whole[0].tolist()], "vs": [whole[1].tolist()], "weights": [whole[2].tolist()], "radius": [float(whole[3])]})

    def close(self) -> None:
        pass


def streaming_coreset(stream: DataFrame, k: int) -> DataFrame:
    """A stream (g, id long, v) to (g, ids, vs, weights, radius) after every batch that names the group: at most k rows, how many rows
    each stands for, and a bound of every row's distance to them."""
    prepare(stream.sparkSession)
    rows = stream.where("v IS NOT NULL").select("g", F.col("id").cast("long").alias("id"), "v")
    numbers, wide = T.ArrayType(T.DoubleType()), lambda vs: T.StructType([T.StructField("g", _kind(rows)), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("vs", vs), T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType())])
    parts = rows.mapInArrow(_coreset_parts(k), wide(numbers))
    return parts.groupBy("g").transformWithStateInPandas(_Coresets(k), wide(T.ArrayType(numbers)), "Update", "None")


# --- determinantal selection ---


def log_det(x: np.ndarray, gamma: float) -> float:
    if not len(x):
        return 0.0
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    return float(np.linalg.slogdet(np.exp(-gamma * d))[1])


class DeterminantSet:
    """At most k vectors.  A row is taken while it adds more than ``gain`` to the log determinant, or replaces the row whose exchange raises it most."""

    def __init__(self, k: int, gamma: float = 1.0, gain: float = 0.01, ids: list | None = None, held: np.ndarray | None = None):
        self.k, self.gamma, self.gain, self.ids, self.held = k, gamma, gain, ids or [], held

    def offer(self, i: int, v: np.ndarray) -> bool:
        if self.held is None or not len(self.held):
            self.ids, self.held = [i], v[None]
            return True
        now, more = log_det(self.held, self.gamma), np.concatenate([self.held, v[None]])
        if len(self.held) < self.k:
            if log_det(more, self.gamma) - now <= self.gain:
                return False
            self.ids, self.held = [*self.ids, i], more
            return True
        trials = [log_det(np.delete(more, j, 0), self.gamma) for j in range(self.k)]
        best = int(np.argmax(trials))
        if trials[best] <= now:
            return False
        self.ids, self.held = [*self.ids[:best], *self.ids[best + 1 :], i], np.delete(more, best, 0)
        return True


class _Determinants(StatefulProcessor):
    def __init__(self, k: int, gamma: float, gain: float):
        self.options = (k, gamma, gain)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("held", "ids array<long>, vs array<double>")

    def handleInputRows(self, key, rows, timerValues):
        ids, vs = self.value.get() if self.value.exists() else ([], [])
        held = DeterminantSet(*self.options, list(ids), np.array(vs).reshape(len(ids), -1) if len(ids) else None)
        # rows of a batch are one set: their order is that of their ids
        batch = pd.concat(list(rows)).sort_values("id")
        taken = [bool(held.offer(int(i), np.array(v))) for i, v in zip(batch["id"], batch["v"], strict=True)]
        self.value.update((held.ids, held.held.ravel().tolist()))
        yield pd.DataFrame({"g": [key[0]], "ids": [held.ids], "offered": [len(taken)], "taken": [sum(taken)], "log_det": [log_det(held.held, self.options[1])]})

    def close(self) -> None:
        pass


def streaming_dpp(stream: DataFrame, k: int, gamma: float = 1.0, gain: float = 0.01) -> DataFrame:
    """A stream (g, id long, v) to (g, ids, offered, taken, log_det) after every batch: at most k vectors kept for a large determinant of their Gaussian kernel.
    Rows of a batch and group are offered in the order of their ids, which is sequential: a group's rate is what one task can offer."""
    prepare(stream.sparkSession)
    rows = stream.where("v IS NOT NULL").select("g", F.col("id").cast("long").alias("id"), "v")
    out = T.StructType([T.StructField("g", _kind(rows)), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("offered", T.LongType()), T.StructField("taken", T.LongType()), T.StructField("log_det", T.DoubleType())])
    return rows.groupBy("g").transformWithStateInPandas(_Determinants(k, gamma, gain), out, "Update", "None")


# --- MinHash ---


def signatures(texts: DataFrame, shingles: Column, bands: int, rows: int) -> DataFrame:
    """(id, band, key, signature array<long>) of texts with shingles: a row for each band."""
    minima = F.transform(F.sequence(F.lit(0), F.lit(bands * rows - 1)), lambda seed: F.array_min(F.transform("s", lambda x: F.xxhash64(x, seed))))
    signed = texts.select("id", F.array_distinct(shingles).alias("s")).where(F.size("s") > 0).select("id", minima.alias("signature"))
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("signature", b * rows + 1, rows)) for b in range(bands)])
    return signed.select("id", "signature", F.posexplode(keys).alias("band", "key"))


class _Bands(StatefulProcessor):
    def __init__(self, threshold: float, ttl_ms: int | None):
        self.threshold, self.ttl = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "signature binary", "id long", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        held = [(np.frombuffer(k[0], np.int64), v[0]) for k, v in self.seen.iterator()]
        out = []
        for r in pd.concat(list(rows)).sort_values("id").itertuples():
            mine = np.array(r.signature, np.int64)
            alike = [(float((mine == s).mean()), -i) for s, i in held]
            best = max(alike, default=(0.0, 0))
            if best[0] >= self.threshold:
                out.append((int(r.id), -best[1], best[0]))
            if best[0] < 1.0:  # equal signatures are held once, by the first id
                self.seen.updateValue((mine.tobytes(),), (int(r.id),))
                held.append((mine, int(r.id)))
        yield pd.DataFrame(out, columns=["id", "of", "similarity"]).astype({"id": "int64", "of": "int64", "similarity": "float64"})

    def close(self) -> None:
        pass


def incremental_minhash(stream: DataFrame, shingles: Column, threshold: float, bands: int = 32, rows: int = 4, ttl_ms: int | None = None) -> DataFrame:
    """A stream (id long, text) to (id, of, similarity): for every band a text shares with an earlier one whose signature agrees in at
    least ``threshold`` of its numbers, the earlier text most like it there.  A text matched in several bands gives several rows.
    ``ttl_ms``: how long a signature is remembered (processing time)."""
    prepare(stream.sparkSession)
    each = signatures(stream, shingles, bands, rows).select("band", "key", F.col("id").cast("long").alias("id"), "signature")
    out = "id long, of long, similarity double"
    return each.groupBy("band", "key").transformWithStateInPandas(_Bands(threshold, ttl_ms), out, "Append", "ProcessingTime" if ttl_ms else "None")
