"""Hashed keys of rows that meet their equals of all rows, without a row for each key.

The task that holds some rows deals their keys out to buckets, one row of arrays a bucket; a bucket's task tells for each
key what it is worth, sums this for each row that sent keys to it, and sends the sums back to where the rows are listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words or characters that are cut at a time, and characters of text a bucket is for.
TALLY = 1 << 19
BUCKET = 48 << 20
#: Words of texts whose grams are counted together before they move.
GATHERED = 1 << 21

TYPES = {"int": pa.int32(), "long": pa.int64()}


def sizes_of(column: pa.Array) -> np.ndarray:
    size = pc.list_value_length if pa.types.is_list(column.type) else pc.utf8_length
    return size(column).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, or characters, of all rows one after another, how many each row has)."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes_of(column)
    chars = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    chars *= np.uint64(0x94D049BB133111EB)
    return chars ^ (chars >> np.uint64(31)), sizes_of(column)


def windows(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of all n-grams of rows of hashed words, ``gram`` a hash of the n hashes."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    if len(words) < n:
        return row[:0], words[:0]
    gram = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        gram += words[k : len(words) - n + 1 + k]
    inside = row[: len(gram)] == row[n - 1 :]
    return row[: len(gram)][inside], gram[inside]


def keyed(row: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return gram ^ ((row.astype(np.uint64, copy=False) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def counts_of(row: np.ndarray, gram: np.ndarray) -> tuple:
    """(key, row, gram, count) of the different grams of every row, by key."""
    key, at, count = np.unique(keyed(row, gram), return_index=True, return_counts=True)
    return key, row[at], gram[at], count


def buckets_for(texts: DataFrame, *columns: str) -> int:
    """So many that a bucket's keys fit a task, whatever the size of the table."""
    chars = sum((F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in columns), F.lit(0))
    return max(8, math.ceil(texts.agg(chars.alias("n")).first()["n"] / BUCKET))


def gathered(batches, column: str, most: int | None = None):
    """Batches joined until they hold ``GATHERED`` words, or ``most``, so that what they repeat moves once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(sizes_of(batch.column(column)).sum())
        if size >= (most or GATHERED):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sliced(batch: pa.RecordBatch, columns: list[str], most: int | None = None):
    """Slices of some ``most`` words or characters."""
    part = np.cumsum(sum(sizes_of(batch.column(c)) for c in columns)) // (most or TALLY)
    for k in np.unique(part):
        at = np.flatnonzero(part == k)
        yield batch.slice(int(at[0]), len(at))


def sent(rows: DataFrame, words: list[str], cut, extra: dict[str, str], buckets: int, keep: Column | None = None, beside: list[str] = []) -> DataFrame:
    """(bucket, part, row, key, extra...): ``cut(batch)`` yields (n, row, key, [extra...]) with n from 0; bucket is n * buckets + that
    of the key.  ``keep``, a struct, lists the rows of every part, in a bucket below 0."""
    rows = rows.select(*words, *beside, *([keep.alias("_keep")] if keep is not None else []))
    kept = rows.schema["_keep"].dataType.simpleString() if keep is not None else None

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in sliced(batch, words) if batch.num_rows else ():
                part += 1
                of = batch.schema.field("_keep").type if kept else None
                nothing = lambda size: [pa.array([[]] * size, pa.list_(of))] if kept else []
                for n, row, key, others in cut(b):
                    at = (key >> np.uint64(24)) % np.uint64(buckets)
                    order = np.lexsort((row, at))  # rows in order are nearly free once compressed
                    edges = np.searchsorted(at[order], np.arange(buckets + 1, dtype=np.uint64))
                    has = np.flatnonzero(np.diff(edges))
                    offsets = pa.array(np.append(edges[has], len(key)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order], t)) for v, t in zip((row, key.view(np.int64), *others), (pa.int32(), pa.int64(), *(TYPES[x] for x in extra.values())))]
                    yield pa.RecordBatch.from_arrays([pa.array(n * buckets + has, pa.int64()), pa.array(np.full(len(has), part), pa.int64()), *lists, *nothing(len(has))], names)
                if kept:
                    none = [pa.array([[]], pa.list_(t)) for t in (pa.int32(), pa.int64(), *(TYPES[x] for x in extra.values()))]
                    here = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([b.column("_keep")]))
                    yield pa.RecordBatch.from_arrays([pa.array([-part], pa.int64()), pa.array([part], pa.int64()), *none, here], names)

    names = ["bucket", "part", "row", "key", *extra, *(["keep"] if kept else [])]
    schema = ", ".join(["bucket long, part long, row array<int>, key array<long>", *(f"{k} array<{t}>" for k, t in extra.items()), *([f"keep array<{kept}>"] if kept else [])])
    return rows.mapInArrow(run, schema)


def flat(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def returned(packed: DataFrame, extra: list[str], worth, sums: int, orders: int, buckets: int) -> DataFrame:
    """(keep..., sums array<double>): for each row that was sent, order by order, the sums of the ``sums`` arrays that
    ``worth(key, extra...)`` gives for a bucket's keys."""
    kept = packed.schema["keep"].dataType
    kind = kept.elementType.simpleString()

    def meet(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        none = lambda type_: pa.array([[]] * t.num_rows, pa.list_(type_))
        if bucket < 0:
            return pa.table([t.column("part"), pa.array([0] * t.num_rows, pa.int32()), none(pa.int32()), none(pa.float64()), t.column("keep")], names)
        owner = np.repeat(np.arange(t.num_rows), sizes_of(t.column("row").combine_chunks()))
        found = worth(flat(t, "key").view(np.uint64), *(flat(t, c) for c in extra))
        slot, place = np.unique(owner << 32 | flat(t, "row").astype(np.int64), return_inverse=True)
        each = np.stack([np.bincount(place, v, len(slot)) for v in found], axis=1)
        some = each.any(axis=1)
        slot, each = slot[some], each[some]
        edges = np.searchsorted(slot >> 32, np.arange(t.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((slot & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(pa.array((edges * sums).astype(np.int32)), pa.array(each.ravel()))
        return pa.table([t.column("part"), pa.array([bucket // buckets] * t.num_rows, pa.int32()), *lists, pa.nulls(t.num_rows, t.schema.field("keep").type)], names)

    def back(t: pa.Table) -> pa.Table:
        rows = t.column("keep").combine_chunks().flatten()
        size = sizes_of(t.column("row").combine_chunks())
        total = np.zeros((len(rows), orders, sums))
        n = np.repeat(t.column("n").to_numpy(), size)
        np.add.at(total, (flat(t, "row"), n), flat(t, "s").reshape(-1, sums))
        width = orders * sums
        return pa.table([rows, pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(total.ravel()))], names=["keep", "sums"])

    names = ["part", "n", "row", "s", "keep"]
    parts = packed.groupBy("bucket").applyInArrow(meet, f"part long, n int, row array<int>, s array<double>, keep array<{kind}>")
    return parts.groupBy("part").applyInArrow(back, f"keep {kind}, sums array<double>").select("keep.*", "sums")
