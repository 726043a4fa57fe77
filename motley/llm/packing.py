"""Operator 6, pattern packing by non-negative least squares.

1. Texts become token ids and a closing id 0; documents longer than a sequence
   are cut into pieces.  Texts are read once; only (length, checksum) rows move.
2. The histogram of piece lengths (at most 2048 numbers, whatever the input)
   reaches the driver.
3. Patterns of two to four pieces that fill a sequence are enumerated over it;
   non-negative least squares, by coordinate descent until the counts stand
   still, finds repeat counts whose lengths match the histogram; these are
   rounded down and cut to what is there.
4. The residual histogram, whatever least squares left, is packed best-fit
   decreasing, whole groups of equal sequences at a time, so the work does not
   depend on the number of pieces.
5. Pieces are ranked inside their length: they are dealt by range of (length,
   doc_id, piece), so one length may fill many tasks, numbered in each task, and
   the tasks' counts (at most tasks + 2048 rows) are summed up.  Rank and plan
   give the sequence and the place in it.

The broadcast plan has a row for each place in a pattern.  Patterns depend on the
at most 2048 different lengths, not on how many pieces there are: a histogram of
10**9 pieces of all lengths makes a plan of under 2 MB (``tests/llm``).

Edge cases: null or empty text is one piece of one token (id 0); null doc_ids
and repeated rows are packed like others; an empty table gives no rows; other
columns are ignored.  Very long texts become many pieces, none is left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm import textbytes as tb
from motley.llm.shared import written
from motley.llm.tokens import ENCODE_BYTES, encoder, vocabulary
from motley.session import ship

SIZE = 2048


def _cut(path: str, size: int):
    end = np.zeros(1, "<u4").tobytes()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()), tb.strings(batch.column("text"))
            for i, j in tb.slices(tb.utf8(texts)[1], ENCODE_BYTES):
                owner, piece, start, length, crc = [], [], [], [], []
                for k, data in enumerate(encoder(path).encode(texts.slice(i, j - i).to_pylist()), i):
                    data += end
                    for n, at in enumerate(range(0, len(data), 4 * size)):
                        part = data[at : at + 4 * size]
                        owner.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _number(batches):
    """Adds the task's number and the place among the task's pieces of that length."""
    task, seen = TaskContext.get().partitionId(), np.zeros(SIZE + 1, np.int64)
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        if lengths.max(initial=0) >= len(seen):
            seen = np.concatenate((seen, np.zeros(int(lengths.max()) + 1 - len(seen), np.int64)))
        order = np.argsort(lengths, kind="stable")
        ranked = lengths[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked) + seen[ranked]
        seen += np.bincount(lengths, minlength=len(seen))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(order), task, np.int64)), pa.array(place)], names=[*batch.schema.names, "task", "place"])


def patterns(lengths: np.ndarray, size: int = SIZE, spread: int = 6) -> list[tuple[int, ...]]:
    """Few-piece patterns that fill a sequence, or nearly: for each longest piece its best
    partner, and for some second pieces the best third (and for short ones a fourth)."""
    have = np.sort(np.unique(lengths))
    best = np.zeros(size + 1, np.int64)  # the largest length at most r, 0 if none
    best[have[have <= size]] = have[have <= size]
    best = np.maximum.accumulate(best)
    found = {(size,)} if best[size] == size else set()
    slack = 2
    for a in have[::-1].tolist():
        rest = size - a
        if b := int(best[rest]):
            if rest - b <= slack:
                found.add(tuple(sorted((a, b), reverse=True)))
            options = have[(have <= rest) & (have <= a) & (2 * have >= rest)]
            for b in options[np.unique(np.linspace(0, len(options) - 1, spread).astype(int))].tolist() if len(options) else []:
                c = int(best[rest - b])
                if c and rest - b - c <= slack:
                    found.add(tuple(sorted((a, b, c), reverse=True)))
            options = have[(3 * have >= rest) & (2 * have <= rest)]
            for b in options[np.unique(np.linspace(0, len(options) - 1, spread // 2).astype(int))].tolist() if len(options) else []:
                c = int(best[min(rest - b, size)] if rest - b > 0 else 0)
                c = int(best[(rest - b) // 2])
                d = int(best[rest - b - c]) if c else 0
                if d and rest - b - c - d <= slack:
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found, reverse=True)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray) -> np.ndarray:
    """The x >= 0 with the least ||A x - target||, A's columns counting the lengths of each pattern; coordinate descent."""
    left = target.astype(float).tolist()
    x = [0.0] * len(columns)
    counts = []
    for p in columns:
        of = defaultdict(int)
        for n in p:
            of[n] += 1
        counts.append((list(of.items()), float(sum(v * v for v in of.values()))))
    moved, still = np.inf, 0.01 + 1e-7 * float(target.sum())
    while moved > still:
        moved = 0.0
        for k, (of, norm) in enumerate(counts):
            step = 0.0
            for n, v in of:
                step += left[n] * v
            step = max(step / norm, -x[k])
            if step:
                x[k] += step
                moved += abs(step)
                for n, v in of:
                    left[n] -= step * v
    return np.array(x)


def best_fit(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (pattern, repeats)."""
    open_: dict[int, list[list]] = defaultdict(list)  # by room left: [pattern, repeats]
    free = np.zeros(size + 1, np.int64)  # sequences by room left
    for n in range(size, 0, -1):
        todo = int(histogram[n])
        while todo:
            fits = np.flatnonzero(free[n:] > 0)
            if len(fits):
                room = n + int(fits[0])
                group = open_[room][-1]
                take = min(todo, group[1])
                group[1] -= take
                if not group[1]:
                    open_[room].pop()
                pattern = group[0] + (n,)
            else:
                room, each = size, size // n
                take = todo // each or 1
                each = min(each, todo)
                pattern = (n,) * each
                open_[size - n * each].append([pattern, take])
                free[size - n * each] += take
                todo -= take * each
                continue
            free[room] -= take
            free[room - n] += take
            open_[room - n].append([pattern, take])
            todo -= take
    return [(p, k) for groups in open_.values() for p, k in groups]


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use up the histogram of lengths (index: length)."""
    columns = patterns(np.flatnonzero(histogram), size)
    left = histogram.astype(np.int64).copy()
    fitted = []
    for p, x in zip(columns, np.floor(nnls(columns, histogram) + 1e-9).astype(np.int64).tolist()):
        of = defaultdict(int)
        for n in p:
            of[n] += 1
        x = min(x, *(int(left[n]) // v for n, v in of.items()))
        if x > 0:
            fitted.append((p, x))
            for n, v in of.items():
                left[n] -= v * x
    return fitted + best_fit(left, size)


def _slots(parts: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each place in a pattern: length << 40 | first rank, that rank, first sequence, offset; sorted."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, repeats in parts:
        offset = 0
        for n in pattern:
            rows.append((n << 40 | used[n], used[n], base, offset))
            used[n] += repeats
            offset += n
        base += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(table[:, k]) for k in range(4))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer or vocabulary(), size), shape), "pieces")
    histogram = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `size` rows
        histogram[row["length"]] = row["count"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = written(pieces.repartitionByRange(parts, "length", "doc_id", "piece").mapInArrow(_number, f"{shape}, task long, place long"), "ranked")
    tasks = sorted((r["length"], r["task"], r["count"]) for r in ranked.groupBy("task", "length").count().collect())  # at most tasks + size rows
    base, at = {}, defaultdict(int)
    for length, task, count in tasks:
        base[task << 24 | length] = at[length]
        at[length] += count
    keys = np.array(sorted(base), np.int64)
    sent = spark.sparkContext.broadcast((keys, np.array([base[k] for k in keys.tolist()], np.int64), *_slots(plan(histogram, size))))

    def place(batches):
        keys, firsts, slot, low, sequence, offset = sent.value
        for batch in batches:
            lengths, task, number = (batch.column(c).to_numpy() for c in ("length", "task", "place"))
            rank = firsts[np.searchsorted(keys, task << 24 | lengths)] + number
            k = np.searchsorted(slot, lengths << 40 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[k] + rank - low[k]), pa.array(offset[k])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{shape}, sequence_id long, offset long")
