r"""Operator 12, fill-in-middle transformation by a parallel automaton scan.

Units are ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``.  An automaton
of five states (start, in a gap, in a word, after ``<``, after ``<`` and a
sentinel's letter) reads UTF-8 bytes and counts the units that end and the
sentinels ``<P>``, ``<S>``, ``<M>`` that it passes.  Texts are cut into lanes of
64 bytes, all lanes advance together, and each yields for every start state the
end state and the counts.  Such results compose associatively: a doubling scan
over a text's lanes gives every lane's entry state and the counts before it, and
only the lanes that hold the two cuts are read again.

A text above ``chunk_bytes`` is dealt out in chunks to other tasks; a chunk's
result is the same five-state function, a few numbers.  The functions of one
text are composed (a Spark string of 2 GB has 32768 chunks), which tells the
chunk, its entry state and the unit within it for each cut; the chosen chunks
are scanned once more, again in parallel.  Texts themselves stay in the JVM,
where the output is put together and taken apart again.

Edge cases: null text is empty, and an empty text is plain with no units; a null
id is hashed as an empty one; repeated rows and ids give a row each; an empty
table gives no rows.  All columns are returned; columns of the input that are
named as an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm import textbytes as tb
from motley.llm.shared import written
from motley.session import ship

SEED, RATE, SPM, CHUNK_BYTES, LANE = 42, 50, 80, 1 << 16, 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

START, GAP, INSIDE, OPEN, LETTER = range(5)
_OTHER, _SPACE, _LESS, _NAME, _MORE, _NONE = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[ord("<")], _CLASS[ord(">")] = _LESS, _MORE
_CLASS[[ord("P"), ord("S"), ord("M")]] = _NAME
_HIT, _FAN = 1 << 32, 64


def _table() -> np.ndarray:
    """For state * 6 + class: the next state, + 8 if a unit ends here, + 8 * 2^32 if a sentinel ends here."""
    made = np.zeros((5, 6), np.int64)
    for state in range(5):
        made[state, _OTHER] = INSIDE
        made[state, _SPACE] = GAP + 8 * (state in (INSIDE, OPEN, LETTER))
        made[state, _LESS] = OPEN
        made[state, _NAME] = LETTER if state == OPEN else INSIDE
        made[state, _MORE] = INSIDE + 8 * _HIT * (state == LETTER)
        made[state, _NONE] = state
    return made.ravel()


_TABLE = _table()


class Scan:
    """Start-state functions of texts: ``to`` and ``counts`` (units + 2^32 * sentinels) of every lane, composed from the text's first lane on."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.offsets, size = offsets, np.diff(offsets)
        lanes = np.maximum(1, -(-size // LANE))
        self.first = np.concatenate(([0], np.cumsum(lanes)))
        text = np.repeat(np.arange(len(size)), lanes)
        self.place = np.arange(len(text)) - self.first[text]
        self.start = offsets[text] + LANE * self.place
        at = self.start[None, :] + np.arange(LANE)[:, None]
        inside = at < offsets[text + 1][None, :]
        self.classes = np.where(inside, _CLASS[raw[np.minimum(at, len(raw) - 1)]], _NONE) if len(raw) else np.full(at.shape, _NONE, np.uint8)
        state, counts = np.tile(np.arange(5), (len(text), 1)), np.zeros((len(text), 5), np.int64)
        for step in self.classes:
            seen = _TABLE[state * 6 + step[:, None]]
            state = seen & 7
            counts += seen >> 3
        reach = 1
        while reach < lanes.max(initial=0):
            late = np.flatnonzero(self.place >= reach)
            mid = state[late - reach]
            after, more = np.take_along_axis(state[late], mid, 1), np.take_along_axis(counts[late], mid, 1)
            counts[late] = counts[late - reach] + more
            state[late] = after
            reach *= 2
        self.to, self.counts = state, counts

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The composed function of every whole text."""
        return self.to[self.first[1:] - 1], self.counts[self.first[1:] - 1]

    def locate(self, text: np.ndarray, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Bytes of ``text`` before the byte where its ``unit``-th unit (from 1) ends, entered in the state ``entry``."""
        lane, begun, left = np.empty(len(text), np.int64), np.empty(len(text), np.int64), np.empty(len(text), np.int64)
        for k, (t, s, u) in enumerate(zip(text, entry, unit, strict=True)):
            low, high = self.first[t], self.first[t + 1]
            j = low + int(np.searchsorted(self.counts[low:high, s] % _HIT, u))
            lane[k], begun[k], left[k] = j, s if j == low else self.to[j - 1, s], u - (0 if j == low else self.counts[j - 1, s] % _HIT)
        found = np.full(len(text), -1, np.int64)
        for step in range(LANE):
            seen = _TABLE[begun * 6 + self.classes[step, lane]]
            begun = seen & 7
            left -= (seen >> 3) % _HIT
            found[(left == 0) & (found < 0)] = step
        return self.start[lane] + found - self.offsets[text]


def _scans(column: pa.Array):
    if pa.types.is_binary(column.type):
        column = column.view(pa.string())
    raw, offsets = tb.utf8(column)
    for i, j in tb.slices(offsets):
        yield i, j, Scan(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


_CUTS = "struct<n: long, hits: long, first: long, second: long>"


def _cuts(column: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Units, sentinels and the byte offsets of both cuts of whole texts."""
    draws = np.stack([h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)])
    parts: list[np.ndarray] = []
    for i, j, scan in _scans(column):
        to, counts = (x[:, START] for x in scan.ends())
        n, size = counts % _HIT + (to != START), np.diff(scan.offsets)
        units = np.sort(draws[:, i:j] % (n + 1), axis=0)
        offsets = np.where(units == n, size, 0)
        which, text = np.nonzero((units > 0) & (units < n))
        offsets[which, text] = scan.locate(text, np.zeros(len(text), np.int64), units[which, text])
        parts.append(np.stack([n, counts // _HIT, *offsets]))
    both = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in both], names=["n", "hits", "first", "second"])


def _pieces(giant: DataFrame, size: int) -> DataFrame:
    """key, piece, data: texts in chunks of ``size`` bytes.  Each substring copies its source, hence the two levels."""
    spans = lambda x, step: F.explode(F.sequence(F.lit(0), ((F.octet_length(x) - 1) / step).cast("int")))
    part = lambda x, at, step: F.substring(F.col(x), F.col(at) * step + 1, F.lit(step))
    coarse = giant.select("key", F.col("body").cast("binary").alias("raw")).select("key", "raw", spans("raw", size * _FAN).alias("big")).select("key", "big", part("raw", "big", size * _FAN).alias("part"))
    fine = coarse.select("key", "big", "part", spans("part", size).alias("small"))
    return fine.select("key", (F.col("big") * _FAN + F.col("small")).cast("long").alias("piece"), part("part", "small", size).alias("data"))


def _summaries(column: pa.Array) -> pa.Array:
    """For every chunk: end states and counts for the five start states."""
    to, counts = [], []
    for _, _, scan in _scans(column):
        a, b = scan.ends()
        to.append(a)
        counts.append(b)
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(x).ravel() if x else [], pa.int64()), 5).cast(pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([lists(to), lists(counts)], names=["to", "counts"])


def _compose(batches):
    """Composes the chunk functions of a text and chooses the chunk of each cut (piece -1: the cut is at the text's start, -2: at its end)."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            state, hits, before, seen = START, 0, [0], [START]
            for part in row["parts"]:
                counted, state = part["counts"][state], part["to"][state]
                hits += counted // _HIT
                before.append(before[-1] + counted % _HIT)
                seen.append(state)
            n = before[-1] + (state != START)
            for which, unit in enumerate(sorted((row["h1"] % (n + 1), row["h2"] % (n + 1)))):
                if 0 < unit < n:
                    piece = int(np.searchsorted(before, unit)) - 1
                    out.append((row["key"], n, hits, which, piece, seen[piece], unit - before[piece]))
                else:
                    out.append((row["key"], n, hits, which, -2 if unit else -1, 0, 0))
        names = ["key", "n", "hits", "which", "piece", "entry", "unit"]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 0 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))] if out else [pa.array([], pa.string() if k == 0 else pa.int64()) for k in range(7)], names=names)


def _locate(column: pa.Array, entry: pa.Array, unit: pa.Array) -> pa.Array:
    entry, unit, out = entry.to_numpy(zero_copy_only=False), unit.to_numpy(zero_copy_only=False), []
    for i, j, scan in _scans(column):
        out.append(scan.locate(np.arange(j - i), entry[i:j], unit[i:j]))
    return pa.array(np.concatenate(out) if out else [], pa.int64())


def _giant_cuts(giant: DataFrame, chunk_bytes: int) -> DataFrame:
    """key and cuts of texts that are dealt out in chunks."""
    pieces = written(_pieces(giant, chunk_bytes).repartition(F.col("key"), F.col("piece")), "fim-chunks")
    summary = F.arrow_udf(_summaries, "struct<to: array<long>, counts: array<long>>")
    parts = pieces.select("key", "piece", summary("data").alias("s")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "s.to", "s.counts"))).alias("parts"))
    shape = "key string, n long, hits long, which long, piece long, entry long, unit long"
    chosen = written(parts.join(giant.select("key", "h1", "h2"), "key").mapInArrow(_compose, shape), "fim-cuts")
    held = pieces.join(chosen.where("piece >= 0"), ["key", "piece"])
    offset = F.arrow_udf(_locate, "long")(F.col("data"), F.col("entry"), F.col("unit"))
    inner = held.select("key", "n", "hits", "which", (F.col("piece") * chunk_bytes + offset).alias("offset"))
    outer = chosen.where("piece < 0").select("key", "n", "hits", "which", F.when(F.col("piece") == -1, 0).alias("offset"))
    at = lambda k: F.max(F.when(F.col("which") == k, F.col("offset")))
    return inner.union(outer).groupBy("key").agg(F.max("n").alias("n"), F.max("hits").alias("hits"), at(0).alias("first"), at(1).alias("second"))


def _restored(output: Column, form: Column) -> Column:
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Adds ``restored``, the text rebuilt from an output and its form alone."""
    return df.withColumn("restored", _restored(F.col(output_col), F.col(form_col)))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns of ``docs`` and n, form, prefix_chars, middle_chars, output: ``rate`` percent of texts rearranged, ``spm`` percent of these suffix first."""
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), digest.alias("digest"))
    base = base.select("row", "body", *[draw(k) for k in (1, 2, 3, 4)])
    cuts = F.arrow_udf(_cuts, _CUTS)
    short = base.where(F.octet_length("body") <= chunk_bytes).withColumn("cut", cuts("body", "h1", "h2"))
    giant = written(base.where(F.octet_length("body") > chunk_bytes).withColumn("key", F.expr("uuid()")), "fim-giants")
    known = giant.join(_giant_cuts(giant, chunk_bytes), "key")
    end = F.octet_length("body").cast("long")
    known = known.select("row", "body", "h1", "h2", "h3", "h4", F.struct("n", "hits", F.coalesce("first", end).alias("first"), F.coalesce("second", end).alias("second")).alias("cut"))
    cut = short.union(known).select("row", "body", F.col("body").cast("binary").alias("raw"), F.col("cut.n").alias("n"), F.col("cut.first").cast("int").alias("first"), F.col("cut.second").cast("int").alias("second"),
        F.when((F.col("body") == "") | (F.col("cut.hits") > 0) | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm").alias("form"))
    part = lambda at, size: F.substring(F.col("raw"), at, size).cast("string")
    prefix, middle = part(F.lit(1), F.col("first")), part(F.col("first") + 1, F.col("second") - F.col("first"))
    cut = cut.select("row", "body", "n", "form", prefix.alias("prefix"), middle.alias("middle"), part(F.col("second") + 1, F.lit(2**31 - 1)).alias("suffix"))
    psm, spm_ = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"), F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    moved = F.col("form") != "plain"
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("body"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED]
    return cut.select(*kept, "n", "form", F.when(moved, F.length("prefix")).cast("long").alias("prefix_chars"), F.when(moved, F.length("middle")).cast("long").alias("middle_chars"), output.alias("output"))


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(g, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(g, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(g, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(g, 25, 8) AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(x) AS restored_sha256
FROM p"""
