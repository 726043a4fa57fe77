"""Operator 3, quality rules: word rules of single texts and the frequency of lines across documents.

Lines are normalised (ASCII lower case, one space between words) and hashed to
64 bits.  For each host (column ``source``) the distinct documents (doc_id) with
a line are counted.  A line found in more than ``max_docs`` of them is removed
from all of them.  A document is rejected if it is depleted, that is if what is
left has fewer than ``min_words`` words (five: no shingle would be left for the
later stages) or less than ``min_share`` of its words, or if a base rule fails.
Of more than ``max_docs`` copies of one document in one host nothing is left: to
this rule they are boilerplate.

Edge cases: null text is an empty text (no words, base_failed); null source is
a host of its own; rows sharing a doc_id count as one document when lines are
counted and are judged one by one, null doc_ids are one document; texts and
lines of any length are hashed whole; a line in exactly ``max_docs`` documents
stays; an empty table gives no rows; other columns are ignored by ``judge`` and
pass through ``apply`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motley.llm import textbytes as tb
from motley.llm.shared import written
from motley.session import ship

MAX_DOCS, MIN_WORDS, MIN_SHARE = 20, 5, 0.2
SYMBOLS = "#*$%&|<>"

_SCHEMA = "doc_id long, source string, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<long>"
_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in SYMBOLS]] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: keys found twice or more; keys equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


class Lines:
    """The \\n-split lines with a word of a slice of documents."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, words: tb.Words):
        breaks = np.flatnonzero(raw == 10)
        starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
        starts = starts[starts < len(raw)]
        starts = starts[raw[starts] != 10]  # others are empty lines; a document's end may be the next one's start
        borders = np.unique(np.concatenate((offsets[1:], breaks)))
        ends = borders[np.searchsorted(borders, starts, "right")] if len(starts) else starts
        first = np.searchsorted(words.starts, starts)
        last = np.searchsorted(words.starts, ends)
        has = last > first
        self.starts, self.ends, self.first, self.last = starts[has], ends[has], first[has], last[has]
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1


def statistics(batches):
    """Arrow kernel: for each document the base counts and the hashes of its different lines."""
    for batch in batches:
        ids, hosts = batch.column("doc_id"), batch.column("source")
        for i, j, cased in tb.each_slice(batch.column("text"), lower=False):
            raw, offs = cased.raw, cased.offsets
            words = tb.Words(raw, offs, lower=True)
            n = j - i
            chars = _per_doc(~cased.space & ((raw & 0xC0) != 0x80), offs)
            symbols = _per_doc(_symbol[raw], offs)
            at, h = cased.windows(8)
            docs = np.repeat(np.arange(n), cased.counts)
            twice, _ = _repeated(tb.mix(h ^ (docs[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
            cover = np.zeros(len(docs) + 9, np.int64)
            np.add.at(cover, at[twice], 1)
            np.add.at(cover, at[twice] + 8, -1)
            repeats = _per_doc(np.cumsum(cover)[: len(docs)] > 0, cased.first)
            lines = Lines(raw, offs, words)
            salt = lines.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            _, later = _repeated(tb.mix(cased.spans(lines.starts, lines.ends) ^ salt))
            dups = np.bincount(lines.doc[later], minlength=n)
            h = words.runs(lines.first, lines.last).view(np.int64)
            cuts = np.searchsorted(lines.doc, np.arange(n + 1))
            digest = cased.spans(offs[:-1], offs[1:]).view(np.int64)
            size = (lines.last - lines.first).astype(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, n).cast(pa.int64()), hosts.slice(i, n).cast(pa.string()), pa.array(digest), pa.array(cased.counts.astype(np.int64)), pa.array(chars), pa.array(symbols), pa.array(dups.astype(np.int64)), pa.array(repeats), lists(h), lists(size)],
                names=["doc_id", "source", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"],
            )


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document: base counts, ``words_left``, ``removed`` (hashes of removed lines), verdicts.

    Text is read once and never shuffled; what moves are line hashes.  Counts
    are aggregated before the shuffle, so one line of a third of all rows is a
    few rows per task; the join that brings limits back is left to adaptive
    skew splitting.
    """
    ship(docs.sparkSession)
    seen = written(docs.select("doc_id", "text", "source").mapInArrow(statistics, _SCHEMA), "lines")
    seen = seen.withColumn("host", F.coalesce("source", F.lit(""))).withColumn("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    single = seen.select("host", "key", "digest", F.explode(F.array_distinct("line_hash")).alias("h"))
    frequent = single.groupBy("host", "h").agg(F.count_distinct("key").alias("n")).where(F.col("n") > max_docs).select(F.col("host").alias("at"), F.col("h").alias("hash"))
    hit = single.join(frequent, (single.host == frequent["at"]) & (single.h == frequent.hash))
    drop = hit.groupBy(F.col("key").alias("of"), F.col("digest").alias("text_digest"), F.col("host").alias("of_host")).agg(F.collect_set("hash").alias("removed"))
    on = (seen.key == drop.of) & (seen.digest == drop.text_digest) & (seen.host == drop.of_host)
    left = F.aggregate(F.zip_with("line_hash", "line_words", lambda h, n: F.when(F.array_contains("removed", h), F.lit(0)).otherwise(n)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = seen.join(drop, on, "left").withColumn("words_left", F.when(F.col("removed").isNull(), F.col("n_words")).otherwise(left))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (F.col("words_left") < min_words) | (F.col("words_left") < F.lit(min_share) * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "words_left", "removed", "digest", "source")


def strip_lines(batches):
    """Arrow kernel: text without the lines whose hashes are in ``_removed``."""
    for batch in batches:
        rows, column, removed = batch.column("_row"), tb.strings(batch.column("_text")), batch.column("_removed")
        for i, j, words in tb.each_slice(column, lower=True):
            texts, dropped = column.slice(i, j - i), removed.slice(i, j - i).to_pylist()
            if any(dropped):
                texts = texts.to_pylist()
                lines = Lines(words.raw, words.offsets, words)
                h = words.runs(lines.first, lines.last).view(np.int64)
                cuts = np.searchsorted(lines.doc, np.arange(j - i + 1))
                for k, hashes in enumerate(dropped):
                    if hashes:
                        gone, own = set(hashes), iter(h[cuts[k] : cuts[k + 1]].tolist())
                        texts[k] = "\n".join(line for line in texts[k].split("\n") if not line.strip(" \t\n\x0b\x0c\r") or next(own) not in gone)
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([rows.slice(i, j - i), texts.cast(pa.string())], names=["_row", "_text"])


def apply(docs: DataFrame, **limits) -> DataFrame:
    """The documents that stay, with frequent lines taken out of their text (``n_chars`` follows)."""
    verdict = judge(docs, **limits).where("kept").select(F.col("doc_id").alias("_id"), F.col("source").alias("_host"), F.col("digest").alias("_digest"), F.col("removed").alias("_removed")).dropDuplicates(["_id", "_host", "_digest"])
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    row = T.StructField("_row", plain.schema["_row"].dataType)
    keyed = plain.mapInArrow(_with_digest, T.StructType([row, T.StructField("_d", T.LongType())]))
    joined = keyed.join(verdict, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest")) & F.col("_row.source").eqNullSafe(F.col("_host")))
    clean = joined.select("_row", F.col("_row.text").alias("_text"), "_removed").mapInArrow(strip_lines, T.StructType([row, T.StructField("_text", T.StringType())]))
    put = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return clean.select(*[put[c].alias(c) if put.get(c) is not None else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def _with_digest(batches):
    for batch in batches:
        row = batch.column("_row")
        text = row.flatten()[row.type.get_field_index("text")]
        found = [np.zeros(0, np.int64)]
        for _, _, words in tb.each_slice(text, lower=False):
            found.append(words.spans(words.offsets[:-1], words.offsets[1:]).view(np.int64))
        yield pa.RecordBatch.from_arrays([row, pa.array(np.concatenate(found), pa.int64())], names=["_row", "_d"])
