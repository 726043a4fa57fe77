"""Operator 8, threshold-scaled document fingerprints (DataFrame functions only).

A fingerprint keeps every hash of a five-word shingle (ASCII lower case) that
lies in the lowest ``FRACTION`` of the 64-bit range, so sketches of parts merge
by union, and overlap and containment of very unequal documents are estimated
from the same hashes.  Likeness is the Jaccard index of two fingerprints.

The edited text of a document takes its second half from the beginning of the
next document in descending doc_id.  Neighbours meet in one window: documents
are dealt by range of doc_id / ``SPAN``, and the head of every such group
(greatest id) is sent along to the next higher group that has documents, the
highest head to the lowest group.  Group heads are linked in the same way, by
ranges, so no window holds more than a range's share of them.  Texts move once,
and sketches are made after that.

Edge cases: null text is empty; texts of one to four words are one shingle;
texts of any length are sketched whole; equal fingerprints without any hash have
likeness 1 if the texts are equal, else 0; a null doc_id comes last in descending
order; rows sharing a doc_id follow one another by text, each the next of the
one before; a single document is its own next; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.llm.shared import GAP, written

FRACTION, WIDTH, SPAN = 0.25, 5, 64
BROADCAST_HEADS = 1 << 20  # rows of 16 bytes
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, fraction: float = FRACTION, width: int = WIDTH) -> Column:
    """Sorted distinct shingle hashes of ``text`` below the threshold, as array<bigint>."""
    limit = -(1 << 63) + int(fraction * (1 << 64))
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), GAP), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) >= width, full).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.filter(_bind(hashes, shingles), lambda h: h < F.lit(limit))))


def likeness(a: Column, b: Column, same_text: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(same_text.cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a has no hash."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def _following(groups: DataFrame) -> DataFrame:
    """(g, head) to (target, head): the head of each group goes to the next higher group, the highest to the lowest."""
    dealt = written(groups.repartitionByRange(_parts(groups), "g").select("g", "head", F.spark_partition_id().alias("part")), "heads")
    linked = dealt.withColumn("target", F.lead("g").over(Window.partitionBy("part").orderBy("g")))
    lowest = dealt.groupBy("part").agg(F.min("g").alias("lowest"))  # one row for a partition
    first = F.min("lowest").over(Window.partitionBy(F.lit(0)))
    over = lowest.select(F.col("part").alias("p"), F.coalesce(F.lead("lowest").over(Window.orderBy("part")), first).alias("over"))
    return linked.join(over, F.col("part") == F.col("p")).select(F.coalesce("target", "over").alias("target"), "head")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def neighbours(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    group = F.floor(F.col("id") / SPAN).cast("long")
    heads = written(_following(rows.groupBy(group.alias("g")).agg(F.max("id").alias("head"))), "guests")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
    rows = rows.join(heads, F.col("id") == F.col("head"), "left")
    home = F.struct(group.alias("g"), F.lit(False).alias("guest"))
    places = F.when(F.col("target").isNull(), F.array(home)).otherwise(F.array(home, F.struct(F.col("target").alias("g"), F.lit(True).alias("guest"))))
    rows = rows.select("doc_id", "id", "text", F.explode(places).alias("place")).select("doc_id", "id", "text", "place.g", "place.guest")
    rows = rows.repartitionByRange(_parts(rows), "g").withColumn("fp", fingerprint(F.col("text"), fraction))
    line = Window.partitionBy("g").orderBy(F.col("guest"), F.col("id").desc(), F.col("text"))
    return rows.withColumn("next", F.lead(F.struct("text", "fp")).over(line)).where(~F.col("guest")).select("doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_in_next."""
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))
    full = neighbours(docs, fraction).withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited"), fraction))
    return full.select(
        "doc_id", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), F.col("text") == F.col("edited")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), F.col("text") == F.col("next_text")).alias("near_next"), containment(F.col("fp"), F.col("next_fp")).alias("contained_in_next"),
    )
