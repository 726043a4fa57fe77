"""Operator 9, line dedup by a log-template tree (DataFrame functions only).

A line with a word is trimmed, white space becomes one blank, and words with a
digit become the variable field ``<*>``.  The fixed-depth tree sends it to a
leaf by its number of words and its first ``DEPTH`` words.  Inside a leaf the
remaining variable fields are found by support: the word at a position is
constant if lines with it there stand in ``min_docs`` documents or more, else
it is ``<*>`` as well.  (Support does not depend on the order of lines, as the
usual running comparison with earlier templates would.)  A template with at
least half of its fields constant that is found in ``min_docs`` different
documents or more is recurring: its lines are dropped from all of them.

Edge cases: null text has no lines and stays null; lines without words stay;
null doc_ids are one document; rows sharing a doc_id are one document with
several texts, repeated rows are treated alike; patterns take time in proportion
to a line, however long; a template in exactly ``min_docs`` documents is
dropped; an empty table gives no rows; other columns pass through ``apply``
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm.shared import GAP, WORD, written

MIN_DOCS, DEPTH, SHARE = 10, 3, 0.5
BROADCAST_LEAVES = 1 << 18
FIELD = "<*>"
_DIGIT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"  # tried once a word, as is _EDGE once a gap
_EDGE = r"^[\x20\x09-\x0D]++|(?<![\x20\x09-\x0D])[\x20\x09-\x0D]++\z"
_LAST = (1 << 63) - 1


def _normal(line: Column) -> Column:
    """One blank between words, none outside; words with digits masked.  One look tells most lines from those that need it."""
    odd = line.rlike(r"[0-9\x09-\x0D]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.regexp_replace(F.regexp_replace(F.regexp_replace(line, _EDGE, ""), GAP, " "), _DIGIT, FIELD)).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """doc, content (hash of the text), pos, norm, leaf, sig of every line with a word."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    split = docs.where("text IS NOT NULL").select(doc.alias("doc"), F.xxhash64("text").alias("content"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    norm = split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc", "content", "pos", _normal(F.col("line")).alias("norm"))
    blanks = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return norm.select("doc", "content", "pos", "norm", F.xxhash64(blanks, F.substring_index("norm", " ", DEPTH)).alias("leaf"), F.xxhash64("norm").alias("sig"))


def _few(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_LEAVES else small


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(all lines without their text; the lines to drop: doc, content, pos)."""
    lines = _lines(docs)
    skinny = written(lines.drop("norm"), "lines")
    sigs = written(skinny.select("leaf", "sig", "doc").distinct().groupBy("leaf", "sig").agg(F.count(F.lit(1)).alias("n_docs")), "sigs")
    leaves = written(sigs.groupBy("leaf").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    there = lines.select("leaf", "sig", "norm").join(_few(leaves), "leaf", "left_semi")
    kinds = there.groupBy("leaf", "sig").agg(F.first("norm").alias("norm")).join(sigs, ["leaf", "sig"])
    kinds = written(kinds, "kinds")

    fields = kinds.select("leaf", "sig", "n_docs", F.posexplode(F.split("norm", " ")).alias("at", "word"))
    support = fields.groupBy("leaf", "at", "word").agg(F.sum("n_docs").alias("support")).where(F.col("support") >= min_docs)
    support = support.select(F.col("leaf").alias("l"), F.col("at").alias("p"), F.col("word").alias("constant"))
    marked = fields.join(support, (F.col("leaf") == F.col("l")) & (F.col("at") == F.col("p")) & (F.col("word") == F.col("constant")), "left")
    marked = marked.select("leaf", "sig", F.struct("at", F.coalesce("constant", F.lit(FIELD)).alias("word")).alias("field"))
    parsed = marked.groupBy("leaf", "sig").agg(F.sort_array(F.collect_list("field")).alias("fields"))
    words = F.transform("fields", lambda f: f["word"])
    constant = F.size(F.filter(words, lambda w: w != FIELD))
    parsed = parsed.where(constant >= share * F.size("fields")).select(F.col("leaf").alias("l"), F.col("sig").alias("s"), F.xxhash64("leaf", F.array_join(words, " ")).alias("template"))
    parsed = written(parsed, "templates")

    found = written(skinny.join(parsed, (F.col("leaf") == F.col("l")) & (F.col("sig") == F.col("s"))).select("doc", "content", "pos", "template"), "found")
    often = found.select("template", "doc").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    often = _few(written(often.select(F.col("template").alias("t")), "often"))
    drop = found.join(often, F.col("template") == F.col("t"), "left_semi").select("doc", "content", "pos")
    return skinny, drop


def _stripped(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """_row (the document), _text without dropped lines, _dropped (how many)."""
    gone = drop.groupBy(F.col("doc").alias("_doc"), F.col("content").alias("_content")).agg(F.collect_set("pos").alias("_gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.col("_row.text")
    on = (F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(_LAST)) == F.col("_doc")) & (F.xxhash64(text) == F.col("_content"))
    joined = rows.join(gone, on, "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    return joined.select("_row", F.when(F.col("_gone").isNull(), text).otherwise(left).alias("_text"), F.coalesce(F.size("_gone"), F.lit(0)).alias("_dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_dropped, text (what is left)."""
    _, drop = recurring(docs.select("doc_id", "text"), min_docs)
    out = _stripped(docs.select("doc_id", "text"), drop)
    breaks = F.regexp_count("_row.text", F.lit(r"(?:^|\n)[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D]"))
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.coalesce(breaks, F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("_dropped") > 0, F.col("_dropped")).otherwise(0).cast("long").alias("n_dropped"), F.col("_text").alias("text"))


def apply(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Documents without their recurring lines (``n_chars`` follows); those left without a word go."""
    _, drop = recurring(docs, min_docs)
    out = _stripped(docs, drop).where((F.col("_dropped") <= 0) | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    put = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[put.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH lines AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS doc, md5(text) AS content, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), norms AS (
  SELECT doc, content, pos, regexp_replace(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), '[^\x20]*[0-9][^\x20]*', '<*>', 'g') AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), keyed AS (
  SELECT *, len(string_split(norm, ' ')) || ' ' || array_to_string(string_split(norm, ' ')[1:3], ' ') AS leaf FROM norms
), sigs AS (SELECT leaf, norm, count(DISTINCT doc) AS n_docs FROM keyed GROUP BY ALL
), kinds AS (SELECT * FROM sigs WHERE leaf IN (SELECT leaf FROM sigs GROUP BY leaf HAVING sum(n_docs) >= 10)
), fields AS (SELECT leaf, norm, n_docs, unnest(string_split(norm, ' ')) AS word, unnest(range(len(string_split(norm, ' ')))) AS place FROM kinds
), marked AS (SELECT leaf, norm, place, CASE WHEN sum(n_docs) OVER (PARTITION BY leaf, place, word) >= 10 THEN word ELSE '<*>' END AS word FROM fields
), parsed AS (
  SELECT leaf, norm, string_agg(word, ' ' ORDER BY place) AS template FROM marked GROUP BY leaf, norm
  HAVING count(*) FILTER (word <> '<*>') >= 0.5 * count(*)
), found AS (SELECT doc, content, pos, leaf, template FROM keyed JOIN parsed USING (leaf, norm)
), often AS (SELECT leaf, template FROM found GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), gone AS (SELECT DISTINCT doc, content, pos FROM found JOIN often USING (leaf, template)
), every_line AS (
  SELECT doc, content, pos, line, (doc, content, pos) IN (SELECT (doc, content, pos) FROM gone) AS dropped FROM (SELECT DISTINCT * FROM lines)
), rebuilt AS (
  SELECT doc, content, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS text, count(*) FILTER (dropped) AS n_dropped,
         count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_lines FROM every_line GROUP BY doc, content
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text
FROM documents d LEFT JOIN rebuilt r ON coalesce(d.doc_id, 9223372036854775807) = r.doc AND md5(d.text) = r.content
"""
