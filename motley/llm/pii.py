r"""Operator 10, PII by bootstrapped contextual extraction (DataFrame functions only).

Base: for each kind the leftmost non-overlapping matches of its pattern, less
those that fail the kind's check.  ``(?:\G|(?<!...))`` only keeps the search
from starting again inside a run it has already tried, and loops are possessive,
so that a run of any length needs neither stack nor second tries; neither changes
a match.

Method: *occurrences* are words with a digit or @, numbers in the phone format,
and the values of labels (``name=value``, ``name: value``), trimmed of outer
punctuation.  Seeds are the base entities, values with a digit under a label of
``SEED_LABELS`` and keys of a published form (``SEED_FORMS``).  Each occurrence has
lexical patterns: its label, the two words before it, the words on both sides,
and for runs of letters and digits the alphabet with the length and the first
four characters with the length.  Patterns and values form a graph.  In each
round a pattern's confidence is the share of its values that are accepted, if
these are ``SUPPORT`` or more, and a value is accepted if it is a seed or its
score, one minus the product of (1 - confidence) over its patterns, is ``ACCEPT``
or more.  Accepted values only grow in number, and rounds go on until none is
added.  Occurrences of accepted values that are no base entities become spans of
the kind ``id``.

Only texts with a digit, @, = or : are kept for the search, all matches of a text
are numbered in a window of that text alone; values and patterns move as 64-bit
hashes.

Edge cases: null text is empty (no spans, the digest of the empty string); a
null doc_id and repeated rows are treated row by row; texts of any length are
searched whole, a run of a million digits or labels included; scores are rounded
to nine digits before they are compared, so the order of sums decides nothing; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
SUPPORT, ACCEPT, SHAPED = 3, 0.6, 8
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Labels of credentials, and key forms that their issuers publish.
SEED_LABELS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key", "secret_key", "auth_token", "access_token")
SEED_FORMS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,})$"
_OCCURRENCE = (
    r"\+[0-9][\x20().0-9-]+[0-9]"
    r"|(?:\G|(?<=[\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
    r"|(?:\G|(?<=[\x20\x09-\x0D]))[^\x20\x09-\x0DA-Za-z0-9]*+[A-Za-z][A-Za-z_.-]*+[=:](?!//)[^\x20\x09-\x0D]++"
    r"|(?<=[=:][\x20\x09-\x0D])[^\x20\x09-\x0D]++"
)
#: What precedes the value in an occurrence: punctuation, and perhaps a label.
_LEAD = r"^(?:[^A-Za-z0-9+]*+[A-Za-z][A-Za-z0-9_.-]*(?:=|:(?!//)))?[^A-Za-z0-9+]*+"
_TAIL = r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++\z"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""

    def add(total: Column, k: Column) -> Column:
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """The check of a match of ``kind``."""
    n = F.length(_digits(value))
    small = F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255))
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", n.between(16, 19) & F.when(n.between(16, 19), luhn(_digits(value))).otherwise(False)).when(kind == "phone", n.between(8, 15)).otherwise(False)


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(gap: Column, count: int) -> Column:
    """The last (count < 0) or first words of a gap between matches, in lower case."""
    near = F.substring_index(F.translate(gap, "\t\n\x0b\x0c\r", "     "), " ", 2 * count)
    return F.filter(F.split(F.lower(near), " "), lambda w: w != "")


def _matches(text: Column, pattern: str, context: bool) -> Column:
    """array<struct<i, value, gap[, before, after]>>: matches in order with the length of the text between them and the words beside them."""

    def build(s: Column) -> Column:
        m, g = s["m"], s["g"]

        def one(i: Column) -> Column:
            gap, value = F.get(g, i), F.get(m, i)
            more = [_words(gap, -3).alias("before"), _words(F.get(g, i + 1), 2).alias("after")] if context else []
            return F.struct(i.alias("i"), value.alias("value"), F.length(gap).alias("gap"), *more)

        return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0))), one), lambda x: x["value"].isNotNull())

    return _bind(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), build)


def _placed(found: DataFrame, *by: str) -> DataFrame:
    """Adds start and end in code points."""
    line = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(line)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def base_spans(texts: DataFrame) -> DataFrame:
    """(row, text) to (row, kind, start, end, value)."""

    def of(kind: str) -> Column:
        worth = F.col("text").contains("@") if kind == "email" else F.col("text").rlike("[0-9]")
        found = F.when(worth, _matches(F.col("text"), PATTERNS[kind], False))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["i"].alias("i"), x["value"].alias("value"), x["gap"].alias("gap")))

    none = F.array().cast("array<struct<kind:string,i:int,value:string,gap:int>>")
    found = texts.select("row", F.explode(F.concat(*[F.coalesce(of(k), none) for k in KINDS])).alias("x")).select("row", "x.*")
    return _placed(found, "row", "kind").where(valid(F.col("kind"), F.col("value"))).select("row", "kind", "start", "end", "value")


def _shapes(value: Column) -> list[Column]:
    """Patterns of the value itself, for runs of letters and digits with both."""
    size = F.length("value").cast("string")
    alphabet = F.when(value.rlike("^[0-9a-f]+$"), "hex").when(value.rlike("^[0-9A-F]+$"), "HEX").when(value.rlike("^[0-9a-z]+$"), "az").when(value.rlike("^[0-9A-Z]+$"), "AZ").otherwise("Az")
    fits = (F.length(value) >= SHAPED) & value.rlike("^[0-9A-Za-z]+$") & value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    return [F.when(fits, F.concat_ws(":", F.lit("alphabet"), alphabet, size)), F.when(fits, F.concat_ws(":", F.lit("head"), F.substring(value, 1, 4), size))]


def occurrences(texts: DataFrame) -> DataFrame:
    """(row, text) to (row, start, end, value, base, seed, patterns): identifier-like words; value and patterns as hashes."""
    found = texts.select("row", F.explode(_matches(F.col("text"), _OCCURRENCE, True)).alias("x")).select("row", "x.*")
    # the match before this one is its left context where nothing but a gap of white space parts them
    previous = F.lag("value").over(Window.partitionBy("row").orderBy("i"))
    placed = _placed(found.withColumn("previous", F.lower(F.coalesce(previous, F.lit("")))), "row")
    before = F.concat(F.array("previous"), F.col("before"))
    lead = F.regexp_extract("value", _LEAD, 0)
    placed = placed.withColumn("before", F.filter(before, lambda w: w != "")).withColumn("lead", lead)
    placed = placed.withColumn("start", F.col("start") + F.length("lead")).withColumn("value", F.regexp_replace(F.expr("substring(value, length(lead) + 1)"), _TAIL, ""))
    placed = placed.where("value <> ''").withColumn("end", F.col("start") + F.length("value"))
    last, second, first = F.try_element_at("before", F.lit(-1)), F.try_element_at("before", F.lit(-2)), F.get("after", F.lit(0))
    inner = F.regexp_extract("lead", r"([A-Za-z][A-Za-z0-9_.-]*)[=:]", 1)
    outer = F.when(last.isin("=", ":"), second).when(last.rlike("[=:]$"), F.expr("left(try_element_at(before, -1), length(try_element_at(before, -1)) - 1)"))
    label = F.lower(F.when(inner != "", inner).otherwise(outer))
    whole = lambda k: F.col("value").rlike(f"^(?:{PATTERNS[k][PATTERNS[k].index('))') + 2 :] if PATTERNS[k].startswith('(?:') else PATTERNS[k]})$") & valid(F.lit(k), F.col("value"))
    placed = placed.withColumn("base", whole("email") | whole("ip") | whole("card") | whole("phone")).withColumn("label", F.coalesce(label, F.lit("")))
    named = F.col("label").isin(*SEED_LABELS) & F.col("value").rlike("[0-9]") & (F.length("value") >= 6)
    seed = F.col("base") | named | F.col("value").rlike(SEED_FORMS)
    marked = F.col("value").rlike("[0-9@]")  # others are believed for their label alone
    patterns = F.array(
        F.when(F.col("label") != "", F.concat_ws(":", F.lit("label"), "label")), F.when(marked & (F.size("before") >= 2), F.concat_ws(" ", F.lit("before"), second, last)),
        F.when(marked & last.isNotNull() & first.isNotNull(), F.concat_ws(" ", F.lit("between"), last, F.lit("_"), first)), *_shapes(F.col("value")),
    )
    hashed = F.transform(F.filter(patterns, lambda p: p.isNotNull()), lambda p: F.xxhash64(p))
    return placed.select("row", "start", "end", F.xxhash64("value").alias("value"), "base", seed.alias("seed"), hashed.alias("patterns"))


def scores(found: DataFrame, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """The values that the pattern-instance graph accepts: (value), seeds included."""
    edges = written(found.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("value", "pattern").agg(F.max("seed").alias("seed")), "graph")
    accepted = written(found.where("seed").select("value").distinct(), "accepted")
    count = accepted.count()
    while True:
        state = edges.join(accepted.select(F.col("value").alias("v")), F.col("value") == F.col("v"), "left").select("value", "pattern", F.col("v").isNotNull().alias("sure"))
        confidence = state.groupBy(F.col("pattern").alias("p")).agg(F.count_if("sure").alias("n"), F.count(F.lit(1)).alias("of")).where(F.col("n") >= support).select("p", (F.col("n") / F.col("of")).alias("confidence"))
        reached = state.where("NOT sure").join(confidence, F.col("pattern") == F.col("p"))
        doubt = reached.groupBy("value").agg(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))).alias("doubt"))
        fresh = doubt.where(F.round(1 - F.exp("doubt"), 9) >= accept).select("value")
        accepted = written(accepted.union(fresh), "accepted")
        before, count = count, accepted.count()
        if count == before:
            return accepted


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and n_added, the spans beside the base ones, and flagged, whether there is any span)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    some = F.col("text").rlike("[0-9@=:]")
    texts = written(rows.where(some).withColumn("row", F.monotonically_increasing_id()), "texts")
    base = written(base_spans(texts), "base")
    found = written(occurrences(texts), "occurrences")
    good = scores(found).select(F.col("value").alias("v"))
    fresh = found.where("NOT base").join(good, F.col("value") == F.col("v"), "left_semi")
    spans = base.select("row", "kind", "start", "end").unionByName(fresh.select("row", F.lit("id").alias("kind"), "start", "end"))
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "id")]), F.col("kind"))
    grouped = spans.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind"))).alias("s"))
    joined = texts.select("row", "doc_id").join(grouped, F.col("row") == F.col("of"), "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string>>")))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    with_spans = joined.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(text(F.filter("s", lambda x: x["kind"] != "id")), 256).alias("base_sha256"), text(F.col("s")).alias("spans"), count("id").alias("n_added"), (F.size("s") > 0).alias("flagged"))
    zero = F.lit(0).cast("long")
    without = rows.where(~some).select("doc_id", *[zero.alias(f"n_{k}") for k in KINDS], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_added"), F.lit(False).alias("flagged"))
    return with_spans.unionByName(without)
