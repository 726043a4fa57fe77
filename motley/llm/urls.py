"""Operator 13, URL filter by rules and a character language-model ratio (DataFrame functions only).

The host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or end (A-Z lower-cased), the path from there to
``?``, ``#`` or end.  A rule's host fits itself and its subdomains, its path every path that starts with it; the longest
rule wins (of equal length: the one with the longer host).

Where no rule fits, two variable-order Markov models decide, one of accepted and one of rejected URLs.  By default these
are the different URLs that the rules decide; ``labels`` adds others.  A URL is its host and path between a start and an
end mark.  Every position counts the longest gram (up to ``ORDER`` characters and the next one); the grams of lower orders
are summed from these, so a URL of n characters makes n rows.  The probability of a character backs off from the longest
context that a model has seen, by Witten-Bell weights, down to ``1 / ALPHABET``.  Each different gram of all URLs gets its
log ratio, in whole millionths so that sums are exact in any order; a URL's score is their mean.  The threshold is the
one that best separates the labelled URLs of a quarter of the hosts, which the models have not seen; where that quarter
lacks a class it is 0.  Scores at or above it are allowed.

Edge cases: null URLs and ones without ``://`` have an empty host and path, no rule, a score of 0 and are allowed; a URL
without a path after the host has the path '', which a rule's ``/`` does not fit; models without any labelled URL give
scores of 0; URLs of any length are scored whole, in pieces of ``PIECE`` characters; repeated rows and ids give a row
each and equal verdicts, but count once in the models; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.llm.shared import written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER, ALPHABET, PIECE, UNIT = 4, 256, 64, 1_000_000
HELD_OUT = "4"  # first hex digit of a host's md5 below it: calibration
BROADCAST_GRAMS = 1 << 20  # rows of at most some 40 bytes
SALTS = 16
_BEGIN, _END = "\x02", "\x03"


def split(df: DataFrame, url: Column, *keep: Column) -> DataFrame:
    """``keep`` and the host and path of ``url``, both empty if it is null or has no ``://``."""
    marked = df.select(F.struct(*keep).alias("kept"), url.cast("string").alias("url")).withColumn("mark", F.instr("url", "://"))
    rest = marked.select("kept", F.when(F.col("mark") > 0, F.substr("url", F.col("mark") + 3)).otherwise("").alias("rest"))
    cut = rest.select("kept", F.regexp_extract("rest", r"^[^/?#]*+", 0).alias("host"), "rest")
    path = F.regexp_extract(F.substr("rest", F.length("host") + 1), r"^[^?#]*+", 0)
    return cut.select("kept.*", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


def _fit(rules) -> Column:
    """The (rule, verdict) that fits ``host`` and ``path``, as a struct, or null."""
    made = [(verdict, rule, rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]) for verdict, rule in rules]
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule, host, path in sorted(made, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row of ``keep`` and the longest gram for every character of ``host`` and ``path`` and the end mark."""
    text = F.concat(F.lit(_BEGIN), "host", "path", F.lit(_END))
    pieces = urls.where("host <> '' OR path <> ''").select(*keep, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    before = F.when(F.col("at") > 0, F.right(F.get("pieces", F.col("at") - 1), F.lit(ORDER))).otherwise("")
    pieces = pieces.select(*keep, "pieces", F.explode(F.sequence(F.lit(0), F.size("pieces") - 1)).alias("at")).select(*keep, before.alias("before"), F.get("pieces", "at").alias("piece"))
    # The start mark is context only, so the first piece begins with its second character.
    body = pieces.select(*keep, F.concat("before", "piece").alias("body"), F.when(F.col("before") == "", 2).otherwise(F.length("before") + 1).alias("from"))
    each = body.where(F.col("from") <= F.length("body")).select(*keep, "body", F.explode(F.sequence("from", F.length("body"))).alias("end"))
    return each.select(*keep, F.substr("body", F.greatest(F.lit(1), F.col("end") - ORDER), F.least(F.col("end"), F.lit(ORDER + 1))).alias("gram"))


def _suffixes(gram: Column) -> Column:
    """All endings of a gram, shortest first: the same character after contexts of 0, 1, ... characters."""
    return F.transform(F.sequence(F.lit(1), F.length(gram)), lambda k: F.right(gram, k))


def log_ratios(longest: DataFrame) -> DataFrame:
    """(gram, ratio): millionths of ln P_accepted - ln P_rejected for the rows (gram, acc, rej) of longest grams and counts."""
    counts = longest.where("acc + rej > 0").select("acc", "rej", F.explode(_suffixes(F.col("gram"))).alias("gram")).groupBy("gram").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    counts = written(counts, "url-grams")
    context = F.expr("left(gram, length(gram) - 1)")
    seen = lambda c: F.count(F.when(F.col(c) > 0, 1))
    contexts = counts.groupBy(context.alias("of")).agg(F.sum("acc").alias("acc_all"), F.sum("rej").alias("rej_all"), seen("acc").alias("acc_kinds"), seen("rej").alias("rej_kinds"))
    contexts = written(contexts, "url-contexts")
    asked = longest.select("gram", F.explode(_suffixes(F.col("gram"))).alias("part")).withColumn("context", F.expr("left(part, length(part) - 1)"))
    # Shorter parts repeat: both lookups are made once for each different part, then parts meet their grams.
    parts_ = asked.select("part", "context").distinct()
    known = parts_.join(counts.withColumnRenamed("gram", "part"), "part", "left").join(contexts.withColumnRenamed("of", "context"), "context", "left").na.fill(0)
    known = written(known.select("part", *[F.col(c).cast("double").alias(c) for c in ("acc", "rej", "acc_all", "rej_all", "acc_kinds", "rej_kinds")]), "url-parts")
    step = F.struct(F.length("part").alias("k"), *[F.col(c) for c in ("acc", "rej", "acc_all", "rej_all", "acc_kinds", "rej_kinds")])
    steps = asked.select("gram", "part").join(known, "part").groupBy("gram").agg(F.sort_array(F.collect_list(step)).alias("steps"))

    def chance(name: str) -> Column:
        def backed(p: Column, s: Column) -> Column:
            n, total, kinds = s[name], s[f"{name}_all"], s[f"{name}_kinds"]
            return F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p)

        return F.aggregate("steps", F.lit(1.0 / ALPHABET), backed)

    return steps.select("gram", F.round((F.log(chance("acc")) - F.log(chance("rej"))) * UNIT).cast("long").alias("ratio"))


def _sums(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(key, score): the rounded mean of the ratios of a URL's grams."""
    grams = _grams(urls, "key")
    if ratios.count() <= BROADCAST_GRAMS:
        met = grams.join(F.broadcast(ratios), "gram")
    else:  # frequent grams are spread over salts
        salted = ratios.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        met = grams.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    return met.groupBy("key").agg(F.floor(F.sum("ratio") / F.count("*")).alias("score"))


def calibrated(scored: DataFrame) -> DataFrame:
    """One row (threshold) for the rows (score, accepted): the bin border of 0.01 with the largest share of accepted at or
    above it plus share of rejected below it; the least distance from 0, then the smaller, on ties; 0 if a class is missing."""
    bin_ = F.floor(F.col("score") / (UNIT // 100))
    bins = scored.groupBy(bin_.alias("bin")).agg(F.count(F.when(F.col("accepted"), 1)).alias("acc"), F.count(F.when(~F.col("accepted"), 1)).alias("rej"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # bins lie between ln of the probabilities' bounds: some thousand rows
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("bin")
    cut = bins.select("bin", F.sum("acc").over(whole).alias("n_acc"), F.sum("rej").over(whole).alias("n_rej"), F.coalesce(F.sum("acc").over(below), F.lit(0)).alias("acc"), F.coalesce(F.sum("rej").over(below), F.lit(0)).alias("rej"))
    # Compared as whole numbers: (1 - acc / n_acc) + rej / n_rej grows with rej * n_acc - acc * n_rej.
    whole_ = lambda c: F.col(c).cast("decimal(19,0)")
    gain = whole_("rej") * whole_("n_acc") - whole_("acc") * whole_("n_rej")
    best = cut.where("n_acc > 0 AND n_rej > 0").agg(F.max(F.struct(gain.alias("gain"), (-F.abs("bin")).alias("near"), (-F.col("bin")).alias("small"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.small") * (UNIT // 100), F.lit(0)).alias("threshold"))


def scores(urls: DataFrame) -> tuple[DataFrame, int]:
    """For different URLs (key, host, path, accepted or null): (key, score) and the threshold."""
    held = F.substring(F.md5("host"), 1, 1) < HELD_OUT
    fit = lambda wanted: F.count(F.when((F.col("accepted") == wanted) & ~F.col("held"), 1))
    longest = _grams(urls.withColumn("held", held), "accepted", "held").groupBy("gram").agg(fit(True).alias("acc"), fit(False).alias("rej"))
    ratios = written(log_ratios(written(longest, "url-longest")), "url-ratios")
    found = written(_sums(urls, ratios), "url-scores")
    labelled = urls.where(F.col("accepted").isNotNull() & held).select("key", "accepted").join(found, "key")
    return found, calibrated(labelled).first()["threshold"]


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides).  ``labels``: rows (url, accepted) that the models learn besides the URLs that rules decide."""
    rows = split(pages, F.col(url_col), F.col(id_col).alias("page_id"))
    rows = written(rows.withColumn("fit", _fit(rules)), "urls")
    key = F.sha2(F.concat("host", F.lit(_BEGIN), "path"), 256)
    learnt = rows.select("host", "path", (F.col("fit.verdict") == "allow").alias("accepted"))
    if labels is not None:
        learnt = learnt.union(split(labels, F.col("url"), F.col("accepted")).select("host", "path", "accepted"))
    # A URL labelled both ways counts as rejected.
    urls = written(learnt.groupBy("host", "path").agg(F.min("accepted").alias("accepted")).withColumn("key", key), "url-distinct")
    found, threshold = scores(urls)
    open_ = rows.where("fit IS NULL").withColumn("key", key).join(found, "key", "left")
    allowed = F.col("score").isNull() | (F.col("score") >= threshold)
    open_ = open_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict"), F.coalesce("score", F.lit(0).cast("long")).alias("score"))
    ruled = rows.where("fit IS NOT NULL").select("page_id", "host", "path", "fit.rule", "fit.verdict", F.lit(None).cast("long").alias("score"))
    return ruled.union(open_)


def _oracle(rules=RULES) -> str:
    made = sorted(((v, r, r.split("/", 1)[0], "/" + r.split("/", 1)[1]) for v, r in rules), key=lambda r: (-len(r[1]), -len(r[2])))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v, r) for v, r, h, p in made]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    levels = range(1, ORDER + 2)
    joins = " ".join(f"LEFT JOIN c c{k} ON length(g.gram) >= {k} AND c{k}.part = right(g.gram, {k}) LEFT JOIN x x{k} ON length(g.gram) >= {k} AND x{k}.context = left(right(g.gram, {k}), {k} - 1)" for k in levels)

    def chance(name: str):
        before = f"CAST(1.0 AS DOUBLE) / {ALPHABET}"
        for k in levels:
            total, kinds = f"x{k}.{name}_all", f"x{k}.{name}_kinds"
            yield f"CASE WHEN {total} > 0 THEN (coalesce(c{k}.{name}, 0) + {kinds} * ({before})) / CAST({total} + {kinds} AS DOUBLE) ELSE {before} END AS p{k}_{name}"
            before = f"p{k}_{name}"

    chances = ", ".join(f"{a}, {b}" for a, b in zip(chance("acc"), chance("rej"), strict=True))
    last = ORDER + 1
    return f"""
WITH s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM s),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {case(2)} AS rule, {case(1)} AS ruled FROM u),
d AS (SELECT host, path, bool_and(ruled = 'allow') AS accepted, substr(md5(host), 1, 1) < '{HELD_OUT}' AS held FROM r WHERE host <> '' OR path <> '' GROUP BY host, path),
t AS (SELECT host, path, accepted, held, chr(2) || host || path || chr(3) AS body FROM d),
e AS (SELECT host, path, accepted, held, substr(body, greatest(1, i - {ORDER}), least(i, {ORDER + 1})) AS gram FROM (SELECT *, unnest(range(2, length(body) + 1)) AS i FROM t)),
g AS (SELECT gram, count(*) FILTER (accepted AND NOT held) AS acc, count(*) FILTER (NOT accepted AND NOT held) AS rej FROM e GROUP BY gram),
c AS (SELECT right(gram, k) AS part, sum(acc)::BIGINT AS acc, sum(rej)::BIGINT AS rej FROM (SELECT *, unnest(range(1, length(gram) + 1)) AS k FROM g WHERE acc + rej > 0) GROUP BY 1),
x AS (SELECT left(part, length(part) - 1) AS context, sum(acc)::BIGINT AS acc_all, sum(rej)::BIGINT AS rej_all, count(*) FILTER (acc > 0) AS acc_kinds, count(*) FILTER (rej > 0) AS rej_kinds FROM c GROUP BY 1),
l AS (SELECT g.gram, {chances} FROM g {joins}),
q AS (SELECT gram, round((ln(p{last}_acc) - ln(p{last}_rej)) * {UNIT})::BIGINT AS ratio FROM l),
z AS (SELECT e.host, e.path, any_value(e.accepted) AS accepted, any_value(e.held) AS held, floor(sum(q.ratio) / count(*))::BIGINT AS score FROM e JOIN q ON e.gram = q.gram GROUP BY e.host, e.path),
b AS (SELECT floor(score / {UNIT // 100})::BIGINT AS bin, count(*) FILTER (accepted) AS acc, count(*) FILTER (NOT accepted) AS rej FROM z WHERE held AND accepted IS NOT NULL GROUP BY 1),
w AS (SELECT bin, sum(acc) OVER () AS n_acc, sum(rej) OVER () AS n_rej, coalesce(sum(acc) OVER p, 0) AS acc, coalesce(sum(rej) OVER p, 0) AS rej FROM b WINDOW p AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT bin * {UNIT // 100} AS threshold FROM w WHERE n_acc > 0 AND n_rej > 0 ORDER BY rej * n_acc - acc * n_rej DESC, abs(bin), bin LIMIT 1)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN z.score IS NULL OR z.score >= coalesce((SELECT threshold FROM y), 0) THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN r.rule IS NULL THEN coalesce(z.score, 0) END AS score
FROM r LEFT JOIN z ON r.host = z.host AND r.path = z.path"""


ORACLE = _oracle()
