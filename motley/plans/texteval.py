"""Queries of texts against references and each other, and of searches and statistics over generations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from motley.operators import lexical as lx
from motley.operators import texteval as tx
from motley.operators.query import Query
from motley.plans.common import Registry, docs, read
from motley.plans.evaluate import PAIRS, _pairs
from motley.plans.text import ENTROPY, T, _texts, count_sql, gram_sql

R = Registry()


def _rounded(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _grams(column: str, name: str, max_n: int) -> str:
    """SELECT (id, n, gram, name) over ``pairs``."""
    tokens = T["space"].replace("text", column)
    parts = [f"SELECT id, {n} AS n, unnest({'t' if n == 1 else f'list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], chr(32)))'}) AS gram FROM (SELECT id, {tokens} AS t FROM pairs)" for n in range(1, max_n + 1)]
    return f"SELECT id, n, gram, count(*) AS {name} FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


_SIZES = f"z AS (SELECT id, len({T['space']}) AS nh, len({T['space'].replace('text', 'reference')}) AS nr FROM pairs)"


@R.add(
    "bleu_brevity",
    f"""WITH {PAIRS}, h AS ({_grams("text", "h", 4)}), r AS ({_grams("reference", "r", 4)}), {_SIZES}, p AS (SELECT id, n, sum(least(h, coalesce(r, 0))) / sum(h) AS p FROM h LEFT JOIN r USING (id, n, gram) GROUP BY id, n),
    s AS (SELECT id, min(p) AS low, avg(ln(CASE WHEN p > 0 THEN p END)) AS m FROM p GROUP BY id) SELECT id, round(CASE WHEN low > 0 THEN CASE WHEN nh < nr THEN exp(1 - nr / greatest(nh, 1)) ELSE 1 END * exp(m) ELSE 0 END, 6) AS bleu FROM z LEFT JOIN s USING (id)""",
)
def bleu_brevity(spark, sf_dir):
    return _rounded(tx.bleu_with_brevity(_pairs(spark, sf_dir)))


@R.add(
    "cider",
    f"""WITH {PAIRS}, h AS ({_grams("text", "c", 4)}), r AS ({_grams("reference", "c", 4)}), {_SIZES}, d AS (SELECT n, gram, count(*) AS df FROM r GROUP BY ALL), k AS (SELECT count(*) AS k FROM pairs),
    x AS (SELECT id, n, gram, c / sum(c) OVER (PARTITION BY id, n) * ln(greatest(k / (1.0 + coalesce(df, 0)), 1.0)) AS x FROM h LEFT JOIN d USING (n, gram), k), y AS (SELECT id, n, gram, c / sum(c) OVER (PARTITION BY id, n) * ln(greatest(k / (1.0 + coalesce(df, 0)), 1.0)) AS y FROM r LEFT JOIN d USING (n, gram), k),
    dots AS (SELECT id, n, sum(x * y) AS dot FROM x JOIN y USING (id, n, gram) GROUP BY ALL), nx AS (SELECT id, n, sqrt(sum(x * x)) AS nx FROM x GROUP BY ALL), ny AS (SELECT id, n, sqrt(sum(y * y)) AS ny FROM y GROUP BY ALL)
    SELECT id, n, round(CASE WHEN nx > 0 AND ny > 0 THEN coalesce(dot, 0) / (nx * ny) ELSE 0 END * exp(-((nh - nr) ** 2) / 72.0), 6) AS cider FROM (SELECT * FROM z, range(1, 5) g(n)) LEFT JOIN dots USING (id, n) LEFT JOIN nx USING (id, n) LEFT JOIN ny USING (id, n)""",
)
def cider(spark, sf_dir):
    return _rounded(tx.cider(_pairs(spark, sf_dir)))


@R.add(
    "reference_coverage",
    f"""WITH {PAIRS}, h AS ({_grams("text", "h", 2)}), r AS ({_grams("reference", "r", 2)}), m AS (SELECT n, gram, sum(h) AS h FROM h GROUP BY ALL), t AS (SELECT DISTINCT n, gram FROM r),
    c AS (SELECT count(*) AS n_grams, count(h) AS n_covered FROM t LEFT JOIN m USING (n, gram)), v AS (SELECT count(*) / sum(h) AS variety FROM m) SELECT n_grams, n_covered, round(n_covered / n_grams, 6) AS coverage, round(variety, 6) AS variety FROM c, v""",
)
def reference_coverage(spark, sf_dir):
    return _rounded(tx.reference_coverage(_pairs(spark, sf_dir)))


_SETS = f"s AS (SELECT item_id % 10 AS g, item_id AS id, list_distinct({T['word']}) AS x FROM benchmark)"


def _items(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select((F.col("item_id") % 10).alias("g"), F.col("item_id").alias("id"), "text")


@R.add("set_similarities", f"WITH {_SETS} SELECT a.g, round(avg(len(list_intersect(a.x, b.x)) / greatest(least(len(a.x), len(b.x)), 1)), 6) AS overlap, round(avg(2 * len(list_intersect(a.x, b.x)) / greatest(len(a.x) + len(b.x), 1)), 6) AS dice FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.g")
def set_similarities(spark, sf_dir):
    return _rounded(tx.set_similarities(_items(spark, sf_dir)))


@R.add(
    "expected_utility",
    f"""WITH {_SETS}, u AS (SELECT a.g, a.id, round(avg(len(list_intersect(a.x, b.x)) / greatest(len(a.x) + len(b.x) - len(list_intersect(a.x, b.x)), 1)), 9) AS u FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL)
    SELECT g, id, round(u, 6) AS utility, row_number() OVER (PARTITION BY g ORDER BY u DESC, id) AS rank FROM u""",
)
def expected_utility(spark, sf_dir):
    return _rounded(tx.expected_utility(_items(spark, sf_dir)))


@R.add(
    "homogenisation_alert",
    f"""WITH c AS ({count_sql(2, "space")}), d AS (SELECT g, count(*) / sum(c) AS d FROM c GROUP BY g), b AS (SELECT DISTINCT * FROM ({gram_sql(2, "space", "g, id")})), f AS (SELECT *, count(*) OVER (PARTITION BY g, gram) AS df FROM b),
    n AS (SELECT g, avg(v) AS n FROM (SELECT g, id, count(*) FILTER (df = 1) / count(*) AS v FROM f GROUP BY g, id) GROUP BY g),
    t AS (SELECT g, id, gram, c / sum(c) OVER (PARTITION BY g, id) AS tf, count(*) OVER (PARTITION BY g, gram) AS df FROM ({count_sql(1, "space", "g, id")})), k AS (SELECT source AS g, count(*) AS k FROM documents GROUP BY 1),
    w AS (SELECT g, id, gram, tf * ln(k / df) AS w FROM t JOIN k USING (g)), v AS (SELECT g, id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY g, id)) AS v FROM w QUALIFY sum(w * w) OVER (PARTITION BY g, id) > 0),
    q AS (SELECT g, sum(s * s) AS q FROM (SELECT g, gram, sum(v) AS s FROM v GROUP BY ALL) GROUP BY g), m AS (SELECT g, count(DISTINCT id) AS m FROM v GROUP BY g),
    e AS (SELECT g, CASE WHEN k < 2 THEN 0 ELSE 1 - (coalesce(q, 0) - coalesce(m, 0)) / (k * (k - 1.0)) END AS e FROM k LEFT JOIN q USING (g) LEFT JOIN m USING (g))
    SELECT g, round(d, 6) AS distinct_2, round(n, 6) AS novelty, round(e, 6) AS semantic, (d < 0.3)::INT + (n < 0.3)::INT + (e < 0.3)::INT >= 2 AS alert FROM d JOIN n USING (g) JOIN e USING (g)""",
)
def homogenisation_alert(spark, sf_dir):
    return _rounded(tx.homogenisation(_texts(spark, sf_dir)))


@R.add("search_generations", "SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%tion%' AND lang IN ('en', 'de') AND n_chars BETWEEN 500 AND 5000 AND source <> 'src0' ORDER BY n_chars DESC, doc_id LIMIT 50")
def search_generations(spark, sf_dir):
    q = Query(spark).table(docs(spark, sf_dir)).where("text", "LIKE", "%tion%").where("lang", "IN", ["en", "de"]).where("n_chars", "BETWEEN", (500, 5000)).where("source", "!=", "src0")
    return q.select("doc_id", "lang", "source", "n_chars").order_by("n_chars", "DESC").order_by("doc_id").limit(50).build().select("doc_id", "lang", "source")


@R.add(
    "generation_statistics",
    f"SELECT source AS g, count(*) AS n, count(DISTINCT md5(text)) AS n_texts, round(avg(length(text)), 4) AS mean_chars, min(len({T['space']})) AS least_words, max(len({T['space']})) AS most_words, round(avg(len({T['space']})), 4) AS mean_words, count(*) FILTER (trim(text) = '') AS n_empty FROM documents GROUP BY 1",
)
def generation_statistics(spark, sf_dir):
    w = F.size(F.split(F.lower("text"), r"(?U)\s+")).cast("long")
    words = F.when(F.col("text").rlike(r"(?U)^\s"), w - 1).otherwise(w)
    words = F.when(F.col("text").rlike(r"(?U)\s$"), words - 1).otherwise(words)
    words = F.when(F.col("text").rlike(r"(?U)^\s*$"), 0).otherwise(words)
    d = docs(spark, sf_dir).select(F.col("source").alias("g"), "text", words.alias("w"))
    return d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.md5("text")).alias("n_texts"), F.round(F.avg(F.char_length("text")), 4).alias("mean_chars"), F.min("w").alias("least_words"), F.max("w").alias("most_words"), F.round(F.avg("w"), 4).alias("mean_words"), F.count_if(F.trim("text") == "").alias("n_empty"))


def _f(beta2: str = "1") -> str:
    return f"CASE WHEN p + q > 0 THEN (1 + {beta2}) * p * q / ({beta2} * p + q) ELSE 0 END"


def _bag_sql(bag) -> str:
    """h, r and m (id, n, k, h, r) from ``bag(column)``, SELECT (id, n, x)."""
    side = lambda c, name: f"{name} AS (SELECT id, n, x, count(*) AS {name} FROM ({bag(c)}) GROUP BY ALL)"
    return f"{side('text', 'h')}, {side('reference', 'r')}, m AS (SELECT id, n, sum(least(coalesce(h, 0), coalesce(r, 0))) AS k, coalesce(sum(h), 0) AS h, coalesce(sum(r), 0) AS r FROM h FULL JOIN r USING (id, n, x) GROUP BY ALL)"


_CHARS = r"regexp_extract_all(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '(?s).')"


def _char_bag(c: str) -> str:
    leads = ", ".join(f"lead(c, {k}) OVER w AS c{k}" for k in range(1, 6))
    grams = " UNION ALL ".join(f"SELECT id, {n} AS n, concat({', '.join(['c', *[f'c{k}' for k in range(1, n)]])}) AS x FROM l WHERE i + {n - 1} <= size OR (i = 1 AND size < {n})" for n in range(1, 7))
    return f"WITH t AS (SELECT id, {_CHARS.format(c=c)} AS t FROM pairs), u AS (SELECT id, len(t) AS size, unnest(t) AS c, unnest(range(1, len(t) + 1)) AS i FROM t), l AS (SELECT *, {leads} FROM u WINDOW w AS (PARTITION BY id ORDER BY i)) {grams}"


@R.add("chrf", f"WITH {PAIRS}, {_bag_sql(_char_bag)}, s AS (SELECT id, avg(k / h) AS p, avg(k / r) AS q FROM m WHERE h > 0 AND r > 0 GROUP BY id) SELECT id, round(coalesce({_f('4')}, 0), 6) AS chrf FROM pairs LEFT JOIN s USING (id)")
def chrf(spark, sf_dir):
    return _rounded(tx.chrf(_pairs(spark, sf_dir)))


@R.add(
    "rouge_s",
    "WITH " + PAIRS + ", " + _bag_sql(lambda c: f"SELECT id, 0 AS n, unnest(list_transform(range(1, len(t) - d + 1), lambda i: t[i] || ' ' || t[i + d])) AS x FROM (SELECT id, {T['spaced'].replace('text', c)} AS t FROM pairs), range(1, 6) g(d) WHERE len(t) > d")
    + f", s AS (SELECT id, CASE WHEN h > 0 THEN k / h ELSE 0 END AS p, CASE WHEN r > 0 THEN k / r ELSE 0 END AS q FROM m) SELECT id, round(coalesce(p, 0), 6) AS precision, round(coalesce(q, 0), 6) AS recall, round(coalesce({_f()}, 0), 6) AS f FROM pairs LEFT JOIN s USING (id)",
)
def rouge_s(spark, sf_dir):
    return _rounded(tx.rouge_s(_pairs(spark, sf_dir)))


_ANSWER = r"list_filter(string_split_regex(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"


@R.add(
    "answer_scores",
    "WITH " + PAIRS + ", " + _bag_sql(lambda c: f"SELECT id, 0 AS n, unnest({_ANSWER.format(c=c)}) AS x FROM pairs")
    + f", e AS (SELECT id, {_ANSWER.format(c='text')} = {_ANSWER.format(c='reference')} AS exact FROM pairs) SELECT id, exact, round(coalesce(2 * k / (h + r), exact::INT), 6) AS f FROM e LEFT JOIN m USING (id)",
)
def answer_scores(spark, sf_dir):
    return _rounded(tx.answer_scores(_pairs(spark, sf_dir)))


@R.add("alignment_scores")
def alignment_scores(spark, sf_dir):
    return _rounded(tx.alignment_scores(_pairs(spark, sf_dir)))


@R.add(
    "entropy_rate",
    "WITH " + ", ".join(f"e{n} AS (SELECT g, {n} AS n, {ENTROPY} AS e FROM ({count_sql(n, 'punct')}) GROUP BY g)" for n in range(1, 6))
    + ", e AS (" + " UNION ALL ".join(f"SELECT * FROM e{n}" for n in range(1, 6)) + ") SELECT g, n, round(e, 5) AS entropy, round(CASE WHEN n = 1 THEN e ELSE greatest(e - lag(e) OVER (PARTITION BY g ORDER BY n), 0) END, 5) AS rate FROM e",
)
def entropy_rate(spark, sf_dir):
    return _rounded(lx.entropy_rate(_texts(spark, sf_dir)), 5)
