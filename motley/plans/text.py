"""Text metric queries over ``documents``, grouped by source, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from motley.operators import lexical as lx
from motley.plans.common import Registry, docs

R = Registry()

#: DuckDB expressions of the tokenizers.
T = {
    "word": r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')",
    "space": r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')",
    "cased": r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')",
    "punct": r"list_filter(string_split_regex(regexp_replace(lower(text), '([!-/:-@\[-`{-~])', ' \1 ', 'g'), '\s+'), lambda x: x <> '')",
    "letter": r"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\s]', '', 'g'), '\s+'), lambda x: x <> '')",
    "alnum": "regexp_extract_all(lower(text), '[a-z0-9]+')",
    "spaced": r"list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+'), lambda x: x <> '')",
    "quality": r"regexp_extract_all(text, '[A-Za-z]+(?:''[a-z]+)?|[0-9]+(?:\.[0-9]+)?|[^\s]')",
    "placeholder": r"list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' \\1 ', 'g'), '\s+'), lambda x: x <> '')",
}


def gram_sql(n: int, tokenizer: str, keep: str = "g") -> str:
    """SELECT (keep, gram) with one row per occurrence."""
    cut = "unnest(t)" if n == 1 else f"unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' ')))"
    return f"SELECT {keep}, {cut} AS gram FROM (SELECT source AS g, doc_id AS id, {T[tokenizer]} AS t FROM documents)"


def count_sql(n: int, tokenizer: str, keep: str = "g") -> str:
    return f"SELECT {keep}, gram, count(*) AS c FROM ({gram_sql(n, tokenizer, keep)}) GROUP BY ALL"


ENTROPY = "log2(sum(c)) - sum(c * log2(c)) / sum(c)"


def _texts(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("source").alias("g"), F.col("doc_id").alias("id"), "text")


@R.add(
    "text_metrics_by_group",
    f"""WITH b AS ({count_sql(2, "word")}), u AS ({count_sql(1, "word")}),
    x AS (SELECT g, round(count(*) / sum(c), 6) AS distinct_2, round({ENTROPY}, 6) AS entropy_2 FROM b GROUP BY g),
    y AS (SELECT g, round(count(*) / sum(c), 6) AS ttr, sum(c)::BIGINT AS n_tokens FROM u GROUP BY g)
    SELECT g, distinct_2, entropy_2, ttr, n_tokens FROM x JOIN y USING (g)""",
)
def text_metrics_by_group(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    two = lx.hashed_counts(texts, 2, "word").groupBy("g").agg(F.round(F.count(F.lit(1)) / F.sum("c"), 6).alias("distinct_2"), F.round(lx._entropy(), 6).alias("entropy_2"))
    one = lx.hashed_counts(texts, 1, "word").groupBy("g").agg(F.round(F.count(F.lit(1)) / F.sum("c"), 6).alias("ttr"), F.sum("c").alias("n_tokens"))
    return two.join(one, "g")


for _n in (1, 2, 3):

    def _distinct(spark, sf_dir, n=_n):
        return lx.distinct_n(_texts(spark, sf_dir), n).withColumn("value", F.round("value", 6))

    R.add(f"distinct_{_n}", f"SELECT g, {_n}::BIGINT AS n, sum(c)::BIGINT AS n_grams, count(*) AS n_distinct, round(count(*) / sum(c), 6) AS value FROM ({count_sql(_n, 'punct')}) GROUP BY g")(_distinct)

for _t in ("word", "space", "letter", "alnum", "punct", "spaced", "quality", "placeholder", "cased"):

    def _ttr(spark, sf_dir, t=_t):
        return lx.type_token_ratio(_texts(spark, sf_dir), t).withColumn("value", F.round("value", 6))

    R.add(f"ttr_{_t}_tokens", f"SELECT g, round(count(*) / sum(c), 6) AS value FROM ({count_sql(1, _t)}) GROUP BY g")(_ttr)


@R.add("ngram_entropy", f"SELECT g, round({ENTROPY}, 6) AS entropy, count(*) AS support, sum(c)::BIGINT AS total FROM ({count_sql(2, 'punct')}) GROUP BY g")
def ngram_entropy(spark, sf_dir):
    return lx.ngram_entropy(_texts(spark, sf_dir), 2).withColumn("entropy", F.round("entropy", 6))


@R.add("conditional_entropy", f"SELECT g, round(greatest(a.h - b.h, 0), 6) AS value FROM (SELECT g, {ENTROPY} AS h FROM ({count_sql(3, 'punct')}) GROUP BY g) a JOIN (SELECT g, {ENTROPY} AS h FROM ({count_sql(2, 'punct')}) GROUP BY g) b USING (g)")
def conditional_entropy(spark, sf_dir):
    return lx.conditional_entropy(_texts(spark, sf_dir), 3).withColumn("value", F.round("value", 6))


@R.add(
    "corrected_entropy",
    f"""WITH c AS ({count_sql(1, "word")}), s AS (SELECT g, sum(c)::DOUBLE AS n, count(*) AS m, sum(c * log2(c)) AS s FROM c GROUP BY g),
    j AS (SELECT g, sum(c * (log2(n - 1) - (s - c * log2(c) + CASE WHEN c > 1 THEN (c - 1) * log2(c - 1) ELSE 0 END) / (n - 1))) AS held FROM c JOIN s USING (g) GROUP BY g)
    SELECT g, round(log2(n) - s / n, 6) AS mle, round(log2(n) - s / n + (m - 1) / (2 * n * ln(2)), 6) AS miller_madow,
           round(n * (log2(n) - s / n) - (n - 1) * held / n, 4) AS jackknife FROM s JOIN j USING (g)""",
)
def corrected_entropy(spark, sf_dir):
    return lx.corrected_entropy(_texts(spark, sf_dir), 1).select("g", F.round("mle", 6).alias("mle"), F.round("miller_madow", 6).alias("miller_madow"), F.round("jackknife", 4).alias("jackknife"))


@R.add(
    "kl_divergence",
    f"""WITH p AS (SELECT g, gram, c / sum(c) OVER (PARTITION BY g) AS p FROM ({count_sql(1, "word")})), o AS (SELECT DISTINCT g AS other FROM p)
    SELECT g, other, round(sum(p.p * log2((p.p + 1e-10) / (coalesce(q.p, 0) + 1e-10))), 5) AS kl
    FROM p JOIN o ON p.g <> o.other LEFT JOIN (SELECT g AS other, gram, p FROM p) q USING (other, gram) GROUP BY g, other""",
)
def kl_divergence(spark, sf_dir):
    return lx.divergence(_texts(spark, sf_dir)).withColumn("kl", F.round("kl", 5))


@R.add(
    "smoothed_kl",
    f"""WITH p AS ({count_sql(1, "word")}), q AS (SELECT gram, count(*) AS d FROM (SELECT unnest({T["word"]}) AS gram FROM benchmark) GROUP BY gram),
    e AS (SELECT g, gram FROM p UNION SELECT g, gram FROM (SELECT DISTINCT g FROM p), q),
    j AS (SELECT g, coalesce(c, 0)::DOUBLE AS c, coalesce(d, 0)::DOUBLE AS d FROM e LEFT JOIN p USING (g, gram) LEFT JOIN q USING (gram)),
    w AS (SELECT *, sum(c) OVER (PARTITION BY g) AS n, sum(d) OVER (PARTITION BY g) AS m, (count(*) OVER (PARTITION BY g))::DOUBLE AS v FROM j),
    b AS (SELECT *, (c + d) / (n + m) AS bg FROM w),
    f AS (SELECT g, (c + 1) / (n + v) AS a1, (d + 1) / (m + v) AS b1, 0.5 * c / n + 0.5 * bg AS a2, 0.5 * d / m + 0.5 * bg AS b2, (c + 1000 * bg) / (n + 1000) AS a3, (d + 1000 * bg) / (m + 1000) AS b3 FROM b)
    SELECT g, round(sum(a1 * log2(a1 / b1)), 5) AS laplace, round(sum(a2 * log2(a2 / b2)), 5) AS jelinek_mercer, round(sum(a3 * log2(a3 / b3)), 5) AS dirichlet FROM f GROUP BY g""",
)
def smoothed_kl(spark, sf_dir):
    out = lx.smoothed_kl(_texts(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return out.select("g", *[F.round(c, 5).alias(c) for c in ("laplace", "jelinek_mercer", "dirichlet")])


@R.add("unique_text_ratio", "SELECT source AS g, round(count(DISTINCT lower(trim(text))) / count(text), 6) AS value FROM documents GROUP BY 1")
def unique_text_ratio(spark, sf_dir):
    return lx.unique_text_ratio(_texts(spark, sf_dir)).withColumn("value", F.round("value", 6))


@R.add(
    "vocabulary_profile",
    f"""SELECT g, sum(c)::BIGINT AS n_tokens, count(*) AS n_types, round(count(*) FILTER (c = 1) / count(*), 6) AS hapax,
    round(1e4 * (sum(c::DOUBLE * c) - sum(c)) / (sum(c)::DOUBLE * sum(c)), 6) AS yule_k, round({ENTROPY}, 6) AS entropy FROM ({count_sql(1, "space")}) GROUP BY g""",
)
def vocabulary_profile(spark, sf_dir):
    return lx.vocabulary_profile(_texts(spark, sf_dir)).select("g", "n_tokens", "n_types", *[F.round(c, 6).alias(c) for c in ("hapax", "yule_k", "entropy")])


@R.add("top_words", f"SELECT g, gram AS word, c AS n, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, encode(gram)) AS rank FROM ({count_sql(1, 'space')})) WHERE rank <= 20")
def top_words(spark, sf_dir):
    return lx.top_words(_texts(spark, sf_dir))


@R.add(
    "self_bleu",
    "WITH "
    + ", ".join(
        f"""o{n} AS ({count_sql(n, "space", "g, id")}), r{n} AS (SELECT g, gram, c AS top, row_number() OVER (PARTITION BY g, gram ORDER BY c DESC, id) AS k, id FROM o{n}),
    m{n} AS (SELECT g, gram, max(top) FILTER (k = 1) AS first, max(id) FILTER (k = 1) AS holder, coalesce(max(top) FILTER (k = 2), 0) AS second FROM r{n} WHERE k <= 2 GROUP BY g, gram),
    p{n} AS (SELECT g, id, ln((sum(least(c, CASE WHEN id = holder THEN second ELSE first END)) + 1e-10) / (sum(c) + 1e-10)) AS p FROM o{n} JOIN m{n} USING (g, gram) GROUP BY g, id)"""
        for n in (1, 2, 3, 4)
    )
    + """, u AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4),
    s AS (SELECT g, id, exp((sum(greatest(p, ln(1e-10))) + (4 - count(*)) * ln(1e-10)) / 4) AS bleu FROM u GROUP BY g, id)
    SELECT g, round(sum(bleu) / max(n), 6) AS value FROM s JOIN (SELECT source AS g, count(*) AS n FROM documents GROUP BY 1) USING (g) GROUP BY g""",
)
def self_bleu(spark, sf_dir):
    return lx.self_bleu(_texts(spark, sf_dir)).withColumn("value", F.round("value", 6))


@R.add(
    "embedding_pairwise_distance",
    f"""WITH t AS (SELECT g, id, gram, c / sum(c) OVER (PARTITION BY g, id) AS tf, count(*) OVER (PARTITION BY g, gram) AS df FROM ({count_sql(1, "space", "g, id")})),
    n AS (SELECT source AS g, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT g, id, gram, tf * ln(n / df) AS w FROM t JOIN n USING (g)),
    v AS (SELECT g, id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY g, id)) AS v FROM w QUALIFY sum(w * w) OVER (PARTITION BY g, id) > 0),
    docs AS (SELECT g, id FROM v GROUP BY ALL), dots AS (SELECT a.g, sum(a.v * b.v) AS s FROM v a JOIN v b ON a.g = b.g AND a.gram = b.gram AND a.id < b.id GROUP BY a.g)
    SELECT n.g, round((n * (n - 1) / 2 - coalesce(s, 0)) / (n * (n - 1) / 2), 6) AS value FROM n LEFT JOIN dots ON n.g = dots.g""",
)
def embedding_pairwise_distance(spark, sf_dir):
    return lx.mean_cosine_distance(_texts(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _jaccard_sql(n: int, tokenizer: str, empty: float) -> str:
    return f"""WITH s AS (SELECT source AS g, doc_id AS id, list_distinct({"t" if n == 1 else f"list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"}) AS x FROM (SELECT *, {T[tokenizer]} AS t FROM documents))
    SELECT a.g, round(avg(CASE WHEN len(a.x) + len(b.x) = 0 THEN {empty} ELSE 1 - len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) END), 6) AS value
    FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.g"""


@R.add("jaccard_unigrams", _jaccard_sql(1, "space", 0.0))
def jaccard_unigrams(spark, sf_dir):
    return lx.mean_jaccard_distance(_texts(spark, sf_dir), 1, "space", 0.0).withColumn("value", F.round("value", 6))


@R.add("jaccard_bigrams", _jaccard_sql(2, "word", 1.0))
def jaccard_bigrams(spark, sf_dir):
    return lx.mean_jaccard_distance(_texts(spark, sf_dir), 2, "word", 1.0).withColumn("value", F.round("value", 6))


@R.add("cross_text_novelty", f"WITH s AS (SELECT DISTINCT * FROM ({gram_sql(2, 'word', 'g, id')})), d AS (SELECT *, count(*) OVER (PARTITION BY g, gram) AS df FROM s) SELECT g, id, round(count(*) FILTER (df = 1) / count(*), 6) AS novelty FROM d GROUP BY g, id")
def cross_text_novelty(spark, sf_dir):
    return lx.novelty_per_text(_texts(spark, sf_dir)).withColumn("novelty", F.round("novelty", 6))
