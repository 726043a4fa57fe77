"""Operator 7, mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree is domain - language - source; tokens are words.  A budget of tokens
is divided top-down: at each node it goes to the children in proportion to
their weights, but never more than a child's subtree can give (its tokens times
``max_epochs``); what a child cannot take goes to its siblings, and only what
all siblings together cannot take has already gone, one level up, to the
siblings of their parent.  The division is water filling in closed form: with
children ordered by capacity/weight the water level is the greatest of
(budget - capacities before) / (weights from here on).

A leaf's tokens come from seeded epochs: every epoch orders the leaf's
documents by md5(seed:epoch:doc_id); whole epochs are taken first, then the
longest prefix of the next whose tokens fit the rest.  The prefix ends at one
md5 value for each leaf, found with sums over md5 buckets, so no task ever
holds a leaf.

Edge cases: null or blank texts have no tokens and come along free with their
place in the order; null language or source is the leaf ''; null doc_ids share
one md5 value; repeated rows share theirs and are taken or left together; an
empty table gives no rows; a zero budget takes only documents without tokens;
other columns pass through ``apply``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.llm.shared import WORD, written

SEED, SHARE, EPOCHS = 17, 0.5, 2
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
BROADCAST_LEAVES, BUCKET_ROWS = 10_000, 4096
LEVELS = ("domain", "language", "leaf")


def default_domain(source: Column) -> Column:
    return F.when(F.substring(F.md5(source), 1, 1) < "8", "a").otherwise("b")


def _weight(name: str, table: Mapping[str, float]) -> Column:
    return reduce(lambda c, kv: c.when(F.col(name) == kv[0], F.lit(float(kv[1]))), table.items(), F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(1.0))


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divides ``budget`` among the nodes of each parent: adds ``share``."""
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    above = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    nodes = nodes.withColumn("level", level)
    top = F.max("level").over(Window.partitionBy(*parent))
    return nodes.withColumn("share", F.greatest(F.lit(0.0), F.least(F.col("capacity"), F.col("weight") * top))).drop("level", "budget")


def budgets(leaves: DataFrame, share: float, epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(domain, language, leaf, available) to (..., full, rest): whole epochs and tokens beyond them."""
    leaves = leaves.withColumn("capacity", F.col("available").cast("double") * epochs)
    languages = leaves.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
    domains = languages.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = F.sum("capacity").over(Window.partitionBy(F.lit(0))) / epochs * share
    domains = _fill(domains.withColumn("weight", _weight("domain", weights.get("domain", {}))).withColumn("budget", total).withColumn("root", F.lit(0)), ["root"], "domain")
    languages = languages.join(domains.select("domain", F.col("share").alias("budget")), "domain")
    languages = _fill(languages.withColumn("weight", _weight("language", weights.get("language", {}))), ["domain"], "language")
    leaves = leaves.join(languages.select("domain", "language", F.col("share").alias("budget")), ["domain", "language"])
    leaves = _fill(leaves.withColumn("weight", _weight("leaf", weights.get("source", {}))), ["domain", "language"], "leaf")
    tokens = F.floor(F.col("share") + 1e-6).cast("long")
    full = F.when(F.col("available") > 0, F.floor(tokens / F.col("available"))).otherwise(0).cast("long")
    return leaves.select("domain", "language", "leaf", "available", full.alias("full"), (tokens - full * F.col("available")).alias("rest"))


def _keyed(docs: DataFrame, domain) -> list[Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return [domain(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), source.alias("leaf")]


def _order(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _sized(small: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only for as many leaves as were counted to be few; else a shuffle join."""
    return F.broadcast(small) if rows <= BROADCAST_LEAVES else small


def thresholds(sizes: DataFrame, share: float, epochs: int, seed: int, weights) -> tuple[DataFrame, int]:
    """The leaf table with ``full``, ``rest`` and ``last``, the md5 that ends the prefix (null: none)."""
    leaf = list(LEVELS)
    stats = sizes.groupBy(*leaf).agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_docs"))
    plan = written(budgets(stats, share, epochs, weights), "budgets")
    n_leaves, rows = plan.count(), sizes.count()
    digits = max(1, math.ceil(math.log(max(rows / BUCKET_ROWS, 2), 16)) + 1)
    keyed = sizes.join(_sized(plan, n_leaves), leaf).select(*leaf, "rest", "n_tokens", _order(seed).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    sums = keyed.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("inside"))
    before = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0))).drop("inside")
    running = Window.partitionBy(*leaf, "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = keyed.withColumn("inside", F.sum("n_tokens").over(running)).join(sums, [*leaf, "bucket"])
    last = reached.where(F.col("before") + F.col("inside") <= F.col("rest")).groupBy(*leaf).agg(F.max("key").alias("last"))
    return written(plan.join(last, leaf, "left"), "thresholds"), n_leaves


def _take(rows: DataFrame, plan: DataFrame, n_leaves: int, seed: int, out: list[Column]) -> DataFrame:
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "full", F.col("last"))
    joined = rows.join(_sized(plan, n_leaves), [F.col(c) == F.col(f"_{c}") for c in LEVELS])
    copies = F.col("full") + F.when(_order(seed) <= F.col("last"), 1).otherwise(0)
    return joined.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).select(*out)


def _sizes(docs: DataFrame, domain) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keyed(docs, domain), words.alias("n_tokens")), "sizes")


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights=None, domain=default_domain) -> DataFrame:
    """One row per selected document and epoch: doc_id, domain, lang, source, n_tokens, epoch."""
    sizes = _sizes(docs, domain)
    plan, n = thresholds(sizes, share, epochs, seed, {"language": LANGUAGES} if weights is None else weights)
    return _take(sizes, plan, n, seed, [F.col("doc_id"), F.col("domain"), F.col("language").alias("lang"), F.col("leaf").alias("source"), F.col("n_tokens"), F.col("epoch")])


def apply(docs: DataFrame, share: float = SHARE, epochs: int = 1, seed: int = SEED, weights=None, domain=default_domain) -> DataFrame:
    """The selected documents with all their columns, one row per epoch in which they are taken."""
    plan, n = thresholds(_sizes(docs, domain), share, epochs, seed, {"language": LANGUAGES} if weights is None else weights)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), *_keyed(docs, domain))
    return _take(rows, plan, n, seed, [F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'a' ELSE 'b' END AS domain, coalesce(lang, '') AS language,
         coalesce(source, '') AS leaf, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, language, leaf, sum(n_tokens)::BIGINT AS available, sum(n_tokens)::DOUBLE * 2 AS capacity, 1.0::DOUBLE AS weight FROM sizes GROUP BY ALL
), langs AS (
  SELECT domain, language, sum(capacity) AS capacity,
         CASE language WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 1.0 END::DOUBLE AS weight FROM leaves GROUP BY ALL
), domains AS (
  SELECT domain, sum(capacity) AS capacity, 1.0::DOUBLE AS weight FROM langs GROUP BY domain
), d1 AS (
  SELECT *, (sum(capacity) OVER () / 2 * 0.5 - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM domains
), d2 AS (
  SELECT domain, greatest(0, least(capacity, weight * max(level) OVER ())) AS share FROM d1
), l1 AS (
  SELECT langs.*, (share - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, language ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM langs JOIN d2 USING (domain)
), l2 AS (
  SELECT domain, language, greatest(0, least(capacity, weight * max(level) OVER (PARTITION BY domain))) AS share FROM l1
), s1 AS (
  SELECT leaves.*, (share - coalesce(sum(capacity) OVER (PARTITION BY domain, language ORDER BY capacity / weight, leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (PARTITION BY domain, language ORDER BY capacity / weight, leaf ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM leaves JOIN l2 USING (domain, language)
), s2 AS (
  SELECT domain, language, leaf, available,
         floor(greatest(0, least(capacity, weight * max(level) OVER (PARTITION BY domain, language))) + 1e-6)::BIGINT AS tokens FROM s1
), plan AS (
  SELECT *, CASE WHEN available > 0 THEN tokens // available ELSE 0 END AS whole FROM s2
), keyed AS (
  SELECT doc_id, domain, language, leaf, n_tokens, whole, tokens - whole * available AS rest,
         md5('17:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM sizes JOIN plan USING (domain, language, leaf)
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, leaf ORDER BY key) AS reached FROM keyed
), copies AS (
  SELECT *, whole + CASE WHEN reached <= rest THEN 1 ELSE 0 END AS n FROM placed
)
SELECT doc_id, domain, language AS lang, leaf AS source, n_tokens, unnest(range(n))::BIGINT AS epoch FROM copies WHERE n > 0
"""
