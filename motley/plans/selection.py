"""Diverse selection over embeddings; every label is a group, or everything is one with labels for fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from motley.operators import select as sel
from motley.plans.common import Registry, docs, read

R = Registry()


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.pmod(F.col("vec_id") * 37, F.lit(101)) / 101.0).alias("relevance"))


for _method in sel.METHODS:

    def _select(spark, sf_dir, method=_method):
        v = _vectors(spark, sf_dir)
        if method == "fair":
            v = v.withColumn("label", F.col("g")).withColumn("g", F.lit(0))
        return sel.select(v, 10, method)

    R.add(f"select_{_method}")(_select)


@R.add("stratified_sample")
def stratified(spark, sf_dir):
    return sel.stratified(_vectors(spark, sf_dir).select("g", "id"), 57, 42)


@R.add("stratified_sample_sizes", "WITH c AS (SELECT label AS g, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS p, count(*) OVER () AS k FROM embeddings GROUP BY label) SELECT g, least(n, 57 // k + (p < 57 % k)::INT)::BIGINT AS n FROM c")
def stratified_sizes(spark, sf_dir):
    return stratified(spark, sf_dir).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@R.add("random_sample")
def random_sample(spark, sf_dir):
    return sel.random_sample(docs(spark, sf_dir).select(F.col("doc_id").alias("id")), 20, 42)
