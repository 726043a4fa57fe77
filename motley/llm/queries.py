"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.llm import centroids, chat, fim, fingerprints, html, linededup, mixing, neardup, packing, pii, quality, tokens, urls
from motley.llm.shared import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table(sf_dir, "documents"))


def op1_chat_format(spark, sf_dir):
    return chat.format_chats(spark.read.parquet(table(sf_dir, "conversations")))


def op2_html_extract(spark, sf_dir):
    return html.extract(spark.read.parquet(table(sf_dir, "pages")))


def op3_quality_rules(spark, sf_dir):
    return quality.judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op5_token_counts(spark, sf_dir):
    return tokens.count_tokens(_documents(spark, sf_dir))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir))


def op7_mix_sources(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir))


def op8_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(_documents(spark, sf_dir))


def op9_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(_documents(spark, sf_dir))


def op10_pii(spark, sf_dir):
    return pii.find(_documents(spark, sf_dir))


def op11_centroid_clustering(spark, sf_dir):
    return centroids.cluster(spark.read.parquet(table(sf_dir, "embeddings")))


def op12_fill_in_middle(spark, sf_dir):
    done = fim.restore(fim.transform(_documents(spark, sf_dir).select("doc_id", "text")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_url_filter(spark, sf_dir):
    return urls.judge(spark.read.parquet(table(sf_dir, "pages")))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_html_extract, op3_quality_rules, op4_minhash_near_dedup, op5_token_counts, op6_best_fit_packing, op7_mix_sources, op8_fingerprints, op9_line_dedup, op10_pii, op11_centroid_clustering, op12_fill_in_middle, op13_url_filter)}
ORACLES: dict[str, str] = {"op7_mix_sources": mixing.ORACLE, "op9_line_dedup": linededup.ORACLE, "op11_centroid_clustering": centroids.ORACLE, "op12_fill_in_middle": fim.ORACLE, "op13_url_filter": urls.ORACLE}
