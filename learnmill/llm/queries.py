"""The corpus queries: one ``opN_<name>`` for each operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, compression_rules, decontaminate, dual_tree, language_id, periodic_runs, quality_nbsvm, sharding, simhash, simplex_clusters, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_nbsvm.quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.score_quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_url_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), keep=["page_id"])


def op4_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_query(table(spark, sf_dir, "documents"))


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_query(table(spark, sf_dir, "documents"))


def op12_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex_clusters.clusters_query(table(spark, sf_dir, "embeddings"))


def op13_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.top_query(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_nbsvm, op2_compression_bands, op3_url_digest_array, op4_rank_order_profiles, op5_chunked_bpe,
        op6_decontaminate, op7_simhash_golay, op8_toxicity_neighbours, op9_sampled_splitters, op10_warc_normaliser, op11_periodic_runs, op12_simplex_clusters,
        op13_dual_tree_top_k,
    )
}

ORACLES: dict[str, str] = {
    "op3_url_digest_array": url_filter.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op10_warc_normaliser": warc.ORACLE_SQL,
    "op12_simplex_clusters": simplex_clusters.ORACLE_SQL,
    "op13_dual_tree_top_k": dual_tree.ORACLE_SQL,
}
