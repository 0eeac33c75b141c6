"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from taxaledger.llm import bpe_codec, centroid_clusters, language_gru, near_duplicates, periodic_runs, pseudo_likelihood, quality_cnn, quality_rules, secret_scan, token_counts, token_store, vector_search, winnowing
from taxaledger.llm.centroid_clusters_sql import cluster_sql
from taxaledger.llm.periodic_runs_sql import OP11_SQL
from taxaledger.llm.quality_rules_sql import OP13_SQL
from taxaledger.llm.secret_scan_sql import OP3_SQL
from taxaledger.llm.shipping import ship
from taxaledger.llm.texts import table
from taxaledger.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(fn)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = shipped
    return shipped


@query
def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).drop("rid")


@query
def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


SQL["op3_secret_scan"] = OP3_SQL


@query
def op4_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_gru.predictions(table(spark, sf_dir, "documents"))


@query
def op5_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"))


@query
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.document_checksums(spark, path)


@query
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digests(winnowing.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


SQL["op8_winnowing"] = winnowing.OP8_SQL


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), order=periodic_runs.planted_order))


SQL["op11_periodic_runs"] = OP11_SQL


@query
def op12_nsimplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.digests(table(spark, sf_dir, "embeddings"))


SQL["op12_nsimplex_clusters"] = cluster_sql(centroid_clusters.CENTROIDS, centroid_clusters.ROUNDS, centroid_clusters.DIMENSIONS, centroid_clusters.SCALE, centroid_clusters.SALT)


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


SQL["op13_quality_rules"] = OP13_SQL
