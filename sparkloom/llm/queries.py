"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, conversation_repair, decontamination, fuzzy_prints, html_text, languages, licences, near_dups, neighbours, oracles, pieces, sharding, token_counts, toxicity
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op4_benchmark_decontamination": oracles.DECONTAMINATION,
    "op5_sharding": oracles.SHARDING,
    "op8_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op11_centroid_clustering": oracles.CENTROIDS,
    "op13_conversation_repair": oracles.REPAIR,
}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"), html_text.default_model(spark))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))).alias("licences"),
        F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.array_min(F.transform("matches", lambda m: m["first_word"])), F.lit(-1).cast("long")).alias("first_word"),
    )


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(read(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.sort_array(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = languages.fit(docs, ~languages.held_out())
    found = languages.identify(docs, model)
    return found.select("doc_id", languages.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~languages.held_out())
    found = toxicity.score(docs, model)
    return found.select("doc_id", languages.held_out().alias("held_out"), "score", "predicted")


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.build_index(vectors), vectors.where("vec_id % 100 = 0"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), k=3)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.char_length("decoded").cast("long").alias("decoded_chars"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        F.transform("samples", lambda s: F.size(s).cast("long")).alias("sample_pieces"),
        F.transform("samples", lambda s: F.xxhash64(s)).alias("sample_hashes"),
        "log_p",
        "inclusion",
    )


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


@query
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_prints.near_duplicates(read(spark, sf_dir, "documents"), width=4)


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(conversation_repair.damaged(read(spark, sf_dir, "conversations")))
