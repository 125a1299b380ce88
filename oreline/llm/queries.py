"""The queries of this subpackage, by name, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.llm import ann, decontam, langid, mixing, pii, quality, sharding, simhash, tokencount, urlfilter
from oreline.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("node")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken", "position")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc_id", "_lid.lang", "_lid.posterior", "_lid.n", "_lid.accepted")


def op3_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.of_pages(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents")).select("doc_id", "_quality.posterior", "_quality.score", "_quality.keep")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.names_hash(F.col("items")).alias("items_sha256"), "contaminated")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_mixing, op3_language_id, op3_language_id_pages, op4_quality, op5_sharding,
        op6_url_filter, op7_decontamination, op8_token_counts, op9_nearest, op10_pii,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op7_decontamination": decontam.ORACLE}
