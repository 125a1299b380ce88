"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables
and columns of any other name; what each does with them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oreline.llm import decontam, langid, mixing, sharding, simhash
from oreline.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters, so also null and empty texts, or like none of the
    languages go. Null languages and sources say nothing; repeated rows stay or go alike."""
    return langid.identify(docs).where("_lid.accepted").drop("_lid")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id, null last, and of several rows with
    that id the one whose text has the smallest hash. Null and empty texts are one group."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much of ``benchmark``; short passages of it are cut out of the others. Null and empty
    texts stay, as all do where the benchmark is empty; repeated rows stay or go alike."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in training order. Documents without words give
    nothing, null texts neither; documents of null sources are those of one source, last in order."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with its shard and place there; these columns replace others of the same names.
    Null texts have size 1; rows that repeat id and text are spread like others."""
    found = sharding.shards(docs, keep_rows=True)
    added = ["size", "text_crc32", "law", "shard", "slot", "virtual_slot", "map_version"]
    return found.select(*[found[f"row.`{c}`"] for c in docs.columns if c.lower() not in added], *added)


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]
#: Stages hash, cluster and score in ways that SQL lacks; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
