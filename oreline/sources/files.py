"""Envelopes and snapshots as files, and a search of one's own over files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators.policy import snapshot_diff
from oreline.operators.release import ENVELOPE, authentication_encoding


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """``path, envelope, payload`` of signed envelopes, a JSON object in each file; what is none has a null envelope."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", ENVELOPE).alias("envelope"))
    return rows.withColumn("envelope", F.when(F.col("envelope.payload").isNotNull(), F.col("envelope"))).withColumn("payload", F.unbase64("envelope.payload"))


def signed_bytes(envelopes: DataFrame) -> DataFrame:
    """``envelopes`` with ``pae``: what their signatures sign."""
    return envelopes.withColumn("pae", F.when(F.col("envelope").isNotNull(), authentication_encoding(F.col("envelope.payloadType"), F.col("payload"))))


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """Envelopes (column ``envelope``) as JSON lines; null fields are left out."""
    envelopes.select(F.to_json("envelope").alias("value")).write.mode("overwrite").text(path)


def save_state(snapshot: DataFrame, folder: str) -> None:
    """Keep a ``policy.snapshot`` (repo_id, kind, ref, hash and, where known, sha512)."""
    snapshot.write.mode("overwrite").json(folder)


def load_state(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("repo_id string, kind string, ref string, hash string, sha512 string").json(folder)


def changes_since(now: DataFrame, folder: str, commits: DataFrame | None = None) -> DataFrame:
    """``policy.snapshot_diff`` against the kept state."""
    return snapshot_diff(load_state(now.sparkSession, folder).select("repo_id", "kind", "ref", "hash"), now, commits)


def each_file(files: DataFrame, search: Callable[[str, bytes], Iterator[tuple]], schema: str, path: str = "path", data: str = "data") -> DataFrame:
    """A search of one's own: ``search(path, data)`` gives rows of ``schema`` for a file; they come with its path."""
    names = [f.name for f in files.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(p, *row) for p, d in zip(batch[path], batch[data], strict=True) for row in search(p, bytes(d))]
            yield pd.DataFrame(rows, columns=[path, *names])

    return files.select(path, data).mapInPandas(run, f"{path} string, {schema}")
