"""What the operators of this subpackage share: tables, shared storage, small columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators.storage import scratch
from oreline.operators.storage import stored as cut

__all__ = ["WORD", "ascii_lower", "cut", "least_hashes", "n_words", "numbered", "restored", "scratch", "table"]

#: What separates words for the operators that count or shingle them.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Rows that go to Python at once: a batch of long texts must fit into a worker beside what it makes of them.
BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH`` rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashes(hashes: DataFrame, n: int) -> int | None:
    """The ``n``-th smallest of the different values of column ``h``, or the largest if there are fewer; null of none.

    Only hashes move, and of these no more than n reach the driver's side.
    """
    return hashes.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed to c0, c1, ..., and the new name of each: what an operator adds
    cannot clash with them."""
    small_batches(df.sparkSession)
    names = {old: f"c{k}" for k, old in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str], added: str | None = None) -> DataFrame:
    """The columns of ``names`` under their old names, and column ``added``, which replaces an old one of that name."""
    old = [F.col(new).alias(name) for name, new in names.items() if added is None or name.lower() != added.lower()]
    return df.select(*old, *[added] * (added is not None))


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def n_words(c: Column) -> Column:
    """How many words of ``WORD`` a text has; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
