"""Top-level domains: those that the installed Java knows, or a list of one's own from a text file of one name per line."""

from __future__ import annotations

import functools
import os
import shutil
import time
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where no Java with a list is found: the oldest generic names and the most used country codes.
COMMON = tuple(
    "com org net edu gov mil int arpa info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx app dev io ai co me tv xyz top site online shop tech "
    "at au be br ca ch cn cz de dk es eu fi fr gr hu ie il in it jp kr mx nl no nz pl pt ro ru se sk tr tw ua uk us za".split()
)


@functools.cache
def installed_tlds(java_home: str | None = None) -> tuple[str, ...]:
    """All top-level domains (about 1450), lower case and sorted, names beyond ASCII as ``xn--``.

    Every Java has them, as the names of the parts of its public suffix list; without such a list ``COMMON``.
    """
    java = shutil.which("java")
    homes = [java_home, os.environ.get("JAVA_HOME"), os.path.dirname(os.path.dirname(os.path.realpath(java))) if java else None]
    for home in filter(None, homes):
        path = os.path.join(home, "lib", "security", "public_suffix_list.dat")
        if os.path.exists(path):
            with zipfile.ZipFile(path) as parts:
                return tuple(sorted({name if name.isascii() else name.encode("idna").decode() for name in map(str.lower, parts.namelist())}))
    return COMMON


def read_tlds(spark: SparkSession, path: str) -> DataFrame:
    """``tld``, lower case, from a file in which lines that start with # are comments; blank lines go."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(line.alias("tld")).where("tld != ''").distinct()


def cached_tlds(spark: SparkSession, fetch: Callable[[], DataFrame], folder: str, max_age_s: float, now: float | None = None) -> DataFrame:
    """The newest stored list that is at most ``max_age_s`` old, else what ``fetch`` gives, stored by time."""
    now = time.time() if now is None else now
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = sorted(float(x.getPath().getName()[3:]) for x in store.listStatus(path) if x.getPath().getName().startswith("at=")) if store.exists(path) else []
    if stored and now - stored[-1] <= max_age_s:
        return spark.read.parquet(f"{folder}/at={stored[-1]}")
    fetch().write.mode("overwrite").parquet(f"{folder}/at={now}")
    return spark.read.parquet(f"{folder}/at={now}")
