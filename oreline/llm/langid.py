"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text's likelihood comes from trigrams of character classes; a model of independent classes stands
for no language at all. Grouped sums of text posteriors give the prior of each host, smoothed
towards its address suffix, which is smoothed towards the whole; and how often each language is
declared as what.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import cut, least_hashes, numbered, restored

LANGUAGES = ("de", "en", "es", "fr")
NONE = "und"
#: Texts per declared language that the trigram models are fitted on: those of least hash.
SAMPLE = 2000
#: Strength of a suffix prior over a host's own rows, and of the whole over a suffix.
ALPHA, BETA = 20.0, 50.0
#: Trigrams of a text are not independent: the evidence is worth at most so many, each at this weight.
MOST, WEIGHT = 400, 0.3
#: The text's part of the posterior below which a row is rejected.
LEAST = 0.5

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[0xC2:0xC6] = 27
_CLASS[0x80:0xC0] = 28 + np.arange(0x40) % 4


def trigrams(text: str | None) -> np.ndarray:
    """How often each of 32768 trigrams of character classes that hold a letter occurs in a whole text.

    Letters are those of Latin scripts (up to U+017F); other scripts count as no letters.
    """
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(1 << 15, np.int64)
    for at in range(0, max(len(raw) - 2, 0), 1 << 20):
        part = raw[at : at + (1 << 20) + 2]
        c = _CLASS[part]
        before = np.concatenate((raw[max(at - 1, 0) : at], part))[: len(part)] if at else np.concatenate(([0], part[:-1]))
        c[(part >= 0x80) & (part < 0xC0) & ((before < 0xC2) | (before > 0xC5))] = 0  # continues a letter of another script
        out += np.bincount((c[:-2] << 10) | (c[1:-1] << 5) | c[2:], minlength=1 << 15)
    out[0] = 0
    return out


def models(counts: np.ndarray) -> np.ndarray:
    """Log probabilities (languages and none, trigram) from counts (language, trigram)."""
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
    every = p.mean(0).reshape(32, 32, 32)
    one = every.sum((1, 2)) + every.sum((0, 2)) + every.sum((0, 1))
    one /= one.sum()
    none = one[:, None, None] * one[None, :, None] * one[None, None, :]
    return np.log(np.vstack((p, none.reshape(1, -1) / none.sum())))


def evidence(text: str | None, table: np.ndarray) -> tuple[int, list[float]]:
    """Trigrams in a text, and the weighted log likelihood of each language and of none."""
    found = trigrams(text)
    at = np.flatnonzero(found)
    n = int(found[at].sum())
    if not n:
        return 0, [0.0] * len(table)
    ll = table[:, at] @ found[at].astype(float)
    return n, (WEIGHT * min(n, MOST) / n * ll).tolist()


def fit(docs: DataFrame, text: str, declared: str, languages: tuple[str, ...], sample: int = SAMPLE) -> np.ndarray:
    """Models from up to ``sample`` different texts per declared language, those of least hash."""
    rows = docs.select(F.col(text).alias("t"), F.lower(F.substring(F.col(declared), 1, 2)).alias("d"), F.xxhash64(text).alias("h")).where(F.col("d").isin(*languages) & F.col("t").isNotNull())
    where, hashes = F.lit(False), cut(rows.select("d", "h").distinct(), "hashes")
    for lang in languages:
        last = least_hashes(hashes.where(F.col("d") == lang), sample)
        if last is not None:
            where = where | ((F.col("d") == lang) & (F.col("h") <= last))

    def count(batches):
        total = np.zeros((len(languages), 1 << 15), np.int64)
        for batch in batches:
            for t, d in zip(batch.column(0), batch.column(1), strict=True):
                total[languages.index(d.as_py())] += trigrams(t.as_py())
        lang, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram), pa.array(total[lang, gram])], names=["l", "g", "n"])

    out = np.zeros((len(languages), 1 << 15))
    found = rows.where(where).dropDuplicates(["d", "h"]).select("t", "d").mapInArrow(count, "l long, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (x.to_numpy() for x in found.columns)  # at most 32768 a language
    out[lang, gram] = n
    return models(out)


def _text_column(text: Column, table: np.ndarray, spark) -> Column:
    shared = spark.sparkContext.broadcast(table)
    kind = pa.struct([("n", pa.int64()), ("ll", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<n:long,ll:array<double>,p:array<double>>")
    def compute(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            n, ll = evidence(t.as_py(), shared.value)
            p = np.exp(np.array(ll) - max(ll))
            out.append({"n": n, "ll": ll, "p": (p / p.sum()).tolist()})
        return pa.array(out, kind)

    return compute(text)


def identify(
    docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", suffix_col: str | None = None, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE, least: float = LEAST, table: np.ndarray | None = None, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` with a column ``_lid``: struct of lang, posterior, text_share (the likelihoods' own
    posterior of that language), n (trigrams) and accepted.

    Rejected: texts without letters (also null and empty), texts that no language explains better
    than independent characters do, and posteriors below ``least``. Null or unknown declarations say
    nothing; null hosts share one prior, as do null suffixes. Repeated rows count and come out each.
    Without any labelled row all languages are alike and texts are rejected. Very long texts are read
    whole; their evidence counts as that of ``MOST`` trigrams. keep: the only columns of ``docs`` to give out.
    """
    spark, k = docs.sparkSession, len(languages) + 1
    docs, names_of = numbered(docs)
    text_col, declared_col, host_col = names_of[text_col], names_of[declared_col], names_of[host_col]
    suffix_col = names_of[suffix_col] if suffix_col else None
    table = fit(docs, text_col, declared_col, languages, sample) if table is None else table
    known = F.lower(F.substring(F.coalesce(F.col(declared_col), F.lit("")), 1, 2))
    declared = F.when(known.isin(*languages), known).otherwise("")
    key = {"_lid_host": F.coalesce(F.col(host_col).cast("string"), F.lit("\0")), "_lid_suffix": F.coalesce(F.col(suffix_col).cast("string"), F.lit("\0")) if suffix_col else F.lit(""), "_lid_declared": declared}
    rows = docs.withColumns(key | {"_lid_x": _text_column(F.col(text_col), table, spark)})
    rows = cut(rows if keep is None else rows.drop(*[c for old, c in names_of.items() if old not in keep]), "evidence")  # texts are read once
    names_of = {old: c for old, c in names_of.items() if keep is None or old in keep}

    sums = [F.sum(F.when(F.col("_lid_x.n") > 0, F.col("_lid_x.p")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(k)]
    seen = cut(rows.groupBy("_lid_host", "_lid_suffix", "_lid_declared").agg(*sums), "hosts")
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    said = {r[0]: r[1:] for r in seen.groupBy("_lid_declared").agg(*again).collect()}  # at most one row a language
    total = np.array([sum(r[i] or 0.0 for r in said.values()) for i in range(k)])
    whole = (total + 1) / (total.sum() + k)
    of_suffix = seen.groupBy("_lid_suffix").agg(*again).toDF("_s", *[f"x{i}" for i in range(k)])
    add = lambda name: sum((F.col(f"{name}{i}") for i in range(1, k)), F.col(f"{name}0"))
    hosts = seen.groupBy("_lid_host", "_lid_suffix").agg(*again).join(of_suffix, F.col("_lid_suffix") == F.col("_s"))
    by_suffix = [(F.col(f"x{i}") + BETA * float(whole[i])) / (add("x") + BETA) for i in range(k)]
    hosts = hosts.select(F.col("_lid_host").alias("_h"), F.col("_lid_suffix").alias("_s"), F.array(*[F.col(f"s{i}") for i in range(k)]).alias("_lid_own"), F.array(*by_suffix).alias("_lid_up"))

    rows = rows.join(hosts, (F.col("_lid_host") == F.col("_h")) & (F.col("_lid_suffix") == F.col("_s")))
    own = F.when(F.col("_lid_x.n") > 0, 1.0).otherwise(0.0)  # a row does not vouch for itself
    all_own = F.aggregate("_lid_own", F.lit(0.0), lambda a, b: a + b)
    prior = F.transform(F.arrays_zip("_lid_own", "_lid_up", "_lid_x.p"), lambda z: (F.greatest(z["_lid_own"] - own * z["p"], F.lit(0.0)) + ALPHA * z["_lid_up"]) / (F.greatest(all_own - own, F.lit(0.0)) + ALPHA))
    likely = F.lit(None)
    for name, mass in said.items():
        if name:
            other = {n: np.array([x or 0.0 for x in m]) for n, m in said.items() if n}
            every = sum(other.values())
            p = (np.array([x or 0.0 for x in mass]) + 0.5) / (every + 0.5 * (len(languages) + 1))
            likely = F.when(F.col("_lid_declared") == name, F.array(*[F.lit(float(np.log(x))) for x in p])).otherwise(likely)
    likely = F.coalesce(likely, F.array(*[F.lit(0.0)] * k)) if any(said) else F.array(*[F.lit(0.0)] * k)
    rows = rows.withColumn("_lid_prior", prior).withColumn("_lid_likely", likely)
    logs = F.transform(F.arrays_zip("_lid_x.ll", "_lid_prior", "_lid_likely"), lambda z: z["ll"] + F.log(z["_lid_prior"]) + z["_lid_likely"])
    rows = rows.withColumn("_lid_logs", logs)
    shifted = F.transform("_lid_logs", lambda x: F.exp(x - F.array_max("_lid_logs")))
    rows = rows.withColumn("_lid_odds", shifted).withColumn("_lid_sum", F.aggregate("_lid_odds", F.lit(0.0), lambda a, b: a + b))
    best = F.array_position("_lid_odds", F.array_max("_lid_odds")).cast("int")
    names = F.array(*[F.lit(x) for x in (*languages, NONE)])
    silent = F.col("_lid_x.n") == 0
    lang = F.when(silent, F.lit(NONE)).otherwise(F.element_at(names, best))
    posterior = F.array_max("_lid_odds") / F.col("_lid_sum")
    rows = rows.withColumn("_lid", F.struct(lang.alias("lang"), posterior.alias("posterior"), F.element_at("_lid_x.p", best).alias("text_share"), F.col("_lid_x.n").alias("n"), ((lang != NONE) & (posterior >= least)).alias("accepted")))
    return restored(rows, names_of, "_lid")


def of_pages(pages: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``page_id``, ``lang``, ``posterior``, ``accepted`` of web pages: declared by the markup's ``lang``, host and
    last label of the host from the address, text without markup. Malformed or null markup and
    addresses give no evidence; empty pages are rejected, repeated rows come out each, an empty table gives none."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    rows = pages.select("page_id", text.alias("text"), F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]{2})", 1).alias("lang"), host.alias("host"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"))
    found = identify(rows, "text", "lang", "host", "suffix", languages, keep=("page_id",))
    return found.select("page_id", "_lid.lang", "_lid.posterior", "_lid.accepted")
