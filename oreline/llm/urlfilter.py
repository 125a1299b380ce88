"""URL filtering: host and path rules, and for what no rule fits a character language-model ratio.

Two smoothed variable-order Markov models, of URLs that rules allow and of URLs that rules block,
score a URL by its log-likelihood difference per character; the cut is calibrated on URLs held out.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import ascii_lower, cut, least_hashes, numbered, restored

#: Verdict, host, path: a rule fits its host and all subdomains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Characters of context at most; different URLs per verdict that the models are fitted on (those of
#: least hash; one in five is held out).
ORDER, SAMPLE = 4, 20_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; empty without ``://`` or for null."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does. Rules are few:
    they become a chain of conditions, longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _framed(url: str) -> str:
    """The bytes of a URL, a character each, between a mark of the start and one of the end."""
    return "\x02" + url.encode("utf-8", "surrogatepass").decode("latin-1") + "\x03"


@dataclass
class Markov:
    """Character model of orders up to ``order``, each smoothed towards the shorter one (Witten-Bell).

    Characters are bytes of UTF-8, so that the shortest order, which takes all as alike, is a distribution.
    """

    order: int = ORDER
    counts: dict[str, Counter] = field(default_factory=dict)
    kept: dict[tuple[str, str], float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}  # what was looked up does not travel

    def add(self, url: str) -> None:
        text = _framed(url)
        for k in range(1, len(text)):
            for n in range(min(self.order, k) + 1):
                self.counts.setdefault(text[k - n : k], Counter())[text[k]] += 1

    def chance(self, context: str, c: str) -> float:
        key = (context, c)
        if key not in self.kept:
            if len(self.kept) > 1_000_000:
                self.kept.clear()
            lower = self.chance(context[1:], c) if context else 1 / 256
            seen = self.counts.get(context)
            if seen:
                n, kinds = seen.total(), len(seen)
                lower = (seen[c] + kinds * lower) / (n + kinds)
            self.kept[key] = lower
        return self.kept[key]

    def score(self, url: str) -> float:
        """Mean log chance of a URL's characters and its end."""
        text = _framed(url)
        return sum(math.log(self.chance(text[max(0, k - self.order) : k], text[k])) for k in range(1, len(text))) / (len(text) - 1)


@dataclass
class Ratio:
    good: Markov
    bad: Markov
    cut: float

    def score(self, url: str) -> float:
        return self.good.score(url) - self.bad.score(url)

    def verdict(self, url: str | None) -> str:
        """Null URLs, like empty ones, are allowed, as are all where a side has no examples."""
        if not url or not self.good.counts or not self.bad.counts:
            return "allow"
        return "allow" if self.score(url) >= self.cut else "block"


def fit(allowed: list[str], blocked: list[str], order: int = ORDER) -> Ratio:
    """Models of four in five URLs; the cut has the best mean of both sides' accuracies on the rest."""
    out = Ratio(Markov(order), Markov(order), 0.0)
    held: list[tuple[float, int]] = []
    for model, urls in ((out.good, allowed), (out.bad, blocked)):
        for k, url in enumerate(sorted(urls)):
            if k % 5:
                model.add(url)
    if not out.good.counts or not out.bad.counts:
        return out
    for y, urls in ((1, allowed), (0, blocked)):
        held += [(out.score(url), y) for k, url in enumerate(sorted(urls)) if not k % 5]
    n = Counter(y for _, y in held)
    best, right = (0.0, 0.0, 0.0), {1: n[1], 0: 0}
    held.sort()
    for k, (s, y) in enumerate(held):
        value = right[1] / max(n[1], 1) + right[0] / max(n[0], 1)
        at = s if not k else (s + held[k - 1][0]) / 2
        best = max(best, (value, -abs(at), at))
        right[y] += 1 if y == 0 else -1
    out.cut = best[2]
    return out


def train(pages: DataFrame, url_col: str = "url", rules: tuple = RULES, sample: int = SAMPLE) -> Ratio:
    """A ratio fitted on up to ``sample`` different URLs of each verdict of the rules, those of least hash."""
    url = F.col(url_col)
    rows = pages.select(url.alias("u"), F.xxhash64(url).alias("h"), rule_of(host_of(url), path_of(url), rules)["verdict"].alias("v")).where("v is not null")
    hashes, sides = cut(rows.select("v", "h").distinct(), "hashes"), []
    for verdict in ("allow", "block"):
        last = least_hashes(hashes.where(F.col("v") == verdict), sample)
        near = rows.where((F.col("v") == verdict) & (F.col("h") <= F.lit(last))) if last is not None else rows.limit(0)
        sides.append([r.u for r in near.dropDuplicates(["h"]).select("u").collect()])  # at most ``sample``
    return fit(*sides)


def judge(pages: DataFrame, url_col: str = "url", rules: tuple = RULES, ratio: Ratio | None = None) -> DataFrame:
    """``pages`` with a column ``_url``: struct of host, path, rule, verdict and ratio (null where a rule decides).

    Null URLs and URLs without ``://`` have empty host and path, so no rule; the method judges the
    whole string. Repeated rows come out each; very long URLs are read whole; an empty table gives no rows.
    """
    pages, names = numbered(pages)
    url_col = names[url_col]
    ratio = ratio or train(pages, url_col, rules)
    shared = pages.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf("struct<verdict:string,ratio:double>")
    def compute(urls: pa.Array, ruled: pa.Array) -> pa.Array:
        verdicts, scores = [], []
        for u, r in zip(urls.to_pylist(), ruled.to_pylist(), strict=True):
            verdicts.append(None if r else shared.value.verdict(u))
            scores.append(shared.value.score(u) if u and not r and shared.value.good.counts and shared.value.bad.counts else None)
        return pa.StructArray.from_arrays([pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=["verdict", "ratio"])

    url = F.col(url_col)
    out = pages.withColumn("_rule", rule_of(host_of(url), path_of(url), rules))
    out = out.withColumn("_model", compute(url, F.col("_rule").isNotNull()))
    found = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_model.verdict").alias("verdict"), F.col("_model.ratio").alias("ratio"))
    return restored(out.withColumn("_url", found), names, "_url")
