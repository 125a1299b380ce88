"""Personal data by candidate generation and gradient boosting, in DataFrame functions only.

Strict patterns give the base spans. Wider generators propose overlapping candidates. What is known of
a candidate is held apart: a check of its content (Luhn sum, octets, digits, top-level name) that
random text passes with a known chance is the label, and shape and context are the features. Boosted
trees learn how often candidates of a shape and context pass; where that is far above chance, those
that pass are personal data, whatever the base patterns say. Trees are fitted on counts of feature
cells over all rows, so the driver sees at most one row per cell; thresholds are set per kind on
cells of held-out documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.functions.arrays import let, maxima, sums
from oreline.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Equal to the plain forms, but linear: no match starts inside a run that cannot match as a whole,
#: except where the match before ends (\G), and repeated groups keep what they took.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: High recall: spelled-out signs, commas in addresses, other separators, numbers without a plus.
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?: ?[.,] ?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[ ./()-]{1,2}[0-9]{2,5}+){2,5}+(?![0-9])",
}
#: What must occur for a pattern to be tried at all.
HINT = {"email": "@|at", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_WORDS = "(?:tel|phone|call|fax|mobile|mail|contact|write|card|visa|pay|ip|addr|host|server|from)[ .:=]*$"
FEATURES = ("kind", "digits", "signs", "plus", "parens", "before", "after", "word", "upper", "alone")
#: How often a candidate of each kind passes its check by chance, and last labels that mail domains have.
CHANCE = (0.05, 0.3, 0.1, 0.3)
#: Held-out candidates whose rate is judged at once.
POOL = 10
_TOP = r"(?i)(?:com|org|net|edu|gov|info|biz|io|dev|app|de|fr|es|uk|it|nl|eu|us|ca|ch|at|se|no|pl|pt|br|jp|cn|in|au)$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def located(text: Column, pattern: str, hint: str) -> Column:
    """Matches of a pattern with code point offsets: array of (start, end, hit, before, after); before
    and after are up to 16 characters since or until the next match."""
    kind = "array<struct<start:long,end:long,hit:string,before:string,after:string>>"

    def of(x: Column) -> Column:
        hits, parts = x["hits"], x["parts"]
        ends = sums(F.transform(hits, lambda h, i: (F.length(F.get(parts, i)) + F.length(h)).cast("long")))
        one = lambda h, e, i: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit"), F.right(F.get(parts, i), F.lit(16)).alias("before"), F.left(F.get(parts, i + 1), F.lit(16)).alias("after"))
        return let(ends, lambda e: F.transform(hits, lambda h, i: one(h, F.get(e, i), i)))

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("parts")), of)
    return F.when(text.rlike(hint) & text.rlike(pattern), found.cast(kind)).otherwise(F.array().cast(kind))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits(hit))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, order, end) of the strict spans of all kinds, sorted; order: place in KINDS."""

    def of(k: int, kind: str) -> Column:
        good = F.filter(located(text, BASE[kind], HINT[kind]), lambda s: valid(kind, s["hit"]))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("order"), s["end"].alias("end")))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def candidates(text: Column) -> Column:
    """Array of (start, order, end, passes, features) that the wide generators propose."""

    def of(k: int, kind: str) -> Column:
        return F.transform(located(text, WIDE[kind], HINT[kind]), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("order"), s["end"].alias("end"), passes(kind, s["hit"]).alias("passes"), _features(k, s).alias("features")))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def passes(kind: str, hit: Column) -> Column:
    """Whether a candidate's content checks out; the trees do not see this."""
    if kind == "email":
        return hit.rlike(_TOP)
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:[ .,]+{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits(hit))
    return F.length(digits(hit)).between(10, 13)


def _features(k: int, s: Column) -> Column:
    hit, before = s["hit"], s["before"]
    n = F.length(digits(hit))
    signs = F.length(F.regexp_replace(hit, "[0-9A-Za-z]", ""))
    edge = lambda c: F.when(c == "", 0).when(c.rlike("[\\s]"), 1).when(c.rlike("[A-Za-z0-9]"), 2).otherwise(3)
    # How many digits a card or phone number has is part of its check.
    count = F.lit(0) if KINDS[k] == "phone" else F.when(n < 4, 0).when(n < 9, 1).when(n < 12, 2).when(n < 16, 3).when(n == 16, 4).otherwise(5)
    own = (
        F.lit(k), count, F.when(signs == 0, 0).when(signs <= 3, 1).when(signs <= 6, 2).otherwise(3), hit.startswith("+").cast("int"), hit.contains("(").cast("int"),
        edge(F.right(before, F.lit(1))), edge(F.left(F.coalesce(s["after"], F.lit("")), F.lit(1))), F.lower(before).rlike(_WORDS).cast("int"), hit.rlike("[A-Z]").cast("int"), (~before.rlike("[0-9]")).cast("int"),
    )
    return F.struct(*[c.alias(name) for c, name in zip(own, FEATURES, strict=True)])


# --- boosting over cells ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Boosted trees of two levels: (feature, limit, [(feature, limit, low, high)] of both sides)."""

    start: float
    trees: tuple
    limits: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, t, sides in self.trees:
            for side, (g, u, low, high) in zip((x[:, f] <= t, x[:, f] > t), sides, strict=True):
                out += side * np.where(x[:, g] <= u, low, high)
        return out

    def column(self, features: Column) -> Column:
        def leaf(side: tuple) -> Column:
            g, u, low, high = side
            return F.when(features[FEATURES[g]] <= u, F.lit(low)).otherwise(F.lit(high))

        out = F.lit(self.start)
        for f, t, (one, two) in self.trees:
            out = out + F.when(features[FEATURES[f]] <= t, leaf(one)).otherwise(leaf(two))
        return out

    def accepts(self, candidate: Column) -> Column:
        """Whether a candidate passes its check and is of a shape and context that do so far above chance."""
        limit = F.element_at(F.array(*[F.lit(x) for x in self.limits]), candidate["order"] + 1)
        return candidate["passes"] & (self.column(candidate["features"]) >= limit)


def fit(cells: list[tuple], rounds: int = 24, rate: float = 0.3, precision: float = 0.9) -> Trees:
    """Trees from cells (features..., held out, rows, rows that pass). A kind's threshold goes down through the
    scores of its held-out candidates, ``POOL`` or more at a time, while of those that pass ``precision``
    do so not by chance: of a share p of true ones, p + (1 - p) * chance pass. Without any it adds nothing."""
    if not cells:
        return Trees(0.0, (), (float("inf"),) * len(KINDS))
    table = np.array(sorted(cells), float)
    x, held, n, y = table[:, : len(FEATURES)], table[:, -3] > 0, table[:, -2], table[:, -1]
    n_fit = np.where(held, 0, n) if (~held).any() else n
    y_fit = np.where(held, 0, y) if (~held).any() else y
    rate0 = (y_fit.sum() + 1) / (n_fit.sum() + 2)
    start = float(np.log(rate0 / (1 - rate0)))
    score, trees = np.full(len(x), start), []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        total = (g[rows].sum() ** 2) / (h[rows].sum() + 1)
        found = (0.0, 0, float("inf"))
        for f in range(x.shape[1]):
            for t in np.unique(x[rows, f])[:-1]:
                left = rows & (x[:, f] <= t)
                right = rows & ~left
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - total
                if gain > found[0] + 1e-9:
                    found = (gain, f, float(t))
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y_fit - n_fit * p, n_fit * p * (1 - p)
        every = np.ones(len(x), bool)
        gain, f, t = best(every, g, h)
        if not gain:
            break
        sides = []
        for rows in (x[:, f] <= t, x[:, f] > t):
            _, f2, t2 = best(rows, g, h)
            low, high = rows & (x[:, f2] <= t2), rows & (x[:, f2] > t2)
            sides.append((f2, t2, *(float(rate * g[s].sum() / (h[s].sum() + 1)) for s in (low, high))))
        trees.append((f, t, tuple(sides)))
        score = Trees(start, tuple(trees), ()).score(x)
    limits = []
    for k in range(len(KINDS)):
        own = (x[:, 0] == k) & (held if held.any() else True)
        limit, kept, good = float("inf"), 0.0, 0.0
        levels = sorted(set(score[own]), reverse=True)
        for s in levels:
            kept += n[own & (score == s)].sum()
            good += y[own & (score == s)].sum()
            if kept < POOL and s != levels[-1]:
                continue
            rate, chance = good / max(kept, 1.0), CHANCE[k]
            if not rate or (rate - chance) / (1 - chance) < precision * rate:
                break
            limit, kept, good = float(s) - 1e-9, 0.0, 0.0
        limits.append(limit)
    return Trees(start, tuple(trees), tuple(limits))


def train(found: DataFrame) -> Trees:
    """Trees from rows with ``id`` and ``wide``: one in five documents, by hash of the id, is held out."""
    rows = found.where(F.size("wide") > 0).select("id", F.explode("wide").alias("c"))
    cells = rows.groupBy(*[F.col(f"c.features.{f}").alias(f) for f in FEATURES], (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).cast("int").alias("held"))
    return fit([tuple(r) for r in cells.agg(F.count("*"), F.sum(F.col("c.passes").cast("int"))).collect()])


def chosen(base: Column, wide: Column, trees: Trees) -> Column:
    """The base spans and every accepted candidate that no base span of its kind covers, sorted."""
    covered = lambda c: F.exists(base, lambda b: (b["order"] == c["order"]) & (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
    plain = F.transform(F.filter(wide, lambda c: trees.accepts(c) & ~covered(c)), lambda c: F.struct(c["start"].alias("start"), c["order"].alias("order"), c["end"].alias("end")))
    return F.array_sort(F.array_distinct(F.concat(base, plain)))


def _proposed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return cut(docs.select(F.col(id_col).alias("id"), base_spans(text).alias("base"), candidates(text).alias("wide")), "candidates")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, ``base`` and ``spans``: sorted arrays of (start, order, end), offsets in
    code points, end exclusive. spans: the base and every accepted candidate no base span covers.

    Null texts are empty and have no spans. Repeated rows give a row each. Other columns are not read.
    """
    found = _proposed(docs, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), "base", chosen(F.col("base"), F.col("wide"), train(found)).alias("spans"))


def said(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text, of rows as ``find`` gives them: empty arrays
    give zeros, the hash of nothing and an empty text; repeated rows and null ids come out each."""

    def of(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["order"] == k)).cast("long")

    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[{}]") -> DataFrame:
    """doc_id and ``text`` with every span, merged where they overlap, replaced by the name of its first kind.

    Spans are found and cut in their own row: rows that repeat an id, or have none, are each redacted by
    their own text. Null texts stay null, empty ones empty; an empty table gives no rows.
    """
    trees = train(_proposed(docs, id_col, text_col))
    names = F.array(*[F.lit(mask.format(k)) for k in KINDS])

    def masked(text: Column, spans: Column) -> Column:
        part = lambda at, n: F.substr(text, (at + 1).cast("int"), n.cast("int"))

        def piece(s: Column, before: Column) -> Column:
            return F.when(s["start"] >= before, F.concat(part(before, F.greatest(s["start"] - before, F.lit(0).cast("long"))), F.element_at(names, s["order"] + 1))).otherwise("")

        ends = maxima(F.transform(spans, lambda s: s["end"]))
        whole = lambda e: F.concat(F.array_join(F.transform(spans, lambda s, i: piece(s, F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(e, i - 1)))), ""), part(F.element_at(e, -1), F.length(text)))
        return F.when(F.size(spans) > 0, let(ends, whole)).otherwise(text)

    def of(text: Column) -> Column:
        found = let(base_spans(text), lambda b: let(candidates(text), lambda w: chosen(b, w, trees)))
        return let(found, lambda spans: masked(text, spans))

    return docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).isNotNull(), of(F.coalesce(F.col(text_col), F.lit("")))).alias("text"))
