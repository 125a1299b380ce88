"""Quality by weak labels: heuristic labellers vote, EM estimates their accuracies, a hashed linear
scorer learns the posterior.

EM runs over vote patterns, of which there are at most three to the number of labellers, counted
over all rows. The scorer hashes words and their shapes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import least_hashes, numbered, restored

WEIGHTS = 1 << 16
#: Different texts that the scorer is fitted on, those of least hash, and features they have in all.
SAMPLE, ENTRIES = 12_000, 20_000_000
#: Scores from here are kept.
LEAST = 0.4
LABELLERS = ("symbols", "capitals", "bars", "clean_words", "repeats", "runs", "variety", "length", "word_length", "sentences")
#: What share of rows EM takes for good before it has seen any.
PRIOR = 0.8

_SHAPE = bytes(32 if b in b" \t\n\r\v\f" else 97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))
#: The shape of a word that may carry a bracket or quote before and a sign behind.
_CLEAN = re.compile(rb"[\"'(\[]?(?:[aA]a*|0+)(?:['-][aA]a*)*[.,;:!?)\]\"']?")


def measures(text: str | None) -> dict[str, float]:
    """What the labellers look at, over the whole text."""
    raw = (text or "").encode()
    shape = raw.translate(_SHAPE)
    words, solid = shape.split(), max(len(raw) - shape.count(b" "), 1)
    letters = shape.count(b"a") + shape.count(b"A")
    lines = [x for x in raw.replace(b". ", b"\n").split(b"\n") if x.strip()]
    n = len(words)
    return {
        "words": n, "symbols": (solid - letters - shape.count(b"0")) / solid, "capitals": shape.count(b"A") / max(letters, 1), "bars": words.count(b"|") / max(n, 1), "distinct": len(set(lines)) / max(len(lines), 1),
        "runs": sum(map(eq, words, words[1:])) / max(n, 1), "variety": len(set(words)) / max(min(n, 100), 1), "clean": sum(c for w, c in Counter(words).items() if _CLEAN.fullmatch(w)) / max(n, 1), "word_length": solid / max(n, 1), "stops": sum(shape.count(x) for x in (b".", b"?", b"!")) / max(n, 1),
    }


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """Of each labeller: 1 good, -1 bad, 0 abstains. A text without words is bad to all that vote.

    Labellers of one defect abstain on texts without it; only words, sentences and length vouch.
    """
    if not m["words"]:
        return (0, 0, 0, -1, 0, 0, 0, -1, -1, -1)
    pick = lambda bad, good: -1 if bad else int(good)
    return (
        pick(m["symbols"] > 0.15, False), pick(m["capitals"] > 0.4, False), pick(m["bars"] > 0.05, False), pick(m["clean"] < 0.8, m["clean"] > 0.9), pick(m["distinct"] < 0.5, False),
        pick(m["runs"] > 0.3, False), pick(m["variety"] < 0.2, False), pick(False, m["words"] >= 30), pick(m["word_length"] > 14 or m["word_length"] < 2, False), pick(m["stops"] > 0.5, 0.01 <= m["stops"] <= 0.4),
    )


def em(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Chance that a pattern is of a good text, votes taken as independent given the truth."""
    if not patterns:
        return {}
    v, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    good = 1 / (1 + np.exp(-(v.sum(1) - 0.5)))
    for _ in range(rounds):
        share = (n @ good + 10 * PRIOR) / (n.sum() + 10)
        logs = np.log([share, 1 - share])[:, None] * np.ones(len(v))
        for j in range(v.shape[1]):
            for k, w in enumerate((n * good, n * (1 - good))):
                # Each labeller is taken to be right a little more often than not.
                lean = (0.5, 1.0, 1.5) if k == 0 else (1.5, 1.0, 0.5)
                p = [(w[v[:, j] == x].sum() + lean[x + 1]) / (w.sum() + 3) for x in (-1, 0, 1)]
                logs[k] += np.log(p)[v[:, j] + 1]
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return {p: float(g) for p, g in zip(patterns, good, strict=True)}


def features(text: str | None, voted: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots and values of a text: words, shapes and votes, with root frequencies."""
    raw = (text or "").encode()
    out: Counter[int] = Counter()
    for tag, words in ((1, raw.lower().split()), (2, raw.translate(_SHAPE).split())):
        for w, c in Counter(words).items():
            out[zlib.crc32(w, tag) % WEIGHTS] += c / len(words)
    for j, x in enumerate(votes(measures(text)) if voted is None else voted):
        out[zlib.crc32(b"%d:%d" % (j, x), 3) % WEIGHTS] += 1
    out[zlib.crc32(b"bias", 4) % WEIGHTS] += 1
    return np.fromiter(out, np.int64, len(out)), np.sqrt(np.fromiter(out.values(), float, len(out)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 4, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic scorer of these features and target chances, by stochastic gradient (AdaGrad)."""
    w, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-3)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            g = (1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30))) - y) * x
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
    return w


def _vote_column(text: Column) -> Column:
    @F.arrow_udf("int")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([code_of(votes(measures(t.as_py()))) for t in texts], pa.int32())

    return compute(text)


def code_of(pattern: tuple[int, ...]) -> int:
    """A vote pattern as a number to the base of three."""
    code = 0
    for v in pattern:
        code = code * 3 + v + 1
    return code


def pattern_of(code: int) -> tuple[int, ...]:
    return tuple(code // 3**j % 3 - 1 for j in reversed(range(len(LABELLERS))))


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray]:
    """Posterior by vote code, from all rows; weights from up to ``sample`` of them."""
    rows = docs.select(F.col(text_col).alias("t"), _vote_column(F.col(text_col)).alias("v"))
    codes = {v: n for v, n in rows.groupBy("v").count().collect()}  # at most 3^10 rows
    good = em({pattern_of(c): n for c, n in codes.items()})
    by_code = {c: good[pattern_of(c)] for c in codes}
    hashed = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col, F.lit(11)).alias("h")).where("t is not null")
    last = least_hashes(hashed, sample)
    if last is None:
        return by_code, np.zeros(WEIGHTS)

    @F.arrow_udf("struct<at:array<long>,x:array<double>,v:int>")
    def compute(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            voted = votes(measures(t.as_py()))
            at, x = features(t.as_py(), voted)
            code = code_of(voted)
            out.append({"at": at.tolist(), "x": x.tolist(), "v": code})
        return pa.array(out, pa.struct([("at", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("v", pa.int32())]))

    picked = hashed.where(F.col("h") <= last).dropDuplicates(["h"]).select(compute("t").alias("f"), "h").select("f.*", "h").toLocalIterator()
    fitted = sorted(((r.h, np.array(r.at, np.int32), np.array(r.x, np.float32), by_code.get(r.v, PRIOR)) for r in picked), key=lambda r: r[0])
    most = np.cumsum([len(r[1]) for r in fitted])
    return by_code, fit([r[1:] for r, n in zip(fitted, most, strict=True) if n <= ENTRIES])


def scored(docs: DataFrame, text_col: str = "text", least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a column ``_quality``: struct of posterior (of its votes), score and keep.

    Null and empty texts vote as wordless and score low; very long ones are read whole; repeated rows
    come out each. An empty table gives no rows.
    """
    docs, names = numbered(docs)
    text_col = names[text_col]
    by_code, weights = train(docs, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast((by_code, weights))

    @F.arrow_udf("struct<posterior:double,score:double>")
    def compute(texts: pa.Array) -> pa.Array:
        known, w = shared.value
        posterior, score = [], []
        for t in texts:
            text = t.as_py()
            voted = votes(measures(text))
            code = code_of(voted)
            at, x = features(text, voted)
            posterior.append(known.get(code, PRIOR))
            score.append(float(1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30)))))
        return pa.StructArray.from_arrays([pa.array(posterior), pa.array(score)], names=["posterior", "score"])

    found = docs.withColumn("_q", compute(F.col(text_col)))
    return restored(found.withColumn("_quality", F.struct("_q.posterior", "_q.score", (F.col("_q.score") >= least).alias("keep"))), names, "_quality")
