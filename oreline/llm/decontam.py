"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item in at most twice as many states as the items
have words. A document streams through it once; the automaton tracks the longest run ending at each
word that some item has, so overlaps of any length come from one pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import cut, numbered, restored

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
#: The automaton travels to every executor: more benchmark words than this go in several automata, each
#: with a broadcast and a pass of its own; between passes the documents are stored.
WORDS_PER_AUTOMATON = 500_000


def words(text: str | None) -> list[str]:
    """Words of a text: A-Z folded, then runs of a-z, 0-9 and anything beyond ASCII. Null has none."""
    return _WORD.findall((text or "").translate(_FOLD))


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, with the windows that end in each state.

    ``marks[s]``: (length, items) of the windows that are a suffix of what state s has just read;
    a window holds only where the match is at least as long.
    """

    width: int
    vocabulary: dict[str, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    marks: list[tuple[tuple[int, frozenset], ...]] = field(default_factory=list)

    @classmethod
    def of(cls, items: Iterable[tuple[object, str | None]], width: int) -> Automaton:
        out = cls(width)
        texts = [(item, [out.vocabulary.setdefault(w, len(out.vocabulary)) for w in words(text)]) for item, text in items]
        texts = [(item, run) for item, run in texts if run]
        for _, run in texts:
            last = 0
            for x in run:
                last = out._extend(last, x)
        own: dict[int, dict[int, set]] = {}
        for item, run in texts:
            state, size, least = 0, 0, min(width, len(run))
            for k, x in enumerate(run):
                state, size = out.advance(state, size, x)
                if k + 1 >= least:
                    at = state
                    while out.length[out.link[at]] >= least:
                        at = out.link[at]
                    own.setdefault(at, {}).setdefault(least, set()).add(item)
        out.marks = [()] * len(out.step)
        for s in sorted(range(1, len(out.step)), key=out.length.__getitem__):
            mine = {k: frozenset(v) for k, v in own.get(s, {}).items()}
            above = out.marks[out.link[s]]
            out.marks[s] = tuple(sorted((mine | {k: v | mine.get(k, frozenset()) for k, v in above}).items(), key=lambda x: x[0])) if mine else above
        return out

    def _extend(self, last: int, x: int) -> int:
        step, link, length = self.step, self.link, self.length
        if x in step[last]:
            q = step[last][x]
            return q if length[q] == length[last] + 1 else self._split(last, q, x)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and x not in step[at]:
            step[at][x] = new
            at = link[at]
        if at >= 0:
            q = step[at][x]
            link[new] = q if length[q] == length[at] + 1 else self._split(at, q, x)
        return new

    def _split(self, at: int, q: int, x: int) -> int:
        twin = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[at] + 1)
        self.link[q] = twin
        while at >= 0 and self.step[at].get(x) == q:
            self.step[at][x] = twin
            at = self.link[at]
        return twin

    def advance(self, state: int, size: int, x: int) -> tuple[int, int]:
        """The state and the length of the longest match after one more word."""
        while state and x not in self.step[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.step[state].get(x)
        return (to, size + 1) if to is not None else (0, 0)

    def hits(self, run: list[int | None]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words inside occurrences of windows, merged, and the items these belong to."""
        step, link, length, marks = self.step, self.link, self.length, self.marks
        spans: list[tuple[int, int]] = []
        seen: set[frozenset] = set()
        state = size = 0
        for k, x in enumerate(run):
            if x is None:
                state = size = 0
                continue
            while state and x not in step[state]:
                state = link[state]
                size = length[state]
            to = step[state].get(x)
            if to is None:
                state = size = 0
                continue
            state, size = to, size + 1
            if marks[state]:
                most = 0
                for least, items in marks[state]:
                    if least > size:
                        break
                    most = least
                    seen.add(items)
                if most:
                    start = k + 1 - most
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, k + 1))
        return spans, set().union(*seen)


def automata(benchmark: DataFrame, width: int = 13, id_col: str = "item_id", text_col: str = "text") -> Iterator[Automaton]:
    """Automata of all items, each of at most ``WORDS_PER_AUTOMATON`` words and one item.

    Items reach the driver one partition at a time, and one automaton is built at a time. Null or
    wordless items have no windows; an item with a null id counts under the empty name; items that
    share an id count once. An empty benchmark gives one empty automaton.
    """
    part, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        n = len(words(text))
        if part and size + n > WORDS_PER_AUTOMATON:
            yield Automaton.of(part, width)
            part, size = [], 0
        part.append((item, text))
        size += n
    yield Automaton.of(part, width)


_MATCH = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>,clean:string>"


def _scan(shared, clean: bool):
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("clean", pa.string())])

    @F.arrow_udf(_MATCH)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        machine, out = shared.value, []
        number = machine.vocabulary.get
        for text, old in zip(texts, before.to_pylist(), strict=True):
            text = text.as_py()
            run = words(text)
            spans, items = machine.hits(list(map(number, run)))
            if old:
                spans, items = merged([(s["start"], s["end"]) for s in old["spans"]] + spans), items | set(old["items"])
            out.append({"n_words": len(run), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items), "clean": without_spans(text, spans) if clean and spans else None})
        return pa.array(out, kind)

    return scan.asNondeterministic()  # or the optimizer runs it once for a filter and again for the columns


def matched(rows: DataFrame, text: str, benchmark: DataFrame, width: int, clean: bool = False) -> DataFrame:
    """``rows`` with ``m``: a text's number of words, the merged word spans inside window occurrences, the items hit
    (sorted) and, with ``clean``, the text without the spans, null where there are none."""
    before = None
    rows = rows.withColumn("m", F.lit(None).cast(_MATCH))
    for machine in automata(benchmark, width):
        if before is not None:
            rows = cut(rows, "pass")
            before.unpersist()
        before = rows.sparkSession.sparkContext.broadcast(machine)
        rows = rows.withColumn("m", _scan(before, clean)(F.col(text), F.col("m")))
    return rows


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted names), spans, contaminated.

    A window is ``width`` consecutive words of an item, or a shorter item whole. contaminated: some
    word is hit and hits are at least ``share`` of the words. Null and empty texts have no words;
    repeated rows give a row each; an empty benchmark hits nothing. Other columns are not read.
    """
    found = matched(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", benchmark, width)
    found = found.select("doc_id", "m.n_words", _n_hit().alias("n_hit"), F.size("m.items").cast("long").alias("n_items"), "m.items", "m.spans")
    return found.withColumn("contaminated", _reaches(F.col("n_hit"), F.col("n_words"), share))


def _n_hit() -> Column:
    return F.aggregate("m.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _reaches(n_hit: Column, n_words: Column, share: float) -> Column:
    """Whether hits are at least ``share`` of the words, in whole numbers: the share is what its decimals say."""
    part = Fraction(str(share))
    return (n_hit > 0) & (n_hit * part.denominator >= n_words * part.numerator)


def without_spans(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """The text without the words of these spans and what lies between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: float = 0.05, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without contaminated rows, and without the hit spans in the texts that stay.

    Untouched texts and all other columns stay as they are; ``length_col``, where there is one,
    follows the shortened texts. Nulls and empty texts stay, repeated rows each; an empty benchmark
    changes nothing and an empty table gives no rows.
    """
    rows, names = numbered(docs)
    text = names[text_col]
    rows = matched(rows, text, benchmark, width, clean=True).where(~_reaches(_n_hit(), F.col("m.n_words"), share))
    changed = {text: F.coalesce(F.col("m.clean"), F.col(text))}
    if length_col and (length := names.get(length_col)):
        changed[length] = F.when(F.col("m.clean").isNull(), F.col(length)).otherwise(F.length("m.clean")).cast(docs.schema[length_col].dataType)
    return restored(rows.withColumns(changed), names)


def names_hash(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(text: str | None, items: list[tuple[object, str | None]], width: int = 13) -> tuple[int, int, int, str, bool]:
    """What ``contamination`` must give for a text, from comparing every window with every place."""
    found = words(text)
    hit, names = set(), set()
    for item, other in items:
        run = words(other)
        size = min(width, len(run))
        for i in range(len(run) - size + 1 if run else 0):
            for k in range(len(found) - size + 1):
                if found[k : k + size] == run[i : i + size]:
                    hit |= set(range(k, k + size))
                    names.add("" if item is None else str(item))
    return len(found), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(found)


_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_FOLDED} AS w FROM benchmark) WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS run FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM b)),
doc AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hit AS (SELECT doc_id, doc.n, i, item_id FROM doc JOIN item ON doc.n = item.n AND doc.run = item.run),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(names), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
