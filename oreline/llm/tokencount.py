"""Token counts by overlap resynchronisation.

Long texts are encoded in overlapping chunks with offsets, and neighbouring encodings are spliced at
a boundary that both have and that is proven to be one of the whole text's. Where the overlap has no
such boundary, it is widened, up to the whole text.

The proof: the vocabulary's encoder cuts a text into pieces by a pattern, from left to right and
without looking back, and merges bytes only inside a piece. A piece is white space alone, or at most
one blank followed by other characters. So a piece always starts at a blank or line feed that
follows something else than white space, and nothing to the left or right of it changes that.
Special strings hold no white space.

Shorter texts are cut at all such boundaries; the counts of segments, which repeat often, are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Code points in a chunk, and in the overlap of two.
CHUNK, OVERLAP = 1 << 14, 1 << 8
#: Texts of more code points than this are encoded in chunks.
WHOLE = 1 << 15
#: Segments whose counts are kept: their length, and how many at a time.
SEGMENT, KEPT = 64, 400_000
#: Characters that no library takes for white space.
_SOLID = "!-~\u00C0-\u024F"
_SEGMENT = re.compile("[ \n]+[^ \n]*|[^ \n]+")
_UNSURE = re.compile(f"[^{_SOLID} \n](?=[ \n])")
_SURE = re.compile(f"(?<=[{_SOLID}])(?=[ \n])")
_loaded: dict[str, Counts] = {}


class Counts(dict):
    """Tokens of each short segment, as the tokenizer gives them."""

    def __init__(self, path: str):
        """The vocabulary at ``path``, without truncation or padding; special strings keep the file's default."""
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def __missing__(self, segment: str) -> int:
        n = len(self.tok.encode(segment, add_special_tokens=False))
        if len(segment) <= SEGMENT:
            if len(self) >= KEPT:
                self.clear()
            self[segment] = n
        return n

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = self.tok.encode(text, add_special_tokens=False)
        return found.ids, found.offsets


def counts(path: str) -> Counts:
    if path not in _loaded:
        _loaded[path] = Counts(path)
    return _loaded[path]


def safe(text: str, at: int) -> bool:
    """Whether a piece of the whole text starts at ``at``, whatever is further away."""
    return 0 < at < len(text) and _SURE.match(text, at) is not None


def splice(text: str, encode: Callable[[str], tuple[list[int], list[tuple[int, int]]]], chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[int]:
    """The ids of ``encode(text)`` from overlapping chunks. encode: ids and code point offsets of a text."""
    start, done = 0, 0  # of the chunk; where the ids given so far end
    while True:
        stop = min(len(text), start + chunk)
        ids, offsets = encode(text[start:stop])
        begins = {start + a: k for k, (a, _) in reversed(list(enumerate(offsets)))}
        if stop == len(text):
            yield from ids[begins[done] if done < len(text) else len(ids) :]
            return
        width = overlap
        while True:  # a boundary that both this chunk and the next one, from stop - width, have
            low = max(start, stop - width)
            if low == start:
                chunk *= 2
                break
            after = {low + a for a, _ in encode(text[low : min(len(text), stop + width)])[1]}
            common = [at for at in range(stop - width // 4, low + width // 4, -1) if at in begins and at in after and at > done and safe(text, at)]
            if common:
                yield from ids[begins[done] : begins[common[0]]]
                start = done = common[0]
                break
            width *= 2


def count(text: str, kept: Counts, whole: int = WHOLE) -> int:
    """How many tokens a text has."""
    if len(text) > whole:
        return sum(1 for _ in splice(text, kept.encode))
    segments = _SURE.split(text) if _UNSURE.search(text) else _SEGMENT.findall(text)
    return sum(map(kept.__getitem__, segments))


def count_column(text: Column, path: str, whole: int = WHOLE) -> Column:
    """Tokens of a text as a long column; null and empty texts have none. path: a tokenizers file that every executor has."""

    @F.arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        kept = counts(path)
        return pa.array([count(t.as_py() or "", kept, whole) for t in texts], pa.int64())

    return compute(text)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens of the whole text, over_limit.

    Null texts count as empty: no bytes, no tokens. Repeated rows give a row each; other columns
    are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), count_column(F.col(text_col), path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
