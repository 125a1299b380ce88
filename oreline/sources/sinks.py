"""What searches give out: JSON lines, text lines, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def result_json(matches: DataFrame) -> DataFrame:
    """``value``: an object per match with the fixed names of the format; null fields are left out."""
    names = {"matched_text": "matchedText", "original": "searchTerm", "line_number": "lineNumber", "column": "column", "context_before": "contextBefore", "context_after": "contextAfter", "path": "path", "repo": "repo", "org": "org"}
    return matches.select(F.to_json(F.struct(*[F.col(k).alias(v) for k, v in names.items() if k in matches.columns])).alias("value"))


#: Terminal colours of the parts of a line.
COLOURS = {"path": "\x1b[35m", "number": "\x1b[32m", "match": "\x1b[1;31m"}
_PLAIN = "\x1b[0m"


def _coloured(c: Column, part: str, colour: bool) -> Column:
    return F.concat(F.lit(COLOURS[part]), c, F.lit(_PLAIN)) if colour else c


def text_line(matches: DataFrame, path: bool = True, line: bool = True, column: bool = False, keyword: bool = False, colour: bool = False) -> Column:
    """``[path:][line:][column:][keyword:]context`` of a match, in terminal colours if asked for."""
    parts = [_coloured(F.col(c).cast("string"), part, colour) for c, want, part in (("path", path, "path"), ("line_number", line, "number"), ("column", column, "number"), ("original", keyword, "number")) if want]
    shown = F.concat(*[_coloured(F.col(c), "match", colour and c == "matched_text") for c in ("context_before", "matched_text", "context_after") if c in matches.columns])
    return F.concat_ws(":", *parts, shown)


def text_output(matches: DataFrame, heading: bool = False, line: bool = True, column: bool = False, keyword: bool = False, colour: bool = False) -> DataFrame:
    """``path, ord, value``: the lines of a text report; sorted by path and ord they are the report.

    heading: the path stands once above its matches instead of in each line. Matches of histories (columns
    branch, first_commits, last_commit, on_tip, tags) are followed by a line per branch and one of tags.
    """
    at = ["line_number", "column", "original"]
    order = F.struct(*[F.col(c) for c in at if c in matches.columns])
    rows = matches.select("path", F.struct(F.lit(1).alias("level"), order.alias("at"), F.lit(0).alias("part"), F.lit("").alias("branch")).alias("ord"), text_line(matches, not heading, line, column, keyword, colour).alias("value")).distinct()
    if heading:
        top = matches.groupBy("path").agg(F.min(order).alias("at")).select("path", F.struct(F.lit(0).alias("level"), "at", F.lit(0).alias("part"), F.lit("").alias("branch")).alias("ord"), _coloured(F.col("path"), "path", colour).alias("value"))
        rows = rows.unionByName(top)
    if "branch" in matches.columns:
        said = F.concat(F.lit("  "), F.coalesce("branch", F.lit("(no branch)")), F.lit(": first "), F.array_join("first_commits", " "), F.when(F.col("on_tip"), F.lit(", still there")).otherwise(F.concat(F.lit(", last "), "last_commit")))
        rows = rows.unionByName(matches.select("path", F.struct(F.lit(1).alias("level"), order.alias("at"), F.lit(1).alias("part"), F.coalesce("branch", F.lit("")).alias("branch")).alias("ord"), said.alias("value")))
    if "tags" in matches.columns:
        tagged = matches.where(F.size("tags") > 0)
        rows = rows.unionByName(tagged.select("path", F.struct(F.lit(1).alias("level"), order.alias("at"), F.lit(2).alias("part"), F.lit("").alias("branch")).alias("ord"), F.concat(F.lit("  tags: "), F.array_join("tags", " ")).alias("value")).distinct())
    return rows


def stats(matches: DataFrame, files: DataFrame, path: str = "path", data: str = "data") -> DataFrame:
    """One row: matches, files with some, files and bytes searched."""
    searched = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length(data)), F.lit(0)).alias("bytes"))
    found = matches.agg(F.count("*").alias("matches"), F.count_distinct(path).alias("files_with_matches"))
    return found.join(searched)  # a row each


def footer(row, seconds: float) -> str:
    """The closing line of a report, of a row of ``stats`` and the time that was taken."""
    return f"{row.matches} matches in {row.files_with_matches} of {row.files} files, {row.bytes} bytes in {seconds:.2f} s, {row.bytes / 1e6 / max(seconds, 1e-9):.1f} MB/s"


def observed(matches: DataFrame, name: str = "search") -> tuple[DataFrame, Observation]:
    """``matches`` with counts of rows, and of rows by what the least and greatest term are, once it has run."""
    seen = Observation(name)
    return matches.observe(seen, F.count("*").alias("matches"), F.min("original").alias("least"), F.max("original").alias("greatest")), seen
