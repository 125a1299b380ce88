"""Path, repository and word filters, and searches that a path chooses."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """All before the last ``/``; ``.`` where there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/", 1)).otherwise(".")


def extension(path: Column) -> Column:
    """From the last dot of the last part on, dot included; empty without one."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


_KINDS = {"path": lambda c: c, "directory": directory, "extension": extension, "name": base_name}


def classify(pattern: str) -> tuple[str, str]:
    """Kind and value of a path pattern: ``/x/`` directory, ``/x`` path, ``.x`` extension, else file name. ``/`` is the root."""
    if not pattern:
        raise ValueError("empty path pattern")
    if pattern.startswith("/"):
        value = pattern.strip("/")
        return ("directory", value or ".") if pattern.endswith("/") else ("path", value)
    if pattern.startswith("."):
        if "." in pattern[1:]:
            raise ValueError(f"more than one dot in extension '{pattern}'")
        return "extension", pattern
    return "name", pattern


@dataclass(frozen=True)
class PathFilter:
    """Included and excluded patterns; kinds are ANDed, exclusion wins, no inclusion of a kind includes all."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    sub_path: str = ""

    def condition(self, path: Column) -> Column:
        out = path.startswith(self.sub_path) if self.sub_path else F.lit(True)
        for kind, of in _KINDS.items():
            for patterns, keep in ((self.exclude, False), (self.include, True)):
                values = [v for k, v in map(classify, patterns) if k == kind]
                if values:
                    out = out & (of(path).isin(values) if keep else ~of(path).isin(values))
        return out


def select_repos(repos: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Rows of (org, repo, ...) whose ``org/repo`` or ``repo`` is included and not excluded; none left is an error."""
    full, include, exclude = F.concat_ws("/", "org", "repo"), list(include), list(exclude)
    named = lambda names: full.isin(names) | F.col("repo").isin(names)
    out = repos
    if include:
        out = out.where(named(include))
    if exclude:
        out = out.where(~named(exclude))
    if out.isEmpty():
        raise ValueError("no repositories left to search")
    return out


def exclude_words(matches: DataFrame, words: Iterable[str]) -> DataFrame:
    """Matches whose lower-cased text is none of these words."""
    words = [w.lower() for w in words]
    return matches.where(~F.lower("matched_text").isin(words)) if words else matches


@dataclass(frozen=True)
class Dork:
    """A term for files that a path pattern chooses; ``anything`` for all files."""

    kind: str
    value: str
    term: str

    @classmethod
    def parse(cls, text: str) -> Dork:
        path, colon, term = text.partition(":")
        if not colon or ":" in term or not term:
            raise ValueError(f"a dork has the form path:term, got '{text}'")
        return cls("anything", "", term) if path in ("", "*") else cls(*classify(path), term)


def dork_groups(dorks: list[Dork]) -> list[tuple[tuple[str, str], list[str]]]:
    """Searches to run: all ``anything`` terms share one, every other dork has its own."""
    shared = [d.term for d in dorks if d.kind == "anything"]
    return ([(("anything", ""), shared)] if shared else []) + [((d.kind, d.value), [d.term]) for d in dorks if d.kind != "anything"]


def route(dork: tuple[str, str], path: Column) -> Column:
    """Whether a search's pattern chooses a path."""
    kind, value = dork
    return F.lit(True) if kind == "anything" else _KINDS[kind](path) == value


def routes(groups: list[tuple[tuple[str, str], list[str]]], path: Column) -> Column:
    """The places in ``groups`` of the searches that a path is for, as an array."""
    return F.filter(F.array(*[F.when(route(dork, path), F.lit(k)) for k, (dork, _) in enumerate(groups)]), lambda x: x.isNotNull())


def owner_and_repo(url: Column) -> Column:
    """Owner and repository of ``https://github.com/owner[/repo]``, else null; trailing ``/`` and ``.git`` go."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, "^https://github\\.com/(.+)$", 1), "/$", ""), "\\.git$", "")
    parts = F.split(rest, "/")
    good = (rest != "") & (F.size(parts) <= 2)
    return F.when(good, F.struct(parts[0].alias("owner"), F.get(parts, F.lit(1)).alias("repo")))


def remote_owner_and_repo(url: Column) -> Column:
    """Owner and repository of an https or ``git@`` remote with exactly two parts, else null."""
    found = F.regexp_replace(F.regexp_extract(url, r"^(?:https://github\.com/|git@github\.com:)([^/]+/[^/]+?)/?$", 1), "\\.git$", "")
    parts = F.split(found, "/")
    return F.when(found != "", F.struct(parts[0].alias("owner"), parts[1].alias("repo")))


def is_sha1(c: Column) -> Column:
    return c.rlike("^[a-f0-9]{40}$")


def is_sha512(c: Column) -> Column:
    return c.rlike("^[a-f0-9]{128}$")


def is_semver(c: Column) -> Column:
    return c.rlike(r"^v\d+\.\d+\.\d+$")


def is_repository_uri(c: Column) -> Column:
    return c.rlike(r"^git\+(https|ssh)://[^?#]*\.git$")


def branch_name(ref: Column) -> Column:
    return F.regexp_replace(ref, "^refs/(?:remotes/[^/]+|heads)/", "")


def with_scheme(uri: Column) -> Column:
    return F.when(uri.rlike("^https://"), uri).otherwise(F.concat(F.lit("https://"), uri))


def exclusive(**flags: object) -> None:
    """Options of which at most one may be set."""
    if len(given := [k for k, v in flags.items() if v]) > 1:
        raise ValueError("options exclude each other: " + ", ".join(given))


def checked_options(match: str = "normalized", *, terms: int = 0, dorks: int = 0, files: int = 0, anchored: bool = False, lines: int = 0, columns: int = 50, only_matching: bool = False, history: bool = False, branches: bool = False, json: bool = False, colour: bool = False) -> None:
    """Whether the options of a search go together; an error says which do not."""
    if not terms and not dorks and not files:
        raise ValueError("nothing to search: give terms, dorks or a file of terms")
    if dorks and anchored:
        raise ValueError("dorks are not anchored")
    exclusive(history=history, branches=branches)
    exclusive(json=json, colour=colour)
    if only_matching and lines:
        raise ValueError("lines of context need context")
    if lines < 0 or columns < 0:
        raise ValueError("context must not be negative")
    if match not in ("exact", "normalized", "typo-only", "normalized-and-typo"):
        raise ValueError(f"unknown match mode '{match}'")


def read_terms(text: str) -> list[str]:
    """Terms of a file or list: separated by line feeds or commas, trimmed; blank ones are left out."""
    return [t for t in (x.strip() for x in re.split("[\n,]", text)) if t]
