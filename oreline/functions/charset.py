"""Character sets: which characters make up words, and the key under which words are equal."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from enum import StrEnum

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


class CharacterSet(StrEnum):
    PACKAGE = "package"
    URL = "url"
    DOMAIN = "domain"
    INPUT = "input"


class Match(StrEnum):
    EXACT = "exact"
    NORMALIZED = "normalized"
    TYPO = "typo-only"
    BOTH = "normalized-and-typo"


@dataclass(frozen=True)
class Alphabet:
    """The characters of words (body of a regular-expression class) and what their keys ignore."""

    kind: CharacterSet
    body: str
    fold: bool
    collapse: bool
    merged: str = ""

    def key(self, word: Column) -> Column:
        """The key of words as they stand in texts: only literal ``--`` collapses."""
        out = F.lower(word) if self.fold else word
        out = F.regexp_replace(out, "-+", "-") if self.collapse else out
        return F.translate(out, self.merged, "-" * len(self.merged)) if self.merged else out

    def variation_key(self, variation: str) -> str:
        """The key of a keyword's variation, whose delimiters ``normalized`` has dealt with."""
        out = variation.lower() if self.fold else variation
        return out.translate({ord(c): "-" for c in self.merged})

    def normalized(self, term: str) -> str:
        """A term with its characters checked, folded, and for packages with runs of delimiters made one ``-``."""
        if bad := regex.search(f"[^{self.body}]", term):
            raise ValueError(f"invalid character '{bad.group()}' in '{term}'")
        out = term.lower() if self.fold else term
        return re.sub("[-._]+", "-", out) if self.kind == CharacterSet.PACKAGE and self.fold else out

    def tokens(self, text: Column) -> Column:
        """Runs of word characters and runs of others, in turn: joined they are the text."""
        return F.regexp_extract_all(text, F.lit(f"[{self.body}]+|[^{self.body}]+"), F.lit(0))

    def is_word(self, token: Column) -> Column:
        return token.rlike(f"^[{self.body}]")


def alphabet(kind: CharacterSet, match: Match, terms: Iterable[str] = ()) -> Alphabet:
    """The alphabet of a character set; that of ``input`` follows from the terms.

    Digits count wherever a term has one, also without letters; non-ASCII letters match whatever
    their case in the terms.
    """
    exact = match == Match.EXACT
    if kind == CharacterSet.PACKAGE:
        return Alphabet(kind, r"A-Za-z0-9._\-", not exact, not exact, "" if exact else "._")
    if kind == CharacterSet.URL:
        return Alphabet(kind, r"A-Za-z0-9/:?#@._\-", not exact, False)
    if kind == CharacterSet.DOMAIN:
        return Alphabet(kind, r"A-Za-z0-9.\-\p{L}\p{N}", not exact, not exact)
    used = set("".join(terms))
    wide = any(ord(c) > 127 for c in used)
    body = r"\p{L}\p{N}" if wide else ""
    if exact:
        body += "A-Za-z0-9" if any(c.isascii() and c.isalpha() for c in used) else "0-9" if any(c.isascii() and c.isdigit() for c in used) else ""
        extra = {c for c in used if c.isascii() and not c.isalnum()}
        return Alphabet(kind, body + "".join(re.escape(c) for c in sorted(extra)), False, False)
    extra = {c for c in used if c.isascii() and not c.isalnum()} | set("-._")
    merged = "" if any(c in used for c in "-._") else "._"
    return Alphabet(kind, body + "A-Za-z0-9" + "".join(re.escape(c) for c in sorted(extra)), True, True, merged)
