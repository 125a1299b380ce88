"""Search of many terms in texts: exact, normalised and with typing errors.

Of few keys, one regular expression finds the words that may be hits; they are held against the keys,
told apart and given their place inside their row, and nothing is shuffled. Of many keys, texts are
cut into all their words, which meet the keys in a join with their table.
Offsets and columns count bytes of UTF-8, lines count from 1.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreline.functions import variations as V
from oreline.functions.arrays import let, maxima, sums
from oreline.functions.charset import Alphabet, CharacterSet, Match, alphabet
from oreline.functions.tlds import installed_tlds
from oreline.operators import filters

#: Bytes of strings up to which the keyword table is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Keys up to which words are checked in their row, by a set in the plan.
LITERAL_KEYS = 1_000
CONTEXT = ("context_before", "context_after", "trimmed_left", "trimmed_right")
RESULT = ("original", "variation", "matched_text", "line_number", "column", "start_of_word", "end_of_word", "start_of_match", "end_of_match", "start_of_line")


@dataclass(frozen=True)
class Keyword:
    ord: int
    original: str
    variation: str
    exact_candidate: bool
    alt_originals: tuple[str, ...] | None = None
    group: int = 0


@dataclass(frozen=True)
class Parameters:
    match: Match = Match.EXACT
    character_set: CharacterSet = CharacterSet.PACKAGE
    anchor_beginning: bool = True
    anchor_end: bool = True
    fail_on_invalid: bool = False
    context: bool = False
    columns: int = 50
    lines: int = 0
    collapse_mixed: bool = False
    tlds: tuple[str, ...] = ()  # for domains; none: those that are installed


@dataclass
class Search:
    """A compiled set of terms."""

    terms: list[str]
    parameters: Parameters = field(default_factory=Parameters)

    def __post_init__(self):
        p, self.terms = self.parameters, list(dict.fromkeys(self.terms))
        if not self.terms or any(not t for t in self.terms):
            raise ValueError("terms must be given and must not be empty")
        self.alphabet: Alphabet = alphabet(p.character_set, p.match, self.terms)
        self.keywords: list[Keyword] = self._domain_keywords() if p.character_set == CharacterSet.DOMAIN else self._keywords()

    def _keywords(self) -> list[Keyword]:
        p, out = self.parameters, []
        for term in self.terms:
            normal = self.alphabet.normalized(term)
            out.append((term, term if p.match == Match.EXACT else normal, True))
            if p.match in (Match.TYPO, Match.BOTH):
                out += [(term, v, False) for v in V.word_variations(normal, p.character_set == CharacterSet.PACKAGE)]
        return [Keyword(k, *x) for k, x in enumerate(dict.fromkeys(out))]

    def _domain_keywords(self) -> list[Keyword]:
        """Terms are ``stem.tld``; with typing errors the stem's variations meet every top-level domain, the stem all others."""
        p, out, stems = self.parameters, [], {}
        tlds = p.tlds or installed_tlds()
        known_tlds = set(tlds)
        for term in self.terms:
            parts = self.alphabet.normalized(term).split(".")
            if len(parts) != 2:
                raise ValueError(f"subdomains are not supported: '{term}'")
            if parts[1].lower() not in known_tlds:
                raise ValueError(f"not a valid tld '{parts[1]}' in domain '{term}'")
            stems.setdefault(parts[0], []).append(parts[1])
            out.append((term, term if p.match == Match.EXACT else ".".join(parts), True, None))
        if p.match in (Match.TYPO, Match.BOTH):
            for stem, own in stems.items():
                label, known = f"{stem}.{{{','.join(sorted(own))}}}", tuple(f"{stem}.{t}" for t in sorted(own))
                out += [(label, f"{stem}.{t}", False, known) for t in tlds if t not in own]
                out += [(label, f"{v}.{t}", False, known) for v in V.word_variations(stem, look_alikes=True) for t in tlds]
        return [Keyword(k, *x) for k, x in enumerate(dict.fromkeys(out))]

    @classmethod
    def of_groups(cls, groups: list[list[str]], parameters: Parameters) -> Search | None:
        """One search of several groups of terms, each with results of its own; null if their alphabets differ."""
        each = [cls(terms, parameters) for terms in groups]
        if any(x.alphabet != each[0].alphabet for x in each):
            return None
        each[0].keywords = [replace(k, group=g) for g, x in enumerate(each) for k in x.keywords]
        return each[0]

    def variations(self) -> list[str]:
        """Sorted distinct variations."""
        return sorted({k.variation for k in self.keywords})

    def size(self) -> dict[str, int]:
        """How many variations beside the terms, and how many distinct prefixes (with the empty one) they have."""
        return {"variations": sum(not k.exact_candidate for k in self.keywords), "nodes": len({k.variation[:i] for k in self.keywords for i in range(len(k.variation) + 1)})}

    def _keyword_rows(self, once: bool) -> list[tuple]:
        rows, seen = [], set()
        for k in self.keywords:
            key = self._key_of(k)
            if once and (k.group, key, k.original) in seen:
                continue
            seen.add((k.group, key, k.original))
            rows.append((k.ord, k.original, k.variation, k.exact_candidate, list(k.alt_originals) if k.alt_originals else None, key, k.group))
        return rows

    def keyword_frame(self, spark: SparkSession, once: bool = False) -> DataFrame:
        """The keywords as a table. once: of those of a group that share key and original only the first."""
        return spark.createDataFrame(self._keyword_rows(once), "ord long, original string, variation string, exact_candidate boolean, alt_originals array<string>, key string, group int")

    def nbytes(self) -> int:
        """How large the keyword table is: its strings and 64 bytes a row."""
        return sum(64 + 4 * (len(k.original) + 2 * len(k.variation) + sum(map(len, k.alt_originals or ()))) for k in self.keywords)

    def _key_of(self, k: Keyword) -> str:
        return k.variation if self.parameters.match == Match.EXACT else self.alphabet.variation_key(k.variation)

    def _word_key(self, word: Column) -> Column:
        key = self.alphabet.key(word)
        return F.regexp_replace(key, "-+", "-") if self.parameters.collapse_mixed and self.alphabet.merged else key

    def match(self, docs: DataFrame, key: list[str], text: str, routes: str | None = None) -> DataFrame:
        """Columns ``key`` of ``docs`` and those of ``RESULT`` (with context_before, context_after, trimmed_left
        and trimmed_right if asked for), a row per term found in a word.

        ``key`` names a row of ``docs``: rows that share it must not differ. Null and empty texts give no
        rows. Of several hits of a term in one word the first in emission order counts. routes: a column
        with the array of groups whose terms are searched in a row; results then have ``group``.
        """
        p, a = self.parameters, self.alphabet
        if p.fail_on_invalid:
            bad = F.regexp_extract(text, f"[^{a.body}]", 0)
            docs = docs.withColumn(text, F.when(bad != "", F.raise_error(F.concat(F.lit("invalid character '"), bad, F.lit("'")))).otherwise(F.col(text)))
        own = [f"k{i}" for i in range(len(key))]
        rows = docs.select(*[F.col(k).alias(c) for c, k in zip(own, key, strict=True)], *([F.col(routes).alias("routes")] if routes else []), F.explode(self._placed(F.col(text))).alias("w"))
        rows = rows.select(*own, *["routes"] * bool(routes), "w.*")
        few = len({self._key_of(k) for k in self.keywords}) <= LITERAL_KEYS
        found = (self._told_apart if few else self._joined)(rows, own, bool(routes))
        start = F.col("at")
        out = [
            *[F.col(c).alias(k) for c, k in zip(own, key, strict=True)], "original", "variation", F.col("word").alias("matched_text"), "line_number", (start - F.col("line_start") + 1).alias("column"),
            start.alias("start_of_word"), (start + F.octet_length("word")).alias("end_of_word"), (start + F.col("begin")).alias("start_of_match"), (start + F.col("stop")).alias("end_of_match"), F.col("line_start").alias("start_of_line"),
        ]
        return found.select(*out, *["group"] * bool(routes), *[F.col(f"context.{c}") for c in CONTEXT] * p.context)

    def _bytes_of(self, n: Column) -> Column:
        """Bytes of ``word`` that the first ``n`` characters of its key stand for."""
        left = lambda: F.octet_length(F.left("word", n))
        if not self.alphabet.collapse:
            return left()
        runs = F.regexp_substr("word", F.concat(F.lit("(?s)^(?:-+|[^-]){"), n.cast("string"), F.lit("}")))
        return F.when(F.contains("word", F.lit("--")), F.octet_length(F.coalesce(runs, F.lit("")))).otherwise(left())

    def _first_only(self) -> bool:
        """Whether a term may be found several times in a word."""
        p = self.parameters
        return not (p.anchor_beginning and p.anchor_end and p.match != Match.TYPO)

    @staticmethod
    def _order(width: Column, s: Column, begin: Column, stop: Column) -> list[Column]:
        live = s["from"] + s["size"] == width
        return [(~live).cast("int"), F.when(live, 0).otherwise(stop), begin]

    def _told_apart(self, rows: DataFrame, own: list[str], routes: bool) -> DataFrame:
        """A row per term and word of ``rows``; keywords are looked up and told apart inside the word's row."""
        of, terms = {}, {}
        for ord_, original, variation, _, alts, key, group in self._keyword_rows(not self._first_only()):
            term = terms.setdefault((group, original), len(terms))
            of.setdefault(key, []).append({"ord": ord_, "original": original, "variation": variation, "alt_originals": alts, "group": group, "term": term})
        keys = F.array(*[F.lit(k) for k in of])
        known = F.from_json(F.lit(json.dumps(list(of.values()))), "array<array<struct<ord:long,original:string,variation:string,alt_originals:array<string>,group:int,term:int>>>")

        def entries(s: Column) -> Column:
            def entry(at: Column) -> Callable[[Column], Column]:
                shown = [at["begin"].alias("begin"), at["stop"].alias("stop")]
                order = [c.alias(f"o{i}") for i, c in enumerate(self._order(F.col("width"), s, at["begin"], at["stop"]))]
                return lambda k: F.struct(*order, *[k[c].alias(c) for c in ("ord", "original", "variation", "alt_originals", "group", "term")], *shown)

            at = F.struct(self._bytes_of(s["from"]).alias("begin"), self._bytes_of(s["from"] + s["size"]).alias("stop"))
            return let(at, lambda x: F.transform(F.get(known, (F.array_position(keys, s["key"]) - 1).cast("int")), entry(x)))

        def firsts(all_: Column) -> Column:
            return F.transform(F.array_distinct(F.transform(all_, lambda e: e["term"])), lambda t: F.array_min(F.filter(all_, lambda e: e["term"] == t)))

        hits = F.flatten(F.transform("spans", entries))
        if routes:
            hits = F.filter(hits, lambda e: F.array_contains("routes", e["group"]))
        if self.parameters.match == Match.TYPO:
            hits = F.filter(hits, lambda e: self._is_typo(lambda c: e[c]))
        hits = let(hits, firsts) if self._first_only() else hits
        return rows.withColumn("e", F.explode(hits)).drop("spans").select("*", *[F.col(f"e.{c}") for c in ("ord", "original", "variation", "group", "begin", "stop")])

    def _joined(self, rows: DataFrame, own: list[str], routes: bool) -> DataFrame:
        """The same by a join with the table of keywords."""
        rows = rows.select("*", F.explode("spans").alias("s")).drop("spans")
        terms = self.keyword_frame(rows.sparkSession, once=not self._first_only())
        found = rows.join(F.broadcast(terms) if self.nbytes() <= BROADCAST_BYTES else terms, F.col("s.key") == terms["key"])
        if routes:
            found = found.where(F.array_contains("routes", F.col("group")))
        found = found.withColumn("begin", self._bytes_of(F.col("s.from"))).withColumn("stop", self._bytes_of(F.col("s.from") + F.col("s.size")))
        if self.parameters.match == Match.TYPO:
            found = found.where(self._is_typo(F.col))
        if self._first_only():
            order = [*self._order(F.col("width"), F.col("s"), F.col("begin"), F.col("stop")), F.col("ord")]
            found = found.withColumn("first", F.row_number().over(Window.partitionBy(*own, "at", "group", "original").orderBy(*order))).where("first = 1")
        return found

    def _pattern(self) -> str | None:
        """What finds the words that may be hits, if there are few keys: whole words, with all that are hits and few more.

        The keys are a tree. A character of a key stands for those that the key of a word may have it
        from: both cases (of letters beyond ASCII: any), runs of delimiters.
        """
        p, a = self.parameters, self.alphabet
        keys = {self._key_of(k) for k in self.keywords}
        if len(keys) > LITERAL_KEYS or "" in keys:
            return None
        wide = "\\p" in a.body
        other = f"[\\P{{ASCII}}&&[{a.body}]]"

        def unit(c: str) -> str:
            if c == "-" and (a.collapse or a.merged):
                return "[-._]++" if a.merged else "-++"
            if not a.fold:
                return re.escape(c)
            if ord(c) > 127:
                return other
            both = re.escape(c) if c == c.upper() else c + c.upper()
            return f"[{both}\\P{{ASCII}}&&[{a.body}]]" if wide else f"[{both}]"

        tree: dict = {}
        for key in keys:
            if regex.search(f"[^{a.body}]", "".join(c for c in key if c.isascii())):
                continue  # no word has such a key
            units = [unit(c) for c in key.replace("\u0307", "" if a.fold else "\u0307")]
            node = tree
            for k, u in enumerate(units):
                node = node if k and u == units[k - 1] and u.endswith("++") else node.setdefault(u, {})
            node[""] = {}

        def said(node: dict) -> str:
            if not p.anchor_end and "" in node:
                return ""
            each = [u + said(x) if u else "" for u, x in sorted(node.items(), reverse=True)]
            return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"

        if not tree:
            return "(?!)"
        begin, end = "" if p.anchor_beginning else f"[{a.body}]*?", f"(?![{a.body}])" if p.anchor_end else f"[{a.body}]*+"
        # A character beyond 16 bits, here never matched, has Java look behind by characters instead of their halves.
        return f"(?<![{a.body}]){begin}{said(tree)}{end}" + "(?:\U00010000){0}" * wide

    def _tokens(self, text: Column) -> Column:
        """A text in pieces, which joined are the text; of few keys the words that may be hits have the odd places."""
        pattern = self._pattern()
        if pattern is None:
            return self.alphabet.tokens(text)
        gaps, words = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.flatten(F.zip_with(gaps, words, lambda g, w: F.array(g, F.coalesce(w, F.lit("")))))

    def _candidates(self, tokens: Column) -> Column:
        """The words of ``tokens`` that may be hits, with those spans of their keys that may be variations.

        Few keys are checked here, so that only hits are placed; many keys wait for the join.
        """
        p, a = self.parameters, self.alphabet
        keys = sorted({self._key_of(k) for k in self.keywords})
        lengths = sorted({len(k) for k in keys})
        known = (lambda k: k.isin(keys)) if len(keys) <= LITERAL_KEYS else (lambda k: F.lit(True))
        whole = p.anchor_beginning and p.anchor_end
        collapses = a.collapse or p.collapse_mixed
        # Keys hold word characters only, so runs of others fall out by key; by length most words do before.
        if not whole or p.collapse_mixed:
            fits = lambda t: F.length(t) >= lengths[0]
        else:
            fits = lambda t: F.length(t).isin(lengths) | F.contains(t, F.lit("--")) if collapses else F.length(t).isin(lengths)
        words = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), t.alias("word"))), lambda w: fits(w["word"]))
        words = F.filter(words, lambda w: a.is_word(w["word"])) if self._pattern() is None else F.filter(words, lambda w: w["pos"] % 2 == 1)
        words = F.transform(words, lambda w: F.struct(w["pos"].alias("pos"), w["word"].alias("word"), self._word_key(w["word"]).alias("key")))
        empty = F.array().cast("array<struct<from:int,size:int,key:string>>")

        def span(key: Column, size: int):
            return lambda s: F.struct(s.alias("from"), F.lit(size).alias("size"), F.substr(key, s + 1, F.lit(size)).alias("key"))

        def spans(w: Column) -> Column:
            n, each = F.length(w["key"]), []
            for size in lengths:
                last = n - size
                starts = F.array(F.lit(0)) if p.anchor_beginning else F.array(last) if p.anchor_end else F.sequence(F.lit(0), last)
                each.append(F.when(last >= 0, F.filter(F.transform(starts, span(w["key"], size)), lambda x: known(x["key"]))).otherwise(empty))
            return F.concat(*each)

        def one(w: Column) -> Column:
            return F.array(F.struct(F.lit(0).alias("from"), F.length(w["key"]).alias("size"), w["key"].alias("key")))

        if whole:
            words = F.filter(words, lambda w: known(w["key"]))
        hits = F.transform(words, lambda w: F.struct(w["pos"].alias("pos"), w["word"].alias("word"), F.length(w["key"]).alias("width"), (one if whole else spans)(w).alias("spans")))
        return hits if whole else F.filter(hits, lambda w: F.size(w["spans"]) > 0)

    def _placed(self, text: Column) -> Column:
        """The hits in a text with byte offset, line, the line's offset and, if asked for, context.

        What lies between a hit and the one before is joined once, and running sums are nearly linear,
        so places cost the text's length in all, however many hits there are. Arrays are bound by
        ``let``: as columns of a projection the optimizer would compute them anew for each element.
        """
        long = lambda c: c.cast("long")
        lines = lambda g: F.length(g) - F.length(F.replace(g, F.lit("\n"), F.lit("")))

        def sizes(tokens: Column, hits: Column) -> Column:
            last = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(hits, i - 1)["pos"])
            gaps = F.transform(hits, lambda w, i: let(last(i), lambda p: F.struct(w["word"].alias("word"), F.array_join(F.slice(tokens, p + 2, w["pos"] - p - 1), "").alias("gap"))))
            return F.transform(gaps, lambda x: F.struct(long(F.octet_length(x["word"])).alias("word"), long(F.octet_length(x["gap"])).alias("gap"), long(lines(x["gap"])).alias("lines"), long(F.octet_length(F.substring_index(x["gap"], "\n", -1))).alias("tail")))

        def scans(size: Column) -> Column:
            ends = sums(F.transform(size, lambda x: x["gap"] + x["word"]))
            begun = lambda e: F.transform(size, lambda x, i: F.when(x["lines"] > 0, F.get(e, i) - x["word"] - x["tail"]).otherwise(F.lit(0).cast("long")))
            return let(ends, lambda e: F.struct(size.alias("size"), e.alias("end"), sums(F.transform(size, lambda x: x["lines"])).alias("lines"), maxima(begun(e)).alias("start")))

        def placed(tokens: Column, hits: Column, scan: Column) -> Column:
            def place(w: Column, i: Column) -> Column:
                at = [(F.get(scan["end"], i) - F.get(scan["size"], i)["word"]).alias("at"), (F.get(scan["lines"], i) + 1).alias("line_number"), F.get(scan["start"], i).alias("line_start")]
                around = [self._context(tokens, w["pos"]).alias("context")] if self.parameters.context else []
                return F.struct(w["word"].alias("word"), w["width"].alias("width"), w["spans"].alias("spans"), *at, *around)

            return F.transform(hits, place)

        found = lambda t: let(self._candidates(t), lambda h: let(sizes(t, h), lambda z: let(scans(z), lambda s: placed(t, h, s))))
        return let(self._tokens(text), found)

    def _is_typo(self, of: Callable[[str], Column]) -> Column:
        """Whether a hit, with columns ``of`` its keyword and place, is no hit of the term itself."""
        kind = self.parameters.character_set
        if kind == CharacterSet.PACKAGE:
            return F.lower("word") != of("original")
        if kind == CharacterSet.DOMAIN:
            return of("alt_originals").isNotNull() & ~F.coalesce(F.array_contains(of("alt_originals"), F.lower("word")), F.lit(False))
        around = F.substring(F.col("word").cast("binary"), F.greatest(of("begin"), F.lit(1)), of("stop") - F.greatest(of("begin") - 1, F.lit(0)) + 1)
        return ~F.contains(F.lower(around.cast("string")), of("original"))

    def _context(self, tokens: Column, pos: Column) -> Column:
        """Bytes around word ``pos`` of ``tokens``; a cut character and what is neither letter, number, sign
        nor line feed become blanks. A token has a byte at least: as many tokens as bytes will do, cut short."""
        p = self.parameters
        most = 4 * p.lines * p.columns if p.lines else p.columns
        first = F.greatest(pos - most, F.lit(1))  # of the tokens before, counted from 1
        near = F.transform(F.slice(tokens, first, pos - first + 1), lambda t: F.right(t, F.lit(most + 1)))
        left = F.substring_index(F.array_join(near, ""), "\n", -(p.lines + 1))
        near = F.transform(F.slice(tokens, pos + 2, most + 1), lambda t: F.left(t, F.lit(most + 1)))
        right = F.substring_index(F.array_join(near, ""), "\n", p.lines + 1)
        clean = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}\p{P}\p{Sc}\p{Sm}\n]", " ")

        def cut(x: Column) -> Column:
            n_left, n_right = F.octet_length(x["left"]), F.octet_length(x["right"])
            before = F.when(n_left > most, F.substring(x["left"].cast("binary"), n_left - most + 1, F.lit(most)).cast("string")).otherwise(x["left"])
            after = F.when(n_right > most, F.substring(x["right"].cast("binary"), F.lit(1), F.lit(most)).cast("string")).otherwise(x["right"])
            return F.struct(*[c.alias(name) for c, name in zip((clean(before), clean(after), n_left > most, n_right > most), CONTEXT, strict=True)])

        return let(F.struct(left.alias("left"), right.alias("right")), cut)

    @staticmethod
    def match_dorks(docs: DataFrame, key: list[str], text: str, path: str, dorks: list[filters.Dork], parameters: Parameters) -> DataFrame:
        """The searches of ``dorks`` over files: columns as of ``match`` and ``group``, the place of the search in
        ``filters.dork_groups``. Files are read once; where alphabets differ (``input``), once a search."""
        groups = filters.dork_groups(dorks)
        search = Search.of_groups([terms for _, terms in groups], parameters)
        routed = docs.withColumn("_routes", filters.routes(groups, F.col(path))).where(F.size("_routes") > 0)
        if search is not None:
            return search.match(routed, key, text, routes="_routes")
        each = [Search(terms, parameters).match(routed.where(F.array_contains("_routes", k)), key, text).withColumn("group", F.lit(k)) for k, (_, terms) in enumerate(groups)]
        return reduce(DataFrame.unionByName, each)

    def match_permissive(self, spark: SparkSession, texts: list[str]) -> DataFrame:
        """``match`` over strings, a row of ``index`` each."""
        return self.match(spark.createDataFrame(list(enumerate(texts)), "index int, text string"), ["index"], "text")
