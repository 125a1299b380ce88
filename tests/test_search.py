"""Searches on literal cases: mode, set, anchors, terms, text, and the terms found in order."""

import random
import re

import pytest

from oreline.functions import variations as V
from oreline.functions.charset import CharacterSet as C
from oreline.functions.charset import Match as M
from oreline.operators.filters import Dork, PathFilter, classify, owner_and_repo, read_terms
from oreline.operators import search as search_module
from oreline.operators.search import Parameters, Search

CASES = [
    (M.EXACT, C.PACKAGE, 1, 1, ["testing", "another"], "testing %! another", ["testing", "another"]),
    (M.BOTH, C.PACKAGE, 1, 1, ["Testing", "aNother"], "tEsting %! anoTheR", ["Testing", "aNother"]),
    (M.TYPO, C.PACKAGE, 1, 1, ["abc-def"], "abc-def", []),
    (M.NORMALIZED, C.PACKAGE, 1, 1, ["a-b"], "a-b a--b a._b", ["a-b", "a-b"]),
    (M.NORMALIZED, C.PACKAGE, 1, 1, ["ab--cd"], "ab---cd", ["ab--cd"]),
    (M.TYPO, C.PACKAGE, 1, 1, ["request"], "reequest", ["request"]),
    (M.TYPO, C.PACKAGE, 1, 1, ["requires-port"], "require-port", ["requires-port"]),
    (M.TYPO, C.PACKAGE, 1, 1, ["lodash"], "1odash", ["lodash"]),
    (M.TYPO, C.PACKAGE, 1, 1, ["foobar"], "foo-bar", ["foobar"]),
    (M.TYPO, C.DOMAIN, 1, 1, ["foobar.com"], "foo-bar.com", ["foobar.{com}"]),
    (M.BOTH, C.DOMAIN, 1, 1, ["example.com", "example.no"], "example.jp", ["example.{com,no}"]),
    (M.NORMALIZED, C.PACKAGE, 1, 0, ["abc", "def"], "abcd defg", ["abc", "def"]),
    (M.NORMALIZED, C.PACKAGE, 1, 1, ["abc", "def"], "abcd defg", []),
    (M.NORMALIZED, C.URL, 1, 1, ["https://GitHub.com"], "https://github.com", ["https://GitHub.com"]),
    (M.TYPO, C.URL, 0, 0, ["word"], "awordb", []),
    (M.TYPO, C.PACKAGE, 0, 0, ["word"], "awordb", ["word"]),
    (M.EXACT, C.PACKAGE, 0, 1, ["word"], "wordb", []),
    (M.BOTH, C.PACKAGE, 0, 1, ["ab", "abc", "bc"], "abc", ["abc", "bc"]),
    (M.BOTH, C.INPUT, 1, 1, ["blåbærsyltetøy"], "blabersyltetoy blåbærsyltetøy", ["blåbærsyltetøy"]),
    (M.TYPO, C.DOMAIN, 1, 1, ["no.no"], "nо.no", ["no.{no}"]),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[0]}-{c[1]}-{c[4][0]}")
def test_match(spark, case):
    mode, kind, begin, end, terms, text, want = case
    search = Search(terms, Parameters(mode, kind, bool(begin), bool(end)))
    found = search.match_permissive(spark, [text]).orderBy("start_of_word", "start_of_match").collect()
    assert sorted(r.original for r in found) == sorted(want)


def test_positions_are_bytes_and_lines_count_from_one(spark):
    row = Search(["abc"], Parameters(M.EXACT, anchor_beginning=False, anchor_end=False, context=True, columns=3)).match_permissive(spark, ["é\nüü xabcd!"]).first()
    assert (row.line_number, row.column, row.start_of_word, row.end_of_word, row.start_of_match, row.end_of_match, row.start_of_line) == (2, 6, 8, 13, 9, 12, 3)
    assert row.context_after == "!" and row.trimmed_left and not row.trimmed_right


def test_errors(spark):
    with pytest.raises(ValueError):
        Search([""])
    with pytest.raises(ValueError):
        Search(["a b"])
    with pytest.raises(ValueError):
        Search(["a.b.com"], Parameters(character_set=C.DOMAIN))
    with pytest.raises(Exception, match="invalid character ' '"):
        Search(["abc"], Parameters(fail_on_invalid=True)).match_permissive(spark, ["def abc"]).collect()


def test_variations():
    assert V.omissions("abc") == ["bc", "ac", "ab"] and V.duplications("ab") == ["aab", "abb"] and V.swaps("abc") == ["bac", "acb"]
    assert V.reorders("a-a-a") == [] and V.reorders("b-a-a") == ["a-b-a", "a-a-b"] and V.delimiters("a-bc") == ["a-b-c"]
    assert V.near_keys("1z") == ["2z", "qz", "lz", "iz", "1a", "1s", "1x", "12"]
    assert len(V.word_variations("pypi", look_alikes=True)) == 46


def test_paths(spark):
    assert [classify(x) for x in ("/a/", "/", "/a/b", ".go", "a.go")] == [("directory", "a"), ("directory", "."), ("path", "a/b"), ("extension", ".go"), ("name", "a.go")]
    paths = spark.createDataFrame([(p,) for p in ("a/x.go", "a/b/x.go", "y.go", "a/.gitignore", "a/y.md")], "p string")
    keep = lambda f: [r.p for r in paths.where(f.condition(paths.p)).collect()]
    assert keep(PathFilter(("/a/",), ("y.md",))) == ["a/x.go", "a/.gitignore"]
    assert keep(PathFilter((".go", "/"))) == ["y.go"] and keep(PathFilter((".gitignore",))) == ["a/.gitignore"]
    assert Dork.parse(".go:term") == Dork("extension", ".go", "term") and read_terms(" a\n\n,b ") == ["a", "b"]
    urls = spark.createDataFrame([(u,) for u in ("https://github.com/Foo/Bar.git", "https://github.com/Foo/", "http://github.com/Foo")], "u string")
    assert [tuple(r.x) if r.x else None for r in urls.select(owner_and_repo(urls.u).alias("x")).collect()] == [("Foo", "Bar"), ("Foo", None), None]


@pytest.mark.parametrize("kind,begin,end,terms", [(C.PACKAGE, True, True, ["there", "mail-server"]), (C.PACKAGE, False, False, ["ab", "bcd"]), (C.DOMAIN, False, True, ["example.com"])])
def test_many_keys_are_joined_with_their_table(spark, monkeypatch, kind, begin, end, terms):
    """The same rows whether keys are a set in the plan, a broadcast table or a shuffled one."""
    texts = ["the tehre there! mail--server mailserver", "xabcdx ab-cd abcd", "www.exmaple.com example.org", "", "émail-srever\nthere"]
    search = Search(terms, Parameters(M.BOTH, kind, begin, end, tlds=("com", "org")))
    rows = lambda: sorted(map(tuple, search.match_permissive(spark, texts).collect()))
    few = rows()
    monkeypatch.setattr(search_module, "LITERAL_KEYS", 0)
    assert rows() == few and few
    monkeypatch.setattr(search_module, "BROADCAST_BYTES", 0)
    assert rows() == few


#: Terms and anchors of searches that tell several finds of a term in a word apart.
APART = {
    "substring": (M.EXACT, False, False, ["tion", "ionth", "stst"]),
    "prefix": (M.NORMALIZED, True, False, ["ther", "tion"]),
    "suffix": (M.NORMALIZED, False, True, ["ing", "eau"]),
}


@pytest.mark.parametrize("name", APART)
def test_finds_are_told_apart_without_a_shuffle(spark, name):
    mode, begin, end, terms = APART[name]
    r = random.Random(name)
    texts = ["".join(r.choice(["tion", "ther", "ing", "eau", "st", "Th", "x", "-", "--", ".", " ", "\n", "é", "\U0001f600", "h"]) for _ in range(r.randrange(60))) for _ in range(200)]
    found = Search(terms, Parameters(mode, anchor_beginning=begin, anchor_end=end)).match_permissive(spark, texts)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    fold = (lambda w: re.sub("-+", "-", w.lower()).translate(str.maketrans("._", "--"))) if mode == M.NORMALIZED else str
    want = set()
    for k, text in enumerate(texts):
        for w in re.finditer(r"[A-Za-z0-9._\-]+", text):
            key = fold(w.group())
            for t in terms:
                if key.startswith(t) if begin else key.endswith(t) if end else t in key:
                    want.add((k, t, w.group(), len(text[: w.start()].encode()), text[: w.start()].count("\n") + 1))
    got = found.select("index", "original", "matched_text", "start_of_word", "line_number").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


@pytest.mark.parametrize("kind,mode,begin,end,terms", [(C.INPUT, M.NORMALIZED, False, True, ["über", "i̇s"]), (C.INPUT, M.EXACT, True, False, ["\U0001d49c", "où"]), (C.DOMAIN, M.BOTH, False, False, ["ab-c.com"]), (C.URL, M.TYPO, False, False, ["a/b"]), (C.PACKAGE, M.BOTH, True, True, ["a-b.c"])])
def test_words_found_by_pattern_are_those_of_all_words(spark, monkeypatch, kind, mode, begin, end, terms):
    """Letters beyond 16 bits, of several cases and runs of delimiters, in a text and beside each other."""
    r = random.Random(f"{kind}{mode}")
    bits = ["über", "ÜBER", "où", "İs", "i̇s", "\U0001d49c", "\U0001f600", "ab-c", "a-b", "a/b", "AB", ".com", ".c", "-", "--", "._", " ", "\n", "–", "K", "x"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(250)] + ["-" * 3_000, None, ""]
    search = Search([t.replace("i̇", "i") for t in terms], Parameters(mode, kind, begin, end, context=True, columns=5, tlds=("com", "org")))
    rows = lambda: sorted(map(str, search.match_permissive(spark, texts).collect()))
    few = rows()
    monkeypatch.setattr(search_module, "LITERAL_KEYS", 0)
    assert few and rows() == few
