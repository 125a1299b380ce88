"""The search as SQL, to hold the rows of the engine against."""

from __future__ import annotations

from oreline.functions.charset import CharacterSet, Match
from oreline.operators.search import Search


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def keyword_values(search: Search) -> str:
    rows = ", ".join(f"({k.ord}, {quoted(k.original)}, {quoted(k.variation)}, {quoted(search._key_of(k))}, {'[' + ', '.join(map(quoted, k.alt_originals)) + ']' if k.alt_originals else 'NULL::VARCHAR[]'})" for k in search.keywords)
    return f"(VALUES {rows}) AS k(ord, original, variation, key, alts)"


def search_ctes(search: Search, table: str, key: str, text: str) -> str:
    """CTEs up to ``found``: a row per term found in a word, with positions and, in ``prefix`` and ``rest``, the text around."""
    p, a = search.parameters, search.alphabet
    lowered = "lower(word)" if a.fold else "word"
    collapsed = f"regexp_replace({lowered}, '-+', '-', 'g')" if a.collapse else lowered
    keyed = f"translate({collapsed}, '{a.merged}', '{'-' * len(a.merged)}')" if a.merged else collapsed
    body = a.body.replace("'", "''")
    if p.anchor_beginning and p.anchor_end:
        spans = "SELECT w.*, k.*, 0 AS s FROM words w JOIN kw k ON k.key = w.wkey"
    elif p.anchor_beginning:
        spans = "SELECT w.*, k.*, 0 AS s FROM words w JOIN kw k ON starts_with(w.wkey, k.key)"
    elif p.anchor_end:
        spans = "SELECT w.*, k.*, length(w.wkey) - length(k.key) AS s FROM words w JOIN kw k ON suffix(w.wkey, k.key)"
    else:
        spans = "SELECT * FROM (SELECT w.*, k.*, unnest(range(0, length(w.wkey) - length(k.key) + 1)) AS s FROM words w JOIN kw k ON contains(w.wkey, k.key)) WHERE substring(wkey, s + 1, length(key)) = key"
    typo = "true"
    if p.match == Match.TYPO:
        typo = "lower(word) <> original" if p.character_set == CharacterSet.PACKAGE else "alts IS NOT NULL AND NOT list_contains(alts, lower(word))"
    return f"""
WITH kw AS (SELECT * FROM {keyword_values(search)}),
toks AS (SELECT {key}, {text} AS txt, regexp_extract_all({text}, '[{body}]+|[^{body}]+') AS t FROM {table}),
parts AS (SELECT {key}, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM toks),
sized AS (SELECT *, coalesce(sum(strlen(word)) OVER w, 0)::BIGINT AS ofs, 1 + coalesce(sum(length(word) - length(replace(word, chr(10), ''))) OVER w, 0)::BIGINT AS line
          FROM parts WINDOW w AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lined AS (SELECT *, coalesce(max(CASE WHEN contains(word, chr(10)) THEN ofs + strlen(word) - strlen(string_split(word, chr(10))[-1]) END) OVER w, 0)::BIGINT AS begins
          FROM sized WINDOW w AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
words AS (SELECT *, {keyed} AS wkey FROM lined WHERE regexp_matches(word, '^[{body}]')),
spans AS ({spans}),
found AS (SELECT *, word AS matched_text, line AS line_number, ofs - begins + 1 AS "column", ofs AS start_of_word FROM spans WHERE {typo}
          QUALIFY row_number() OVER (PARTITION BY {key}, pos, original ORDER BY (s + length(key) <> length(wkey)), CASE WHEN s + length(key) = length(wkey) THEN 0 ELSE s + length(key) END, s, ord) = 1)
"""


def search_sql(search: Search, table: str, key: str, text: str) -> str:
    return search_ctes(search, table, key, text) + f'SELECT {key}, original, variation, matched_text, line_number, "column", start_of_word FROM found'
