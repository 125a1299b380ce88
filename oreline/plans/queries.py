"""Registered queries over the test tables, and the same in SQL.

Tables stand for the engine's relations: documents are blobs (source: repository, lang: directory),
pages are files by address, a conversation is a repository whose turns are commits in a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.functions import variations as V
from oreline.functions.charset import CharacterSet, Match
from oreline.functions.tlds import installed_tlds
from oreline.operators import filters, hashing, history, policy, release
from oreline.operators.search import Parameters, Search
from oreline.plans.oracle import quoted, search_ctes, search_sql
from oreline.sources.sinks import result_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- searches -----------------------------------------------------------------------------------------

SHOWN = ("original", "variation", "matched_text", "line_number", "column", "start_of_word")
TYPO_TLDS = ("com", "io", "net", "org")
SEARCHES: dict[str, tuple[Search, str, str, str]] = {
    "search_package_normalized": (Search(["the", "of", "que", "der", "a_b"], Parameters(Match.NORMALIZED)), "documents", "doc_id", "text"),
    "search_package_exact": (Search(["The", "of", "Que", "nation-1"], Parameters(Match.EXACT)), "documents", "doc_id", "text"),
    "search_input_exact": (Search(["the", "où", "42"], Parameters(Match.EXACT, CharacterSet.INPUT)), "documents", "doc_id", "text"),
    "search_input_normalized": (Search(["ÉTAIT", "über", "que"], Parameters(Match.NORMALIZED, CharacterSet.INPUT)), "documents", "doc_id", "text"),
    "search_url_normalized": (Search(["example.com/EN", "example.org", "//m."], Parameters(Match.NORMALIZED, CharacterSet.URL, False, False)), "pages", "page_id", "url"),
    "search_prefix": (Search(["ther", "tion"], Parameters(Match.NORMALIZED, anchor_end=False)), "documents", "doc_id", "text"),
    "search_suffix": (Search(["ing", "eau"], Parameters(Match.NORMALIZED, anchor_beginning=False)), "documents", "doc_id", "text"),
    "search_substring": (Search(["tion", "ionth", "stst"], Parameters(Match.EXACT, anchor_beginning=False, anchor_end=False)), "documents", "doc_id", "text"),
    "search_package_typo": (Search(["there", "mail-server", "with"], Parameters(Match.TYPO)), "documents", "doc_id", "text"),
    "search_package_all": (Search(["there", "was"], Parameters(Match.BOTH)), "documents", "doc_id", "text"),
    "search_domain_normalized": (Search(["example.com", "example.org"], Parameters(Match.NORMALIZED, CharacterSet.DOMAIN, anchor_beginning=False)), "pages", "page_id", "url"),
    "search_domain_typo": (Search(["exmaple.com", "example.io"], Parameters(Match.TYPO, CharacterSet.DOMAIN, False, tlds=TYPO_TLDS)), "pages", "page_id", "url"),
}


def _search_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    search, source, key, text = SEARCHES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.match(table(spark, sf_dir, source), [key], text).select(key, *SHOWN)

    return run


for _name, (_s, _source, _key, _text) in SEARCHES.items():
    QUERIES[_name] = _search_query(_name)
    ORACLE_SQL[_name] = search_sql(_s, _source, _key, _text)

_CLEAN = r"[^\p{L}\p{N}\p{P}\p{Sc}\p{Sm}\n]"
_NEAR = Search(["der", "que"], Parameters(Match.NORMALIZED, context=True, columns=50))
_LINES = Search(["der", "que"], Parameters(Match.NORMALIZED, context=True, columns=40, lines=1))


def _context_sql(search: Search) -> str:
    """Windows in bytes, on text as bytes in hex: two digits a byte, so that a cut character shows as half."""
    n, columns = search.parameters.lines, search.parameters.columns
    most = 4 * n * columns if n else columns
    before = f"array_to_string(list_slice(string_split(prefix, chr(10)), -{n + 1}, -1), chr(10))"
    after = f"array_to_string(list_slice(string_split(rest, chr(10)), 1, {n + 1}), chr(10))"
    # Characters that are cut fall out on both sides: held against the engine without its blanks there.
    left = f"(SELECT coalesce(string_agg(c, '' ORDER BY i), '') FROM (SELECT c, i, sum(strlen(c)) OVER (ORDER BY i DESC) AS n FROM (SELECT unnest(string_split(l, '')) AS c, generate_subscripts(string_split(l, ''), 1) AS i)) WHERE n <= {most})"
    right = f"(SELECT coalesce(string_agg(c, '' ORDER BY i), '') FROM (SELECT c, i, sum(strlen(c)) OVER (ORDER BY i) AS n FROM (SELECT unnest(string_split(r, '')) AS c, generate_subscripts(string_split(r, ''), 1) AS i)) WHERE n <= {most})"
    return search_ctes(search, "documents", "doc_id", "text") + f"""
, around AS (SELECT f.doc_id, original, matched_text, line_number, start_of_word, right(array_to_string(list_slice(t, 1, pos - 1), ''), {4 * most + 4}) AS prefix, left(array_to_string(list_slice(t, pos + 1, len(t)), ''), {4 * most + 4}) AS rest
           FROM found f JOIN toks USING (doc_id)),
sides AS (SELECT *, {before} AS l, {after} AS r FROM around)
SELECT doc_id, original, matched_text, line_number, start_of_word, ltrim(regexp_replace({left}, '{_CLEAN}', ' ', 'g')) AS context_before, rtrim(regexp_replace({right}, '{_CLEAN}', ' ', 'g')) AS context_after,
       strlen(l) > {most} AS trimmed_left, strlen(r) > {most} AS trimmed_right FROM sides"""


def _contexts(search: Search, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.match(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return found.select("doc_id", "original", "matched_text", "line_number", "start_of_word", F.ltrim("context_before").alias("context_before"), F.rtrim("context_after").alias("context_after"), "trimmed_left", "trimmed_right")


@query(_context_sql(_NEAR))
def context_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(_NEAR, spark, sf_dir)


@query(_context_sql(_LINES))
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(_LINES, spark, sf_dir)


_PLAIN = SEARCHES["search_package_normalized"][0]


@query(search_ctes(_PLAIN, "documents", "doc_id", "text") + """SELECT '{"matchedText":"' || matched_text || '","searchTerm":"' || original || '","lineNumber":' || line_number || ',"column":' || "column" || ',"path":"' || path || '","repo":"' || source || '"}' AS value
FROM found JOIN (SELECT doc_id, source, lang || '/' || doc_id || '.txt' AS path FROM documents) USING (doc_id)""")
def result_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")))
    return result_json(_PLAIN.match(docs, ["doc_id", "path", "source"], "text").withColumnRenamed("source", "repo"))


@query(search_ctes(_PLAIN, "documents", "doc_id", "text") + "SELECT original, count(*) AS matches, count(DISTINCT doc_id) AS files FROM found GROUP BY original")
def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _PLAIN.match(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return found.groupBy("original").agg(F.count("*").alias("matches"), F.count_distinct("doc_id").alias("files"))


@query(search_ctes(_PLAIN, "documents", "doc_id", "text") + "SELECT doc_id, original, matched_text, start_of_word FROM found WHERE lower(matched_text) NOT IN ('of', 'der')")
def exclude_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _PLAIN.match(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return filters.exclude_words(found, ["OF", "der"]).select("doc_id", "original", "matched_text", "start_of_word")


# --- paths ---------------------------------------------------------------------------------------------

_PATH = r"regexp_extract(url, '://[^/?#]*/([^?#]*)', 1)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1))


@query(f"SELECT page_id, {_PATH} AS path FROM pages WHERE regexp_extract(string_split({_PATH}, '/')[-1], '(\\.[^.]*)$', 1) = '.html'")
def path_filter_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where(filters.PathFilter(include=(".html",)).condition(F.col("path"))).select("page_id", "path")


@query(f"SELECT page_id, {_PATH} AS path FROM pages WHERE CASE WHEN contains({_PATH}, '/') THEN regexp_extract({_PATH}, '^(.*)/', 1) ELSE '.' END IN ('en', 'fr') AND string_split({_PATH}, '/')[-1] NOT IN ('7', '25') AND regexp_extract(string_split({_PATH}, '/')[-1], '(\\.[^.]*)$', 1) <> '.html'")
def path_filter_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filters.PathFilter(include=("/en/", "/fr/"), exclude=("7", "25", ".html"))
    return _pages(spark, sf_dir).where(chosen.condition(F.col("path"))).select("page_id", "path")


_DORKS = [filters.Dork.parse(x) for x in ("/en/:the", ".html:of", "*:html", "*:href")]
_DORK_SEARCHES = [(route, Search(terms, Parameters(Match.NORMALIZED))) for route, terms in filters.dork_groups(_DORKS)]


def _dork_sql() -> str:
    conditions = {"directory": f"CASE WHEN contains({_PATH}, '/') THEN regexp_extract({_PATH}, '^(.*)/', 1) ELSE '.' END", "extension": f"regexp_extract(string_split({_PATH}, '/')[-1], '(\\.[^.]*)$', 1)"}
    parts = []
    for k, ((kind, value), search) in enumerate(_DORK_SEARCHES):
        where = f" WHERE {conditions[kind]} = {quoted(value)}" if kind in conditions else ""
        parts.append(f"SELECT * FROM ({search_ctes(search, f'(SELECT * FROM pages{where})', 'page_id', 'html')} SELECT {k} AS search, page_id, original, line_number, start_of_word FROM found)")
    return " UNION ALL ".join(parts)


@query(_dork_sql())
def dork_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Search.match_dorks(_pages(spark, sf_dir), ["page_id"], "html", "path", _DORKS, Parameters(Match.NORMALIZED))
    return found.select(F.col("group").alias("search"), "page_id", "original", "line_number", "start_of_word")


@query(r"""SELECT page_id, CASE WHEN rest <> '' AND len(string_split(rest, '/')) <= 2 THEN string_split(rest, '/')[1] END AS owner, CASE WHEN rest <> '' AND len(string_split(rest, '/')) <= 2 THEN string_split(rest, '/')[2] END AS repo
FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract('https://github.com/' || regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '^https://github\.com/(.+)$', 1), '/$', ''), '\.git$', '') AS rest FROM pages)""")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.owner_and_repo(F.concat(F.lit("https://github.com/"), "path"))
    return _pages(spark, sf_dir).select("page_id", found["owner"].alias("owner"), found["repo"].alias("repo"))


# --- variations ----------------------------------------------------------------------------------------

_WORDS = "SELECT DISTINCT lower(replace(p_name, ' ', '-')) AS word FROM part"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("word")).distinct()


def _variation_query(make):
    return lambda spark, sf_dir: _words(spark, sf_dir).select("word", F.explode(make(F.col("word"))).alias("variation"))


_GENERATORS = {
    "omit": (V.omissions_column, "substring(word, 1, i - 1) || substring(word, i + 1)", "true"),
    "duplicate": (V.duplications_column, "substring(word, 1, i) || substring(word, i)", "substring(word, i, 1) <> '-'"),
    "swap": (V.swaps_column, "substring(word, 1, i - 1) || substring(word, i + 1, 1) || substring(word, i, 1) || substring(word, i + 2)", "i < length(word) AND substring(word, i, 1) <> substring(word, i + 1, 1)"),
    "delimiter": (V.delimiters_column, "substring(word, 1, i - 1) || '-' || substring(word, i)", "i > 1 AND NOT contains(substring(word, i - 1, 2), '-')"),
}
for _kind, (_make, _expr, _cond) in _GENERATORS.items():
    QUERIES[f"variations_{_kind}"] = _variation_query(_make)
    ORACLE_SQL[f"variations_{_kind}"] = f"SELECT DISTINCT word, {_expr} AS variation FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM ({_WORDS})) WHERE {_cond}"
QUERIES["variations_qwerty"] = _variation_query(V.near_keys_column)
_PAIRS = ", ".join(f"({quoted(c)}, {quoted(x)})" for c, keys in V.NEAR_KEYS.items() for x in keys)
ORACLE_SQL["variations_qwerty"] = f"SELECT DISTINCT word, substring(word, 1, i - 1) || x || substring(word, i + 1) AS variation FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM ({_WORDS})) JOIN (VALUES {_PAIRS}) AS n(c, x) ON substring(word, i, 1) = c"


@query(f"""WITH RECURSIVE p AS (SELECT word, string_split(word, '-') AS parts FROM ({_WORDS})),
o AS (SELECT word, parts, [i] AS taken FROM (SELECT word, parts, unnest(range(1, len(parts) + 1)) AS i FROM p WHERE len(parts) > 1 AND len(list_filter(parts, lambda x: x <> '')) <= 5)
      UNION ALL SELECT word, parts, list_append(taken, i) FROM (SELECT word, parts, taken, unnest(range(1, len(parts) + 1)) AS i FROM o) WHERE NOT list_contains(taken, i))
SELECT DISTINCT word, array_to_string(list_transform(taken, lambda i: parts[i]), '-') AS variation FROM o WHERE len(taken) = len(parts) AND array_to_string(list_transform(taken, lambda i: parts[i]), '-') <> word""")
def variations_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("word", F.explode(V.reorders_column(F.col("word"))).alias("variation"))


_ALL = [("package", Search(["there", "mail-server"], Parameters(Match.BOTH))), ("domain", Search(["pypi.org", "pypi.io"], Parameters(Match.BOTH, CharacterSet.DOMAIN)))]
_ALIKE = ", ".join(f"({quoted(c)}, {quoted(x)})" for c in V.NEAR_KEYS for x in V.NEAR_KEYS[c] + V.LOOK_ALIKES.get(c, ""))


def _variations_sql(words: str, alike: str) -> str:
    """``original``, ``variation`` of all kinds but reordering, of a table of ``word``."""
    each = f"SELECT word, unnest(range(1, length(word) + 1)) AS i FROM ({words})"
    made = [f"SELECT word, {expr} AS v FROM ({each}) WHERE {cond}" for _, expr, cond in _GENERATORS.values()]
    made.append(f"SELECT word, substring(word, 1, i - 1) || x || substring(word, i + 1) FROM ({each}) JOIN (VALUES {alike}) AS n(c, x) ON substring(word, i, 1) = c")
    return f"SELECT DISTINCT word, v FROM ({' UNION ALL '.join(made)}) WHERE v <> '' AND v <> word"


_TLD_VALUES = "(VALUES " + ", ".join(f"({quoted(t)})" for t in installed_tlds()) + ") AS t(tld)"
_DOMAIN_SQL = f"""SELECT 'pypi.{{io,org}}' AS original, v || '.' || tld AS variation FROM ({_variations_sql("SELECT 'pypi' AS word", _ALIKE)}), {_TLD_VALUES}
UNION SELECT 'pypi.{{io,org}}', 'pypi.' || tld FROM {_TLD_VALUES} WHERE tld NOT IN ('org', 'io') UNION SELECT 'pypi.' || x, 'pypi.' || x FROM (VALUES ('org'), ('io')) AS o(x)"""
_PACKAGE_SQL = f"""SELECT word AS original, v AS variation FROM ({_variations_sql("SELECT unnest(['there', 'mail-server']) AS word", _PAIRS)})
UNION SELECT 'mail-server', 'server-mail' UNION SELECT x, x FROM (VALUES ('there'), ('mail-server')) AS o(x)"""


def _stats_sql(name: str, sql: str) -> str:
    prefixes = f"SELECT count(DISTINCT left(variation, i)) FROM (SELECT variation, unnest(range(0, length(variation) + 1)) AS i FROM ({sql}))"
    return f"SELECT {quoted(name)} AS name, (SELECT count(*) FROM ({sql}) WHERE variation <> original) AS variations, ({prefixes}) AS nodes"


@query(f"SELECT DISTINCT 'package' AS name, variation FROM ({_PACKAGE_SQL})")
def variations_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ALL[0][1].keyword_frame(spark).select(F.lit("package").alias("name"), "variation").distinct().orderBy("variation")


@query(_DOMAIN_SQL)
def variations_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ALL[1][1].keyword_frame(spark).select("original", "variation").distinct().orderBy("variation")


@query(f"{_stats_sql('package', _PACKAGE_SQL)} UNION ALL {_stats_sql('domain', _DOMAIN_SQL)}")
def variation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, s.size()["variations"], s.size()["nodes"]) for n, s in _ALL], "name string, variations long, nodes long")


# --- digests -------------------------------------------------------------------------------------------


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


_OBJECT = "encode('blob ' || strlen(coalesce(text, ''))) || '\\x00'::BLOB || encode(coalesce(text, ''))"


@query(f"SELECT doc_id, sha1({_OBJECT}) AS sum FROM documents")
def blob_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir).select("doc_id", hashing.object_hash("blob", F.col("data"), "sha1").alias("sum"))


@query(f"SELECT doc_id, sha256({_OBJECT}) AS sum FROM documents")
def blob_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir).select("doc_id", hashing.object_hash("blob", F.col("data"), "sha256").alias("sum"))


@query()
def blob_sha512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir).select("doc_id", hashing.object_hash("blob", F.col("data")).alias("sum"))


@query()
def blob_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir).select("doc_id", hashing.object_hash("blob", F.col("data"), "blake2b-64").alias("sum"))


@query("""SELECT source, lang, 'h1:' || to_base64(unhex(sha256(string_agg(sha256(coalesce(text, '')) || '  ' || name || chr(10), '' ORDER BY name)))) AS h1
FROM (SELECT *, doc_id || '.txt' AS name FROM documents) GROUP BY source, lang""")
def dir_hash_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").withColumn("name", F.concat("doc_id", F.lit(".txt"))).withColumn("data", F.coalesce("text", F.lit("")))
    return hashing.directory_hash(files, ["source", "lang"], "name", "data")


@query("SELECT doc_id, 'DSSEv1 28 application/vnd.in-toto+json ' || strlen(text) || ' ' || text AS pae FROM documents WHERE text <> ''")
def authentication_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text != ''")
    return docs.select("doc_id", release.authentication_encoding(F.lit(release.PAYLOAD_TYPE), F.col("text")).cast("string").alias("pae"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hex FROM documents")
def h1_to_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    h1 = F.concat(F.lit("h1:"), F.base64(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))))
    return table(spark, sf_dir, "documents").select("doc_id", release.h1_to_hex(h1).alias("hex"))


# --- graphs --------------------------------------------------------------------------------------------

_COMMITS = "(SELECT conv_id::VARCHAR AS repo_id, conv_id || '-' || turn AS hash, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent, turn, role, text FROM conversations)"


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    parents = F.when(F.col("turn") > 0, F.array(name(F.col("turn") - 1))).otherwise(F.array().cast("array<string>"))
    return turns.select(F.col("conv_id").cast("string").alias("repo_id"), name(F.col("turn")).alias("hash"), parents.alias("parents"), "turn", "role", "text")


@query(f"WITH RECURSIVE c AS (SELECT repo_id, hash AS start, hash, 0::BIGINT AS depth, parent FROM {_COMMITS} UNION ALL SELECT c.repo_id, c.start, p.hash, c.depth + 1, p.parent FROM c JOIN {_COMMITS} p ON c.parent = p.hash) SELECT repo_id, start, hash, depth FROM c")
def first_parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    return history.first_parent_chain(history.parent_edges(commits), commits)


@query(f"WITH RECURSIVE c AS (SELECT repo_id, hash AS start, hash, parent FROM {_COMMITS} WHERE role = 'assistant' UNION SELECT c.repo_id, c.start, p.hash, p.parent FROM c JOIN {_COMMITS} p ON c.parent = p.hash) SELECT repo_id, start, hash FROM c")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    return history.ancestors(history.parent_edges(commits), commits.where("role = 'assistant'"))


@query(f"SELECT repo_id, hash FROM {_COMMITS} WHERE hash NOT IN (SELECT parent FROM {_COMMITS} WHERE parent IS NOT NULL)")
def heads_not_pointed_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.heads(_commits(spark, sf_dir)).select("repo_id", "hash")


_TIPS = f"(SELECT repo_id, 'main' AS name, hash, turn FROM {_COMMITS} WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY turn DESC) = 1)"


def _tips(commits: DataFrame) -> DataFrame:
    """The last turn of the user as the branch of each conversation."""
    last = commits.where("role = 'user'").groupBy("repo_id").agg(F.max(F.struct("turn", "hash"))["hash"].alias("hash"))
    return last.select("repo_id", F.lit("main").alias("name"), "hash")


@query(f"SELECT c.repo_id, c.hash FROM {_COMMITS} c LEFT JOIN {_TIPS} t USING (repo_id) WHERE t.turn IS NULL OR c.turn > t.turn")
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    return history.dangling(commits, _tips(commits)).select("repo_id", "hash")


_KEYS = "(SELECT repo_id, hash, turn, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x IN ('the', 'of', 'que')))) AS match_key FROM " + _COMMITS + ")"


@query(f"""WITH hits AS (SELECT k.* FROM {_KEYS} k JOIN {_TIPS} t ON k.repo_id = t.repo_id AND k.turn <= t.turn),
fresh AS (SELECT h.*, NOT EXISTS (SELECT 1 FROM hits b WHERE b.repo_id = h.repo_id AND b.match_key = h.match_key AND b.turn = h.turn - 1) AS fresh FROM hits h)
SELECT f.repo_id, 'main' AS branch, match_key, array_to_string(list_sort(list(f.hash) FILTER (WHERE fresh)), ',') AS first_commits, max_by(f.hash, f.turn) AS last_commit, max_by(f.hash, f.turn) = any_value(t.hash) AS on_tip
FROM fresh f JOIN {_TIPS} t ON f.repo_id = t.repo_id GROUP BY f.repo_id, match_key""")
def history_first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    keys = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: w.isin("the", "of", "que")))
    hits = commits.select("repo_id", "hash", F.explode(keys).alias("match_key"))
    return history.sightings(commits, _tips(commits), hits).withColumn("first_commits", F.array_join("first_commits", ","))


# Merges: every third turn from the third on has the turn three before it as a second parent. Two branches: the last
# turn, and the last one that is no multiple of three, so that each has commits which the other lacks.
_EDGES = f"(SELECT repo_id, hash, repo_id || '-' || p AS parent FROM (SELECT repo_id, hash, unnest(CASE WHEN turn >= 3 AND turn % 3 = 0 THEN [turn - 2, turn - 3] WHEN turn > 0 THEN [turn - 1] ELSE [] END) AS p FROM {_COMMITS}))"
_TWO_TIPS = f"""(SELECT repo_id, 'main' AS name, max_by(hash, turn) AS hash FROM {_COMMITS} GROUP BY repo_id
UNION ALL SELECT repo_id, 'side', max_by(hash, turn) FROM {_COMMITS} WHERE turn % 3 <> 0 GROUP BY repo_id)"""


def _merged_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, name = F.col("turn"), lambda t: F.concat_ws("-", "repo_id", t.cast("string"))
    parents = F.when((turn >= 3) & (turn % 3 == 0), F.array(name(turn - 2), name(turn - 3))).when(turn > 0, F.array(name(turn - 1))).otherwise(F.array().cast("array<string>"))
    return _commits(spark, sf_dir).withColumn("parents", parents)


def _two_tips(commits: DataFrame) -> DataFrame:
    last = lambda d, name: d.groupBy("repo_id").agg(F.max_by("hash", "turn").alias("hash")).select("repo_id", F.lit(name).alias("name"), "hash")
    return last(commits, "main").unionByName(last(commits.where("turn % 3 != 0"), "side"))


_REACH = f"reach AS (SELECT repo_id, name, hash FROM {_TWO_TIPS} UNION SELECT r.repo_id, r.name, e.parent FROM reach r JOIN {_EDGES} e ON r.hash = e.hash)"


@query(f"WITH RECURSIVE {_REACH} SELECT repo_id, hash FROM (SELECT DISTINCT repo_id, hash FROM {_COMMITS}) WHERE hash NOT IN (SELECT hash FROM reach)")
def dangling_with_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _merged_commits(spark, sf_dir)
    return history.dangling(commits, _two_tips(commits)).select("repo_id", "hash")


_HEIGHT = f"height AS (SELECT hash, 0 AS h FROM {_COMMITS} UNION SELECT e.hash, h + 1 FROM height JOIN {_EDGES} e ON e.parent = height.hash)"


@query(f"WITH RECURSIVE {_HEIGHT} SELECT c.repo_id, c.hash, max(h)::BIGINT AS generation FROM height JOIN {_COMMITS} c USING (hash) GROUP BY c.repo_id, c.hash")
def generations_with_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.generations(_merged_commits(spark, sf_dir))


@query(f"""WITH RECURSIVE {_REACH}, {_HEIGHT}, age AS (SELECT hash, max(h) AS age FROM height GROUP BY hash), hits AS (SELECT repo_id, hash, match_key FROM {_KEYS}),
fresh AS (SELECT h.*, NOT EXISTS (SELECT 1 FROM {_EDGES} e JOIN hits b ON b.hash = e.parent AND b.match_key = h.match_key WHERE e.hash = h.hash) AS fresh FROM hits h)
SELECT r.repo_id, r.name AS branch, match_key, coalesce(array_to_string(list_sort(list(r.hash) FILTER (WHERE fresh)), ','), '') AS first_commits, max_by(r.hash, (age, r.hash)) AS last_commit, max_by(r.hash, (age, r.hash)) = any_value(t.hash) AS on_tip
FROM reach r JOIN fresh f ON f.hash = r.hash JOIN age a ON a.hash = r.hash JOIN {_TWO_TIPS} t ON t.repo_id = r.repo_id AND t.name = r.name GROUP BY r.repo_id, r.name, match_key""")
def history_with_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sight on two branches of histories with merges."""
    commits = _merged_commits(spark, sf_dir)
    keys = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: w.isin("the", "of", "que")))
    hits = commits.select("repo_id", "hash", F.explode(keys).alias("match_key"))
    return history.sightings(commits, _two_tips(commits), hits).withColumn("first_commits", F.array_join("first_commits", ","))


@query(f"SELECT repo_id, hash, turn::BIGINT AS generation FROM {_COMMITS}")
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.generations(_commits(spark, sf_dir))


# --- policy and releases -------------------------------------------------------------------------------


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is a tag of its conversation whose previous one is the turn before; those that end in 5 skip one."""
    commits = _commits(spark, sf_dir)
    before = F.col("turn") - F.when(F.col("repo_id").endswith("5"), 2).otherwise(1)
    previous = F.when((F.col("turn") > 0) & (before >= 0), F.concat_ws("-", "repo_id", before.cast("string")))
    return commits.select("repo_id", F.concat(F.lit("v0.0."), "turn").alias("name"), "hash", previous.alias("previous"))


@query(f"""WITH tags AS (SELECT repo_id, 'v0.0.' || turn AS name, hash, CASE WHEN turn > 0 AND turn - CASE WHEN suffix(repo_id, '5') THEN 2 ELSE 1 END >= 0 THEN repo_id || '-' || (turn - CASE WHEN suffix(repo_id, '5') THEN 2 ELSE 1 END) END AS previous FROM {_COMMITS}),
free AS (SELECT * FROM tags t WHERE NOT EXISTS (SELECT 1 FROM tags o WHERE o.repo_id = t.repo_id AND o.previous = t.hash)),
n AS (SELECT repo_id, count(*) AS n, min_by(hash, name) AS hash, min(name) AS name FROM free GROUP BY repo_id)
SELECT repo_id, CASE WHEN n = 1 THEN name END AS name, CASE WHEN n = 1 THEN hash END AS hash, CASE WHEN n <> 1 THEN 'expected one latest tag, got ' || n END AS problem FROM n""")
def previous_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.previous_tag(_tags(spark, sf_dir))


@query("""WITH b AS (SELECT c_custkey, c_name AS ref, c_mktsegment AS hash, CASE WHEN c_custkey % 2 = 0 THEN 'tag' ELSE 'branch' END AS kind FROM customer),
n AS (SELECT ref, kind, CASE WHEN c_nationkey % 5 = 0 THEN hash || '!' ELSE hash END AS hash FROM b JOIN (SELECT c_custkey, c_nationkey FROM customer) USING (c_custkey) WHERE c_custkey % 7 <> 0)
SELECT 'all' AS repo_id, CASE WHEN n.hash IS NULL THEN b.kind || ' deleted' ELSE 'tag changed' END AS rule, b.ref AS object, coalesce(n.hash, b.hash) AS detail
FROM b LEFT JOIN n ON b.ref = n.ref AND b.kind = n.kind WHERE n.hash IS NULL OR (b.kind = 'tag' AND n.hash <> b.hash)""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer")
    before = people.select(F.lit("all").alias("repo_id"), F.when(F.col("c_custkey") % 2 == 0, "tag").otherwise("branch").alias("kind"), F.col("c_name").alias("ref"), F.col("c_mktsegment").alias("hash"), "c_custkey", "c_nationkey")
    now = before.where("c_custkey % 7 != 0").withColumn("hash", F.when(F.col("c_nationkey") % 5 == 0, F.concat("hash", F.lit("!"))).otherwise(F.col("hash")))
    return policy.snapshot_diff(before.drop("c_custkey", "c_nationkey"), now.drop("c_custkey", "c_nationkey"))


@query("SELECT DISTINCT user_id::VARCHAR AS email FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def identity_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("email"))
    return policy.missing_identities(known, table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("email")).distinct())


@query("SELECT n_name AS uri, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'all' END AS maintainers, coalesce(n_regionkey % 2 = 0, true) AS require_signed_tags FROM nation")
def rules_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = table(spark, sf_dir, "nation").select(F.col("n_name").alias("uri"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("maintainers"), (F.col("n_regionkey") % 2 == 0).alias("require_signed_tags"))
    shared = spark.createDataFrame([("all", True)], "maintainers string, require_signed_tags boolean")
    return policy.merged_policies(shared, repos, ["maintainers", "require_signed_tags"])


_REFS = f"(SELECT repo_id, 'refs/tags/v0.0.' || turn AS name, hash FROM {_COMMITS} UNION ALL SELECT repo_id, 'refs/remotes/origin/' || name, hash FROM {_TIPS})"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    tags = commits.select("repo_id", F.concat(F.lit("refs/tags/v0.0."), "turn").alias("name"), "hash")
    return tags.unionByName(_tips(commits).withColumn("name", F.concat(F.lit("refs/remotes/origin/"), "name")))


@query(f"SELECT repo_id, name AS ref, hash AS sha1 FROM {_REFS} WHERE name LIKE 'refs/tags/%'")
def exempt_tags_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.exempt_tags(_refs(spark, sf_dir)).select("repo_id", "ref", "sha1")


@query(f"""SELECT DISTINCT c.repo_id, c.hash AS sha1, t.name AS branch FROM (SELECT repo_id, hash FROM {_COMMITS} WHERE hash NOT IN (SELECT parent FROM {_COMMITS} WHERE parent IS NOT NULL) UNION SELECT repo_id, hash FROM {_TIPS}) c LEFT JOIN {_TIPS} t ON c.repo_id = t.repo_id AND c.hash = t.hash""")
def after_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.after_candidates(_commits(spark, sf_dir), _refs(spark, sf_dir), ["main"])


@query(f"""WITH c AS (SELECT *, role || '@example.com' AS email FROM {_COMMITS})
SELECT repo_id, rule, hash AS object, detail FROM (
  SELECT repo_id, hash, 'unknown committer' AS rule, email AS detail FROM c WHERE role = 'system'
  UNION ALL SELECT repo_id, hash, 'unsigned commit', '' FROM c WHERE turn % 3 = 0
  UNION ALL SELECT repo_id, hash, 'unknown signature', '' FROM c WHERE turn % 3 = 1
  UNION ALL SELECT repo_id, hash, 'gpg signatures are not allowed', '' FROM c WHERE turn % 3 = 2
  UNION ALL SELECT repo_id, hash, 'signature not checked', '' FROM c WHERE turn % 3 = 2)""")
def commit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are committers, of whom all but ``system`` are known; signatures go by turn."""
    kind = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "?").otherwise("-----BEGIN PGP SIGNATURE-----")
    person = F.struct(F.concat("role", F.lit("@example.com")).alias("email"))
    commits = _commits(spark, sf_dir).withColumns({"author": person, "committer": person, "signature": kind})
    known = spark.createDataFrame([("user@example.com", "u", True, False), ("assistant@example.com", "a", False, False)], "email string, identity string, maintainer boolean, forge boolean")
    return policy.check_commits(commits, known, commits.limit(0), {"allow_ssh_signatures": True})
