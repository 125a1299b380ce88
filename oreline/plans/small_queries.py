"""More registered queries: the small operators on paths, refs, policies, hashes and releases, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.functions.charset import Match
from oreline.operators import filters, hashing, policy, release
from oreline.operators.search import Parameters, Search
from oreline.plans.oracle import search_ctes
from oreline.plans.queries import _COMMITS, _PATH, _commits, _pages, query, table
from oreline.sources import sinks

# --- paths and addresses ------------------------------------------------------------------------------


@query(f"SELECT page_id, {_PATH} AS path FROM pages WHERE starts_with({_PATH}, 'en/') AND {_PATH} NOT IN ('en/7', 'en/8')")
def path_filter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filters.PathFilter(exclude=("/en/7", "/en/8"), sub_path="en/")
    return _pages(spark, sf_dir).where(chosen.condition(F.col("path"))).select("page_id", "path")


@query("SELECT DISTINCT lang AS org, source AS repo FROM documents WHERE lang || '/' || source IN ('en/' || source, 'de/' || source) AND lang <> 'de'")
def repo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = table(spark, sf_dir, "documents").select(F.col("lang").alias("org"), F.col("source").alias("repo")).distinct()
    every = [f"{o}/{r.repo}" for r in repos.select("repo").distinct().collect() for o in ("en", "de")]
    return filters.select_repos(repos, include=every, exclude=[x for x in every if x.startswith("de/")])


@query(r"""SELECT page_id, CASE WHEN found <> '' THEN string_split(found, '/')[1] END AS owner, CASE WHEN found <> '' THEN string_split(found, '/')[2] END AS repo
FROM (SELECT page_id, regexp_replace(regexp_extract('git@github.com:' || regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '^(?:https://github\.com/|git@github\.com:)([^/]+/[^/]+?)/?$', 1), '\.git$', '') AS found FROM pages)""")
def remote_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.remote_owner_and_repo(F.concat(F.lit("git@github.com:"), "path"))
    return _pages(spark, sf_dir).select("page_id", found["owner"].alias("owner"), found["repo"].alias("repo"))


@query("SELECT page_id, CASE WHEN starts_with(u, 'https://') THEN u ELSE 'https://' || u END AS uri FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^[a-z]+://', '') ELSE 'https://' || regexp_replace(url, '^[a-z]+://', '') END AS u FROM pages)")
def uri_with_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", filters.with_scheme(F.when(F.col("page_id") % 2 == 0, bare).otherwise(F.concat(F.lit("https://"), bare))).alias("uri"))


@query(r"SELECT page_id, regexp_matches(u, '^git\+(https|ssh)://[^?#]*\.git$') AS good FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'git+https://h/' || page_id || '.git' WHEN 1 THEN 'git+http://h/' || page_id || '.git' ELSE 'git+ssh://h/' || page_id END AS u FROM pages)")
def repository_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    uri = F.when(n % 3 == 0, F.concat(F.lit("git+https://h/"), n, F.lit(".git"))).when(n % 3 == 1, F.concat(F.lit("git+http://h/"), n, F.lit(".git"))).otherwise(F.concat(F.lit("git+ssh://h/"), n))
    return table(spark, sf_dir, "pages").select("page_id", filters.is_repository_uri(uri).alias("good"))


_DIGESTS = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha1(coalesce(text, '')) WHEN 1 THEN upper(sha1(coalesce(text, ''))) WHEN 2 THEN sha256(coalesce(text, '')) || sha256(coalesce(text, '')) ELSE 'v1.' || doc_id || '.0' END AS h FROM documents)"


@query(rf"SELECT doc_id, regexp_matches(h, '^[a-f0-9]{{40}}$') AS sha1, regexp_matches(h, '^[a-f0-9]{{128}}$') AS sha512, regexp_matches(h, '^v[0-9]+\.[0-9]+\.[0-9]+$') AS semver FROM {_DIGESTS}")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = F.coalesce("text", F.lit("")), F.col("doc_id")
    h = F.when(n % 4 == 0, F.sha1(text)).when(n % 4 == 1, F.upper(F.sha1(text))).when(n % 4 == 2, F.concat(F.sha2(text, 256), F.sha2(text, 256))).otherwise(F.concat(F.lit("v1."), n, F.lit(".0")))
    return table(spark, sf_dir, "documents").select("doc_id", filters.is_sha1(h).alias("sha1"), filters.is_sha512(h).alias("sha512"), filters.is_semver(h).alias("semver"))


@query(f"SELECT repo_id, turn, CASE turn % 3 WHEN 0 THEN 'b/' || turn WHEN 1 THEN 'b/' || turn ELSE 'refs/tags/' || turn END AS branch FROM {_COMMITS}")
def branch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    ref = F.when(turn % 3 == 0, F.concat(F.lit("refs/heads/b/"), turn)).when(turn % 3 == 1, F.concat(F.lit("refs/remotes/origin/b/"), turn)).otherwise(F.concat(F.lit("refs/tags/"), turn))
    return _commits(spark, sf_dir).select("repo_id", "turn", filters.branch_name(ref).alias("branch"))


# --- text output --------------------------------------------------------------------------------------

_SHORT = Search(["der", "of"], Parameters(Match.NORMALIZED))


@query(search_ctes(_SHORT, "documents", "doc_id", "text") + "SELECT doc_id || ':' || line_number || ':' || \"column\" || ':' || original || ':' || matched_text AS value FROM found")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _SHORT.match(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumnRenamed("doc_id", "path")
    return found.select(sinks.text_line(found, column=True, keyword=True).alias("value"))


@query(search_ctes(_SHORT, "documents", "doc_id", "text") + """SELECT path, value FROM (SELECT doc_id::VARCHAR AS path, line_number || ':' || matched_text AS value, original, "column", line_number FROM found) GROUP BY path, value, original, "column", line_number
UNION ALL SELECT DISTINCT doc_id::VARCHAR, doc_id::VARCHAR FROM found""")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _SHORT.match(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("path", F.col("doc_id").cast("string"))
    return sinks.text_output(found, heading=True).select("path", "value")


@query(search_ctes(_SHORT, "documents", "doc_id", "text") + "SELECT count(*) AS matches, count(DISTINCT doc_id) AS files_with_matches, (SELECT count(*) FROM documents) AS files, (SELECT coalesce(sum(strlen(text)), 0)::BIGINT FROM documents) AS bytes FROM found")
def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sinks.stats(_SHORT.match(docs, ["doc_id"], "text"), docs, "doc_id", "text")


# --- policy -------------------------------------------------------------------------------------------


@query(f"SELECT repo_id, turn, CASE turn % 4 WHEN 0 THEN 'ssh' WHEN 1 THEN 'gpg' WHEN 2 THEN 'none' ELSE 'unknown' END AS kind FROM {_COMMITS}")
def signature_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    text = F.when(turn % 4 == 0, "-----BEGIN SSH SIGNATURE-----\nx").when(turn % 4 == 1, "-----BEGIN PGP SIGNATURE-----\nx").when(turn % 4 == 3, "-----BEGIN X-----")
    return _commits(spark, sf_dir).select("repo_id", "turn", policy.signature_type(text).alias("kind"))


@query("SELECT c_custkey, c_custkey || '+' || c_name || '@users.noreply.github.com' AS email FROM customer")
def forge_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", policy.forge_email(F.col("c_custkey"), F.col("c_name")).alias("email"))


_AFTERS = "(SELECT n_regionkey::VARCHAR AS uri, CASE WHEN n_nationkey % 4 = 0 THEN 'x' WHEN n_nationkey % 4 < 3 THEN sha1(n_name) END AS sha1, CASE WHEN n_nationkey % 2 = 1 AND n_nationkey % 4 < 3 THEN sha256(n_name) || sha256(n_name) END AS sha512, CASE WHEN n_nationkey % 3 = 0 THEN 'main' ELSE n_name END AS branch FROM nation)"


@query(f"""SELECT DISTINCT uri, sha1, branch, problem FROM (
  SELECT *, 'sha1' AS problem FROM {_AFTERS} WHERE NOT regexp_matches(sha1, '^[a-f0-9]{{40}}$')
  UNION ALL SELECT *, 'sha512' FROM {_AFTERS} WHERE NOT regexp_matches(sha512, '^[a-f0-9]{{128}}$')
  UNION ALL SELECT *, 'no hash' FROM {_AFTERS} WHERE sha1 IS NULL AND sha512 IS NULL
  UNION ALL SELECT *, 'repeated branch' FROM {_AFTERS} a WHERE (SELECT count(*) FROM {_AFTERS} b WHERE b.uri = a.uri AND b.branch = a.branch) > 1
  UNION ALL SELECT *, 'repeated sha1' FROM {_AFTERS} a WHERE (SELECT count(*) FROM {_AFTERS} b WHERE b.uri = a.uri AND b.sha1 = a.sha1) > 1
  UNION ALL SELECT *, 'repeated sha512' FROM {_AFTERS} a WHERE (SELECT count(*) FROM {_AFTERS} b WHERE b.uri = a.uri AND b.sha512 = a.sha512) > 1)""")
def after_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name = F.col("n_nationkey"), F.col("n_name")
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("string").alias("uri"), F.when(n % 4 == 0, "x").when(n % 4 < 3, F.sha1(name.cast("binary"))).alias("sha1"),
        F.when((n % 2 == 1) & (n % 4 < 3), F.concat(F.sha2(name.cast("binary"), 256), F.sha2(name.cast("binary"), 256))).alias("sha512"), F.when(n % 3 == 0, "main").otherwise(name).alias("branch"),
    )
    return policy.invalid_afters(rows)


@query("""WITH i AS (SELECT c_custkey, c_name AS email, 'x' || c_custkey % 50 AS other, c_custkey % 3 = 0 AS maintainer FROM customer WHERE c_custkey <= 200)
SELECT email, min(identity) AS identity, bool_or(maintainer) AS maintainer, forge FROM (
  SELECT email, email AS identity, maintainer, false AS forge FROM i UNION ALL SELECT other, email, maintainer, false FROM i
  UNION ALL SELECT c_custkey || '+u' || c_custkey || '@users.noreply.github.com', email, maintainer, true FROM i WHERE c_custkey % 2 = 0) GROUP BY email, forge""")
def identity_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that several identities share maintain if one of these does."""
    n = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").where(n <= 200)
    identities = people.select(F.col("c_name").alias("email"), F.array(F.concat(F.lit("x"), n % 50)).alias("additional_emails"), F.when(n % 2 == 0, F.concat(F.lit("u"), n)).alias("forge_username"), n.cast("string").alias("forge_user_id"))
    return policy.emails(identities, people.select(F.col("c_name").alias("email"), (n % 3 == 0).alias("maintainer")))


@query(f"""SELECT repo_id, CASE WHEN starts_with(name, 'refs/tags/') THEN 'tag' ELSE 'branch' END AS kind, name AS ref, hash FROM (
  SELECT repo_id, CASE turn % 3 WHEN 0 THEN 'refs/tags/' || turn WHEN 1 THEN 'refs/heads/main' ELSE 'refs/remotes/origin/x' || turn END AS name, hash FROM {_COMMITS}) WHERE starts_with(name, 'refs/tags/') OR name = 'refs/heads/main'""")
def state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    name = F.when(turn % 3 == 0, F.concat(F.lit("refs/tags/"), turn)).when(turn % 3 == 1, "refs/heads/main").otherwise(F.concat(F.lit("refs/remotes/origin/x"), turn))
    return policy.snapshot(_commits(spark, sf_dir).select("repo_id", name.alias("name"), "hash"), ["main"])


# --- hashes and releases ------------------------------------------------------------------------------


@query(r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'v0.0.0-' || mark WHEN 1 THEN 'v1.2.' || doc_id ELSE 'v1.2.' || (doc_id + 1) || '-0.' || mark END AS version
FROM (SELECT doc_id, strftime(make_timestamp((1700000000 + doc_id * 1000)::BIGINT * 1000000), '%Y%m%d%H%M%S') || '-' || left(sha1(doc_id::VARCHAR), 12) AS mark FROM documents)""")
def pseudo_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    tag = F.when(n % 3 != 0, F.concat(F.lit("v1.2."), n))
    version = hashing.pseudo_version(tag, n % 3 == 1, n * 1000 + 1700000000, F.sha1(n.cast("string").cast("binary")))
    return table(spark, sf_dir, "documents").select("doc_id", version.alias("version"))


@query("SELECT doc_id, 'example.com/m' || doc_id AS module, 'h1:' || to_base64(unhex(sha256(sha256('module example.com/m' || doc_id || chr(10) || 'go 1.20' || chr(10)) || '  go.mod' || chr(10)))) AS h1 FROM documents")
def go_mod_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("module example.com/m"), "doc_id", F.lit("\ngo 1.20\n"))
    files = table(spark, sf_dir, "documents").select("doc_id", hashing.module_name(text).alias("module"), text.alias("data"), F.lit("go.mod").alias("name"))
    return hashing.directory_hash(files, ["doc_id", "module"], "name", "data")


@query("SELECT doc_id, doc_id % 3 = 2 AS kept FROM documents")
def ignored_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    path = F.when(n % 3 == 0, F.concat(F.lit("a/.git/"), n)).when(n % 3 == 1, F.concat(F.lit(".idea/"), n)).otherwise(F.concat(F.lit("a/.gitx/"), n))
    return table(spark, sf_dir, "documents").select("doc_id", hashing.not_ignored(path).alias("kept"))


@query("SELECT doc_id, 'm' || doc_id AS module, CASE WHEN doc_id % 2 = 0 THEN 'v1.0.' || doc_id END AS version FROM documents")
def module_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    found = hashing.split_version(F.when(n % 2 == 0, F.concat(F.lit("m"), n, F.lit("@v1.0."), n)).otherwise(F.concat(F.lit("m"), n)))
    return table(spark, sf_dir, "documents").select("doc_id", found["module"].alias("module"), found["version"].alias("version"))


@query("SELECT page_id, 'git+' || url || '.git' AS plain, 'git+' || url || '.git@v' || page_id AS at_tag FROM pages")
def package_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", release.package_url(F.col("url")).alias("plain"), release.package_url(F.col("url"), F.concat(F.lit("v"), "page_id")).alias("at_tag"))


@query("SELECT page_id, '{\"payloadType\":\"application/vnd.in-toto+json\",\"payload\":\"' || to_base64(encode(url)) || '\",\"signatures\":[{\"keyid\":\"k\",\"sig\":\"s' || page_id || '\"}]}' AS envelope, url AS payload FROM pages WHERE url IS NOT NULL")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = release.envelope(F.col("url"), F.array(F.struct(F.lit("k").alias("keyid"), F.concat(F.lit("s"), "page_id").alias("sig"), F.lit(None).cast("string").alias("cert"))))
    rows = table(spark, sf_dir, "pages").where("url is not null").select("page_id", made.alias("e"))
    return rows.select("page_id", F.to_json("e").alias("envelope"), release.envelope_payload(F.col("e")).cast("string").alias("payload"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS uri, CASE WHEN n_nationkey % 3 <> 0 THEN sha1(n_name) END AS sha1 FROM nation")
def tag_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata made and read again; every third message has two such lines, which counts as none."""
    null, name = F.lit(None).cast("string"), F.col("n_name")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", name.alias("uri"), F.sha1(name.cast("binary")).alias("commit_sha1"), null.alias("commit_sha256"), null.alias("previous_sha1"), null.alias("previous_sha256"), F.lit(None).cast("array<struct<name:string,sha1:string,sha256:string>>").alias("branches"), null.alias("go_uri"), null.alias("go_directory"), null.alias("go_mod"))
    line = release.encode_metadata(F.col("metadata"))
    made = release.build_metadata(rows).withColumn("message", F.concat(F.lit("release\n\n"), line, F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("\n"), line)).otherwise("")))
    read = made.withColumn("m", release.decode_metadata(F.col("message")))
    return read.select("n_nationkey", F.col("m.repositoryUri").alias("uri"), F.col("m.commitHash.sha1").alias("sha1"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS same FROM nation")
def countersigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = lambda x: F.struct(F.array(F.struct(F.lit("tag").alias("name"), x.alias("uri"))).alias("subject"))
    other = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("!")))
    return table(spark, sf_dir, "nation").select("n_nationkey", release.same_subject(statement(F.col("n_name")), statement(other)).alias("same"))
