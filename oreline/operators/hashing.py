"""Re-hashing of Git objects and directories with other digests.

Trees are hashed bottom-up over all repositories at once; commits follow their parents round by round,
rewriting only the ids in the raw bytes, so unusual headers keep their place.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.operators.storage import stored

DEFAULT = "sha512"


def digest(data: Column, algorithm: str = DEFAULT) -> Column:
    """Lower-case hex: sha1, sha256 and sha512 on the JVM; sha3-256, sha3-512 and blake2b-64 (64 bytes) by a pandas UDF."""
    if algorithm == "sha1":
        return F.sha1(data)
    if algorithm in ("sha256", "sha512"):
        return F.sha2(data, int(algorithm[3:]))
    name = {"sha3-256": "sha3_256", "sha3-512": "sha3_512", "blake2b-64": "blake2b"}[algorithm]

    @F.pandas_udf("string")
    def compute(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.new(name, bytes(v)).hexdigest())

    return compute(data)


def object_hash(kind: str, data: Column, algorithm: str = DEFAULT) -> Column:
    """The id of an object: the digest of its kind, length, a zero byte and its bytes."""
    raw = data.cast("binary")
    head = F.concat(F.lit(kind + " "), F.octet_length(raw).cast("string"), F.lit("\0")).cast("binary")
    return digest(F.concat(head, raw), algorithm)


def blob_sums(blobs: DataFrame, algorithm: str = DEFAULT) -> DataFrame:
    """``repo_id, hash, sum`` of blobs (repo_id, hash, data); equal blobs are hashed once per repository."""
    return blobs.dropDuplicates(["repo_id", "hash"]).select("repo_id", "hash", object_hash("blob", F.col("data"), algorithm).alias("sum"))


def tree_sums(entries: DataFrame, sums: DataFrame, algorithm: str = DEFAULT) -> DataFrame:
    """``repo_id, hash, sum`` of trees, from their entries in stored order (ord) and the sums of blobs.

    Submodule entries keep their ids. Each round hashes the trees whose sub-trees are all done.
    """
    entries = entries.withColumn("mode", F.ltrim("mode", F.lit("0")))
    left = stored(entries)
    done = sums
    trees = None
    while not left.isEmpty():
        known = left.join(done.withColumnRenamed("sum", "new"), ["repo_id", "hash"], "left")
        new = F.when(F.col("mode") == "160000", F.col("hash")).otherwise(F.col("new"))
        name = F.col("name_bytes") if "name_bytes" in entries.columns else F.col("name").cast("binary")
        line = F.concat(F.concat(F.col("mode"), F.lit(" ")).cast("binary"), name, F.lit("\0").cast("binary"), F.unhex(new))
        grouped = known.groupBy("repo_id", "tree_hash").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"), F.count_if(new.isNull()).alias("open"))
        ready = grouped.where("open = 0").select("repo_id", F.col("tree_hash").alias("hash"), F.aggregate("lines", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["line"])).alias("data"))
        round_ = stored(ready.select("repo_id", "hash", object_hash("tree", F.col("data"), algorithm).alias("sum")))
        if round_.isEmpty():
            missing = left.select("repo_id", "tree_hash").first()
            raise ValueError(f"tree {missing.tree_hash} of {missing.repo_id} has entries that are not there")
        trees = round_ if trees is None else trees.unionByName(round_)
        done = done.unionByName(round_)
        left = stored(left.join(round_.select("repo_id", F.col("hash").alias("tree_hash")), ["repo_id", "tree_hash"], "left_anti"))
    return trees if trees is not None else sums.limit(0)



def commit_sums(commits: DataFrame, trees: DataFrame, algorithm: str = DEFAULT) -> DataFrame:
    """``repo_id, hash, sum`` of commits (repo_id, hash, tree_hash, parents, raw): the ids of the tree and the
    parents in the head of the raw bytes become the new ones, all else stays byte for byte.

    Parents that are not in the table (shallow history) are an error.
    """
    tree = trees.select("repo_id", F.col("hash").alias("tree_hash"), F.col("sum").alias("tree_sum"))
    left = stored(commits.select("repo_id", "hash", "tree_hash", "parents", "raw").join(tree, ["repo_id", "tree_hash"]))
    done = None
    while not left.isEmpty():
        parents = left.select("repo_id", "hash", F.posexplode_outer("parents").alias("nth", "parent"))
        if done is None:
            ready = parents.groupBy("repo_id", "hash").agg(F.count("parent").alias("open"), F.array().cast("array<string>").alias("sums"))
        else:
            known = parents.join(done.select("repo_id", F.col("hash").alias("parent"), F.col("sum").alias("new")), ["repo_id", "parent"], "left")
            lines = F.array_sort(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("nth", "new"))))
            ready = known.groupBy("repo_id", "hash").agg(F.count_if(F.col("parent").isNotNull() & F.col("new").isNull()).alias("open"), F.transform(lines, lambda x: x["new"]).alias("sums"))
        ready = left.join(ready.where("open = 0"), ["repo_id", "hash"])
        # "tree <40>\n", then "parent <40>\n" for each parent: all before the author line.
        old = F.lit(46) + 48 * F.size("parents")
        head = F.concat(F.lit("tree "), F.col("tree_sum"), F.lit("\n"), F.array_join(F.transform("sums", lambda s: F.concat(F.lit("parent "), s, F.lit("\n"))), ""))
        data = F.concat(head.cast("binary"), F.substring("raw", old + 1, F.octet_length("raw")))
        round_ = stored(ready.select("repo_id", "hash", object_hash("commit", data, algorithm).alias("sum")))
        if round_.isEmpty():
            raise ValueError("commits with parents that are not there")
        done = round_ if done is None else done.unionByName(round_)
        left = stored(left.join(round_, ["repo_id", "hash"], "left_anti"))
    return done if done is not None else trees.limit(0)


def tag_sums(tags: DataFrame, commits: DataFrame, algorithm: str = DEFAULT) -> DataFrame:
    """``repo_id, hash, sum`` of annotated tags of commits (repo_id, hash, target, raw)."""
    new = commits.select("repo_id", F.col("hash").alias("target"), F.col("sum").alias("new"))
    data = F.concat(F.concat(F.lit("object "), F.col("new"), F.lit("\n")).cast("binary"), F.substring("raw", F.lit(49), F.octet_length("raw")))
    return tags.join(new, ["repo_id", "target"]).select("repo_id", "hash", object_hash("tag", data, algorithm).alias("sum"))


def mismatches(sums: DataFrame) -> DataFrame:
    """Objects whose recomputed SHA-1 is not their id."""
    return sums.where("sum != hash")


# --- directory hashes -------------------------------------------------------------------------------


def directory_hash(files: DataFrame, by: list[str], name: str, data: str) -> DataFrame:
    """Columns ``by`` and ``h1`` over the files of each directory: ``h1:`` and the base64 SHA-256 of the sorted
    lines of hex SHA-256, two blanks, name, line feed. Names are sorted by code point."""
    line = F.struct(F.col(name).alias("name"), F.concat(F.sha2(F.col(data).cast("binary"), 256), F.lit("  "), F.col(name), F.lit("\n")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "")
    return files.groupBy(*by).agg(F.concat(F.lit("h1:"), F.base64(F.unhex(F.sha2(lines, 256)))).alias("h1"))


def not_ignored(path: Column) -> Column:
    """Files outside of ``.git/`` and ``.idea/``."""
    return ~path.rlike(r"(^|/)\.(git|idea)/")


def module_files(files: DataFrame) -> DataFrame:
    """``repo_id, module_dir, path, name, data``: the files of every directory with a go.mod.

    A file belongs to the nearest such directory above it; a module without LICENSE takes the root's.
    """
    dirs = files.where(F.col("path").rlike(r"(^|/)go\.mod$")).select("repo_id", F.regexp_extract("path", r"^(.*/|)go\.mod$", 1).alias("module_dir"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.when(k > 0, "/").otherwise("")))
    near = files.select("repo_id", "path", "data", F.explode(above).alias("module_dir")).join(dirs, ["repo_id", "module_dir"])
    own = near.groupBy("repo_id", "path").agg(F.max(F.struct(F.length("module_dir").alias("n"), "module_dir"))["module_dir"].alias("module_dir"))
    found = files.select("repo_id", "path", "data").join(own, ["repo_id", "path"])
    found = found.withColumn("name", F.substr("path", F.length("module_dir") + 1))
    licence = files.where("path = 'LICENSE'").select("repo_id", F.col("path"), "data", F.lit("LICENSE").alias("name"))
    lacking = dirs.join(found.where("name = 'LICENSE'").select("repo_id", "module_dir"), ["repo_id", "module_dir"], "left_anti")
    return found.select("repo_id", "module_dir", "path", "name", "data").unionByName(lacking.join(licence, "repo_id").select("repo_id", "module_dir", "path", "name", "data"))


def module_name(go_mod: Column) -> Column:
    return F.regexp_extract(go_mod.cast("string"), r"(?m)^module[ \t]+\"?([^\s\"]+)", 1)


def module_hashes(files: DataFrame, version: Column | str = "") -> DataFrame:
    """``repo_id, directory, module, version, directory_hash, go_mod_hash`` of every module, sorted by directory."""
    version = F.lit(version) if isinstance(version, str) else version
    own = module_files(files)
    mods = own.where("name = 'go.mod'").select("repo_id", "module_dir", module_name(F.col("data")).alias("module"), F.col("data").alias("go_mod"))
    named = own.join(mods, ["repo_id", "module_dir"]).withColumn("line", F.concat(F.col("module"), F.lit("@"), version, F.lit("/"), F.col("name")))
    whole = directory_hash(named, ["repo_id", "module_dir", "module"], "line", "data")
    single = directory_hash(mods.withColumn("name", F.lit("go.mod")), ["repo_id", "module_dir"], "name", "go_mod").withColumnRenamed("h1", "go_mod_hash")
    out = whole.join(single, ["repo_id", "module_dir"])
    return out.select("repo_id", F.rtrim("module_dir", F.lit("/")).alias("directory"), "module", version.alias("version"), F.col("h1").alias("directory_hash"), "go_mod_hash").orderBy("repo_id", "directory")


def pseudo_version(tag: Column, exact: Column, when_unix: Column, commit: Column) -> Column:
    """The version of a commit: its own tag; after an earlier tag that with the patch raised and the commit's
    UTC time and first 12 digits; without any, v0.0.0."""
    mark = F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(when_unix), F.current_timezone()), "yyyyMMddHHmmss"), F.lit("-"), F.left(commit, F.lit(12)))
    part = F.split(tag, r"\.")
    raised = F.concat(part[0], F.lit("."), part[1], F.lit("."), (part[2].cast("int") + 1).cast("string"), F.lit("-0."), mark)
    return F.when(tag.isNull(), F.concat(F.lit("v0.0.0-"), mark)).when(exact, tag).otherwise(raised)


def newest_tags(chain: DataFrame, tags: DataFrame) -> DataFrame:
    """``repo_id, start, tag, depth``: the nearest tag (repo_id, name, target) on a first-parent chain.

    A commit with several tags or one that is no semantic version is an error.
    """
    first = chain.join(tags.select("repo_id", F.col("target").alias("hash"), F.col("name").alias("tag")), ["repo_id", "hash"])
    at = first.groupBy("repo_id", "start", "depth").agg(F.collect_set("tag").alias("tags"))
    near = at.groupBy("repo_id", "start").agg(F.min(F.struct("depth", "tags")).alias("m"))
    bad = F.raise_error(F.concat(F.lit("expected one semantic version at a commit, got "), F.array_join("m.tags", ", ")))
    good = (F.size("m.tags") == 1) & F.col("m.tags")[0].rlike(r"^v\d+\.\d+\.\d+$")
    return near.select("repo_id", "start", F.when(good, F.col("m.tags")[0]).otherwise(bad).alias("tag"), F.col("m.depth").alias("depth"))


def split_version(name: Column) -> Column:
    """``module`` and ``version`` of ``module@version``."""
    parts = F.split(name, "@")
    return F.struct(parts[0].alias("module"), F.get(parts, F.lit(1)).alias("version"))


def tree_self_check(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Trees whose SHA-1, recomputed from their blobs, is not their id."""
    return mismatches(tree_sums(entries, blob_sums(blobs, "sha1"), "sha1"))


