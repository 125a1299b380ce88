"""Release metadata: what annotated tags carry, links between releases, and signed envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats.
LINE = "Tag-metadata: "
PAYLOAD_TYPE = "application/vnd.in-toto+json"
STATEMENT, PREDICATE = "https://in-toto.io/Statement/v1", "https://in-toto.io/attestation/link/v0.3"
HASH = "struct<sha1:string,sha256:string>"
METADATA = f"struct<_type:string,repositoryUri:string,commitHash:{HASH},previousTag:{HASH},protectedBranches:array<struct<name:string,sha1:string,sha256:string>>,goRelease:struct<uri:string,directoryHash:string,goModHash:string>>"


def metadata_lines(message: Column) -> Column:
    return F.filter(F.split(message, "\n"), lambda x: x.startswith(LINE))


def decode_metadata(message: Column) -> Column:
    """The metadata in a tag's message; null unless just one line has it."""
    lines = metadata_lines(message)
    text = F.unbase64(F.substring(lines[0], len(LINE) + 1, 1 << 30)).cast("string")
    return F.when(F.size(lines) == 1, F.from_json(text, METADATA))


def encode_metadata(value: Column) -> Column:
    """The line for a tag's message; null fields are left out."""
    return F.concat(F.lit(LINE), F.regexp_replace(F.base64(F.to_json(value).cast("binary")), r"\s", ""))


def build_metadata(tags: DataFrame, type_: str = "tag-metadata/v0.1") -> DataFrame:
    """``tags`` (uri, commit_sha1, commit_sha256, previous_sha1, previous_sha256, branches, go_uri, go_directory,
    go_mod) with ``metadata``. Branches carry hashes of their own tips."""
    opt = lambda have, s: F.when(have.isNotNull(), s)
    return tags.withColumn(
        "metadata",
        F.struct(
            F.lit(type_).alias("_type"), F.col("uri").alias("repositoryUri"), F.struct(F.col("commit_sha1").alias("sha1"), F.col("commit_sha256").alias("sha256")).alias("commitHash"),
            opt(F.col("previous_sha1"), F.struct(F.col("previous_sha1").alias("sha1"), F.col("previous_sha256").alias("sha256"))).alias("previousTag"), F.col("branches").alias("protectedBranches"),
            opt(F.col("go_uri"), F.struct(F.col("go_uri").alias("uri"), F.col("go_directory").alias("directoryHash"), F.col("go_mod").alias("goModHash"))).alias("goRelease"),
        ),
    )


def previous_tag(tags: DataFrame) -> DataFrame:
    """Per repository the tag (repo_id, name, hash, previous) that no other names as its previous one.

    ``problem`` is null if there is just one; a tag named as previous by two others is a problem too.
    """
    free = tags.join(tags.where("previous is not null").select("repo_id", F.col("previous").alias("hash")).distinct(), ["repo_id", "hash"], "left_anti")
    twice = tags.where("previous is not null").groupBy("repo_id", "previous").count().where("count > 1").select("repo_id").distinct().withColumn("forked", F.lit(True))
    found = free.groupBy("repo_id").agg(F.count("*").alias("n"), F.min(F.struct("name", "hash")).alias("least"))
    every = tags.select("repo_id").distinct().join(found, "repo_id", "left").join(twice, "repo_id", "left")
    problem = F.when(F.col("forked"), "a tag is the previous one of several").when(F.coalesce("n", F.lit(0)) != 1, F.concat(F.lit("expected one latest tag, got "), F.coalesce("n", F.lit(0)).cast("string")))
    return every.select("repo_id", F.when(problem.isNull(), F.col("least.name")).alias("name"), F.when(problem.isNull(), F.col("least.hash")).alias("hash"), problem.alias("problem"))


def package_url(url: Column, at: Column | None = None) -> Column:
    """``git+<url>.git``, with ``@at`` where given."""
    out = F.concat(F.lit("git+"), url, F.lit(".git"))
    return F.concat(out, F.lit("@"), at) if at is not None else out


def h1_to_hex(h1: Column) -> Column:
    """The digest of an ``h1:`` directory hash in hex; null for anything else."""
    return F.when(h1.startswith("h1:"), F.lower(F.hex(F.unbase64(F.substring(h1, 4, 1 << 30)))))


def authentication_encoding(payload_type: Column, payload: Column) -> Column:
    """What is signed: ``DSSEv1``, and type and payload each after its length in bytes. Empty ones are an error."""
    empty = (F.octet_length(payload_type) == 0) | (F.octet_length(payload) == 0)
    text = F.concat(F.lit("DSSEv1 "), F.octet_length(payload_type).cast("string"), F.lit(" "), payload_type, F.lit(" "), F.octet_length(payload).cast("string"), F.lit(" "))
    return F.when(empty, F.raise_error(F.lit("type and payload must not be empty"))).otherwise(F.concat(text.cast("binary"), payload.cast("binary")))


def envelope(payload: Column, signatures: Column, payload_type: str = PAYLOAD_TYPE) -> Column:
    """A signed envelope of a payload; signatures: array of (keyid, sig, cert)."""
    return F.struct(F.lit(payload_type).alias("payloadType"), F.regexp_replace(F.base64(payload.cast("binary")), r"\s", "").alias("payload"), signatures.alias("signatures"))


def envelope_payload(body: Column) -> Column:
    return F.unbase64(body["payload"])


ENVELOPE = "struct<payloadType:string,payload:string,signatures:array<struct<keyid:string,sig:string,cert:string>>>"


def tag_links(tags: DataFrame) -> DataFrame:
    """``tags`` with ``link``: an in-toto statement on the tag, of the commit, of main and, where there is one,
    of the Go module and its go.mod.

    Columns: url, tag, tag_sha1, tag_sha256, commit_sha1, commit_sha256, main_sha1, main_sha256, go_uri, go_directory,
    go_mod, command (array), created (RFC 3339).
    """
    kind = "map<string,string>"
    at = lambda x: package_url(F.col("url"), x)

    def item(name, uri, digest: dict):
        pairs = [x for k, v in digest.items() for x in (F.lit(k), v)]
        return F.struct(name.alias("name"), uri.alias("uri"), F.create_map(*pairs).cast(kind).alias("digest"))

    git = lambda what, p: {what: F.col(f"{p}_sha1"), f"{what}_sha256": F.col(f"{p}_sha256")}
    go = F.col("go_uri").isNotNull()
    materials = F.array_compact(F.array(
        item(F.lit("commit"), at(F.col("commit_sha1")), git("gitCommit", "commit")),
        item(F.lit("refs/remotes/origin/main"), at(F.lit("main")), git("gitCommit", "main")),
        F.when(go, item(F.lit("goRelease"), F.col("go_uri"), {"dirHash1": h1_to_hex(F.col("go_directory"))})),
        F.when(go, item(F.lit("goRelease#go.mod"), F.concat("go_uri", F.lit("#go.mod")), {"dirHash1": h1_to_hex(F.col("go_mod"))})),
    ))
    predicate = F.struct(F.lit("tag").alias("name"), F.col("command"), materials.alias("materials"), F.create_map(F.lit("timestamp"), F.col("created")).alias("environment"))
    subject = F.array(item(F.lit("tag"), at(F.col("tag")), git("gitTag", "tag")))
    return tags.withColumn("link", F.struct(F.lit(STATEMENT).alias("_type"), subject.alias("subject"), F.lit(PREDICATE).alias("predicateType"), predicate.alias("predicate")))


def same_subject(a: Column, b: Column) -> Column:
    """Whether two statements have byte-equal subjects."""
    return F.to_json(a["subject"]) == F.to_json(b["subject"])
