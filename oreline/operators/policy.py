"""Policy checks on commits, tags and protected branches: every violation as a row.

A policy is a few small relations that are joined to commits and tags. Checks give rows
(repo_id, rule, object, detail); none means that all is well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.operators.filters import exclusive
from oreline.operators.history import first_parent_chain, heads, parent_edges, reachable

#: The rules and what holds where a configuration does not say.
RULES = {
    "allow_ssh_signatures": False, "require_ssh_user_present": True, "require_ssh_user_verified": True, "allow_ssh_sha256": False,
    "allow_gpg_signatures": False, "require_signed_tags": True, "require_merge_commits": True, "require_up_to_date": True,
}


#: The rule that signatures break where no result of a check is given.
UNCHECKED = "signature not checked"


def signature_type(signature: Column) -> Column:
    """``ssh``, ``gpg``, ``none`` or ``unknown``, by the armour's first line."""
    return (
        F.when(F.coalesce(signature, F.lit("")) == "", "none")
        .when(signature.startswith("-----BEGIN SSH SIGNATURE-----"), "ssh")
        .when(signature.startswith("-----BEGIN PGP SIGNATURE-----"), "gpg")
        .otherwise("unknown")
    )


def forge_email(user_id: Column, username: Column) -> Column:
    return F.concat(user_id.cast("string"), F.lit("+"), username, F.lit("@users.noreply.github.com"))


def emails(identities: DataFrame, roles: DataFrame) -> DataFrame:
    """``email, identity, maintainer, forge``: the addresses (also additional and forge ones) of identities
    (email, additional_emails, forge_username, forge_user_id) with a role (email, maintainer)."""
    known = identities.join(roles.groupBy("email").agg(F.max("maintainer").alias("maintainer")), "email")
    own = F.concat(F.array("email"), F.coalesce("additional_emails", F.array().cast("array<string>")))
    plain = known.select(F.explode(own).alias("address"), F.col("email").alias("identity"), "maintainer", F.lit(False).alias("forge"))
    forge = known.where("forge_username is not null and forge_user_id is not null").select(forge_email(F.col("forge_user_id"), F.col("forge_username")).alias("address"), F.col("email").alias("identity"), "maintainer", F.lit(True).alias("forge"))
    every = plain.unionByName(forge)
    # Two identities with one address: that it maintains holds if it does for one of them.
    return every.groupBy(F.col("address").alias("email"), "forge").agg(F.min("identity").alias("identity"), F.max("maintainer").alias("maintainer")).select("email", "identity", "maintainer", "forge")


def _violation(rows: DataFrame, rule: str, what: Column, when: Column, detail: Column | None = None) -> DataFrame:
    return rows.where(when).select("repo_id", F.lit(rule).alias("rule"), what.alias("object"), (detail if detail is not None else F.lit("")).alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def missing_identities(identities: DataFrame, roles: DataFrame) -> DataFrame:
    """Maintainers and contributors (email) without an identity."""
    return roles.join(identities.select("email"), "email", "left_anti")


def merged_policies(global_: DataFrame, repos: DataFrame, sections: list[str]) -> DataFrame:
    """Per repository (uri) each section: its own where it has one, else the global one, never a mix."""
    shared = F.broadcast(global_.select(*[F.col(s).alias(f"_{s}") for s in sections]))  # one row
    return repos.join(shared, F.lit(True), "left").select("uri", *[F.coalesce(s, f"_{s}").alias(s) for s in sections])


def invalid_afters(afters: DataFrame) -> DataFrame:
    """``after`` entries (uri, sha1, sha512, branch) with a malformed hash, or of a branch or hash that occurs twice."""
    bad = _all([
        afters.where(~F.coalesce(F.col("sha1").rlike("^[a-f0-9]{40}$"), F.lit(True))).select("uri", "sha1", "branch", F.lit("sha1").alias("problem")),
        afters.where(~F.coalesce(F.col("sha512").rlike("^[a-f0-9]{128}$"), F.lit(True))).select("uri", "sha1", "branch", F.lit("sha512").alias("problem")),
        afters.where("sha1 is null and sha512 is null").select("uri", "sha1", "branch", F.lit("no hash").alias("problem")),
    ])
    for column in ("branch", "sha1", "sha512"):
        twice = afters.where(F.col(column).isNotNull()).groupBy("uri", column).count().where("count > 1").drop("count")
        found = afters.join(twice, ["uri", column], "left_semi").select("uri", "sha1", "branch", F.lit(f"repeated {column}").alias("problem"))
        bad = bad.unionByName(found)
    return bad.distinct()


def ignored(commits: DataFrame, afters: DataFrame) -> DataFrame:
    """``repo_id, hash`` of the commits up to and including ``after`` ones (repo_id, hash)."""
    return reachable(parent_edges(commits), afters)


def check_commits(commits: DataFrame, known: DataFrame, skip: DataFrame, rules: dict, verified: DataFrame | None = None, forge: dict | None = None, states: DataFrame | None = None) -> DataFrame:
    """Violations of commits that ``skip`` (repo_id, hash) does not hold.

    known: as ``emails`` gives it. verified: as ``signatures.verified`` gives it; without it every signature is a
    violation of its own, "signature not checked". forge: email, allow_merge_commits, allow_content_commits of
    the forge that commits for its users. states: ``signatures.merge_states``, for merges a forge makes.
    """
    rules = RULES | rules
    plain = F.broadcast(known.where("not forge").select(F.col("email").alias("_email"), F.lit(True).alias("_plain")))
    every = F.broadcast(known.select(F.col("email").alias("_author")).distinct().withColumn("_any", F.lit(True)))
    rows = commits.join(skip, ["repo_id", "hash"], "left_anti").withColumn("kind", signature_type(F.col("signature")))
    rows = rows.join(plain, F.col("committer.email") == F.col("_email"), "left").join(every, F.col("author.email") == F.col("_author"), "left")
    rows = rows.join(verified.select("repo_id", "hash", "valid"), ["repo_id", "hash"], "left") if verified is not None else rows.withColumn("valid", F.lit(None).cast("boolean"))
    failed = "invalid signature" if verified is not None else UNCHECKED
    by_forge = F.col("committer.email") == forge["email"] if forge else F.lit(False)
    n = F.size("parents")
    h = F.col("hash")
    own = rows.where(~by_forge)
    out = [
        _violation(rows, "more than two parents", h, n > 2),
        _violation(own, "unknown committer", h, F.col("_plain").isNull(), F.col("committer.email")),
        _violation(own, "unsigned commit", h, F.col("kind") == "none"),
        _violation(own, "unknown signature", h, F.col("kind") == "unknown"),
        _violation(own, failed, h, F.col("kind").isin("ssh", "gpg") & ~F.coalesce("valid", F.lit(False))),
    ]
    for kind in ("ssh", "gpg"):
        if not rules[f"allow_{kind}_signatures"]:
            out.append(_violation(own, f"{kind} signatures are not allowed", h, F.col("kind") == kind))
    if forge:
        merges, content = bool(forge.get("allow_merge_commits")), bool(forge.get("allow_content_commits"))
        theirs = rows.where(by_forge)
        if not merges and not content:
            out.append(_violation(theirs, "forge is not allowed to make commits", h, F.lit(True)))
        if not merges:
            out.append(_violation(theirs, "forge is not allowed to merge", h, n > 1))
        out.append(_violation(theirs, "unknown author of a forge commit", h, F.col("_any").isNull(), F.col("author.email")))
        out.append(_violation(theirs, "forge commit without a valid signature" if verified is not None else UNCHECKED, h, (F.col("kind") == "none") | ~F.coalesce("valid", F.lit(False))))
        if merges and not content:
            clean = theirs.join(states.select("repo_id", "hash", "clean"), ["repo_id", "hash"], "left") if states is not None else theirs.withColumn("clean", F.lit(None).cast("boolean"))
            out.append(_violation(clean, "forge commit is no merge", h, n < 2))
            out.append(_violation(clean, "forge merge changes content" if states is not None else "merge not checked", h, (n > 1) & ~F.coalesce("clean", F.lit(False))))
    return _all(out)


def check_tags(refs: DataFrame, tags: DataFrame, known: DataFrame, exempt: DataFrame, rules: dict, verified: DataFrame | None = None) -> DataFrame:
    """Violations of tags: refs (repo_id, name, hash) below ``refs/tags/``, tags as the source gives them,
    exempt (repo_id, ref, sha1).

    Unsigned annotated tags are violations where signed tags are required, and allowed otherwise.
    """
    rules = RULES | rules
    refs = refs.where(F.col("name").startswith("refs/tags/")).select("repo_id", F.col("name").alias("ref"), "hash")
    rows = refs.join(exempt.select("repo_id", "ref", F.col("sha1").alias("_exempt")), ["repo_id", "ref"], "left")
    rows = rows.join(tags.select("repo_id", "hash", F.col("name").alias("tag"), F.col("tagger.email").alias("tagger"), "signature"), ["repo_id", "hash"], "left")
    by = F.broadcast(known.where("maintainer and not forge").select(F.col("email").alias("tagger"), F.lit(True).alias("_known")))
    rows = rows.join(by, "tagger", "left").withColumn("kind", signature_type(F.col("signature")))
    rows = rows.join(verified.select("repo_id", "hash", "valid"), ["repo_id", "hash"], "left") if verified is not None else rows.withColumn("valid", F.lit(None).cast("boolean"))
    ref, annotated, bound = F.col("ref"), F.col("tag").isNotNull(), F.col("_exempt").isNull()
    need = F.lit(bool(rules["require_signed_tags"]))
    signed = annotated & bound & F.col("kind").isin("ssh", "gpg")
    return _all([
        _violation(rows, "wrong hash of exempt tag", ref, F.col("_exempt") != F.col("hash"), F.col("hash")),
        _violation(rows, "ref does not match tag name", ref, annotated & (F.col("tag") != F.substring(ref, 11, 1 << 30)), F.col("tag")),
        _violation(rows, "unknown tagger", ref, annotated & bound & F.col("_known").isNull(), F.col("tagger")),
        _violation(rows, "unsigned annotated tag", ref, annotated & bound & (F.col("kind") == "none") & need),
        _violation(rows, "unknown signature", ref, annotated & bound & (F.col("kind") == "unknown")),
        _violation(rows, "invalid signature" if verified is not None else UNCHECKED, ref, signed & ~F.coalesce("valid", F.lit(False))),
        _violation(rows, "lightweight tag", ref, ~annotated & bound & need),
    ])


def check_protected(commits: DataFrame, tips: DataFrame, known: DataFrame, rules: dict, merges: DataFrame | None = None, forge: dict | None = None) -> DataFrame:
    """Violations on the first-parent chain of protected tips (repo_id, branch, hash, after), down to ``after``.

    merges: repo_id, hash, clean (the merge changes no content), up_to_date (the merge base is the first
    parent); merges without a row there, or all where it is not given, count as neither. Object is the
    branch or a commit.
    """
    rules = RULES | rules
    chain = first_parent_chain(parent_edges(commits), tips)
    chain = chain.join(tips.select("repo_id", F.col("hash").alias("start"), "branch", "after"), ["repo_id", "start"])
    end = chain.where(F.col("hash") == F.col("after")).select("repo_id", "branch", F.col("depth").alias("last"))
    lost = tips.join(end, ["repo_id", "branch"], "left_anti")
    rows = chain.join(end, ["repo_id", "branch"]).where("depth < last").join(commits.select("repo_id", "hash", "parents", "author", "committer"), ["repo_id", "hash"])
    makers = F.broadcast(known.where("maintainer and not forge").select(F.col("email").alias("_email"), F.lit(True).alias("_maintains")))
    authors = F.broadcast(known.where("maintainer").select(F.col("email").alias("_author")).distinct().withColumn("_author_maintains", F.lit(True)))
    rows = rows.join(makers, F.col("committer.email") == F.col("_email"), "left").join(authors, F.col("author.email") == F.col("_author"), "left")
    rows = rows.join(merges, ["repo_id", "hash"], "left") if merges is not None else rows.withColumns({"clean": F.lit(False), "up_to_date": F.lit(False)})
    by_forge = (F.col("committer.email") == forge["email"]) & F.col("_author_maintains").isNotNull() if forge else F.lit(False)
    merge, h, branch = F.size("parents") == 2, F.col("hash"), F.col("branch")
    out = [
        _violation(lost, "not a descendant of after", branch, F.lit(True), F.col("hash")),
        _violation(rows, "merge made by no maintainer", h, merge & F.col("_maintains").isNull() & ~by_forge, F.col("committer.email")),
        _violation(rows, "merge changes content", h, merge & ~F.coalesce("clean", F.lit(False)), branch),
    ]
    if rules["require_merge_commits"]:
        out.append(_violation(rows, "no merge commit", h, ~merge, branch))
    if rules["require_up_to_date"]:
        out.append(_violation(rows, "second parent is not up to date", h, merge & ~F.coalesce("up_to_date", F.lit(False)), branch))
    return _all(out)


def wrong_ids(commits: DataFrame) -> DataFrame:
    """Commits (raw) whose SHA-1 is not their id."""
    raw = F.concat(F.concat(F.lit("commit "), F.octet_length("raw").cast("string"), F.lit("\0")).cast("binary"), F.col("raw"))
    return _violation(commits, "wrong sha1", F.col("hash"), F.sha1(raw) != F.col("hash"))


def exempt_tags(refs: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """All tags as exemptions, descending by ref: ref, sha1 and, with sums (hash, sum), sha512."""
    rows = refs.where(F.col("name").startswith("refs/tags/")).select("repo_id", F.col("name").alias("ref"), F.col("hash").alias("sha1"))
    if sums is not None:
        rows = rows.join(sums.select("repo_id", F.col("hash").alias("sha1"), F.col("sum").alias("sha512")), ["repo_id", "sha1"], "left")
    return rows.orderBy("repo_id", F.desc("ref"))


def after_candidates(commits: DataFrame, refs: DataFrame, protected: list[str]) -> DataFrame:
    """``repo_id, sha1, branch``: tips of protected branches and commits that nothing points to; the branch is
    filled where just one name points there. Named ones come first, by name, then by hash."""
    name = F.regexp_replace("name", "^refs/(?:remotes/[^/]+|heads)/", "")
    branches = refs.where(F.col("name").rlike("^refs/(remotes/[^/]+|heads)/")).select("repo_id", "hash", name.alias("branch"))
    found = heads(commits).select("repo_id", "hash").union(branches.where(F.col("branch").isin(protected)).select("repo_id", "hash")).distinct()
    named = branches.groupBy("repo_id", "hash").agg(F.collect_set("branch").alias("names"))
    one = F.when(F.size("names") == 1, F.col("names")[0])
    return found.join(named, ["repo_id", "hash"], "left").select("repo_id", F.col("hash").alias("sha1"), one.alias("branch")).orderBy(F.asc_nulls_last("branch"), "sha1")


def snapshot(refs: DataFrame, protected: list[str], sums: DataFrame | None = None) -> DataFrame:
    """``repo_id, kind, ref, hash`` of tags and protected branches: what is kept to compare later. With sums
    (repo_id, hash, sum) also ``sha512``."""
    if sums is not None:
        return snapshot(refs, protected).join(sums.select("repo_id", "hash", F.col("sum").alias("sha512")), ["repo_id", "hash"], "left").select("repo_id", "kind", "ref", "hash", "sha512")
    name = F.regexp_replace("name", "^refs/(?:remotes/[^/]+|heads)/", "")
    kind = F.when(F.col("name").startswith("refs/tags/"), "tag").when(F.col("name").rlike("^refs/(remotes/[^/]+|heads)/") & name.isin(protected), "branch")
    return refs.select("repo_id", kind.alias("kind"), F.col("name").alias("ref"), "hash").where("kind is not null")


def snapshot_diff(before: DataFrame, now: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Tags that changed or went, branches that went or are no first-parent descendants of what they were."""
    new = now.select("repo_id", "kind", "ref", F.col("hash").alias("new"))
    rows = before.join(new, ["repo_id", "kind", "ref"], "left")
    ref, tag = F.col("ref"), F.col("kind") == "tag"
    out = [
        _violation(rows, "tag deleted", ref, tag & F.col("new").isNull(), F.col("hash")),
        _violation(rows, "tag changed", ref, tag & (F.col("new") != F.col("hash")), F.col("new")),
        _violation(rows, "branch deleted", ref, ~tag & F.col("new").isNull(), F.col("hash")),
    ]
    if commits is not None:
        moved = rows.where(~tag & (F.col("new") != F.col("hash")))
        chain = first_parent_chain(parent_edges(commits), moved.select("repo_id", F.col("new").alias("hash")))
        held = chain.select("repo_id", F.col("start").alias("new"), "hash").distinct()
        out.append(_violation(moved.join(held, ["repo_id", "new", "hash"], "left_anti"), "branch is no descendant", ref, F.lit(True), F.col("new")))
    return _all(out)


def connected(commits: DataFrame, targets: DataFrame, afters: DataFrame) -> DataFrame:
    """Targets (repo_id, hash) that descend from an ``after`` along first parents, or are ancestors of one."""
    edges = parent_edges(commits)
    down = first_parent_chain(edges, targets).join(afters, ["repo_id", "hash"], "left_semi").select("repo_id", F.col("start").alias("hash"))
    up = first_parent_chain(edges, afters).join(targets, ["repo_id", "hash"], "left_semi").select("repo_id", "hash")
    return down.union(up).distinct()


def verify(
    commits: DataFrame, tags: DataFrame, refs: DataFrame, policy: dict, known: DataFrame, *, verified: DataFrame | None = None, merges: DataFrame | None = None, sums: DataFrame | None = None,
    commit: str | None = None, tag: str | None = None, branch: str | None = None, tip: str | None = None, connected_to_after: bool = False,
) -> DataFrame:
    """All violations (repo_id, rule, object, detail) of repositories under a policy, sorted; none means that all is well.

    policy: rules, protected_branches, after (sha1 or sha512, branch), exempt_tags (ref, hash with sha1 or
    sha512), forge. known: as ``emails`` gives it. verified, merges: results of ``signatures.verified`` and
    ``signatures.merge_states``; what they do not cover is a violation. sums: repo_id, hash, sum (SHA-512)
    of commits and tags, needed where the policy names objects by it.

    Without a target everything is checked. commit, tag or branch: only what that reaches, down to the
    ``after`` commits; a target must exist, a tag must point to a commit, and a branch must stand at
    ``tip`` where that is given. connected_to_after: a target commit must also lie on a first-parent
    line with an ``after``.
    """
    rules, spark = RULES | (policy.get("rules") or {}), commits.sparkSession
    exclusive(commit=commit, tag=tag, branch=branch)
    named = sums.select("repo_id", "hash", F.col("sum").alias("sha512")) if sums is not None else commits.select("repo_id", "hash", F.lit(None).cast("string").alias("sha512"))
    ends = spark.createDataFrame([(a.get("sha1"), a.get("sha512"), a.get("branch")) for a in policy.get("after") or []], "a1 string, a512 string, a_branch string")
    objects = commits.select("repo_id", "hash").join(named, ["repo_id", "hash"], "left")
    afters = objects.join(F.broadcast(ends), (F.col("hash") == F.col("a1")) | (F.col("sha512") == F.col("a512"))).select("repo_id", "hash", "a_branch")
    wrong = afters.join(named.select("repo_id", "hash", F.col("sha512").alias("_now")), ["repo_id", "hash"]).join(F.broadcast(ends), F.col("hash") == F.col("a1")).where("a512 is not null and (_now is null or _now != a512)")
    skip = ignored(commits, afters.select("repo_id", "hash"))
    out = [_violation(wrong, "wrong sha512 of after", F.col("hash"), F.lit(True), F.col("_now")), wrong_ids(commits)]

    name = F.regexp_replace("name", "^refs/(?:remotes/[^/]+|heads)/", "")
    tips = refs.where(F.col("name").rlike("^refs/(remotes/[^/]+|heads)/")).select("repo_id", name.alias("branch"), "hash").distinct()
    protected = tips.where(F.col("branch").isin(list(policy.get("protected_branches") or [])))
    exempt = spark.createDataFrame([(e["ref"], (e.get("hash") or {}).get("sha1"), (e.get("hash") or {}).get("sha512")) for e in policy.get("exempt_tags") or []], "ref string, e1 string, e512 string")
    tag_refs = refs.where(F.col("name").startswith("refs/tags/"))
    target = None
    if commit:
        target = commits.where(F.col("hash") == commit).select("repo_id", "hash")
    elif tag:
        tag_refs = tag_refs.where(F.col("name") == f"refs/tags/{tag}")
        target = tag_refs.join(tags.select("repo_id", "hash", "target"), ["repo_id", "hash"], "left").select("repo_id", F.coalesce("target", "hash").alias("hash")).join(commits.select("repo_id", "hash"), ["repo_id", "hash"], "left_semi")
    elif branch:
        target = tips.where(F.col("branch") == branch).select("repo_id", "hash")
        protected = protected.where(F.col("branch") == branch)
        if tip:
            out.append(_violation(target, "branch is at another commit", F.col("hash"), F.col("hash") != tip, F.lit(branch)))
    checked = commits
    if target is not None:
        repos = commits.select("repo_id").distinct()
        out.append(_violation(repos.join(target, "repo_id", "left_anti"), "target does not exist", F.lit(commit or tag or branch), F.lit(True)))
        checked = commits.join(reachable(parent_edges(commits), target, stop=skip), ["repo_id", "hash"], "left_semi")
        if connected_to_after:
            lost = target.join(connected(commits, target, afters.select("repo_id", "hash")), ["repo_id", "hash"], "left_anti")
            out.append(_violation(lost, "not connected to an after commit", F.col("hash"), F.lit(True)))
    out.append(check_commits(checked, known, skip, rules, verified, policy.get("forge"), merges))
    if not commit and not branch:
        listed = tag_refs.join(F.broadcast(exempt), F.col("name") == F.col("ref")).join(named, ["repo_id", "hash"], "left")
        held = F.when(F.col("e1").isNotNull(), F.col("e1")).when(F.col("sha512") == F.col("e512"), F.col("hash")).otherwise("no such hash")
        out.append(check_tags(tag_refs, tags, known, listed.select("repo_id", "ref", held.alias("sha1")), rules, verified))
    if not commit and not tag:
        ends = afters.select(F.col("repo_id").alias("a_repo"), F.col("hash").alias("after"), "a_branch")
        own = protected.join(ends, (F.col("repo_id") == F.col("a_repo")) & (F.coalesce("a_branch", "branch") == F.col("branch")), "left").select("repo_id", "branch", "hash", "after")
        out.append(check_protected(commits, own, known, rules, merges, policy.get("forge")))
    return _all(out).distinct().orderBy("repo_id", "rule", "object", "detail")
