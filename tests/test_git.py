"""Object graphs of real repositories, with git's own answers as the expected ones."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from oreline.functions.charset import Match
from oreline.operators import hashing, history, policy, release, signatures
from oreline.operators.search import Parameters, Search
from oreline.sources import config, git


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("org") / "repo")
    env = os.environ | {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "A B"), ("EMAIL", "a@example.com"), ("DATE", "1700000000 +0200"))} | {"GIT_CONFIG_GLOBAL": "/dev/null"}

    def run(*args):
        return subprocess.run(["git", "-C", path, *args], env=env, check=True, capture_output=True, text=True).stdout.strip()

    def write(name, text):
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        with open(f"{path}/{name}", "w") as f:
            f.write(text)
        run("add", "-A")

    os.makedirs(path)
    run("init", "-q", "-b", "main")
    write("go.mod", "module example.com/m\n")
    write("a/b/x.go", "one\n")
    run("commit", "-qm", "first")
    run("tag", "-a", "-m", "tag", "v0.0.1")
    run("checkout", "-qb", "side")
    write("a/c/x.go", "one\n")
    run("commit", "-qm", "side")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-ff", "-m", "merge", "side")
    run("checkout", "-qb", "lost")
    write("z", "lost")
    run("commit", "-qm", "lost")
    run("checkout", "-q", "main")
    run("branch", "-qD", "lost")
    return path, run


def test_objects_hash_to_their_ids_and_to_other_digests(spark, repo):
    path, run = repo
    found = git.objects(spark, [path]).cache()
    assert {r.hash for r in found.collect()} == {x.split()[0] for x in run("cat-file", "--batch-all-objects", "--batch-check").splitlines()}
    blobs, entries, commits, tags = git.blobs(found), git.tree_entries(found), git.commits(found), git.tags(found)
    sums = hashing.blob_sums(blobs, "sha1")
    trees = hashing.tree_sums(entries, sums, "sha1")
    made = hashing.commit_sums(commits, trees, "sha1")
    for frame in (sums, trees, made, hashing.tag_sums(tags, made, "sha1")):
        assert frame.count() and hashing.mismatches(frame).count() == 0
    assert policy.wrong_ids(commits).count() == 0
    row = commits.where(commits.hash == run("rev-parse", "main")).first()
    assert row.message == "merge\n" and row.author.email == "a@example.com" and (row.author.when_unix, row.author.tz) == (1700000000, "+0200")
    assert row.parents == run("rev-parse", "main^1", "main^2").split()


def test_graph_questions_have_gits_answers(spark, repo):
    path, run = repo
    found = git.objects(spark, [path]).cache()
    commits, refs = git.commits(found), git.refs(spark, [path])
    main = run("rev-parse", "main")
    name = git.repo_ids([path])[path]
    tip = spark.createDataFrame([(name, "main", main)], "repo_id string, name string, hash string")
    edges = history.parent_edges(commits)
    assert {r.hash for r in history.reachable(edges, tip).collect()} == set(run("rev-list", "main").split())
    assert [r.hash for r in history.first_parent_chain(edges, tip).orderBy("depth").collect()] == run("rev-list", "--first-parent", "main").split()
    assert [r.message for r in history.dangling(commits, tip).collect()] == ["lost\n"]
    tree = spark.createDataFrame([(name, run("rev-parse", "main^{tree}"))], "repo_id string, hash string")
    assert sorted(r.path for r in history.tree_files(git.tree_entries(found), tree).collect()) == run("ls-tree", "-r", "--name-only", "main").splitlines()
    merges = signatures.merge_states(commits, {name: path}).collect()
    assert [(m.hash, m.clean, m.up_to_date) for m in merges] == [(main, True, True)]
    tips = tip.select("repo_id", tip.name.alias("branch"), "hash").crossJoin(spark.createDataFrame([(run("rev-parse", "v0.0.1^{}"),)], "after string"))
    known = spark.createDataFrame([("a@example.com", "a", True, False)], "email string, identity string, maintainer boolean, forge boolean")
    assert policy.check_protected(commits, tips, known, {}, signatures.merge_states(commits, {name: path})).count() == 0
    assert {r.rule for r in policy.check_protected(commits, tips, known, {}).collect()} == {"merge changes content", "second parent is not up to date"}  # what is not checked does not pass
    rules = {r.rule for r in policy.check_tags(refs, git.tags(found), known, spark.createDataFrame([], "repo_id string, ref string, sha1 string"), {}).collect()}
    assert rules == {"unsigned annotated tag"}


def test_discovery_and_working_tree(spark, repo):
    path, _ = repo
    assert git.infer_repos(f"{path}/a/b")[0][1:] == ("repo", path, "a/b/") and git.is_org(os.path.dirname(path))
    assert sorted(r.path for r in git.working_tree(spark, path).collect()) == ["a/b/x.go", "a/c/x.go", "go.mod"]


def new_repo(path, files, date="1700000000 +0200"):
    os.makedirs(path)
    env = os.environ | {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "A B"), ("EMAIL", "a@example.com"), ("DATE", date))} | {"GIT_CONFIG_GLOBAL": "/dev/null"}

    def run(*args):
        return subprocess.run(["git", "-C", path, *args], env=env, check=True, capture_output=True).stdout.decode("latin-1").strip()

    run("init", "-q", "-b", "main")
    for name, data in files.items():
        target = os.path.join(os.fsencode(path), name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(data)
    run("add", "-A")
    run("commit", "-qm", "first")
    return run


def test_hidden_files_are_read(spark, tmp_path):
    names = [".gitignore", "_x.go", "a.go", ".github/w.yml", "d/.git2/e"]
    for n in [*names, ".git/config", "d/.git/HEAD"]:
        os.makedirs(os.path.dirname(f"{tmp_path}/{n}"), exist_ok=True)
        open(f"{tmp_path}/{n}", "w").write(n)
    os.symlink("a.go", f"{tmp_path}/link")
    got = {r.path: bytes(r.data).decode() for r in git.working_tree(spark, str(tmp_path)).collect()}
    assert got == {n: n for n in names}
    assert git.working_tree(spark, str(tmp_path / "d" / ".git")).count() == 1


def test_repositories_of_one_name_and_broken_ones(spark, tmp_path):
    paths = [f"{tmp_path}/{o}/x" for o in ("one", "two")]
    for p in paths:
        new_repo(p, {b"f": p.encode()})
    ids = git.repo_ids(paths)
    assert list(ids.values()) == ["one/x", "two/x"]
    commits = git.commits(git.objects(spark, paths))
    assert {r.repo_id for r in commits.collect()} == {"one/x", "two/x"} and {r.repo_id for r in git.refs(spark, paths).collect()} == {"one/x", "two/x"}
    os.makedirs(f"{tmp_path}/two/broken")
    both = git.objects(spark, [*paths, f"{tmp_path}/two/broken"], failing="skip")
    assert [r.repo_id for r in git.errors(both).collect()] == ["two/broken"] and git.commits(both).count() == 2


def test_bytes_that_are_not_utf8_keep_their_hashes(spark, tmp_path):
    run = new_repo(f"{tmp_path}/o/r", {"é/ü".encode("latin-1"): b"x"})
    open(f"{tmp_path}/message", "wb").write("déjà vu\n".encode("latin-1"))
    run("-c", "i18n.commitEncoding=ISO-8859-1", "commit", "-q", "--allow-empty", "-F", f"{tmp_path}/message")
    found = git.objects(spark, [f"{tmp_path}/o/r"]).cache()
    trees = hashing.tree_sums(git.tree_entries(found), hashing.blob_sums(git.blobs(found), "sha1"), "sha1")
    made = hashing.commit_sums(git.commits(found), trees, "sha1")
    assert trees.count() == 2 and hashing.mismatches(trees).count() == 0 and made.count() == 2 and hashing.mismatches(made).count() == 0
    raw = git.commits(found).select("raw", signatures.signed_commit(F.col("raw")).alias("signed")).collect()
    assert all(bytes(r.raw) == bytes(r.signed) for r in raw)


def test_search_of_all_history(spark, tmp_path):
    """needle: in the first commit, gone on main, back by a merge; lost: only where no branch leads."""
    path = f"{tmp_path}/o/r"
    run = new_repo(path, {b"a/f": b"needle here\n", b"b/f": b"needle here\n"})

    def change(text, message, name="a/f"):
        open(f"{path}/{name}", "w").write(text)
        run("commit", "-qam", message)
        return run("rev-parse", "HEAD")

    first = run("rev-parse", "HEAD")
    run("checkout", "-qb", "side")
    side = change("needle here\nmore\n", "side")
    run("checkout", "-q", "main")
    gone = change("nothing\n", "gone")
    run("checkout", "-qb", "lost")
    lost = change("needle lost\n", "lost")
    run("checkout", "-q", "main")
    run("branch", "-qD", "lost")
    run("merge", "-q", "--no-ff", "-X", "theirs", "-m", "merge", "side")
    merge = run("rev-parse", "HEAD")
    run("tag", "-a", "-m", "t", "v1", first)

    found = git.objects(spark, [path]).cache()
    search = Search(["needle"], Parameters(Match.NORMALIZED, context=True))
    args = git.blobs(found), git.tree_entries(found), git.commits(found), git.refs(spark, [path])
    rows = history.search_history(search, *args, git.tags(found), prefix="refs/heads/").collect()
    got = {(r.path, r.branch): (r.first_commits, r.last_commit, r.on_tip, r.tags) for r in rows}
    assert got == {
        ("a/f", "main"): ([first], merge, True, ["v1"]), ("b/f", "main"): ([first], merge, True, ["v1"]), ("a/f", "side"): ([first], side, True, ["v1"]), ("b/f", "side"): ([first], side, True, ["v1"]),
        ("a/f", None): ([lost], lost, False, []),
    }
    assert gone not in {r.last_commit for r in rows} and all(r.original == "needle" and r.line_number == 1 for r in rows)
    tips = history.search_history(search, *args, tips_only=True, path=F.col("path").startswith("a/"), prefix="refs/heads/").collect()
    assert {(r.path, r.branch, r.last_commit) for r in tips} == {("a/f", "main", merge), ("a/f", "side", side)}


def test_graphs_too_large_for_a_task_agree(spark, monkeypatch):
    parents = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"], "e": ["d"], "x": []}
    commits = spark.createDataFrame([("r", h, p) for h, p in parents.items()], "repo_id string, hash string, parents array<string>")
    tips = spark.createDataFrame([("r", "m", "e"), ("r", "s", "c")], "repo_id string, name string, hash string")
    hits = spark.createDataFrame([("r", h, "k") for h in "abe"], "repo_id string, hash string, match_key string")
    stop = spark.createDataFrame([("r", "b")], "repo_id string, hash string")
    edges = history.parent_edges(commits)

    def answers():
        frames = (history.ancestors(edges, tips, stop), history.reachable(edges, tips), history.first_parent_chain(edges, tips), history.generations(commits), history.sightings(commits, tips, hits))
        return [sorted(map(repr, f.select(sorted(f.columns)).collect())) for f in frames]

    small = answers()
    monkeypatch.setattr(history, "LARGE", 0)
    assert answers() == small


def test_verify_needs_checked_signatures(spark, tmp_path):
    path = f"{tmp_path}/o/r"
    run = new_repo(path, {b"f": b"1"})
    subprocess.run(["ssh-keygen", "-q", "-t", "ed25519", "-N", "", "-C", "", "-f", f"{tmp_path}/k"], check=True)
    after = run("rev-parse", "HEAD")
    sign = ("-c", "gpg.format=ssh", "-c", f"user.signingkey={tmp_path}/k")
    run("checkout", "-qb", "side")
    open(f"{path}/f", "w").write("2")
    run(*sign, "commit", "-q", "-S", "-a", "-m", "second")
    run("checkout", "-q", "main")
    run(*sign, "merge", "-q", "-S", "--no-ff", "-m", "merge", "side")
    run(*sign, "tag", "-s", "-m", "t", "v1")
    main = run("rev-parse", "HEAD")
    found = git.objects(spark, [path]).cache()
    commits, tags, refs = git.commits(found), git.tags(found), git.refs(spark, [path])
    known = spark.createDataFrame([("a@example.com", "a", True, False)], "email string, identity string, maintainer boolean, forge boolean")
    keys = spark.createDataFrame([("a@example.com", [(tmp_path / "k.pub").read_text()], [])], "email string, ssh_keys array<string>, gpg_keys array<string>")
    rules = {"allow_ssh_signatures": True, "require_ssh_user_present": False, "require_ssh_user_verified": False}
    plan = {"rules": rules, "protected_branches": ["main"], "after": [{"sha1": after, "branch": "main"}]}
    signed = commits.select("repo_id", "hash", "raw", "signature", F.col("committer.email").alias("email")).unionByName(tags.select("repo_id", "hash", "raw", "signature", F.col("tagger.email").alias("email")))
    merges = signatures.merge_states(commits, {git.repo_ids([path])[path]: path})
    said = lambda **more: {r.rule for r in policy.verify(commits, tags, refs, plan | more.pop("policy", {}), known, merges=merges, **more).collect()}
    checked = signatures.verified(signed, keys, rules).cache()
    assert said(verified=checked) == set()
    assert said() == {"signature not checked"}
    assert said(verified=checked, policy={"rules": {}}) >= {"ssh signatures are not allowed"}
    strict = signatures.verified(signed, keys, rules | {"require_ssh_user_present": True})
    assert said(verified=strict) == {"invalid signature"}
    assert said(verified=checked, branch="main", tip=main) == set() and said(verified=checked, branch="main", tip=after) == {"branch is at another commit"}
    assert said(verified=checked, commit=main, connected_to_after=True) == set() and said(verified=checked, commit="0" * 40) == {"target does not exist"}
    assert said(verified=checked, tag="v1") == set() and "target does not exist" in said(verified=checked, tag="v2")
    assert "unsigned commit" in said(verified=checked, policy={"after": []})


@pytest.mark.parametrize("kind", ["ed25519", "ecdsa", "rsa"])
@pytest.mark.parametrize("digest", ["sha512", "sha256"])
def test_ssh_key_types_and_hashes(tmp_path, kind, digest):
    subprocess.run(["ssh-keygen", "-q", "-t", kind, "-N", "", "-C", "", "-f", f"{tmp_path}/k"], check=True)
    (tmp_path / "d").write_text("foo")
    subprocess.run(["ssh-keygen", "-q", "-Y", "sign", "-O", f"hashalg={digest}", "-f", f"{tmp_path}/k", "-n", "file", f"{tmp_path}/d"], check=True, capture_output=True)
    key, made = (tmp_path / "k.pub").read_text(), (tmp_path / "d.sig").read_text()
    assert signatures.ssh_problem(b"foo", made, [key], "file", allow_sha256=True) is None
    assert (signatures.ssh_problem(b"foo", made, [key], "file") is None) == (digest == "sha512")


def test_module_hash_is_the_sorted_lines_digest(spark, repo):
    import base64
    import hashlib

    path, _ = repo
    files = git.working_tree(spark, path).selectExpr("'r' AS repo_id", "path", "data")
    row = hashing.module_hashes(files, "v1.0.0").first()
    lines = "".join(f"{hashlib.sha256(open(f'{path}/{n}', 'rb').read()).hexdigest()}  example.com/m@v1.0.0/{n}\n" for n in ("a/b/x.go", "a/c/x.go", "go.mod"))
    assert row.directory_hash == "h1:" + base64.b64encode(hashlib.sha256(lines.encode()).digest()).decode() and row.module == "example.com/m"


def test_ssh_signatures(tmp_path):
    subprocess.run(["ssh-keygen", "-q", "-t", "ed25519", "-N", "", "-C", "", "-f", f"{tmp_path}/k"], check=True)
    (tmp_path / "d").write_text("foo")
    subprocess.run(["ssh-keygen", "-q", "-Y", "sign", "-f", f"{tmp_path}/k", "-n", "file", f"{tmp_path}/d"], check=True, capture_output=True)
    key, made = (tmp_path / "k.pub").read_text(), (tmp_path / "d.sig").read_text()
    check = signatures.ssh_problem
    assert check(b"foo", made, [key], "file") is None
    assert check(b"bar", made, [key], "file") == "signature does not match"
    assert check(b"foo", made, [key], "git") == "namespace file" and check(b"foo", made, [], "file") == "key is not the signer's"
    assert check(b"foo", made, [key], "file", present=True).endswith("no user presence")


def test_encodings_and_metadata(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    assert one.select(release.authentication_encoding(F.lit(release.PAYLOAD_TYPE), F.lit("testPayload")).cast("string")).first()[0] == "DSSEv1 28 application/vnd.in-toto+json 11 testPayload"
    made = F.struct(F.lit("t").alias("_type"), F.lit("u").alias("repositoryUri"))
    line = release.encode_metadata(made)
    assert one.select(release.decode_metadata(F.concat(F.lit("x\n\n"), line)).alias("m")).first().m.repositoryUri == "u"
    assert one.select(release.decode_metadata(F.concat(line, F.lit("\n"), line)).alias("m")).first().m is None


def test_config_is_strict():
    text = '{"_type": "https://example.com/v0.1", "identities": [{"EMAIL": "a@b"}], "maintainers": ["a@b"], "repositories": [{"uri": "git+https://h/r.git", "after": [{"SHA1": "%s", "branch": "main"}]}]}' % ("0" * 40)
    (policy_,) = config.load(text)
    assert policy_["after"][0]["sha1"] == "0" * 40 and policy_["maintainers"] == ["a@b"]
    for bad in (text.replace("EMAIL", "mail"), text.replace('["a@b"]', '["c@d"]'), text.replace("v0.1", "v9"), text.replace("git+https", "https")):
        with pytest.raises(ValueError):
            config.load(bad)
