"""Git repositories as tables: objects and refs through ``git``, working trees as files.

The data source ``git_objects`` has a partition per repository and streams ``git cat-file``, so neither
driver nor executor holds a repository.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 16 << 20


def repo_ids(paths: list[str]) -> dict[str, str]:
    """An id for each repository: its organisation's folder and its own, and as many folders above as tell all apart."""
    parts = {p: os.path.abspath(p).strip("/").split("/") for p in paths}
    out = {}
    for p, own in parts.items():
        n = 2
        while n < len(own) and any(other[-n:] == own[-n:] for q, other in parts.items() if os.path.abspath(q) != os.path.abspath(p)):
            n += 1
        out[p] = "/".join(own[-n:])
    return out


class _Repo(InputPartition):
    def __init__(self, repo_id: str, path: str):
        super().__init__(repo_id)
        self.repo_id, self.path = repo_id, path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], skip: bool):
        self.paths, self.skip = paths, skip

    def partitions(self):
        return [_Repo(name, p) for p, name in repo_ids(self.paths).items()]

    def read(self, partition) -> Iterator[tuple]:
        """All objects, loose and packed, reachable or not, each once."""
        run = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", partition.path, "cat-file", "--batch-all-objects", "--batch", "--unordered"], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        with run:
            while head := run.stdout.readline():
                name, kind, size = head.decode().split()
                data = run.stdout.read(int(size))
                run.stdout.read(1)
                yield partition.repo_id, name, kind, data
        if run.returncode:
            said = f"git cat-file failed in {partition.path}"
            if not self.skip:
                raise OSError(said)
            yield partition.repo_id, None, "error", said.encode()


class GitObjects(DataSource):
    """``spark.read.format("git_objects").option("paths", "a:b").load()``; with option ``failing`` = ``skip`` a
    repository that cannot be read gives a row of kind ``error`` instead of ending the job."""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return "repo_id string, hash string, kind string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options.get("paths", "").split(os.pathsep) if p], self.options.get("failing") == "skip")


def objects(spark: SparkSession, paths: list[str], failing: str = "stop") -> DataFrame:
    """``repo_id, hash, kind, data`` of all objects of repositories. failing: ``stop``, or ``skip`` those that cannot be read."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("paths", os.pathsep.join(paths)).option("failing", failing).load()


def errors(found: DataFrame) -> DataFrame:
    """``repo_id, problem`` of the repositories that were skipped."""
    return found.where("kind = 'error'").select("repo_id", F.col("data").cast("string").alias("problem"))


def blobs(found: DataFrame) -> DataFrame:
    return found.where("kind = 'blob'").select("repo_id", "hash", "data")


_IDENTITY = r"^{} (.*?) ?<([^>]*)> (-?\d+) ([+-]\d{{4}})$"


def commits(found: DataFrame) -> DataFrame:
    """``repo_id, hash, tree_hash, parents, author, committer, mergetag, signature, message, raw`` of commits."""
    raw = found.where("kind = 'commit'").select("repo_id", "hash", F.col("data").alias("raw"), F.col("data").cast("string").alias("text"))
    head = F.substring_index("text", "\n\n", 1)
    unfold = lambda c: F.regexp_replace(c, r"\n ", "\n")

    def person(who: str):
        pattern = "(?m)" + _IDENTITY.format(who)
        part = [F.regexp_extract(head, pattern, k) for k in (1, 2, 3, 4)]
        return F.struct(part[0].alias("name"), part[1].alias("email"), part[2].try_cast("long").alias("when_unix"), part[3].alias("tz")).alias(who)

    parents = F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("parents")
    field = lambda name: unfold(F.regexp_extract(head, rf"(?m)^{name} (.*(?:\n .*)*)", 1)).alias({"gpgsig": "signature"}.get(name, name))
    message = F.substr("text", F.length(head) + 3).alias("message")
    return raw.select("repo_id", "hash", F.regexp_extract(head, r"^tree ([0-9a-f]+)", 1).alias("tree_hash"), parents, person("author"), person("committer"), field("mergetag"), field("gpgsig"), message, "raw")


_ARMOR = r"(?s)(-----BEGIN (?:SSH|PGP) SIGNATURE-----.*)$"


def tags(found: DataFrame) -> DataFrame:
    """``repo_id, hash, target, target_kind, name, tagger, message, signature, raw`` of annotated tags."""
    raw = found.where("kind = 'tag'").select("repo_id", "hash", F.col("data").alias("raw"), F.col("data").cast("string").alias("text"))
    head = F.substring_index("text", "\n\n", 1)
    body = F.substr("text", F.length(head) + 3)
    part = [F.regexp_extract(head, "(?m)" + _IDENTITY.format("tagger"), k) for k in (1, 2, 3, 4)]
    return raw.select(
        "repo_id", "hash", F.regexp_extract(head, r"^object ([0-9a-f]+)", 1).alias("target"), F.regexp_extract(head, r"(?m)^type (\w+)$", 1).alias("target_kind"), F.regexp_extract(head, r"(?m)^tag (.*)$", 1).alias("name"),
        F.struct(part[0].alias("name"), part[1].alias("email"), part[2].try_cast("long").alias("when_unix"), part[3].alias("tz")).alias("tagger"),
        F.regexp_replace(body, _ARMOR, "").alias("message"), F.regexp_extract(body, _ARMOR, 1).alias("signature"), "raw",
    )


def tree_entries(found: DataFrame) -> DataFrame:
    """``repo_id, tree_hash, ord, mode, name, hash, name_bytes``: the entries of trees in stored order. Names that are
    not UTF-8 read with replacement characters; ``name_bytes`` has them as they are."""
    import pyarrow as pa

    def parse(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for repo, tree, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = n = 0
                while at < len(data):
                    blank, zero = data.index(b" ", at), data.index(b"\0", at)
                    row = (repo, tree, n, data[at:blank].decode(), data[blank + 1 : zero].decode(errors="replace"), data[zero + 1 : zero + 21].hex(), bytes(data[blank + 1 : zero]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    at, n = zero + 21, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["repo_id", "tree_hash", "ord", "mode", "name", "hash", "name_bytes"])

    return found.where("kind = 'tree'").select("repo_id", "hash", "data").mapInArrow(parse, "repo_id string, tree_hash string, ord int, mode string, name string, hash string, name_bytes binary")


def refs(spark: SparkSession, paths: list[str], prefix: str = "refs/") -> DataFrame:
    """``repo_id, name, hash`` of the refs that start with ``prefix``; symbolic ones (HEAD of a remote) are left out."""
    rows, names = [], repo_ids(paths)
    for path in paths:
        said = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, "for-each-ref", "--format=%(refname) %(objectname) %(symref)", prefix], capture_output=True, text=True, check=True).stdout
        for line in said.splitlines():
            name, value, *symbolic = line.split(" ")
            if not any(symbolic):
                rows.append((names[path], name, value))
    return spark.createDataFrame(rows, "repo_id string, name string, hash string")


class _Files(InputPartition):
    def __init__(self, root: str, names: list[str]):
        super().__init__(names)
        self.root, self.names = root, names


class _FileReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        """Paths are listed here, and files read where they are needed, in parts of ``BATCH`` bytes or 4096 files."""
        parts, part, size = [], [], 0
        for folder, below, files in os.walk(self.root):
            below[:] = sorted(d for d in below if d != ".git" and not os.path.islink(os.path.join(folder, d)))
            for name in sorted(files):
                path = os.path.join(folder, name)
                if os.path.islink(path) or not os.path.isfile(path):
                    continue
                part.append(os.path.relpath(path, self.root))
                size += os.path.getsize(path)
                if size >= BATCH or len(part) >= 4096:
                    parts.append(_Files(self.root, part))
                    part, size = [], 0
        return [*parts, _Files(self.root, part)]

    def read(self, partition) -> Iterator[tuple]:
        for name in partition.names:
            with open(os.path.join(partition.root, name), "rb") as f:
                yield name, f.read()


class WorkingTree(DataSource):
    """``spark.read.format("working_tree").load(folder)``: every file below a folder, hidden ones too."""

    @classmethod
    def name(cls) -> str:
        return "working_tree"

    def schema(self) -> str:
        return "path string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(os.path.abspath(self.options["path"]))


def working_tree(spark: SparkSession, path: str) -> DataFrame:
    """``path`` (relative), ``data`` of the files below a folder, without ``.git`` folders and symlinks."""
    spark.dataSource.register(WorkingTree)
    return spark.read.format("working_tree").load(path)


def root_of(path: str) -> str:
    """The nearest folder at or above ``path`` with a ``.git`` folder."""
    at = os.path.abspath(path)
    while not os.path.isdir(os.path.join(at, ".git")):
        if at == os.path.dirname(at):
            raise FileNotFoundError(f"no repository at or above {path}")
        at = os.path.dirname(at)
    return at


def _folders(path: str) -> list[str]:
    return sorted(e.path for e in os.scandir(path) if e.is_dir() and not e.name.startswith("."))


def is_org(path: str) -> bool:
    """Whether the first folder in ``path`` is a repository."""
    inside = _folders(path)
    return bool(inside) and os.path.isdir(os.path.join(inside[0], ".git"))


def is_orgs(path: str) -> bool:
    inside = _folders(path)
    return bool(inside) and is_org(inside[0])


def repos_of_orgs(path: str) -> list[tuple[str, str, str, str]]:
    """(org, repo, path, sub_path) of a folder of organisations."""
    return [(os.path.basename(o), os.path.basename(r), r, "") for o in _folders(path) for r in _folders(o) if os.path.isdir(os.path.join(r, ".git"))]


def infer_repos(path: str) -> list[tuple[str, str, str, str]]:
    """Repositories for a folder: the one around it (with the way down to it), else those of an organisation, else of several."""
    path = os.path.abspath(path)
    try:
        root = root_of(path)
    except FileNotFoundError:
        if is_org(path):
            return [(os.path.basename(path), os.path.basename(r), r, "") for r in _folders(path) if os.path.isdir(os.path.join(r, ".git"))]
        if is_orgs(path):
            return repos_of_orgs(path)
        raise
    sub = os.path.relpath(path, root)
    return [(os.path.basename(os.path.dirname(root)), os.path.basename(root), root, "" if sub == "." else sub + "/")]
