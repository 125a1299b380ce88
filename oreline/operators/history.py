"""Commit graphs: reachability, first-parent chains, tree paths, first and last sight of matches.

Relations carry ``repo_id``. The graph of a repository of at most ``LARGE`` edges is walked in one
task, all such repositories at once. Larger ones advance together by joins, a round per step of the
deepest one, until nothing new is reached.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.operators.storage import stored

#: Edges of a commit graph (two short strings each) that one task holds.
LARGE = 2_000_000


def _each(edges: DataFrame, other: DataFrame, walk: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rounds: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``walk`` over each repository's edges and rows of ``other``; ``rounds`` over those too large for a task."""
    # Both may come from one table: new columns keep the sides apart.
    other = other.select(*[F.col(c).alias(c) for c in other.columns])
    large = edges.groupBy("repo_id").count().where(F.col("count") > LARGE).select("repo_id")
    some = not large.isEmpty()
    if some:
        large = stored(large)
    part = lambda d, how: d.join(large, "repo_id", how) if some else d

    columns = edges.columns, other.columns

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # A side without rows of a repository comes without columns.
        left, right = (d if len(d.columns) else pd.DataFrame(columns=c) for d, c in zip((left, right), columns, strict=True))
        out = walk(left, right)
        out.insert(0, "repo_id", key[0])
        return out

    found = part(edges, "left_anti").groupBy("repo_id").cogroup(part(other, "left_anti").groupBy("repo_id")).applyInPandas(run, "repo_id string, " + schema)
    return found.unionByName(rounds(part(edges, "left_semi"), part(other, "left_semi"))) if some else found


def _parents(edges: pd.DataFrame) -> dict[str, list[str]]:
    """Parents of each commit, in the order of ``nth`` where edges have it."""
    out: dict[str, list[str]] = {}
    if "nth" in edges:
        edges = edges.sort_values("nth", kind="stable")
    for h, p in zip(edges["hash"], edges["parent"], strict=True):
        if p is not None:
            out.setdefault(h, []).append(p)
    return out


def _reach(parents: dict[str, list[str]], starts, bar: set[str]) -> set[str]:
    todo = [x for x in starts if x not in bar]
    seen = set(todo)
    while todo:
        for p in parents.get(todo.pop(), ()):
            if p not in seen and p not in bar:
                seen.add(p)
                todo.append(p)
    return seen


def _heights(parents: dict[str, list[str]], nodes) -> dict[str, int]:
    """The longest way from each node down to a root, among ``nodes``."""
    known, out = set(nodes), {}
    for first in known:
        stack = [first]
        while stack:
            h = stack[-1]
            below = [p for p in parents.get(h, ()) if p in known]
            if open_ := [p for p in below if p not in out]:
                stack += open_ if h not in out else []
            else:
                out[h] = 1 + max((out[p] for p in below), default=-1)
            if h in out:
                stack.pop()
    return out


def _with_stop(starts: DataFrame, stop: DataFrame | None) -> DataFrame:
    own = starts.select("repo_id", "hash", F.lit(False).alias("stop"))
    return own.unionByName(stop.select("repo_id", "hash", F.lit(True).alias("stop"))) if stop is not None else own


def parent_edges(commits: DataFrame) -> DataFrame:
    """``repo_id, hash, parent, nth`` (0 for the first parent) of commits with an array of parents."""
    return commits.select("repo_id", "hash", F.posexplode("parents").alias("nth", "parent"))


def ancestors(edges: DataFrame, starts: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """``repo_id, start, hash``: all that each start reaches along parents, itself included, without what
    ``stop`` (repo_id, hash) holds."""

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parents, bar = _parents(left), set(right["hash"][right["stop"].astype(bool)])
        rows = [(s, h) for s in dict.fromkeys(right["hash"][~right["stop"].astype(bool)]) for h in _reach(parents, [s], bar)]
        return pd.DataFrame(rows, columns=["start", "hash"])

    split = lambda e, o: _ancestors_by_rounds(e, o.where("not stop"), o.where("stop") if stop is not None else None)
    return _each(edges.select("repo_id", "hash", "parent"), _with_stop(starts, stop), walk, "start string, hash string", split)


def reachable(edges: DataFrame, starts: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """``repo_id, hash``: what any of the starts reaches, without what ``stop`` holds."""

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = right["stop"].astype(bool)
        return pd.DataFrame(sorted(_reach(_parents(left), right["hash"][~own], set(right["hash"][own]))), columns=["hash"])

    split = lambda e, o: _reachable_by_rounds(e, o.where("not stop"), o.where("stop") if stop is not None else None)
    return _each(edges.select("repo_id", "hash", "parent"), _with_stop(starts, stop), walk, "hash string", split)


def first_parent_chain(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``repo_id, start, hash, depth`` along first parents. Parents that are not in ``edges`` as commits end the
    chain and are part of it."""

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        up, rows = dict(zip(left["hash"], left["parent"], strict=True)), []
        for s in dict.fromkeys(right["hash"]):
            at, depth = s, 0
            while at is not None:
                rows.append((s, at, depth))
                at, depth = up.get(at), depth + 1
        return pd.DataFrame(rows, columns=["start", "hash", "depth"])

    first = edges.where("nth = 0").select("repo_id", "hash", "parent", "nth")
    return _each(first, starts.select("repo_id", "hash"), walk, "start string, hash string, depth long", _chain_by_doubling)


def _ancestors_by_rounds(edges: DataFrame, starts: DataFrame, stop: DataFrame | None) -> DataFrame:
    """``ancestors``; each round joins only what the one before found."""
    edges = edges.select("repo_id", "hash", "parent").distinct()
    new = starts.select("repo_id", F.col("hash").alias("start"), "hash").distinct()
    bar = (lambda d: d.join(stop.select("repo_id", "hash"), ["repo_id", "hash"], "left_anti")) if stop is not None else (lambda d: d)
    seen = new = stored(bar(new))
    while not new.isEmpty():
        step = new.join(edges, ["repo_id", "hash"]).select("repo_id", "start", F.col("parent").alias("hash")).distinct()
        new = stored(bar(step).join(seen, ["repo_id", "start", "hash"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


def _reachable_by_rounds(edges: DataFrame, starts: DataFrame, stop: DataFrame | None) -> DataFrame:
    edges = edges.select("repo_id", "hash", "parent").distinct()
    bar = (lambda d: d.join(stop.select("repo_id", "hash"), ["repo_id", "hash"], "left_anti")) if stop is not None else (lambda d: d)
    seen = new = stored(bar(starts.select("repo_id", "hash").distinct()))
    while not new.isEmpty():
        step = new.join(edges, ["repo_id", "hash"]).select("repo_id", F.col("parent").alias("hash")).distinct()
        new = stored(bar(step).join(seen, ["repo_id", "hash"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


def _chain_by_doubling(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``first_parent_chain`` by pointer doubling: a history of n commits takes log2(n) rounds."""
    jump = edges.where("nth = 0").select("repo_id", "hash", F.col("parent").alias("to"))
    jump = stored(jump.dropDuplicates(["repo_id", "hash"]))
    found = stored(starts.select("repo_id", F.col("hash").alias("start"), "hash", F.lit(0).cast("long").alias("depth")).distinct())
    span = 1
    while True:
        # All of the chain up to ``span`` deep is known; the jump from each of these leads ``span`` further.
        more = found.join(jump, ["repo_id", "hash"]).select("repo_id", "start", F.col("to").alias("hash"), (F.col("depth") + span).alias("depth"))
        more = stored(more)
        if more.isEmpty():
            return found
        found = found.unionByName(more)
        other = jump.select("repo_id", F.col("hash").alias("to"), F.col("to").alias("next"))
        jump = stored(jump.join(other, ["repo_id", "to"]).select("repo_id", "hash", F.col("next").alias("to")))
        span *= 2


def on_first_parent_chain(edges: DataFrame, tips: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (repo_id, hash) that stand on the first-parent chain of a tip."""
    return targets.join(first_parent_chain(edges, tips).select("repo_id", "hash").distinct(), ["repo_id", "hash"], "left_semi")


def heads(commits: DataFrame) -> DataFrame:
    """Commits that no other has as a parent."""
    parents = commits.select("repo_id", F.explode("parents").alias("hash")).distinct()
    return commits.join(parents, ["repo_id", "hash"], "left_anti")


def dangling(commits: DataFrame, branches: DataFrame) -> DataFrame:
    """Commits that no branch tip (repo_id, hash) reaches."""
    return commits.join(reachable(parent_edges(commits), branches), ["repo_id", "hash"], "left_anti")


def generations(commits: DataFrame) -> DataFrame:
    """``repo_id, hash, generation``: the longest way down to a root; parents always come before children."""

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_heights(_parents(left), right["hash"]).items()), columns=["hash", "generation"])

    edges = parent_edges(commits).select("repo_id", "hash", "parent")
    return _each(edges, commits.select("repo_id", "hash"), walk, "hash string, generation long", _generations_by_rounds)


def _generations_by_rounds(edges: DataFrame, commits: DataFrame) -> DataFrame:
    known = commits.select("repo_id", F.col("hash").alias("parent"))
    edges = stored(edges.join(known, ["repo_id", "parent"], "left_semi"))
    level = stored(commits.select("repo_id", "hash", F.lit(0).cast("long").alias("generation")).distinct())
    while True:
        up = level.select("repo_id", F.col("hash").alias("parent"), "generation")
        raised = edges.join(up, ["repo_id", "parent"]).groupBy("repo_id", "hash").agg((F.max("generation") + 1).alias("above"))
        joined = level.join(raised, ["repo_id", "hash"], "left")
        new = stored(joined.select("repo_id", "hash", F.greatest("generation", F.coalesce("above", F.lit(0))).alias("generation")))
        if new.join(level, ["repo_id", "hash", "generation"], "left_anti").isEmpty():
            return new
        level = new


#: Entry modes that are searched, and that are directories.
FILES, DIRECTORY = ("100644", "100755", "100664"), "40000"


def tree_files(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """``repo_id, root, path, hash``: the regular files below each root tree, symlinks and submodules left out.

    Paths join names level by level; an equal subtree at two paths gives both.
    """
    entries = entries.select("repo_id", "tree_hash", F.ltrim("mode", F.lit("0")).alias("mode"), "name", "hash")
    level = roots.select("repo_id", F.col("hash").alias("root"), F.col("hash").alias("tree_hash"), F.lit("").alias("prefix")).distinct()
    found = None
    while True:
        inside = stored(level.join(entries, ["repo_id", "tree_hash"]).select("repo_id", "root", F.concat("prefix", "name").alias("path"), "mode", "hash"))
        files = inside.where(F.col("mode").isin(*FILES)).select("repo_id", "root", "path", "hash")
        found = files if found is None else found.unionByName(files)
        level = inside.where(F.col("mode") == DIRECTORY).select("repo_id", "root", F.col("hash").alias("tree_hash"), F.concat("path", F.lit("/")).alias("prefix"))
        if level.isEmpty():
            return found


def paths_of(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """``repo_id, tree_hash, path, blob``: where each of ``blobs`` (repo_id, hash) lies below every tree that has it.

    From the blobs up: only what has one of them is expanded, and a subtree that many trees share once,
    at each of its paths. A round per level of folders.
    """
    entries = entries.select("repo_id", "tree_hash", F.ltrim("mode", F.lit("0")).alias("mode"), "name", "hash")
    files, folders = entries.where(F.col("mode").isin(*FILES)), entries.where(F.col("mode") == DIRECTORY)
    level = stored(files.join(blobs.select("repo_id", "hash").distinct(), ["repo_id", "hash"]).select("repo_id", "tree_hash", F.col("name").alias("path"), F.col("hash").alias("blob")).distinct())
    found = level
    while not level.isEmpty():
        up = level.select("repo_id", F.col("tree_hash").alias("hash"), F.col("path").alias("below"), "blob")
        level = stored(folders.join(up, ["repo_id", "hash"]).select("repo_id", "tree_hash", F.concat_ws("/", "name", "below").alias("path"), "blob").distinct())
        found = found.unionByName(level)
    return found


def sightings(commits: DataFrame, branches: DataFrame, hits: DataFrame) -> DataFrame:
    """Per branch and match key: first_commits (where the match appears and no parent has it), last_commit
    (the latest, in topological order, that has it) and on_tip.

    commits: repo_id, hash, parents; branches: repo_id, name, hash; hits: repo_id, hash (commit), match_key.
    """

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parents, rows = _parents(left), []
        having: dict[str, set[str]] = {}
        for h, k in zip(right["hash"], right["match_key"], strict=True):
            if k is not None:
                having.setdefault(h, set()).add(k)
        branch = right[right["name"].notna()]
        nodes = set(left["hash"]) | set(right["hash"]) | {p for ps in parents.values() for p in ps}
        height = _heights(parents, nodes) if len(branch) else {}
        for name, tip in zip(branch["name"], branch["hash"], strict=True):
            first: dict[str, list[str]] = {}
            last: dict[str, tuple[int, str]] = {}
            for h in _reach(parents, [tip], set()):
                own = having.get(h, set())
                had = set().union(*(having.get(p, set()) for p in parents.get(h, ())))
                for k in own:
                    last[k] = max(last.get(k, (-1, "")), (height[h], h))
                for k in own - had:
                    first.setdefault(k, []).append(h)
            rows += [(name, k, sorted(first.get(k, [])), h, h == tip) for k, (_, h) in last.items()]
        return pd.DataFrame(rows, columns=["branch", "match_key", "first_commits", "last_commit", "on_tip"])

    edges = parent_edges(commits).select("repo_id", "hash", "parent", "nth")
    none = F.lit(None).cast("string")
    other = branches.select("repo_id", "hash", "name", none.alias("match_key")).unionByName(hits.select("repo_id", "hash", none.alias("name"), "match_key").distinct())

    def rounds(e: DataFrame, o: DataFrame) -> DataFrame:
        own = commits.join(e.select("repo_id").distinct(), "repo_id", "left_semi")
        return _sightings_by_rounds(own, o.where("name is not null").select("repo_id", "name", "hash"), o.where("match_key is not null").select("repo_id", "hash", "match_key"))

    return _each(edges, other, walk, "branch string, match_key string, first_commits array<string>, last_commit string, on_tip boolean", rounds)


def _sightings_by_rounds(commits: DataFrame, branches: DataFrame, hits: DataFrame) -> DataFrame:
    hits = stored(hits.select("repo_id", "hash", "match_key").distinct())
    edges = parent_edges(commits)
    had = edges.join(hits.select("repo_id", F.col("hash").alias("parent"), "match_key"), ["repo_id", "parent"]).select("repo_id", "hash", "match_key").distinct()
    fresh = hits.join(had, ["repo_id", "hash", "match_key"], "left_anti").withColumn("fresh", F.lit(True))
    within = ancestors(edges, branches).join(branches.select("repo_id", F.col("hash").alias("start"), "name"), ["repo_id", "start"])
    seen = within.join(hits, ["repo_id", "hash"]).join(generations(commits), ["repo_id", "hash"]).join(fresh, ["repo_id", "hash", "match_key"], "left")
    out = seen.groupBy("repo_id", F.col("name").alias("branch"), "match_key", "start").agg(
        F.array_sort(F.collect_set(F.when(F.col("fresh"), F.col("hash")))).alias("first_commits"),
        F.max(F.struct("generation", "hash"))["hash"].alias("last_commit"),
    )
    return out.withColumn("on_tip", F.col("last_commit") == F.col("start")).drop("start")


def search_history(search, blobs: DataFrame, entries: DataFrame, commits: DataFrame, refs: DataFrame, tags: DataFrame | None = None, *, tips_only: bool = False, path: Column | None = None, dangling_too: bool = True, prefix: str = "refs/remotes/origin/") -> DataFrame:
    """Matches of a ``Search`` in the files of all history, or with ``tips_only`` of the branches' last commits.

    A row per repository, path, match and branch that has it: the columns of the search, blob, path,
    match_key, branch (null: only commits that no branch reaches have it), first_commits, last_commit,
    on_tip and tags (annotated ones whose commit has it). A match is the same across history if path, text,
    context and term are; the earliest commit supplies its line. blobs: repo_id, hash, data. path: a
    condition on column ``path``. prefix: of the refs that are branches; one named HEAD is left out.
    Equal blobs are searched once a repository; symlinks and submodules are no files. Without refs, trees
    or matches there are no rows.
    """
    tips = refs.where(F.col("name").startswith(prefix) & (F.col("name") != prefix + "HEAD")).select("repo_id", F.substring("name", len(prefix) + 1, 1 << 20).alias("name"), "hash")
    text = blobs.dropDuplicates(["repo_id", "hash"]).select("repo_id", F.col("hash").alias("blob"), F.col("data").try_cast("string").alias("text"))
    found = stored(search.match(text, ["repo_id", "blob"], "text"))
    where = paths_of(entries, found.select("repo_id", F.col("blob").alias("hash")))
    where = where.where(path) if path is not None else where
    seen = commits.join(tips.select("repo_id", "hash").distinct(), ["repo_id", "hash"], "left_semi") if tips_only else commits
    at = seen.select("repo_id", "hash", "tree_hash").join(where, ["repo_id", "tree_hash"]).select("repo_id", "hash", "path", "blob")
    around = [c for c in ("context_before", "context_after") if c in found.columns]
    key = F.sha2(F.concat_ws("\0", "path", *around[:1], "matched_text", *around[1:], "original"), 256)
    hits = stored(at.join(found.select("repo_id", "blob", "matched_text", "original", *around).distinct(), ["repo_id", "blob"]).select("repo_id", "hash", "path", "blob", key.alias("match_key")).distinct())
    graph = commits.select("repo_id", "hash", "parents") if not tips_only else tips.select("repo_id", "hash", F.array().cast("array<string>").alias("parents")).distinct()
    out = sightings(graph, tips, hits.select("repo_id", "hash", "match_key"))
    if dangling_too and not tips_only:
        lost = dangling(commits, tips).select("repo_id", "hash")
        rows = hits.join(lost, ["repo_id", "hash"]).join(generations(commits), ["repo_id", "hash"])
        only = rows.join(out.select("repo_id", "match_key").distinct(), ["repo_id", "match_key"], "left_anti")
        last = F.max(F.struct("generation", "hash"))["hash"]
        first = F.array(F.min(F.struct("generation", "hash"))["hash"])
        out = out.unionByName(only.groupBy("repo_id", "match_key").agg(first.alias("first_commits"), last.alias("last_commit")).withColumns({"branch": F.lit(None).cast("string"), "on_tip": F.lit(False)}))
    if tags is not None:
        out = out.join(tags_of_matches(tags, hits), ["repo_id", "match_key"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    age = generations(commits)
    earliest = hits.join(age, ["repo_id", "hash"]).join(found, ["repo_id", "blob"]).where(F.col("match_key") == key)
    order = Window.partitionBy("repo_id", "match_key").orderBy("generation", "hash", "start_of_word", "start_of_match")
    shown = earliest.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "hash", "generation")
    return shown.join(out, ["repo_id", "match_key"])


def tags_of_matches(tags: DataFrame, hits: DataFrame) -> DataFrame:
    """``repo_id, match_key, tags``: annotated tags (repo_id, name, target) whose commit has the match."""
    found = hits.join(tags.select("repo_id", F.col("target").alias("hash"), "name"), ["repo_id", "hash"])
    return found.groupBy("repo_id", "match_key").agg(F.array_sort(F.collect_set("name")).alias("tags"))
