"""Operators for training data against brute force, exact round trips or held-out accuracy, on small tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oreline.llm import ann, decontam, graph, langid, mixing, pii, quality, queries, sharding, simhash, tokencount, urlfilter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, slot int, size string, c0 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, sources=None, langs=None, ids=None):
    """Rows with columns whose names clash with those that operators add."""
    rows = [((ids or range(len(texts)))[k], t, langs[k] if langs else "en", sources[k] if sources else f"s{k % 3}", len(t or ""), "x", 7, "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(n, seed, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(n))


ODD = [None, "", " \n\t", "a", "A a a", "x" * 5_000, "é ü ß 漢字 \U0001f600", "a b c d e", "a b c d e", "\0 \x1f"]


# --- 1 ------------------------------------------------------------------------------------------------


def slow_print(text, width=4):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def near_texts():
    r, texts = random.Random(1), list(ODD)
    for k in range(12):
        words = prose(120, k).split()
        for _ in range(6):
            copy = list(words)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = f"n{r.random()}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_components_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HOT", 1 if block == 3 else simhash.HOT)
    texts = near_texts()
    prints = [slow_print(t) for t in texts]
    want = components(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).select("doc_id", simhash.hex_print(F.col("node")).alias("p"), "component_id").collect()}
    assert len(got) == len(texts)
    assert [got[k].p for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k].component_id for k in range(len(texts))] == want


@pytest.mark.parametrize("seed", range(3))
def test_simhash_links_all_pairs_within_a_larger_radius(spark, seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 40, np.uint64)
    prints = [int(b) for b in base]
    for b in base:
        for _ in range(4):
            prints.append(int(b) ^ sum(1 << int(x) for x in r.choice(64, r.integers(1, 9), replace=False)))
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), np.uint64(p).tobytes()) for p in prints], "node long, fp binary")
    edges = {(r.a, r.b) for r in simhash.near_links(frame, 64, 7).collect()}
    at = {int(np.uint64(p).view(np.int64)): k for k, p in enumerate(prints)}
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= 7 for a, b in edges)
    pairs = {frozenset((at[a], at[b])) for a, b in edges}
    assert components(len(prints), lambda a, b: frozenset((a, b)) in pairs) == components(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 7)


def test_deduplicate_keeps_one_row_of_each_group_and_all_columns(spark):
    base = [prose(300, k, 2000) for k in range(20)]
    texts = [t for b in base for t in (b, b, b.replace(b.split()[150], "other", 1))]
    docs = documents(spark, [*texts, None, None])
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 60, 3), 60]


def test_deduplicate_of_repeated_rows_null_ids_and_empty_tables(spark):
    docs = documents(spark, ["a b c d e f"] * 4, ids=[None, 3, 3, None])
    assert [r.doc_id for r in simhash.deduplicate(docs).collect()] == [3]
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def jaccard_of(a, b, width=5):
    x, y = ({" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def edited(words, share, r):
    """A copy with words changed, one run of 5 shingles each, until about ``share`` similarity is left."""
    n = len(words) - 4
    k = round(n * (1 - share) / (1 + share) / 5)
    out = list(words)
    for at in r.sample(range(4, len(words) - 4, 6), k):
        out[at] = f"n{r.random()}"
    return " ".join(out)


def test_deduplicate_keeps_texts_below_the_similarity(spark):
    r, texts = random.Random(12), []
    for k in range(40):
        words = prose(400, 700 + k, 3000).split()
        texts += [" ".join(words), edited(words, 0.76, r)]
    assert all(0.7 < jaccard_of(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert simhash.deduplicate(documents(spark, texts)).count() == len(texts)


@pytest.mark.parametrize("lone", [True, False])
def test_deduplicate_links_exactly_the_pairs_of_brute_force(spark, lone):
    """lone: the prints link nothing, and the exact join is on its own."""
    r, texts = random.Random(11), []
    for k in range(60):
        words = prose(r.choice([150, 400]), 500 + k, 3000).split()
        texts += [" ".join(words), edited(words, 0.80 + 0.05 * k / 60, r)]
    near = [jaccard_of(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert sum(0.8 <= x < 0.86 for x in near) > 40
    want = {k for k, c in enumerate(components(len(texts), lambda a, b: jaccard_of(texts[a], texts[b]) >= 0.8)) if k == c}
    options = {"radius": 0, "accept": 0} if lone else {}
    assert {x.doc_id for x in simhash.deduplicate(documents(spark, texts), **options).select("doc_id").collect()} == want


def test_connected_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 230)] + [(5, 5), (None, 9)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {k: 100 for k in range(100, 141)} | {7: 7} | {k: 7 for k in range(200, 230)}


def test_few_edges_are_joined_without_rounds_of_stars(spark, monkeypatch):
    """A long chain used to take a table and several shuffles a round; many edges still alternate stars, to the same rows."""
    r = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in r.integers(-150, 150, (170, 2))]
    chain = [int(k) for k in 1000 + r.permutation(60)]
    edges = spark.createDataFrame(pairs + list(zip(chain[1:], chain, strict=False)), "a long, b long")
    tables, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: tables.append(name) or cut(df, name))
    got = sorted(graph.connected_components(edges, "a", "b").collect())
    assert len(tables) == 2 and graph.connected_components(edges.limit(0), "a", "b").count() == 0
    monkeypatch.setattr(graph, "FEW", 100)
    assert sorted(graph.connected_components(edges, "a", "b").collect()) == got and len(tables) > 6
    reach = {x: {x} for e in pairs for x in e if e[0] != e[1]}
    for a, b in [(a, b) for a, b in pairs if a != b]:
        for x in (both := reach[a] | reach[b]):
            reach[x] = both
    assert dict(got) == {x: min(s) for x, s in reach.items()} | {x: 1000 for x in chain}


def jobs_of(spark, partitions, run):
    """How many jobs ``run`` takes with so many shuffle partitions."""
    before, name = spark.conf.get("spark.sql.shuffle.partitions"), f"jobs-{partitions}-{id(run)}"
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.sparkContext.setJobGroup(name, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_bits_are_counted_in_as_many_jobs_at_any_number_of_partitions(spark):
    """They were fetched in a job a partition, one after the other."""
    prints = np.random.default_rng(4).integers(0, 256, (50, 8), np.uint8)
    rows = spark.createDataFrame([(k, p.tobytes()) for k, p in enumerate(prints)], "node long, fp binary")
    ones = np.unpackbits(prints, axis=1, bitorder="little").astype(float)
    found = []
    assert 0 < jobs_of(spark, 12, lambda: found.append(simhash.bit_counts(rows, 64))) <= 3
    assert (found[0] == ones.T @ ones).all()


def test_languages_are_counted_in_as_many_jobs_at_any_number_of_partitions(spark):
    docs = documents(spark, [prose(20, k) for k in range(40)], langs=["en", "de"] * 20)
    few, many = (jobs_of(spark, n, lambda: langid.fit(docs, "text", "lang", langid.LANGUAGES)) for n in (2, 12))
    assert 0 < many <= few + 1


# --- 2 ------------------------------------------------------------------------------------------------


def test_mix_meets_targets_in_fixed_order_with_bounded_repeats(spark):
    texts = [prose(20 + k % 30, k) for k in range(300)] + ODD
    sources = ["big" if k % 3 else f"s{k % 7}" for k in range(300)] + [None] * len(ODD)
    docs = documents(spark, texts, sources)
    plan = mixing.plan(docs).toPandas()
    again = mixing.plan(docs.repartition(7)).toPandas()
    assert plan.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (plan["size"] == [len(WORD.findall(texts[d] or "")) for d in plan.doc_id]).all()
    assert (plan.taken <= 3 * plan["size"]).all()
    by = plan.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 1).all() and (by.target <= 3 * by["size"] + 1e-6).all()
    order = plan[plan.taken > 0].position.tolist()
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= plan.taken.sum()
    rows = mixing.mix(docs)
    assert rows.columns == docs.columns and rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.plan(docs.limit(0)).count() == 0


def test_curriculum_shifts_sources_along_the_mix(spark):
    docs = documents(spark, [prose(30, k) for k in range(600)], ["abc"[k % 3] for k in range(600)])
    seen = [r.source for r in mixing.mix(docs).collect()]
    half = len(seen) // 2
    # a has 375 of 600 places, b 150, c 75, at 1.5 to 0.5, 1 and 0.5 to 1.5 times the mean: half of all are
    # placed by time 0.44, and with them 0.563 of a.
    assert abs(seen[:half].count("a") - 211) <= 8
    assert seen[:half].count("c") < 0.45 * seen.count("c")


# --- 3 ------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents_and_junk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = documents(spark, [None, "", "12 34 ++ 56", "漢字 漢字 漢字"])
    both = docs.unionByName(junk.select(docs.columns).withColumn("doc_id", F.col("doc_id") + 1_000_000)).withColumn("_h", F.lit(1))
    hidden = both.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.xxhash64("doc_id") % 2 == 0, F.col("lang")))
    got = langid.identify(hidden)
    assert got.columns == [*hidden.columns, "_lid"]
    rows = got.select("doc_id", "truth", "lang", "n_chars", "_lid").toPandas()
    clean = rows[(rows.doc_id < 1_000_000) & (rows.n_chars > 100) & rows.lang.isna()]
    assert (pd.Series([x["lang"] for x in clean._lid]) == clean.truth.reset_index(drop=True)).mean() > 0.97
    assert not any(x["accepted"] for x in rows[rows.doc_id >= 1_000_000]._lid)
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_evidence_is_fused(spark):
    """A word that says little takes the language of its host, and one that is declared otherwise keeps its text's."""
    text = {"en": "the and with this that from there where which would", "de": "der und nicht eine werden können über schön für ist"}
    texts = [text["en"] + f" {k}" for k in range(30)] + [text["de"] + f" {k}" for k in range(30)] + ["ind", "ind", text["de"]]
    langs = ["en"] * 30 + ["de"] * 30 + [None, None, "en"]
    sources = ["e.uk"] * 30 + ["d.de"] * 30 + ["e.uk", "d.de", "d.de"]
    got = {r.doc_id: r._lid.lang for r in langid.identify(documents(spark, texts, sources, langs)).collect()}
    assert (got[60], got[61], got[62]) == ("en", "de", "de")


def slow_languages(rows, table, languages):
    """lang, posterior and accepted of rows (text, declared, host, suffix), by loops over all of them."""
    k, seen = len(languages) + 1, []
    for text, declared, host, suffix in rows:
        n, ll = langid.evidence(text, table)
        p = np.exp(np.array(ll) - max(ll))
        d = (declared or "")[:2].lower()
        seen.append((n, np.array(ll), p / p.sum(), d if d in languages else "", host, suffix))
    total = lambda keep: sum((x[2] for x in seen if x[0] and keep(x)), np.zeros(k))
    whole = (total(lambda x: True) + 1) / (total(lambda x: True).sum() + k)
    out = []
    for n, ll, p, d, host, suffix in seen:
        up = total(lambda x: x[5] == suffix)
        up = (up + langid.BETA * whole) / (up.sum() + langid.BETA)
        own = total(lambda x: (x[4], x[5]) == (host, suffix)) - (p if n else 0)
        prior = (np.maximum(own, 0) + langid.ALPHA * up) / (max(own.sum(), 0) + langid.ALPHA)
        said = np.zeros(k)
        if d:
            every = total(lambda x: x[3] != "")
            said = np.log((total(lambda x: x[3] == d) + 0.5) / (every + 0.5 * k))
        logs = ll + np.log(prior) + said
        odds = np.exp(logs - logs.max())
        best = int(np.argmax(odds))
        lang = langid.NONE if not n else (*languages, langid.NONE)[best]
        out.append((lang, odds[best] / odds.sum(), lang != langid.NONE and odds[best] / odds.sum() >= langid.LEAST))
    return out


def test_languages_are_those_of_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(documents(spark, ODD, ids=[10_000 + k for k in range(len(ODD))], langs=["en", None] * 5).select("doc_id", "text", "lang", "source", "n_chars"))
    table = langid.fit(docs, "text", "lang", langid.LANGUAGES)
    rows = docs.toPandas().sort_values("doc_id")
    want = slow_languages([(t, d if isinstance(d, str) else None, s, "") for t, d, s in zip(rows.text, rows.lang, rows.source, strict=True)], table, langid.LANGUAGES)
    got = langid.identify(docs, table=table, keep=("doc_id",)).orderBy("doc_id").collect()
    assert [(x._lid.lang, x._lid.accepted) for x in got] == [(w[0], w[2]) for w in want]
    assert np.allclose([x._lid.posterior for x in got], [w[1] for w in want])


def test_languages_of_pages_are_those_of_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = []
    for url, html in pages.orderBy("page_id").select("url", "html").collect():
        html, host = html or "", (re.search(r"://([^/?#]*)", url or "") or [None, ""])[1]
        text = re.sub(r"<[^>]*>|&[a-zA-Z#0-9]+;", " ", re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ", html))
        declared = re.search(r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]{2})", html)
        rows.append((text, declared and declared[1], host, host.rsplit(".", 1)[-1]))
    frame = spark.createDataFrame([(k, t, d or "") for k, (t, d, _, _) in enumerate(rows)], "k long, text string, lang string")
    want = slow_languages(rows, langid.fit(frame, "text", "lang", langid.LANGUAGES), langid.LANGUAGES)
    got = langid.of_pages(pages).orderBy("page_id").collect()
    assert [(x.lang, x.accepted) for x in got] == [(w[0], w[2]) for w in want]


def test_language_of_pages_by_markup(spark):
    pages = spark.createDataFrame([(k, f"http://a.de/{k}", f"<html lang='de'><body>der und nicht eine {k}</body>") for k in range(20)] + [(99, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.of_pages(pages, ("de", "en")).collect()}
    assert got[3].lang == "de" and got[99].accepted is False


# --- 4 ------------------------------------------------------------------------------------------------


def test_quality_against_labels_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.scored(docs.withColumn("_q", F.lit(0))).join(labels, "doc_id").select("_quality.keep", "quality").toPandas()
    assert (got.keep == (got.quality == 1)).mean() > 0.97
    odd = quality.scored(documents(spark, ODD))
    assert odd.count() == len(ODD) and odd.where("doc_id < 2 and _quality.keep").count() == 0
    assert quality.scored(documents(spark, ODD).limit(0)).count() == 0


def test_quality_is_that_of_brute_force(spark):
    """Posterior and score of every row, votes and features counted here."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(documents(spark, ODD, ids=[10_000 + k for k in range(len(ODD))]).select("doc_id", "text"))
    rows = docs.orderBy("doc_id").collect()
    counts = {}
    for r in rows:
        v = quality.votes(quality.measures(r.text))
        counts[v] = counts.get(v, 0) + 1
    good, (_, weights) = quality.em(dict(sorted(counts.items()))), quality.train(docs)
    got = quality.scored(docs).orderBy("doc_id").collect()
    for r, x in zip(rows, got, strict=True):
        raw = (r.text or "").encode()
        shape = re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[0-9]", b"0", raw)))
        voted, bag = quality.votes(quality.measures(r.text)), {}
        for tag, words in ((1, re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())), (2, re.findall(rb"[^\x20\x09-\x0D]+", shape))):
            for w in words:
                at = zlib.crc32(w, tag) % quality.WEIGHTS
                bag[at] = bag.get(at, 0) + 1 / len(words)
        for tag, texts in ((3, [b"%d:%d" % (j, v) for j, v in enumerate(voted)]), (4, [b"bias"])):
            for t in texts:
                at = zlib.crc32(t, tag) % quality.WEIGHTS
                bag[at] = bag.get(at, 0) + 1
        score = 1 / (1 + np.exp(-np.clip(sum(weights[at] * c**0.5 for at, c in bag.items()), -30, 30)))
        assert abs(x._quality.posterior - good[voted]) < 1e-9 and abs(x._quality.score - score) < 1e-6 and x._quality.keep == (x._quality.score >= quality.LEAST)


def test_quality_features_take_whole_words():
    one, other = (set(quality.features("q" * 64 + end)[0].tolist()) for end in ("abc", "xyz"))
    assert one != other


def test_expectation_maximisation_finds_the_better_labeller():
    r = random.Random(3)
    seen = {}
    for _ in range(4000):
        good = r.random() < 0.7
        vote = tuple((1 if good == (r.random() < a) else -1) for a in (0.95, 0.9, 0.6))
        seen[vote] = seen.get(vote, 0) + 1
    found = quality.em(seen)
    assert found[(1, 1, -1)] > 0.9 and found[(-1, -1, 1)] < 0.1


# --- 5 ------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_checksummed(spark):
    texts = [prose(k % 40, k) for k in range(2000)] + ODD
    got = sharding.shards(documents(spark, texts)).toPandas()
    assert got["size"].tolist() == [len((texts[d] or "").encode()) + 1 for d in got.doc_id]
    assert got.text_crc32.tolist() == [zlib.crc32((texts[d] or "").encode()) for d in got.doc_id]
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() < 0.02 * load.mean()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.shards(documents(spark, ["a"]).limit(0)).count() == 0
    assert sharding.shards(documents(spark, ["a"] * 5, ids=[1, 1, 1, None, None])).select("shard", "slot").distinct().count() == 5


def test_repeated_rows_are_spread_and_maps_are_edited(spark, tmp_path):
    texts, ids = [prose(5, k) for k in range(400)] + ["one and the same"] * 600, [*range(400)] + [7000] * 600
    docs, folder = documents(spark, texts, ids=ids), str(tmp_path / "maps")
    got = sharding.shards(docs, folder=folder).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() < 0.05 * load.mean()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    again = sharding.shards(docs, folder=folder).toPandas()
    assert again.map_version.max() == got.map_version.max() + 1
    before, after = (sharding.SlotMap.load(spark, folder, int(x.map_version.max())) for x in (got, again))
    assert sum(a != b for a, b in zip(before.owner, after.owner, strict=True)) < 400


def test_slot_map_moves_little_and_is_versioned(spark, tmp_path):
    r = random.Random(2)
    sizes = {k: r.randrange(50, 150) for k in range(512)}
    first = sharding.SlotMap.first(8, 512).rebalanced(sizes)
    sizes[5] += 400
    second = first.rebalanced(sizes)
    assert second.version == first.version + 1 and sum(a != b for a, b in zip(first.owner, second.owner, strict=True)) < 60
    grown = second.rebalanced(sizes, 9)
    assert set(grown.owner) == set(range(9)) and sum(a != b for a, b in zip(second.owner, grown.owner, strict=True)) < 512 / 9 + 60
    second.save(spark, str(tmp_path / "m"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "m"), second.version) == second


# --- 6 ------------------------------------------------------------------------------------------------


def slow_rule(url):
    at = (url or "").find("://")
    rest = (url or "")[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = max(((len(h) + len(p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7?x", "http://a.example.com/en/70", "http://com/en/", "x://y://z.org/es/1", "http://q.org/es", "http://mexample.com/en/7", "http://a.net/de/8#t", "http://b.example.net/de/8", "http://é.com/en/\n?"]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(10_000 + k, u) for k, u in enumerate(urls)], "page_id long, url string"))
    got = urlfilter.judge(pages.withColumn("_rule", F.lit(1))).toPandas()
    for url, x in zip(got.url, got._url, strict=True):
        host, path, rule, verdict = slow_rule(url)
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule)
        assert x["verdict"] == verdict if verdict else x["verdict"] in ("allow", "block")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_url_verdicts_are_those_of_brute_force(spark):
    """Models counted, smoothed and calibrated here, over bytes."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    urls = sorted({r.url for r in pages.collect() if r.url is not None})
    sides = {v: [u for u in urls if slow_rule(u)[3] == v] for v in ("allow", "block")}

    def framed(u):
        return [256, *u.encode(), 257]

    def model(side):
        seen = {}
        for k, u in enumerate(side):
            if k % 5:
                x = framed(u)
                for i in range(1, len(x)):
                    for n in range(min(4, i) + 1):
                        row = seen.setdefault(tuple(x[i - n : i]), {})
                        row[x[i]] = row.get(x[i], 0) + 1
        return seen

    def score(seen, u):
        x, total = framed(u), 0.0
        for i in range(1, len(x)):
            p = 1 / 256
            for n in range(min(4, i) + 1):
                if row := seen.get(tuple(x[i - n : i])):
                    p = (row.get(x[i], 0) + len(row) * p) / (sum(row.values()) + len(row))
            total += np.log(p)
        return total / (len(x) - 1)

    models = {v: model(side) for v, side in sides.items()}
    ratio = lambda u: score(models["allow"], u) - score(models["block"], u)
    held = sorted((ratio(u), v) for v, side in sides.items() for k, u in enumerate(side) if not k % 5)
    cuts = [a[0] if not k else (a[0] + held[k - 1][0]) / 2 for k, a in enumerate(held)]
    share = lambda c, v: np.mean([(s >= c) == (v == "allow") for s, x in held if x == v])
    best = max([(share(c, "allow") + share(c, "block"), -abs(c), c) for c in cuts])[2]
    for r in urlfilter.judge(pages).collect():
        if r._url.rule is None and r.url and abs(r._url.ratio - best) > 1e-6:
            assert abs(r._url.ratio - ratio(r.url)) < 1e-9 and r._url.verdict == ("allow" if ratio(r.url) >= best else "block")


def test_url_models_learn_whole_urls():
    ratio = urlfilter.fit([f"http://a/{k}{'x' * 2500}good" for k in range(10)], [f"http://a/{k}{'x' * 2500}evil" for k in range(10)])
    assert ratio.good.counts["goo"]["d"] == 8 and ratio.bad.counts["evi"]["l"] == 8


def test_url_ratio_on_held_out_urls():
    r = random.Random(4)
    good = [f"http://site{r.randrange(99)}.example/articles/{r.randrange(9999)}" for _ in range(400)]
    bad = [f"http://win-cash{r.randrange(99)}.example/bet?ref={r.randrange(9999)}" for _ in range(400)]
    model = urlfilter.fit(good[:300], bad[:300])
    assert sum(model.verdict(u) == "allow" for u in good[300:]) > 95 and sum(model.verdict(u) == "block" for u in bad[300:]) > 95
    assert sum(model.good.chance("\x02htt"[-4:], chr(c)) for c in range(256)) <= 1 + 1e-9
    assert urlfilter.fit([], []).verdict("http://a") == "allow"


# --- 7 ------------------------------------------------------------------------------------------------


def test_contamination_is_that_of_brute_force(spark):
    r, texts = random.Random(5), list(ODD)
    items = [(k, prose(r.randrange(1, 40), 900 + k, 30)) for k in range(12)] + [(50, None), (51, ""), (52, "A-a"), (None, "zz yy"), (10, prose(20, 77))]
    for k in range(60):
        words = prose(r.randrange(5, 80), k, 30).split()
        if k % 2:
            at, item = r.randrange(len(words)), (items[k % 12][1]).split()
            begin = r.randrange(len(item))
            words[at:at] = item[begin : begin + r.randrange(1, 30)]
        texts.append("-".join(words) if k % 5 == 0 else " ".join(words))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontam.contamination(documents(spark, texts), bench).select("*", decontam.names_hash(F.col("items")).alias("sha")).collect()}
    for k, t in enumerate(texts):
        x = got[k]
        assert (x.n_words, x.n_hit, x.n_items, x.sha, x.contaminated) == decontam.brute_force(t, items), t
    assert decontam.contamination(documents(spark, texts), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_automata_of_several_parts_agree_with_one(spark, monkeypatch):
    items = spark.createDataFrame([(k, prose(30, k, 50)) for k in range(8)], "item_id long, text string")
    docs = documents(spark, [prose(200, 3, 50) + " " + prose(30, k, 50) for k in range(8)])
    one = decontam.contamination(docs, items).orderBy("doc_id").collect()
    monkeypatch.setattr(decontam, "WORDS_PER_AUTOMATON", 50)
    assert len(list(decontam.automata(items))) > 2
    assert decontam.contamination(docs, items).orderBy("doc_id").collect() == one


def test_share_is_exact(spark):
    """Of 38 words 13 are 0.342: below 0.35, above 0.34."""
    item = " ".join(f"q{k}" for k in range(13))
    docs, bench = documents(spark, [item + " f" * 25]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [decontam.contamination(docs, bench, share=s).first().contaminated for s in (0.35, 0.34)] == [False, True]


def test_decontaminate_drops_and_cuts(spark):
    item = " ".join(f"q{k}" for k in range(20))
    filler = " ".join(f"f{k}" for k in range(1000))
    docs = documents(spark, [item, f"{filler}, {item}! {filler}", filler, None])
    got = {r.doc_id: r for r in decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert sorted(got) == [1, 2, 3] and got[2].text == filler and got[3].text is None
    assert got[1].text == f"{filler}, ! {filler}" and got[1].n_chars == len(got[1].text)


# --- 8 ------------------------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    r = random.Random(6)
    alphabet = ["a", " ", "  ", "\n", "\t", "the", "'s", "é", "漢", "\U0001f600", "<|endoftext|>", "9", "...", "\u00a0", "\u2003", "\u0085", "-", "can't", "\r\n", "e\u0301"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(400))) for _ in range(200)] + ["".join(r.choice(alphabet) for _ in range(60_000)), "b" * 100_000, "word " * 20_000]
    got = tokencount.token_counts(documents(spark, texts), path).orderBy("doc_id").collect()
    assert [x.n_tokens for x in got] == [len(tok.encode(t or "", add_special_tokens=False)) for t in texts]
    assert [x.n_bytes for x in got] == [len((t or "").encode()) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_splice_is_the_whole_encoding_for_any_chunk(seed):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(seed)
    text = "".join(r.choice(["ab", " ", "  ", "\n\n", "the ", "é", "1 2", "x" * r.randrange(1, 90), "<|endoftext|>"]) for _ in range(600))
    encode = lambda t: ((e := tok.encode(t, add_special_tokens=False)).ids, e.offsets)
    for chunk, overlap in ((64, 16), (200, 40), (1000, 100)):
        assert list(tokencount.splice(text, encode, chunk, overlap)) == encode(text)[0]


# --- 9 ------------------------------------------------------------------------------------------------


def test_nearest_recall_and_exact_scores(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.toPandas()
    v, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    found = ann.nearest(vectors).toPandas()
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        score[q] = -np.inf
        own = found[found.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        want = set(ids[np.lexsort((ids, -score))[:20]])
        recall.append(len(want & set(own.vec_id)) / 20)
        at = [int(np.flatnonzero(ids == x)[0]) for x in own.vec_id]
        assert np.allclose(own.score, score[at], rtol=1e-12) and (np.diff(own.score) <= 0).all()
    assert np.mean(recall) >= 0.9


def test_nearest_ignores_unusable_vectors_and_breaks_ties_by_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [float("inf"), 1.0]), (9, [-1.0, 5.0]), (None, [1.0, 1.0]), (20, [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame, sample=100, lists=2, probes=2, parts=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (0, 4, 9, -1.0), (20, 1, 9, 15.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert ann.nearest(frame.limit(0)).count() == 0 and ann.nearest(frame.where("vec_id = 4")).count() == 0


def test_hot_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    r = np.random.default_rng(1)
    rows = [(int(k), [1.0, 1.0, 0.0, float(x)]) for k, x in enumerate(r.normal(size=600) * 1e-3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, lists=2, probes=2, parts=2).toPandas()
    v = np.array([x for _, x in rows])
    for q in range(0, 600, 20):
        s = v @ v[q]
        s[q] = -np.inf
        assert np.allclose(sorted(got[got.query_id == q].score), sorted(s)[-20:])


def test_copies_beyond_the_rerank_are_told_apart(spark):
    """More copies, and more near copies, in a block than are reranked at first."""
    r = np.random.default_rng(2)
    base = r.normal(size=8)
    rows = [(int(k), (base + (0 if k % 2 else 1e-4) * r.normal(size=8)).tolist()) for k in r.permutation(800)]
    rows += [(int(1000 + k), r.normal(size=8).tolist()) for k in range(200)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample=300, lists=2, probes=2, parts=2, rerank=100).toPandas()
    ids, v = np.array([k for k, _ in rows]), np.array([x for _, x in rows])
    copies = np.flatnonzero((ids < 1000) & (ids % 2 == 1))
    for q in ids[ids % 20 == 0].tolist():
        s = (v * v[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == ids[np.lexsort((ids, -s))[:20]].tolist()
    frame = spark.createDataFrame([(int(ids[k]), v[k].tolist()) for k in copies] + [(0, base.tolist())], "vec_id long, embedding array<double>")
    only = ann.nearest(frame, sample=300, lists=2, probes=2, parts=2, rerank=100).where("query_id = 0").orderBy("rank").toPandas()
    assert only.vec_id.tolist() == sorted(ids[copies].tolist())[:20]


@pytest.mark.parametrize("kind", ["norms", "near copies", "whole numbers", "long and short"])
def test_nearest_is_brute_force_on_uneven_vectors(spark, kind):
    """Norms that differ, near copies, products that tie, few long vectors; of a length that few numbers divide."""
    r, n = np.random.default_rng(4), 1_500
    v = r.normal(size=(n, 10))
    if kind == "norms":
        v *= np.exp(1.5 * r.normal(size=(n, 1)))
    elif kind == "near copies":
        v = v[r.integers(3, size=n)] + 1e-4 * r.normal(size=(n, 10))
    elif kind == "whole numbers":
        v = np.sign(v) * (np.abs(v) > 1.2) + (np.arange(10) == 0)
    else:
        v[r.choice(n, 30, replace=False)] *= 40
    ids = r.permutation(n)
    frame = spark.createDataFrame([(int(k), x.tolist()) for k, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, sample=300).orderBy("query_id", "rank").toPandas()
    usable = np.abs(v).sum(1) > 0
    assert len(got) == 20 * np.sum(usable & (ids % 20 == 0))
    for q, own in got.groupby("query_id"):
        s = np.where(usable & (ids != q), (v * v[ids == q][0]).sum(1), -np.inf)
        best = np.lexsort((ids, -s))[:20]
        assert own.vec_id.tolist() == ids[best].tolist() and own.score.tolist() == s[best].tolist()


def test_lists_that_cannot_hold_the_best_are_passed_by():
    v = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    bounds = ann.Bounds(v, np.array([0.1, 0.1, 0.1]), np.array([1.1, 1.1, 1.1]), 1.1)
    assert bounds.needed(v[:1], np.array([0.5])).tolist() == [[True, False, False]]
    assert bounds.needed(v[:1], np.array([-np.inf])).all() and bounds.needed(v[:1] * 1e300, np.array([np.nan])).all()


# --- 10 -----------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "card":
        total = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in hit.split(".")), "phone": 9 <= len(digits) <= 15}[kind]


def slow_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group()))


def test_base_spans_are_those_of_the_plain_patterns(spark):
    r = random.Random(8)
    bits = ["a@b.co", "x", "@", ".", "-", " ", "1", "12", "255", "256", "10.0.0.1", "+1 (202) 555-0100", "4111 1111 1111 1111", "4111111111111111", "00", "+", "é", "%", "(", ")", "\n", "mail", "at", "192.168.1.300", "0001.2.3.4", "%d@e.f"]
    texts = ODD + ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(600)] + ["1" * 2_000, "a" * 2_000 + "@", "+1" * 500]
    got = {x.doc_id: x for x in pii.digest(pii.find(documents(spark, texts))).collect()}
    for k, t in enumerate(texts):
        spans = slow_spans(t)
        said = ",".join(f"{pii.KINDS[o]}:{a}:{b}" for a, o, b in spans)
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(o == j for _, o, _ in spans) for j in range(4)], t[:200] if t else t
        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(got[k].spans.split(","))


def test_method_adds_spans_that_the_base_lacks(spark):
    """Dotted cards and spelled-out addresses are no base spans; what passes by chance stays alone."""
    r, texts = random.Random(9), []
    for k in range(300):
        card = "4" + "".join(r.choice("0123456789") for _ in range(14))
        card += next(d for d in "0123456789" if valid("card", card + d))
        texts.append(f"paid by {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]} today")
        texts.append(f"ask user{k} at mail dot example dot com for it")
        texts.append("serial " + "/".join("".join(r.choice("0123456789") for _ in range(5)) for _ in range(3)) + " of it")
    found = pii.find(documents(spark, texts)).toPandas().set_index("doc_id")
    added = [len(set(map(tuple, found.spans[k])) - set(map(tuple, found.base[k]))) for k in range(len(texts))]
    assert sum(x > 0 for x in added[::3]) > 270 and sum(x > 0 for x in added[1::3]) > 270
    assert sum(x > 0 for x in added[2::3]) < 10


def test_redacts_every_row_by_its_own_text(spark):
    texts = [f"write to user{k}@mail.example.com or call +49 30 {1000000 + k}" for k in range(20)] + ["nothing here", "a@b.co", None, "", "mail me@x.org", "é a@b.co,c@d.eu"]
    ids = [*range(20), 1, None, None, 1, None, 1]
    got = [x.text for x in pii.redact(documents(spark, texts, ids=ids)).collect()]
    assert got[0] == "write to [email] or call [phone]" and got[20:] == ["nothing here", "[email]", None, "", "mail [email]", "é [email],[email]"]
    assert pii.find(documents(spark, texts).limit(0)).count() == 0 and pii.redact(documents(spark, texts).limit(0)).count() == 0


# --- all ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    order = lambda d: d.sort_values("doc_id").reset_index(drop=True)[sorted(d.columns)]
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, check_exact=True)
