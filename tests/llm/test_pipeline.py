"""Every stage of the pipeline against what must hold of its own input, and the whole against brute force."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from oreline.llm import decontam, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, stored as the driver does."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def test_columns_stay_until_the_last_stage(stages):
    first = next(iter(stages.values()))[0]
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.dtypes == first.dtypes, name


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_go_and_others_stay(stages):
    before, after = (x.select("doc_id", "text").toPandas() for x in stages["near_copies"])
    kept = set(after.doc_id)
    sets = {d: shingles(t) for d, t in zip(before.doc_id, before.text, strict=True)}
    near = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sets:
        for o in sets:
            if o < d and near(o, d) >= 0.8:
                root[max(find(d), find(o))] = min(find(d), find(o))
    assert kept == {d for d in sets if find(d) == d}  # one of each group at 0.8, and nothing else goes


def test_decontamination_leaves_no_benchmark_window(spark, stages):
    before, after = stages["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontam.contamination(before, bench).where("contaminated").collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad
    clean = {r.doc_id for r in decontam.contamination(before, bench).where("n_hit = 0").collect()}
    assert {(r.doc_id, r.text) for r in before.collect() if r.doc_id in clean} == {(r.doc_id, r.text) for r in after.collect() if r.doc_id in clean}


def test_shards_hold_the_mix(stages):
    before, after = stages["shards"]
    assert before.count() == after.count()
    load = [r.b for r in after.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 8 and max(load) - min(load) < 0.05 * max(load)
    assert sharding.slot_of is not None and after.groupBy("shard", "slot").count().where("count > 1").count() == 0


def test_pipeline_survives_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, SF).count() <= 3
