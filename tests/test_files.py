"""Envelopes, snapshots and reports as files, options, and a search of one's own."""

import pytest
from pyspark.sql import functions as F

from oreline.operators import filters, policy, release
from oreline.sources import files, sinks


def test_envelopes_are_written_and_read(spark, tmp_path):
    made = release.envelope(F.col("body"), F.array(F.struct(F.lit("k").alias("keyid"), F.lit("s").alias("sig"), F.lit(None).cast("string").alias("cert"))))
    files.write_envelopes(spark.createDataFrame([("é 1",)], "body string").select(made.alias("envelope")), str(tmp_path / "out"))
    row = files.signed_bytes(files.read_envelopes(spark, str(tmp_path / "out"))).first()
    assert bytes(row.payload).decode() == "é 1" and row.envelope.signatures[0].keyid == "k"
    assert bytes(row.pae).decode() == "DSSEv1 28 application/vnd.in-toto+json 4 é 1"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x").write_text("no json")
    assert files.signed_bytes(files.read_envelopes(spark, str(tmp_path / "bad"))).first().pae is None


def test_state_is_kept_and_compared(spark, tmp_path):
    refs = spark.createDataFrame([("r", "refs/tags/v1", "a"), ("r", "refs/heads/main", "b"), ("r", "refs/heads/x", "c")], "repo_id string, name string, hash string")
    files.save_state(policy.snapshot(refs, ["main"], spark.createDataFrame([("r", "a", "512")], "repo_id string, hash string, sum string")), str(tmp_path / "s"))
    kept = {(r.ref, r.sha512) for r in files.load_state(spark, str(tmp_path / "s")).collect()}
    assert kept == {("refs/tags/v1", "512"), ("refs/heads/main", None)}
    moved = refs.withColumn("hash", F.when(F.col("name") == "refs/tags/v1", "z").otherwise(F.col("hash"))).where("name != 'refs/heads/main'")
    assert {r.rule for r in files.changes_since(policy.snapshot(moved, ["main"]), str(tmp_path / "s")).collect()} == {"tag changed", "branch deleted"}


def test_a_search_of_ones_own(spark):
    rows = spark.createDataFrame([("a", b"x\ny"), ("b", b"")], "path string, data binary")
    own = lambda path, data: ((k, line.decode()) for k, line in enumerate(data.split(b"\n")) if line)
    assert sorted(map(tuple, files.each_file(rows, own, "nth long, line string").collect())) == [("a", 0, "x"), ("a", 1, "y")]


def test_report_of_history(spark):
    rows = [("p", 3, 1, "t", "a ", "t", " b", "main", ["c1"], "c2", True, ["v1"]), ("p", 3, 1, "t", "a ", "t", " b", "side", ["c1"], "c1", False, ["v1"])]
    found = spark.createDataFrame(rows, "path string, line_number long, column long, original string, context_before string, matched_text string, context_after string, branch string, first_commits array<string>, last_commit string, on_tip boolean, tags array<string>")
    said = [r.value for r in sinks.text_output(found, heading=True).orderBy("path", "ord").collect()]
    assert said == ["p", "3:a t b", "  main: first c1, still there", "  side: first c1, last c1", "  tags: v1"]
    coloured = found.limit(1).select(sinks.text_line(found, colour=True)).first()[0]
    assert coloured == "\x1b[35mp\x1b[0m:\x1b[32m3\x1b[0m:a \x1b[1;31mt\x1b[0m b"
    assert sinks.footer(sinks.stats(found, spark.createDataFrame([("p", b"12")], "path string, data binary")).first(), 2.0).startswith("2 matches in 1 of 1 files, 2 bytes")


@pytest.mark.parametrize("bad", [{}, {"terms": 1, "history": True, "branches": True}, {"dorks": 1, "anchored": True}, {"terms": 1, "json": True, "colour": True}, {"terms": 1, "only_matching": True, "lines": 1}, {"terms": 1, "match": "x"}])
def test_options_that_do_not_go_together(bad):
    with pytest.raises(ValueError):
        filters.checked_options(**bad)
    filters.checked_options(terms=1, history=True)
