"""Registered queries against their SQL on the smallest tables, and the search on a stream."""

import duckdb
import pytest

from oreline.operators.search import Parameters, Search
from oreline.plans import small_queries  # noqa: F401
from oreline.plans.queries import ORACLE_SQL, QUERIES
from oreline.streaming.search import stream_matches

SF = "/root/testdata/sf0.001"
#: One of each family; the driver compares all.
NAMES = ("search_package_normalized", "search_substring", "search_domain_typo", "context_lines", "dork_search", "variations_qwerty", "dir_hash_h1", "previous_tag", "snapshot_diff", "commit_rules", "heads_not_pointed_to", "history_with_merges", "variation_stats", "text_report", "tag_metadata")


#: These also under the settings of production: compiled stages and plans that adapt.
PRODUCTION = ("search_package_normalized", "context_columns", "history_with_merges")


@pytest.mark.parametrize("name", PRODUCTION)
def test_query_equals_sql_in_production(spark, name):
    settings = {"spark.sql.codegen.wholeStage": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        test_query_equals_sql(spark, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "part", "conversations", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).map(str).values.tolist()))
    assert rows(got) == rows(want)


def test_places_of_many_hits_in_one_text(spark):
    n = 20_000
    search = Search(["the"], Parameters("normalized", context=True))
    found = search.match_permissive(spark, ["the é\nx " * n])
    assert found.selectExpr("count(*)", "max(start_of_word)", "max(line_number)", "max(column)", "count_if(trimmed_left)").first() == (n, 9 * (n - 1), n, 3, 0)


def test_all_top_level_domains():
    from oreline.functions.tlds import installed_tlds

    tlds = installed_tlds()
    assert len(tlds) >= 1337 and {"com", "xyz"} <= set(tlds) and list(tlds) == sorted(set(tlds))


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    spark.createDataFrame([(1, "the end"), (2, "a The")], "id long, text string").write.parquet(str(tmp_path / "in"))
    search = Search(["the"], Parameters("normalized"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    stream_matches(stream, search, ["id"], "text", str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.matched_text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["The", "the"]
