import duckdb
import pytest
from pyspark.sql import functions as F

from vecstead.llm import url_filter

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://A.Example.COM/en/x?y=/z#/q", "http://www.example.com/en/",
    "http://www.example.com/en", "https://x.www.example.com/en/a", "http://notexample.com/en/", "http://a.net/es/x", "http://a.net/fr/",
    "http://a.net/de/", "http://a.net?x=/es/", "a://b://c.com/x", "http://É.net/es/", "http://a.com:80/en/", "http://.com/", "http://a..net/fr/x",
]


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in url_filter.query(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()}
    want = duckdb.connect().execute(url_filter.ORACLE.replace("from pages)", f"from '{tmp_path}/pages.parquet/*.parquet')")).fetchall()
    assert got == {tuple(x) for x in want}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.col("key").endswith("7"))
    for size in (2_001, 40_000):  # too small a guess makes more levels, not wrong answers
        cascade = url_filter.build_cascade(listed, universe, size, 3)
        assert len(cascade.levels) > 1
        assert universe.where(cascade.holds(F.col("key")) != F.col("key").endswith("7")).count() == 0


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", 2), (1, "http://a.com/", 2)], "page_id long, url string, host int")
    got = url_filter.judge_urls(pages).collect()
    assert [(r.host, r.rule, r.verdict) for r in got] == [("a.com", "com/", "allow")] * 2
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert [r.verdict for r in url_filter.judge_urls(pages, ()).collect()] == ["allow", "allow"]
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, (url_filter.Rule("a", "/", "allow"), url_filter.Rule("a", "/", "block")))
