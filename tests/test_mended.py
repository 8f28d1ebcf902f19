"""Cases in which rows used to be lost or misread."""

import random

import pytest
from pyspark.sql import functions as F

from catalogwatch.operators import requests as req
from catalogwatch.operators import selectors
from catalogwatch.operators.jobs import numbered_pages
from catalogwatch.operators.urlsets import dense_index
from catalogwatch.sources.readers import expand_sitemaps


def test_every_object_of_a_script(spark):
    """Two objects in one script, code and calls around them, an object within another one, one that doesn't end."""
    from catalogwatch.operators import html_table as H
    from catalogwatch.operators import variants as O

    offers = lambda i: '{"OFFERS":[{"ID":"%d","PRICE":"1.50","NAME":"a}</b>"}]}' % i
    pages = [
        (1, f"<script>new JCCatalogElement({offers(1)}); BX.message({{'a': 1}});</script>"),
        (2, f"<script>var a = {{}}; if (a) {{ x({offers(2)}); y({offers(3)}) }}</script>"),
        (3, '<script>f({"form":{"n":1.50,"spConfig":{"attributes":{}}},"b":{}})</script>'),
        (4, f'<script>{{"variants":[ {offers(4)} </script><script>{{"OFFERS":1,"x":"variants"}}</script>'),
        (5, '<script>{"variants":[{"id":5,"variants":[]}]}</script>'),
    ]
    df = spark.createDataFrame(pages, "page_id int, html string")
    got = sorted((r["page_id"], r["vendor"], r["payload"]) for r in O.embedded_payloads(H.parse_pages(df), "page_id").collect())
    assert got == [
        (1, "bitrix", offers(1)), (2, "bitrix", offers(2)), (2, "bitrix", offers(3)), (3, "magento", '{"n":1.50,"spConfig":{"attributes":{}}}'),
        (4, "bitrix", offers(4)), (5, "insales", '{"variants":[{"id":5,"variants":[]}]}'),
    ]


def test_details_of_pages_of_every_system(spark, tmp_path):
    """Pages are told their system by detection, whatever their number is."""
    from catalogwatch.plans import pages as Q

    html = [(1, Q.EXTRA[4][1]), (2, "<p>none</p>"), *((3 + i, t) for i, (_, t) in enumerate(Q.SYSTEMS))]
    spark.createDataFrame([(i, "http://a.example/", t) for i, t in html], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in Q.cms_details(spark, str(tmp_path)).collect()] == [(1, "wordpress", True, "6.1", "shop-x")]
    got = {r["page_id"]: tuple(r)[1:4] for r in Q.cms_page_details(spark, str(tmp_path)).collect()}
    assert got == {1: ("wordpress", True, "6.1"), 2: (None, False, None), 3: ("joomla", True, "3.9"), 4: ("bitrix", True, "20.5"), 5: ("opencart", True, "3.0")}


def test_streaks_at_equal_times(spark):
    rows = [("a", 5, 1, True), ("a", 5, 2, False), ("a", 5, 3, False), ("b", 5, 1, False), ("b", 5, 2, True), ("c", 1, 1, False)]
    log = spark.createDataFrame(rows, "key string, us long, id long, ok boolean")
    got = {r["key"]: r["consecutive_failures"] for r in req.retry_statistics(log, "key", F.col("ok"), "us", "id", F.lit(1.0)).collect()}
    assert got == {"a": 2, "b": 0, "c": 1}
    ends = {r["key"]: (r["consecutive_successes"], r["consecutive_failures"]) for r in selectors.end_streaks(log, ["key"], "us", "id", "ok").collect()}
    assert ends == {"a": (0, 2), "b": (1, 0), "c": (0, 1)}


def test_sitemap_chain_of_any_length(spark):
    edges = spark.createDataFrame([(f"m{i}", f"m{(i + 1) % 11}") for i in range(11)], "parent string, child string")
    got = {r["map"]: r["depth"] for r in expand_sitemaps(edges, spark.createDataFrame([("m0",)], "map string")).collect()}
    assert got == {f"m{i}": i for i in range(11)}


def _depths(edges, roots):
    depth, frontier = {r: 0 for r in roots}, list(roots)
    while frontier:
        found = []
        for a, b in edges:
            if a in frontier and b not in depth:
                found.append(b)
                depth[b] = depth[a] + 1
        frontier = found
    return depth


@pytest.mark.parametrize("growth", [0, 4])
def test_sitemap_depths_of_any_graph(spark, growth):
    rng = random.Random(growth)
    for n, m in ((8, 12), (30, 40), (25, 120)):
        edges = [(f"m{rng.randrange(n)}", f"m{rng.randrange(n)}") for _ in range(m)] + [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("m1", None), (None, "m2")]
        roots = ["m0", "m1", "c4", "alone"]
        df = spark.createDataFrame(edges * 2, "parent string, child string")
        got = expand_sitemaps(df, spark.createDataFrame([(r,) for r in [*roots, None]], "map string"), growth).collect()
        assert {r["map"]: r["depth"] for r in got} == _depths([e for e in edges if None not in e], roots) and len(got) == len({r["map"] for r in got})


def test_sitemap_chain_of_a_thousand(spark):
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    edges = spark.range(1000).selectExpr("concat('m', id) AS parent", "concat('m', id + 1) AS child")
    got = expand_sitemaps(edges, spark.createDataFrame([("m0",)], "map string"))
    assert got.where("map = concat('m', depth)").count() == 1001 == got.count()
    assert len(jobs.getJobIdsForGroup(None)) - before < 250
    empty = spark.createDataFrame([], "parent string, child string")
    assert [tuple(r) for r in expand_sitemaps(empty, spark.createDataFrame([("m0",)], "map string")).collect()] == [("m0", 0)]


def test_positions_over_many_buckets(spark):
    df = spark.range(20_000).select((F.col("id") * 7).alias("k"))
    got = dense_index(df, ["k"], F.floor(F.col("k") / 10)).where(F.col("index") != F.col("k") / 7)
    assert got.count() == 0


def test_places_in_cells_equal_places_without(spark):
    """One job holds most rows; null times and jobs, ties in the first key."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), None if rng.random() < 0.1 else rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "job string, at int, id int")
    plain = numbered_pages(df, "job", "at", "id")
    for cell in (F.floor(F.col("at") / 7), F.col("at"), F.lit(1)):
        cut = numbered_pages(df, "job", "at", "id", cell=cell)
        assert sorted(map(tuple, cut.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


@pytest.mark.parametrize("name", ["parsed_stocks", "option_prices", "product_documents"])
def test_heavy_row_work_is_dealt_out(spark, tmp_path, name):
    from __spark_entry__ import queries

    ddl = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string"
    rows = [(k, n, k, 3.0, 9.5, "A") for k in range(20) for n in range(1, 8)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries()[name](spark, str(tmp_path))
    assert got.count() == len(rows) and got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_document_is_parsed_once(spark):
    from catalogwatch.sources import readers

    docs = spark.createDataFrame([('{"products":[{"url":"a"},5]}',), ('[{"url":"b"}]',), ("broken",)], "doc string")
    rows = readers.products_from_json(docs, "doc")
    assert sorted(r["url"] for r in rows.collect()) == ["a", "b"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1
