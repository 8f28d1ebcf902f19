"""Readers and writers over real files."""

import json

from pyspark.sql import functions as F

from catalogwatch.operators.catalogue import full_rows
from catalogwatch.sources import readers as R
from catalogwatch.sources import writers as K
from catalogwatch.sources.versions import VersionedTable, publish_payload, read_payload

PRODUCTS = [
    {"url": "https://a.ru/p/1", "name": "One", "price": "1 290,50", "stock": 3, "variations": [{"variation_id": "v", "price": "5", "in_stock": True}]},
    {"url": "https://a.ru/p/2", "name": "Two", "price": 7.5, "extra": {"x": 1}},
    "noise", None,
]


def test_product_export(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"generated_at": "t", "products": PRODUCTS}, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(PRODUCTS[:1]))
    (tmp_path / "c.json").write_text("{broken")
    rows = full_rows(R.read_products(spark, str(tmp_path / "*.json"))).collect()
    assert sorted((r["url"], r["price"]) for r in rows) == [("https://a.ru/p/1", 5.0), ("https://a.ru/p/1", 5.0), ("https://a.ru/p/2", 7.5)]


def test_partial_lines(spark, tmp_path):
    f = tmp_path / "p.jsonl"
    f.write_text(json.dumps(PRODUCTS[0]) + "\n{bad\n\n" + json.dumps(PRODUCTS[1]) + "\n")
    assert R.read_partial(spark, str(f)).count() == 2
    assert R.read_partial(spark, str(f), rejects=True).count() == 1


def test_sitemaps(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.ru/x </loc><changefreq>daily</changefreq></url>'
        "<url><loc>https://a.ru/about</loc></url><url><loc>https://a.ru/product/1</loc></url></urlset>"
    )
    (tmp_path / "i.xml").write_text(
        '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://a.ru/m.xml</loc></sitemap></sitemapindex>'
    )
    entries = R.read_sitemap(spark, str(tmp_path / "m.xml"))
    assert entries.count() == 3
    assert sorted(r["url"] for r in R.filter_sitemap(entries).collect()) == ["https://a.ru/product/1", "https://a.ru/x"]
    assert R.read_sitemap_index(spark, str(tmp_path / "i.xml")).head()["child"] == "https://a.ru/m.xml"


def test_lists_and_logs(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("a\n\n  b \n")
    assert sorted(r["url"] for r in R.read_cached_urls(spark, str(tmp_path / "urls.txt")).collect()) == ["a", "b"]
    (tmp_path / "map.json").write_text('{"links": ["https://a.ru/1", {"url": "https://a.ru/2"}, 5]}')
    assert R.read_url_map(spark, str(tmp_path / "map.json")).count() == 2
    assert R.read_preseed(spark, str(tmp_path / "map.json")).count() == 2
    (tmp_path / "proxies.txt").write_text("# c\nhttps://u:p@h:1\nh:1:u:p\nh:2\nbad\n")
    assert R.read_proxy_list(spark, str(tmp_path / "proxies.txt")).count() == 3
    logs = tmp_path / "logs" / "deep"
    logs.mkdir(parents=True)
    (logs / "x.log").write_text('GET HTTP/1.1" 500 x\nTraceback (most recent call last)\nour API has an error\n')
    c = R.scan_error_logs(spark, str(tmp_path / "logs")).head()
    assert (c["http_500"], c["api_errors"], c["tracebacks"]) == (1, 1, 1)
    (tmp_path / "e.jsonl").write_text('{"proxy_url":"h:1","event":"Failure","timestamp":"2025-01-01T00:00:00Z"}\n{bad\n')
    e = R.read_event_log(spark, str(tmp_path / "e.jsonl")).collect()
    assert [(r["proxy"], r["failed"]) for r in e] == [("https://h:1", True)]
    (tmp_path / "audit.jsonl").write_text('{"timestamp":"t","action":"a","success":true,"details":{"k":"v"}}\n')
    assert R.read_audit(spark, str(tmp_path / "audit.jsonl")).head()["details"] == {"k": "v"}


def test_csv_round_trip(spark, tmp_path):
    rows = full_rows(spark.createDataFrame([("https://a.ru/1", 'He said "x"; y', 1234.5)], "url string, name string, price double"))
    K.write_csv(rows, str(tmp_path / "full"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "full").glob("*.csv")))
    assert "1234,5" in text and text.splitlines()[0].startswith("url;final_url;http_status")
    back = R.read_full_export(spark, str(tmp_path / "full")).head()
    assert back["price"] == 1234.5 and back["title"] == 'He said "x"; y'


def test_tables(spark, tmp_path):
    a = spark.createDataFrame([("u", 1, "x"), ("v", 1, "y")], "url string, at int, s string")
    b = spark.createDataFrame([("u", 2, "z")], "url string, at int, s string")
    snapshots = VersionedTable(spark, str(tmp_path / "snap"), "url", 4)
    snapshots.upsert(a, "at")
    snapshots.upsert(b, "at")
    assert {(r["url"], r["s"]) for r in snapshots.read().collect()} == {("u", "z"), ("v", "y")}
    p = spark.createDataFrame([("u", "a.ru", "2025-01-01T00:00:00Z", "2025-01-01")], "url string, site_domain string, fetched_at string, scraped_at string")
    K.append_history(p, str(tmp_path / "hist"))
    K.append_history(p, str(tmp_path / "hist"))
    h = spark.read.parquet(str(tmp_path / "hist"))
    assert h.count() == 2 and h.where("site_domain = 'a.ru' AND crawl_date = DATE'2025-01-01'").count() == 2
    publish_payload(p, str(tmp_path / "pay"), "7")
    assert read_payload(spark, str(tmp_path / "pay")).collect() == p.collect()
    K.append_manifest({"full": a, "seo": b}, str(tmp_path / "man"), F.lit("t"))
    assert {(r["name"], r["rows"]) for r in spark.read.parquet(str(tmp_path / "man")).collect()} == {("full", 2), ("seo", 1)}
    K.write_url_cache(spark.createDataFrame([("https://a.ru/1/",), ("https://a.ru/x",)], "url string"), str(tmp_path / "cache"))
    assert spark.read.text(str(tmp_path / "cache_products")).count() == 1
    good, bad = K.page_results(spark.createDataFrame([(1, "u"), (2, None)], "job_id int, url string"))
    assert good.count() == 1 and bad.count() == 1
