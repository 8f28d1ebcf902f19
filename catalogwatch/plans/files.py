"""Files landed from the tables and read back: lines, logs, exports, histories, versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.operators import cms as C
from catalogwatch.operators import snapshots as snap
from catalogwatch.plans.bindings import CRAWLS, PRODUCTS, products
from catalogwatch.plans.catalogue import FULL, full_table
from catalogwatch.plans.registry import query, table
from catalogwatch.plans.snapshots import ORDER, sides
from catalogwatch.sources import readers as R
from catalogwatch.sources import writers as K
from catalogwatch.sources.versions import VersionedTable, publish_payload, read_payload
from catalogwatch.streaming.runner import work_folder


def _partial_lines(spark, d):
    """One run's lines: products, lines cut off in the middle, and blanks."""
    li = table(spark, d, "lineitem")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    item = F.to_json(F.struct(
        F.concat_ws("-", F.lit("u"), "l_orderkey", "l_linenumber").alias("url"), F.concat(F.lit('He said "'), "l_returnflag", F.lit('"')).alias("name"),
        F.col("l_extendedprice").alias("price"), F.array(F.struct(F.col("l_linestatus").alias("variation_id"))).alias("variations"),
    ))
    line = F.when(n % 7 == 0, F.substring(item, 1, 30)).when(n % 11 == 0, F.lit("  ")).otherwise(item)
    path = f"{work_folder(spark, 'partial')}/lines"
    li.select(line.alias("value")).write.text(path)
    return path


@query(
    "partial_lines",
    """SELECT 'u-' || l_orderkey || '-' || l_linenumber AS url, 'He said "' || l_returnflag || '"' AS name, l_extendedprice AS price, l_linestatus AS v_id
    FROM lineitem WHERE (l_orderkey + l_linenumber) % 7 <> 0 AND (l_orderkey + l_linenumber) % 11 <> 0""",
)
def partial_lines(spark, d):
    """Products of a partial run, line by line; broken and blank lines drop out."""
    rows = R.read_partial(spark, _partial_lines(spark, d))
    return rows.select("url", "name", F.col("price").cast("double").alias("price"), F.col("variations")[0]["variation_id"].alias("v_id"))


@query("partial_rejects", "SELECT substring('{\"url\":\"u-' || l_orderkey || '-' || l_linenumber || '\",\"name\":\"He said \\\"', 1, 30) AS line, count(*) AS n FROM lineitem WHERE (l_orderkey + l_linenumber) % 7 = 0 GROUP BY 1")
def partial_rejects(spark, d):
    """Broken lines of a partial run."""
    return R.read_partial(spark, _partial_lines(spark, d), rejects=True).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("cached_url_lines", "SELECT 'https://a.example.com/' || c_custkey AS url FROM customer WHERE c_custkey % 5 <> 0")
def cached_url_lines(spark, d):
    """A cached list of addresses; blank lines drop out and blanks around an address too."""
    c = table(spark, d, "customer")
    line = F.when(c.c_custkey % 5 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("  https://a.example.com/"), "c_custkey", F.lit(" ")))
    path = f"{work_folder(spark, 'cached')}/urls"
    c.select(line.alias("value")).write.text(path)
    return R.read_cached_urls(spark, path)


@query(
    "audit_lines",
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS action, 'user-' || user_id AS username, event_type <> 'error' AS success,
      CAST(event_id AS VARCHAR) AS event, CASE WHEN event_id % 3 = 0 THEN 'why' END AS error FROM events WHERE event_id % 13 <> 0""",
)
def audit_lines(spark, d):
    """An audit log as JSON lines; lines that are no JSON drop out."""
    e = table(spark, d, "events")
    item = F.to_json(F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("user-"), "user_id").alias("username"),
        F.col("event_type").alias("action"), F.create_map(F.lit("event"), F.col("event_id").cast("string")).alias("details"),
        (F.col("event_type") != "error").alias("success"), F.when(F.col("event_id") % 3 == 0, "why").alias("error"), F.lit(1).alias("unknown"),
    ))
    path = f"{work_folder(spark, 'audit')}/log"
    e.select(F.when(F.col("event_id") % 13 == 0, F.substring(item, 1, 20)).otherwise(item).alias("value")).write.text(path)
    log = R.read_audit(spark, path)
    return log.select(F.col("timestamp").alias("at"), "action", "username", "success", F.col("details")["event"].alias("event"), "error")


@query(
    "sitemap_entries",
    """SELECT 'https://a.example.com/' || CASE WHEN p_size > 25 THEN 'product/' ELSE 'about/' END || p_partkey AS url,
      CASE WHEN p_size % 3 = 0 THEN 'daily' WHEN p_size % 3 = 1 THEN 'yearly' END AS changefreq FROM part WHERE p_size > 25 OR p_size % 3 = 0""",
)
def sitemap_entries(spark, d):
    """Sitemaps as XML: entries read in parallel, kept by frequency or product address."""
    p = table(spark, d, "part")
    page = F.when(p.p_size > 25, "product/").otherwise("about/")
    often = F.when(p.p_size % 3 == 0, "<changefreq>daily</changefreq>").when(p.p_size % 3 == 1, "<changefreq>yearly</changefreq>").otherwise("")
    entry = F.concat(F.lit("<url><loc> https://a.example.com/"), page, "p_partkey", F.lit(" </loc>"), often, F.lit("</url>"))
    # A map is a document of its own, of a thousand addresses at most.
    maps = p.groupBy(F.expr("p_partkey div 1000").alias("map")).agg(F.array_join(F.collect_list(entry), "\n").alias("entries"))
    document = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "entries", F.lit("</urlset>"))
    path = f"{work_folder(spark, 'sitemap')}/maps"
    maps.select("map", document.alias("value")).repartition("map").write.partitionBy("map").text(path)
    return R.filter_sitemap(R.read_sitemap(spark, f"{path}/*")).select("url", "changefreq")


@query(
    "large_exports",
    """SELECT l_orderkey, l_linenumber, 'He said "' || l_returnflag || '": [{\\' AS name, l_extendedprice AS price, l_linestatus AS v_id FROM lineitem""",
)
def large_exports(spark, d):
    """Exports of one document each, whose product lists are read in ranges of 64 thousand bytes."""
    li = table(spark, d, "lineitem")
    item = F.to_json(F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("url"), F.concat(F.lit('He said "'), "l_returnflag", F.lit('": [{\\')).alias("name"),
        F.col("l_extendedprice").alias("price"), F.array(F.struct(F.col("l_linestatus").alias("variation_id"))).alias("variations"),
    ))
    # A document holds two thousand orders at most; beside the products it has lists that are none.
    docs = li.groupBy(F.expr("l_orderkey div 2000").alias("part")).agg(F.array_join(F.collect_list(item), ", ").alias("items"))
    text = F.concat(F.lit('{"before": [[1], {"products": [2]}], "products": [null, '), "items", F.lit(', 5], "after": {"x": [{"url": "no"}, 3]}}'))
    path = f"{work_folder(spark, 'exports')}/parts"
    docs.select("part", text.alias("value")).repartition("part").write.partitionBy("part").text(path)
    rows = R.read_large_products(spark, f"{path}/*", chunk_bytes=1 << 16)
    key = F.split("url", "-")
    return rows.select(
        key[0].cast("long").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), "name", F.col("price").cast("double").alias("price"),
        F.col("variations")[0]["variation_id"].alias("v_id"),
    )


@query(
    "full_export_rows",
    f"""WITH {FULL} SELECT url, title, price, stock, stock_value, availability, variation_id, variation_price, variation_in_stock FROM full_rows""",
)
def full_export_rows(spark, d):
    """The flat table written with decimal commas and read back."""
    path = f"{work_folder(spark, 'export')}/full"
    K.write_csv(full_table(spark, d), path)
    back = R.read_full_export(spark, path)
    return back.select("url", "title", "price", "stock", "stock_value", "availability", "variation_id", "variation_price", "variation_in_stock")


@query(
    "product_history",
    f"""WITH {PRODUCTS} SELECT site_domain, CAST('2025-01-0' || (1 + pk % 3) AS DATE) AS crawl_date, count(*) AS rows, count(DISTINCT url) AS urls
    FROM (SELECT *, 1 AS run FROM products UNION ALL SELECT *, 2 FROM products WHERE pk % 2 = 0) GROUP BY ALL""",
)
def product_history(spark, d):
    """Two runs appended to a history by site and crawl day; a day without a fetch time comes from the scrape time."""
    path = f"{work_folder(spark, 'history')}/table"
    day = F.concat(F.lit("2025-01-0"), (1 + F.col("pk") % 3).cast("string"))
    rows = products(spark, d).withColumns({
        "fetched_at": F.when(F.col("pk") % 5 == 0, F.concat(day, F.lit("T10:00:00Z"))), "scraped_at": day,
    })
    K.append_history(rows, path)
    K.append_history(rows.where("pk % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("site_domain", "crawl_date").agg(F.count("*").alias("rows"), F.count_distinct("url").alias("urls"))


@query(
    "latest_payload",
    f"""WITH {PRODUCTS} SELECT url, name, price + 1 AS price FROM products WHERE stock > 10""",
)
def latest_payload(spark, d):
    """Product payloads of two runs, of which the later one is the latest."""
    root = work_folder(spark, "payload")
    p = products(spark, d)
    publish_payload(p, root, "1")
    publish_payload(p.where("stock > 10").withColumn("price", F.col("price") + 1), root, "2")
    return read_payload(spark, root).select("url", "name", "price")


@query(
    "versioned_upsert",
    f"""WITH {CRAWLS} SELECT url, job_id, price, availability, title FROM crawls
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at DESC, job_id DESC) = 1""",
)
def versioned_upsert(spark, d):
    """Snapshots upserted in three versions, the newest crawl first: of each address the newest row stays."""
    snapshots = VersionedTable(spark, f"{work_folder(spark, 'versions')}/snapshots", "url", 16)
    prev, curr = sides(spark, d)
    for part in (curr.where("job_id % 2 = 0"), prev, curr.where("job_id % 2 <> 0")):
        snapshots.upsert(part, ORDER)
    return snapshots.read().select("url", "job_id", "price", "availability", "title")


@query(
    "version_before",
    """WITH o AS (SELECT 'https://shop.example.com/item/' || o_custkey AS url, o_orderkey AS job_id, o_orderdate AS crawl_at FROM orders)
    SELECT url, job_id FROM o WHERE crawl_at < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at DESC, job_id DESC) = 1""",
)
def version_before(spark, d):
    """The first version, read after a second one was made."""
    snapshots = VersionedTable(spark, f"{work_folder(spark, 'versions')}/snapshots", "url", 16)
    prev, curr = sides(spark, d)
    first = snapshots.upsert(snap.latest_per_url(prev, ORDER), ORDER)
    snapshots.upsert(curr, ORDER)
    return snapshots.read(first).select("url", "job_id")


@query(
    "own_cms_marks",
    """SELECT page_id, CASE WHEN listed THEN 'listed' WHEN hits > 0 THEN 'own' END AS cms, CASE WHEN listed THEN 1.0 ELSE hits / 2.0::DOUBLE END AS confidence FROM (
      SELECT page_id, contains(url, 'page=') AS listed, CAST(contains(lower(url), 'utm') AS INTEGER) + CAST(contains(lower(url), '.html') AS INTEGER) AS hits FROM pages)""",
)
def own_cms_marks(spark, d):
    """Shop systems by a caller's table of marks, with marks of an own system added behind it."""
    known = [C.Mark("listed", "url", "page=")]
    extra = [C.Mark("own", "url", "utm"), C.Mark("own", "url", r"\.html")]
    return C.detect(table(spark, d, "pages"), marks=known, extra=extra).select("page_id", "cms", "confidence")
