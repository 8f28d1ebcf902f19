"""Reader queries: documents and lines of the landed formats, derived from the tables, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.functions import sql as S
from catalogwatch.plans.registry import query, table
from catalogwatch.session import spread
from catalogwatch.sources import readers as R


@query(
    "product_documents",
    """SELECT 'https://a.example.com/' || l_orderkey || '-' || l_linenumber AS url, 'part ' || l_partkey AS name, replace(CAST(l_extendedprice AS VARCHAR), '.', ',') AS price,
      l_returnflag AS v_id, CAST(l_quantity AS VARCHAR) AS v_stock FROM lineitem""",
)
def product_documents(spark, d):
    """Export documents (object or bare list) opened to product rows."""
    li = spread(table(spark, d, "lineitem"))
    item = F.struct(
        F.concat(F.lit("https://a.example.com/"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("url"),
        F.concat(F.lit("part "), "l_partkey").alias("name"),
        F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(",")).alias("price"),
        F.array(F.struct(F.col("l_returnflag").alias("variation_id"), F.col("l_quantity").cast("string").alias("stock"))).alias("variations"),
    )
    one = F.to_json(item)
    doc = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('{"generated_at":"x","products":['), one, F.lit(',5,null]}'))).otherwise(
        F.concat(F.lit("["), one, F.lit(',"text"]'))
    )
    rows = R.products_from_json(li.select(doc.alias("doc")), "doc")
    v = F.col("variations")[0]
    return rows.select("url", "name", "price", v["variation_id"].alias("v_id"), v["stock"].alias("v_stock"))


@query(
    "url_map_documents",
    """SELECT o_orderkey AS map, 'https://a.example.com/' || o_custkey AS url, 0 AS pos FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT o_orderkey, 'https://b.example.com/' || o_custkey, 2 FROM orders WHERE o_orderstatus <> 'P'""",
)
def url_map_documents(spark, d):
    """URL-map documents with text and record entries; other entries and broken documents drop out."""
    o = table(spark, d, "orders")
    doc = F.when(
        F.col("o_orderstatus") != "P",
        F.format_string('{"links":["https://a.example.com/%d",7,{"url":"https://b.example.com/%d","priority":3},{"title":"x"}]}', "o_custkey", "o_custkey"),
    ).otherwise(F.lit('{"links":"broken'))
    return R.links_from_json(o.select(F.col("o_orderkey").alias("map"), doc.alias("doc")), "doc", ["map"])


@query(
    "preseed_documents",
    """WITH u AS (SELECT 'https://a.example.com/' || c_custkey || '/' AS url FROM customer UNION SELECT 'https://b.example.com/' || c_nationkey || '.html' FROM customer) SELECT url FROM u""",
)
def preseed_documents(spark, d):
    """Pre-seeded URLs from three document shapes, normalised and without repeats."""
    c = table(spark, d, "customer")
    shapes = {0: '{"links":["https://a.example.com/%d",{"url":"https://b.example.com/%d.html"}]}', 1: '{"x":["https://a.example.com/%d"],"y":"https://b.example.com/%d.html","z":1}',
              2: '["https://a.example.com/%d",{"url":"https://b.example.com/%d.html"},null]'}
    doc = None
    for i, shape in shapes.items():
        text = F.format_string(shape, "c_custkey", "c_nationkey")
        doc = F.when(F.col("c_custkey") % 3 == i, text) if doc is None else doc.when(F.col("c_custkey") % 3 == i, text)
    return R.preseed_from_json(c.select(doc.alias("doc")), "doc").select("url")


@query(
    "sitemap_filter",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N') OR l_linenumber = 1""",
)
def sitemap_filter(spark, d):
    """Sitemap entries kept by frequency or product address."""
    li = table(spark, d, "lineitem")
    freq = F.when(F.col("l_returnflag") == "A", "daily").when(F.col("l_returnflag") == "N", "weekly").otherwise("monthly")
    url = F.when(F.col("l_linenumber") == 1, "https://a.example.com/product/1").otherwise("https://a.example.com/about")
    return R.filter_sitemap(li.select("l_orderkey", "l_linenumber", url.alias("url"), freq.alias("changefreq"))).select("l_orderkey", "l_linenumber")


@query(
    "sitemap_levels",
    """SELECT 'region-' || r_regionkey AS map, 0 AS depth FROM region UNION ALL SELECT 'nation-' || n_nationkey, 1 FROM nation
    UNION ALL SELECT DISTINCT 'customer-' || c_custkey, 2 FROM customer
    UNION ALL SELECT DISTINCT 'deep-' || (n_nationkey % 12), CAST(n_nationkey % 12 AS INTEGER) FROM nation""",
)
def sitemap_levels(spark, d):
    """Sitemap indexes followed to their child maps, level by level."""
    roots = table(spark, d, "region").select(F.concat(F.lit("region-"), "r_regionkey").alias("map"))
    a = table(spark, d, "nation").select(F.concat(F.lit("region-"), "n_regionkey").alias("parent"), F.concat(F.lit("nation-"), "n_nationkey").alias("child"))
    b = table(spark, d, "customer").select(F.concat(F.lit("nation-"), "c_nationkey").alias("parent"), F.concat(F.lit("customer-"), "c_custkey").alias("child"))
    # A chain of twelve maps and a link back to its start.
    n = table(spark, d, "nation").select((F.col("n_nationkey") % 12).alias("k"))
    deep = n.select(F.concat(F.lit("deep-"), "k").alias("parent"), F.concat(F.lit("deep-"), (F.col("k") + 1) % 12).alias("child"))
    start = n.where("k = 0").select(F.concat(F.lit("deep-"), "k").alias("map"))
    return R.expand_sitemaps(a.unionByName(b).unionByName(deep), roots.unionByName(start))


@query(
    "sql_functions",
    """SELECT page_id, rtrim(regexp_replace(url, '[#?].*$', ''), '/') AS stripped, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS domain,
      CAST(len(string_split(trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), '/')) AS INTEGER) AS segments, page_id + 0.5::DOUBLE AS n,
      page_id + 0.25::DOUBLE AS price FROM pages""",
)
def sql_functions(spark, d):
    """The named SQL functions over the page table."""
    S.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("cw_pages")
    return spark.sql(
        """SELECT page_id, cw_strip_url(url) AS stripped, cw_domain(cw_host(url)) AS domain, cw_path_segments(url) AS segments,
           cw_number(concat(page_id, ',5')) AS n, cw_clean_price(concat(page_id, ',25 ₽')) AS price FROM cw_pages"""
    )
