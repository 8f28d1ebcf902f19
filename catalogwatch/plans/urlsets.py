"""URL functions and URL-set queries over the page and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.functions import urls as U
from catalogwatch.operators import urlsets as us
from catalogwatch.plans.bindings import CRAWLS, crawls
from catalogwatch.plans.registry import query, table

NETLOC = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
STRIPPED = "rtrim(regexp_replace(trim(url), '[#?].*$', ''), '/')"


def page_urls(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


@query(
    "url_normal_forms",
    f"""SELECT page_id, {STRIPPED} AS stripped,
      CASE WHEN regexp_matches(regexp_extract(url, '^[^?#]*', 0), '/[^/.]+$')
        THEN regexp_extract(url, '^[^?#]*', 0) || '/' || regexp_replace(url, '^[^?#]*', '') ELSE url END AS discovery,
      {STRIPPED} || '/' AS site_form, regexp_replace({NETLOC}, '^www\\.', '') AS domain,
      {NETLOC} AS host, len(string_split(trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), '/')) AS segments,
      TRUE AS valid
    FROM pages""",
)
def url_normal_forms(spark, d):
    """Three normal forms, domain, host and depth of every page address."""
    u = F.col("url")
    return page_urls(spark, d).select(
        "page_id",
        U.strip_url(u).alias("stripped"),
        U.slash_path(u).alias("discovery"),
        U.site_slash_url(u).alias("site_form"),
        U.normalise_domain(U.host_of(u)).alias("domain"),
        U.host_of(u).alias("host"),
        U.path_segments(u).cast("bigint").alias("segments"),
        U.is_valid_url(u).alias("valid"),
    )


@query(
    "url_params",
    """SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
      regexp_extract(url, '^[^?#]*', 0) || '?'
        || CASE WHEN list_aggregate(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'page=')), 'string_agg', '&') IS NULL THEN ''
           ELSE list_aggregate(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'page=')), 'string_agg', '&') || '&' END
        || 'page=' || n || regexp_extract(url, '#.*$', 0) AS page_url
    FROM pages, (SELECT unnest(range(1, 4)) AS n)""",
)
def url_params(spark, d):
    """Page parameter read, and the addresses of three result pages built."""
    u = F.col("url")
    p = page_urls(spark, d).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return p.select("page_id", U.query_param(u, "page").alias("page"), U.with_query_param(u, "page", F.col("n")).alias("page_url"))


@query(
    "product_urls",
    """WITH u AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5
        WHEN 0 THEN 'https://a.example.com/Catalog/goods-x/item-' || l_partkey
        WHEN 1 THEN 'https://a.example.com/catalog/' || l_partkey
        WHEN 2 THEN 'https://a.example.com/p/' || l_partkey || '/'
        WHEN 3 THEN 'https://a.example.com/view?id=' || l_partkey
        ELSE 'https://a.example.com/about/team/us' END AS url FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_linenumber % 5 IN (0, 2, 3) AS product,
      l_linenumber % 5 IN (0, 4) AS deep_shop, l_linenumber % 5 = 2 AS numbered, l_linenumber % 5 <> 6 AS candidate FROM u""",
)
def product_urls(spark, d):
    """Product-address predicates."""
    n = F.col("l_linenumber") % 5
    part = F.col("l_partkey").cast("string")
    url = (
        F.when(n == 0, F.concat(F.lit("https://a.example.com/Catalog/goods-x/item-"), part))
        .when(n == 1, F.concat(F.lit("https://a.example.com/catalog/"), part))
        .when(n == 2, F.concat(F.lit("https://a.example.com/p/"), part, F.lit("/")))
        .when(n == 3, F.concat(F.lit("https://a.example.com/view?id="), part))
        .otherwise(F.lit("https://a.example.com/about/team/us"))
    )
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", url.alias("url"))
    u = F.col("url")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        U.is_product_url(u).alias("product"),
        U.looks_like_product(u, ("/about/",), min_segments=3).alias("deep_shop"),
        U.looks_like_product(u, (), numeric_last=True).alias("numbered"),
        U.is_candidate_url(u, F.lit("a.example.com")).alias("candidate"),
    )


@query(
    "clean_url_map",
    f"""WITH u AS (SELECT page_id, {STRIPPED} AS url, {NETLOC} AS host FROM pages)
    SELECT url, min(page_id) AS pos FROM u WHERE ends_with(host, '.example.com') AND url NOT LIKE '%.html' GROUP BY url""",
)
def clean_url_map(spark, d):
    """URL map cleaned with a caller-supplied include rule; first position stays."""
    include = lambda c: U.netloc_of(c).endswith(".example.com") & ~c.endswith(".html")
    return us.clean_url_map(page_urls(spark, d), "page_id", include=include)


@query(
    "site_rule_urls",
    f"""WITH u AS (SELECT url, regexp_replace({NETLOC}, '^www\\.', '') AS domain,
      trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/') AS path FROM pages)
    SELECT url, domain FROM u WHERE contains(lower(url), CASE WHEN ends_with(domain, '.org') THEN '/en/' ELSE '/es/' END)
      AND len(string_split(path, '/')) >= 2
      AND (ends_with(domain, '.org') = FALSE OR regexp_matches(string_split(path, '/')[-1], '^[0-9]+$'))""",
)
def site_rule_urls(spark, d):
    """URLs that satisfy the profile of their own site."""
    p = page_urls(spark, d)
    domain = U.normalise_domain(U.host_of(F.col("url")))
    org = F.col("domain").endswith(".org")
    profiles = p.select(domain.alias("domain")).distinct().select(
        "domain",
        F.array(F.when(org, "/EN/").otherwise("/ES/")).alias("patterns"),
        F.lit(2).alias("min_segments"),
        org.alias("numeric_last"),
    )
    return us.with_site_rules(p.select("url"), profiles)


LISTS = f"""lists AS (
  SELECT {STRIPPED} AS url, page_id AS pos, page_id % 4 AS s FROM pages)"""


def _lists(spark, d):
    p = page_urls(spark, d).select(U.strip_url(F.col("url")).alias("url"), F.col("page_id").alias("pos"))
    return [p.where(F.col("pos") % 4 == i) for i in range(4)]


@query(
    "merge_ordered_urls",
    f"""WITH {LISTS} SELECT url, s AS source, pos FROM (
      SELECT url, CAST(s AS INTEGER) AS s, pos FROM lists QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, pos) = 1)""",
)
def merge_ordered_urls(spark, d):
    """Ordered union of four URL lists."""
    return us.merge_ordered(_lists(spark, d))


@query(
    "discover_urls",
    f"""WITH {LISTS} SELECT url, CAST(s AS INTEGER) AS source, pos FROM lists WHERE s < 3
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, pos) = 1""",
)
def discover_urls(spark, d):
    """Prioritised discovery; the category list is ignored because others found URLs."""
    a, b, c, e = _lists(spark, d)
    out = us.discover(a, b, c, e.limit(0), e)
    return out


@query(
    "discover_branches",
    f"""WITH {LISTS}, forced AS (SELECT 'forced' AS branch, url, CAST(s + 1 AS INTEGER) AS source, pos FROM lists
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, pos) = 1),
    nothing AS (SELECT 'nothing_found' AS branch, url, CAST(CASE s WHEN 0 THEN 0 ELSE 4 END AS INTEGER) AS source, pos FROM lists WHERE s IN (0, 3)
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, pos) = 1),
    replaced AS (SELECT 'replaced' AS branch, url, CAST(s - 1 AS INTEGER) AS source, pos FROM lists WHERE s > 0
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, pos) = 1)
    SELECT * FROM forced UNION ALL SELECT * FROM nothing UNION ALL SELECT * FROM replaced WHERE source < 2""",
)
def discover_branches(spark, d):
    """Discovery with a forced category list, with nothing else found, and with a preseed that replaces the known URLs."""
    a, b, c, e = _lists(spark, d)
    none = a.where("false")
    forced = us.discover(none, a, b, c, e, force_category=True)
    nothing = us.discover(a, none, none, none, e)
    replaced = us.discover(a, b, c, none, e, preseed_replaces=True)
    named = [x.select(F.lit(n).alias("branch"), "url", "source", "pos") for n, x in (("forced", forced), ("nothing_found", nothing), ("replaced", replaced))]
    return named[0].union(named[1]).union(named[2])


@query(
    "pending_urls",
    """WITH done AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    SELECT c_custkey, 'https://s.example.com/' || c_custkey AS url FROM customer WHERE c_custkey NOT IN (SELECT k FROM done)""",
)
def pending_urls(spark, d):
    """URLs not processed under either address."""
    return us.pending_urls(_wanted(spark, d), _done(spark, d)).select("c_custkey", "url")


@query(
    "processed_urls",
    """WITH done AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    SELECT c_custkey, 'https://s.example.com/' || c_custkey AS url FROM customer WHERE c_custkey IN (SELECT k FROM done)""",
)
def processed_urls(spark, d):
    """URLs already processed under either address."""
    return us.processed_urls(_wanted(spark, d), _done(spark, d)).select("c_custkey", "url")


def _address(c):
    return F.concat(F.lit("https://s.example.com/"), c)


def _wanted(spark, d):
    return table(spark, d, "customer").select("c_custkey", _address(F.col("c_custkey")).alias("url"))


def _done(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.select(_address(F.col("o_custkey")).alias("url"), _address(F.col("o_orderkey")).alias("original_url"))


@query(
    "merge_products",
    """WITH RECURSIVE n AS (
      SELECT o_orderkey AS pos, 'u' || o_custkey AS url, 'u' || (o_custkey + 1) AS ourl FROM orders WHERE o_orderstatus <> 'P'),
    e AS (SELECT o_orderkey AS pos, CASE WHEN o_custkey % 3 = 0 THEN 'u' || o_custkey ELSE 'w' || o_orderkey END AS url, 'v' || o_orderkey AS ourl FROM orders WHERE o_orderstatus = 'P'),
    seen AS (SELECT url FROM e UNION SELECT ourl FROM e),
    free AS (SELECT o.* FROM n o WHERE url NOT IN (SELECT url FROM seen) AND ourl NOT IN (SELECT url FROM seen)),
    -- customers form chains u(k) - u(k+1): the earliest row of a customer is its only candidate
    lead AS (SELECT url, ourl, min(pos) AS pos FROM free GROUP BY url, ourl),
    walk AS (
      SELECT row_number() OVER (ORDER BY pos) AS i, pos, url, ourl FROM lead),
    step AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS pos, FALSE AS ok
      UNION ALL
      SELECT w.i, CASE WHEN list_contains(taken, w.url) OR list_contains(taken, w.ourl) THEN taken ELSE list_concat(taken, [w.url, w.ourl]) END,
        w.pos, NOT (list_contains(taken, w.url) OR list_contains(taken, w.ourl))
      FROM step s JOIN walk w ON w.i = s.i + 1)
    SELECT pos, url, ourl AS original_url, 'existing' AS origin FROM e
    UNION ALL SELECT w.pos, w.url, w.ourl, 'new' FROM walk w JOIN step s ON s.i = w.i WHERE s.ok""",
)
def merge_products(spark, d):
    """Product lists merged, first wins on either key."""
    o = table(spark, d, "orders")
    key = lambda p, c: F.concat(F.lit(p), c)
    new = o.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("pos"), key("u", F.col("o_custkey")).alias("url"), key("u", F.col("o_custkey") + 1).alias("original_url")
    )
    # Existing rows share an address with new ones for a third of the customers; the others stand alone.
    held = F.when(F.col("o_custkey") % 3 == 0, key("u", F.col("o_custkey"))).otherwise(key("w", F.col("o_orderkey")))
    old = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("pos"), held.alias("url"), key("v", F.col("o_orderkey")).alias("original_url"))
    return us.merge_products(old, new)


@query(
    "pick_url_map",
    f"""WITH {CRAWLS}, m AS (SELECT o_custkey AS domain, job_id AS map_id, crawl_at, title = '1-URGENT' AS is_canonical,
      CAST(floor(price) AS BIGINT) % 7 AS link_count,
      title = '1-URGENT' AND crawl_at >= TIMESTAMP '2001-07-31' AS fresh FROM crawls)
    SELECT domain, map_id, is_canonical, link_count FROM m WHERE link_count > 0
    QUALIFY row_number() OVER (PARTITION BY domain ORDER BY fresh DESC, crawl_at DESC, map_id DESC) = 1""",
)
def pick_url_map(spark, d):
    """Fresh canonical map per site, else the newest usable one."""
    c = crawls(spark, d).select(
        F.col("o_custkey").alias("domain"),
        F.col("job_id").alias("map_id"),
        F.unix_micros(F.col("crawl_at").cast("timestamp")).alias("modified_us"),
        (F.col("title") == "1-URGENT").alias("is_canonical"),
        (F.floor("price") % 7).alias("link_count"),
    )
    as_of = F.unix_micros(F.lit("2001-08-07 00:00:00").cast("timestamp"))
    return us.pick_url_map(c, as_of).drop("modified_us")


def proxy_lines(spark, d):
    """Proxy definitions: three sources of one address list, the later ones redefining some."""
    c = table(spark, d, "customer")
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    host = F.concat_ws(".", (n + 40).cast("string"), (k % 200).cast("string"), (k % 100).cast("string"), F.lit("9"))
    one = c.select(F.concat(F.lit("http://user:pass@"), host, F.lit(":8000")).alias("raw"), k.alias("pos"))
    two = c.where(k % 3 == 0).select(F.concat(host, F.lit(":9000")).alias("raw"), k.alias("pos"))
    three = c.where(k % 5 == 0).select(F.concat(F.lit(" https://"), host, F.lit(":9000 ")).alias("raw"), k.alias("pos"))
    return [one, two, three]


PROXY_HOST = "(c_nationkey + 40) || '.' || (c_custkey % 200) || '.' || (c_custkey % 100) || '.9'"
PROXY_TABLE = f"""lines AS (
  SELECT 'http://user:pass@' || {PROXY_HOST} || ':8000' AS raw, 'http://user:pass@' || {PROXY_HOST} || ':8000' AS canonical,
    'http' AS protocol, {PROXY_HOST} AS host, 0 AS source, c_custkey AS pos, c_nationkey + 40 AS octet FROM customer
  UNION ALL SELECT {PROXY_HOST} || ':9000', 'https://' || {PROXY_HOST} || ':9000', 'https', {PROXY_HOST}, 1, c_custkey, c_nationkey + 40
    FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT ' https://' || {PROXY_HOST} || ':9000 ', 'https://' || {PROXY_HOST} || ':9000', 'https', {PROXY_HOST}, 2, c_custkey, c_nationkey + 40
    FROM customer WHERE c_custkey % 5 = 0),
proxies AS (
  SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY source DESC, pos DESC) = 1)"""


@query("merge_proxies", f"WITH {PROXY_TABLE} SELECT canonical, protocol, host, raw, source, pos FROM proxies")
def merge_proxies(spark, d):
    """Proxy sources merged, last definition wins."""
    return us.merge_proxies(proxy_lines(spark, d))


@query("seeded_sample", "SELECT page_id, url FROM pages ORDER BY md5('7:' || url), url LIMIT 50")
def seeded_sample(spark, d):
    """Repeatable random sample of fifty URLs."""
    return us.seeded_sample(page_urls(spark, d), "url", seed=7, n=50)


@query(
    "url_batches",
    """WITH i AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part)
    SELECT p_partkey, index, CAST(index // 64 + 1 AS INTEGER) AS batch, 'batch-' || lpad(CAST(index // 64 + 1 AS VARCHAR), 3, '0') AS label
    FROM i""",
)
def url_batches(spark, d):
    """Numbered URLs cut into labelled batches."""
    p = table(spark, d, "part").select("p_partkey")
    indexed = us.dense_index(p, ["p_partkey"], F.floor(F.col("p_partkey") / 4096))
    return us.assign_batches(indexed, 64)


@query(
    "numbered_page_urls",
    """WITH u AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'https://a.example.com/list/' || l_partkey WHEN 1 THEN 'http://a.example.com/x/' || l_partkey || '/?p=2'
        WHEN 2 THEN 'https://b.example.com/' || l_partkey WHEN 3 THEN 'ftp://a.example.com/' || l_partkey ELSE 'https://a.example.com/list-' || l_partkey END AS url FROM lineitem)
    SELECT l_orderkey, l_linenumber, url FROM u WHERE l_linenumber % 5 IN (0, 1)""",
)
def numbered_page_urls(spark, d):
    """Addresses of one site whose path ends in a number."""
    n, part = F.col("l_linenumber") % 5, F.col("l_partkey").cast("string")
    url = (
        F.when(n == 0, F.concat(F.lit("https://a.example.com/list/"), part))
        .when(n == 1, F.concat(F.lit("http://a.example.com/x/"), part, F.lit("/?p=2")))
        .when(n == 2, F.concat(F.lit("https://b.example.com/"), part)).when(n == 3, F.concat(F.lit("ftp://a.example.com/"), part))
        .otherwise(F.concat(F.lit("https://a.example.com/list-"), part))
    )
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", url.alias("url"))
    return li.where(U.is_numbered_page(F.col("url"), F.lit("a.example.com")))


@query(
    "cached_product_urls",
    f"SELECT page_id, {STRIPPED} AS url FROM pages WHERE regexp_matches({STRIPPED}, '/[0-9]+$')",
)
def cached_product_urls(spark, d):
    """The products-only part of the URL cache."""
    p = page_urls(spark, d).select("page_id", U.strip_url(F.col("url")).alias("url"))
    return us.cache_outputs(p)[1]


@query(
    "upload_check",
    f"""SELECT page_id % 20 AS upload, count(*) AS urls, count(DISTINCT regexp_replace({NETLOC}, '^www\\.', '')) AS hosts,
      count(*) <= 200000 AND count(DISTINCT regexp_replace({NETLOC}, '^www\\.', '')) <= 1 AS accepted FROM pages GROUP BY 1""",
)
def upload_check(spark, d):
    """Upload limits: one site, bounded size."""
    p = page_urls(spark, d).withColumn("upload", F.col("page_id") % 20)
    return us.upload_check(p, "upload")


@query(
    "url_map_violations",
    """WITH l AS (SELECT c_custkey AS domain, c_nationkey AS n, c_acctbal AS b FROM customer)
    SELECT domain, 'url_form' AS rule, CAST(1 AS BIGINT) AS hits FROM l WHERE n = 3
    UNION ALL SELECT domain, 'url_length', 1 FROM l WHERE n = 4
    UNION ALL SELECT domain, 'priority_range', 2 FROM l WHERE b > 9000
    UNION ALL SELECT domain, 'total_links', 1 FROM l WHERE n = 7""",
)
def url_map_violations(spark, d):
    """Broken limits of URL maps."""
    c = table(spark, d, "customer")
    n = F.col("c_nationkey")
    url = F.when(n == 3, F.lit("not-a-url")).when(n == 4, F.concat(F.lit("https://a.example.com/"), F.repeat(F.lit("x"), 2100))).otherwise(
        F.lit("https://a.example.com/1")
    )
    level = F.when(F.col("c_acctbal") > 9000, 101).otherwise(5)

    def entry(u):
        return F.struct(u.alias("url"), F.col("c_name").alias("title"), level.alias("priority"))

    maps = c.select(
        F.col("c_custkey").alias("domain"),
        F.when(n == 7, 200000).otherwise(2).alias("total_links"),
        F.array(entry(url), entry(F.lit("https://a.example.com/2"))).alias("links"),
    )
    return us.url_map_violations(maps)


@query(
    "static_assets",
    """SELECT l_orderkey, l_linenumber, l_linenumber IN (1, 2) AS is_static, l_linenumber <> 5 AS is_page FROM lineitem""",
)
def static_assets(spark, d):
    """Static addresses and content types left out of a crawl."""
    n = F.col("l_linenumber")
    u = (
        F.when(n == 1, F.concat(F.lit("https://a.example.com/img/"), F.col("l_partkey"), F.lit(".JPG?x=1")))
        .when(n == 2, F.concat(F.lit("https://a.example.com/assets/"), F.col("l_partkey")))
        .otherwise(F.concat(F.lit("https://a.example.com/p/"), F.col("l_partkey"), F.lit("?f=a.css")))
    )
    kind = F.when(n == 5, F.lit("image/png")).when(n == 6, F.lit("Application/JSON")).otherwise(F.lit("text/html; charset=utf-8"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", U.is_static_asset(u).alias("is_static"), U.is_page_type(kind).alias("is_page")
    )


@query(
    "redacted_proxies",
    f"""WITH {PROXY_TABLE} SELECT canonical, CASE WHEN protocol = 'http' THEN 'http://user@' ELSE 'https://' END || host
      || CASE WHEN protocol = 'http' THEN ':8000' ELSE ':9000' END AS redacted,
      CASE WHEN octet IN (45) THEN 'RU' WHEN octet IN (52, 63, 64) THEN 'US' WHEN octet IN (51, 62) THEN 'EU' ELSE 'UN' END AS country
    FROM proxies""",
)
def redacted_proxies(spark, d):
    """Proxy addresses without passwords, with the guessed country."""
    p = us.merge_proxies(proxy_lines(spark, d))
    return p.select(
        "canonical", U.redact_address(F.col("canonical")).alias("redacted"), U.country_of_host(F.col("host")).alias("country")
    )
