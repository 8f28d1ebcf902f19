"""Catalogue queries: flat rows, SEO rows, checks, counters, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.functions.values import fields_of
from catalogwatch.operators import catalogue as cat
from catalogwatch.operators import kpi
from catalogwatch.plans.bindings import PRODUCTS, VARIATIONS, offers, products, variations
from catalogwatch.plans.registry import query, table

ROLLED = """rolled AS (
  SELECT pk, count(*) AS v_count, sum(stock) AS v_stock, count(*) FILTER (WHERE in_stock) AS v_hits,
         bool_or(in_stock) AS any_in, arg_min(price, pos) AS first_price
  FROM variations GROUP BY pk)"""

FULL = f"""{PRODUCTS}, {VARIATIONS}, {ROLLED}, full_rows AS (
  SELECT p.url, p.site_domain, p.name AS title, p.brand, p.category, p.sku,
         CASE WHEN p.in_stock THEN 'in_stock' ELSE 'out_of_stock' END AS availability,
         v.variation_id, v.type AS variation_type,
         round(coalesce(v.price, r.first_price, p.price), 2) AS price,
         round(coalesce(v.stock, p.stock), 3) AS stock,
         round(round(coalesce(v.price, r.first_price, p.price), 2) * round(coalesce(v.stock, p.stock), 3), 2) AS stock_value,
         round(v.price, 2) AS variation_price, round(v.stock, 3) AS variation_stock, v.in_stock AS variation_in_stock
  FROM products p LEFT JOIN rolled r USING (pk) LEFT JOIN variations v USING (pk))"""


def full_table(spark, d, keep=()):
    return cat.full_rows_joined(products(spark, d), variations(spark, d), "pk", "pos", keep=keep)


@query(
    "full_rows",
    f"""WITH {FULL} SELECT url, title, brand, category, sku, availability, price, stock, stock_value,
    variation_id, variation_type, variation_price, variation_stock, variation_in_stock FROM full_rows""",
)
def full_rows(spark, d):
    """Products with their variations from two tables as flat rows."""
    return full_table(spark, d).select(
        "url", "title", "brand", "category", "sku", "availability", "price", "stock", "stock_value",
        "variation_id", "variation_type", "variation_price", "variation_stock", "variation_in_stock",
    )


@query(
    "full_rows_nested",
    """WITH o AS (
      SELECT concat(l_orderkey, '-', l_linenumber) AS key, l_partkey, l_extendedprice AS own, l_quantity AS q,
             l_linestatus AS ls, l_returnflag AS rf, l_tax > 0.02 AS priced_first FROM lineitem),
    b AS (
      SELECT *, 'https://shop.example.com/product/' || key AS url, 'part ' || l_partkey AS title,
        'goods>' || ls AS category, CASE WHEN ls = 'O' THEN q END AS own_stock,
        CASE WHEN rf = 'N' THEN own WHEN priced_first THEN own ELSE round(own + 1, 2) END AS base_price,
        CASE WHEN ls = 'O' THEN CASE WHEN q > 0 THEN 'in_stock' ELSE 'out_of_stock' END
             WHEN rf = 'N' THEN NULL WHEN rf = 'A' THEN 'in_stock' ELSE 'out_of_stock' END AS availability
      FROM o),
    v AS (
      SELECT b.*, key || 'a' AS variation_id, 'size' AS variation_type, 'a' AS variation_value,
        CASE WHEN priced_first THEN own END AS variation_price, q AS variation_stock, rf = 'A' AS variation_in_stock
      FROM b WHERE rf <> 'N'
      UNION ALL
      SELECT b.*, key || 'b', 'size', 'b', round(own + 1, 2), CAST(NULL AS DOUBLE), FALSE FROM b WHERE rf <> 'N'
      UNION ALL
      SELECT b.*, NULL, NULL, NULL, NULL, NULL, NULL FROM b WHERE rf = 'N')
    SELECT url, title, category, availability, coalesce(variation_price, base_price) AS price,
      coalesce(variation_stock, own_stock) AS stock,
      round(coalesce(variation_price, base_price) * coalesce(variation_stock, own_stock), 2) AS stock_value,
      variation_id, variation_type, variation_value, variation_price, variation_stock, variation_in_stock FROM v""",
)
def full_rows_nested(spark, d):
    """Nested product records exploded in place: no shuffle at all."""
    return cat.full_rows(offers(spark, d)).select(
        "url", "title", "category", "availability", "price", "stock", "stock_value", "variation_id",
        "variation_type", "variation_value", "variation_price", "variation_stock", "variation_in_stock",
    )


@query(
    "seo_rows",
    """WITH r AS (
      SELECT o_custkey, o_orderkey, 'https://shop.example.com/item/' || o_custkey AS url,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS fetched_at, o_orderpriority AS title,
        'order ' || o_orderkey AS og_title, o_orderstatus AS h1, 'en|https://shop.example.com/en/' || o_custkey AS hreflang,
        o_orderpriority || '|' || o_orderstatus AS images_alt_joined
      FROM orders)
    SELECT url, fetched_at, title, og_title, h1, hreflang, images_alt_joined FROM r
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY o_orderkey) = 1""",
)
def seo_rows(spark, d):
    """SEO rows; the first crawl of a URL wins."""
    o = table(spark, d, "orders")
    link = F.concat(F.lit("https://shop.example.com/en/"), F.col("o_custkey"))
    recs = o.select(
        F.concat(F.lit("https://shop.example.com/item/"), F.col("o_custkey")).alias("url"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("scraped_at"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("seo_h1"),
        F.create_map(F.lit("og:title"), F.concat(F.lit("order "), F.col("o_orderkey"))).alias("open_graph"),
        F.array(F.struct(F.lit("en").alias("lang"), link.alias("href"))).alias("hreflang"),
        F.array("o_orderpriority", "o_orderstatus").alias("images_alt"),
        "o_orderkey",
    )
    out = cat.seo_rows(recs, "o_orderkey")
    return out.select("url", "fetched_at", "title", "og_title", "h1", "hreflang", "images_alt_joined")


KPI_SELECT = """count(*) AS products, count(p.price) AS products_with_price,
  count(p.stock) AS products_with_stock_field, count(*) FILTER (WHERE p.in_stock) AS products_in_stock_true,
  round(coalesce(sum(p.stock), 0), 2) AS products_total_stock,
  count(*) FILTER (WHERE r.v_count > 0) AS products_with_variations,
  CAST(coalesce(sum(r.v_count), 0) AS BIGINT) AS total_variations,
  round(coalesce(sum(r.v_stock), 0), 2) AS variations_total_stock,
  CAST(coalesce(sum(r.v_hits), 0) AS BIGINT) AS variations_in_stock_true"""

KPIS = f"""{PRODUCTS}, {VARIATIONS}, {ROLLED}, kpis AS (
  SELECT p.site_domain, {KPI_SELECT} FROM products p LEFT JOIN rolled r USING (pk) GROUP BY p.site_domain)"""


def kpi_table(spark, d):
    return kpi.catalogue_kpis(kpi.with_rolled(products(spark, d), variations(spark, d), "pk"), "site_domain")


@query("catalogue_kpis", f"WITH {KPIS} SELECT * FROM kpis")
def catalogue_kpis(spark, d):
    """Nine counters per site."""
    return kpi_table(spark, d)


@query(
    "catalogue_kpis_nested",
    """WITH o AS (SELECT l_partkey % 50 AS site, l_quantity AS q, l_linestatus AS ls, l_returnflag AS rf FROM lineitem)
    SELECT site, count(*) AS products, count(*) AS products_with_price,
      count(*) FILTER (WHERE ls = 'O') AS products_with_stock_field, CAST(0 AS BIGINT) AS products_in_stock_true,
      round(coalesce(sum(CASE WHEN ls = 'O' THEN q END), 0), 2) AS products_total_stock,
      count(*) FILTER (WHERE rf <> 'N') AS products_with_variations,
      CAST(2 * count(*) FILTER (WHERE rf <> 'N') AS BIGINT) AS total_variations,
      round(coalesce(sum(CASE WHEN rf <> 'N' THEN q END), 0), 2) AS variations_total_stock,
      count(*) FILTER (WHERE rf = 'A') AS variations_in_stock_true
    FROM o GROUP BY site""",
)
def catalogue_kpis_nested(spark, d):
    """The same counters straight from nested records: one partial aggregate, no join."""
    part = F.substring_index("name", " ", -1).cast("bigint")
    rolled = kpi.with_nested_roll(offers(spark, d)).withColumn("site", part % 50)
    return kpi.catalogue_kpis(rolled, "site")


@query(
    "shop_goods_kpis",
    f"""WITH {PRODUCTS}, {VARIATIONS}, r AS (
      SELECT pk, count(*) AS v_count, sum(stock) AS v_stock, count(*) FILTER (WHERE in_stock) AS v_hits, max(stock) AS v_max
      FROM variations GROUP BY pk)
    SELECT p.site_domain, {KPI_SELECT} FROM products p JOIN part ON p_partkey = p.pk LEFT JOIN r USING (pk)
    WHERE p_retailprice * 10.25 <= 10000 AND coalesce(v_max, 0) <= 10000
      AND NOT regexp_matches(lower(p.name || ' ' || p.category), 'digital|pattern|download|pdf|certificate|gift\\s*card')
    GROUP BY p.site_domain""",
)
def shop_goods_kpis(spark, d):
    """Counters without bulk and digital goods."""
    p = products(spark, d).withColumn("balance", F.col("price") * 10.25)
    return kpi.shop_goods_kpis(kpi.with_rolled(p, variations(spark, d), "pk", lenient=True), "site_domain")


SITES = f"""{KPIS}, sites AS (
  SELECT k.*, CASE WHEN products_total_stock > 500 THEN 100.0 * products_in_stock_true / products END AS success_rate,
    '2024-01-' || lpad(CAST(1 + total_variations % 28 AS VARCHAR), 2, '0') AS updated_at FROM kpis k)"""


def site_summary(spark, d):
    k = kpi_table(spark, d)
    day = F.lpad((1 + F.col("total_variations") % 28).cast("string"), 2, "0")
    rate = F.col("products_in_stock_true") * 100.0 / F.col("products")
    return k.withColumns(
        {
            "success_rate": F.when(F.col("products_total_stock") > 500, rate),
            "updated_at": F.concat(F.lit("2024-01-"), day),
        }
    )


@query(
    "summary_totals",
    f"""WITH {SITES} SELECT count(*) AS total_sites, CAST(sum(products) AS BIGINT) AS total_products,
      CAST(sum(products_with_price) AS BIGINT) AS total_products_with_price,
      round(sum(products_total_stock), 2) AS total_stock, CAST(sum(total_variations) AS BIGINT) AS total_variations,
      CAST(nullif(sum(products_with_variations), 0) AS BIGINT) AS total_products_with_variations,
      round(sum(success_rate), 9)::DOUBLE / count(success_rate) AS average_success_rate, max(updated_at) AS generated_at FROM sites""",
)
def summary_totals(spark, d):
    """Totals over all sites."""
    return kpi.summary_totals(site_summary(spark, d))


@query(
    "weighted_success",
    f"""WITH {SITES} SELECT CAST(sum(products) AS BIGINT) AS total_requests,
      CAST(sum(products_with_price) AS BIGINT) AS successful_requests,
      CASE WHEN coalesce(sum(success_rate * products), 0) <> 0 THEN round(sum(success_rate * products) / sum(products), 2)
        ELSE round(sum(products_with_price) * 100.0::DOUBLE / sum(products), 2) END AS success_rate, max(updated_at) AS updated_at FROM sites""",
)
def weighted_success(spark, d):
    """Success rate weighted by products."""
    return kpi.weighted_success(site_summary(spark, d))


@query(
    "configured_sites",
    f"""WITH {KPIS}, d AS (SELECT DISTINCT 'shop' || l_linenumber * 10 || '.example.com' AS site_domain FROM lineitem)
    SELECT d.site_domain, CASE WHEN k.products IS NULL THEN 'missing' ELSE 'ok' END AS status, """
    + ", ".join(f"coalesce(k.{c}, 0) AS {c}" for c in kpi.KPI_COLUMNS)
    + " FROM d LEFT JOIN kpis k USING (site_domain)",
)
def configured_sites(spark, d):
    """Configured sites next to their counters; sites without an export stay, as zero rows."""
    li = table(spark, d, "lineitem")
    sites = li.select(F.concat(F.lit("shop"), F.col("l_linenumber") * 10, F.lit(".example.com")).alias("site_domain"))
    return kpi.configured_sites(sites, kpi_table(spark, d), "site_domain")


@query(
    "top_sites",
    f"WITH {KPIS} SELECT site_domain, products FROM kpis ORDER BY products DESC, site_domain LIMIT 5",
)
def top_sites(spark, d):
    """Five largest sites."""
    return kpi.top_sites(kpi_table(spark, d), "site_domain").select("site_domain", "products")


@query(
    "sites_with_issues",
    f"""WITH {KPIS}, d AS (SELECT DISTINCT 'shop' || l_linenumber * 10 || '.example.com' AS site_domain FROM lineitem)
    SELECT site_domain, 'missing' AS status FROM d ANTI JOIN kpis USING (site_domain)""",
)
def sites_with_issues(spark, d):
    """Sites whose status is not ok."""
    return kpi.sites_with_issues(configured_sites(spark, d)).select("site_domain", "status")


QUALITY = """SELECT count(*) AS rows, count(DISTINCT url) AS unique_products, count(*) AS variation_rows,
  count(*) FILTER (WHERE p IS NULL) AS price_missing, count(*) FILTER (WHERE coalesce(p, 0) <= 0) AS price_zero,
  count(*) FILTER (WHERE s IS NULL) AS stock_missing, count(*) FILTER (WHERE coalesce(s, 0) <= 0) AS stock_zero FROM"""

QUALITY_PCT = ", ".join(
    f"round(100.0 * {c} / rows, 2) AS {c}_pct" for c in ("price_missing", "price_zero", "stock_missing", "stock_zero")
)


def quality_rows(spark, d, tax):
    li = table(spark, d, "lineitem").where(F.col("l_tax") <= tax)
    return li.select(
        F.col("l_partkey").cast("string").alias("url"),
        F.when(F.col("l_discount") > 0.03, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity") - 25).alias("stock"),
    )


def _quality_sql(tax):
    return f"""(SELECT l_partkey AS url, CASE WHEN l_discount > 0.03 THEN l_extendedprice END AS p,
      CASE WHEN l_returnflag <> 'A' THEN l_quantity - 25 END AS s FROM lineitem WHERE l_tax <= {tax})"""


@query("export_quality", f"WITH q AS ({QUALITY} {_quality_sql(1)}) SELECT q.*, {QUALITY_PCT} FROM q")
def export_quality(spark, d):
    """Quality figures of a flat export."""
    return kpi.export_quality(quality_rows(spark, d, 1.0))


@query(
    "quality_delta",
    f"""WITH c AS (SELECT q.*, {QUALITY_PCT} FROM ({QUALITY} {_quality_sql(1)}) q),
    b AS (SELECT q.*, {QUALITY_PCT} FROM ({QUALITY} {_quality_sql(0.04)}) q),
    cu AS (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM c) ON COLUMNS(*) INTO NAME figure VALUE v),
    bu AS (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM b) ON COLUMNS(*) INTO NAME figure VALUE v)
    SELECT figure, round(cu.v - bu.v, 2) AS delta FROM cu JOIN bu USING (figure)""",
)
def quality_delta(spark, d):
    """Quality of the whole export against the low-tax baseline export."""
    cur, base = (kpi.export_quality(quality_rows(spark, d, t)) for t in (1.0, 0.04))
    return kpi.quality_delta(cur, base)


@query(
    "kpi_sheet",
    f"""WITH {FULL} SELECT count(*) AS items, count(DISTINCT url) AS unique_urls, round(sum(stock), 2) AS total_stock,
    round(sum(stock_value), 2) AS total_stock_value FROM full_rows""",
)
def kpi_sheet(spark, d):
    """Overall items, URLs, stock and stock value."""
    return kpi.kpi_sheet(full_table(spark, d))


@query(
    "top_stock_value",
    f"""WITH {FULL} SELECT url, variation_id, stock_value FROM full_rows WHERE stock_value IS NOT NULL
    ORDER BY stock_value DESC, url, variation_id LIMIT 20""",
)
def top_stock_value(spark, d):
    """Twenty items with the highest stock value."""
    return kpi.top_stock_value(full_table(spark, d)).select("url", "variation_id", "stock_value")


@query(
    "variation_summary",
    f"""WITH {VARIATIONS}, s AS (
      SELECT pk, count(*) AS total_variations, count(*) FILTER (WHERE stock > 0) AS in_stock_count,
        count(*) - count(*) FILTER (WHERE stock > 0) AS out_of_stock_count, floor(round(sum(price), 2) / count(price) * 100 + 0.5) / 100 AS average_price,
        min(price) AS min_price, max(price) AS max_price FROM variations GROUP BY pk),
    t AS (SELECT pk, string_agg(type || '=' || n, ',' ORDER BY type) AS types
      FROM (SELECT pk, type, count(*) AS n FROM variations GROUP BY pk, type) GROUP BY pk)
    SELECT s.*, t.types FROM s JOIN t USING (pk)""",
)
def variation_summary(spark, d):
    """Variation figures per product."""
    out = kpi.variation_summary(variations(spark, d), "pk")
    entries = F.transform(F.map_entries("type_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("types", F.array_join(entries, ",")).drop("type_distribution")


@query(
    "variation_types",
    f"""WITH {VARIATIONS} SELECT pk, type, count(*) AS n, round(sum(price), 2) / count(price) AS avg_price, min(price) AS min_price,
      max(price) AS max_price, sum(stock) AS total_stock, round(sum(stock), 2) / count(stock) AS avg_stock,
      (count(*) * 100.0::DOUBLE) / (sum(count(*)) OVER (PARTITION BY pk))::DOUBLE AS share_pct
    FROM variations GROUP BY pk, type""",
)
def variation_types(spark, d):
    """Share, price and stock per product and variation type."""
    return kpi.variation_types(variations(spark, d), "pk")


@query(
    "product_statistics",
    f"""WITH {PRODUCTS}, {VARIATIONS}, r AS (
      SELECT pk, count(*) AS n, min(price) AS lo, max(price) AS hi, round(sum(price), 2) / count(price) AS mean, sum(stock) AS st, round(sum(stock), 2) / count(stock) AS ms
      FROM variations GROUP BY pk)
    SELECT pk, p.price AS base_price, p.stock AS base_stock, coalesce(n, 0) AS variation_count,
      coalesce(n, 0) > 0 AS has_variations, lo AS min_variation_price, hi AS max_variation_price,
      mean AS avg_variation_price, st AS total_variation_stock, ms AS avg_variation_stock
    FROM products p LEFT JOIN r USING (pk)""",
)
def product_statistics(spark, d):
    """Own figures next to variation figures, products without variations included."""
    out = kpi.product_statistics(products(spark, d), variations(spark, d), "pk")
    return out.select(
        "pk", F.col("price").alias("base_price"), F.col("stock").alias("base_stock"), "variation_count",
        "has_variations", "min_variation_price", "max_variation_price",
        "avg_variation_price", "total_variation_stock", "avg_variation_stock",
    )


@query(
    "excluded_goods",
    """SELECT p_partkey AS pk FROM part WHERE p_retailprice * 10.25 > 10000
      OR regexp_matches(lower(p_name || ' ' || p_type), 'digital|pattern|download|pdf|certificate|gift\\s*card')""",
)
def excluded_goods(spark, d):
    """Bulk and digital goods."""
    p = products(spark, d).withColumn("balance", F.col("price") * 10.25)
    return p.where(cat.is_excluded_item(fields_of(p))).select("pk")


@query(
    "placeholder_shares",
    """SELECT count(*) AS products, round(avg(CASE WHEN starts_with(p_name, 'small') THEN 1 ELSE 0 END), 6) AS sample_name_share,
      round(avg(CASE WHEN starts_with('2024-10-' || p_size, '2024-10-1') THEN 1 ELSE 0 END), 6) AS sample_time_share,
      FALSE AS is_placeholder FROM part""",
)
def placeholder_shares(spark, d):
    """Guard figures against a placeholder data set."""
    p = products(spark, d).withColumn("scraped_at", F.concat(F.lit("2024-10-"), F.col("stock").cast("int")))
    out = cat.placeholder_shares(p, "small", "2024-10-1")
    return out.withColumns({c: F.round(c, 6) for c in ("sample_name_share", "sample_time_share")})


@query(
    "required_columns",
    """WITH r AS (SELECT o_orderkey AS row_key, nullif(trim(CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END), '') AS s,
        CASE WHEN o_totalprice < 100000 THEN NULL ELSE 200 END AS h FROM orders)
    SELECT row_key, 'full.fetched_at' AS rule FROM r WHERE s IS NULL
    UNION ALL SELECT row_key, 'full.http_status' FROM r WHERE h IS NULL""",
)
def required_columns(spark, d):
    """Broken required-column rules of the full table, one row per rule."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey"),
        F.lit("https://a.example.com").alias("url"),
        F.when(F.col("o_totalprice") >= 100000, F.lit(200)).alias("http_status"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("fetched_at"),
    )
    return cat.violations(o, "o_orderkey", cat.required_column_rules(o, "full"))


@query(
    "product_rule_violations",
    """WITH r AS (SELECT c_custkey AS row_key, c_acctbal AS price, c_nationkey AS n FROM customer)
    SELECT row_key, 'base_price_not_negative' AS rule FROM r WHERE price < 0
    UNION ALL SELECT row_key, 'url_scheme' FROM r WHERE n = 3
    UNION ALL SELECT row_key, 'domain_has_dot' FROM r WHERE n = 4
    UNION ALL SELECT row_key, 'in_stock_present' FROM r WHERE n = 5""",
)
def product_rule_violations(spark, d):
    """Broken field rules of product records."""
    n = F.col("c_nationkey")
    c = table(spark, d, "customer").select(
        "c_custkey",
        F.when(n == 3, F.lit("ftp://a.example.com/1")).otherwise(F.lit("https://a.example.com/1")).alias("url"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("base_price"),
        F.when(n != 5, F.lit(True)).alias("in_stock"),
        n.alias("stock_quantity"),
        F.when(n == 4, F.lit("localhost")).otherwise(F.lit("a.example.com")).alias("site_domain"),
    )
    return cat.violations(c, "c_custkey", cat.product_rules(fields_of(c)))
