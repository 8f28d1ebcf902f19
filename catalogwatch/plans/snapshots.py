"""Crawl comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.operators import snapshots as snap
from catalogwatch.operators.catalogue import keep_first
from catalogwatch.plans.bindings import CRAWLS, CUT, crawls, stamp
from catalogwatch.plans.registry import query, table

SIDES = f"""{CRAWLS}, dated AS (
  SELECT url, strftime(crawl_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, price, availability, title, crawl_at, job_id,
         CAST(job_id % 40 AS DOUBLE) AS stock FROM crawls),
p AS (SELECT * FROM dated WHERE crawl_at < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at DESC, job_id DESC) = 1),
c AS (SELECT * FROM dated WHERE crawl_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at DESC, job_id DESC) = 1),
j AS (SELECT coalesce(p.url, c.url) AS url, p.url AS pu, c.url AS cu, p.fetched_at AS pf, c.fetched_at AS cf,
        p.price AS pp, c.price AS cp, p.availability AS pa, c.availability AS ca, p.title AS pt, c.title AS ct,
        p.stock AS ps, c.stock AS cs
      FROM p FULL JOIN c ON p.url = c.url),
k AS (SELECT *, CASE WHEN pu IS NULL THEN 'ADDED' WHEN cu IS NULL THEN 'REMOVED'
        WHEN pp IS DISTINCT FROM cp OR pa IS DISTINCT FROM ca OR pt IS DISTINCT FROM ct THEN 'MODIFIED'
        ELSE 'UNCHANGED' END AS change_type,
        concat_ws(';', CASE WHEN pp IS DISTINCT FROM cp THEN 'price' END, CASE WHEN pa IS DISTINCT FROM ca THEN 'availability' END,
          CASE WHEN pt IS DISTINCT FROM ct THEN 'title' END) AS fields FROM j)"""


def sides(spark, d):
    c = crawls(spark, d).withColumns(
        {"fetched_at": stamp(F.col("crawl_at")), "stock": (F.col("job_id") % 40).cast("double")}
    )
    cut = F.lit(CUT).cast("timestamp_ntz")
    return c.where(F.col("crawl_at") < cut), c.where(F.col("crawl_at") >= cut)


ORDER = ("crawl_at", "job_id")

DIFF_SELECT = """url, pf AS prev_crawl_at, cf AS curr_crawl_at, change_type,
  CASE WHEN change_type IN ('ADDED', 'REMOVED') THEN lower(change_type) ELSE fields END AS fields_changed,
  pp AS price_prev, cp AS price_curr, pa AS availability_prev, ca AS availability_curr, pt AS title_prev, ct AS title_curr"""


@query("snapshot_diff", f"WITH {SIDES} SELECT {DIFF_SELECT} FROM k WHERE change_type <> 'UNCHANGED'")
def snapshot_diff(spark, d):
    """Two crawls compared per URL."""
    prev, curr = sides(spark, d)
    return snap.snapshot_diff(prev, curr, ORDER)


@query(
    "wide_diff",
    f"""WITH {SIDES} SELECT url, change_type, CASE WHEN pu IS NOT NULL AND cu IS NOT NULL THEN fields END AS fields_changed,
      round(cp - pp, 2) AS price_delta, round(cs - ps, 3) AS stock_delta FROM k""",
)
def wide_diff(spark, d):
    """All URLs with price and stock deltas."""
    prev, curr = sides(spark, d)
    return snap.wide_diff(prev, curr, ORDER)


@query(
    "long_diff",
    f"""WITH {SIDES}, f AS (
      SELECT url, change_type, pu, cu, pf, cf, 'price' AS field, CAST(pp AS VARCHAR) AS old_value, CAST(cp AS VARCHAR) AS new_value FROM k
      UNION ALL SELECT url, change_type, pu, cu, pf, cf, 'availability', pa, ca FROM k
      UNION ALL SELECT url, change_type, pu, cu, pf, cf, 'title', pt, ct FROM k)
    SELECT url, change_type, field, old_value, new_value, pf AS timestamp_prev, cf AS timestamp_curr FROM f
    WHERE old_value IS DISTINCT FROM new_value""",
)
def long_diff(spark, d):
    """One row per URL and changed field."""
    prev, curr = sides(spark, d)
    return snap.long_diff(prev, curr, ORDER)


@query(
    "set_field_diff",
    """WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS a,
      list_sort(list_distinct(list(l_linestatus || 'x'))) AS b FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, list_sort(list_distinct([o_orderstatus, o_orderpriority, o_orderstatus]))
      = list_sort(list_distinct([o_orderpriority, CASE WHEN o_totalprice > 200000 THEN 'F' ELSE o_orderstatus END])) AS same
    FROM orders""",
)
def set_field_diff(spark, d):
    """List fields compared as sets."""
    o = table(spark, d, "orders")
    a = F.array("o_orderstatus", "o_orderpriority", "o_orderstatus")
    b = F.array("o_orderpriority", F.when(F.col("o_totalprice") > 200000, "F").otherwise(F.col("o_orderstatus")))
    return o.select("o_orderkey", snap.same_set(a, b).alias("same"))


@query(
    "baseline_jobs",
    """SELECT o_orderkey AS job_id, o_custkey AS domain,
      last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (
        PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline_job
    FROM orders""",
)
def baseline_jobs(spark, d):
    """Last successful job of the same domain before each job."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("domain"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        F.col("o_orderstatus").alias("status"),
    )
    out = snap.baseline_jobs(o, "domain", "us", "job_id", F.col("status") == "F")
    return out.select("job_id", "domain", "baseline_job")


@query(
    "url_history",
    f"""WITH {CRAWLS}, h AS (SELECT url, job_id, price, lag(price) OVER w AS prev_price, lag(job_id) OVER w IS NOT NULL AS has_prev
      FROM crawls WINDOW w AS (PARTITION BY url ORDER BY crawl_at, job_id))
    SELECT url, job_id, price, prev_price, round(price - prev_price, 2) AS price_delta,
      has_prev AND price IS DISTINCT FROM prev_price AS price_changed FROM h""",
)
def url_history(spark, d):
    """Price history per URL across crawls."""
    c = crawls(spark, d).withColumn("us", F.unix_micros(F.col("crawl_at").cast("timestamp")))
    out = snap.url_history(c, "us", "job_id", ("price",))
    return out.select("url", "job_id", "price", "prev_price", "price_delta", "price_changed")


@query(
    "url_set_counts",
    f"""WITH {SIDES} SELECT count(*) FILTER (WHERE pu IS NULL) AS added, count(*) FILTER (WHERE cu IS NULL) AS removed,
      count(*) FILTER (WHERE pu IS NOT NULL AND cu IS NOT NULL) AS common, count(*) AS all_urls FROM j""",
)
def url_set_counts(spark, d):
    """Added, removed and common URLs."""
    prev, curr = sides(spark, d)
    return snap.url_set_counts(prev, curr)


@query(
    "snapshot_upsert",
    f"""WITH {CRAWLS} SELECT url, job_id, price, availability, title FROM crawls
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at DESC, job_id DESC) = 1""",
)
def snapshot_upsert(spark, d):
    """Snapshot table after the newer crawl is upserted into the older one."""
    prev, curr = sides(spark, d)
    out = snap.upsert_snapshots(snap.latest_per_url(prev, ORDER), curr, "url", ORDER)
    return out.select("url", "job_id", "price", "availability", "title")


@query(
    "latest_snapshots",
    f"""WITH {CRAWLS} SELECT url, job_id, price FROM crawls
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at DESC, job_id DESC) = 1""",
)
def latest_snapshots(spark, d):
    """Newest row per URL."""
    return snap.latest_per_url(crawls(spark, d), ORDER).select("url", "job_id", "price")


@query(
    "first_crawls",
    f"""WITH {CRAWLS} SELECT url, job_id, price FROM crawls
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at, job_id) = 1""",
)
def first_crawls(spark, d):
    """First row per URL."""
    return keep_first(crawls(spark, d), "url", ORDER).select("url", "job_id", "price")
