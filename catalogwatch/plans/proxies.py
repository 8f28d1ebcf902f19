"""Proxy queries: lists and logs parsed from text lines derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.operators import proxies as px
from catalogwatch.operators import urlsets as us
from catalogwatch.plans.bindings import REQUESTS, requests
from catalogwatch.plans.catalogue import SITES, site_summary
from catalogwatch.plans.registry import query, table
from catalogwatch.plans.urlsets import PROXY_TABLE, proxy_lines
from catalogwatch.plans.windows import USAGE_SQL, usage_table
from catalogwatch.operators import kpi
from catalogwatch.sources import readers

# Text log: one line per event, its proxy taken from the customer with the same number.
LOG_HOST = "((key % 25 + 40) || '.' || (key % 200) || '.' || (key % 100) || '.9')"
LOG_SQL = f"""{REQUESTS}, log AS (
  SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'http://user:pass@' || {LOG_HOST} || ':8000' AS proxy,
    kind = 'signup' AND k > 90 AS burned, kind IN ('error', 'purchase') AS failed FROM requests)"""


def _address():
    k = F.col("key")
    return F.concat_ws(".", (k % 25 + 40).cast("string"), (k % 200).cast("string"), (k % 100).cast("string"), F.lit("9"))


def log_lines(spark, d):
    r = requests(spark, d)
    word = (
        F.when((F.col("kind") == "signup") & (F.col("k") > 90), "Marked proxy as BURNED")
        .when(F.col("kind") == "error", "Proxy failure handled")
        .when(F.col("kind") == "purchase", "request Timeout")
        .otherwise("ok")
    )
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    line = F.concat(stamp, F.lit(",000 - info - "), word, F.lit(": http://user:pass@"), _address(), F.lit(":8000"))
    return r.select("id", line.alias("value"))


def parsed_log(spark, d):
    return readers.parse_log_lines(log_lines(spark, d))


@query(
    "text_log_scan",
    f"WITH {LOG_SQL} SELECT ts, proxy, burned, failed, count(*) AS n FROM log GROUP BY ALL",
)
def text_log_scan(spark, d):
    """Plain log lines parsed into proxy events."""
    p = parsed_log(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return p.groupBy("ts", "proxy", "burned", "failed").agg(F.count("*").alias("n"))


@query(
    "json_log_scan",
    f"""WITH {REQUESTS} SELECT 'https://' || {LOG_HOST} AS proxy, kind = 'signup' AS burned, kind = 'error' AS failed, count(*) AS n
    FROM requests WHERE k % 10 <> 0 GROUP BY ALL""",
)
def json_log_scan(spark, d):
    """JSON event lines with field aliases; broken lines drop out."""
    r = requests(spark, d)
    status = F.when(F.col("kind") == "signup", "Burned").when(F.col("kind") == "error", "FAILURE").otherwise("success")
    even = F.col("id") % 2 == 0
    doc = F.to_json(
        F.struct(
            F.when(even, _address()).alias("proxy"),
            F.when(~even, _address()).alias("proxy_url"),
            F.when(even, status).alias("status"),
            F.when(~even, status).alias("event"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        )
    )
    broken = F.expr("substr(doc, 1, length(doc) - 5)")
    lines = r.select("k", doc.alias("doc")).select(F.when(F.col("k") % 10 == 0, broken).otherwise(F.col("doc")).alias("value"))
    return readers.parse_event_lines(lines).groupBy("proxy", "burned", "failed").agg(F.count("*").alias("n"))


@query(
    "proxy_list_lines",
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'socks5://u:p@10.0.0.1:' || c_custkey
      WHEN 1 THEN 'https://u:p@10.0.0.2:' || c_custkey WHEN 2 THEN 'https://10.0.0.3:' || c_custkey END AS raw
    FROM customer WHERE c_custkey % 4 <> 3""",
)
def proxy_list_lines(spark, d):
    """Proxy list lines of three forms; comments and others drop out."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    line = (
        F.when(k % 4 == 0, F.concat(F.lit(" socks5://u:p@10.0.0.1:"), k))
        .when(k % 4 == 1, F.concat(F.lit("10.0.0.2:"), k, F.lit(":u:p")))
        .when(k % 4 == 2, F.concat(F.lit("10.0.0.3:"), k))
        .when(k % 8 == 3, F.concat(F.lit("# 10.0.0.4:"), k))
        .otherwise(F.lit("a:b:c"))
    )
    return readers.parse_proxy_lines(c.select(k.alias("id"), line.alias("value"))).select("id", "raw")


@query(
    "error_line_counts",
    f"""WITH {REQUESTS} SELECT key, count(*) FILTER (WHERE k = 1) AS http_500, count(*) FILTER (WHERE k = 2) AS api_errors,
      count(*) FILTER (WHERE k = 3) AS tracebacks FROM requests GROUP BY key""",
)
def error_line_counts(spark, d):
    """Error patterns counted over log lines."""
    k = F.col("k")
    line = (
        F.when(k == 1, 'GET / HTTP/1.1" 500').when(k == 2, "the API gave an Error").when(k == 3, "Traceback (most recent call last)")
        .otherwise("rapid error; status=5000")
    )
    return readers.scan_error_lines(requests(spark, d).select("key", line.alias("value")), by=["key"])


CATALOGUE_SQL = f"""{LOG_SQL}, {PROXY_TABLE}, fails AS (
  SELECT proxy, count(*) FILTER (WHERE failed) AS failures, bool_or(burned) AS burned FROM log GROUP BY proxy)"""


def catalogue(spark, d):
    return us.merge_proxies(proxy_lines(spark, d))


@query("proxy_failures", f"WITH {CATALOGUE_SQL} SELECT p.canonical, coalesce(failures, 0) AS failures, coalesce(burned, FALSE) AS burned FROM proxies p LEFT JOIN fails ON proxy = canonical")
def proxy_failures(spark, d):
    """Catalogue with failure counts from the log."""
    j = px.with_failures(catalogue(spark, d), px.failure_summary(parsed_log(spark, d)))
    return j.select("canonical", "failures", "burned")


COUNTS_SQL = f"""{CATALOGUE_SQL}, counts AS (
  SELECT t AS total_proxies, f AS failed_proxies, b AS burned_proxies, greatest(t - b, 0) AS healthy_proxies, greatest(t - f, 0) AS active_proxies
  FROM (SELECT count(*) AS t FROM proxies), (SELECT count(*) FILTER (WHERE failures > 0) AS f, count(*) FILTER (WHERE burned) AS b FROM fails))"""


@query("proxy_counts", f"WITH {COUNTS_SQL} SELECT * FROM counts")
def proxy_counts(spark, d):
    """Total, healthy, active, failed and burned proxies."""
    return px.proxy_counts(catalogue(spark, d), px.failure_summary(parsed_log(spark, d)))


@query("proxy_protocols", f"WITH {PROXY_TABLE} SELECT protocol, count(*) AS n FROM proxies GROUP BY protocol")
def proxy_protocols(spark, d):
    """Proxies per protocol."""
    return px.protocol_counts(catalogue(spark, d))


@query(
    "proxy_countries",
    f"""WITH {PROXY_TABLE} SELECT CASE WHEN octet IN (45) THEN 'RU' WHEN octet IN (52, 63, 64) THEN 'US' WHEN octet IN (51, 62) THEN 'EU' ELSE 'UN' END AS country,
      count(*) AS n FROM proxies GROUP BY 1""",
)
def proxy_countries(spark, d):
    """Proxies per guessed country."""
    return px.country_counts(catalogue(spark, d))


@query(
    "proxy_capacity",
    f"""WITH {COUNTS_SQL}, {SITES}, u AS (SELECT CAST(sum(products) AS BIGINT) * 700 AS total_requests,
      CAST(sum(products_with_price) AS BIGINT) AS successful_requests, CASE WHEN coalesce(sum(success_rate * products), 0) <> 0 THEN round(sum(success_rate * products) / sum(products), 2) ELSE round(sum(products_with_price) * 100.0::DOUBLE / sum(products), 2) END AS success_rate FROM sites),
    o AS (SELECT *, greatest(healthy_proxies, CAST(ceil(total_requests / 250) AS BIGINT)) AS optimal_proxies FROM counts, u),
    x AS (SELECT *, greatest(optimal_proxies - healthy_proxies, 0) AS deficit FROM o)
    SELECT total_proxies, healthy_proxies, optimal_proxies, deficit,
      CASE WHEN healthy_proxies / optimal_proxies >= 0.85 THEN 'sufficient' WHEN healthy_proxies / optimal_proxies >= 0.6 THEN 'warning' ELSE 'critical' END AS status,
      round(deficit * 0.65::DOUBLE, 2) AS estimated_cost, round(greatest(2200.0::DOUBLE - (650.0::DOUBLE + deficit * 0.65::DOUBLE), 0), 2) AS budget_remaining,
      concat_ws(',', CASE WHEN success_rate <> 0 AND success_rate < 90 THEN 'low_success_rate' END,
        CASE WHEN healthy_proxies < total_proxies * 0.6 THEN 'few_healthy_proxies' END, CASE WHEN deficit > 0 THEN 'proxy_deficit' END) AS warnings FROM x""",
)
def proxy_capacity(spark, d):
    """Capacity need, shortage, cost and warnings."""
    usage = kpi.weighted_success(site_summary(spark, d)).withColumn("total_requests", F.col("total_requests") * 700)
    out = px.capacity(proxy_counts(spark, d), usage)
    return out.select(
        "total_proxies", "healthy_proxies", "optimal_proxies", "deficit", "status", "estimated_cost", "budget_remaining",
        F.array_join("warnings", ",").alias("warnings"),
    )


@query(
    "top_proxies",
    f"""WITH {CATALOGUE_SQL}, j AS (SELECT canonical, octet, coalesce(failures, 0) AS f FROM proxies LEFT JOIN fails ON proxy = canonical),
    b AS (SELECT greatest((SELECT count(*) FROM requests WHERE success) / greatest((SELECT count(*) FROM proxies), 1), 1.0) AS base),
    g AS (SELECT *, greatest(base - f, 0.0) AS good FROM j, b)
    SELECT canonical, floor(least(good / (good + f) * 100, 100.0) * 10 + 0.5) / 10 AS success_rate, 350 + f * 120 AS latency_ms,
      CASE WHEN octet IN (45) THEN 'RU' WHEN octet IN (52, 63, 64) THEN 'US' WHEN octet IN (51, 62) THEN 'EU' ELSE 'UN' END AS country
    FROM g ORDER BY success_rate DESC, canonical LIMIT 5""",
)
def top_proxies(spark, d):
    """Five proxies with the best success rate."""
    good = requests(spark, d).agg(F.count_if("success").alias("successful_requests"))
    j = px.with_failures(catalogue(spark, d), px.failure_summary(parsed_log(spark, d)))
    return px.top_proxies(j, good)


POOL_SQL = f"""{USAGE_SQL}, pool AS (SELECT key AS proxy, key % 7 <> 0 AS is_active, key % 11 = 0 AS is_expired, CASE WHEN key % 2 = 0 THEN 'ru' ELSE 'US' END AS country,
  CASE WHEN key % 3 = 0 THEN 'HTTP' ELSE 'socks5' END AS protocol, usage_count, success_rate, moving_latency / 20 AS latency, traffic_mb / 1024.0::DOUBLE AS traffic_gb,
  CASE WHEN key % 5 <> 0 THEN 2.5::DOUBLE END AS cost_per_gb FROM used)"""


def pool(spark, d):
    u = usage_table(spark, d)
    k = F.col("key")
    return u.select(
        k.alias("proxy"), (k % 7 != 0).alias("is_active"), (k % 11 == 0).alias("is_expired"),
        F.when(k % 2 == 0, "ru").otherwise("US").alias("country"), F.when(k % 3 == 0, "HTTP").otherwise("socks5").alias("protocol"),
        "usage_count", "success_rate", (F.col("moving_latency") / 20).alias("latency"), (F.col("traffic_mb") / 1024.0).alias("traffic_gb"),
        F.when(k % 5 != 0, F.lit(2.5)).alias("cost_per_gb"),
    )


@query(
    "pool_usage",
    f"""WITH {POOL_SQL} SELECT count(*) AS total_proxies, count(*) FILTER (WHERE is_active AND NOT is_expired) AS active_proxies,
      count(*) FILTER (WHERE is_expired) AS expired_proxies, CAST(sum(usage_count) AS BIGINT) AS total_usage, round(sum(latency) FILTER (WHERE latency > 0), 6) / count(*) FILTER (WHERE latency > 0) AS avg_latency,
      round(sum(success_rate), 9) / count(success_rate) AS avg_success_rate, round(sum(traffic_gb), 4) AS total_traffic_gb, round(sum(coalesce(traffic_gb * cost_per_gb, 0)), 4) AS traffic_cost,
      200.0::DOUBLE AS budget_remaining, concat_ws(',', 'cost_near_budget', CASE WHEN count(*) FILTER (WHERE is_active AND NOT is_expired) < 500 THEN 'too_few_active' END,
        CASE WHEN avg(success_rate) < 0.8 THEN 'low_success_rate' END) AS warnings FROM pool""",
)
def pool_usage(spark, d):
    """Pool figures with warnings."""
    out = px.pool_usage(pool(spark, d), monthly_cost=1000.0, max_cost=1200.0, min_count=500)
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query(
    "best_proxies",
    f"""WITH {POOL_SQL} SELECT proxy, round(success_rate * 0.5 + greatest(0.0, 1.0 - latency / 10.0) * 0.3 + greatest(0.0, 1.0 - usage_count / 1000.0) * 0.2, 9)::DOUBLE AS score
    FROM pool WHERE is_active AND NOT is_expired AND upper(country) = 'RU' ORDER BY score DESC, proxy LIMIT 5""",
)
def best_proxies(spark, d):
    """Five best active proxies of a country."""
    return px.best_proxies(pool(spark, d), 5, country="ru").select("proxy", "score")


@query(
    "required_proxies",
    f"""WITH {POOL_SQL}, m AS (SELECT proxy, country, protocol FROM pool WHERE proxy % 4 <> 0),
    k AS (SELECT DISTINCT key AS proxy FROM requests)
    SELECT proxy FROM k LEFT JOIN m USING (proxy) WHERE (country IS NULL OR lower(country) = 'us') AND (protocol IS NULL OR lower(protocol) = 'http')""",
)
def required_proxies(spark, d):
    """Proxies that meet a country and protocol requirement; unknown ones pass."""
    keys = requests(spark, d).select(F.col("key").alias("proxy")).distinct()
    meta = pool(spark, d).where("proxy % 4 <> 0").select("proxy", "country", "protocol")
    return px.meets_requirement(keys, meta, "proxy", country="US", protocol="http")


@query(
    "purchase_plans",
    """WITH b AS (SELECT c_custkey, c_nationkey - 5 AS deficit, greatest(c_acctbal, 0) / 300 AS left_over, c_custkey % 90 AS mins FROM customer),
    r AS (SELECT *, CASE WHEN deficit > 0 THEN CAST(greatest(0, least(deficit, 10, floor(left_over / 0.65::DOUBLE))) AS BIGINT) ELSE 0 END AS recommended,
      CAST(greatest(0, 60 - mins) AS BIGINT) AS cooldown_minutes FROM b)
    SELECT c_custkey, recommended, cooldown_minutes, recommended > 0 AND cooldown_minutes = 0 AS can_purchase, round(recommended * 0.65::DOUBLE, 2) AS purchase_cost,
      CAST(CASE WHEN c_custkey = 0 THEN 5 ELSE least(greatest(CAST(ceil(c_custkey * 1.5::DOUBLE / 0.85::DOUBLE) AS BIGINT), 5), 100) END AS INTEGER) AS optimal FROM r""",
)
def purchase_plans(spark, d):
    """Purchase advice for shortages and the optimum per concurrency."""
    c = table(spark, d, "customer").select(
        "c_custkey", (F.col("c_nationkey") - 5).alias("deficit"), (F.greatest("c_acctbal", F.lit(0.0)) / 300).alias("left_over")
    )
    out = px.purchase_plan(c, "deficit", F.col("left_over"), F.col("c_custkey") % 90)
    return out.select(
        "c_custkey", "recommended", "cooldown_minutes", "can_purchase", "purchase_cost",
        px.optimal_for_concurrency(F.col("c_custkey")).alias("optimal"),
    )
