"""Job, page, export and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.operators import jobs as J
from catalogwatch.operators.requests import latency_statistics
from catalogwatch.plans.bindings import REQUESTS, requests
from catalogwatch.plans.registry import query, table
from catalogwatch.sources import writers


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query(
    "code_violations",
    """SELECT o_orderkey AS row_key, 'status' AS rule FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, 'format' FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def code_violations(spark, d):
    """Status, type and format codes outside their lists."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "paused").when(F.col("o_orderstatus") == "F", "failed").otherwise("queued")
    fmt = F.when(F.col("o_orderpriority") == "5-LOW", "pdf").otherwise("csv")
    checks = {"status": (status, J.JOB_STATUSES), "type": (F.lit("full"), J.EXPORT_TYPES), "format": (fmt, J.EXPORT_FORMATS)}
    return J.code_violations(o, "o_orderkey", checks)


@query(
    "job_counters",
    """SELECT l_orderkey AS job_id, count(*) AS total_urls, count(*) FILTER (WHERE l_tax < 0.04 AND l_returnflag <> 'R') AS success_urls,
      count(*) FILTER (WHERE NOT (l_tax < 0.04 AND l_returnflag <> 'R')) AS failed_urls, round(CAST(sum(CAST(l_quantity AS BIGINT) * 10000) AS BIGINT) / 1048576, 2) AS traffic_mb
    FROM lineitem GROUP BY 1""",
)
def job_counters(spark, d):
    """Counters and traffic per job from its pages."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "job_id")
    status = F.when(F.col("l_tax") >= 0.04, 503).otherwise(200)
    error = F.when(F.col("l_returnflag") == "R", "timeout")
    return J.job_counters(li, "job_id", status, error, F.col("l_quantity").cast("bigint") * 10000)


@query(
    "failed_pages",
    "SELECT l_orderkey AS job_id, l_linenumber FROM lineitem WHERE l_tax >= 0.04 OR l_returnflag = 'R'",
)
def failed_pages(spark, d):
    """Pages that failed or are missing."""
    status = F.when(F.col("l_tax") >= 0.04, 404)
    li = table(spark, d, "lineitem").where(J.is_failed_page(status, F.when(F.col("l_returnflag") == "R", "blocked")))
    return li.select(F.col("l_orderkey").alias("job_id"), "l_linenumber")


@query(
    "job_results",
    """SELECT l_orderkey AS job_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS products_found,
      CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag <> 'R'), 0) AS BIGINT) AS variations_found,
      count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linestatus || CAST(l_tax * 100 AS INTEGER) END) AS distinct_failures,
      max(l_discount) AS response_time, count(*) FILTER (WHERE l_returnflag <> 'R') > 0 AS success FROM lineitem GROUP BY 1""",
)
def job_results(spark, d):
    """Products, variations and failures per job."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "job_id")
    failure = F.when(F.col("l_returnflag") == "R", F.concat(F.col("l_linestatus"), F.round(F.col("l_tax") * 100).cast("int").cast("string")))
    return J.job_results(li, "job_id", F.col("l_quantity").cast("bigint"), failure, F.col("l_discount"))


@query(
    "bulk_runs",
    """WITH s AS (SELECT l_orderkey AS run, CAST(floor(l_extendedprice) AS BIGINT) AS processed, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 1000 END AS total,
      l_linenumber * 10 AS percent, CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS BIGINT) END AS eta, l_linestatus = 'O' OR l_returnflag <> 'N' AS done, l_returnflag = 'R' AS bad FROM lineitem)
    SELECT run, count(*) AS sites, CAST(coalesce(sum(CASE WHEN total > 0 THEN least(processed, total) END), 0) AS BIGINT) AS processed_urls, CAST(coalesce(sum(total), 0) AS BIGINT) AS total_urls,
      CAST(floor(sum(CASE WHEN total > 0 THEN least(processed, total) ELSE percent END) / sum(CASE WHEN total > 0 THEN total ELSE 100 END) * 100 + 0.5) AS BIGINT) AS progress_percent,
      CAST(floor(sum(eta) / count(eta) + 0.5) AS BIGINT) AS eta_seconds, CASE WHEN NOT bool_and(done) THEN 'running' WHEN bool_or(bad) THEN 'failed' ELSE 'completed' END AS status
    FROM s GROUP BY run""",
)
def bulk_runs(spark, d):
    """Roll-up of site runs."""
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    status = F.when(F.col("l_returnflag") == "R", "failed").when((F.col("l_linestatus") == "O") | (F.col("l_returnflag") != "N"), "completed").otherwise("running")
    s = li.select(
        F.col("l_orderkey").alias("run"),
        F.floor("l_extendedprice").alias("processed"),
        F.when(F.col("l_linenumber") % 3 != 0, q * 1000).alias("total"),
        F.lit(None).cast("bigint").alias("expected_total"),
        (F.col("l_linenumber") * 10).cast("bigint").alias("percent"),
        F.when(F.col("l_tax") > 0.02, q).alias("eta_seconds"),
        status.alias("status"),
    )
    return J.bulk_runs(s, "run")


@query(
    "task_statistics",
    """SELECT count(*) AS total_tasks, count(*) FILTER (WHERE o_orderstatus = 'O') AS active_tasks, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed_tasks,
      count(*) FILTER (WHERE o_orderkey % 4 > 0) AS tasks_with_retries, CAST(sum(o_orderkey % 4) AS DOUBLE) / count(*) AS avg_retry_count,
      epoch_us(min(o_orderdate) FILTER (WHERE o_orderstatus = 'O')) AS next_scheduled_run FROM orders""",
)
def task_statistics(spark, d):
    """Task totals and next planned run."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "failed").otherwise("paused")
    return J.task_statistics(o, status, F.col("o_orderkey") % 4, us("o_orderdate"))


@query(
    "list_jobs",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 2 = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100",
)
def list_jobs(spark, d):
    """Third page of the job list."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_custkey")
    return J.list_jobs(o, "o_orderdate", "o_orderkey", F.col("o_custkey") % 2 == 1, 50, 100).select("o_orderkey", "o_orderstatus")


@query(
    "kept_jobs",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 1500 DAY
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10""",
)
def kept_jobs(spark, d):
    """Jobs kept by age and by number per domain."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    recent = J.within_age(o, "o_orderdate", F.lit("2001-08-01").cast("timestamp_ntz"), 1500)
    return J.newest_per_domain(recent, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query(
    "pages_with_job",
    "SELECT l_orderkey AS job_id, l_linenumber, o_orderstatus, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def pages_with_job(spark, d):
    """Pages with status and domain of their job."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "job_id")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    return J.with_job(li, o, "job_id", ["o_orderstatus", "o_custkey"])


@query(
    "ordered_pages",
    """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS INTEGER) AS place FROM lineitem""",
)
def ordered_pages(spark, d):
    """Pages of every job in order of their fetch time."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    month = F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))
    out = J.numbered_pages(li, "l_orderkey", "l_shipdate", "l_linenumber", cell=month)
    return out.select("l_orderkey", "l_linenumber", F.col("place").cast("int").alias("place"))


@query(
    "ordered_products",
    """SELECT o_custkey, 'https://s.example.com/' || o_orderkey AS url,
      CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY 'https://s.example.com/' || o_orderkey) AS INTEGER) AS place FROM orders""",
)
def ordered_products(spark, d):
    """Products of every site in order of their address."""
    o = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("https://s.example.com/"), "o_orderkey").alias("url"))
    out = J.numbered_pages(o, "o_custkey", "url", cell=F.substring("url", 1, 27))
    return out.withColumn("place", F.col("place").cast("int"))


@query("audit_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_tail(spark, d):
    """Last fifty audit entries."""
    return J.audit_tail(table(spark, d, "events"), "ts", "event_id").select("event_id", "event_type")


LATENCY_SQL = f"""{REQUESTS}, s AS (SELECT key, list(latency ORDER BY latency) AS v, count(*) AS n, round(sum(latency), 2) / count(*) AS mean FROM requests GROUP BY key),
lat AS (SELECT key, mean, CASE WHEN n > 20 THEN (v[((n + 1) * 19) // 20] * (20 - ((n + 1) * 19) % 20) + v[((n + 1) * 19) // 20 + 1] * (((n + 1) * 19) % 20)) / 20 ELSE 0 END AS p95 FROM s)"""


@query(
    "service_levels",
    f"""WITH {LATENCY_SQL}, w AS (SELECT key, count(*) FILTER (WHERE kind = 'error') OVER f / count(*) OVER f AS share FROM requests
      WINDOW f AS (PARTITION BY key ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)),
    h AS (SELECT key, count(*) FILTER (WHERE kind <> 'click') / count(*) AS direct_share FROM requests GROUP BY key),
    j AS (SELECT key, mean, p95, direct_share, worst FROM lat JOIN h USING (key) JOIN (SELECT key, max(share) AS worst FROM w GROUP BY key) USING (key))
    SELECT key, 'mean_latency' AS rule, mean AS value FROM j WHERE mean > 30 UNION ALL SELECT key, 'p95_latency', p95 FROM j WHERE p95 > 45
    UNION ALL SELECT key, 'direct_share', direct_share FROM j WHERE direct_share < 0.95 UNION ALL SELECT key, 'timeout_share', worst FROM j WHERE worst > 0.05""",
)
def service_levels(spark, d):
    """Broken service levels per key."""
    r = requests(spark, d)
    latency = latency_statistics(r, "key", "latency")
    worst = J.worst_window_share(r, "key", "us", "id", F.col("kind") == "error", 300.0)
    direct = r.groupBy("key").agg((F.count_if(F.col("kind") != "click") / F.count("*")).alias("direct_share"))
    shares = direct.join(worst.withColumnRenamed("worst_share", "worst_timeout_share"), "key")
    return J.service_levels(latency, "key", shares)


@query(
    "export_gap",
    """WITH g AS (SELECT epoch_us(max(o_orderdate) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01')) AS current_us,
      epoch_us(max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01')) AS previous_us FROM orders)
    SELECT *, printf('%.1f h / %.2f d', (current_us - previous_us) / 3.6e9::DOUBLE, (current_us - previous_us) / 8.64e10::DOUBLE) AS elapsed FROM g""",
)
def export_gap(spark, d):
    """Newest time of two exports and the time between them."""
    o = table(spark, d, "orders").select(us("o_orderdate").alias("us"))
    cut = F.unix_micros(F.lit("1998-01-01").cast("timestamp"))
    return J.export_gap(o.where(F.col("us") >= cut), o.where(F.col("us") < cut), "us")


@query(
    "site_states",
    """WITH s AS (SELECT c_custkey, max(o_orderdate) FILTER (WHERE o_orderstatus <> 'P') AS m, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS e
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
    SELECT c_custkey, CASE WHEN m IS NULL THEN 'missing' WHEN m >= TIMESTAMP '2001-08-02' - INTERVAL 200 DAY THEN 'available' ELSE 'outdated' END AS map_status,
      CASE WHEN e IS NULL THEN 'missing_export' WHEN m IS NULL THEN 'missing_map' ELSE 'ready' END AS export_status FROM s""",
)
def site_states(spark, d):
    """Freshness of URL map and export per site."""
    o = table(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.when(F.col("o_orderstatus") != "P", us("o_orderdate"))).alias("map_us"),
        F.max(F.when(F.col("o_orderstatus") == "F", us("o_orderdate"))).alias("export_us"),
    )
    sites = table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left")
    as_of = F.unix_micros(F.lit("2001-08-02").cast("timestamp"))
    state = J.site_states(sites, "map_us", "export_us", as_of, 200)
    return state.select("c_custkey", "map_status", "export_status")


PRESET_SQL = "presets(site, minutes, usual) AS (VALUES " + ", ".join(f"('{k}', {m}, {u})" for k, (m, u) in J.SITE_PRESETS.items()) + ")"
SITE_NAMES = [*J.SITE_PRESETS, "other.example.com"]


@query(
    "duration_estimates",
    f"""WITH {PRESET_SQL}, s AS (SELECT c_custkey, {SITE_NAMES}[c_custkey % 8 + 1] AS site, CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS n FROM customer),
    e AS (SELECT c_custkey, s.site, CASE WHEN n > 0 THEN n ELSE coalesce(usual, 1000) END AS url_count, CASE WHEN n > 0 THEN 'map' ELSE 'preset' END AS source,
      CASE WHEN minutes IS NULL THEN 240.0::DOUBLE ELSE usual / minutes END AS rate FROM s LEFT JOIN presets p ON p.site = s.site)
    SELECT c_custkey, site, url_count, source, CAST(floor(url_count / rate * 60 + 0.5) AS BIGINT) AS duration_seconds FROM e""",
)
def duration_estimates(spark, d):
    """Estimated run time per site."""
    c = table(spark, d, "customer")
    site = F.element_at(F.array(*[F.lit(s) for s in SITE_NAMES]), (F.col("c_custkey") % 8 + 1).cast("int"))
    s = c.select("c_custkey", site.alias("site"), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).alias("urls"))
    out = J.duration_estimate(s, J.presets(spark), "site", "urls")
    return out.select("c_custkey", "site", "url_count", "source", "duration_seconds")


@query(
    "mapped_statuses",
    "SELECT event_id, ['ok', 'ok', 'missing', 'error', 'missing'][event_id % 5 + 1] AS status FROM events",
)
def mapped_statuses(spark, d):
    """Status words as ok, missing or error."""
    words = F.array(*[F.lit(w) for w in (" Ready ", "SUCCESS", "missing_map", "Failed", "strange")])
    e = table(spark, d, "events").select("event_id", F.element_at(words, (F.col("event_id") % 5 + 1).cast("int")).alias("w"))
    return e.select("event_id", J.map_status(F.col("w")).alias("status"))


@query(
    "export_manifest",
    """SELECT 'full' AS name, (SELECT count(*) FROM lineitem) AS rows, '2024-01-01T00:00:00Z' AS generated_at
    UNION ALL SELECT 'seo', (SELECT count(*) FROM part), '2024-01-01T00:00:00Z'""",
)
def export_manifest(spark, d):
    """One manifest row per written table."""
    parts = {"full": table(spark, d, "lineitem"), "seo": table(spark, d, "part")}
    return writers.manifest_rows(parts, F.lit("2024-01-01T00:00:00Z"))


@query(
    "decimal_comma_rows",
    "SELECT p_partkey, p_name, replace(CAST(p_retailprice AS VARCHAR), '.', ',') AS p_retailprice FROM part",
)
def decimal_comma_rows(spark, d):
    """Export rows with a decimal comma, as they go to CSV."""
    return writers.with_decimal_comma(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"))


@query(
    "failure_rows",
    """SELECT 'https://a.example.com/' || l_orderkey || '-' || l_linenumber AS url, 'a.example.com' AS site_domain, 0.0::DOUBLE AS stock, FALSE AS in_stock,
      CASE WHEN l_linestatus = 'O' THEN 'gone' ELSE 'unavailable' END AS error, CAST(404 AS INTEGER) AS status_code FROM lineitem WHERE l_returnflag = 'R'""",
)
def failure_rows(spark, d):
    """Placeholder products for failed pages."""
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("https://a.example.com/"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("url"),
        F.lit("a.example.com").alias("site_domain"),
        F.when(F.col("l_linestatus") == "O", "gone").alias("error"),
        F.lit(404).alias("status_code"),
    )
    out = writers.failure_rows(li, F.lit("2024-01-01"))
    return out.select("url", "site_domain", "stock", "in_stock", "error", "status_code")


@query(
    "event_export",
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, event_type FROM events
    WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20'""",
)
def event_export(spark, d):
    """Events of the last week as time, type and payload."""
    e = table(spark, d, "events")
    return writers.event_export(e, "ts", "event_type", F.lit("2024-01-20").cast("timestamp_ntz"), "7d").select("timestamp", "event_type")


@query(
    "summary_update",
    """SELECT c_nationkey AS domain, count(*) AS products, CASE WHEN c_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS status FROM customer GROUP BY c_nationkey""",
)
def summary_update(spark, d):
    """Summary table after some domains were recomputed."""
    old = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("domain")).agg(F.count("*").alias("products")).withColumn("status", F.lit("old"))
    new = old.where("domain % 3 = 0").withColumn("status", F.lit("new"))
    return writers.replace_domain(old, new)


@query(
    "page_results",
    "SELECT o_orderkey AS job_id, 'https://a.example.com/' || o_orderkey AS url, CAST(0 AS INTEGER) AS bytes_in, CAST(0 AS INTEGER) AS retry_count FROM orders WHERE o_orderstatus <> 'P'",
)
def page_results(spark, d):
    """Page rows ready to append: URL required, counters defaulted."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("https://a.example.com/"), F.col("o_orderkey"))).alias("url"),
    )
    return writers.page_results(o)[0].select("job_id", "url", "bytes_in", "retry_count")
