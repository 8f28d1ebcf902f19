"""Request-log queries. Roles: user = domain/proxy key, event type = outcome, value = latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.functions.errors import classify_error, retry_plan
from catalogwatch.functions.values import steady_mean
from catalogwatch.operators import requests as req
from catalogwatch.operators import timeline as tl
from catalogwatch.plans.bindings import REQUESTS, requests
from catalogwatch.plans.registry import query

HITS = "count(*) FILTER (WHERE {})"
MEAN = "round(sum(latency), 2) / count(latency)"


def _hits(cond):
    return HITS.format(cond)


STATS = f"""count(*) AS total, {_hits('success')} AS successful, {_hits("kind = 'purchase'")} AS captchas,
  {_hits("kind = 'signup'")} AS blocked, {MEAN} AS mean_latency, count(*) - {_hits('success')} AS failed,
  {_hits('success')} / count(*) AS success_rate, {_hits('NOT success')} / count(*) AS failure_rate,
  {_hits("kind = 'purchase'")} / count(*) AS captcha_rate, {_hits("kind = 'signup'")} / count(*) AS blocked_rate"""


@query("request_statistics", f"WITH {REQUESTS} SELECT key, {STATS} FROM requests GROUP BY key")
def request_statistics(spark, d):
    """Outcome counts, rates and mean latency per key."""
    return req.request_statistics(requests(spark, d), "key", F.col("success"), (F.col("kind") == "purchase"), (F.col("kind") == "signup"), F.col("latency"))


@query(
    "component_rollup",
    f"""WITH {REQUESTS} SELECT kind, CAST(count(*) AS BIGINT) AS total, {_hits('success')} AS successful,
      {_hits('success')} / count(*) AS success_rate FROM requests GROUP BY ROLLUP (kind)""",
)
def component_rollup(spark, d):
    """Statistics per component with the grand total."""
    per = req.request_statistics(requests(spark, d), "kind", F.col("success"), (F.col("kind") == "purchase"), (F.col("kind") == "signup"), F.col("latency"))
    return req.component_rollup(per, "kind")


@query(
    "latency_statistics",
    f"""WITH {REQUESTS}, s AS (
      SELECT key, list(latency ORDER BY latency) AS v, count(*) AS n, {MEAN} AS mean FROM requests GROUP BY key),
    j AS (SELECT *, least(greatest(((n + 1) * 19) // 20, 1), greatest(n - 1, 1)) AS j95,
      least(greatest(((n + 1) * 99) // 100, 1), greatest(n - 1, 1)) AS j99 FROM s)
    SELECT key, n, mean, (v[(n + 1) // 2] + v[(n + 2) // 2]) / 2 AS median,
      CASE WHEN n > 20 THEN (v[j95] * (20 - ((n + 1) * 19 - j95 * 20)) + v[j95 + 1] * ((n + 1) * 19 - j95 * 20)) / 20 ELSE 0 END AS p95,
      CASE WHEN n > 100 THEN (v[j99] * (100 - ((n + 1) * 99 - j99 * 100)) + v[j99 + 1] * ((n + 1) * 99 - j99 * 100)) / 100 ELSE 0 END AS p99
    FROM j""",
)
def latency_statistics(spark, d):
    """Mean, median and exclusive quantiles per key."""
    return req.latency_statistics(requests(spark, d), "key", "latency")


@query(
    "latency_by_kind",
    f"""WITH {REQUESTS}, s AS (
      SELECT kind, list(latency ORDER BY latency) AS v, count(*) AS n, {MEAN} AS mean FROM requests GROUP BY kind)
    SELECT kind, n, mean, (v[(n + 1) // 2] + v[(n + 2) // 2]) / 2 AS median,
      (v[((n + 1) * 19) // 20] * (20 - ((n + 1) * 19) % 20) + v[((n + 1) * 19) // 20 + 1] * (((n + 1) * 19) % 20)) / 20 AS p95,
      (v[((n + 1) * 99) // 100] * (100 - ((n + 1) * 99) % 100) + v[((n + 1) * 99) // 100 + 1] * (((n + 1) * 99) % 100)) / 100 AS p99
    FROM s""",
)
def latency_by_kind(spark, d):
    """The same over few, large keys."""
    return req.latency_statistics(requests(spark, d), "kind", "latency")


@query(
    "event_analysis",
    f"""WITH {REQUESTS} SELECT kind, count(*) AS n, min(us) AS first_us, max(us) AS last_us,
      count(*) / greatest((max(us) - min(us)) / 3.6e9::DOUBLE, 1.0) AS per_hour FROM requests GROUP BY kind""",
)
def event_analysis(spark, d):
    """Count and hourly frequency per event type."""
    return req.event_analysis(requests(spark, d), "kind", "us")


@query(
    "report_summary",
    f"""WITH {REQUESTS}, a AS (SELECT key, count(*) AS total_events, {_hits("kind = 'purchase'")} AS captcha_events,
      {_hits("kind = 'click'")} AS proxy_events, {_hits("kind = 'signup'")} AS rate_limit_events,
      {_hits('success')} / count(*) AS success_rate, {MEAN} AS mean_latency FROM requests GROUP BY key)
    SELECT *, concat_ws(',', CASE WHEN captcha_events > 5 THEN 'reduce_captchas' END,
      CASE WHEN proxy_events > total_events * 0.2 THEN 'improve_proxies' END, CASE WHEN rate_limit_events > 3 THEN 'slow_down' END) AS advice,
      CASE WHEN captcha_events > 10 THEN 'captcha_threshold_exceeded' END AS alert FROM a""",
)
def report_summary(spark, d):
    """Event counts and advice codes per key."""
    out = req.report_summary(requests(spark, d), "key", (F.col("kind") == "purchase"), F.col("kind") == "click", (F.col("kind") == "signup"), F.col("success"), F.col("latency"))
    return out.withColumn("advice", F.array_join("advice", ","))


@query(
    "session_summary",
    f"""WITH {REQUESTS}, a AS (SELECT key, us // 86400000000 AS day, min(us) AS start_us, (max(us) - min(us)) / 1e6 AS seconds, count(*) AS total,
      {_hits('success')} AS successful, {_hits("kind = 'purchase'")} AS captchas, {_hits("kind = 'signup'")} AS blocked,
      {MEAN} AS mean_latency FROM requests GROUP BY ALL)
    SELECT *, successful / total AS success_rate, CASE WHEN seconds > 0 THEN total / seconds * 60 ELSE 0 END AS per_minute FROM a""",
)
def session_summary(spark, d):
    """Figures per key and day taken as one session."""
    r = requests(spark, d).withColumn("day", F.floor(F.col("us") / 86400000000))
    return req.session_summary(r, ["key", "day"], "us", F.col("success"), (F.col("kind") == "purchase"), (F.col("kind") == "signup"), F.col("latency"))


@query(
    "agent_effectiveness",
    f"""WITH {REQUESTS} SELECT k % 12 AS agent, count(*) AS total, {_hits('success')} AS successful, {MEAN} AS mean_latency,
      {_hits('success')} / count(*) AS success_rate FROM requests GROUP BY ALL""",
)
def agent_effectiveness(spark, d):
    """Success and latency per user agent."""
    return req.agent_effectiveness(requests(spark, d).withColumn("agent", F.col("k") % 12), "agent", F.col("success"), F.col("latency"))


@query(
    "agent_effectiveness_by_domain",
    f"""WITH {REQUESTS} SELECT key, k % 12 AS agent, count(*) AS total, {_hits('success')} AS successful, {MEAN} AS mean_latency,
      {_hits('success')} / count(*) AS success_rate FROM requests GROUP BY ALL""",
)
def agent_effectiveness_by_domain(spark, d):
    """Success and latency per domain and user agent."""
    r = requests(spark, d).withColumn("agent", F.col("k") % 12)
    return req.agent_effectiveness(r, "agent", F.col("success"), F.col("latency"), domain="key")


PUZZLE_SQL = f"""{REQUESTS}, daily AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS attempts, {_hits('k < 60')} AS solves,
  round(sum(latency) FILTER (WHERE k < 60), 2) / count(latency) FILTER (WHERE k < 60) AS mean_seconds,
  round(sum(CASE WHEN k < 60 THEN CASE kind WHEN 'view' THEN 0.003 WHEN 'click' THEN 0.001 ELSE 0.002 END END), 4)::DOUBLE AS daily_cost
  FROM requests GROUP BY 1)"""


def _daily_puzzles(spark, d):
    r = requests(spark, d)
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    return req.puzzle_costs(r, day, F.col("kind"), F.col("k") < 60, F.col("latency"), {"view": 0.003, "click": 0.001}, 0.4)


@query(
    "puzzle_costs",
    f"WITH {PUZZLE_SQL} SELECT *, solves * 100.0::DOUBLE / attempts AS success_rate_pct, daily_cost > 0.4 AS over_limit FROM daily",
)
def puzzle_costs(spark, d):
    """Solve rate and cost of puzzles per day."""
    return _daily_puzzles(spark, d)


@query(
    "puzzle_totals",
    f"""WITH {PUZZLE_SQL} SELECT CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(solves) AS BIGINT) AS solves,
      round(sum(daily_cost), 4) AS total_cost, sum(solves) * 100.0::DOUBLE / sum(attempts) AS success_rate_pct FROM daily""",
)
def puzzle_totals(spark, d):
    """Overall solve rate and cost."""
    return req.puzzle_totals(_daily_puzzles(spark, d))


@query(
    "compliance_statistics",
    f"""WITH {REQUESTS}, a AS (SELECT key, count(*) AS checks, {_hits('success')} AS allowed, {_hits('NOT success')} AS blocked,
      {_hits('latency > 50')} AS delays_applied, {_hits('k < 80')} AS cache_hits FROM requests GROUP BY key)
    SELECT *, allowed * 100.0::DOUBLE / checks AS allowed_pct, blocked * 100.0::DOUBLE / checks AS blocked_pct,
      cache_hits * 100.0::DOUBLE / checks AS cache_hit_pct FROM a""",
)
def compliance_statistics(spark, d):
    """Robots compliance per key."""
    return req.compliance_statistics(requests(spark, d), "key", F.col("success"), F.col("latency") > 50, F.col("k") < 80)


@query(
    "retry_statistics",
    f"""WITH {REQUESTS}, l AS (SELECT key, max(us) FILTER (WHERE success) AS last_ok FROM requests GROUP BY key),
    a AS (SELECT key, {_hits('NOT success')} AS attempt_count, {_hits('success')} AS success_count,
      min(us) FILTER (WHERE NOT success) AS first_failure, max(us) FILTER (WHERE NOT success) AS last_failure,
      max(us) FILTER (WHERE success) AS last_success, round(sum(latency) FILTER (WHERE NOT success), 2) AS total_delay,
      {_hits('NOT success AND (last_ok IS NULL OR us > last_ok)')} AS consecutive_failures
      FROM requests JOIN l USING (key) GROUP BY key)
    SELECT *, CASE WHEN success_count + consecutive_failures = 0 THEN 1.0 ELSE success_count / (success_count + consecutive_failures) END AS success_rate,
      coalesce(total_delay, 0) / greatest(attempt_count, 1) AS mean_delay FROM a""",
)
def retry_statistics(spark, d):
    """Retry state per key at the end of the log."""
    return req.retry_statistics(requests(spark, d), "key", F.col("success"), "us", "id", F.col("latency"))


@query(
    "method_performance",
    f"""WITH {REQUESTS}, m AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'light' ELSE 'browser' END AS method FROM requests),
    r AS (SELECT *, row_number() OVER (PARTITION BY key, method ORDER BY us DESC, id DESC) AS rn FROM m)
    SELECT key, method, count(*) AS total, {_hits('success')} / count(*) AS success_rate,
      round(sum(latency) FILTER (WHERE rn <= 50), 2) / count(*) FILTER (WHERE rn <= 50) AS recent_latency
    FROM r GROUP BY ALL""",
)
def method_performance(spark, d):
    """Success rate, and mean of the last 50 latencies, per domain and fetch method."""
    r = requests(spark, d).withColumn("method", F.when(F.col("k") % 2 == 0, "light").otherwise("browser"))
    rates = r.groupBy("key", "method").agg(
        F.count("*").alias("total"), (F.count_if(F.col("success")) / F.count("*")).alias("success_rate")
    )
    last = tl.last_rows(r, ["key", "method"], ["us", "id"], 50)
    recent = last.groupBy("key", "method").agg((F.round(F.sum("latency"), 2) / F.count("*")).alias("recent_latency"))
    return rates.join(recent, ["key", "method"])


DOMAIN_SQL = f"""{REQUESTS}, dom AS (SELECT key, {_hits("success AND kind <> 'view'")} AS success, {_hits('NOT success')} AS failures,
  {_hits("kind = 'view'")} AS skipped FROM requests GROUP BY key),
doms AS (SELECT *, CASE WHEN success + failures = 0 THEN 1.0 ELSE success / (success + failures) END AS success_rate FROM dom)"""


@query("domain_statistics", f"WITH {DOMAIN_SQL} SELECT * FROM doms")
def domain_statistics(spark, d):
    """Outcomes and skips per domain."""
    return req.domain_statistics(requests(spark, d), "key", F.col("success"), F.col("kind") == "view")


@query(
    "domain_totals",
    f"""WITH {DOMAIN_SQL} SELECT count(*) AS tracked_domains, CAST(sum(skipped) AS BIGINT) AS skipped,
      round(sum(success_rate), 9)::DOUBLE / count(success_rate) AS average_success_rate FROM doms""",
)
def domain_totals(spark, d):
    """Mean of domain success rates."""
    return req.domain_totals(domain_statistics(spark, d))


@query(
    "batch_performance",
    f"""WITH {REQUESTS}, a AS (SELECT id // 500 AS batch, count(*) AS urls, {_hits('success')} AS successes, {_hits('NOT success')} AS errors,
      (max(us) - min(us)) / 1e6 AS seconds FROM requests GROUP BY 1)
    SELECT *, successes / urls AS success_rate, CASE WHEN seconds > 0 THEN urls / seconds ELSE 0 END AS urls_per_second FROM a""",
)
def batch_performance(spark, d):
    """Success rate and speed per batch."""
    r = requests(spark, d).withColumn("batch", F.floor(F.col("id") / 500))
    return req.batch_performance(r, "batch", F.col("success"), "us")


@query(
    "recent_batch_success",
    f"""WITH {REQUESTS}, a AS (SELECT key, id // 500 AS batch, {_hits('success')} / count(*) AS rate FROM requests GROUP BY ALL)
    SELECT key, round(sum(rate), 9) / count(rate) AS recent_rate, round(sum(rate), 9) / count(rate) < 0.8 AS shrink FROM (
      SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY batch DESC) <= 5) GROUP BY key""",
)
def recent_batch_success(spark, d):
    """Mean success of the last five batches per key, and whether batches should shrink."""
    r = requests(spark, d).withColumn("batch", F.floor(F.col("id") / 500))
    per = r.groupBy("key", "batch").agg((F.count_if(F.col("success")) / F.count("*")).alias("rate"))
    last = tl.last_rows(per, "key", ["batch"], 5)
    rate = steady_mean(F.col("rate"), 9)
    return last.groupBy("key").agg(rate.alias("recent_rate"), (rate < 0.8).alias("shrink"))


@query(
    "recent_errors",
    f"""WITH {REQUESTS} SELECT kind, id, us FROM requests WHERE kind <> 'view'
    QUALIFY row_number() OVER (PARTITION BY kind ORDER BY us DESC, id DESC) <= 10""",
)
def recent_errors(spark, d):
    """Last ten events of each error type."""
    r = requests(spark, d).where("kind <> 'view'")
    return tl.last_rows(r, "kind", ["us", "id"], 10).select("kind", "id", "us")


@query(
    "error_counts",
    f"""WITH {REQUESTS}, e AS (SELECT CASE kind WHEN 'error' THEN 'NetworkError' WHEN 'click' THEN 'ParsingError' ELSE 'Other' END AS error_type
      FROM requests)
    SELECT error_type, count(*) AS n, error_type <> 'Other' AND count(*) >= CASE error_type WHEN 'NetworkError' THEN 10 ELSE 5 END AS alert
    FROM e GROUP BY error_type""",
)
def error_counts(spark, d):
    """Errors per type against their alert thresholds."""
    r = requests(spark, d)
    kind = F.when(F.col("kind") == "error", "NetworkError").when(F.col("kind") == "click", "ParsingError").otherwise("Other")
    return req.error_counts(r, kind)


@query(
    "operation_durations",
    f"""WITH {REQUESTS} SELECT kind, count(*) AS calls, {MEAN} AS mean_seconds, min(latency) AS min_seconds, max(latency) AS max_seconds
    FROM requests GROUP BY kind""",
)
def operation_durations(spark, d):
    """Duration figures per operation."""
    return req.duration_statistics(requests(spark, d), "kind", F.col("latency"))


BOUNDS_SQL = " UNION ALL ".join(f"SELECT '{b}' AS le, {b}::DOUBLE AS bound" for b in req.REQUEST_BOUNDS)


@query(
    "latency_histogram",
    f"""WITH {REQUESTS}, b AS ({BOUNDS_SQL} UNION ALL SELECT '+Inf', 'Infinity'::DOUBLE),
    t AS (SELECT kind, k % 4 AS route, count(*) AS count, round(sum(latency), 2) AS sum FROM requests GROUP BY ALL)
    SELECT t.kind, t.route, b.le, {_hits('r.latency <= b.bound')} AS n, any_value(t.count) AS count, any_value(t.sum) AS sum
    FROM requests r JOIN t ON t.kind = r.kind AND t.route = r.k % 4 CROSS JOIN b GROUP BY t.kind, t.route, b.le""",
)
def latency_histogram(spark, d):
    """Cumulative latency buckets per method and route."""
    return req.histogram(requests(spark, d).withColumn("route", F.col("k") % 4), ["kind", "route"], F.col("latency"))


@query("request_counters", f"WITH {REQUESTS} SELECT k % 4 AS route, kind, success, count(*) AS n FROM requests GROUP BY ALL")
def request_counters(spark, d):
    """Labelled counters."""
    return req.labelled_counters(requests(spark, d).withColumn("route", F.col("k") % 4), ["route", "kind", "success"])


@query(
    "extraction_statistics",
    f"""WITH {REQUESTS} SELECT key, kind AS field, count(*) AS attempts, {_hits('k < 90')} AS successes, {_hits('k < 30')} AS fallbacks,
      {_hits('k < 90')} / count(*) AS success_rate FROM requests GROUP BY ALL""",
)
def extraction_statistics(spark, d):
    """Extraction outcomes per domain and field."""
    r = requests(spark, d).withColumnRenamed("kind", "field")
    return req.extraction_statistics(r, ["key", "field"], F.col("k") < 90, F.col("k") < 30)


@query(
    "combined_scores",
    f"""WITH {REQUESTS}, a AS (SELECT key, {_hits('success')} / count(*) AS s, {MEAN} AS l FROM requests GROUP BY key)
    SELECT key, round(least(1.0, greatest(0.0, s * 0.5 + s * 0.3 + least(1.0, 5.0 / greatest(1.0, l)) * 0.2)), 9) AS score FROM a""",
)
def combined_scores(spark, d):
    """Combined proxy score."""
    s = req.request_statistics(requests(spark, d), "key", F.col("success"), (F.col("kind") == "purchase"), (F.col("kind") == "signup"), F.col("latency"))
    score = req.combined_score(F.col("success_rate"), F.col("success_rate"), F.col("mean_latency"))
    return s.select("key", F.round(score, 9).alias("score"))


@query(
    "method_recommendations",
    f"""WITH {REQUESTS}, m AS (
      SELECT key, {_hits('k % 2 = 0 AND success')} / nullif({_hits('k % 2 = 0')}, 0) AS lr, {_hits('k % 2 = 1 AND success')} / nullif({_hits('k % 2 = 1')}, 0) AS br,
        round(sum(latency) FILTER (WHERE k % 2 = 0), 2) / {_hits('k % 2 = 0')} AS ll, round(sum(latency) FILTER (WHERE k % 2 = 1), 2) / {_hits('k % 2 = 1')} AS bl,
        {_hits('k = 0 AND NOT success')} AS lf, {_hits('k = 1 AND NOT success')} AS bf,
        {_hits("kind = 'click'")} % 2 = 0 AS scripted, {_hits("kind = 'view'")} % 3 = 0 AS complex FROM requests GROUP BY key),
    s AS (SELECT key, lf, bf,
      round(CASE WHEN key % 3 = 1 THEN 0.7 * 0.4 ELSE 0 END + CASE WHEN NOT scripted THEN 0.1 * 0.4 ELSE 0 END + coalesce(lr, 0) * 0.3
        + CASE WHEN ll <> 0 AND bl <> 0 AND bl > ll THEN 0.06 ELSE 0 END, 6)::DOUBLE AS light_score,
      round(CASE WHEN key % 3 = 0 THEN 0.7 * 0.4 ELSE 0 END + CASE WHEN scripted THEN 0.1 ELSE 0 END + CASE WHEN complex THEN 0.06 ELSE 0 END
        + coalesce(br, 0) * 0.3 + CASE WHEN ll <> 0 AND bl <> 0 AND NOT bl > ll THEN 0.06 ELSE 0 END, 6)::DOUBLE AS browser_score FROM m)
    SELECT key, light_score, browser_score, CASE WHEN lf >= 3 THEN 'browser' WHEN bf >= 2 THEN 'light'
      WHEN browser_score > light_score THEN 'browser' ELSE 'light' END AS method FROM s""",
)
def method_recommendations(spark, d):
    """Recommended fetch method per domain."""
    light, key = F.col("k") % 2 == 0, F.col("key")
    per = requests(spark, d).groupBy("key").agg(
        (F.count_if(light & F.col("success")) / F.nullif(F.count_if(light), F.lit(0))).alias("light_rate"),
        (F.count_if(~light & F.col("success")) / F.nullif(F.count_if(~light), F.lit(0))).alias("browser_rate"),
        (F.round(F.sum(F.when(light, F.col("latency"))), 2) / F.nullif(F.count_if(light), F.lit(0))).alias("light_latency"),
        (F.round(F.sum(F.when(~light, F.col("latency"))), 2) / F.nullif(F.count_if(~light), F.lit(0))).alias("browser_latency"),
        F.count_if((F.col("k") == 0) & ~F.col("success")).alias("light_failures"),
        F.count_if((F.col("k") == 1) & ~F.col("success")).alias("browser_failures"),
        (F.count_if(F.col("kind") == "click") % 2 == 0).alias("scripted"),
        (F.count_if(F.col("kind") == "view") % 3 == 0).alias("complex"),
    )
    cms = F.when(key % 3 == 0, "Shopify").when(key % 3 == 1, "bitrix")
    per = per.withColumns({"cms": cms, "cms_confidence": F.when(cms.isNotNull(), 0.7)})
    return req.recommend_method(per).select("key", "light_score", "browser_score", "method")


ERROR_TEXT = """CASE k % 11 WHEN 0 THEN 'Connection TIMED OUT' WHEN 1 THEN 'rate_limit hit' WHEN 2 THEN 'HTTP 429' WHEN 3 THEN 'reCAPTCHA shown'
  WHEN 4 THEN 'Access denied' WHEN 5 THEN 'connection reset' WHEN 6 THEN 'HTTP 503' WHEN 7 THEN 'HTTP 404' WHEN 8 THEN 'bad proxy'
  WHEN 9 THEN 'Unauthorized' ELSE 'odd' END"""


def _error_text():
    texts = ["Connection TIMED OUT", "rate_limit hit", "HTTP 429", "reCAPTCHA shown", "Access denied", "connection reset",
             "HTTP 503", "HTTP 404", "bad proxy", "Unauthorized"]
    out = F.lit("odd")
    for i, t in enumerate(texts):
        out = F.when(F.col("k") % 11 == i, F.lit(t)).otherwise(out)
    return out


@query(
    "error_classes",
    f"""WITH {REQUESTS}, e AS (SELECT id, k % 11 AS c, {ERROR_TEXT} AS text FROM requests)
    SELECT id, text, ['timeout', 'rate_limit', 'rate_limit', 'captcha', 'blocked', 'network', 'http_5xx', 'http_4xx', 'proxy_error',
      'authentication', 'unknown'][c + 1] AS error_class FROM e""",
)
def error_classes(spark, d):
    """Error texts mapped to ten classes."""
    r = requests(spark, d).select("id", _error_text().alias("text"))
    return r.withColumn("error_class", classify_error(F.col("text")))


@query(
    "retry_plans",
    f"""WITH {REQUESTS}, e AS (SELECT id, id % 7 AS attempt, ['timeout', 'rate_limit', 'rate_limit', 'captcha', 'blocked', 'network', 'http_5xx', 'http_4xx',
      'proxy_error', 'authentication', 'unknown'][k % 11 + 1] AS c FROM requests),
    s(c, base, mult, tries) AS (VALUES ('timeout', 2.0, 1.5, 3), ('rate_limit', 10.0, 3.0, 5), ('captcha', 30.0, 5.0, 2), ('blocked', 0.0, 1.0, 1),
      ('network', 1.0, 2.0, 4), ('http_5xx', 5.0, 2.0, 3), ('http_4xx', 0.0, 1.0, 1), ('proxy_error', 3.0, 1.5, 2), ('authentication', 0.0, 1.0, 1),
      ('unknown', 1.0, 2.0, 5))
    SELECT id, attempt, least(base::DOUBLE * pow(mult::DOUBLE, attempt), 300.0) AS delay_seconds,
      CASE WHEN attempt >= tries OR c IN ('blocked', 'authentication') THEN FALSE WHEN c = 'captcha' THEN attempt < 2
        WHEN c = 'rate_limit' THEN attempt < greatest(5, tries) ELSE TRUE END AS retry
    FROM e JOIN s USING (c)""",
)
def retry_plans(spark, d):
    """Delay and retry decision per failed attempt."""
    r = requests(spark, d).select("id", (F.col("id") % 7).alias("attempt"), classify_error(_error_text()).alias("c"))
    delay, retry = retry_plan(F.col("c"), F.col("attempt"))
    return r.select("id", "attempt", delay.alias("delay_seconds"), retry.alias("retry"))
