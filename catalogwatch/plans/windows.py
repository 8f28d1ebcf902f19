"""Queries over per-key timelines: streaks, trailing windows, burn rules, budgets, pacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.functions.values import contains_any
from catalogwatch.operators import health
from catalogwatch.operators.requests import request_statistics
from catalogwatch.plans.bindings import REQUESTS, requests
from catalogwatch.plans.registry import query

W = "WINDOW w AS (PARTITION BY key ORDER BY us, id)"
STREAK_SQL = f"""{REQUESTS}, n AS (SELECT *, row_number() OVER w AS rn FROM requests {W}),
m AS (SELECT *, rn - coalesce(max(CASE WHEN NOT success THEN rn END) OVER w, 0) AS success_streak,
  rn - coalesce(max(CASE WHEN success THEN rn END) OVER w, 0) AS failure_streak,
  count(*) FILTER (WHERE success) OVER w AS good FROM n {W})"""


def ok():
    return F.col("success")


@query(
    "recent_latency",
    f"""WITH {REQUESTS} SELECT id, key,
      round(sum(latency) OVER f, 2) / count(latency) OVER f AS recent_latency FROM requests WHERE success
    WINDOW f AS (PARTITION BY key ORDER BY us, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
)
def recent_latency(spark, d):
    """Mean of the last fifty successful latencies at each success."""
    out = health.recent_latency(requests(spark, d), "key", "us", "id", ok(), "latency")
    return out.select("id", "key", "recent_latency")


@query("outcome_streaks", f"WITH {STREAK_SQL} SELECT id, key, success_streak, failure_streak FROM m")
def outcome_streaks(spark, d):
    """Consecutive successes and failures at each request."""
    out = health.outcome_streaks(requests(spark, d), "key", "us", "id", ok())
    return out.select("id", "key", "success_streak", "failure_streak")


BURN_SQL = f"""{STREAK_SQL}, hit AS (SELECT *, CASE WHEN NOT success AND k = 13 THEN 'error' WHEN failure_streak >= 3 THEN 'consecutive_failures'
    WHEN good::DOUBLE / rn < 0.2 AND rn >= 10 THEN 'low_success_rate' END AS reason FROM m),
burns AS (SELECT key, us AS burned_us, reason, rn AS requests FROM hit WHERE reason IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY us, id) = 1)"""


def _burns(spark, d):
    error = F.when(~ok() & (F.col("k") == 13), "Captcha shown").when(~ok(), "timeout")
    return health.burn_events(requests(spark, d), "key", "us", "id", ok(), error)


@query("burn_events", f"WITH {BURN_SQL} SELECT * FROM burns")
def burn_events(spark, d):
    """When and why each proxy was burned."""
    return _burns(spark, d)


@query(
    "requests_until_burn",
    f"""WITH {BURN_SQL} SELECT r.id, r.key FROM requests r LEFT JOIN burns b USING (key) WHERE b.key IS NULL OR r.us <= b.burned_us""",
)
def requests_until_burn(spark, d):
    """Requests up to the burn of their proxy."""
    return health.drop_after_burn(requests(spark, d), _burns(spark, d), "key", "us").select("id", "key")


HEALTH_SQL = f"""{BURN_SQL}, st AS (SELECT key, count(*) AS total, count(*) FILTER (WHERE success) / count(*) AS rate FROM requests GROUP BY key),
la AS (SELECT key, round(sum(latency), 2) / count(latency) AS lat FROM (
  SELECT * FROM requests WHERE success QUALIFY row_number() OVER (PARTITION BY key ORDER BY us DESC, id DESC) <= 50) GROUP BY key),
health AS (SELECT st.key, total, rate AS success_rate, lat AS recent_latency, b.key IS NOT NULL AS burned,
  CASE WHEN b.key IS NOT NULL THEN 0 ELSE round(rate * 0.5 + least(1.0, 5.0 / greatest(1.0, coalesce(lat, 1.0))) * 0.3 + rate * 0.2, 9) END::DOUBLE AS health_score
  FROM st LEFT JOIN la USING (key) LEFT JOIN burns b USING (key))"""


def health_table(spark, d):
    from catalogwatch.operators.timeline import last_rows

    r = requests(spark, d)
    stats = r.groupBy("key").agg(F.count("*").alias("total"), (F.count_if(ok()) / F.count("*")).alias("success_rate"))
    recent = last_rows(r.where(ok()), "key", ["us", "id"], health.RECENT).groupBy("key").agg(
        (F.round(F.sum("latency"), 2) / F.count("latency")).alias("recent_latency")
    )
    burned = _burns(spark, d).select("key", F.lit(True).alias("burned"))
    j = stats.join(recent, "key", "left").join(burned, "key", "left")
    flag = F.coalesce("burned", F.lit(False))
    score = health.health_score(F.col("success_rate"), F.col("recent_latency"), F.col("total"), flag)
    return j.select("key", "total", "success_rate", "recent_latency", flag.alias("burned"), F.round(score, 9).alias("health_score"))


@query("proxy_health", f"WITH {HEALTH_SQL} SELECT * FROM health")
def proxy_health(spark, d):
    """Health score per proxy, zero when burned."""
    return health_table(spark, d)


@query("healthiest_proxies", f"WITH {HEALTH_SQL} SELECT key, health_score, success_rate FROM health ORDER BY health_score DESC, key LIMIT 5")
def healthiest_proxies(spark, d):
    """Five proxies with the best health score."""
    return health_table(spark, d).orderBy(F.desc("health_score"), "key").limit(5).select("key", "health_score", "success_rate")


@query(
    "rolling_success",
    f"""WITH {REQUESTS} SELECT id, key, count(*) OVER f AS window_requests, count(*) FILTER (WHERE success) OVER f AS window_success,
      count(*) FILTER (WHERE success) OVER f / count(*) OVER f AS window_rate FROM requests
    WINDOW f AS (PARTITION BY key ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)""",
)
def rolling_success(spark, d):
    """Success rate of each key over the trailing two days."""
    out = health.rolling_success(requests(spark, d), "key", "us", "id", ok(), 172800.0)
    return out.select("id", "key", "window_requests", "window_success", "window_rate")


@query(
    "rate_limit_hits",
    f"""WITH {REQUESTS} SELECT id, key, count(*) OVER f AS window_errors, count(*) OVER f >= 3 AS exceeded FROM requests WHERE NOT success
    WINDOW f AS (PARTITION BY key ORDER BY us RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW)""",
)
def rate_limit_hits(spark, d):
    """Errors within a sliding window against a threshold."""
    out = health.rate_limit_hits(requests(spark, d), "key", "us", "id", ~ok(), 259200.0, 3)
    return out.select("id", "key", "window_errors", "exceeded")


@query(
    "hourly_alerts",
    f"""WITH {REQUESTS}, c AS (SELECT id, k % 3 AS g, kind, count(*) FILTER (WHERE kind = 'purchase') OVER f AS captcha_last_hour,
      count(*) FILTER (WHERE kind = 'signup') OVER f AS limited_last_hour FROM requests
      WINDOW f AS (PARTITION BY k % 3 ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))
    SELECT id, g, captcha_last_hour, limited_last_hour, concat_ws(',', CASE WHEN kind = 'purchase' AND captcha_last_hour > 2 THEN 'captcha' END,
      CASE WHEN kind = 'signup' AND limited_last_hour > 1 THEN 'limited' END) AS alerts FROM c""",
)
def hourly_alerts(spark, d):
    """Captcha and rate-limit alerts over the last hour."""
    r = requests(spark, d).withColumn("g", F.col("k") % 3)
    flags = {"captcha": (F.col("kind") == "purchase", 2), "limited": (F.col("kind") == "signup", 1)}
    out = health.hourly_alerts(r, "g", "us", "id", flags)
    return out.select("id", "g", "captcha_last_hour", "limited_last_hour", F.array_join("alerts", ",").alias("alerts"))


BUDGET_SQL = f"""{REQUESTS}, b AS (SELECT id, k % 5 AS scope, strftime(ts, '%Y-%m-%d') AS day, us, k * 1000 AS bytes FROM requests),
u AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY scope, day ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(bytes) OVER (PARTITION BY scope, day ORDER BY us, id) AS upto FROM b)"""


def budget_log(spark, d):
    r = requests(spark, d)
    return r.select(
        "id", (F.col("k") % 5).alias("scope"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), "us",
        (F.col("k") * 1000).cast("bigint").alias("bytes"),
    )


@query(
    "budget_states",
    f"""WITH {BUDGET_SQL}, f AS (SELECT *, max(CASE WHEN before < 2500000 THEN upto END) OVER (PARTITION BY scope, day ORDER BY us, id) AS usage FROM u)
    SELECT id, scope, day, CASE WHEN before >= 2500000 THEN 'exhausted' WHEN upto > 2500000 THEN 'limit_reached'
        WHEN upto / 2000000.0::DOUBLE >= 0.8 THEN 'throttled' ELSE 'allowed' END AS state,
      before < 2500000 AND upto <= 2500000 AS allowed, CAST(usage AS BIGINT) AS usage,
      CASE WHEN before >= 2500000 OR upto > 2500000 THEN 1.0 WHEN upto / 2000000.0::DOUBLE >= 0.8 THEN least(upto / 2000000.0::DOUBLE, 1.0)
        ELSE upto / 2000000.0::DOUBLE END AS usage_ratio FROM f""",
)
def budget_states(spark, d):
    """Daily traffic budget with soft and hard limit."""
    out = health.budget_states(budget_log(spark, d), "scope", "day", "us", "id", F.col("bytes"), 2_000_000, 2_500_000)
    return out.select("id", "scope", "day", "state", "allowed", "usage", "usage_ratio")


@query(
    "budget_snapshot",
    f"""WITH {BUDGET_SQL} SELECT day, CASE WHEN scope IS NULL THEN 'global' ELSE 'site:' || scope END AS scope,
      round(sum(bytes) / 1048576.0::DOUBLE, 2) AS usage_mb, round(coalesce(sum(bytes) FILTER (WHERE id % 2 = 0), 0) / 1048576.0::DOUBLE, 2) AS residential_mb
    FROM b GROUP BY GROUPING SETS ((day, scope), (day))""",
)
def budget_snapshot(spark, d):
    """Traffic per day, site and overall."""
    return health.budget_snapshot(budget_log(spark, d), "day", "scope", F.col("id") % 2 == 0, F.col("bytes"))


@query(
    "pacing",
    f"""WITH {REQUESTS}, p AS (SELECT id, key, (us - lag(us) OVER w) / 1e6 AS gap_seconds, row_number() OVER w - 1 AS n,
      count(*) FILTER (WHERE success) OVER (PARTITION BY key ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good FROM requests {W})
    SELECT id, key, gap_seconds, greatest(5.0, coalesce(36000.0 - gap_seconds, 0.0), 0.0) * CASE WHEN n > 0 AND good / n < 0.5 THEN 1.5
      WHEN n > 0 AND good / n > 0.9 THEN 0.75 ELSE 1.0 END AS delay_seconds FROM p""",
)
def pacing(spark, d):
    """Gap since the previous run and the delay still required."""
    return health.pacing(requests(spark, d), "key", "us", "id", ok(), 5.0, 36000.0).select("id", "key", "gap_seconds", "delay_seconds")


@query(
    "crawl_wait",
    f"""WITH {REQUESTS}, p AS (SELECT id, key, k, (us - lag(us) OVER w) / 1e6 AS gap FROM requests {W})
    SELECT id, key, CASE WHEN gap IS NULL THEN k * 600.0 ELSE greatest(0.0, k * 600.0::DOUBLE - gap) END::DOUBLE AS wait_seconds FROM p""",
)
def crawl_wait(spark, d):
    """Seconds still to wait under the crawl delay."""
    return health.crawl_wait(requests(spark, d), "key", "us", "id", F.col("k") * 600.0).select("id", "key", "wait_seconds")


def _fold(keep):
    return f"""WITH {REQUESTS}, v AS (SELECT key, list(latency ORDER BY us, id) AS l, count(*) AS n FROM requests GROUP BY key)
    SELECT key, n, round(list_reduce(l, lambda a, b: a * {keep} + b * {1 - keep:.1f}), 6) AS {{}} FROM v"""


@query("half_mean_latency", _fold(0.5).format("half_mean"))
def half_mean_latency(spark, d):
    """Latency folded by halves."""
    out = health.half_mean_latency(requests(spark, d), "key", "us", "id", "latency")
    return out.withColumn("half_mean", F.round("half_mean", 6))


@query("moving_latency", _fold(0.9).format("moving_latency"))
def moving_latency(spark, d):
    """Exponential moving latency."""
    out = health.moving_latency(requests(spark, d), "key", "us", "id", "latency")
    return out.withColumn("moving_latency", F.round("moving_latency", 6))


USAGE_SQL = f"""{REQUESTS}, v AS (SELECT key, list(latency ORDER BY us, id) AS l, count(*) AS usage_count, count(*) FILTER (WHERE success) / count(*) AS success_rate,
  CAST(sum(k) AS BIGINT) AS traffic_mb FROM requests GROUP BY key),
used AS (SELECT key, usage_count, success_rate, traffic_mb, round(list_reduce(l, lambda a, b: a * 0.9 + b * 0.1), 6) AS moving_latency,
  round(traffic_mb / 1024.0::DOUBLE * 2.5, 4) AS traffic_cost FROM v)"""


def usage_table(spark, d):
    out = health.usage_state(requests(spark, d), "key", "us", "id", ok(), "latency", F.col("k").cast("bigint"), 2.5)
    return out.withColumn("moving_latency", F.round("moving_latency", 6))


@query("usage_state", f"WITH {USAGE_SQL} SELECT * FROM used")
def usage_state(spark, d):
    """Pool record per proxy."""
    return usage_table(spark, d)


PROGRESS_SQL = f"""{REQUESTS}, e AS (SELECT id, key AS run, us, CAST(k AS BIGINT) AS current, kind = 'error' AS err FROM requests),
a AS (SELECT *, current > coalesce(max(current) OVER (PARTITION BY run ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS advanced FROM e),
q AS (SELECT *, us - coalesce(max(CASE WHEN advanced THEN us END) OVER w, min(us) OVER w) AS quiet, CAST(sum(err::INT) OVER w AS BIGINT) AS errs FROM a
  WINDOW w AS (PARTITION BY run ORDER BY us, id)),
o AS (SELECT *, errs - coalesce(max(CASE WHEN advanced THEN errs - err::INT END) OVER (PARTITION BY run ORDER BY us, id), 0) AS error_run FROM q)"""


def progress_events(spark, d):
    """Progress events: run = key, current = k, message = event type."""
    return requests(spark, d).select("id", F.col("key").alias("run"), "us", F.col("k").cast("bigint").alias("current"), F.col("kind").alias("message"))


@query(
    "progress_watch",
    f"""WITH {PROGRESS_SQL} SELECT id, run, advanced, quiet / 1e6 AS quiet_seconds, error_run, quiet / 1e6 > 86400 AS stalled, error_run >= 4 AS too_many_errors FROM o""",
)
def progress_watch(spark, d):
    """Advance, stall and error-run detection."""
    is_error = contains_any(F.lower("message"), (*health.ERROR_WORDS, "error"))
    out = health.progress_watch(
        progress_events(spark, d), "run", "us", "id", "current", is_error, stall=86400, error_run=4
    )
    return out.select("id", "run", "advanced", "quiet_seconds", "error_run", "stalled", "too_many_errors")


@query(
    "speed_and_eta",
    f"""WITH {REQUESTS}, s AS (SELECT key, min(us) AS s FROM requests GROUP BY key), x AS (
      SELECT id, key AS run, (us - s) / 1e6 AS elapsed, k FROM requests JOIN s USING (key))
    SELECT id, run, CASE WHEN elapsed > 0 AND k > 0 THEN k / elapsed END AS speed,
      CASE WHEN elapsed > 0 AND k > 0 THEN CAST(ceil(greatest(100 - k, 0) / (k / elapsed)) AS BIGINT) END AS eta_seconds FROM x""",
)
def speed_and_eta(spark, d):
    """Speed and seconds left."""
    e = progress_events(spark, d).withColumn("total", F.lit(100))
    return health.speed_and_eta(e, "run", "us", "id", "current", "total").select("id", "run", "speed", "eta_seconds")


@query(
    "alert_rates",
    f"""WITH {REQUESTS}, a AS (SELECT key, count(*) AS total, count(*) FILTER (WHERE success) / count(*) AS r,
      count(*) FILTER (WHERE kind = 'purchase') / count(*) AS c, count(*) FILTER (WHERE kind = 'signup') / count(*) AS b FROM requests GROUP BY key)
    SELECT key, total, concat_ws(',', CASE WHEN total >= 10 AND 1 - r > 0.2 THEN 'high_failure_rate' END, CASE WHEN total >= 5 AND b > 0.2 THEN 'high_block_rate' END,
      CASE WHEN total >= 5 AND c > 0.2 THEN 'high_captcha_rate' END) AS alerts FROM a""",
)
def alert_rates(spark, d):
    """Failure, block and captcha alerts per key over the whole log."""
    s = request_statistics(requests(spark, d), "key", ok(), F.col("kind") == "purchase", F.col("kind") == "signup", F.col("latency"))
    alerts = F.array_compact(
        F.array(
            F.when((F.col("total") >= 10) & (1 - F.col("success_rate") > 0.2), "high_failure_rate"),
            F.when((F.col("total") >= 5) & (F.col("blocked_rate") > 0.2), "high_block_rate"),
            F.when((F.col("total") >= 5) & (F.col("captcha_rate") > 0.2), "high_captcha_rate"),
        )
    )
    return s.select("key", "total", F.array_join(alerts, ",").alias("alerts"))
