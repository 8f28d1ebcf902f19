"""Streaming queries: each drains the landed files and returns what the stream wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.plans.bindings import REQUESTS, stamp
from catalogwatch.plans.registry import query
from catalogwatch.plans.snapshots import ORDER, sides
from catalogwatch.streaming import machines as M
from catalogwatch.streaming import windows as W
from catalogwatch.streaming.runner import drain, read_landed, work_folder

DAY_US = 86_400_000_000


def request_stream(spark, d):
    e = read_landed(spark, f"{d}/events.parquet")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("user_id").alias("key"),
        F.col("event_type").alias("kind"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("event_type") == "signup").alias("blocked"),
        (F.col("event_type") == "purchase").alias("captcha"),
        F.col("value").alias("latency"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query(
    "stream_progress",
    f"""WITH {REQUESTS} SELECT key, max(k) AS processed, count(*) FILTER (WHERE success) AS success_count, count(*) FILTER (WHERE NOT success) AS failed_count,
      max(100) AS total, max(k) * 100.0::DOUBLE / 100 AS percent FROM requests GROUP BY key""",
)
def stream_progress(spark, d):
    """Progress roll-up per run, newest state per run."""
    s = request_stream(spark, d).select("key", F.col("k").alias("current"), "success", F.lit(100).alias("total"), "ts")
    out = drain(W.progress_rollup(s, "key"), "progress", "update")
    newest = out.groupBy("key").agg(F.max_by(F.struct("processed", "success_count", "failed_count", "total", "percent"), F.struct("last_event_at", "success_count", "failed_count")).alias("_n"))
    return newest.select("key", "_n.*")


CLOSED = "(SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE"


@query(
    "stream_tumbling_counts",
    f"""WITH {REQUESTS} SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, kind, count(*) AS n, round(sum(latency), 2) AS latency_sum
    FROM requests GROUP BY time_bucket(INTERVAL 1 HOUR, ts), kind HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {CLOSED}""",
)
def stream_tumbling_counts(spark, d):
    """Hourly event counts per type."""
    out = drain(W.tumbling_counts(request_stream(spark, d), "ts", "kind", "1 hour", "10 minutes"), "tumbling")
    return out.select(stamp(F.col("start")).alias("start"), "kind", "n", "latency_sum")


@query(
    "stream_rate_alerts",
    f"""WITH {REQUESTS}, x AS (SELECT *, key % 5 AS g, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM requests),
    a AS (SELECT start, g, count(*) AS n, count(*) FILTER (WHERE NOT success) AS f, count(*) FILTER (WHERE kind = 'signup') AS b, count(*) FILTER (WHERE kind = 'purchase') AS c, max(latency) AS s
      FROM x GROUP BY ALL HAVING start + INTERVAL 12 HOUR <= {CLOSED}),
    y AS (SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, g, n, concat_ws(',', CASE WHEN n >= 10 AND f / n > 0.25 THEN 'high_failure_rate' END, CASE WHEN n >= 5 AND b / n > 0.25 THEN 'high_block_rate' END,
      CASE WHEN n >= 5 AND c / n > 0.25 THEN 'high_captcha_rate' END, CASE WHEN s > 300 THEN 'slow_response' END) AS alerts FROM a)
    SELECT * FROM y WHERE alerts <> ''""",
)
def stream_rate_alerts(spark, d):
    """Rate alerts over sliding windows."""
    s = request_stream(spark, d).withColumn("g", F.col("key") % 5)
    out = drain(W.rate_alerts(s, "ts", "g", "12 hours", "6 hours", "10 minutes", 0.25, 0.25, 0.25, 300.0), "alerts")
    return out.select(stamp(F.col("start")).alias("start"), "g", "n", "alerts")


@query(
    "stream_sessions",
    f"""WITH {REQUESTS}, b AS (SELECT *, coalesce(us - lag(us) OVER w >= 14400000000, TRUE) AS fresh FROM requests WINDOW w AS (PARTITION BY key ORDER BY us, id)),
    s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY key ORDER BY us, id) AS sid FROM b)
    SELECT key, min(us) AS start_us, count(*) AS requests, count(*) FILTER (WHERE success) AS successes FROM s GROUP BY key, sid
    HAVING max(ts) + INTERVAL 4 HOUR <= {CLOSED}""",
)
def stream_sessions(spark, d):
    """Request sessions per key, split by four idle hours."""
    out = drain(W.request_sessions(request_stream(spark, d), "ts", "key", "4 hours", "10 minutes"), "sessions")
    return out.select("key", F.unix_micros("start").alias("start_us"), "requests", "successes")


@query("stream_dedupe", f"WITH {REQUESTS} SELECT DISTINCT key, k, CAST(1 AS BIGINT) AS times FROM requests")
def stream_dedupe(spark, d):
    """URLs seen, repeats dropped in the stream: each comes out once."""
    out = drain(W.dedupe_urls(request_stream(spark, d).select("key", "k", "ts"), "ts", ["key", "k"], "40 days"), "dedupe")
    return out.groupBy("key", "k").agg(F.count("*").alias("times"))


@query(
    "stream_snapshot_diff",
    """WITH o AS (SELECT 'https://shop.example.com/item/' || o_custkey AS url, o_orderkey AS job_id, o_orderdate AS crawl_at, o_totalprice AS price, o_orderstatus AS availability,
        o_orderpriority AS title FROM orders),
    p AS (SELECT * FROM o WHERE crawl_at < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at DESC, job_id DESC) = 1),
    c AS (SELECT * FROM o WHERE crawl_at >= TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at DESC, job_id DESC) = 1)
    SELECT c.url, CASE WHEN p.url IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS change_type, p.price AS price_prev, c.price AS price_curr FROM c LEFT JOIN p USING (url)
    WHERE p.url IS NULL OR p.price <> c.price OR p.availability <> c.availability OR p.title <> c.title""",
)
def stream_snapshot_diff(spark, d):
    """Snapshot table kept from a page stream, with a diff per micro-batch."""
    folder = work_folder(spark, "snapshots")
    prev, curr = (s.drop("stock") for s in sides(spark, d))
    from catalogwatch.operators.snapshots import latest_per_url

    latest_per_url(prev, ORDER).write.parquet(f"{folder}/table/version=0")
    curr.write.parquet(f"{folder}/landed")
    stream = spark.readStream.schema(curr.schema).parquet(f"{folder}/landed")
    drain(stream, "snapshots", "append", W.snapshot_keeper(f"{folder}/table", f"{folder}/diff", ORDER))
    return spark.read.parquet(f"{folder}/diff").select("url", "change_type", "price_prev", "price_curr")


@query(
    "stream_spike_alerts",
    f"""WITH {REQUESTS}, a AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind = 'signup') AS limited
      FROM requests GROUP BY 1 HAVING time_bucket(INTERVAL 2 HOUR, ts) + INTERVAL 2 HOUR <= {CLOSED}),
    j AS (SELECT a.*, b.limited AS baseline FROM a LEFT JOIN a b ON a.start = b.start + INTERVAL 2 HOUR),
    y AS (SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n, concat_ws(',', CASE WHEN errors / n > 0.05 THEN 'error_rate' END, CASE WHEN limited > baseline * 3 THEN 'limit_spike' END) AS alerts FROM j)
    SELECT * FROM y WHERE alerts <> ''""",
)
def stream_spike_alerts(spark, d):
    """Error-share and rate-limit spike alerts per window."""
    counts = drain(W.tumbling_counts(request_stream(spark, d), "ts", "kind", "2 hours", "10 minutes"), "spikes")
    out = W.spike_alerts(counts, "start", 7200, F.col("kind") == "error", F.col("kind") == "signup")
    return out.select(stamp(F.col("start")).alias("start"), "n", "alerts")


def _fold(fields, init, step):
    return f"""{REQUESTS}, v AS (SELECT key, list({{{fields}}} ORDER BY us, id) AS l FROM requests GROUP BY key),
    f AS (SELECT key, list_reduce(l, lambda a, x: {step}, {init}) AS s FROM v)"""


CIRCUIT = _fold(
    "'us': us, 'ok': success",
    "{'k': 0::BIGINT, 'o': FALSE, 't': 0::BIGINT, 'n': 0::BIGINT, 'r': 0::BIGINT}",
    f"""CASE WHEN x.ok THEN {{'k': 0::BIGINT, 'o': FALSE, 't': a.t, 'n': a.n, 'r': a.r + CASE WHEN a.o THEN 1 ELSE 0 END}}
      WHEN NOT (a.o AND x.us <= a.t) AND a.k + 1 >= 2 THEN {{'k': a.k + 1, 'o': TRUE, 't': x.us + {DAY_US}, 'n': a.n + 1, 'r': a.r}}
      ELSE {{'k': a.k + 1, 'o': a.o AND x.us <= a.t, 't': a.t, 'n': a.n, 'r': a.r}} END""",
)


@query("stream_circuits", f"WITH {CIRCUIT} SELECT key, s.k AS failure_streak, s.o AS is_open, s.n AS opened, s.r AS recovered FROM f")
def stream_circuits(spark, d):
    """Circuit breaker per key: state after its last event."""
    s = request_stream(spark, d).select("id", "us", "key", "success")
    out = drain(M.run_machine(s, M.Circuit, "key", threshold=2, timeout_us=DAY_US), "circuits")
    last = F.max_by(F.struct("failure_streak", "is_open", "opened", "recovered"), "id")
    return out.groupBy("key").agg(last.alias("_l")).select("key", "_l.*")


BUCKET = _fold(
    "'us': us",
    "{'t': 3::BIGINT, 'at': -1::BIGINT, 'ok': 0::BIGINT, 'no': 0::BIGINT}",
    f"""CASE WHEN greatest(CASE WHEN trunc((x.us - CASE WHEN a.at < 0 THEN x.us ELSE a.at END) / {2 * DAY_US}.0::DOUBLE * 3) > 0 THEN least(3, a.t + CAST(trunc((x.us - a.at) / {2 * DAY_US}.0::DOUBLE * 3) AS BIGINT)) ELSE a.t END, 0) >= 1
      THEN {{'t': CASE WHEN trunc((x.us - CASE WHEN a.at < 0 THEN x.us ELSE a.at END) / {2 * DAY_US}.0::DOUBLE * 3) > 0 THEN least(3, a.t + CAST(trunc((x.us - a.at) / {2 * DAY_US}.0::DOUBLE * 3) AS BIGINT)) ELSE a.t END - 1,
        'at': CASE WHEN a.at < 0 OR trunc((x.us - a.at) / {2 * DAY_US}.0::DOUBLE * 3) > 0 THEN x.us ELSE a.at END, 'ok': a.ok + 1, 'no': a.no}}
      ELSE {{'t': a.t, 'at': a.at, 'ok': a.ok, 'no': a.no + 1}} END""",
)


@query("stream_token_buckets", f"WITH {BUCKET} SELECT key, s.ok AS allowed, s.no AS refused FROM f")
def stream_token_buckets(spark, d):
    """Token-bucket limiter: requests let through and refused per client."""
    s = request_stream(spark, d).select("id", "us", "key")
    out = drain(M.run_machine(s, M.TokenBucket, "key", capacity=3, refill=3, window_us=2 * DAY_US), "buckets")
    return out.groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


BURST = _fold(
    "'us': us, 'ok': k % 10 = 0",
    f"{{'i': 0::BIGINT, 'u': 0::BIGINT, 'c': {DAY_US}::BIGINT, 'b': 0::BIGINT, 'n': 0::BIGINT}}",
    f"""CASE WHEN x.us < a.u THEN a
      WHEN x.ok THEN {{'i': 0::BIGINT, 'u': 0::BIGINT, 'c': {DAY_US}::BIGINT, 'b': 0::BIGINT, 'n': a.n + 1}}
      WHEN a.i + 1 >= 3 THEN {{'i': a.i + 1, 'u': x.us + CASE WHEN a.b + 1 > 1 THEN CAST(trunc(greatest({DAY_US}.0::DOUBLE, a.c * 1.5::DOUBLE)) AS BIGINT) ELSE {DAY_US} END,
        'c': CASE WHEN a.b + 1 > 1 THEN CAST(trunc(greatest({DAY_US}.0::DOUBLE, a.c * 1.5::DOUBLE)) AS BIGINT) ELSE {DAY_US} END, 'b': a.b + 1, 'n': a.n + 1}}
      ELSE {{'i': a.i + 1, 'u': a.u, 'c': a.c, 'b': a.b, 'n': a.n + 1}} END""",
)


@query("stream_bursts", f"WITH {BURST} SELECT key, s.n AS started, s.b AS bursts FROM f")
def stream_bursts(spark, d):
    """Bursts with a growing cool-down: requests started per site and bursts at its last event."""
    s = request_stream(spark, d).select("id", "us", "key", (F.col("k") % 10 == 0).alias("success"))
    m = M.run_machine(
        s, M.Burst, "key", max_consecutive=3, cooldown_us=DAY_US, multiplier=1.5, allowance=0, reset_on_success=True
    )
    out = drain(m, "bursts")
    return out.groupBy("key").agg(F.count_if("started").alias("started"), F.max_by("bursts", "id").alias("bursts"))


FALLBACK = _fold(
    "'o': CASE WHEN k < 20 THEN 1 WHEN k = 50 THEN 2 WHEN k = 99 THEN 0 ELSE 3 END",
    "{'s': 0::BIGINT, 't': 0::BIGINT, 'd': FALSE, 'u0': 0::BIGINT, 'u1': 0::BIGINT, 'u4': 0::BIGINT}",
    """{'s': CASE WHEN (x.o = 1 AND a.t + 1 >= 2) OR x.o = 2 THEN CASE WHEN a.d OR a.s + 1 >= 4 THEN 4 ELSE a.s + 1 END ELSE a.s END,
      't': CASE WHEN x.o = 1 THEN CASE WHEN a.t + 1 >= 2 THEN 0 ELSE a.t + 1 END WHEN x.o = 2 THEN 0 ELSE a.t END, 'd': a.d OR x.o = 0,
      'u0': a.u0 + CASE WHEN a.s = 0 THEN 1 ELSE 0 END, 'u1': a.u1 + CASE WHEN a.s = 1 THEN 1 ELSE 0 END, 'u4': a.u4 + CASE WHEN a.s = 4 THEN 1 ELSE 0 END}""",
)


@query("stream_fallback_steps", f"WITH {FALLBACK} SELECT key, s.u0 AS direct_uses, s.u1 AS datacenter_uses, s.u4 AS unavailable_uses FROM f")
def stream_fallback_steps(spark, d):
    """Fetch steps used per site."""
    k = F.col("k")
    outcome = F.when(k < 20, "connect_timeout").when(k == 50, "http_403").when(k == 99, "success").otherwise("http_500")
    s = request_stream(spark, d).select("id", "us", "key", outcome.alias("outcome"))
    out = drain(M.run_machine(s, M.Fallback, "key", steps=M.FETCH_STEPS, refusals=M.REFUSALS), "fallback")
    uses = [F.count_if(F.col("step") == i).alias(n) for i, n in ((0, "direct_uses"), (1, "datacenter_uses"), (4, "unavailable_uses"))]
    return out.groupBy("key").agg(*uses)


@query(
    "stream_stalls",
    f"""WITH {REQUESTS}, a AS (SELECT *, k > coalesce(max(k) OVER (PARTITION BY key ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS adv FROM requests),
    q AS (SELECT id, key, (us - max(CASE WHEN adv THEN us END) OVER (PARTITION BY key ORDER BY us, id)) / 1e6 AS quiet_seconds FROM a)
    SELECT id, key, quiet_seconds, quiet_seconds > 86400 AS stalled FROM q""",
)
def stream_stalls(spark, d):
    """Runs that stopped advancing."""
    s = request_stream(spark, d).select("id", "us", "key", F.col("k").alias("current"))
    out = drain(M.run_machine(s, M.Stall, "key", seconds=86400), "stalls")
    return out.select("id", "key", "quiet_seconds", "stalled")


