"""Streams over events that arrive late and out of order, in several micro-batches.

Each query lands its table in parts by time of arrival; a part is a micro-batch. Twins work on the events themselves, up to the
last cell that the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogwatch.operators import snapshots as snap
from catalogwatch.plans.bindings import CRAWLS, REQUESTS, requests, stamp
from catalogwatch.plans.registry import query
from catalogwatch.plans.snapshots import ORDER, sides
from catalogwatch.plans.streams import DAY_US
from catalogwatch.streaming import machines as M
from catalogwatch.streaming import ordered as O
from catalogwatch.streaming import windows as W
from catalogwatch.streaming.runner import drain, read_parts, work_folder, write_parts

HOUR_US = 3_600_000_000
# Events come up to 35 hours late; the watermark waits for two days.
LATE, LATE_MS = "2 days", 2 * 86_400_000
CUTS = ("2024-01-08", "2024-01-16", "2024-01-24")


def late_requests(spark: SparkSession, d: str, job: str) -> DataFrame:
    """The request log as it arrives: each event up to 35 hours after its time, in four parts."""
    r = requests(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.col("ts") + F.make_dt_interval(hours=(F.col("id") * 7 % 36).cast("int"))
    folder = f"{work_folder(spark, job)}/landed"
    write_parts(r, arrival, [F.lit(c).cast("timestamp") for c in CUTS], folder)
    return read_parts(spark, folder, r.schema)


RELEASED = f"""{REQUESTS}, edge AS (SELECT (epoch_ms(max(ts)) - {LATE_MS}) // 3600000 AS cell FROM requests),
released AS (SELECT requests.* FROM requests, edge WHERE us // {HOUR_US} < cell)"""


def _fold(fields: str, init: str, step: str) -> str:
    return f"""{RELEASED}, v AS (SELECT key, list({{{fields}}} ORDER BY us, id) AS l FROM released GROUP BY key),
    f AS (SELECT key, list_reduce(l, lambda a, x: {step}, {init}) AS s FROM v)"""


def _last(out: DataFrame, *columns: str) -> DataFrame:
    return out.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("us", "id")).alias("_l")).select("key", "_l.*")


CIRCUIT = _fold(
    "'us': us, 'ok': success",
    "{'k': 0::BIGINT, 'o': FALSE, 't': 0::BIGINT, 'n': 0::BIGINT, 'r': 0::BIGINT}",
    f"""CASE WHEN x.ok THEN {{'k': 0::BIGINT, 'o': FALSE, 't': a.t, 'n': a.n, 'r': a.r + CASE WHEN a.o THEN 1 ELSE 0 END}}
      WHEN NOT (a.o AND x.us <= a.t) AND a.k + 1 >= 2 THEN {{'k': a.k + 1, 'o': TRUE, 't': x.us + {DAY_US}, 'n': a.n + 1, 'r': a.r}}
      ELSE {{'k': a.k + 1, 'o': a.o AND x.us <= a.t, 't': a.t, 'n': a.n, 'r': a.r}} END""",
)


@query("stream_late_circuits", f"WITH {CIRCUIT} SELECT key, s.k AS failure_streak, s.o AS is_open, s.n AS opened, s.r AS recovered FROM f")
def stream_late_circuits(spark, d):
    """Circuit breaker per key over late events: state after the last event that the watermark has released."""
    s = late_requests(spark, d, "late-circuits").select("id", "ts", "us", "key", "success")
    out = drain(O.run_ordered(s, M.Circuit, "key", LATE, 3600, threshold=2, timeout_us=DAY_US, idle_us=60 * DAY_US), "late-circuits")
    return _last(out, "failure_streak", "is_open", "opened", "recovered")


_GAINED = f"trunc((x.us - CASE WHEN a.at < 0 THEN x.us ELSE a.at END) / {2 * DAY_US}.0::DOUBLE * 3)"
_TOKENS = f"CASE WHEN {_GAINED} > 0 THEN least(3, a.t + CAST({_GAINED} AS BIGINT)) ELSE a.t END"
_AT = f"CASE WHEN a.at < 0 OR {_GAINED} > 0 THEN x.us ELSE a.at END"
BUCKET = _fold(
    "'us': us",
    "{'t': 3::BIGINT, 'at': -1::BIGINT, 'ok': 0::BIGINT, 'no': 0::BIGINT}",
    f"""CASE WHEN {_TOKENS} >= 1 THEN {{'t': {_TOKENS} - 1, 'at': {_AT}, 'ok': a.ok + 1, 'no': a.no}}
      ELSE {{'t': {_TOKENS}, 'at': {_AT}, 'ok': a.ok, 'no': a.no + 1}} END""",
)


@query("stream_late_buckets", f"WITH {BUCKET} SELECT key, s.ok AS allowed, s.no AS refused FROM f")
def stream_late_buckets(spark, d):
    """Token buckets over late events: requests let through and refused per client."""
    s = late_requests(spark, d, "late-buckets").select("id", "ts", "us", "key")
    out = drain(O.run_ordered(s, M.TokenBucket, "key", LATE, 3600, capacity=3, refill=3, window_us=2 * DAY_US), "late-buckets")
    return out.groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


_COOL = f"CASE WHEN a.b + 1 > 1 THEN CAST(trunc(greatest({DAY_US}.0::DOUBLE, a.c * 1.5::DOUBLE)) AS BIGINT) ELSE {DAY_US} END"
BURST = _fold(
    "'us': us, 'ok': k % 10 = 0",
    f"{{'i': 0::BIGINT, 'u': 0::BIGINT, 'c': {DAY_US}::BIGINT, 'b': 0::BIGINT, 'n': 0::BIGINT}}",
    f"""CASE WHEN x.us < a.u THEN a
      WHEN x.ok THEN {{'i': 0::BIGINT, 'u': 0::BIGINT, 'c': {DAY_US}::BIGINT, 'b': 0::BIGINT, 'n': a.n + 1}}
      WHEN a.i + 1 >= 3 THEN {{'i': a.i + 1, 'u': x.us + {_COOL}, 'c': {_COOL}, 'b': a.b + 1, 'n': a.n + 1}}
      ELSE {{'i': a.i + 1, 'u': a.u, 'c': a.c, 'b': a.b, 'n': a.n + 1}} END""",
)


@query("stream_late_bursts", f"WITH {BURST} SELECT key, s.n AS started, s.b AS bursts FROM f")
def stream_late_bursts(spark, d):
    """Bursts with a growing cool-down over late events."""
    s = late_requests(spark, d, "late-bursts").select("id", "ts", "us", "key", (F.col("k") % 10 == 0).alias("success"))
    rules = {"max_consecutive": 3, "cooldown_us": DAY_US, "multiplier": 1.5, "allowance": 0, "reset_on_success": True}
    out = drain(O.run_ordered(s, M.Burst, "key", LATE, 3600, **rules), "late-bursts")
    return out.groupBy("key").agg(F.count_if("started").alias("started"), F.max_by("bursts", F.struct("us", "id")).alias("bursts"))


FALLBACK = _fold(
    "'o': CASE WHEN k < 20 THEN 1 WHEN k = 50 THEN 2 WHEN k = 99 THEN 0 ELSE 3 END",
    "{'s': 0::BIGINT, 't': 0::BIGINT, 'd': FALSE, 'u0': 0::BIGINT, 'u1': 0::BIGINT, 'u4': 0::BIGINT}",
    """{'s': CASE WHEN (x.o = 1 AND a.t + 1 >= 2) OR x.o = 2 THEN CASE WHEN a.d OR a.s + 1 >= 4 THEN 4 ELSE a.s + 1 END ELSE a.s END,
      't': CASE WHEN x.o = 1 THEN CASE WHEN a.t + 1 >= 2 THEN 0 ELSE a.t + 1 END WHEN x.o = 2 THEN 0 ELSE a.t END, 'd': a.d OR x.o = 0,
      'u0': a.u0 + CASE WHEN a.s = 0 THEN 1 ELSE 0 END, 'u1': a.u1 + CASE WHEN a.s = 1 THEN 1 ELSE 0 END, 'u4': a.u4 + CASE WHEN a.s = 4 THEN 1 ELSE 0 END}""",
)


@query("stream_late_fallback", f"WITH {FALLBACK} SELECT key, s.u0 AS direct_uses, s.u1 AS datacenter_uses, s.u4 AS unavailable_uses FROM f")
def stream_late_fallback(spark, d):
    """Fetch steps used per site over late events."""
    k = F.col("k")
    outcome = F.when(k < 20, "connect_timeout").when(k == 50, "http_403").when(k == 99, "success").otherwise("http_500")
    s = late_requests(spark, d, "late-fallback").select("id", "ts", "us", "key", outcome.alias("outcome"))
    out = drain(O.run_ordered(s, M.Fallback, "key", LATE, 3600, steps=M.FETCH_STEPS, refusals=M.REFUSALS), "late-fallback")
    uses = [F.count_if(F.col("step") == i).alias(n) for i, n in ((0, "direct_uses"), (1, "datacenter_uses"), (4, "unavailable_uses"))]
    return out.groupBy("key").agg(*uses)


@query(
    "stream_silence",
    f"""WITH {RELEASED}, a AS (SELECT *, k > coalesce(max(k) OVER (PARTITION BY key ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS adv FROM released),
    g AS (SELECT key, k AS best, us AS quiet_since_us, lead(us) OVER (PARTITION BY key ORDER BY us, id) AS next_us FROM a WHERE adv)
    SELECT key, best, quiet_since_us, quiet_since_us + {2 * DAY_US} AS alarm_us FROM g, edge
    WHERE coalesce(next_us - quiet_since_us > {2 * DAY_US}, quiet_since_us + {2 * DAY_US} < edge.cell * {HOUR_US})""",
)
def stream_silence(spark, d):
    """Alarms for runs that have not advanced for two days, whether or not anything comes after."""
    s = late_requests(spark, d, "silence").select("id", "ts", "us", "key", F.col("k").alias("current"))
    out = drain(O.run_ordered(s, O.Silence, "key", LATE, 3600, limit_us=2 * DAY_US, forget_us=60 * DAY_US), "silence")
    return out.select("key", F.col("best").cast("int").alias("best"), "quiet_since_us", F.col("us").alias("alarm_us"))


BUDGET = f"""{RELEASED}, b AS (SELECT id, k % 5 AS scope, strftime(ts, '%Y-%m-%d') AS day, us, k * 1000 AS bytes FROM released),
u AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY scope, day ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(bytes) OVER (PARTITION BY scope, day ORDER BY us, id) AS upto FROM b),
f AS (SELECT *, max(CASE WHEN before < 2500000 THEN upto END) OVER (PARTITION BY scope, day ORDER BY us, id) AS usage FROM u)"""


@query(
    "stream_budget_gate",
    f"""WITH {BUDGET} SELECT id, scope, day, CASE WHEN before >= 2500000 THEN 'exhausted' WHEN upto > 2500000 THEN 'limit_reached'
        WHEN upto / 2000000.0::DOUBLE >= 0.8 THEN 'throttled' ELSE 'allowed' END AS state,
      before < 2500000 AND upto <= 2500000 AS allowed, CAST(usage AS BIGINT) AS usage,
      CASE WHEN before >= 2500000 OR upto > 2500000 THEN 1.0 WHEN upto / 2000000.0::DOUBLE >= 0.8 THEN least(upto / 2000000.0::DOUBLE, 1.0)
        ELSE upto / 2000000.0::DOUBLE END AS usage_ratio FROM f""",
)
def stream_budget_gate(spark, d):
    """The daily traffic gate of each scope, request by request."""
    r = late_requests(spark, d, "budget")
    s = r.select(
        "id", "ts", "us", (F.col("k") % 5).alias("scope"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("k") * 1000).cast("bigint").alias("size")
    )
    rules = {"soft": 2_000_000, "hard": 2_500_000, "throttle": 0.8, "day_us": DAY_US, "grace_us": DAY_US}
    out = drain(O.run_ordered(s, O.DailyBudget, ["scope", "day"], LATE, 3600, **rules), "budget")
    return out.select("id", "scope", "day", "state", "allowed", "usage", "usage_ratio")


@query(
    "stream_moving_alerts",
    f"""WITH {REQUESTS}, x AS (SELECT key % 3 AS scope, kind, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM requests),
    a AS (SELECT scope, start, count(*) AS n, count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind = 'signup') AS limited FROM x GROUP BY ALL
      HAVING epoch_ms(start) + 7200000 <= (SELECT epoch_ms(max(ts)) - {LATE_MS} FROM requests)),
    b AS (SELECT *, avg(limited) OVER (PARTITION BY scope ORDER BY start RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS baseline FROM a),
    y AS (SELECT scope, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n, baseline, concat_ws(',', CASE WHEN errors / n > 0.3 THEN 'error_rate' END, CASE WHEN limited > 3 * baseline THEN 'limit_spike' END) AS alerts FROM b)
    SELECT * FROM y WHERE alerts <> ''""",
)
def stream_moving_alerts(spark, d):
    """Two-hour windows, every hour, with too many errors or three times the rate-limit answers of the six before."""
    s = late_requests(spark, d, "moving").withColumn("scope", F.col("key") % 3)
    out = drain(
        W.moving_alerts(s, "ts", "scope", 7200, 3600, LATE, 6, F.col("kind") == "error", F.col("kind") == "signup", 0.3, 3), "moving"
    )
    return out.select("scope", stamp(F.col("start")).alias("start"), "n", "baseline", "alerts")


CRAWL_CUTS = ("1998-07-01", "1999-06-01", "2000-06-01")


@query(
    "stream_snapshot_state",
    f"""WITH {CRAWLS}, edge AS (SELECT (epoch_ms(max(crawl_at)) - {90 * 86_400_000}) // 86400000 AS cell FROM crawls),
    p AS (SELECT *, TRUE AS old FROM crawls WHERE crawl_at < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_at DESC, job_id DESC) = 1),
    c AS (SELECT crawls.*, FALSE AS old FROM crawls, edge WHERE crawl_at >= TIMESTAMP '1998-01-01' AND epoch_ms(crawl_at) // 86400000 < cell),
    h AS (SELECT *, lag(job_id) OVER w IS NOT NULL AS known, lag(price) OVER w AS price_prev, lag(availability) OVER w AS a, lag(title) OVER w AS t FROM (FROM p UNION ALL FROM c)
      WINDOW w AS (PARTITION BY url ORDER BY crawl_at, job_id))
    SELECT url, job_id, CASE WHEN known THEN 'MODIFIED' ELSE 'ADDED' END AS change_type, price_prev, price AS price_curr FROM h
    WHERE NOT old AND (NOT known OR price IS DISTINCT FROM price_prev OR availability IS DISTINCT FROM a OR title IS DISTINCT FROM t)""",
)
def stream_snapshot_state(spark, d):
    """Changes of pages against a snapshot that the stream holds as state; it begins with the table of the older crawl."""
    folder = work_folder(spark, "snapshot-state")
    fields = "fetched_at string, price double, availability string, title string"
    prev, curr = (
        s.select(
            "url", F.col("job_id").alias("id"), F.col("crawl_at").cast("timestamp").alias("ts"), F.unix_micros(F.col("crawl_at").cast("timestamp")).alias("us"),
            "fetched_at", "price", "availability", "title",
        )
        for s in (snap.latest_per_url(sides(spark, d)[0].drop("stock"), ORDER), sides(spark, d)[1])
    )
    # Pages arrive up to a month late, in four parts; the watermark waits for three.
    write_parts(curr, F.col("ts") + F.make_dt_interval(days=(F.col("id") % 30).cast("int")), [F.lit(c).cast("timestamp") for c in CRAWL_CUTS], f"{folder}/landed")
    stream = read_parts(spark, f"{folder}/landed", curr.schema)
    changes = O.run_ordered(stream, O.Changes, "url", "90 days", 86400, initial=prev.drop("ts"), fields=fields)
    out = drain(changes, "snapshot-state")
    return snap.changes(out).select("url", F.col("id").alias("job_id"), "change_type", "price_prev", "price_curr")
