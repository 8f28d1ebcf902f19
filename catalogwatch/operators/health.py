"""Health, streaks, burn rules, pacing and budgets over per-key request timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogwatch.functions.values import ratio
from catalogwatch.operators.timeline import (
    HOUR,
    MINUTE,
    RunningLast,
    RunningMax,
    RunningSum,
    decayed,
    running,
    streaks,
    trailing_rows,
    trailing_time,
)

RECENT = 50


def recent_latency(log: DataFrame, key, us: str, tie: str, success: Column, latency: str, rows: int = RECENT,
                   width: float = MINUTE) -> DataFrame:
    """Mean of the last ``rows`` successful latencies at each success."""
    ok = log.where(success)
    out = trailing_rows(ok, key, us, tie, rows, {"_s": F.sum(latency), "_n": F.count(latency)}, width=width)
    return out.withColumn("recent_latency", F.round(F.col("_s"), 2) / F.col("_n")).drop("_s", "_n")


def outcome_streaks(log: DataFrame, key, us: str, tie: str, success: Column, width: float = MINUTE) -> DataFrame:
    """Consecutive successes and failures up to each row."""
    return streaks(log, key, us, tie, {"success_streak": success, "failure_streak": ~success}, width)


def health_score(success_rate: Column, mean_latency: Column, requests: Column, burned: Column) -> Column:
    """0.5 success + 0.3 speed + 0.2 uptime; 0 for unused and burned proxies."""
    speed = F.when(mean_latency.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 5.0 / F.greatest(F.lit(1.0), mean_latency)))
    score = success_rate * 0.5 + speed * 0.3 + success_rate * 0.2
    return F.when((requests == 0) | F.coalesce(burned, F.lit(False)), F.lit(0.0)).otherwise(score)


# Errors that burn a proxy at once, and the burn limits.
BURNING_ERRORS = ("blocked", "captcha", "authentication")
MIN_RATE, MIN_REQUESTS = 0.2, 10


def burn_events(log: DataFrame, key: str, us: str, tie: str, success: Column, error: Column, max_failures: int = 3,
                width: float = MINUTE) -> DataFrame:
    """First row at which a proxy is burned, with the reason.

    Running counts and streaks per key, then one ``min_by`` per key.
    """
    flagged = log.withColumns({"_ok": success, "_err": F.lower(error)})
    counted = running(
        flagged, key, us, tie,
        {"_n": RunningSum(F.lit(1)), "_good": RunningSum(F.col("_ok").cast("int"))}, width,
    )
    runs = streaks(counted, key, us, tie, {"_bad": ~F.col("_ok")}, width)
    at_once = F.lit(False)
    for phrase in BURNING_ERRORS:
        at_once = at_once | F.coalesce(F.col("_err").contains(phrase), F.lit(False))
    rate = ratio(F.col("_good"), F.col("_n"))
    reason = (
        F.when(at_once, "error")
        .when(F.col("_bad") >= max_failures, "consecutive_failures")
        .when((rate < MIN_RATE) & (F.col("_n") >= MIN_REQUESTS), "low_success_rate")
    )
    hits = runs.withColumn("reason", reason).where(F.col("reason").isNotNull())
    first = F.min_by(F.struct(F.col(us).alias("burned_us"), "reason", F.col("_n").alias("requests")), F.struct(us, tie))
    return hits.groupBy(key).agg(first.alias("_f")).select(key, "_f.*")


def drop_after_burn(log: DataFrame, burns: DataFrame, key: str, us: str) -> DataFrame:
    """Rows up to and including the burn of their key."""
    j = log.join(burns.select(key, "burned_us"), key, "left")
    return j.where(F.col("burned_us").isNull() | (F.col(us) <= F.col("burned_us"))).drop("burned_us")


def rolling_success(log: DataFrame, key: str, us: str, tie: str, success: Column, seconds: float, width: float = MINUTE) -> DataFrame:
    """Success rate over the trailing window at each row."""
    out = trailing_time(
        log, key, us, tie, seconds, {"window_requests": F.lit(1), "window_success": success.cast("int")}, True, width
    )
    return out.withColumn("window_rate", ratio(F.col("window_success"), F.col("window_requests"), 1.0))


def rate_limit_hits(log: DataFrame, key: str, us: str, tie: str, limited: Column, seconds: float, threshold: int,
                    width: float = MINUTE) -> DataFrame:
    """Rows at which rate-limit errors of the trailing window (open at its far end) reach the threshold."""
    out = trailing_time(log.where(limited), key, us, tie, seconds, {"window_errors": F.lit(1)}, False, width)
    return out.withColumn("exceeded", F.col("window_errors") >= threshold)


def hourly_alerts(log: DataFrame, key: str, us: str, tie: str, flags: dict[str, tuple[Column, int]], width: float = MINUTE) -> DataFrame:
    """Rows whose event type occurred more often than its threshold within the last hour."""
    sums = {f"{n}_last_hour": c.cast("int") for n, (c, _) in flags.items()}
    out = trailing_time(log, key, us, tie, HOUR, sums, False, width)
    alert = F.array_compact(F.array(*[F.when(c & (F.col(f"{n}_last_hour") > t), F.lit(n)) for n, (c, t) in flags.items()]))
    return out.withColumn("alerts", alert)


MEGABYTE = 1024 * 1024


def budget_states(log: DataFrame, scope, day: str, us: str, tie: str, size: Column, soft: int, hard: int,
                  throttle: float = 0.8, width: float = MINUTE) -> DataFrame:
    """State of a daily budget at each consumption: allowed, throttled, blocked, usage.

    Usage stops growing once it has reached the hard limit. Because the limit is tested before
    adding, "exhausted" is the same as "everything before already sums to the limit", so a plain
    running sum decides it and the frozen usage is the running sum at the crossing.
    """
    scope = [scope] if isinstance(scope, str) else list(scope)
    keys = [*scope, day]
    sized = log.withColumn("_b", size.cast("bigint"))
    out = running(sized, keys, us, tie, {"_before": RunningSum(F.col("_b"), before=True), "_upto": RunningSum(F.col("_b"))}, width)
    before = F.coalesce("_before", F.lit(0))
    exhausted = before >= hard
    out = running(
        out, keys, us, tie, {"_frozen": RunningMax(F.when(F.coalesce("_before", F.lit(0)) < hard, F.col("_upto")))}, width
    )
    blocked = exhausted | (F.col("_upto") > hard)
    share = F.col("_upto") / F.lit(float(soft))
    state = (
        F.when(exhausted, "exhausted").when(F.col("_upto") > hard, "limit_reached").when(share >= throttle, "throttled").otherwise("allowed")
    )
    return out.select(
        *log.columns,
        state.alias("state"),
        (~blocked).alias("allowed"),
        F.col("_frozen").alias("usage"),
        F.when(blocked, F.lit(1.0)).when(share >= throttle, F.least(share, F.lit(1.0))).otherwise(share).alias("usage_ratio"),
    )


def budget_snapshot(log: DataFrame, day: str, site: str, residential: Column, size: Column) -> DataFrame:
    """Megabytes per day for every site and overall, with the residential part (ROLLUP)."""
    sized = log.withColumns({"_b": size.cast("bigint"), "_r": F.when(residential, size.cast("bigint")).otherwise(F.lit(0))})
    a = sized.groupBy(day, site).agg(F.sum("_b").alias("_b"), F.sum("_r").alias("_r"))
    r = a.groupBy(F.col(day)).agg(F.sum("_b").alias("_b"), F.sum("_r").alias("_r")).withColumn("scope", F.lit("global"))
    per = a.withColumn("scope", F.concat(F.lit("site:"), F.col(site).cast("string"))).select(day, "_b", "_r", "scope")
    both = per.unionByName(r.select(day, "_b", "_r", "scope"))
    mb = lambda c: F.round(F.col(c) / MEGABYTE, 2)
    return both.select(day, "scope", mb("_b").alias("usage_mb"), mb("_r").alias("residential_mb"))


def pacing(log: DataFrame, key: str, us: str, tie: str, success: Column, inter_site: float, min_interval: float,
           width: float = MINUTE) -> DataFrame:
    """Gap since the previous run and the delay still required, scaled by the success rate so far."""
    out = running(
        log.withColumn("_ok", success.cast("int")), key, us, tie,
        {
            "_prev": RunningLast(F.col(us), before=True),
            "_n": RunningSum(F.lit(1), before=True),
            "_good": RunningSum(F.col("_ok"), before=True),
        },
        width,
    )
    gap = (F.col(us) - F.col("_prev")) / F.lit(1e6)
    base = F.greatest(F.lit(inter_site), F.lit(min_interval) - gap, F.lit(0.0))
    rate = ratio(F.col("_good"), F.col("_n"), 1.0)
    seen = F.col("_n").isNotNull()
    factor = F.when(seen & (rate < 0.5), 1.5).when(seen & (rate > 0.9), 0.75).otherwise(1.0)
    return out.select(*log.columns, gap.alias("gap_seconds"), (base * factor).alias("delay_seconds"))


def crawl_wait(log: DataFrame, key: str, us: str, tie: str, delay: Column, width: float = MINUTE) -> DataFrame:
    """Seconds still to wait at each access under a crawl delay."""
    out = running(log, key, us, tie, {"_prev": RunningLast(F.col(us), before=True)}, width)
    gap = (F.col(us) - F.col("_prev")) / F.lit(1e6)
    wait = F.when(F.col("_prev").isNull(), F.greatest(delay, F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), delay - gap))
    return out.select(*log.columns, wait.alias("wait_seconds"))


def half_mean_latency(log: DataFrame, key, us: str, tie: str, value: str, width: float = MINUTE) -> DataFrame:
    """Latency folded as (old + new) / 2 from the first value on."""
    return decayed(log, key, us, tie, value, 0.5, "half_mean", None, width)


def moving_latency(log: DataFrame, key, us: str, tie: str, value: str, width: float = MINUTE) -> DataFrame:
    """Latency folded as 0.9 old + 0.1 new from the first value on."""
    return decayed(log, key, us, tie, value, 0.9, "moving_latency", None, width)


def usage_state(log: DataFrame, key: str, us: str, tie: str, success: Column, latency: str, traffic: Column, cost_per_gb: float,
                width: float = MINUTE) -> DataFrame:
    """Pool record per proxy: uses, success rate, moving latency, traffic and its cost."""
    a = log.groupBy(key).agg(
        F.count("*").alias("usage_count"),
        ratio(F.count_if(success), F.count("*")).alias("success_rate"),
        F.sum(traffic).alias("traffic_mb"),
    )
    moved = moving_latency(log, key, us, tie, latency, width).drop("n")
    return a.join(moved, key, "left").withColumn("traffic_cost", F.round(F.col("traffic_mb") / 1024 * cost_per_gb, 4))


# Quiet seconds and error run that abort a crawl, and the error words.
STALL_SECONDS, ERROR_RUN = 300, 25
ERROR_WORDS = ("timeout", "тайм-аут", "http 404", "404", "not found", "no element")


def progress_watch(events: DataFrame, run, us: str, tie: str, current: str, is_error: Column, phase: str | None = None,
                   stall: float = STALL_SECONDS, error_run: int = ERROR_RUN, width: float = MINUTE) -> DataFrame:
    """For each progress event: did it advance, seconds since the last advance, length of the error run.

    An advance resets the error run unless the advancing message is itself an error, in which case
    the run starts again at one.
    """
    run = [run] if isinstance(run, str) else list(run)
    keys = [*run, phase] if phase else run
    out = running(
        events.withColumn("_err", is_error), keys, us, tie, {"_best": RunningMax(F.col(current), before=True)}, width
    )
    advanced = F.coalesce(F.col(current) > F.coalesce("_best", F.lit(-1)), F.lit(False))
    out = out.withColumn("advanced", advanced)
    out = running(
        out, run, us, tie,
        {
            "_last": RunningLast(F.when(F.col("advanced"), F.col(us))),
            "_neg_start": RunningMax(-F.col(us)),
            "_e": RunningSum(F.col("_err").cast("int")),
        },
        width,
    )
    # errors counted up to the last advance, to subtract from the running error count
    mark = F.when(F.col("advanced"), F.col("_e") - F.col("_err").cast("int"))
    out = running(out, run, us, tie, {"_offset": RunningMax(mark)}, width)
    quiet = (F.col(us) - F.coalesce(F.col("_last"), -F.col("_neg_start"))) / F.lit(1e6)
    errors = F.col("_e") - F.coalesce("_offset", F.lit(0))
    return out.select(
        *events.columns,
        "advanced",
        quiet.alias("quiet_seconds"),
        errors.alias("error_run"),
        (quiet > stall).alias("stalled"),
        (errors >= error_run).alias("too_many_errors"),
    )


def speed_and_eta(events: DataFrame, run: str, us: str, tie: str, done: str, total: str, width: float = MINUTE) -> DataFrame:
    """Processed per second since the start of the run and whole seconds left."""
    starts = events.groupBy(run).agg(F.min(us).alias("_start"))
    out = events.join(starts, run)
    elapsed = (F.col(us) - F.col("_start")) / F.lit(1e6)
    speed = F.when((elapsed > 0) & (F.col(done) > 0), F.col(done) / elapsed)
    eta = F.when(speed > 0, F.ceil(F.greatest(F.col(total) - F.col(done), F.lit(0)) / speed))
    return out.select(*events.columns, speed.alias("speed"), eta.cast("bigint").alias("eta_seconds"))
