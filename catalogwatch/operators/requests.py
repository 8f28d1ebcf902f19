"""Figures over a request log: rates, latencies, counters, histograms, recommendations.

Everything groups by keys with map-side partial sums; nothing gathers the rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogwatch.functions.values import percent, ratio, steady_mean
from catalogwatch.operators.timeline import RunningSum, running


def _by(df: DataFrame, by):
    by = [by] if isinstance(by, str) else list(by or [])
    return df.groupBy(*by) if by else df.groupBy()


def _hits(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def request_statistics(log: DataFrame, by, success: Column, captcha: Column, blocked: Column, latency: Column) -> DataFrame:
    """Requests, outcomes, their shares and the mean latency."""
    a = _by(log, by).agg(
        F.count("*").alias("total"),
        _hits(success).alias("successful"),
        _hits(captcha).alias("captchas"),
        _hits(blocked).alias("blocked"),
        steady_mean(latency).alias("mean_latency"),
    )
    return a.withColumns(
        {
            "failed": F.col("total") - F.col("successful"),
            "success_rate": ratio(F.col("successful"), F.col("total")),
            "failure_rate": ratio(F.col("total") - F.col("successful"), F.col("total")),
            "captcha_rate": ratio(F.col("captchas"), F.col("total")),
            "blocked_rate": ratio(F.col("blocked"), F.col("total")),
        }
    )


def component_rollup(stats: DataFrame, component: str) -> DataFrame:
    """Component statistics next to the grand total, in one pass (ROLLUP)."""
    return stats.rollup(component).agg(
        F.sum("total").alias("total"), F.sum("successful").alias("successful"),
    ).withColumn("success_rate", ratio(F.col("successful"), F.col("total")))


# Share as a fraction, and how many values must be exceeded before it is reported.
QUANTILES = {"p95": (19, 20, 20), "p99": (99, 100, 100)}


def latency_statistics(log: DataFrame, by, value: str, cell: float = 1.0) -> DataFrame:
    """Mean, median and exclusive quantiles per key, exact.

    Values are counted first, so equal ones collapse before anything is ordered. Ranks are running
    counts over value cells: no task sees more than one cell of one key, and no value list is built.
    """
    keys = [by] if isinstance(by, str) else list(by)
    present = log.where(F.col(value).isNotNull())
    counted = present.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = running(counted, keys, value, value, {"_hi": RunningSum(F.col("_c"))}, cell / 1_000_000)
    sizes = counted.groupBy(*keys).agg(
        F.sum("_c").alias("n"), (F.round(F.sum(F.col(value) * F.col("_c")), 2)).alias("_sum")
    )
    n, hi = F.col("n"), F.col("_hi")
    lo = hi - F.col("_c")

    def at(rank: Column) -> Column:
        return F.max(F.when((lo < rank) & (rank <= hi), F.col(value)))

    picks = {"_m1": at(F.floor((n + 1) / 2)), "_m2": at(F.floor((n + 2) / 2))}
    outs = {"median": (F.col("_m1") + F.col("_m2")) / 2}
    for name, (i, k, gate) in QUANTILES.items():
        j = F.least(F.greatest(F.floor((n + 1) * i / k), F.lit(1)), F.greatest(n - 1, F.lit(1)))
        picks[f"_{name}a"], picks[f"_{name}b"] = at(j), at(j + 1)
        jn = F.least(F.greatest(F.floor((F.col("n") + 1) * i / k), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
        delta = (F.col("n") + 1) * i - jn * k
        outs[name] = F.when(
            F.col("n") > gate, (F.col(f"_{name}a") * (k - delta) + F.col(f"_{name}b") * delta) / k
        ).otherwise(F.lit(0.0))
    picked = ranked.join(sizes, keys).groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("_sum").alias("_sum"), *[c.alias(a) for a, c in picks.items()]
    )
    return picked.select(*keys, "n", (F.col("_sum") / F.col("n")).alias("mean"), *[c.alias(a) for a, c in outs.items()])


def event_analysis(log: DataFrame, kind: str, us: str) -> DataFrame:
    """Per event type: count, frequency per hour (span of at least one hour), first and last."""
    a = log.groupBy(kind).agg(F.count("*").alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    hours = F.greatest((F.col("last_us") - F.col("first_us")) / F.lit(3.6e9), F.lit(1.0))
    return a.withColumn("per_hour", F.col("n") / hours)


def report_summary(log: DataFrame, by, captcha: Column, proxy: Column, rate_limit: Column, success: Column, latency: Column) -> DataFrame:
    """Event counts and threshold-driven advice codes."""
    a = _by(log, by).agg(
        F.count("*").alias("total_events"),
        _hits(captcha).alias("captcha_events"),
        _hits(proxy).alias("proxy_events"),
        _hits(rate_limit).alias("rate_limit_events"),
        ratio(_hits(success), F.count("*")).alias("success_rate"),
        F.coalesce(steady_mean(latency), F.lit(0.0)).alias("mean_latency"),
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("captcha_events") > 5, F.lit("reduce_captchas")),
            F.when(F.col("proxy_events") > F.col("total_events") * 0.2, F.lit("improve_proxies")),
            F.when(F.col("rate_limit_events") > 3, F.lit("slow_down")),
        )
    )
    alert = F.when(F.col("captcha_events") > 10, F.lit("captcha_threshold_exceeded"))
    return a.withColumns({"advice": advice, "alert": alert})


def session_summary(log: DataFrame, session, us: str, success: Column, captcha: Column, blocked: Column, latency: Column) -> DataFrame:
    """Per session: duration, outcomes, requests per minute."""
    a = _by(log, session).agg(
        F.min(us).alias("start_us"),
        ((F.max(us) - F.min(us)) / F.lit(1e6)).alias("seconds"),
        F.count("*").alias("total"),
        _hits(success).alias("successful"),
        _hits(captcha).alias("captchas"),
        _hits(blocked).alias("blocked"),
        F.coalesce(steady_mean(latency), F.lit(0.0)).alias("mean_latency"),
    )
    rpm = F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds") * 60).otherwise(F.lit(0.0))
    return a.withColumns({"success_rate": ratio(F.col("successful"), F.col("total")), "per_minute": rpm})


def agent_effectiveness(log: DataFrame, agent: str, success: Column, latency: Column, domain: str | None = None) -> DataFrame:
    """Requests, success rate and mean latency per user agent, or per domain and agent."""
    by = [domain, agent] if domain else [agent]
    a = log.groupBy(*by).agg(
        F.count("*").alias("total"), _hits(success).alias("successful"), steady_mean(latency).alias("mean_latency")
    )
    return a.withColumn("success_rate", ratio(F.col("successful"), F.col("total")))


# Fixed value: price of a solved puzzle of an unlisted type.
DEFAULT_PUZZLE_COST = 0.002


def puzzle_costs(log: DataFrame, day: Column, kind: Column, solved: Column, seconds: Column, costs: dict[str, float],
                 daily_limit: float) -> DataFrame:
    """Solve rate, mean solve time and cost per day, with the daily limit check."""
    price = F.lit(DEFAULT_PUZZLE_COST)
    for name, value in costs.items():
        price = F.when(kind == name, F.lit(value)).otherwise(price)
    a = log.groupBy(day.alias("day")).agg(
        F.count("*").alias("attempts"),
        _hits(solved).alias("solves"),
        steady_mean(F.when(solved, seconds)).alias("mean_seconds"),
        F.round(F.sum(F.when(solved, price)), 4).alias("daily_cost"),
    )
    return a.withColumns(
        {
            "success_rate_pct": percent(F.col("solves"), F.col("attempts")),
            "over_limit": F.coalesce(F.col("daily_cost") > daily_limit, F.lit(False)),
        }
    )


def puzzle_totals(daily: DataFrame) -> DataFrame:
    """Overall figures from the daily ones."""
    a = daily.agg(
        F.sum("attempts").alias("attempts"), F.sum("solves").alias("solves"), F.round(F.sum("daily_cost"), 4).alias("total_cost")
    )
    return a.withColumn("success_rate_pct", percent(F.col("solves"), F.col("attempts")))


def compliance_statistics(log: DataFrame, by, allowed: Column, delayed: Column, cached: Column) -> DataFrame:
    """Robots checks: allowed and blocked counts and shares, delays applied, cache hit share."""
    a = _by(log, by).agg(
        F.count("*").alias("checks"),
        _hits(allowed).alias("allowed"),
        _hits(~allowed).alias("blocked"),
        _hits(delayed).alias("delays_applied"),
        _hits(cached).alias("cache_hits"),
    )
    return a.withColumns(
        {
            "allowed_pct": percent(F.col("allowed"), F.col("checks")),
            "blocked_pct": percent(F.col("blocked"), F.col("checks")),
            "cache_hit_pct": percent(F.col("cache_hits"), F.col("checks")),
        }
    )


def retry_statistics(log: DataFrame, by, success: Column, us: str, tie: str, delay: Column) -> DataFrame:
    """Attempts, successes, current failure streak, first and last failure, delay per retry.

    The current streak is the number of failures after the last success (of equal times, by ``tie``): found with two
    partial aggregates instead of an ordered pass.
    """
    keys = [by] if isinstance(by, str) else list(by)
    base = log.select(*keys, us, F.struct(us, tie).alias("_at"), success.alias("_ok"), delay.alias("_delay"))
    a = base.groupBy(*keys).agg(
        _hits(~F.col("_ok")).alias("attempt_count"),
        _hits(F.col("_ok")).alias("success_count"),
        F.min(F.when(~F.col("_ok"), F.col(us))).alias("first_failure"),
        F.max(F.when(~F.col("_ok"), F.col(us))).alias("last_failure"),
        F.max(F.when(F.col("_ok"), F.col(us))).alias("last_success"),
        F.max(F.when(F.col("_ok"), F.col("_at"))).alias("_last"),
        F.round(F.sum(F.when(~F.col("_ok"), F.col("_delay"))), 2).alias("total_delay"),
    )
    tail = base.where(~F.col("_ok")).join(a.select(*keys, "_last"), keys).where(F.col("_last").isNull() | (F.col("_at") > F.col("_last")))
    streak = tail.groupBy(*keys).agg(F.count("*").alias("consecutive_failures"))
    out = a.drop("_last").join(streak, keys, "left")
    run = F.coalesce("consecutive_failures", F.lit(0))
    return out.withColumns(
        {
            "consecutive_failures": run,
            "success_rate": ratio(F.col("success_count"), F.col("success_count") + run, 1.0),
            "mean_delay": F.coalesce("total_delay", F.lit(0.0)) / F.greatest(F.col("attempt_count"), F.lit(1)),
        }
    )


def domain_statistics(log: DataFrame, domain: str, success: Column, skipped: Column) -> DataFrame:
    """Per domain: outcomes, skips and success rate (1.0 where only skips were seen)."""
    a = log.groupBy(domain).agg(
        _hits(success & ~skipped).alias("success"),
        _hits(~success & ~skipped).alias("failures"),
        _hits(skipped).alias("skipped"),
    )
    return a.withColumn("success_rate", ratio(F.col("success"), F.col("success") + F.col("failures"), 1.0))


def domain_totals(stats: DataFrame) -> DataFrame:
    """Number of domains, skips, and the mean of the domain success rates."""
    return stats.agg(
        F.count("*").alias("tracked_domains"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
        F.coalesce(steady_mean(F.col("success_rate"), 9), F.lit(1.0)).alias("average_success_rate"),
    )


def batch_performance(log: DataFrame, batch: str, success: Column, us: str) -> DataFrame:
    """Per batch: URLs, outcomes, duration, URLs per second."""
    a = log.groupBy(batch).agg(
        F.count("*").alias("urls"),
        _hits(success).alias("successes"),
        _hits(~success).alias("errors"),
        ((F.max(us) - F.min(us)) / F.lit(1e6)).alias("seconds"),
    )
    return a.withColumns(
        {
            "success_rate": ratio(F.col("successes"), F.col("urls")),
            "urls_per_second": F.when(F.col("seconds") > 0, F.col("urls") / F.col("seconds")).otherwise(F.lit(0.0)),
        }
    )


# Errors of one type that raise an alert.
ERROR_THRESHOLDS = {"NetworkError": 10, "ParsingError": 5, "ExtractionError": 5}


def error_counts(log: DataFrame, kind: Column, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Errors per type with the alert flag."""
    limit = F.lit(None).cast("bigint")
    for name, value in (thresholds or ERROR_THRESHOLDS).items():
        limit = F.when(F.col("error_type") == name, F.lit(value)).otherwise(limit)
    a = log.groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))
    return a.withColumn("alert", F.coalesce(F.col("n") >= limit, F.lit(False)))


def duration_statistics(log: DataFrame, operation: str, seconds: Column) -> DataFrame:
    """Calls, mean, shortest and longest duration per operation."""
    return log.groupBy(operation).agg(
        F.count("*").alias("calls"),
        steady_mean(seconds).alias("mean_seconds"),
        F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"),
    )


# Histogram bounds in seconds.
REQUEST_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)
EXPORT_BOUNDS = (30.0, 60.0, 120.0, 300.0, 600.0, 1200.0, 1800.0, 3600.0)


def histogram(log: DataFrame, by, value: Column, bounds=REQUEST_BOUNDS) -> DataFrame:
    """Cumulative bucket counts, sum and count per label set.

    All buckets are counted in one aggregate, then turned into rows: rows are never multiplied by
    the number of buckets.
    """
    by = [by] if isinstance(by, str) else list(by)
    a = log.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.round(F.sum(value), 2).alias("sum"),
        *[F.count_if(value <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
    )
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return a.select(*by, "count", "sum", F.explode(F.array(*cells)).alias("_e")).select(*by, "_e.le", "_e.n", "count", "sum")


def labelled_counters(log: DataFrame, labels) -> DataFrame:
    return log.groupBy(*labels).agg(F.count("*").alias("n"))


def extraction_statistics(log: DataFrame, by, success: Column, fallback: Column) -> DataFrame:
    """Extraction attempts, success share and fallbacks per field or parser."""
    a = _by(log, by).agg(F.count("*").alias("attempts"), _hits(success).alias("successes"), _hits(fallback).alias("fallbacks"))
    return a.withColumn("success_rate", ratio(F.col("successes"), F.col("attempts")))


def combined_score(success: Column, uptime: Column, latency: Column) -> Column:
    """0.5 success + 0.3 uptime + 0.2 latency (five seconds and below is full marks), within 0..1."""
    speed = F.least(F.lit(1.0), 5.0 / F.greatest(F.lit(1.0), latency))
    speed = F.when(latency.isNull(), F.lit(0.0)).otherwise(speed)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), success * 0.5 + uptime * 0.3 + speed * 0.2))


# Shop systems that need a browser, factor weights, failures that rule a method out.
SCRIPTED_SYSTEMS = ("shopify", "magento", "vue_storefront", "squarespace")
METHOD_WEIGHTS = {"system": 0.4, "history": 0.3, "complexity": 0.1}
MAX_LIGHT_FAILURES, MAX_BROWSER_FAILURES = 3, 2


def recommend_method(domains: DataFrame) -> DataFrame:
    """``light`` or ``browser`` per domain with both scores.

    Input, one row per domain: cms, cms_confidence, scripted, complex, light_rate, browser_rate,
    light_latency, browser_latency, light_failures, browser_failures (recent). The load of the
    crawling host, part of the original score, has no place here.
    """
    w = METHOD_WEIGHTS
    zero = F.lit(0.0)
    cms = F.lower("cms")
    cms_part = F.coalesce(F.col("cms_confidence"), zero) * w["system"]
    needs_browser = F.coalesce(cms.isin(*SCRIPTED_SYSTEMS), F.lit(False))
    timed = (F.coalesce("light_latency", zero) != 0) & (F.coalesce("browser_latency", zero) != 0)
    light_faster = F.col("browser_latency") > F.col("light_latency")
    bonus = F.lit(w["history"] * 0.2)
    light = (
        F.when(F.col("cms").isNotNull() & ~needs_browser, cms_part).otherwise(zero)
        + F.when(~F.col("scripted"), F.lit(w["complexity"] * 0.4)).otherwise(zero)
        + F.coalesce("light_rate", zero) * w["history"]
        + F.when(timed & light_faster, bonus).otherwise(zero)
    )
    browser = (
        F.when(needs_browser, cms_part).otherwise(zero)
        + F.when(F.col("scripted"), F.lit(w["complexity"])).otherwise(zero)
        + F.when(F.col("complex"), F.lit(w["complexity"] * 0.6)).otherwise(zero)
        + F.coalesce("browser_rate", zero) * w["history"]
        + F.when(timed & ~light_faster, bonus).otherwise(zero)
    )
    method = (
        F.when(F.col("light_failures") >= MAX_LIGHT_FAILURES, "browser")
        .when(F.col("browser_failures") >= MAX_BROWSER_FAILURES, "light")
        .when(F.col("browser_score") > F.col("light_score"), "browser")
        .otherwise("light")
    )
    scored = domains.withColumns({"light_score": F.round(light, 6), "browser_score": F.round(browser, 6)})
    return scored.withColumn("method", method)
