"""Proxy catalogue joined with its failures: counts, capacity, cost, best lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogwatch.functions import urls as U
from catalogwatch.functions.values import half_up, ratio, steady_mean

# Planning figures.
REQUESTS_PER_PROXY = 250
COST_PER_PROXY = 0.65
MONTHLY_BUDGET, MONTHLY_USED = 2200.0, 650.0
SUFFICIENT, WARNING = 0.85, 0.6
BASE_LATENCY_MS, LATENCY_PER_FAILURE_MS = 350, 120


def failure_summary(log: DataFrame) -> DataFrame:
    """Failures and burned flag per canonical proxy."""
    return log.where(F.col("proxy").isNotNull()).groupBy("proxy").agg(
        F.count_if("failed").alias("failures"), F.max("burned").alias("burned")
    )


def with_failures(catalogue: DataFrame, failures: DataFrame) -> DataFrame:
    """Catalogue with its failure counts; proxies never seen failing get zero."""
    j = catalogue.join(failures.withColumnRenamed("proxy", "canonical"), "canonical", "left")
    return j.withColumns({"failures": F.coalesce("failures", F.lit(0)), "burned": F.coalesce("burned", F.lit(False))})


def proxy_counts(catalogue: DataFrame, failures: DataFrame) -> DataFrame:
    """Total, healthy, active, failed, burned; failures count whether or not the proxy is still listed."""
    bad = failures.agg(
        F.count_if(F.col("failures") > 0).alias("failed_proxies"), F.count_if("burned").alias("burned_proxies")
    )
    j = bad.withColumn("total_proxies", catalogue.agg(F.count("*")).scalar())
    return j.withColumns(
        {
            "healthy_proxies": F.greatest(F.col("total_proxies") - F.col("burned_proxies"), F.lit(0)),
            "active_proxies": F.greatest(F.col("total_proxies") - F.col("failed_proxies"), F.lit(0)),
        }
    )


def protocol_counts(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("protocol").agg(F.count("*").alias("n"))


def country_counts(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy(U.country_of_host(F.col("host")).alias("country")).agg(F.count("*").alias("n"))


def capacity(counts: DataFrame, usage: DataFrame, per_proxy: int = REQUESTS_PER_PROXY, cost: float = COST_PER_PROXY,
             budget: float = MONTHLY_BUDGET, used: float = MONTHLY_USED) -> DataFrame:
    """Needed proxies, shortage, state, cost, budget left and warning codes (one row in, one row out)."""
    one = usage.select(F.struct("total_requests", "successful_requests", "success_rate")).scalar()
    j = counts.withColumn("_u", one).select("*", "_u.*").drop("_u")
    healthy, requests = F.col("healthy_proxies"), F.col("total_requests")
    need = F.when(requests > 0, F.greatest(healthy, F.ceil(requests / per_proxy))).otherwise(healthy)
    j = j.withColumn("optimal_proxies", need.cast("bigint"))
    short = F.greatest(F.col("optimal_proxies") - healthy, F.lit(0))
    share = ratio(healthy, F.col("optimal_proxies"), 1.0)
    j = j.withColumns(
        {
            "deficit": short,
            "status": F.when(requests <= 0, "sufficient").when(share >= SUFFICIENT, "sufficient").when(share >= WARNING, "warning").otherwise("critical"),
            "estimated_cost": F.round(short * cost, 2),
            "budget_remaining": F.round(F.greatest(F.lit(budget) - (F.lit(used) + short * cost), F.lit(0.0)), 2),
        }
    )
    low = (F.col("success_rate") != 0) & (F.col("success_rate") < 90)
    few = (F.col("total_proxies") > 0) & (healthy < F.col("total_proxies") * 0.6)
    warn = F.array_compact(
        F.array(F.when(low, "low_success_rate"), F.when(few, "few_healthy_proxies"), F.when(F.col("deficit") > 0, "proxy_deficit"))
    )
    return j.withColumn("warnings", warn)


def optimal_for_concurrency(concurrency: Column, safety: float = 1.5, target: float = 0.85, low: int = 5, high: int = 100) -> Column:
    """Proxies needed for a number of parallel requests."""
    safety, target = max(1.0, safety), max(0.1, min(0.99, target))
    low = max(1, low)
    high = max(low, high)
    need = F.least(F.greatest(F.ceil(concurrency * safety / target), F.lit(low)), F.lit(high))
    return F.when(concurrency <= 0, F.lit(low)).otherwise(need).cast("int")


def purchase_plan(rows: DataFrame, deficit: str, budget_left: Column, minutes_since: Column, cost: float = COST_PER_PROXY,
                  batch: int = 10, cooldown: int = 60, auto: bool = True) -> DataFrame:
    """How many proxies may be bought for a shortage, at what cost."""
    d = F.col(deficit)
    by_budget = F.floor(budget_left / cost) if cost > 0 else d
    count = F.when(d > 0, F.greatest(F.lit(0), F.least(d, F.lit(batch), by_budget))).otherwise(F.lit(0)).cast("bigint")
    wait = F.coalesce(F.greatest(F.lit(0), F.ceil(F.lit(cooldown) - minutes_since)), F.lit(0)).cast("bigint")
    return rows.withColumns(
        {
            "recommended": count,
            "cooldown_minutes": wait,
            "can_purchase": F.lit(auto) & (count > 0) & (wait == 0),
            "purchase_cost": F.round(count * cost, 2),
        }
    )


def top_proxies(joined: DataFrame, successful: DataFrame, n: int = 5) -> DataFrame:
    """Best proxies when successes are spread evenly and failures taken off."""
    size = joined.agg(F.count("*")).scalar()
    j = joined.withColumn("_base", successful.select("successful_requests").scalar() / F.greatest(size, F.lit(1)))
    base = F.greatest(F.col("_base"), F.lit(1.0))
    good = F.greatest(base - F.col("failures"), F.lit(0.0))
    rate = half_up(F.least(ratio(good, good + F.col("failures")) * 100, F.lit(100.0)), 1)
    out = j.select(
        "canonical",
        rate.alias("success_rate"),
        (BASE_LATENCY_MS + F.col("failures") * LATENCY_PER_FAILURE_MS).alias("latency_ms"),
        U.country_of_host(F.col("host")).alias("country"),
    )
    return out.orderBy(F.desc("success_rate"), "canonical").limit(n)


def pool_usage(pool: DataFrame, monthly_cost: float, max_cost: float, min_count: int) -> DataFrame:
    """Active, expired, mean latency of answering proxies, mean success of used ones, traffic, warnings."""
    live = F.col("is_active") & ~F.col("is_expired")
    a = pool.agg(
        F.count("*").alias("total_proxies"),
        F.count_if(live).alias("active_proxies"),
        F.count_if("is_expired").alias("expired_proxies"),
        F.sum("usage_count").alias("total_usage"),
        F.coalesce(steady_mean(F.when(F.col("latency") > 0, F.col("latency")), 6), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(steady_mean(F.when(F.col("usage_count") > 0, F.col("success_rate")), 9), F.lit(0.0)).alias("avg_success_rate"),
        F.round(F.sum("traffic_gb"), 4).alias("total_traffic_gb"),
        F.round(F.sum(F.coalesce(F.col("traffic_gb") * F.col("cost_per_gb"), F.lit(0.0))), 4).alias("traffic_cost"),
    )
    warn = F.array_compact(
        F.array(
            F.when(F.lit(monthly_cost > max_cost * 0.8), "cost_near_budget"),
            F.when(F.col("active_proxies") < min_count, "too_few_active"),
            F.when(F.col("avg_success_rate") < 0.8, "low_success_rate"),
        )
    )
    return a.withColumns({"budget_remaining": F.lit(max(0.0, max_cost - monthly_cost)), "warnings": warn})


def meets_requirement(proxies: DataFrame, metadata: DataFrame, on: str, country: str | None = None, protocol: str | None = None) -> DataFrame:
    """Proxies of the wanted country and protocol; those without metadata pass."""
    j = proxies.join(metadata, on, "left")
    keep = F.lit(True)
    for name, wanted in (("country", country), ("protocol", protocol)):
        if wanted:
            have = F.nullif(F.lower(name), F.lit(""))
            keep = keep & (have.isNull() | (have == wanted.lower()))
    return j.where(keep).select(*proxies.columns)


def best_proxies(pool: DataFrame, n: int = 5, country: str | None = None, protocol: str | None = None) -> DataFrame:
    """Active proxies by 0.5 success + 0.3 speed + 0.2 spare use."""
    live = pool.where(F.col("is_active") & ~F.col("is_expired"))
    if country:
        live = live.where(F.upper("country") == country.upper())
    if protocol:
        live = live.where(F.lower("protocol") == protocol.lower())
    speed = F.greatest(F.lit(0.0), 1.0 - F.col("latency") / 10.0)
    spare = F.greatest(F.lit(0.0), 1.0 - F.col("usage_count") / 1000.0)
    score = F.round(F.col("success_rate") * 0.5 + speed * 0.3 + spare * 0.2, 9)
    return live.withColumn("score", score).orderBy(F.desc("score"), "proxy").limit(n)
