"""Selector statistics: state from an extraction log, scores, best lists, store reconciliation, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogwatch.functions.values import ratio, steady_mean
from catalogwatch.operators.health import half_mean_latency
from catalogwatch.operators.timeline import MINUTE

# Reliability and staleness limits, score weights and scales.
RELIABLE_RATE, RELIABLE_ATTEMPTS, RELIABLE_RUN = 0.8, 5, 3
STALE_DAYS, STALE_RATE = 30, 0.7
DAY_US = 86_400_000_000
STORE_COLUMNS = ("last_used", "confidence_score", "reliability_score", "usage_count")
WIN_REASONS = ("newer", "higher_confidence", "more_reliable", "more_used")


def end_streaks(log: DataFrame, keys: list[str], us: str, tie: str, ok: str) -> DataFrame:
    """Length of the success and failure runs that end each key's log, equal times by ``tie`` (two partial aggregates)."""
    at = F.struct(us, tie)
    last = log.groupBy(*keys).agg(F.max(F.when(F.col(ok), at)).alias("_s"), F.max(F.when(~F.col(ok), at)).alias("_f"))
    tail = log.join(last, keys)
    after_f = F.col(ok) & (F.col("_f").isNull() | (at > F.col("_f")))
    after_s = ~F.col(ok) & (F.col("_s").isNull() | (at > F.col("_s")))
    return tail.groupBy(*keys).agg(
        F.count_if(after_f).alias("consecutive_successes"), F.count_if(after_s).alias("consecutive_failures")
    )


def selector_state(log: DataFrame, keys: list[str], us: str, tie: str, success: Column, seconds: str, as_of_us: Column,
                   width: float = MINUTE) -> DataFrame:
    """Statistics and scores of every selector at ``as_of``."""
    base = log.withColumn("_ok", success)
    counts = base.groupBy(*keys).agg(
        F.count("*").alias("total_attempts"),
        F.count_if("_ok").alias("success_count"),
        F.min(us).alias("first_discovered"),
        F.max(us).alias("last_used"),
    )
    folded = half_mean_latency(base.where(F.col(seconds) > 0), keys, us, tie, seconds, width).drop("n")
    j = counts.join(end_streaks(base, keys, us, tie, "_ok"), keys).join(folded, keys, "left")
    return with_scores(j.withColumns({"usage_count": F.col("total_attempts"), "avg_seconds": F.col("half_mean")}).drop("half_mean"), as_of_us)


def with_scores(state: DataFrame, as_of_us: Column) -> DataFrame:
    """Success rate, confidence, reliability, and the reliable and stale flags."""
    n = F.col("total_attempts")
    rate = ratio(F.col("success_count"), n)
    one = F.lit(1.0)
    age = F.least(one, (as_of_us - F.col("first_discovered")) / F.lit(30.0 * DAY_US))
    confidence = (
        rate * 0.6 + F.least(one, F.col("consecutive_successes") / 10.0) * 0.2 + F.least(one, F.col("usage_count") / 100.0) * 0.1 + age * 0.1
    )
    steady = 1.0 - F.abs(F.col("consecutive_successes") - F.col("consecutive_failures")) / n
    reliability = F.when(n < RELIABLE_ATTEMPTS, 0.0).otherwise(rate * 0.7 + steady * 0.2 + F.least(one, n / 50.0) * 0.1)
    idle = (as_of_us - F.col("last_used")) / F.lit(float(DAY_US))
    return state.withColumns(
        {
            "success_rate": rate,
            "confidence_score": F.round(confidence, 9),
            "reliability_score": F.round(reliability, 9),
            "is_reliable": (rate >= RELIABLE_RATE) & (n >= RELIABLE_ATTEMPTS) & (F.col("consecutive_successes") >= RELIABLE_RUN),
            "is_stale": (idle > STALE_DAYS) & (rate < STALE_RATE),
        }
    )


def store_statistics(state: DataFrame, by: list[str]) -> DataFrame:
    """Per domain and field: selectors, reliable and stale ones, mean confidence and success rate."""
    return state.groupBy(*by).agg(
        F.count("*").alias("selectors"),
        F.count_if("is_reliable").alias("reliable"),
        F.count_if("is_stale").alias("stale"),
        steady_mean(F.col("confidence_score"), 9).alias("avg_confidence"),
        steady_mean(F.col("success_rate"), 9).alias("avg_success_rate"),
    )


def best_selectors(state: DataFrame, by: list[str], selector: str, n: int = 5, oldest_first: bool = True) -> DataFrame:
    """Best selectors per domain and field.

    Equal scores favour the selector used longest ago, as the original order does;
    ``oldest_first=False`` favours the most recent one. The limit applies before the shuffle.
    """
    age = F.asc("last_used") if oldest_first else F.desc("last_used")
    w = Window.partitionBy(*by).orderBy(F.desc("confidence_score"), F.desc("reliability_score"), age, selector)
    return state.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def reconcile(file_store: DataFrame, table_store: DataFrame, keys: list[str]) -> DataFrame:
    """Winner of every selector known to either store, with the reason.

    The newer use wins, then confidence, reliability, usage; the file store wins ties.
    """
    rest = [c for c in file_store.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    j = side(file_store, "f").join(side(table_store, "d"), keys, "full_outer")
    reason = F.when(F.col("d").isNull(), "file_only").when(F.col("f").isNull(), "db_only")
    for column, word in zip(STORE_COLUMNS, WIN_REASONS):
        f, d = (F.coalesce(F.col(f"{s}.{column}").cast("double"), F.lit(0.0)) for s in ("f", "d"))
        reason = reason.when(f > d, f"file_{word}").when(d > f, f"db_{word}")
    j = j.withColumn("reason", reason.otherwise("file_tiebreaker"))
    chosen = F.when(F.col("reason").startswith("file"), F.col("f")).otherwise(F.col("d"))
    return j.withColumn("_c", chosen).select(*keys, *[F.col(f"_c.{c}").alias(c) for c in rest], "reason")


def reconcile_report(reconciled: DataFrame, domain: str) -> DataFrame:
    """Per domain: one-sided, merged and won selectors, and what to do."""
    r = F.col("reason")
    a = reconciled.groupBy(domain).agg(
        F.count_if(r == "file_only").alias("file_only"),
        F.count_if(r == "db_only").alias("db_only"),
        F.count_if(~r.isin("file_only", "db_only")).alias("conflicts"),
        F.count_if(r.startswith("file_") & (r != "file_only")).alias("file_wins"),
        F.count_if(r.startswith("db_") & (r != "db_only")).alias("db_wins"),
    )
    both = (F.col("conflicts") > 0) | ((F.col("file_only") > 0) & (F.col("db_only") > 0))
    state = (
        F.when(F.col("conflicts") > 0, "conflicts").when(both, "synced").when(F.col("file_only") > 0, "file_only").otherwise("db_only")
    )
    advice = (
        F.when(state == "file_only", "migrate_to_table")
        .when(state == "db_only", "sync_to_file")
        .when(state == "synced", "in_sync")
        .when(F.col("file_wins") > F.col("db_wins"), "file_is_newer")
        .when(F.col("db_wins") > F.col("file_wins"), "table_is_newer")
        .otherwise("balanced")
    )
    return a.withColumns({"state": state, "advice": advice})


def reconcile_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("total_domains"),
        F.count_if(F.col("state") == "conflicts").alias("domains_with_conflicts"),
        F.count_if(F.col("state") == "file_only").alias("domains_file_only"),
        F.count_if(F.col("state") == "db_only").alias("domains_db_only"),
        F.count_if(F.col("state") == "synced").alias("domains_synced"),
        F.sum("conflicts").alias("total_conflicts"),
    )


def selector_chain(steps: list[DataFrame], by: list[str], selector: str = "selector", pos: str = "pos") -> DataFrame:
    """Selectors of several steps in step order without repeats; position in the chain per group.

    Selector lists are configuration (a handful per field), so the ranking window is small.
    """
    merged = None
    for i, s in enumerate(steps):
        t = s.select(*by, F.col(selector).alias("selector"), F.lit(i).alias("step"), F.col(pos).alias("pos"))
        merged = t if merged is None else merged.unionByName(t)
    first = merged.groupBy(*by, "selector").agg(F.min(F.struct("step", "pos")).alias("_o"))
    w = Window.partitionBy(*by).orderBy("_o", "selector")
    return first.select(*by, "selector", "_o.step", F.row_number().over(w).alias("position"))
