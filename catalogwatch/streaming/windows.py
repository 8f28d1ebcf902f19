"""Event-time streams made of built-in operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogwatch.functions.values import ratio
from catalogwatch.operators.snapshots import latest_per_url, snapshot_diff, upsert_snapshots
from catalogwatch.streaming.machines import MICROS
from catalogwatch.streaming.ordered import MovingBaseline, run_ordered


def progress_rollup(events: DataFrame, run) -> DataFrame:
    """Per run: processed, successes, failures, total, percent (update mode)."""
    run = [run] if isinstance(run, str) else list(run)
    a = events.groupBy(*run).agg(
        F.max("current").alias("processed"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failed_count"),
        F.max("total").alias("total"),
        F.max("ts").alias("last_event_at"),
    )
    share = F.least(F.lit(100.0), F.greatest(F.lit(0.0), ratio(F.col("processed") * 100, F.col("total"))))
    return a.withColumn("percent", share)


def tumbling_counts(events: DataFrame, ts: str, kind: str, every: str, late: str) -> DataFrame:
    """Events per type and interval (append mode: an interval appears once it is closed)."""
    a = events.withWatermark(ts, late).groupBy(F.window(ts, every), kind).agg(F.count("*").alias("n"), F.sum("latency").alias("latency_sum"))
    return a.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", F.round("latency_sum", 2).alias("latency_sum"))


def rate_alerts(events: DataFrame, ts: str, key: str, length: str, slide: str, late: str, failure: float, block: float, captcha: float, slow: float) -> DataFrame:
    """Sliding windows whose failure, block or captcha share, or slowest answer, is above its limit."""
    a = events.withWatermark(ts, late).groupBy(F.window(ts, length, slide), key).agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if("blocked").alias("blocked_n"),
        F.count_if("captcha").alias("captcha_n"),
        F.max("latency").alias("slowest"),
    )
    n = F.col("n")
    alerts = F.array_compact(
        F.array(
            F.when((n >= 10) & (F.col("failed") / n > failure), F.lit("high_failure_rate")),
            F.when((n >= 5) & (F.col("blocked_n") / n > block), F.lit("high_block_rate")),
            F.when((n >= 5) & (F.col("captcha_n") / n > captcha), F.lit("high_captcha_rate")),
            F.when(F.col("slowest") > slow, F.lit("slow_response")),
        )
    )
    return a.select(F.col("window.start").alias("start"), key, "n", F.array_join(alerts, ",").alias("alerts")).where(F.col("alerts") != "")


def request_sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions split by idle gaps."""
    a = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("requests"), F.count_if("success").alias("successes"))
    return a.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "requests", "successes")


def dedupe_urls(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """First sight of each URL within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def snapshot_keeper(base: str, diff_out: str, order):
    """``foreachBatch`` body: diff each micro-batch against the snapshot table and fold it in.

    Table versions and diffs are named by the batch number, so a repeated batch rewrites its own output.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{base}/version={number}")
        fresh = latest_per_url(batch, order)
        seen = old.join(fresh.select("url"), "url", "left_semi")
        snapshot_diff(seen, fresh, order).write.mode("overwrite").parquet(f"{diff_out}/batch={number}")
        upsert_snapshots(old, fresh.select(*old.columns), "url", order).write.mode("overwrite").parquet(f"{base}/version={number + 1}")

    return keep


def moving_alerts(
    events: DataFrame, ts: str, scope: str, length: int, slide: int, late: str, back: int, errors: Column, limited: Column,
    max_error_share: float, factor: float,
) -> DataFrame:
    """Sliding windows with too many errors, or with ``factor`` times the mean rate-limit answers of the ``back`` windows before.

    Two stateful operators in one query: the windows, and per scope the counts of the last ones. Lengths are in seconds.
    """
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, f"{length} seconds", f"{slide} seconds"), scope).agg(
        F.count("*").alias("n"), F.count_if(errors).alias("errors"), F.count_if(limited).alias("limited")
    )
    # A window's time is its last microsecond: it falls into the cell that ends with the window.
    end = F.unix_micros("window.end")
    closed = counts.select(F.window_time("window").alias("ts"), end.alias("id"), (end - 1).alias("us"), scope, "n", "errors", "limited")
    rules = {"back_us": back * slide * MICROS, "max_error_share": max_error_share, "factor": factor}
    out = run_ordered(closed, MovingBaseline, scope, None, slide, **rules)
    return out.select(scope, F.timestamp_micros(F.col("id") - length * MICROS).alias("start"), "n", "baseline", "alerts")


# Error share and rate-limit growth that raise an alert.
MAX_ERROR_SHARE, SPIKE_FACTOR = 0.05, 3


def spike_alerts(counts: DataFrame, start: str, seconds: int, errors: Column, limited: Column, n: str = "n") -> DataFrame:
    """Windows with too many errors, or with three times the rate-limit answers of the window before.

    ``counts`` holds one row per window, kind and count; the baseline is the previous window,
    found with an equi-join on its start.
    """
    a = counts.groupBy(start).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(errors, F.col(n)).otherwise(0)).alias("errors"),
        F.sum(F.when(limited, F.col(n)).otherwise(0)).alias("limited"),
    )
    before = a.select((F.col(start) + F.make_dt_interval(secs=F.lit(float(seconds)))).alias(start), F.col("limited").alias("baseline"))
    j = a.join(before, start, "left")
    alerts = F.array_compact(
        F.array(
            F.when(F.col("errors") / F.col("n") > MAX_ERROR_SHARE, F.lit("error_rate")),
            F.when(F.col("limited") > F.col("baseline") * SPIKE_FACTOR, F.lit("limit_spike")),
        )
    )
    return j.withColumn("alerts", F.array_join(alerts, ",")).where(F.col("alerts") != "")
