"""Jobs, pages, exports, tasks, runs: counters, roll-ups, lookups, retention, service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogwatch.functions.values import clean_text, ratio
from catalogwatch.operators.timeline import MICROS, MINUTE, trailing_time

# Permitted codes.
JOB_STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")
EXPORT_TYPES = ("full", "seo", "diff")
EXPORT_FORMATS = ("csv", "xlsx", "json")
# Site states of the summary.
STATUS_WORDS = {
    "ok": "ok", "ready": "ok", "success": "ok", "missing": "missing", "missing_export": "missing", "missing_map": "missing",
    "unknown": "missing", "pending": "missing", "error": "error", "failed": "error",
}
KEEP_JOBS = 10


def map_status(c: Column) -> Column:
    """Any status word as ok, missing or error."""
    t = F.lower(clean_text(c))
    out = None
    for target in ("ok", "missing", "error"):
        words = [w for w, v in STATUS_WORDS.items() if v == target]
        out = F.when(t.isin(*words), target) if out is None else out.when(t.isin(*words), target)
    return out.otherwise("missing")


def code_violations(rows: DataFrame, key: str, checks: dict[str, tuple[Column, tuple[str, ...]]]) -> DataFrame:
    """Rows whose code column holds a value outside its list."""
    bad = F.array_compact(
        F.array(*[F.when(~F.coalesce(c.isin(*allowed), F.lit(False)), F.lit(n)) for n, (c, allowed) in checks.items()])
    )
    return rows.select(F.col(key).alias("row_key"), F.explode(bad).alias("rule"))


def job_counters(pages: DataFrame, job: str, http_status: Column, error: Column, size: Column) -> DataFrame:
    """URLs, successes, failures and megabytes per job."""
    failed = is_failed_page(http_status, error)
    return pages.groupBy(job).agg(
        F.count("*").alias("total_urls"),
        F.count_if(~failed).alias("success_urls"),
        F.count_if(failed).alias("failed_urls"),
        F.round(F.sum(size.cast("bigint")) / (1024 * 1024), 2).alias("traffic_mb"),
    )


def is_failed_page(http_status: Column, error: Column) -> Column:
    """Answer of 400 and above, or an error class."""
    return F.coalesce(http_status >= 400, F.lit(False)) | error.isNotNull()


def job_results(products: DataFrame, job: str, variations: Column, failure: Column, elapsed: Column) -> DataFrame:
    """Products, variations, distinct failures and success flag per job."""
    a = products.groupBy(job).agg(
        F.count_if(failure.isNull()).alias("products_found"),
        F.coalesce(F.sum(F.when(failure.isNull(), variations)), F.lit(0)).cast("bigint").alias("variations_found"),
        F.count_distinct(failure).alias("distinct_failures"),
        F.max(elapsed).alias("response_time"),
    )
    return a.withColumn("success", F.col("products_found") > 0)


# End states of a site run.
FINISHED = ("completed", "failed", "skipped", "error")


def bulk_runs(sites: DataFrame, run: str) -> DataFrame:
    """Roll-up of site runs: capped progress, mean time left, final status.

    Input: processed, total, expected_total, percent, eta_seconds, status per site.
    """
    total = F.coalesce("total", "expected_total", F.lit(0))
    done = F.least(F.coalesce("processed", F.lit(0)), total)
    sized = total > 0
    part = F.when(sized, done).when(F.col("percent").isNotNull(), F.col("percent"))
    whole = F.when(sized, total).when(F.col("percent").isNotNull(), F.lit(100))
    a = sites.groupBy(run).agg(
        F.count("*").alias("sites"),
        F.coalesce(F.sum(F.when(sized, done)), F.lit(0)).alias("processed_urls"),
        F.coalesce(F.sum(F.when(sized, total)), F.lit(0)).alias("total_urls"),
        F.sum(part).alias("_part"),
        F.sum(whole).alias("_whole"),
        F.sum("eta_seconds").alias("_eta"),
        F.count("eta_seconds").alias("_etas"),
        F.min(F.col("status").isin(*FINISHED)).alias("_done"),
        F.max(F.col("status").isin("failed", "error")).alias("_bad"),
    )
    return a.select(
        run,
        "sites",
        "processed_urls",
        "total_urls",
        F.when(F.col("_whole") > 0, F.floor(F.col("_part") / F.col("_whole") * 100 + 0.5)).otherwise(F.lit(0)).cast("bigint").alias("progress_percent"),
        F.when(F.col("_etas") > 0, F.floor(F.col("_eta") / F.col("_etas") + 0.5)).cast("bigint").alias("eta_seconds"),
        F.when(~F.col("_done"), "running").when(F.col("_bad"), "failed").otherwise("completed").alias("status"),
    )


def task_statistics(tasks: DataFrame, status: Column, retries: Column, next_run: Column) -> DataFrame:
    """Task totals by state, mean retries, next planned run of an active task."""
    return tasks.agg(
        F.count("*").alias("total_tasks"),
        F.count_if(status == "active").alias("active_tasks"),
        F.count_if(status == "failed").alias("failed_tasks"),
        F.count_if(retries > 0).alias("tasks_with_retries"),
        ratio(F.sum(retries), F.count("*")).alias("avg_retry_count"),
        F.min(F.when(status == "active", next_run)).alias("next_scheduled_run"),
    )


def list_jobs(jobs: DataFrame, created: str, key: str, domain: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of the job list, newest first (filter reaches the scan; top-k before the final sort)."""
    rows = jobs.where(domain) if domain is not None else jobs
    return rows.orderBy(F.desc(created), F.desc(key)).offset(offset).limit(limit)


def newest_per_domain(jobs: DataFrame, domain: str, created: str, key: str, keep: int = KEEP_JOBS) -> DataFrame:
    """Retention: the newest ``keep`` jobs of each domain."""
    w = Window.partitionBy(domain).orderBy(F.desc(created), F.desc(key))
    return jobs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def within_age(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Retention by age."""
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(days=F.lit(days)))


def with_job(rows: DataFrame, jobs: DataFrame, job: str, columns) -> DataFrame:
    """Pages or exports with columns of their job."""
    return rows.join(jobs.select(job, *columns), job)


def audit_tail(audit: DataFrame, ts: str, key: str, n: int = 50) -> DataFrame:
    return audit.orderBy(F.desc(ts), F.desc(key)).limit(n)


# Service levels.
MAX_MEAN_LATENCY, MAX_P95_LATENCY, MIN_DIRECT_SHARE, MAX_TIMEOUT_SHARE = 30.0, 45.0, 0.95, 0.05


def service_levels(latency: DataFrame, by: str, shares: DataFrame) -> DataFrame:
    """One row per key and broken rule: mean latency, p95 latency, direct share, worst timeout share.

    ``latency``: key, mean, p95. ``shares``: key, direct_share, worst_timeout_share.
    """
    j = latency.join(shares, by)
    rules = {
        "mean_latency": (F.col("mean") > MAX_MEAN_LATENCY, F.col("mean")),
        "p95_latency": (F.col("p95") > MAX_P95_LATENCY, F.col("p95")),
        "direct_share": (F.col("direct_share") < MIN_DIRECT_SHARE, F.col("direct_share")),
        "timeout_share": (F.col("worst_timeout_share") > MAX_TIMEOUT_SHARE, F.col("worst_timeout_share")),
    }
    broken = F.array_compact(
        F.array(*[F.when(bad, F.struct(F.lit(n).alias("rule"), v.cast("double").alias("value"))) for n, (bad, v) in rules.items()])
    )
    return j.select(by, F.explode(broken).alias("_e")).select(by, "_e.rule", "_e.value")


def worst_window_share(log: DataFrame, key: str, us: str, tie: str, hit: Column, seconds: float, width: float = MINUTE) -> DataFrame:
    """Largest share of flagged rows over any trailing window, per key."""
    out = trailing_time(log, key, us, tie, seconds, {"_n": F.lit(1), "_hit": hit.cast("int")}, True, width)
    return out.groupBy(key).agg(F.max(ratio(F.col("_hit"), F.col("_n"))).alias("worst_share"))


# --- exports -------------------------------------------------------------------------------------


def elapsed_label(seconds: Column) -> Column:
    """Time between two exports as hours and days."""
    s = F.abs(seconds)
    return F.format_string("%.1f h / %.2f d", s / 3600.0, s / 86400.0)


def export_gap(current: DataFrame, previous: DataFrame, us: str) -> DataFrame:
    """Newest fetch time of each export and the time between them."""
    a = current.agg(F.max(us).alias("current_us")).withColumn("previous_us", previous.agg(F.max(us)).scalar())
    return a.withColumn("elapsed", elapsed_label((F.col("current_us") - F.col("previous_us")) / F.lit(float(MICROS))))


def map_state(modified_us: Column, as_of_us: Column, days: int = 7) -> Column:
    """available / outdated / missing by age of the newest URL map."""
    return F.when(modified_us.isNull(), "missing").when(as_of_us - modified_us <= days * 86400 * MICROS, "available").otherwise("outdated")


def site_states(sites: DataFrame, map_us: str, export_us: str, as_of_us: Column, days: int = 7) -> DataFrame:
    """Map and export state per site."""
    m = map_state(F.col(map_us), as_of_us, days)
    export = F.when(F.col(export_us).isNull(), "missing_export").when(F.col(map_us).isNull(), "missing_map").otherwise("ready")
    return sites.withColumns({"map_status": m, "export_status": export})


# Planning presets per site (minutes, usual number of URLs), rate where none is known.
DEFAULT_RATE = 240.0
DEFAULT_MINUTES, DEFAULT_URLS = 45, 1000
SITE_PRESETS = {
    "atmospherestore.ru": (45, 970),
    "sittingknitting.ru": (35, 680),
    "mpyarn.ru": (40, 900),
    "ili-ili.com": (50, 5600),
    "knitshop.ru": (20, 450),
    "triskeli.ru": (30, 1200),
    "6wool.ru": (25, 800),
}


def presets(spark, rows: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Preset table: site, minutes, usual_urls."""
    data = [(k, m, u) for k, (m, u) in (rows or SITE_PRESETS).items()]
    return spark.createDataFrame(data, "site string, minutes int, usual_urls int")


def duration_estimate(sites: DataFrame, preset: DataFrame, site: str, urls: str) -> DataFrame:
    """Seconds a run will take, from URL count and rate, else from the preset, with a label code.

    The presets are joined as the engine sees fit: a caller's table may be of any size.
    """
    j = sites.join(preset.withColumnRenamed("site", site), site, "left")
    known = F.col("minutes").isNotNull()
    usual = F.coalesce("usual_urls", F.lit(DEFAULT_URLS))
    explicit = F.when(F.col(urls) > 0, F.floor(F.col(urls) + 0.5))
    count = F.coalesce(explicit, usual).cast("bigint")
    rate = F.when(known, usual / F.col("minutes")).otherwise(F.lit(DEFAULT_RATE))
    seconds = F.floor(count / rate * 60 + 0.5).cast("bigint")
    return j.select(
        *sites.columns,
        count.alias("url_count"),
        seconds.alias("duration_seconds"),
        duration_label(seconds).alias("duration_label"),
        F.when(explicit.isNotNull(), "map").otherwise("preset").alias("source"),
    )


def duration_label(seconds: Column) -> Column:
    """Approximate duration: seconds, minutes, or hours and minutes."""
    total = F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5))
    hours, minutes = F.floor(total / 60), total % 60
    text = lambda c: c.cast("string")
    return (
        F.when(seconds <= 0, F.lit("≈1 минута"))
        .when(seconds < 60, F.concat(F.lit("≈"), text(seconds), F.lit(" с")))
        .when(total < 60, F.concat(F.lit("≈"), text(total), F.lit(" минут")))
        .when(minutes == 0, F.concat(F.lit("≈"), text(hours), F.lit(" ч")))
        .otherwise(F.concat(F.lit("≈"), text(hours), F.lit(" ч "), text(minutes), F.lit(" мин")))
    )


def numbered_pages(pages: DataFrame, job: str, *order: str, name: str = "place", cell: Column | None = None) -> DataFrame:
    """Pages with their place (from 1) in the order of their job: by fetch time, or by address for a product list.

    Where only the first pages are wanted, filter on the place: the engine then cuts each job before its shuffle. ``cell`` cuts the
    order of a job into stretches, so that a job of very many pages isn't one task: it never falls along the order (a day of
    the fetch time, the beginning of the address). Stretches are counted, and a page's place is that in its stretch behind all
    stretches before.
    """
    from pyspark.sql import Window

    if cell is None:
        return pages.withColumn(name, F.row_number().over(Window.partitionBy(job).orderBy(*order)))
    cut = pages.withColumn("_cell", cell)
    counts = cut.groupBy(F.col(job).alias("_job"), F.col("_cell").alias("_at")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_job").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_job", "_at", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(job, "_cell").orderBy(*order))
    met = cut.withColumn("_own", own).join(before, F.col(job).eqNullSafe(F.col("_job")) & F.col("_cell").eqNullSafe(F.col("_at")))
    return met.select(*pages.columns, (F.col("_before") + F.col("_own")).alias(name))
