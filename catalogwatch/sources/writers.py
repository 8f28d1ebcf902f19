"""Sinks. Every write is a plain Spark write, so a lost executor only repeats its own tasks. Upserts and payloads: ``versions``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.functions.values import first_text, fields_of


def with_decimal_comma(df: DataFrame) -> DataFrame:
    """Fractional columns as text with a decimal comma."""
    cols = [
        F.replace(F.col(f.name).cast("string"), F.lit("."), F.lit(",")).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, sep: str = ";", decimal_comma: bool = True, mode: str = "overwrite") -> None:
    """``full`` / ``seo`` / ``diff`` table as UTF-8 CSV with a header."""
    out = with_decimal_comma(df) if decimal_comma else df
    out.write.mode(mode).option("header", True).option("sep", sep).option("encoding", "UTF-8").option(
        "escape", '"'
    ).csv(path)


def manifest_rows(parts: dict[str, DataFrame], generated_at: Column) -> DataFrame:
    """One row per written table: name, row count, time."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", generated_at.alias("generated_at"))
        out = row if out is None else out.unionByName(row)
    return out


def append_manifest(parts: dict[str, DataFrame], path: str, generated_at: Column) -> None:
    manifest_rows(parts, generated_at).write.mode("append").parquet(path)


def append_history(products: DataFrame, path: str) -> None:
    """Product history, partitioned by site and crawl day."""
    day = F.to_date(F.coalesce(F.col("fetched_at"), F.col("scraped_at")))
    products.withColumn("crawl_date", day).repartition("site_domain", "crawl_date", F.pmod(F.xxhash64("url"), F.lit(32))).write.mode(
        "append"
    ).partitionBy("site_domain", "crawl_date").parquet(path)


PAGE_DEFAULTS = {"bytes_in": 0, "retry_count": 0}
PAGE_COLUMNS = (
    "job_id", "url", "final_url", "http_status", "title", "h1", "content_hash", "bytes_in", "data_full", "data_seo",
    "error_class", "error_message", "retry_count", "strategy_used", "proxy_used",
)


def page_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ready for the page table (defaults filled), and rows refused for want of a URL."""
    have = set(results.columns)
    cols = []
    for c in PAGE_COLUMNS:
        col = F.col(c) if c in have else F.lit(None)
        cols.append((F.coalesce(col, F.lit(PAGE_DEFAULTS[c])) if c in PAGE_DEFAULTS else col).alias(c))
    ok = first_text(fields_of(results), "url").isNotNull()
    return results.where(ok).select(*cols), results.where(~ok)


def replace_domain(summary: DataFrame, rows: DataFrame, on: str = "domain") -> DataFrame:
    """Summary table with the rows of some domains replaced."""
    kept = summary.join(rows.select(on).distinct(), on, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


# Named export periods in seconds.
PERIODS = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000}


def event_export(events: DataFrame, ts: str, kind: str, as_of: Column, period: str = "24h") -> DataFrame:
    """Events of a period as time, type and JSON payload; unknown periods mean a day."""
    seconds = PERIODS.get(period, 86400)
    start = as_of - F.make_dt_interval(secs=F.lit(float(seconds)))
    return events.where((F.col(ts) > start) & (F.col(ts) <= as_of)).select(
        F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col(kind).alias("event_type"),
        F.to_json(F.struct(*events.columns)).alias("event_data"),
    )


def failure_rows(failed: DataFrame, as_of: Column, domain: str = "site_domain", url: str = "url") -> DataFrame:
    """Placeholder products for pages that could not be fetched."""
    have = set(failed.columns)
    pick = lambda c: F.col(c) if c in have else F.lit(None)
    none_text = F.lit(None).cast("string")
    return failed.select(
        F.col(url).alias("url"),
        F.coalesce(pick("original_url").cast("string"), F.col(url)).alias("original_url"),
        F.col(domain).alias("site_domain"),
        none_text.alias("name"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("double").alias("base_price"),
        none_text.alias("currency"),
        F.lit(0.0).alias("stock"),
        F.lit(0.0).alias("stock_quantity"),
        F.lit(False).alias("in_stock"),
        F.coalesce(pick("error").cast("string"), F.lit("unavailable")).alias("error"),
        pick("status_code").cast("int").alias("status_code"),
        as_of.cast("string").alias("scraped_at"),
    )


def write_url_cache(urls: DataFrame, path: str) -> None:
    """The URL cache and its products-only part as text."""
    from catalogwatch.operators.urlsets import cache_outputs

    everything, products = cache_outputs(urls)
    everything.select("url").write.mode("overwrite").text(path)
    products.select("url").write.mode("overwrite").text(f"{path}_products")
