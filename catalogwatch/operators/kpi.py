"""Counters, quality figures and top lists over a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.functions.values import (
    fields_of,
    first_parsed_number,
    half_up,
    percent,
    ratio,
    steady_mean,
    struct_fields,
    to_number_lenient,
)
from catalogwatch.operators.catalogue import ALL_STOCK_KEYS, is_excluded_item, is_excluded_product

PRODUCT_STOCK_KEYS = ("stock_quantity", "stock", "inventory", "available", "quantity")
KPI_COLUMNS = (
    "products", "products_with_price", "products_with_stock_field", "products_in_stock_true", "products_total_stock",
    "products_with_variations", "total_variations", "variations_total_stock", "variations_in_stock_true",
)
UNKNOWN = -1.0


def lenient_stock(fields) -> Column:
    """First of the ten stock keys that reads as a number."""
    parts = [to_number_lenient(fields[n][0]) for n in ALL_STOCK_KEYS if n in fields]
    return F.coalesce(*parts) if parts else F.lit(None).cast("double")


def _variation_measures(fields, lenient: bool) -> dict[str, Column]:
    stock = lenient_stock(fields) if lenient else first_parsed_number(fields, "stock")
    flag = fields["in_stock"][0] if "in_stock" in fields else F.lit(None).cast("boolean")
    return {"stock": F.coalesce(stock, F.lit(0.0)), "hit": F.coalesce(flag, F.lit(False)).cast("bigint")}


def roll_variations(variations: DataFrame, on: str, lenient: bool = False) -> DataFrame:
    """Per product: number, stock, available ones (map-side combined)."""
    fields = fields_of(variations)
    m = _variation_measures(fields, lenient)
    aggs = [
        F.count("*").alias("v_count"),
        F.sum(m["stock"]).alias("v_stock"),
        F.sum(m["hit"]).alias("v_hits"),
    ]
    if lenient:
        aggs.append(F.max(is_excluded_item(fields)).alias("v_excluded"))
    return variations.groupBy(on).agg(*aggs)


def with_rolled(products: DataFrame, variations: DataFrame, on: str, lenient: bool = False) -> DataFrame:
    return products.join(roll_variations(variations, on, lenient), on, "left")


def with_nested_roll(products: DataFrame, lenient: bool = False) -> DataFrame:
    """Same columns from the in-row ``variations`` array."""
    kind: T.StructType = products.schema["variations"].dataType.elementType
    arr = F.filter("variations", lambda v: v.isNotNull()) if lenient else F.col("variations")

    def total(key: str, zero: Column) -> Column:
        return F.aggregate(arr, zero, lambda acc, v: acc + _variation_measures(struct_fields(v, kind), lenient)[key])

    cols = {
        "v_count": F.when(F.size(arr) > 0, F.size(arr).cast("bigint")),
        "v_stock": total("stock", F.lit(0.0)),
        "v_hits": total("hit", F.lit(0).cast("bigint")),
    }
    if lenient:
        cols["v_excluded"] = is_excluded_product({"variations": fields_of(products)["variations"]})
    return products.withColumns(cols)


def _kpi_aggs(price: Column, stock: Column, flag: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.count("*").alias("products"),
        F.count(price).alias("products_with_price"),
        F.count(stock).alias("products_with_stock_field"),
        F.count_if(F.coalesce(flag, F.lit(False))).alias("products_in_stock_true"),
        F.round(F.coalesce(F.sum(stock), zero), 2).alias("products_total_stock"),
        F.count_if(F.col("v_count") > 0).alias("products_with_variations"),
        F.coalesce(F.sum("v_count"), F.lit(0)).cast("bigint").alias("total_variations"),
        F.round(F.coalesce(F.sum("v_stock"), zero), 2).alias("variations_total_stock"),
        F.coalesce(F.sum("v_hits"), F.lit(0)).cast("bigint").alias("variations_in_stock_true"),
    ]


def catalogue_kpis(rolled: DataFrame, by: str, exclude_unknown: bool = False) -> DataFrame:
    """Nine counters per site over every product.

    The stock sentinel -1 is added as it stands; ``exclude_unknown`` leaves it out of the sum.
    """
    fields = fields_of(rolled)
    stock = first_parsed_number(fields, *PRODUCT_STOCK_KEYS)
    if exclude_unknown:
        stock = F.when(stock != UNKNOWN, stock)
    flag = fields["in_stock"][0] if "in_stock" in fields else F.lit(None).cast("boolean")
    return rolled.groupBy(by).agg(*_kpi_aggs(F.col("price"), stock, flag))


def shop_goods_kpis(rolled: DataFrame, by: str) -> DataFrame:
    """The same counters after bulk and digital goods are left out, with ten stock keys."""
    own = {k: v for k, v in fields_of(rolled).items() if k != "variations"}
    keep = ~(is_excluded_item(own) | F.coalesce(F.col("v_excluded"), F.lit(False)))
    flag = own["in_stock"][0] if "in_stock" in own else F.lit(None).cast("boolean")
    aggs = _kpi_aggs(to_number_lenient(F.col("price")), lenient_stock(own), flag)
    return rolled.where(keep).groupBy(by).agg(*aggs)


def summary_totals(sites: DataFrame) -> DataFrame:
    """Totals over the site summary, mean success rate over sites that have one."""
    return sites.agg(
        F.count("*").alias("total_sites"),
        F.coalesce(F.sum("products"), F.lit(0)).alias("total_products"),
        F.coalesce(F.sum("products_with_price"), F.lit(0)).alias("total_products_with_price"),
        F.round(F.coalesce(F.sum("products_total_stock"), F.lit(0.0)), 2).alias("total_stock"),
        F.coalesce(F.sum("total_variations"), F.lit(0)).alias("total_variations"),
        F.nullif(F.coalesce(F.sum("products_with_variations"), F.lit(0)), F.lit(0)).alias("total_products_with_variations"),
        steady_mean(F.col("success_rate"), 9).alias("average_success_rate"),
        F.max("updated_at").alias("generated_at"),
    )


def weighted_success(sites: DataFrame) -> DataFrame:
    """Success rate weighted by products; priced share where no site reports a rate."""
    rate = F.when(F.col("products") > 0, F.col("success_rate") * F.col("products"))
    a = sites.agg(
        F.coalesce(F.sum("products"), F.lit(0)).cast("bigint").alias("total_requests"),
        F.coalesce(F.sum("products_with_price"), F.lit(0)).cast("bigint").alias("successful_requests"),
        F.coalesce(F.sum(rate), F.lit(0.0)).alias("_w"),
        F.max("updated_at").alias("updated_at"),
    )
    n = F.col("total_requests")
    value = F.when(n == 0, F.lit(0.0)).when(F.col("_w") != 0, ratio(F.col("_w"), n)).otherwise(
        percent(F.col("successful_requests"), n)
    )
    return a.select("total_requests", "successful_requests", F.round(value, 2).alias("success_rate"), "updated_at")


def configured_sites(domains: DataFrame, summary: DataFrame, on: str) -> DataFrame:
    """Every configured site; those without an export become zero rows marked missing."""
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in KPI_COLUMNS]
    return domains.select(on).distinct().join(summary.withColumn("_have", F.lit(True)), on, "left").select(
        on, *zero, F.when(F.col("_have"), F.lit("ok")).otherwise(F.lit("missing")).alias("status")
    )


# Columns probed for price and stock in a flat export.
EXPORT_PRICE_COLUMNS = ("variation_price", "price", "base_price")
EXPORT_STOCK_COLUMNS = ("variation_stock", "stock", "total")


def export_quality(full: DataFrame) -> DataFrame:
    """Row, URL and variation counts, missing and non-positive price and stock."""
    names = set(full.columns)

    def pick(cols) -> Column:
        found = [F.col(c) for c in cols if c in names]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    price, stock = pick(EXPORT_PRICE_COLUMNS), pick(EXPORT_STOCK_COLUMNS)
    is_variation = (F.lower("row_type") == "variation") if "row_type" in names else F.lit(True)
    a = full.agg(
        F.count("*").alias("rows"),
        F.count_distinct("url").alias("unique_products"),
        F.count_if(is_variation).alias("variation_rows"),
        F.count_if(price.isNull()).alias("price_missing"),
        F.count_if(F.coalesce(price, F.lit(0.0)) <= 0).alias("price_zero"),
        F.count_if(stock.isNull()).alias("stock_missing"),
        F.count_if(F.coalesce(stock, F.lit(0.0)) <= 0).alias("stock_zero"),
    )
    shares = {f"{c}_pct": F.round(percent(F.col(c), F.col("rows")), 2) for c in
              ("price_missing", "price_zero", "stock_missing", "stock_zero")}
    return a.withColumns(shares)


def quality_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Current minus baseline, one row per figure (two one-row inputs, unpivoted and joined)."""

    def long(q: DataFrame, name: str) -> DataFrame:
        cast = q.select(*[F.col(c).cast("double") for c in q.columns])
        return cast.unpivot([], list(q.columns), "figure", name)

    pair = long(current, "cur").join(long(baseline, "base"), "figure", "left")
    return pair.select("figure", F.round(F.col("cur") - F.coalesce("base", F.lit(0.0)), 2).alias("delta"))


def kpi_sheet(full: DataFrame) -> DataFrame:
    """Items, unique URLs, total stock, total stock value."""
    return full.agg(
        F.count("*").alias("items"),
        F.count_distinct("url").alias("unique_urls"),
        F.round(F.sum("stock"), 2).alias("total_stock"),
        F.round(F.sum("stock_value"), 2).alias("total_stock_value"),
    )


def top_stock_value(full: DataFrame, n: int = 20) -> DataFrame:
    """Items with the highest stock value (top-k per partition, then merged)."""
    return full.where(F.col("stock_value").isNotNull()).orderBy(F.desc("stock_value"), "url", "variation_id").limit(n)


def top_sites(summary: DataFrame, on: str, n: int = 5) -> DataFrame:
    return summary.orderBy(F.desc("products"), on).limit(n)


def sites_with_issues(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("status") != "ok")


# --- variations ---------------------------------------------------------------------------------


def variation_summary(variations: DataFrame, by: str) -> DataFrame:
    """Per product: counts, price range and number of variations per type.

    Types are counted first (partial sums per product and type), so the second step only
    meets one row per type.
    """
    price, stock = F.col("price"), F.col("stock")
    per_type = variations.groupBy(by, F.coalesce("type", F.lit("unknown")).alias("_type")).agg(
        F.count("*").alias("_n"),
        F.count_if(stock > 0).alias("_in"),
        F.sum(price).alias("_sum"),
        F.count(price).alias("_priced"),
        F.min(price).alias("_min"),
        F.max(price).alias("_max"),
    )
    zero = F.lit(0.0)
    return per_type.groupBy(by).agg(
        F.sum("_n").alias("total_variations"),
        F.sum("_in").alias("in_stock_count"),
        (F.sum("_n") - F.sum("_in")).alias("out_of_stock_count"),
        half_up(ratio(F.round(F.sum("_sum"), 2), F.sum("_priced")), 2).alias("average_price"),
        F.coalesce(F.min("_min"), zero).alias("min_price"),
        F.coalesce(F.max("_max"), zero).alias("max_price"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_type", "_n")))).alias("type_distribution"),
    )


def variation_types(variations: DataFrame, by: str) -> DataFrame:
    """Per product and type: count, share, price range, stock."""
    price, stock = F.col("price"), F.col("stock")
    per_type = variations.groupBy(by, F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        F.count("*").alias("n"),
        steady_mean(price).alias("avg_price"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.sum(stock).alias("total_stock"),
        steady_mean(stock).alias("avg_stock"),
    )
    totals = per_type.groupBy(by).agg(F.sum("n").alias("_all"))
    return per_type.join(totals, by).withColumn("share_pct", percent(F.col("n"), F.col("_all"))).drop("_all")


def product_statistics(products: DataFrame, variations: DataFrame, on: str) -> DataFrame:
    """Per product: own price and stock next to the spread over its variations."""
    rolled = variations.groupBy(on).agg(
        F.count("*").alias("variation_count"),
        F.min("price").alias("min_variation_price"),
        F.max("price").alias("max_variation_price"),
        steady_mean(F.col("price")).alias("avg_variation_price"),
        F.coalesce(F.sum("stock"), F.lit(0.0)).alias("total_variation_stock"),
        F.coalesce(steady_mean(F.col("stock")), F.lit(0.0)).alias("avg_variation_stock"),
    )
    out = products.join(rolled, on, "left")
    count = F.coalesce("variation_count", F.lit(0))
    return out.withColumns({"variation_count": count, "has_variations": count > 0})
