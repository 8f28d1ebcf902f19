"""Nested or relational product data -> flat ``full`` and ``seo`` tables, and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.functions import goods
from catalogwatch.functions.values import (
    any_of,
    as_text,
    clean_text,
    fields_of,
    first_number,
    first_text,
    has_value,
    struct_fields,

    to_number_lenient,
    to_whole,
)

TEXT, NUMERIC = "string", "double"

# The output tables.
FULL_COLUMNS = {
    "url": TEXT, "final_url": TEXT, "http_status": "int", "fetched_at": TEXT, "title": TEXT, "h1": TEXT,
    "price": NUMERIC, "stock": NUMERIC, "stock_value": NUMERIC, "currency": TEXT, "availability": TEXT,
    "sku": TEXT, "brand": TEXT, "category": TEXT, "breadcrumbs": TEXT, "images": TEXT, "attrs_json": TEXT,
    "text_hash": TEXT, "variation_id": TEXT, "variation_sku": TEXT, "variation_type": TEXT,
    "variation_value": TEXT, "variation_price": NUMERIC, "variation_stock": NUMERIC,
    "variation_in_stock": "boolean", "variation_attributes": TEXT,
}
SEO_COLUMNS = (
    "url", "fetched_at", "title", "meta_description", "h1", "og_title", "og_description", "og_image",
    "twitter_title", "twitter_description", "canonical", "robots", "hreflang", "images_alt_joined",
)
FETCH_KEYS = ("fetched_at", "scraped_at", "collected_at", "timestamp")
VARIATION_OUT = [c for c in FULL_COLUMNS if c.startswith("variation_")]


def _fixed(df: DataFrame, keep=()) -> DataFrame:
    """Pad and order to the fixed column list, then the carried columns."""
    have = set(df.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in FULL_COLUMNS.items()]
    return df.select(*cols, *[F.col(k) for k in keep])


def _base_columns(fields, price: Column, any_variation) -> dict[str, Column]:
    price = F.round(price, 2)
    stock = F.round(goods.stock_of(fields), 3)
    return {
        "url": clean_text(fields["url"][0]),
        "final_url": first_text(fields, "final_url", "resolved_url", "canonical_url"),
        "http_status": to_whole(first_text(fields, "http_status", "status_code")).cast("int"),
        "fetched_at": first_text(fields, *FETCH_KEYS),
        "title": first_text(fields, "title", "name"),
        "h1": first_text(fields, "h1", "seo_h1"),
        "price": price,
        "stock": stock,
        "currency": first_text(fields, "currency", "price_currency", "currency_code"),
        "availability": goods.availability(fields, any_variation),
        "sku": first_text(fields, "sku", "article", "product_id", "id"),
        "brand": first_text(fields, "brand", "manufacturer"),
        "category": goods.category_of(fields),
        "breadcrumbs": goods.breadcrumbs_of(fields),
        "images": goods.images_of(fields),
        "attrs_json": goods.attributes_json(fields),
        "text_hash": first_text(fields, "text_hash", "content_hash", "body_hash"),
    }


def _variation_columns(fields) -> dict[str, Column]:
    flag = F.lit(None).cast("boolean")
    for n in ("in_stock", "variation_in_stock"):
        if n in fields:
            flag = F.coalesce(fields[n][0].cast("boolean"), flag)
    attrs = F.lit(None).cast("string")
    for n in ("attributes", "variation_attributes"):
        if n in fields:
            c, kind = fields[n]
            attrs = F.coalesce(F.when(has_value(c, kind), as_text(c, kind)), attrs)
    return {
        "variation_id": first_text(fields, "variation_id", "variant_id"),
        "variation_sku": first_text(fields, "variation_sku", "sku"),
        "variation_type": first_text(fields, "variation_type", "type"),
        "variation_value": first_text(fields, "variation_value", "value"),
        "variation_price": F.round(first_number(fields, *goods.VARIATION_PRICE_KEYS), 2),
        "variation_stock": F.round(first_number(fields, *goods.VARIATION_STOCK_KEYS), 3),
        "variation_in_stock": F.coalesce(flag, F.lit(False)),
        "variation_attributes": attrs,
    }


def _with_overrides(df: DataFrame) -> DataFrame:
    """Variation price and stock replace the product's own where present."""
    df = df.withColumns(
        {"price": F.coalesce("variation_price", "price"), "stock": F.coalesce("variation_stock", "stock")}
    )
    return df.withColumn("stock_value", goods.stock_value(F.col("price"), F.col("stock")))


def full_rows(products: DataFrame, keep=()) -> DataFrame:
    """One row per variation of a nested product record, one base row when it has none."""
    fields = fields_of(products)
    base = _base_columns(fields, goods.effective_price(fields), None)
    kind = fields.get("variations", (None, None))[1]
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
    arr = F.filter(F.col("variations"), lambda v: v.isNotNull()) if nested else F.lit(None)
    out = products.select(*[c.alias(n) for n, c in base.items()], arr.alias("_vs"), *[F.col(k).alias(k) for k in keep])
    out = out.where(F.col("url").isNotNull())
    if nested:
        out = out.withColumn("_v", F.explode_outer("_vs"))
        cols = _variation_columns(struct_fields(F.col("_v"), kind.elementType))
        out = out.withColumns({n: F.when(F.col("_v").isNotNull(), c) for n, c in cols.items()})
    else:
        out = out.withColumns({n: F.lit(None).cast(FULL_COLUMNS[n]) for n in VARIATION_OUT})
    return _fixed(_with_overrides(out), keep)


def full_rows_joined(products: DataFrame, variations: DataFrame, on: str, order: str, keep=()) -> DataFrame:
    """``full_rows`` for products and variations held in two tables.

    No variation list is ever gathered: what a product needs from its variations
    (first priced one, any available) is a partial aggregate, and the variation rows meet
    their product in an inner join, whose hot keys the engine may split on either side.
    """
    vf = fields_of(variations)
    priced = [has_value(*vf[n]) for n in goods.VARIATION_PRICE_FIRST if n in vf]
    first_price = F.min_by(
        F.struct(first_number(vf, *goods.VARIATION_PRICE_FIRST).alias("p")),
        F.when(any_of(priced), F.col(order)),
    )
    rolled = variations.groupBy(on).agg(
        first_price.alias("_first"), F.max(goods.variation_available(vf)).alias("_any")
    )
    pf = fields_of(products)
    joined = products.join(rolled, on, "left")
    price = F.when(F.col("_first").isNotNull(), F.col("_first.p")).otherwise(goods.price_of(pf))
    base_cols = _base_columns(pf, price, F.col("_any"))
    base = joined.select(
        *[c.alias(n) for n, c in base_cols.items()], F.col(on).alias("_key"), F.col("_any"), *[F.col(k) for k in keep if k != on]
    ).where(F.col("url").isNotNull())
    rows = variations.select(F.col(on).alias("_key"), *[c.alias(n) for n, c in _variation_columns(vf).items()])
    with_rows = base.where(F.col("_any").isNotNull()).join(rows, "_key")
    bare = base.where(F.col("_any").isNull())
    out = with_rows.unionByName(bare, allowMissingColumns=True)
    if on in keep:
        out = out.withColumn(on, F.col("_key"))
    return _fixed(_with_overrides(out), keep)


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """First row per key by an explicit order, as an aggregate (no per-key sort)."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """Last row per key by an explicit order."""
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys, order, fn) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(fn(F.struct(*rest), by).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def seo_rows(products: DataFrame, order, keep=()) -> DataFrame:
    """One SEO row per URL; the first record of a URL by ``order`` wins."""
    fields = fields_of(products)

    def block(names, keys) -> Column:
        out = F.lit(None).cast("string")
        for n in reversed(names):
            if n not in fields:
                continue
            c, kind = fields[n]
            if isinstance(kind, T.MapType):
                value = F.coalesce(*[clean_text(c[k]) for k in keys])
            elif isinstance(kind, T.StructType):
                value = first_text(struct_fields(c, kind), *keys)
            else:
                continue
            out = F.when(c.isNotNull(), value).otherwise(out)
        return out

    og, tw = ("open_graph", "og", "og_data"), ("twitter", "twitter_card", "twitter_data")
    cols = {
        "url": clean_text(F.col("url")),
        "fetched_at": first_text(fields, *FETCH_KEYS),
        "title": first_text(fields, "seo_title", "title", "name"),
        "meta_description": first_text(fields, "seo_meta_description", "meta_description"),
        "h1": first_text(fields, "seo_h1", "h1"),
        "og_title": F.coalesce(first_text(fields, "og_title"), block(og, ("title", "og:title"))),
        "og_description": F.coalesce(first_text(fields, "og_description"), block(og, ("description", "og:description"))),
        "og_image": F.coalesce(first_text(fields, "og_image"), block(og, ("image", "og:image"))),
        "twitter_title": F.coalesce(first_text(fields, "twitter_title"), block(tw, ("title", "twitter:title"))),
        "twitter_description": F.coalesce(
            first_text(fields, "twitter_description"), block(tw, ("description", "twitter:description"))
        ),
        "canonical": first_text(fields, "canonical", "canonical_url"),
        "robots": first_text(fields, "robots", "meta_robots"),
        "hreflang": goods.hreflang_of(fields),
        "images_alt_joined": goods.image_alts_of(fields),
    }
    order = [order] if isinstance(order, (str, Column)) else list(order)
    by = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    flat = products.select(*[cols[c].alias(c) for c in SEO_COLUMNS], *by, *[F.col(k) for k in keep])
    flat = flat.where(F.col("url").isNotNull())
    return keep_first(flat, "url", [f"_o{i}" for i in range(len(order))]).select(*SEO_COLUMNS, *keep)


# --- row filters and checks -------------------------------------------------------------------

# Digital or non-stock goods, and the stock level above which an item counts as bulk.
DIGITAL_MARKS = (
    "электрон", "цифров", "подписк", "абонем", r"gift\s*card", "сертификат", "certificate", "download", "pdf",
    "онлайн", "digital", "pattern",
)
DIGITAL_PATTERN = "(?iu)" + "|".join(DIGITAL_MARKS)
MAX_STOCK = 10000
GOODS_TEXT_KEYS = (
    "name", "title", "description", "short_description", "summary", "body", "category", "categories", "type", "tags",
    "attributes", "sku",
)
ALL_STOCK_KEYS = (
    "stock_quantity", "stock", "inventory", "available", "quantity",
    "quantity_available", "stock_left", "stock_level", "remaining", "balance",
)


def is_excluded_item(fields) -> Column:
    """Bulk stock, or text that marks digital goods, in one record's own fields."""
    stocks = [to_number_lenient(fields[n][0]) > MAX_STOCK for n in ALL_STOCK_KEYS if n in fields]
    texts = [
        as_text(*fields[n]).rlike(DIGITAL_PATTERN)
        for n in GOODS_TEXT_KEYS
        if n in fields and not isinstance(fields[n][1], (T.NumericType, T.BooleanType))
    ]
    return F.coalesce(any_of([F.coalesce(c, F.lit(False)) for c in stocks + texts]), F.lit(False))


def is_excluded_product(fields) -> Column:
    """``is_excluded_item`` on the product or any nested variation."""
    out = is_excluded_item({k: v for k, v in fields.items() if k != "variations"})
    kind = fields.get("variations", (None, None))[1]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        inner = F.exists(fields["variations"][0], lambda v: is_excluded_item(struct_fields(v, kind.elementType)))
        out = out | F.coalesce(inner, F.lit(False))
    return out


# A data set is a placeholder when both shares reach this level.
PLACEHOLDER_SHARE = 0.6


def placeholder_shares(products: DataFrame, name_prefix: str, time_prefix: str) -> DataFrame:
    """Share of sample names and of sample times, and whether the set is a placeholder."""
    fields = fields_of(products)
    name = F.coalesce(first_text(fields, "name").startswith(name_prefix), F.lit(False))
    stamp = F.coalesce(first_text(fields, "scraped_at", "fetched_at").startswith(time_prefix), F.lit(False))
    shares = products.agg(
        F.count("*").alias("products"),
        F.avg(name.cast("int")).alias("sample_name_share"),
        F.avg(stamp.cast("int")).alias("sample_time_share"),
    )
    both = (F.col("sample_name_share") >= PLACEHOLDER_SHARE) & (F.col("sample_time_share") >= PLACEHOLDER_SHARE)
    return shares.withColumn("is_placeholder", F.coalesce(both, F.lit(False)))


def refuse_placeholder(products: DataFrame, name_prefix: str, time_prefix: str) -> DataFrame:
    """Guard before a write: one aggregate row comes to the driver."""
    if placeholder_shares(products, name_prefix, time_prefix).head()["is_placeholder"]:
        raise ValueError("placeholder data set, export refused")
    return products


def violations(df: DataFrame, row_key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: ``(row_key, rule)``; one pass, no self-union."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(F.col(row_key).alias("row_key"), F.explode(broken).alias("rule"))


# Columns that must carry a value in each output table; a diff row needs
# at least one of its two crawl times, because added and removed rows have only one.
REQUIRED = {"full": ("url", "http_status", "fetched_at"), "seo": ("url", "fetched_at"), "diff": ("url",)}


def required_column_rules(df: DataFrame, table: str) -> dict[str, Column]:
    fields = fields_of(df)
    rules = {f"{table}.{n}": has_value(*fields[n]) if n in fields else F.lit(False) for n in REQUIRED[table]}
    if table == "diff":
        rules["diff.crawl_at"] = F.coalesce(F.col("prev_crawl_at"), F.col("curr_crawl_at")).isNotNull()
    return rules


def product_rules(fields) -> dict[str, Column]:
    """Field rules of a product record; absent fields break their rule."""

    def number(name: str) -> Column:
        return first_number(fields, name)

    url, name, domain = (first_text(fields, n) for n in ("url", "name", "site_domain"))
    return {
        "url_scheme": url.startswith("http://") | url.startswith("https://"),
        "name_length": F.length(name).between(1, 500),
        "base_price_not_negative": number("base_price") >= 0,
        "in_stock_present": fields["in_stock"][0].isNotNull() if "in_stock" in fields else F.lit(False),
        "stock_quantity_not_negative": number("stock_quantity") >= 0,
        "domain_has_dot": domain.contains("."),
    }
