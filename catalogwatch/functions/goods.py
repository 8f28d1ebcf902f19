"""Price, stock, availability and list columns of a product record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.functions.values import (
    Fields,
    as_text,
    clean_text,
    contains_any,
    first_number,
    first_parsed_number,
    first_text,
    has_value,
    let,
    strip,
    struct_fields,
    to_number,
)

# Alias order decides which key of a record is read.
PRICE_KEYS = ("price", "base_price", "current_price")
VARIATION_PRICE_FIRST = ("price", "variation_price", "current_price")
VARIATION_PRICE_KEYS = ("variation_price", "price", "current_price")
STOCK_KEYS = ("stock", "stock_quantity", "quantity", "inventory", "available")
VARIATION_STOCK_KEYS = ("variation_stock", "stock_quantity", "stock", "quantity")
AVAILABILITY_KEYS = ("availability", "stock_status", "availability_status")
LABEL_KEYS = ("name", "title", "label")
CRUMB_KEYS = ("label", "name", "title", "text")
IMAGE_KEYS = ("url", "src", "href")
ALT_KEYS = ("alt", "text", "label")
ATTRIBUTE_KEYS = (
    "attributes", "attrs", "characteristics", "properties", "specs", "specifications", "details",
)

# Stock phrases.
AVAILABLE_PHRASES = ("в наличии", "in stock", "available", "есть")
MISSING_PHRASES = ("нет в наличии", "out of stock", "unavailable", "отсутствует")
UNLIMITED_PHRASES = ("unlimited", "много", "большое количество", "неограничено")
UNKNOWN_QUANTITY = -1
MAX_PRICE = 1000000
MAX_PARSED_STOCK = 10000


def clean_price(c: Column) -> Column:
    """Price from display text; a comma is a decimal mark only when no dot is there.

    A chain of three replacements: signs and blanks out, a single closing decimal comma to a dot,
    then the commas of a text without any dot out.
    """
    t = F.regexp_replace(c, r"[€$£¥₽\s]", "")
    t = F.regexp_replace(t, r"^([^.,]*),(\d{1,2})$", "$1.$2")
    t = F.regexp_replace(t, r"\G([^.,]*),(?=[^.]*$)", "$1")
    n = F.regexp_extract(t, r"\d+(?:\.\d{1,2})?", 0).try_cast("double")
    return F.when(n <= MAX_PRICE, n)


def parse_stock(c: Column, strict: bool = False) -> Column:
    """Quantity from stock text; -1 = available without a number, 0 = sold out.

    The default order tests the positive phrases first, so a negative phrase that
    contains a positive one reads as available; ``strict`` tests negatives first.
    """

    def read(t: Column) -> Column:
        digits = F.regexp_extract(t, r"\d+", 0).try_cast("bigint")
        positive = (contains_any(t, AVAILABLE_PHRASES), UNKNOWN_QUANTITY)
        negative = (contains_any(t, MISSING_PHRASES), 0)
        rungs = [negative, positive] if strict else [positive, negative]
        out = F.when(t == "", F.lit(None)).when(digits.between(0, MAX_PARSED_STOCK), digits)
        for cond, value in [*rungs, (contains_any(t, UNLIMITED_PHRASES), UNKNOWN_QUANTITY)]:
            out = out.when(cond, F.lit(value))
        return out.cast("int")

    return let(strip(F.lower(c)), read)


def price_of(fields: Fields) -> Column:
    """Own price, before variations are looked at."""
    return first_number(fields, *PRICE_KEYS)


def _variation_struct(fields: Fields) -> T.StructType | None:
    kind = fields.get("variations", (None, None))[1]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return kind.elementType
    return None


def _present(fields: Fields, names) -> Column:
    checks = [has_value(*fields[n]) for n in names if n in fields]
    out = F.lit(False)
    for c in checks:
        out = out | c
    return out


def effective_price(fields: Fields) -> Column:
    """Price of the first variation that carries one, else the product's own."""
    own = price_of(fields)
    struct = _variation_struct(fields)
    if struct is None:
        return own
    priced = F.filter(
        fields["variations"][0],
        lambda v: v.isNotNull() & _present(struct_fields(v, struct), VARIATION_PRICE_FIRST),
    )
    head = F.try_element_at(priced, F.lit(1))
    return let(
        head, lambda v: F.when(v.isNotNull(), first_number(struct_fields(v, struct), *VARIATION_PRICE_FIRST)).otherwise(own)
    )


def stock_of(fields: Fields) -> Column:
    return first_number(fields, *STOCK_KEYS)


def stock_value(price: Column, stock: Column) -> Column:
    return F.round(price * stock, 2)


def sold_word(flag: Column) -> Column:
    return F.when(flag, F.lit("in_stock")).otherwise(F.lit("out_of_stock"))


def variation_available(fields: Fields) -> Column:
    """A set flag decides; only an unset one lets the quantity decide."""
    flag = fields["in_stock"][0] if "in_stock" in fields else F.lit(None).cast("boolean")
    return F.coalesce(flag, first_number(fields, "stock", "stock_quantity") > 0, F.lit(False))


def availability(fields: Fields, any_variation: Column | None = None) -> Column:
    """Text, else flag, else own stock, else any variation.

    ``any_variation``: true/false when the product has variations, null when it has none;
    derived from the nested array when not given.
    """
    struct = _variation_struct(fields)
    if any_variation is None and struct is not None:
        arr = fields["variations"][0]
        any_variation = F.when(
            F.size(arr) > 0,
            F.exists(arr, lambda v: v.isNotNull() & variation_available(struct_fields(v, struct))),
        )
    text = first_text(fields, *[n for n in AVAILABILITY_KEYS if n in fields and isinstance(fields[n][1], T.StringType)])
    stock = first_number(fields, "stock", "stock_quantity", "quantity")
    out = F.when(text.isNotNull(), text)
    if "in_stock" in fields and isinstance(fields["in_stock"][1], T.BooleanType):
        flag = fields["in_stock"][0]
        out = out.when(flag.isNotNull(), sold_word(flag))
    out = out.when(stock.isNotNull(), sold_word(stock > 0))
    if any_variation is not None:
        out = out.when(any_variation.isNotNull(), sold_word(any_variation))
    return out


def join_labels(c: Column, kind: T.DataType, keys, sep: str) -> Column:
    """Text as it is; list items (text or labelled records) joined; record by its label."""
    if isinstance(kind, T.StringType):
        return clean_text(c)
    if isinstance(kind, T.StructType):
        return first_text(struct_fields(c, kind), *keys)
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType

        def label(x: Column) -> Column:
            if isinstance(inner, T.StructType):
                return first_text(struct_fields(x, inner), *keys)
            if isinstance(inner, T.MapType):
                return F.coalesce(*[clean_text(x[k].cast("string")) for k in keys])
            return clean_text(x.cast("string"))

        return F.nullif(F.array_join(F.array_compact(F.transform(c, label)), sep), F.lit(""))
    return F.lit(None).cast("string")


def joined(fields: Fields, names, keys, sep: str) -> Column:
    """``join_labels`` over the first alias that carries a value."""
    out = None
    for n in names:
        if n in fields:
            c, kind = fields[n]
            hit = has_value(c, kind)
            out = F.when(hit, join_labels(c, kind, keys, sep)) if out is None else out.when(hit, join_labels(c, kind, keys, sep))
    return F.lit(None).cast("string") if out is None else out


def category_of(fields: Fields) -> Column:
    return joined(fields, ("category", "categories"), LABEL_KEYS, ">")


def breadcrumbs_of(fields: Fields) -> Column:
    return joined(fields, ("breadcrumbs", "breadcrumb", "breadcrumb_path"), CRUMB_KEYS, ">")


def images_of(fields: Fields) -> Column:
    return joined(fields, ("images", "image_urls", "gallery"), IMAGE_KEYS, "|")


def image_alts_of(fields: Fields) -> Column:
    return joined(fields, ("images_alt", "image_alts", "alt_texts"), ALT_KEYS, "|")


def _language_entry(struct: T.StructType):
    def entry(x: Column) -> Column:
        f = struct_fields(x, struct)
        return F.nullif(F.concat_ws("|", first_text(f, "lang", "locale"), first_text(f, "url", "href")), F.lit(""))

    return entry


def hreflang_of(fields: Fields) -> Column:
    """``lang|href`` entries joined by ``|``."""
    out = None
    for n in ("hreflang", "alternate_locales", "alternates", "alternate_hreflang"):
        if n not in fields:
            continue
        c, kind = fields[n]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            value = F.nullif(F.array_join(F.array_compact(F.transform(c, _language_entry(kind.elementType))), "|"), F.lit(""))
        else:
            value = join_labels(c, kind, (), "|")
        hit = has_value(c, kind)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("string") if out is None else out


def attributes_json(fields: Fields) -> Column:
    """One JSON object of every attribute block a record carries (compact JSON)."""
    own = F.lit(None).cast("string")
    blocks: list[Column] = []
    hits: list[Column] = []
    if "attrs_json" in fields:
        c, kind = fields["attrs_json"]
        if isinstance(kind, T.StringType):
            own = clean_text(c)
        else:
            blocks.append(F.when(has_value(c, kind), c).alias("attrs_json"))
            hits.append(has_value(c, kind))
    for n in (*ATTRIBUTE_KEYS, "variations"):
        if n in fields and isinstance(fields[n][1], (T.ArrayType, T.MapType, T.StructType)):
            c, kind = fields[n]
            hit = has_value(c, kind)
            blocks.append(F.when(hit, c).alias(n))
            hits.append(hit)
    if not blocks:
        return own
    some = hits[0]
    for h in hits[1:]:
        some = some | h
    return F.coalesce(own, F.when(some, F.to_json(F.struct(*blocks))))


def binary_stock(flag: Column) -> Column:
    """1.0 / 0.0 from a flag, null when the flag is unset."""
    return F.when(flag.isNotNull(), flag.cast("double"))


def variations_stock(arr: Column, struct: T.StructType) -> Column:
    """Sum of variation stock held in one record."""
    return F.aggregate(
        arr,
        F.lit(0.0),
        lambda acc, v: acc + F.coalesce(first_parsed_number(struct_fields(v, struct), "stock"), F.lit(0.0)),
    )


