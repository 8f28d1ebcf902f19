"""Variation rows from vendor payloads, embedded JSON, option lists and tables; fields by rules; robots rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogwatch.functions import goods
from catalogwatch.functions import urls as U
from catalogwatch.functions.values import NUMBER, clean_text, strip, to_number
from catalogwatch.functions.variants import option_price, option_stock, variation_type
from catalogwatch.operators import html_table as H

# Where each vendor keeps its list of variants.
VARIANT_PATHS = {
    "insales": "$.variants", "shopify": "$.variants", "bitrix": "$.OFFERS", "generic": "$.variations", "woocommerce": "$.product_variations",
}
# Field names of one vendor's offers, in the order in which they are looked at.
BITRIX_PRICE_KEYS = ("PRICE", "MIN_PRICE", "BASE_PRICE", "price", "ITEM_PRICE")
BITRIX_PRICE_LISTS = ("ITEM_PRICES", "ITEM_PRICE_DATA")
BITRIX_PRODUCT_PRICES = ("MIN_PRICE", "PRICE", "PRICE_VALUE")
BITRIX_PRICE_PARTS = (
    "DISCOUNT_VALUE", "DISCOUNT_PRICE", "RATIO_DISCOUNT_PRICE", "VALUE", "PRICE", "BASE_PRICE", "RATIO_PRICE", "PRICE_WITHOUT_DISCOUNT",
)
BITRIX_STOCK_KEYS = ("QUANTITY", "STOCK", "QUANTITY_RESERVED", "IN_STOCK", "AVAILABLE", "TOTAL_QUANTITY")
BITRIX_PRODUCT_STOCK = ("QUANTITY", "AVAILABLE", "QUANTITY_AVAILABLE", "STOCK")

# The fields that are read of an offer, of the product within it, and of the other vendors' entries.
BITRIX_FIELDS = (
    "ID", "OFFER_ID", "SKU", "ARTNUMBER", "CODE", "XML_ID", "PROPERTY_NAME", "NAME", "CAN_BUY", "PRODUCT", *BITRIX_PRICE_KEYS, *BITRIX_PRICE_LISTS, *BITRIX_STOCK_KEYS,
)
BITRIX_PRODUCT_FIELDS = tuple(dict.fromkeys(("CAN_BUY", *BITRIX_PRODUCT_PRICES, *BITRIX_PRODUCT_STOCK)))
PLAIN_FIELDS = (
    "id", "variation_id", "sku", "title", "name", "label", "value", "type", "option_name", "option_values", "attributes", "price", "display_price",
    "stock", "quantity", "inventory_quantity", "max_qty", "available",
)

MAP = "map<string,string>"


def _entries(rows: DataFrame, payload: Column) -> DataFrame:
    """Variants of a payload as JSON texts ``_texts``, with the labels of the option groups they stand in; entries that are no objects are left out."""
    inner = F.from_json(payload, "spConfig struct<attributes:map<string,string>>, attributes map<string,string>")
    groups = F.map_values(F.coalesce(inner["spConfig"]["attributes"], inner["attributes"]))
    # A group is read once, and not again for each of its options.
    read = F.transform(groups, lambda t: F.from_json(t, "label string, options array<string>"))

    def options(group: Column) -> Column:
        return F.transform(F.coalesce(group["options"], F.array().cast("array<string>")), lambda o: F.struct(o.alias("v"), group["label"].alias("label")))

    grouped = F.filter(F.flatten(F.transform(read, options)), lambda e: e["v"].startswith("{"))
    vendor = F.col("vendor")
    rows = rows.withColumn("_grouped", F.when(vendor == "magento", grouped))
    lists = F.when(vendor == "magento", F.col("_grouped.v"))
    for name, path in VARIANT_PATHS.items():
        plain = F.from_json(payload, f"`{path[2:]}` array<string>")[path[2:]]
        lists = lists.when(vendor == name, F.filter(plain, lambda v: v.startswith("{")))
    return rows.withColumns({"_texts": lists, "_labels": F.col("_grouped.label")}).drop("_grouped")


def _objects(rows: DataFrame, payload: Column, *keep: str) -> DataFrame:
    """The texts of a payload's entries as maps, one a row: all in one reading, as each reading has its own cost.

    A text that was quoted in the payload need not be whole JSON, so where there may be such ones each text is read by itself.
    """
    quoted = payload.contains('"{') | payload.contains("'{") | payload.contains("\\u00")
    whole = F.from_json(F.concat(F.lit("["), F.array_join("_texts", ","), F.lit("]")), f"array<{MAP}>")
    rows = rows.withColumn("_whole", F.when(~quoted, whole))
    single = F.transform("_texts", lambda t: F.from_json(t, MAP))
    # The choice sits in the generator: of a plain column the engine would infer a filter and read all again for it, before the rows are dealt out.
    return rows.select(*keep, F.posexplode(F.when(F.size("_whole") == F.size("_texts"), F.col("_whole")).otherwise(single)).alias("pos", "_m"))


def _get(doc: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(doc, "$" + (p if p.startswith("[") else "." + p)), F.lit("")) for p in paths])


def _first(values: Column) -> Column:
    """The first value that isn't null."""
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))


def payload_variants(payloads: DataFrame, vendor: str, payload: str, *keep: str, base_price: Column | None = None) -> DataFrame:
    """Common variation rows out of vendor JSON documents.

    Fields are read from the parsed document by their exact names, and only those of the row's vendor. What a document
    doesn't say stays null. Entries of the list that are no objects are left out, and so are unpriced offers of the vendor
    that prices every offer. A document that isn't JSON has no rows.
    """
    base = base_price if base_price is not None else F.lit(None).cast("double")
    rows = payloads.select(*keep, F.col(vendor).alias("vendor"), base.alias("_base"), F.col(payload).alias("_payload"))
    rows = _objects(_entries(rows, F.col("_payload")), F.col("_payload"), *keep, "vendor", "_base", "_labels")
    of = lambda name, c: F.when(F.col("vendor") == name, c)

    def picked(fields: str, names: Sequence[str]) -> Column:
        """The named fields of a map by their places; names differ in their case alone."""
        return F.struct(*[F.try_element_at(fields, F.lit(n)).alias(f"f{i}") for i, n in enumerate(names)])

    # Each field is looked up once, and only those of the row's kind of vendor; what is an object within an entry is read once.
    rows = rows.select(
        *keep, "vendor", "pos", "_base", F.try_element_at("_labels", F.col("pos") + 1).alias("_label"),
        of("bitrix", picked("_m", BITRIX_FIELDS)).alias("_offer"), F.when(F.col("vendor") != "bitrix", picked("_m", PLAIN_FIELDS)).alias("_plain"),
    )
    offer = lambda name: F.col(f"_offer.f{BITRIX_FIELDS.index(name)}")
    plain = lambda name: F.col(f"_plain.f{PLAIN_FIELDS.index(name)}")
    product = lambda name: F.col(f"_product.f{BITRIX_PRODUCT_FIELDS.index(name)}")
    rows = rows.withColumn("_p", F.from_json(offer("PRODUCT"), MAP)).withColumn("_product", F.when(F.col("_p").isNotNull(), picked("_p", BITRIX_PRODUCT_FIELDS))).drop("_p")

    def inner(text: Column, kind: str) -> Column:
        return F.when(text.startswith("[" if kind.startswith("array") else "{"), F.from_json(text, kind))

    def said(*fields: Column) -> Column:
        """The first of the fields that says anything."""
        return F.coalesce(*[F.when(x != "", x) for x in fields])

    def raw(*names: str) -> Column:
        return said(*map(plain, names))

    def parts(m: Column) -> Column:
        """Prices among the fields of an object."""
        return F.array(*[F.try_element_at(m, F.lit(k)) for k in BITRIX_PRICE_PARTS])

    def price_texts(x: Column) -> Column:
        """What may be a price below a field: its own text, the parts of an object, or those of a list's objects."""
        listed = F.flatten(F.transform(F.transform(x["texts"], lambda t: F.from_json(t, MAP)), parts))
        return F.when(x["text"].startswith("{"), parts(x["fields"])).when(x["listed"] & x["text"].startswith("["), listed).otherwise(F.array(x["text"]))

    def currency(x: Column) -> Column:
        """The currency that an object or a list's first object names."""
        head = F.try_element_at(x["texts"], F.lit(1))
        return F.when(~x["listed"], F.try_element_at(x["fields"], F.lit("CURRENCY"))).otherwise(F.try_element_at(inner(head, MAP), F.lit("CURRENCY")))

    def first_of(texts: Column, read) -> Column:
        """What is read from the first text that can be read."""
        return _first(F.transform(F.filter(texts, lambda x: x.isNotNull()), read))

    def quantity(text: Column) -> Column:
        parsed = goods.parse_stock(text)
        flag = F.upper(F.trim(text))
        return (
            F.when(text.isNull(), F.lit(None).cast("double")).when(flag.isin("Y", "TRUE"), F.lit(1.0)).when(flag == "FALSE", F.lit(0.0))
            .when(text.rlike(NUMBER), F.greatest(F.floor(text.try_cast("double")), F.lit(0)).cast("double"))
            .when(parsed.isNotNull(), F.greatest(parsed, F.lit(0)).cast("double"))
        )

    zero = F.lit(0.0)
    none = F.lit(None).cast("string")
    # In the order in which they count. Most of them aren't there, so those that are there are picked first and read once.
    named = [*[(offer(k), False) for k in BITRIX_PRICE_KEYS], *[(offer(k), True) for k in BITRIX_PRICE_LISTS], *[(product(k), False) for k in BITRIX_PRODUCT_PRICES]]
    priced = F.array(*[F.struct(c.alias("text"), F.lit(listed).alias("listed")) for c, listed in named])
    stocks = F.array(*map(offer, BITRIX_STOCK_KEYS), *map(product, BITRIX_PRODUCT_STOCK))

    def opened(x: Column) -> Column:
        texts = F.when(x["listed"] & x["text"].startswith("["), F.from_json(x["text"], "array<string>"))
        return F.struct(x["text"], x["listed"], inner(x["text"], MAP).alias("fields"), texts.alias("texts"))

    rows = rows.withColumns({
        "_priced": of("bitrix", F.transform(F.filter(priced, lambda x: x["text"].isNotNull()), opened)),
        "_option": of("insales", inner(F.try_element_at(inner(plain("option_values"), "array<string>"), F.lit(1)), MAP)),
    })
    option = lambda name: F.try_element_at("_option", F.lit(name))
    barred = F.coalesce(F.upper(said(product("CAN_BUY"))).isin("N", "FALSE"), F.lit(False)) | F.coalesce(F.upper(said(offer("CAN_BUY"))).isin("N", "FALSE"), F.lit(False))
    chosen = F.array_join(F.map_values(inner(plain("attributes"), MAP)), " ")
    kinds = {
        "insales": {
            "variation_id": raw("id"), "sku": raw("sku"),
            "type": said(*map(option, ("option_name", "name", "option")), plain("option_name")),
            "value": clean_text(said(plain("title"), option("title"), option("value"))),
            "price": F.coalesce(to_number(raw("price")), F.col("_base")), "stock": F.coalesce(to_number(raw("quantity")), zero), "currency": none,
        },
        "shopify": {
            "variation_id": raw("id"), "sku": raw("sku"), "type": F.lit("variant"), "value": raw("title"),
            "price": F.coalesce(to_number(raw("price")), zero) / 100, "stock": F.coalesce(to_number(raw("inventory_quantity")), zero), "currency": none,
        },
        "bitrix": {
            "variation_id": said(offer("ID"), offer("OFFER_ID")), "sku": said(*map(offer, ("SKU", "ARTNUMBER", "CODE", "XML_ID", "ID"))),
            "type": said(offer("PROPERTY_NAME")), "value": clean_text(said(offer("NAME"))),
            "price": first_of(F.flatten(F.transform("_priced", price_texts)), goods.clean_price),
            "stock": F.coalesce(first_of(stocks, quantity), F.when(barred, zero)),
            "currency": F.try_element_at(F.filter(F.transform("_priced", currency), lambda c: c != ""), F.lit(1)),
        },
        "generic": {
            "variation_id": raw("id", "variation_id"), "sku": raw("sku"), "type": raw("type"), "value": raw("name", "title", "label", "value"),
            "price": F.coalesce(to_number(raw("price")), zero), "stock": F.coalesce(to_number(raw("stock", "quantity")), zero), "currency": none,
        },
        "woocommerce": {
            "variation_id": raw("variation_id"), "sku": raw("sku"), "type": F.lit("attribute"), "value": F.coalesce(chosen, F.lit("")),
            "price": F.coalesce(to_number(raw("display_price")), zero), "stock": F.coalesce(to_number(raw("max_qty")), zero), "currency": none,
        },
        # Its payloads don't say what is in stock.
        "magento": {
            "variation_id": raw("id"), "sku": raw("sku"), "type": F.lower(F.coalesce("_label", F.lit("attribute"))), "value": F.coalesce(raw("label"), F.lit("")),
            "price": F.coalesce(to_number(raw("price")), zero), "stock": F.lit(1.0), "currency": none,
        },
    }
    entry = None
    for name, columns in kinds.items():
        made = F.struct(*[c.alias(n) for n, c in columns.items()])
        entry = F.when(F.col("vendor") == name, made) if entry is None else entry.when(F.col("vendor") == name, made)
    available = F.coalesce(plain("available") == "true", F.lit(False))
    rows = rows.select(*keep, "vendor", "pos", available.alias("_available"), entry.alias("_e"))
    # An offer without a price is dropped for the vendor that prices every offer; the test sits in a generator, as a
    # filter behind the projection would be pushed down and read the prices again.
    kept = F.when((F.col("vendor") != "bitrix") | F.col("_e.price").isNotNull(), F.array("_e"))
    out = rows.select(*keep, "vendor", "pos", "_available", F.explode(kept).alias("_e"))
    positive = F.col("_e.stock") > 0
    flag = F.when(F.col("vendor") == "insales", positive | F.col("_available")).otherwise(F.col("_e.stock").isNull() | positive)
    return out.select(
        *keep, "vendor", "pos", "_e.variation_id", "_e.sku", F.coalesce("_e.type", F.lit("variant")).alias("type"), "_e.value", "_e.price",
        "_e.stock", flag.alias("in_stock"), "_e.currency",
    )


# Attributes that hold a payload, and the field that a bare list stands for.
PAYLOAD_ATTRIBUTES = {"data-product": None, "data-variants": "variants", "data-product_variations": "product_variations"}


def embedded_payloads(parsed: DataFrame, *keep: str) -> DataFrame:
    """``vendor, payload`` of every JSON object in scripts and data attributes of parsed pages that lists variants.

    A script may hold several, anywhere in its code. The vendor is told by the fields that are there.
    """
    scripts = F.flatten(F.transform("scripts", lambda s: s["listings"]))

    def held(name: str, field: str | None) -> Column:
        values = F.filter(F.transform("elements", lambda e: strip(H.attr(e, name))), lambda x: x.isNotNull())
        whole = lambda x: F.when(x.startswith("["), F.concat(F.lit(f'{{"{field}":'), x, F.lit("}"))).otherwise(x)
        return F.transform(values, whole) if field else values

    rows = parsed.select(*keep, F.posexplode(F.concat(scripts, *[held(*x) for x in PAYLOAD_ATTRIBUTES.items()])).alias("place", "payload")).where(F.col("payload").startswith("{"))
    doc = F.try_parse_json("payload")
    vendor = F.when(F.try_variant_get(doc, "$.spConfig", "map<string,variant>").isNotNull(), "magento")
    for name in ("bitrix", "woocommerce", "generic"):
        vendor = vendor.when(F.try_variant_get(doc, VARIANT_PATHS[name], "array<variant>").isNotNull(), name)
    listed = F.try_variant_get(doc, "$.variants", "array<variant>").isNotNull()
    vendor = vendor.when(listed & F.col("payload").contains('"inventory_quantity"'), "shopify").when(listed, "insales")
    return rows.select(*keep, "place", vendor.alias("vendor"), "payload").where(F.col("vendor").isNotNull())


def prefer_sources(products: DataFrame, sources: Sequence[DataFrame], on: str) -> DataFrame:
    """Variation rows of the best source per product: the first listed source that has any.

    Sources are ranked rows, the winning rank per product is a partial aggregate; no row list is built.
    """
    tagged = None
    for i, s in enumerate(sources):
        t = s.withColumn("source_rank", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    best = tagged.groupBy(on).agg(F.min("source_rank").alias("source_rank"))
    return products.select(on).join(tagged.join(best, [on, "source_rank"]), on)


def product_stock(products: DataFrame, variations: DataFrame, on: str) -> DataFrame:
    """Product stock = sum of variation stock (flag as 1/0 where a stock is missing), in stock = any."""
    v = F.coalesce(F.col("stock"), F.when(F.col("in_stock"), 1.0).otherwise(0.0))
    rolled = variations.groupBy(on).agg(F.round(F.sum(v), 3).alias("_s"), F.max(F.coalesce("in_stock", F.lit(False))).alias("_i"))
    j = products.join(rolled, on, "left")
    own = F.coalesce(F.col("stock"), goods.binary_stock(F.col("in_stock")), F.lit(0.0))
    flag = F.coalesce("_i", "in_stock", F.lit(False)) | F.coalesce(F.col("stock") > 0, F.lit(False))
    return j.withColumns({"total_stock": F.coalesce("_s", own), "any_in_stock": flag}).drop("_s", "_i")


# --- pages -----------------------------------------------------------------------------------------------


def structured_products(parsed: DataFrame, *keep: str) -> DataFrame:
    """Products out of JSON-LD scripts (single object or graph)."""
    bodies = F.transform(F.filter("scripts", lambda s: F.lower(s["type"]) == "application/ld+json"), lambda s: s["body"])
    docs = parsed.select(*keep, F.explode(bodies).alias("_b")).withColumn("_d", F.try_parse_json("_b"))
    items = F.coalesce(
        F.try_variant_get("_d", "$.@graph", "array<variant>"), F.try_variant_get("_d", "$", "array<variant>"), F.array(F.col("_d"))
    )
    rows = docs.where(F.col("_d").isNotNull()).select(*keep, F.explode(items).alias("_v")).withColumn("_j", F.to_json("_v"))
    j = F.col("_j")
    return rows.where(F.get_json_object(j, "$['@type']") == "Product").select(
        *keep,
        _get(j, "name").alias("name"),
        _get(j, "sku", "productID").alias("sku"),
        _get(j, "brand.name", "brand").alias("brand"),
        to_number(_get(j, "offers.price", "offers[0].price", "offers.lowPrice")).alias("price"),
        _get(j, "offers.priceCurrency", "offers[0].priceCurrency").alias("currency"),
        F.substring_index(_get(j, "offers.availability", "offers[0].availability"), "/", -1).alias("availability"),
    )


def structured_data_marks(parsed: DataFrame, *keep: str) -> DataFrame:
    """Does a page carry JSON-LD, microdata, forms, scripts."""
    return parsed.select(
        *keep,
        F.exists("scripts", lambda s: F.coalesce(F.lower(s["type"]) == "application/ld+json", F.lit(False))).alias("has_json_ld"),
        F.exists("elements", lambda e: F.map_contains_key(e["attrs"], "itemtype")).alias("has_microdata"),
        H.count("form").alias("form_count"),
        H.count("script").alias("script_count"),
    )


@dataclass(frozen=True)
class Rule:
    """One selector rule of a field: tag, required class, attribute test, and where the value is."""

    field: str
    tag: str | None = None
    css_class: str | None = None
    attr: tuple[str, str] | None = None
    read: str | None = None

    @property
    def name(self) -> str:
        parts = [self.tag or "", f".{self.css_class}" if self.css_class else "", f'[{self.attr[0]}="{self.attr[1]}"]' if self.attr else ""]
        return "".join(parts)

    def matches(self, e: Column) -> Column:
        ok = F.lit(True)
        if self.tag:
            ok = ok & (e["tag"] == self.tag)
        if self.css_class:
            ok = ok & F.array_contains(F.split(H.class_text(e), r"\s+"), self.css_class)
        if self.attr:
            ok = ok & F.coalesce(H.attr(e, self.attr[0]) == self.attr[1], F.lit(False))
        return ok


def fields_by_rules(parsed: DataFrame, rules: Sequence[Rule], *keep: str) -> DataFrame:
    """Each field by its first rule (in order) that yields text, with the name of that rule."""
    cols: dict[str, Column] = {}
    for field in dict.fromkeys(r.field for r in rules):
        found = []
        for r in (r for r in rules if r.field == field):
            e = H.first_of(F.filter("elements", r.matches))
            text = H.trimmed(H.attr(e, r.read) if r.read else H.tight_text(e))
            found.append(F.when(text != "", F.struct(text.alias("value"), F.lit(r.name).alias("rule"))))
        cols[field] = F.coalesce(*found)
    out = parsed.select(*keep, *[c.alias(f"_{f}") for f, c in cols.items()])
    return out.select(
        *keep, *[F.col(f"_{f}.value").alias(f) for f in cols], *[F.col(f"_{f}.rule").alias(f"{f}_rule") for f in cols]
    )


# Class keywords and tags that suggest a field.
DISCOVERY = {
    "name": (("product", "name", "title", "item", "goods"), ("h1", "h2", "h3", "div", "span", "p")),
    "price": (("price", "cost", "цена", "руб", "₽"), ("span", "div", "p", "strong")),
    "stock": (("stock", "avail", "quantity", "колич", "штук"), ("span", "div", "p")),
}


def _candidates(field: str, words, tags) -> Column:
    pattern = "(?iu)" + "|".join(words)
    hits = F.filter("elements", lambda e: e["tag"].isin(*tags) & H.class_text(e).rlike(pattern))

    def entry(e: Column) -> Column:
        chain = F.regexp_replace(strip(H.class_text(e)), r"\s+", ".")
        return F.struct(F.lit(field).alias("field"), F.concat(e["tag"], F.lit("."), chain).alias("selector"))

    return F.transform(hits, entry)


def discovered_selectors(parsed: DataFrame, domain: str) -> DataFrame:
    """Candidate selectors per domain and field with the number of pages that support them."""
    found = [_candidates(field, words, tags) for field, (words, tags) in DISCOVERY.items()]
    per_page = F.array_distinct(F.concat(*found))
    rows = parsed.select(domain, F.explode(per_page).alias("_s")).select(domain, "_s.field", "_s.selector")
    return rows.groupBy(domain, "field", "selector").agg(F.count("*").alias("pages"))


# Option texts that stand for "nothing chosen".
PLACEHOLDER_OPTIONS = ("select", "choose", "option", "выберите", "не выбрано", "-")
TABLE_CLASSES = ("product-variations", "variation-table", "variations", "variations-table")


def option_variations(parsed: DataFrame, *keep: str, base_price: Column | None = None, base_stock: Column | None = None) -> DataFrame:
    """Variation rows from ``select`` options named ``option…``, with type, price and stock."""
    base_price = base_price if base_price is not None else F.lit(None).cast("double")
    base_stock = base_stock if base_stock is not None else F.lit(None).cast("int")
    inside = F.transform("elements", lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    p = parsed.select(*keep, "elements", "strings", base_price.alias("_bp"), base_stock.alias("_bs"), F.explode(
        F.filter(inside, lambda x: (x["e"]["tag"] == "select") & F.coalesce(H.attr(x["e"], "name").startswith("option"), F.lit(False)))
    ).alias("_sel"))
    sel = F.col("_sel.e")
    label = H.first_of(F.filter("elements", lambda e: (e["tag"] == "label") & F.coalesce(F.contains(H.attr(e, "for"), H.attr(sel, "name")), F.lit(False))))
    p = p.withColumn("_label", F.coalesce(F.nullif(H.tight_text(label), F.lit("")), F.lit("Variation")))
    options = F.filter("elements", lambda e: (e["tag"] == "option") & (e["first"] >= sel["first"]) & (e["upto"] <= sel["upto"]))
    rows = p.select(*keep, "strings", "_label", "_bp", "_bs", F.posexplode(options).alias("pos", "_o"))
    o = F.col("_o")
    text = F.regexp_replace(H.tight_text(o), r"\s+", " ")
    text = strip(F.regexp_replace(text, r"(?iu)\+\s*[\d.,]+\s*[рp]\.", ""))
    value = F.coalesce(F.nullif(text, F.lit("")), strip(H.attr(o, "value")), F.lit(""))
    rows = rows.withColumns({"value": value, "option_id": H.attr(o, "value"), "_text": H.tight_text(o)})
    rows = rows.where((F.col("value") != "") & ~F.lower("value").isin(*PLACEHOLDER_OPTIONS))
    rows = rows.withColumn("_k", variation_type(F.col("_label"), F.col("value")))
    return rows.select(
        *keep, F.col("_label").alias("label"), "pos", "value", "option_id", "_k.type", "_k.confidence", "_k.category",
        F.coalesce(option_price(o["attrs"], F.col("_text"), F.col("_bp")), F.lit(0.0)).alias("price"),
        F.coalesce(option_stock(o["attrs"], F.col("_text"), F.col("_bs")), F.lit(0)).alias("stock"),
    )


def table_variations(parsed: DataFrame, *keep: str) -> DataFrame:
    """Variation rows from three-column variation tables (size, colour, price); the header row is skipped."""
    marked = F.filter(
        "elements", lambda e: (e["tag"] == "table") & F.arrays_overlap(F.split(H.class_text(e), r"\s+"), F.array(*[F.lit(c) for c in TABLE_CLASSES]))
    )
    p = parsed.select(*keep, "elements", "strings", F.explode(marked).alias("_t"))
    t = F.col("_t")
    inside = lambda tag, box: F.filter("elements", lambda e: (e["tag"] == tag) & (e["first"] >= box["first"]) & (e["upto"] <= box["upto"]))
    rows = p.select(*keep, "elements", "strings", F.posexplode(inside("tr", t)).alias("pos", "_r")).where(F.col("pos") > 0)
    r = F.col("_r")
    rows = rows.withColumn("_c", F.transform(inside("td", r), H.tight_text)).where(F.size("_c") >= 3)
    size, color = F.col("_c")[0], F.col("_c")[1]
    value = F.concat_ws(" ", F.nullif(size, F.lit("")), F.nullif(color, F.lit("")))
    kind = F.when((size != "") & (color != ""), "size_color").when(size != "", "size").otherwise("color")
    return rows.select(*keep, "pos", kind.alias("type"), value.alias("value"), F.coalesce(goods.clean_price(F.col("_c")[2]), F.lit(0.0)).alias("price"))


# --- robots --------------------------------------------------------------------------------------------------


def robots_rules(lines: DataFrame, host: str, pos: str, line: str) -> DataFrame:
    """Directives of robots files with the agent they belong to: host, agent, directive, value.

    A file is parsed inside its row when landed whole; here its lines are rows, and the agent in
    force is the last one above, looked up over at most one file's lines.
    """
    from catalogwatch.operators.timeline import RunningLast, running

    c = strip(F.col(line))
    name = F.lower(F.trim(F.substring_index(c, ":", 1)))
    value = F.trim(F.regexp_replace(c, r"^[^:]*:", ""))
    rows = lines.where((c != "") & ~c.startswith("#") & c.contains(":")).select(
        host, pos, name.alias("directive"), value.alias("value")
    )
    agent = RunningLast(F.when(F.col("directive") == "user-agent", F.col("value")))
    out = running(rows, host, pos, pos, {"agent": agent}, width=0.001)
    return out.where(F.col("directive").isin("allow", "disallow", "crawl-delay") & F.col("agent").isNotNull()).select(
        host, "agent", "directive", "value"
    )


def robots_verdicts(urls: DataFrame, rules: DataFrame, host: str, url: str, agent: str) -> DataFrame:
    """Allowed or not per URL: the longest matching path prefix decides, allow wins ties; plus the crawl delay.

    Rules of a host are gathered (a robots file is bounded) and tested inside the URL row, so
    URLs are never multiplied by rules.
    """
    mine = rules.where((F.lower("agent") == agent.lower()) | (F.col("agent") == "*"))
    own = F.lower("agent") == agent.lower()
    per_host = mine.groupBy(host).agg(
        F.collect_set(
            F.when(F.col("directive").isin("allow", "disallow") & (F.col("value") != ""),
                   F.struct(own.alias("own"), F.col("value").alias("path"), (F.col("directive") == "allow").alias("ok")))
        ).alias("_rules"),
        F.max(own).alias("_named"),
        F.max_by(F.when(F.col("directive") == "crawl-delay", F.col("value").try_cast("double")),
                 F.when(F.col("directive") == "crawl-delay", own.cast("int"))).alias("crawl_delay"),
    )
    j = urls.join(per_host, host, "left")
    path = F.coalesce(F.nullif(U.path_of(F.col(url)), F.lit("")), F.lit("/"))
    hits = F.filter("_rules", lambda r: (r["own"] == F.col("_named")) & F.startswith(path, r["path"]))
    ranked = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["ok"].alias("ok"))))
    return j.select(*urls.columns, F.coalesce(ranked["ok"], F.lit(True)).alias("allowed"), F.coalesce("crawl_delay", F.lit(0.0)).alias("crawl_delay"))
