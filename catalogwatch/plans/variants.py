"""Product-field, variation and robots queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.functions import goods, values
from catalogwatch.functions import text as X
from catalogwatch.functions import variants as V
from catalogwatch.operators import html_table as H
from catalogwatch.operators import variants as O
from catalogwatch.plans.bindings import PRODUCTS, VARIATIONS, products, variations
from catalogwatch.plans.registry import query, table
from catalogwatch.session import spread


def choice(n, options):
    """Cycle through literal texts by a number column."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))


def sql_list(options):
    return "[" + ", ".join("NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options) + "]"


PRICE_TEXTS = {" 1 290,50 ₽": 1290.5, "1,290": 1290.0, "1.290,50": 1.29, "$99.999": 99.99, "12 345 678": None, "free": None, "€5,5": 5.5, "10,999": 10999.0}
STOCK_TEXTS = {"12 шт": 12, "В наличии": -1, "нет в наличии": -1, "unavailable": -1, "out of stock": 0, "отсутствует": 0, "много": -1, "99999": None, "odd": None, "0": 0}
NUMBER_TEXTS = {" 1 290,50 ": (1290.5, 1290.5), "12abc": (None, 12.0), "abc": (None, None), "-3.5e2": (-350.0, -350.0), "1,2,3": (None, 1.2), "": (None, None), ".5": (0.5, 0.5)}


def _num(v):
    return "NULL" if v is None else str(v)


@query(
    "parsed_prices",
    f"""SELECT l_orderkey, l_linenumber, {sql_list(PRICE_TEXTS)}[(l_orderkey + l_linenumber) % {len(PRICE_TEXTS)} + 1] AS text,
      ([{', '.join(_num(v) for v in PRICE_TEXTS.values())}]::DOUBLE[])[(l_orderkey + l_linenumber) % {len(PRICE_TEXTS)} + 1] AS price FROM lineitem""",
)
def parsed_prices(spark, d):
    """Prices from display text."""
    t = choice(F.col("l_orderkey") + F.col("l_linenumber"), list(PRICE_TEXTS))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.alias("text"), goods.clean_price(t).alias("price"))


@query(
    "parsed_stocks",
    f"""SELECT l_orderkey, l_linenumber, ([{', '.join(_num(v) for v in STOCK_TEXTS.values())}]::INTEGER[])[(l_orderkey + l_linenumber) % {len(STOCK_TEXTS)} + 1] AS stock,
      ([12, -1, 0, 0, 0, 0, -1, NULL, NULL, 0]::INTEGER[])[(l_orderkey + l_linenumber) % {len(STOCK_TEXTS)} + 1] AS strict_stock FROM lineitem""",
)
def parsed_stocks(spark, d):
    """Quantities from stock text, in the default and in the strict reading."""
    t = choice(F.col("l_orderkey") + F.col("l_linenumber"), list(STOCK_TEXTS))
    return spread(table(spark, d, "lineitem")).select(
        "l_orderkey", "l_linenumber", goods.parse_stock(t).alias("stock"), goods.parse_stock(t, strict=True).alias("strict_stock")
    )


@query(
    "parsed_numbers",
    f"""SELECT event_id, ([{', '.join(_num(v[0]) for v in NUMBER_TEXTS.values())}]::DOUBLE[])[event_id % {len(NUMBER_TEXTS)} + 1] AS exact,
      ([{', '.join(_num(v[1]) for v in NUMBER_TEXTS.values())}]::DOUBLE[])[event_id % {len(NUMBER_TEXTS)} + 1] AS lenient,
      CAST(trunc(([{', '.join(_num(None if ',' in k else v[0]) for k, v in NUMBER_TEXTS.items())}]::DOUBLE[])[event_id % {len(NUMBER_TEXTS)} + 1]) AS BIGINT) AS whole FROM events""",
)
def parsed_numbers(spark, d):
    """Numbers from text: whole-text, prefix and integer parsing."""
    t = choice(F.col("event_id"), list(NUMBER_TEXTS))
    return table(spark, d, "events").select(
        "event_id", values.to_number(t).alias("exact"), values.to_number_lenient(t).alias("lenient"), values.to_whole(t).alias("whole")
    )


@query(
    "time_stamps",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') || ' MSK' AS local,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS parsed_us FROM events""",
)
def time_stamps(spark, d):
    """Time stamps normalised, shown in report time, and parsed back from text."""
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 3 == 0, F.lit("not a time")).otherwise(X.utc_stamp(ts))
    return table(spark, d, "events").select(
        "event_id", X.utc_stamp(ts).alias("utc"), X.display_stamp(ts).alias("local"), F.unix_micros(X.parse_stamp(text)).alias("parsed_us")
    )


AGENTS = {
    "Mozilla/5.0 Chrome/119.0 Safari/537.36": 119, "Mozilla/5.0 Firefox/115.0": 115, "Mozilla/5.0 Version/16.1 Safari/605": 16,
    "Version/12 Opera": 0, "curl/8": 0,
}


@query("browser_versions", f"SELECT event_id, ([{', '.join(map(str, AGENTS.values()))}]::INTEGER[])[event_id % {len(AGENTS)} + 1] AS version FROM events")
def browser_versions(spark, d):
    """Major browser version of user-agent texts."""
    return table(spark, d, "events").select("event_id", X.browser_version(choice(F.col("event_id"), list(AGENTS))).alias("version"))


@query(
    "truncated_titles",
    "SELECT doc_id, substring(text, 1, 512) AS title, substring(text, 1, 200) AS diff_title, sha256(text) AS content_hash, md5(substring(text, 1, 500)) AS fingerprint FROM documents",
)
def truncated_titles(spark, d):
    """Field limits and content hashes."""
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", X.truncate(t, "title").alias("title"), X.truncate(t, "diff_title").alias("diff_title"), X.content_hash(t).alias("content_hash"),
        F.md5(F.substring(t, 1, 500)).alias("fingerprint"),
    )


@query(
    "list_fields",
    """SELECT o_orderkey, o_orderstatus || '>' || o_orderpriority AS category, 'home>' || o_orderpriority AS breadcrumbs, 'a.png|b.png' AS images,
      'en|https://a.example.com/' || o_custkey || '|ru' AS hreflang, CASE WHEN o_orderstatus = 'P' THEN 'alt' END AS alts,
      CASE WHEN o_orderstatus = 'O' THEN '{"attributes":{"k":"' || o_orderpriority || '"}}' END AS attrs FROM orders""",
)
def list_fields(spark, d):
    """List-valued product fields joined to text, attributes gathered to JSON."""
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    rec = table(spark, d, "orders").select(
        "o_orderkey",
        F.array(F.struct(status.alias("name"), F.lit(None).cast("string").alias("title")), F.struct(F.lit(" ").alias("name"), prio.alias("title"))).alias("categories"),
        F.array(F.lit(" home "), F.lit(""), prio).alias("breadcrumbs"),
        F.array(F.struct(F.lit("a.png").alias("src")), F.struct(F.lit(" b.png ").alias("src"))).alias("images"),
        F.array(
            F.struct(F.lit("en").alias("lang"), F.concat(F.lit("https://a.example.com/"), "o_custkey").alias("href")),
            F.struct(F.lit("ru").alias("lang"), F.lit(None).cast("string").alias("href")),
        ).alias("hreflang"),
        F.when(status == "P", F.array(F.struct(F.lit("alt").alias("text")))).alias("images_alt"),
        F.when(status == "O", F.create_map(F.lit("k"), prio)).alias("attributes"),
    )
    f = values.fields_of(rec)
    return rec.select(
        "o_orderkey", goods.category_of(f).alias("category"), goods.breadcrumbs_of(f).alias("breadcrumbs"), goods.images_of(f).alias("images"),
        goods.hreflang_of(f).alias("hreflang"), goods.image_alts_of(f).alias("alts"), goods.attributes_json(f).alias("attrs"),
    )


# label, value -> type, confidence, category, display name
LABELS = (
    ("Размер", "XL", "size", 1.0, "dimension", "XL"),
    ("Size", "10 x 20", "size", 1.0, "dimension", "10 × 20"),
    ("Выбор цвета товара", "dark-red o'neil", "color", 0.5333333333333333, "appearance", "Dark-Red O'Neil"),
    ("Choose one of these", "42", "size", 0.4, "dimension", "42"),
    ("Pick", " Edition two ", "model", 0.4, "variant", "Edition two"),
    ("Pick", "plain", "unknown", 0.0, "other", "plain"),
    ("Color model", "x", "color", 0.5, "appearance", "X"),
)


@query(
    "variation_types_by_label",
    f"""SELECT l_orderkey, l_linenumber, {sql_list([x[2] for x in LABELS])}[l_linenumber] AS type, round(([{', '.join(str(x[3]) for x in LABELS)}]::DOUBLE[])[l_linenumber], 9) AS confidence,
      {sql_list([x[4] for x in LABELS])}[l_linenumber] AS category, {sql_list([x[5] for x in LABELS])}[l_linenumber] AS display FROM lineitem""",
)
def variation_types_by_label(spark, d):
    """Type, confidence, category and display name of variations."""
    n = F.col("l_linenumber") - 1
    label, value = choice(n, [x[0] for x in LABELS]), choice(n, [x[1] for x in LABELS])
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"), V.variation_type(label, value).alias("k"))
    return rows.select(
        "l_orderkey", "l_linenumber", "k.type", F.round("k.confidence", 9).alias("confidence"), "k.category",
        V.display_name(F.col("k.type"), F.col("value")).alias("display"),
    )


@query(
    "variation_order",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, ['size', 'color', 'model', 'size', 'odd', 'size', 'size'][l_linenumber] AS type, ['XL', 'Red', 'M1', '42.5', 'z', '9 cm', 'huge'][l_linenumber] AS value FROM lineitem)
    SELECT *, CASE type WHEN 'size' THEN 1 WHEN 'color' THEN 2 WHEN 'model' THEN 3 ELSE 4 END AS k1, ([5, 0, 0, 42.5, 0, 9, 99]::DOUBLE[])[l_linenumber] AS k3,
      CASE WHEN type = 'size' THEN '' ELSE lower(value) END AS k4 FROM v""",
)
def variation_order(spark, d):
    """Display order keys of variations."""
    n = F.col("l_linenumber") - 1
    kind = choice(n, ["size", "color", "model", "size", "odd", "size", "size"])
    value = choice(n, ["XL", "Red", "M1", "42.5", "z", "9 cm", "huge"])
    k = V.sort_keys(kind, value)
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", kind.alias("type"), value.alias("value"), k[0].alias("k1"), k[1].alias("k2"), k[2].alias("k3"), k[3].alias("k4")
    )
    # The order matters within a product only.
    return rows.repartition("l_orderkey").sortWithinPartitions("l_orderkey", "k1", "k2", "k3", "k4").drop("k2")


@query(
    "validated_variations",
    """WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN -5.0 WHEN 2 THEN 0.0 ELSE l_extendedprice END AS p FROM lineitem)
    SELECT l_orderkey, l_linenumber, p::DOUBLE AS price, ([7, NULL, 0, -1, 3, 0, 5]::INTEGER[])[l_linenumber] AS stock,
      [TRUE, TRUE, FALSE, FALSE, TRUE, TRUE, TRUE][l_linenumber] AS in_stock FROM v WHERE p >= 0""",
)
def validated_variations(spark, d):
    """Validated variations; negative prices drop out."""
    n = F.col("l_linenumber")
    price = F.when(n == 1, "-5").when(n == 2, "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    stock = choice(n - 1, ["7", None, "odd", "in stock", "3 left", "out of stock", "5"])
    v = V.validated(price, stock, F.when(n == 6, F.lit(True)))
    return table(spark, d, "lineitem").where(v["keep"]).select(
        "l_orderkey", "l_linenumber", v["price"].alias("price"), v["stock"].alias("stock"), v["in_stock"].alias("in_stock")
    )


@query(
    "option_prices",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity + 50 WHEN 2 THEN 50 WHEN 3 THEN l_quantity WHEN 4 THEN 70 WHEN 5 THEN 50 WHEN 6 THEN 50 ELSE 50 END::DOUBLE AS price,
      CAST(CASE l_linenumber WHEN 1 THEN 4 WHEN 4 THEN 70 WHEN 5 THEN 0 ELSE 9 END AS INTEGER) AS stock FROM lineitem""",
)
def option_prices(spark, d):
    """Option prices: deltas add to the base, zero keeps it, text and base as fallbacks."""
    n = F.col("l_linenumber")
    q = F.col("l_quantity").cast("string")
    attrs = (
        F.when(n == 1, F.create_map(F.lit("data-price"), q, F.lit("data-stock"), F.lit("4")))
        .when(n == 2, F.create_map(F.lit("data-price"), F.lit("0")))
        .when(n == 3, F.create_map(F.lit("data-special"), q))
        .otherwise(F.create_map(F.lit("value"), q))
    )
    text = F.when(n == 4, F.lit("size L, 70 ₽")).when(n == 5, F.lit("0")).otherwise(F.lit("plain"))
    # Columns of their own, or the map would be built anew for each attribute that is looked up.
    shown = spread(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", attrs.alias("attrs"), text.alias("text"))
    attrs, text = F.col("attrs"), F.col("text")
    return shown.select(
        "l_orderkey", "l_linenumber", V.option_price(attrs, text, F.lit(50.0)).alias("price"), V.option_stock(attrs, text, F.lit(9)).alias("stock")
    )


VENDORS = ["insales", "shopify", "bitrix", "generic", "woocommerce", "magento"]


@query(
    "vendor_variants",
    f"""WITH o AS (SELECT l_orderkey, l_linenumber, {VENDORS}[l_orderkey % 6 + 1] AS vendor, CAST(l_quantity AS INTEGER) AS q, CAST(l_partkey AS VARCHAR) AS id FROM lineitem),
    t (vendor, pos, id, value, price, stock, type, in_stock, currency) AS (VALUES
      ('insales', 1, 'x', 'second', 99.0, 0.0, 'variant', TRUE, NULL), ('shopify', 1, 'x', 'second', 0.0, 0.0, 'variant', FALSE, NULL),
      ('bitrix', 2, 'y', 'third', 500.0, 4.0, 'variant', TRUE, NULL), ('bitrix', 3, 'z', 'fourth', 70.0, 7.0, 'variant', TRUE, 'EUR'),
      ('bitrix', 4, 'w', 'fifth', 80.0, 1.0, 'variant', TRUE, NULL), ('bitrix', 5, 'v', 'sixth', 1.0, NULL, 'variant', TRUE, NULL),
      ('bitrix', 6, 'u', 'seventh', 2.0, 0.0, 'variant', FALSE, NULL),
      ('generic', 1, 'x', 'second', 0.0, 0.0, 'variant', FALSE, NULL), ('woocommerce', 1, NULL, '', 0.0, 0.0, 'attribute', FALSE, NULL),
      ('magento', 1, '2', 'blue', 0.0, 1.0, 'color', TRUE, NULL))
    SELECT l_orderkey, l_linenumber, vendor, 0 AS pos, CASE WHEN vendor = 'magento' THEN '1' ELSE id END AS variation_id,
      CASE vendor WHEN 'woocommerce' THEN 'red XL' WHEN 'magento' THEN 'red' ELSE 'first' END AS value,
      CASE vendor WHEN 'insales' THEN 1250.0 WHEN 'shopify' THEN q WHEN 'bitrix' THEN q + 0.5 WHEN 'generic' THEN 7.5 WHEN 'woocommerce' THEN q + 0.25 ELSE q END::DOUBLE AS price,
      CASE vendor WHEN 'insales' THEN q WHEN 'shopify' THEN q WHEN 'bitrix' THEN 1 WHEN 'generic' THEN 3 WHEN 'woocommerce' THEN q ELSE 1 END::DOUBLE AS stock,
      CASE vendor WHEN 'insales' THEN 'Size' WHEN 'generic' THEN 'color' WHEN 'woocommerce' THEN 'attribute' WHEN 'magento' THEN 'color' ELSE 'variant' END AS type,
      TRUE AS in_stock, CASE vendor WHEN 'bitrix' THEN 'RUB' END AS currency FROM o
    UNION ALL SELECT l_orderkey, l_linenumber, vendor, pos, t.id, value, price::DOUBLE, stock::DOUBLE, type, in_stock, currency FROM o JOIN t USING (vendor)""",
)
def vendor_variants(spark, d):
    """Vendor payloads as common variation rows."""
    li = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"))
    q, part = F.col("l_quantity").cast("int"), F.col("l_partkey")
    docs = [
        F.format_string(
            '{"variants":[{"id":%d,"title":"first","price":"1250.0","quantity":%d,"available":false,"option_values":[{"option_name":"Size","title":"S"}]},{"id":"x","title":"second","price":null,"quantity":0,"available":true}]}',
            part, q),
        F.format_string('{"variants":[{"id":%d,"title":"first","price":%d00,"inventory_quantity":%d},null,{"id":"x","title":"second"}]}', part, q, q),
        F.format_string(
            '{"OFFERS":[{"ID":"%d","id":"no","NAME":" first ","MIN_PRICE":{"PRICE":"%d,5","CURRENCY":"RUB"},"QUANTITY":"Y"},{"ID":"x","NAME":"second","CAN_BUY":"N"},'
            '{"ID":"y","NAME":"third","PRICE":"500","STOCK":"4"},{"ID":"z","NAME":"fourth","ITEM_PRICES":[{"PRICE":70,"CURRENCY":"EUR"}],"PRODUCT":{"QUANTITY":7}},'
            '{"ID":"w","NAME":"fifth","PRODUCT":{"PRICE":{"VALUE":80}},"AVAILABLE":"Y"},{"ID":"v","NAME":"sixth","PRICE":1},'
            '{"ID":"u","NAME":"seventh","PRICE":2,"PRODUCT":{"CAN_BUY":false}},5,null]}', part, q),
        F.format_string('{"variations":[{"id":"%d","name":"first","type":"color","price":"7,5","stock":3},{"id":"x","label":"second"},5]}', part),
        F.format_string('{"product_variations":[{"variation_id":%d,"attributes":{"a_color":"red","b_size":"XL"},"display_price":%d.25,"max_qty":%d},{}]}', part, q, q),
        F.format_string('{"spConfig":{"attributes":{"%d":{"label":"Color","options":[{"id":"1","label":"red","price":"%d"},{"id":"2","label":"blue"}]}}}}', part, q),
    ]
    v = F.col("l_orderkey") % 6
    doc = docs[5]
    for i in range(5):
        doc = F.when(v == i, docs[i]).otherwise(doc)
    rows = li.select("l_orderkey", "l_linenumber", choice(v, VENDORS).alias("vendor"), doc.alias("payload"))
    out = O.payload_variants(rows, "vendor", "payload", "l_orderkey", "l_linenumber", base_price=F.lit(99.0))
    return out.select("l_orderkey", "l_linenumber", "vendor", "pos", "variation_id", "value", "price", "stock", "type", "in_stock", "currency")


@query(
    "embedded_variants",
    """SELECT page_id, vendor, variation_id, value, price::DOUBLE AS price, stock::DOUBLE AS stock FROM (
      SELECT page_id, 'bitrix' AS vendor, CAST(page_id AS VARCHAR) AS variation_id, 'n' AS value, 12.5 AS price, 4 AS stock FROM pages WHERE page_id % 7 = 0
      UNION ALL SELECT page_id, 'insales', '1', 'S', 5, 2 FROM pages WHERE page_id % 9 = 0
      UNION ALL SELECT page_id, 'shopify', '2', 'M', 3, page_id % 4 FROM pages WHERE page_id % 9 = 0
      UNION ALL SELECT page_id, 'magento', '3', 'L', 8, 1 FROM pages WHERE page_id % 10 = 0
      UNION ALL SELECT page_id, 'bitrix', page_id || '-1', 'it''s я', 7.5, 3 FROM pages WHERE page_id % 3 = 0
      UNION ALL SELECT page_id, 'bitrix', page_id || '-2', 'two', 8, page_id % 5 FROM pages WHERE page_id % 3 = 0
      UNION ALL SELECT page_id, 'insales', '5', 'A', 9, 2 FROM pages WHERE page_id % 4 = 0
      UNION ALL SELECT page_id, 'insales', '6', 'B', 4, page_id % 6 FROM pages WHERE page_id % 4 = 0)""",
)
def embedded_variants(spark, d):
    """Variation rows of vendor data inside pages: JSON and object literals in scripts and data attributes."""
    n, page = F.col("page_id"), F.col("page_id").cast("string")
    # Several objects in one script, in code and followed by other calls.
    shop = F.when(n % 7 == 0, F.concat(F.lit('var a = {}; if (a) { new Shop({"OFFERS":[{"ID":"'), page, F.lit('","NAME":"n","PRICE":"12,5","STOCK":"4"}]}); } BX.message({"a":"}"});')))
    init = F.when(n % 10 == 0, F.lit('init({"form":{"spConfig":{"attributes":{"9":{"label":"Size","options":[{"id":"3","label":"L","price":"8"}]}}}}});'))
    parts = [
        F.concat(F.lit("<script>"), F.coalesce(shop, F.lit("")), F.coalesce(init, F.lit("")), F.lit("</script>")),
        F.when(n % 9 == 0, F.concat(
            F.lit("""<div data-variants='[{"id":1,"title":"S","price":"5","quantity":2}]'></div><i data-product="{&quot;variants&quot;:[{&quot;id&quot;:2,&quot;title&quot;:&quot;M&quot;,&quot;price&quot;:300,&quot;inventory_quantity&quot;:"""),
            (n % 4).cast("string"), F.lit('}]}"></i><script>not {json}</script>'))),
        # What shops write more often than JSON: single quotes, bare names, trailing commas, escapes, functions beside the data.
        F.when(n % 3 == 0, F.concat(
            F.lit(r"""<script>/* {'OFFERS': [ */ var ok = /['{]/.test(s); new JCCatalogElement({'CONFIG': {USE: !0, 'T': "it's"}, OFFERS: [{'ID': '"""), page,
            F.lit(r"""-1', NAME: 'it\'s \u044f', "PRICE": '7,5', STOCK: 3,}, {ID: '"""), page, F.lit("""-2', 'NAME': `two`, PRICE: 8.0, STOCK: """), (n % 5).cast("string"),
            F.lit("""},], 'READY': function () { return {}; }, }); BX.ready(function () { x = 'a{b'; });</script>"""))),
        F.when(n % 4 == 0, F.concat(
            F.lit("""<script>window.p = {get: function (a) { return a < 1 ? {} : [a]; }, variants: [{id: 5, title: 'A', price: '9', quantity: 0x2}]}</script><b data-product="{variants:[{id:6,title:'B',price:4,quantity:"""),
            (n % 6).cast("string"), F.lit(""",},],}"></b>"""))),
    ]
    pages = table(spark, d, "pages").select("page_id", F.concat("html", *[F.coalesce(p, F.lit("")) for p in parts]).alias("html"))
    found = O.embedded_payloads(H.parse_pages(pages), "page_id")
    return O.payload_variants(found, "vendor", "payload", "page_id").select("page_id", "vendor", "variation_id", "value", "price", "stock")


@query(
    "preferred_sources",
    f"""WITH {VARIATIONS}, s AS (SELECT *, CASE WHEN type = 'A' AND pk % 2 <> 0 THEN 0 WHEN type = 'N' AND pk % 3 <> 0 THEN 1 ELSE 2 END AS source_rank FROM variations)
    SELECT pk, variation_id, CAST(source_rank AS INTEGER) AS source_rank FROM s QUALIFY source_rank = min(source_rank) OVER (PARTITION BY pk)""",
)
def preferred_sources(spark, d):
    """Variations of the best source per product."""
    v = variations(spark, d)
    # Each row comes from one of the three sources.
    source = F.when((F.col("type") == "A") & (F.col("pk") % 2 != 0), 0).when((F.col("type") == "N") & (F.col("pk") % 3 != 0), 1).otherwise(2)
    api, payload, page = (v.where(source == k) for k in range(3))
    return O.prefer_sources(products(spark, d), [api, payload, page], "pk").select("pk", "variation_id", "source_rank")


@query(
    "product_stock",
    f"""WITH {PRODUCTS}, {VARIATIONS}, r AS (SELECT pk, round(sum(CASE WHEN stock > 10 THEN stock WHEN in_stock THEN 1.0 ELSE 0.0 END), 3) AS s, bool_or(in_stock) AS i FROM variations GROUP BY pk)
    SELECT pk, coalesce(s, stock)::DOUBLE AS total_stock, coalesce(i, in_stock) OR stock > 0 AS any_in_stock FROM products LEFT JOIN r USING (pk)""",
)
def product_stock(spark, d):
    """Product stock from its variations."""
    v = variations(spark, d).withColumn("stock", F.when(F.col("stock") > 10, F.col("stock")))
    return O.product_stock(products(spark, d), v, "pk").select("pk", "total_stock", "any_in_stock")


@query(
    "display_texts",
    f"""WITH {VARIATIONS}, r AS (SELECT pk, min(price) AS lo, max(price) AS hi, CAST(sum(stock) AS BIGINT) AS s, count(*) AS n FROM variations GROUP BY pk)
    SELECT pk, format('{{:,.2f}} ₽', lo) || CASE WHEN lo = hi THEN '' ELSE ' - ' || format('{{:,.2f}} ₽', hi) END AS price_text,
      printf('Total: %d, Avg: %.1f', s + 5, floor((s + 5) / (n + 1) * 10 + 0.5) / 10) AS stock_text FROM r""",
)
def display_texts(spark, d):
    """Price-range and stock lines per product."""
    r = variations(spark, d).groupBy("pk").agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum("stock").cast("bigint").alias("s"), F.count("*").alias("n")
    )
    return r.select("pk", V.price_range_text(F.col("lo"), F.col("hi")).alias("price_text"), V.stock_text(F.lit(5), F.col("s"), F.col("n")).alias("stock_text"))


SHOP = (
    '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Item ID","sku":"S-ID","brand":{"name":"B"},"offers":{"price":"ID.5","priceCurrency":"RUB",'
    '"availability":"https://schema.org/InStock"}},{"@type":"Thing"}]}</script><h2 class="product-title big">Item ID</h2><div class="shop-price now"><b>ID</b> ₽</div>'
    '<span class="avail">5 шт</span><div itemtype="x"></div><label for="option_1">Size</label><select name="option_1"><option value="">Select</option>'
    '<option value="a" data-price="10" data-quantity="3">S + 10 р.</option><option value="b">XL</option></select>'
    '<table class="variations x"><tr><td>h</td><td>h</td><td>h</td></tr><tr><td>M</td><td>red</td><td>1 200 ₽</td></tr><tr><td></td><td>blue</td><td>-</td></tr><tr><td>short</td></tr></table>'
)


def shop_pages(spark, d):
    """Every page with a product block that carries the page's number."""
    block = F.replace(F.lit(SHOP), F.lit("ID"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", "url", F.concat("html", block).alias("html"))


@query(
    "structured_products",
    """SELECT page_id, 'Item ' || page_id AS name, 'S-' || page_id AS sku, 'B' AS brand, page_id + 0.5::DOUBLE AS price, 'RUB' AS currency, 'InStock' AS availability FROM pages""",
)
def structured_products(spark, d):
    """Products out of JSON-LD."""
    return O.structured_products(H.parse_pages(shop_pages(spark, d)), "page_id")


@query("structured_data_marks", "SELECT page_id, TRUE AS has_json_ld, TRUE AS has_microdata, 0 AS form_count, 2 AS script_count FROM pages")
def structured_data_marks(spark, d):
    """Structured-data marks per page."""
    return O.structured_data_marks(H.parse_pages(shop_pages(spark, d)), "page_id")


RULES = (
    O.Rule("name", "h3", "product-title"),
    O.Rule("name", "h2", "product-title"),
    O.Rule("name", "h1"),
    O.Rule("price", attr=("itemprop", "price"), read="content"),
    O.Rule("price", "div", "shop-price"),
    O.Rule("currency", "meta", attr=("itemprop", "priceCurrency"), read="content"),
)


@query(
    "fields_by_rules",
    """SELECT page_id, 'Item ' || page_id AS name, page_id || '₽' AS price, NULL::VARCHAR AS currency, 'h2.product-title' AS name_rule, 'div.shop-price' AS price_rule, NULL::VARCHAR AS currency_rule FROM pages""",
)
def fields_by_rules(spark, d):
    """Product fields by ordered rules, with the winning rule."""
    return O.fields_by_rules(H.parse_pages(shop_pages(spark, d)), RULES, "page_id")


@query(
    "discovered_selectors",
    """WITH p AS (SELECT page_id % 9 AS site FROM pages), s(field, selector) AS (VALUES ('name', 'h2.product-title.big'), ('price', 'div.shop-price.now'), ('stock', 'span.avail'))
    SELECT site, field, selector, count(*) AS pages FROM p, s GROUP BY ALL""",
)
def discovered_selectors(spark, d):
    """Candidate selectors with their support."""
    return O.discovered_selectors(H.parse_pages(shop_pages(spark, d).withColumn("site", F.col("page_id") % 9)), "site")


@query(
    "option_variations",
    """SELECT page_id, 'S' AS value, 'size' AS type, 110.0::DOUBLE AS price, 3 AS stock FROM pages UNION ALL SELECT page_id, 'XL', 'size', 100.0, 9 FROM pages""",
)
def option_variations(spark, d):
    """Variations from option lists."""
    out = O.option_variations(H.parse_pages(shop_pages(spark, d)), "page_id", base_price=F.lit(100.0), base_stock=F.lit(9))
    return out.select("page_id", "value", "type", "price", "stock")


@query(
    "table_variations",
    """SELECT page_id, 1 AS pos, 'size_color' AS type, 'M red' AS value, 1200.0::DOUBLE AS price FROM pages UNION ALL SELECT page_id, 2, 'color', 'blue', 0.0 FROM pages""",
)
def table_variations(spark, d):
    """Variations from three-column tables."""
    return O.table_variations(H.parse_pages(shop_pages(spark, d)), "page_id")


ROBOTS = (
    "# rules", "User-agent: *", "Disallow: /private", "Allow: /private/open", "Crawl-delay: 7", "Sitemap: /s.xml", "User-agent: ShopBot",
    "Disallow: /goods/1", "Allow: /goods/12", "Crawl-delay: 2",
)


@query(
    "robots_verdicts",
    """WITH u AS (SELECT l_orderkey, l_linenumber, l_suppkey % 10 AS host, '/goods/' || l_partkey AS path FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN host = 9 THEN TRUE WHEN host % 2 = 0 THEN NOT (starts_with(path, '/goods/1') AND NOT starts_with(path, '/goods/12')) ELSE TRUE END AS allowed,
      CASE WHEN host = 9 THEN 0 WHEN host % 2 = 0 THEN 2 ELSE 7 END::DOUBLE AS crawl_delay FROM u""",
)
def robots_verdicts(spark, d):
    """Robots rules applied to addresses: longest prefix, own agent before the general one."""
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("host")).distinct().where("host <> 9")
    lines = s.select("host", F.posexplode(F.array(*[F.lit(x) for x in ROBOTS])).alias("pos", "line"))
    # odd hosts only have the general section
    lines = lines.where((F.col("host") % 2 == 0) | (F.col("pos") < 6))
    rules = O.robots_rules(lines, "host", "pos", "line")
    u = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("host"), F.concat(F.lit("https://a.example.com/goods/"), F.col("l_partkey"), F.lit("?x=1")).alias("url")
    )
    return O.robots_verdicts(u, rules, "host", "url", "shopbot").select("l_orderkey", "l_linenumber", "allowed", "crawl_delay")
