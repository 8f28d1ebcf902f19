"""How the driver tables play the roles of a crawl (products, variations, crawls, logs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogwatch.plans.registry import table
from catalogwatch.session import spread

# --- catalogue -------------------------------------------------------------------------------

PRODUCTS = """products AS (
  SELECT p_partkey AS pk,
         concat('https://shop', p_size, '.example.com/product/', p_partkey, '/') AS url,
         concat('shop', p_size, '.example.com') AS site_domain,
         p_name AS name, p_brand AS brand, p_type AS category, concat('SKU-', p_partkey) AS sku,
         p_retailprice AS price, CAST(p_size AS DOUBLE) AS stock, p_size > 5 AS in_stock
  FROM part)"""

VARIATIONS = """variations AS (
  SELECT l_partkey AS pk, l_orderkey * 10 + l_linenumber AS pos,
         concat(l_orderkey, '-', l_linenumber) AS variation_id,
         l_extendedprice AS price, l_quantity AS stock, l_returnflag AS type,
         l_returnflag <> 'R' AS in_stock
  FROM lineitem)"""


def products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    site = F.concat(F.lit("shop"), F.col("p_size"), F.lit(".example.com"))
    return p.select(
        F.col("p_partkey").alias("pk"),
        F.concat(F.lit("https://"), site, F.lit("/product/"), F.col("p_partkey"), F.lit("/")).alias("url"),
        site.alias("site_domain"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("sku"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").cast("double").alias("stock"),
        (F.col("p_size") > 5).alias("in_stock"),
    )


def variations(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem")
    return v.select(
        F.col("l_partkey").alias("pk"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("variation_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("stock"),
        F.col("l_returnflag").alias("type"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
    )


def offers(spark: SparkSession, d: str) -> DataFrame:
    """Every order line as one nested product record with its variations in the row."""
    v = spread(table(spark, d, "lineitem"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    text_price = F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(","))

    def option(tag: str, price: Column, stock: Column, flag: Column) -> Column:
        return F.struct(
            F.concat(key, F.lit(tag)).alias("variation_id"),
            F.lit("size").alias("type"),
            F.lit(tag).alias("value"),
            price.cast("string").alias("price"),
            stock.alias("stock"),
            flag.alias("in_stock"),
        )

    first = option("a", F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")), F.col("l_quantity"), F.col("l_returnflag") == "A")
    second = option("b", F.round(F.col("l_extendedprice") + 1, 2), F.lit(None).cast("double"), F.lit(None).cast("boolean"))
    none = F.array().cast(f"array<{_struct_ddl()}>")
    return v.select(
        key.alias("key"),
        F.concat(F.lit(" https://shop.example.com/product/"), key, F.lit(" ")).alias("url"),
        F.concat(F.lit("part "), F.col("l_partkey")).alias("name"),
        text_price.alias("price"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("string")).otherwise(F.lit(" ")).alias("stock"),
        F.array(F.lit("goods"), F.col("l_linestatus"), F.lit(" ")).alias("categories"),
        F.when(F.col("l_returnflag") == "N", none).otherwise(F.array(first, second)).alias("variations"),
    )


def _struct_ddl() -> str:
    return (
        "struct<variation_id:string,type:string,value:string,price:string,stock:double,in_stock:boolean>"
    )


# --- crawls ----------------------------------------------------------------------------------

# Crawl of a page before and from the cut day: the last order of a customer on each side.
CUT = "1998-01-01"

CRAWLS = """crawls AS (
  SELECT concat('https://shop.example.com/item/', o_custkey) AS url, o_orderkey AS job_id, o_orderdate AS crawl_at,
         o_totalprice AS price, o_orderstatus AS availability, o_orderpriority AS title, o_custkey
  FROM orders)"""


def crawls(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("https://shop.example.com/item/"), F.col("o_custkey")).alias("url"),
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderdate").alias("crawl_at"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("availability"),
        F.col("o_orderpriority").alias("title"),
        "o_custkey",
    )


# --- request log -----------------------------------------------------------------------------

REQUESTS = """requests AS (
  SELECT event_id AS id, ts, epoch_us(ts) AS us, user_id AS key, event_type AS kind,
         event_type <> 'error' AS success, value AS latency,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"),
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("user_id").alias("key"),
        F.col("event_type").alias("kind"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("latency"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def stamp(c: Column) -> Column:
    """Second-precise text form of a timestamp."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
