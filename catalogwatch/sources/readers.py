"""Readers for landed crawl files. All are lazy; bad records are dropped or set aside, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.functions import urls as U
from catalogwatch.functions.values import strip
from catalogwatch.sources.json_arrays import CHUNK_BYTES, json_elements

# Fixed value: the fields a product record is read with; further keys stay in the raw text.
PRODUCT_DDL = (
    "url string, original_url string, final_url string, site_domain string, product_id string, sku string, name string, "
    "title string, currency string, brand string, price string, base_price string, stock string, stock_quantity string, "
    "quantity string, inventory string, available string, in_stock boolean, availability string, status_code int, "
    "http_status int, scraped_at string, fetched_at string, seo_title string, seo_h1 string, seo_meta_description string, "
    "open_graph map<string,string>, twitter map<string,string>, category string, breadcrumbs array<string>, "
    "images array<string>, images_alt array<string>, text_hash string, content_hash string, error string, "
    "variations array<struct<variation_id:string,variation_sku:string,type:string,value:string,price:string,stock:string,"
    "in_stock:boolean,attributes:map<string,string>>>"
)
# Log line forms.
LOG_STAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
LOG_PROXY = r"((?:https?|socks5)://[\w.:@-]+)"
BURN_WORD = "burn"
FAILURE_WORDS = ("fail", "error", "timeout")
HTTP_500 = r"(?i)HTTP/\d\.\d\"\s*500\b|status[_\s:=\"]+500\b|statusCode\s*=\s*500\b"
API_ERROR = r"(?i)\bapi\b.*\berr"
TRACEBACK = r"Traceback \(most recent call last\)"


def read_products(spark: SparkSession, path, ddl: str = PRODUCT_DDL) -> DataFrame:
    """Export files: an object with ``products`` or a bare list; entries that are not objects drop out.

    A file is read whole by one task; for large exports there is :func:`read_large_products`.
    """
    raw = spark.read.text(path, wholetext=True)
    return products_from_json(raw, "value", ddl)


def read_large_products(spark: SparkSession, path, ddl: str = PRODUCT_DDL, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The same of exports of any size: a file is read by as many tasks as it has ranges. ``at`` orders the rows of a file.

    Other than above, a document that breaks off gives the products before the break.
    """
    rows = json_elements(spark, path, "products", chunk_bytes).where(F.col("value").startswith("{"))
    read = rows.select("path", "at", F.from_json("value", ddl).alias("_p"), F.try_parse_json("value").isNotNull().alias("_ok"))
    return read.where("_ok").select("path", "at", "_p.*")


def read_large_url_map(spark: SparkSession, path, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, at, url`` of URL maps of any size."""
    rows = json_elements(spark, path, "links", chunk_bytes)
    return rows.select("path", "at", _entry_url(F.try_parse_json("value")).alias("url")).where(F.col("url").isNotNull())


def products_from_json(docs: DataFrame, column: str, ddl: str = PRODUCT_DDL) -> DataFrame:
    """Product rows out of JSON documents held in a text column."""
    doc = F.col("_doc")
    items = F.coalesce(
        F.try_variant_get(doc, "$.products", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>")
    )
    # A column of its own, or the document would be parsed once for each place that names it.
    parsed = docs.select(F.try_parse_json(F.col(column)).alias("_doc"))
    rows = parsed.select(F.posexplode(items).alias("pos", "_v"))
    text = F.to_json("_v")
    return rows.where(text.startswith("{")).select("pos", F.from_json(text, ddl).alias("_p")).select("pos", "_p.*")


def read_partial(spark: SparkSession, path, ddl: str = PRODUCT_DDL, rejects: bool = False) -> DataFrame:
    """Partial-run JSON lines; broken lines are dropped, or returned when ``rejects`` is set."""
    schema = T.StructType.fromDDL(ddl).add("_corrupt_record", "string")
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("_p"))
    bad = F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull()
    return parsed.where(bad).select("value") if rejects else parsed.where(~bad).select("_p.*").drop("_corrupt_record")


def links_from_json(docs: DataFrame, column: str, carry=()) -> DataFrame:
    """URL entries of map files: ``links`` of texts or ``{url}`` records."""
    doc = F.try_parse_json(F.col(column))
    items = F.try_variant_get(doc, "$.links", "array<variant>")
    rows = docs.select(*carry, F.posexplode(items).alias("pos", "_v"))
    return rows.select(*carry, "pos", _entry_url(F.col("_v")).alias("url")).where(F.col("url").isNotNull())


def _entry_url(v: Column) -> Column:
    """The text itself, or the ``url`` of a record; other kinds give null."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(
        kind.startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get(v, "$.url", "variant")) == "STRING"),
        F.try_variant_get(v, "$.url", "string"),
    )


def read_url_map(spark: SparkSession, path) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return links_from_json(docs, "value", ["file"])


def preseed_from_json(docs: DataFrame, column: str) -> DataFrame:
    """Pre-seeded URLs from any accepted shape (links object, object of lists, list), normalised, first wins."""
    doc = F.try_parse_json(F.col(column))
    links = F.try_variant_get(doc, "$.links", "array<variant>")
    listed = F.try_variant_get(doc, "$", "array<variant>")
    values = F.map_values(F.try_variant_get(doc, "$", "map<string,variant>"))
    nested = F.flatten(
        F.transform(
            values,
            lambda v: F.coalesce(
                F.try_variant_get(v, "$", "array<variant>"),
                F.when(F.schema_of_variant(v) == "STRING", F.array(v)).otherwise(F.array().cast("array<variant>")),
            ),
        )
    )
    rows = docs.select(F.posexplode(F.coalesce(links, listed, nested)).alias("pos", "_v"))
    url = F.nullif(U.slash_path(_entry_url(F.col("_v"))), F.lit(""))
    return rows.select(url.alias("url"), "pos").where(F.col("url").isNotNull()).groupBy("url").agg(F.min("pos").alias("pos"))


def read_preseed(spark: SparkSession, path) -> DataFrame:
    return preseed_from_json(spark.read.text(path, wholetext=True), "value")


def read_sitemap(spark: SparkSession, path) -> DataFrame:
    """``urlset`` entries of landed sitemaps."""
    schema = "loc string, changefreq string, lastmod string, priority string"
    return spark.read.format("xml").option("rowTag", "url").schema(schema).load(path).select(
        strip(F.col("loc")).alias("url"), "changefreq", "lastmod", "priority"
    ).where(F.col("url").isNotNull())


def read_sitemap_index(spark: SparkSession, path) -> DataFrame:
    """``sitemapindex`` entries: parent file and child map."""
    schema = "loc string, lastmod string"
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema(schema).load(path)
    return rows.select(F.input_file_name().alias("parent"), strip(F.col("loc")).alias("child")).where(F.col("child").isNotNull())


def filter_sitemap(entries: DataFrame) -> DataFrame:
    """Daily or weekly entries, and product addresses of any frequency."""
    often = F.coalesce(F.col("changefreq").isin("daily", "weekly"), F.lit(False))
    return entries.where(often | U.is_product_url(F.col("url")))


# Steps of doubled length may be this many times as many as there are edges; beyond, their length stays.
STEP_GROWTH = 4


def expand_sitemaps(edges: DataFrame, roots: DataFrame, growth: int = STEP_GROWTH) -> DataFrame:
    """All maps reachable from the roots, with their least depth: ``map, depth``.

    Once all maps nearer than some length are known, steps of that length reach all maps nearer than twice of it, and two such
    steps make one of the double length. So a chain of d levels takes some log d rounds instead of d. Where maps have many parents,
    longer steps become too many; then their length stays, and rounds go on with it. It ends at the first round that finds nothing
    new. Cycles, loops and repeated edges change nothing; rows with a null are left out.
    """
    from catalogwatch.session import cut_lineage

    step = cut_lineage(
        edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    )
    most, length, grows = growth * step.count(), 1, True
    reached = cut_lineage(roots.select("map").where("map IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    known = None
    while True:
        more = reached.join(step, F.col("map") == F.col("a")).select(F.col("b").alias("map"), (F.col("depth") + length).alias("depth"))
        reached = cut_lineage(reached.unionByName(more).groupBy("map").agg(F.min("depth").alias("depth")))
        now = tuple(reached.agg(F.count("*"), F.sum("depth")).first())
        if now == known:
            break
        known = now
        if grows:
            # How many longer steps there will be at most, from the numbers of steps into and out of each map.
            into, out_of = (step.groupBy(F.col(c).alias("m")).agg(F.count("*").alias(f"n_{c}")) for c in ("b", "a"))
            grows = (into.join(out_of, "m").agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0) <= most
        if grows:
            pairs = step.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
            step = cut_lineage(pairs.where("a <> b").distinct())
            length *= 2
    return reached.select("map", F.col("depth").cast("int").alias("depth"))


def read_cached_urls(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).where(F.col("url") != "")


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Plain log lines -> time stamp, canonical proxy, burned and failed flags (proxy lines only)."""
    c = F.col(column)
    stamp = F.try_to_timestamp(F.nullif(F.regexp_extract(c, LOG_STAMP, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    proxy = U.canonical_proxy(F.nullif(F.regexp_extract(c, LOG_PROXY, 1), F.lit("")))
    failed = c.rlike("(?i)" + "|".join(FAILURE_WORDS))
    return lines.select(
        stamp.alias("ts"), proxy.alias("proxy"), c.rlike("(?i)" + BURN_WORD).alias("burned"), failed.alias("failed")
    ).where(F.col("proxy").isNotNull() | F.col("ts").isNotNull())


def read_text_log(spark: SparkSession, path) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON event lines with field aliases; lines that do not parse drop out."""
    fields = "proxy string, proxy_url string, status string, event string, timestamp string"
    rows = lines.select(F.from_json(column, fields).alias("_e"))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"_e.{n}"), F.lit("")) for n in names])
    status = F.lower(F.coalesce(first("status", "event"), F.lit("")))
    out = rows.select(
        F.try_to_timestamp(F.col("_e.timestamp")).alias("ts"), U.canonical_proxy(first("proxy", "proxy_url")).alias("proxy"),
        (status == "burned").alias("burned"), (status == "failure").alias("failed"),
    )
    return out.where(F.col("proxy").isNotNull())


def read_event_log(spark: SparkSession, path) -> DataFrame:
    return parse_event_lines(spark.read.text(path))


def parse_proxy_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Address lines and ``host:port[:user:password]`` lines; comments and blanks drop out."""
    c = strip(F.col(column))
    part = F.split(c, ":")
    plain = (
        F.when(c.contains("://"), c)
        .when(F.size(part) == 4, F.concat(F.lit("https://"), part[2], F.lit(":"), part[3], F.lit("@"), part[0], F.lit(":"), part[1]))
        .when(F.size(part) == 2, F.concat(F.lit("https://"), part[0], F.lit(":"), part[1]))
    )
    return lines.withColumn("raw", plain).where((c != "") & ~c.startswith("#") & F.col("raw").isNotNull())


def read_proxy_list(spark: SparkSession, path) -> DataFrame:
    return parse_proxy_lines(spark.read.text(path)).select("raw")


def scan_error_lines(lines: DataFrame, column: str = "value", by=()) -> DataFrame:
    """How many lines report a 500 answer, an API error, a traceback."""
    c = F.col(column)
    return lines.groupBy(*by).agg(
        F.count_if(c.rlike(HTTP_500)).alias("http_500"),
        F.count_if(c.rlike(API_ERROR)).alias("api_errors"),
        F.count_if(c.rlike(TRACEBACK)).alias("tracebacks"),
    )


def scan_error_logs(spark: SparkSession, path) -> DataFrame:
    return scan_error_lines(spark.read.option("recursiveFileLookup", "true").text(path))


AUDIT_DDL = (
    "timestamp string, userId string, username string, role string, action string, resource string, "
    "details map<string,string>, ip string, userAgent string, success boolean, error string"
)


def read_audit(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(AUDIT_DDL).option("mode", "DROPMALFORMED").json(path)


def read_full_export(spark: SparkSession, path, sep: str = ";", decimal_comma: bool = True) -> DataFrame:
    """A written ``full`` table; older files use ``,`` and a decimal dot."""
    from catalogwatch.functions.values import to_number
    from catalogwatch.operators.catalogue import FULL_COLUMNS

    names = spark.read.option("header", True).option("sep", sep).option("escape", "\"").csv(path)
    cols = []
    for c in names.columns:
        kind = FULL_COLUMNS.get(c, "string")
        if kind == "double":
            cols.append((to_number(F.col(c)) if decimal_comma else F.col(c).try_cast("double")).alias(c))
        else:
            cols.append(F.col(c).try_cast(kind).alias(c))
    return names.select(*cols)


def read_table(spark: SparkSession, path_or_url: str, name: str | None = None, **options: str) -> DataFrame:
    """Jobs, pages, snapshots, exports: a parquet folder, or a JDBC table when a ``jdbc:`` address is given."""
    if path_or_url.startswith("jdbc:"):
        return spark.read.format("jdbc").option("url", path_or_url).option("dbtable", name).options(**options).load()
    return spark.read.parquet(path_or_url)
