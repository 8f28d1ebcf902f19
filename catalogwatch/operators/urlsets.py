"""Large URL sets: clean, merge, subtract, number, sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.functions import urls as U

from catalogwatch.operators.catalogue import keep_last
from catalogwatch.session import cut_lineage


def clean_url_map(
    links: DataFrame,
    pos: str,
    url: str = "url",
    allowed_hosts=None,
    include: Callable[[Column], Column] | None = None,
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Normalised http(s) URLs of the allowed hosts; the first position of each stays.

    ``normalise`` and ``include`` are column functions supplied by the caller.
    """
    c = F.nullif(U.strip_url(F.col(url)), F.lit(""))
    if normalise:
        c = F.nullif(normalise(c), F.lit(""))
    out = links.select(c.alias("url"), F.col(pos).alias("pos")).where(F.col("url").isNotNull())
    keep = U.scheme_of(F.col("url")).isin("http", "https")
    if allowed_hosts:
        keep = keep & F.lower(U.netloc_of(F.col("url"))).isin(*[h.lower() for h in allowed_hosts])
    if include:
        keep = keep & include(F.col("url"))
    return out.where(keep).groupBy("url").agg(F.min("pos").alias("pos"))


def with_site_rules(urls: DataFrame, profiles: DataFrame) -> DataFrame:
    """Keep the URLs that satisfy the profile of their own site.

    ``profiles``: domain, patterns, min_segments, numeric_last. An equi-join on the domain; a URL
    without a profile is dropped.
    """
    host = U.normalise_domain(U.host_of(F.col("url")))
    j = urls.withColumn("domain", host).join(profiles, "domain")
    u = F.lower("url")
    hit = U.is_product_url(F.col("url")) | F.exists("patterns", lambda p: F.contains(u, F.lower(p)))
    deep = U.path_segments(F.col("url")) >= F.coalesce("min_segments", F.lit(0))
    numeric = ~F.coalesce("numeric_last", F.lit(False)) | U.last_segment(F.col("url")).rlike(r"^\d+$")
    return j.where(hit & deep & numeric).select(*urls.columns, "domain")


def filter_products(urls: DataFrame, patterns=(), min_segments: int = 0, numeric_last: bool = False) -> DataFrame:
    return urls.where(U.looks_like_product(F.col("url"), patterns, min_segments, numeric_last))


def merge_ordered(sources: list[DataFrame], pos: str = "pos") -> DataFrame:
    """Union of several URL lists without repeats: each URL with the first list and place that has it."""
    tagged = [s.select("url", F.lit(i).alias("source"), F.col(pos).alias("pos")) for i, s in enumerate(sources)]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t)
    merged = merged.where(F.coalesce("url", F.lit("")) != "")
    first = merged.groupBy("url").agg(F.min(F.struct("source", "pos")).alias("_o"))
    return first.select("url", "_o.source", "_o.pos")


def discover(existing: DataFrame, site_map: DataFrame, preseed: DataFrame, sitemap: DataFrame, category: DataFrame,
             force_category: bool = False, preseed_replaces: bool = False) -> DataFrame:
    """Prioritised union; the category list counts only when the others found nothing (or is forced).

    The "found nothing" test stays in the plan as a subquery that stops at the first row.
    """
    if not force_category:
        others = site_map.select("url").unionByName(preseed.select("url")).unionByName(sitemap.select("url"))
        category = category.where(~others.exists())
    sources = [site_map, preseed, sitemap, category]
    return merge_ordered(sources if preseed_replaces else [existing, *sources])


def pending_urls(urls: DataFrame, processed: DataFrame) -> DataFrame:
    """URLs not yet processed under their address or their original address."""
    done = processed.select(F.explode(F.array("url", "original_url")).alias("url")).where(F.coalesce("url", F.lit("")) != "")
    return urls.join(done.distinct(), "url", "left_anti")


def processed_urls(urls: DataFrame, processed: DataFrame) -> DataFrame:
    """URLs already processed under either address."""
    done = processed.select(F.explode(F.array("url", "original_url")).alias("url")).where(F.coalesce("url", F.lit("")) != "")
    return urls.join(done.distinct(), "url", "left_semi")


def _keys(df: DataFrame, *carry: str) -> DataFrame:
    keys = F.array_distinct(F.filter(F.array("url", "original_url"), lambda k: k.isNotNull() & (k != "")))
    return df.select(*carry, F.explode(keys).alias("_key"))


def merge_products(existing: DataFrame, new: DataFrame, pos: str = "pos") -> DataFrame:
    """Existing rows, then each new row none of whose two keys was seen on an accepted row before.

    A new row is accepted once it is the earliest open row on every key it has; rows sharing a key
    with an accepted row are then refused. Repeating this reproduces the sequential rule exactly;
    the number of rounds is the length of the longest chain of decisions, not the number of rows.
    """
    seen = _keys(existing).distinct()
    keyed = _keys(new, pos)
    blocked = keyed.join(seen, "_key", "left_semi").select(pos).distinct()
    open_keys = cut_lineage(keyed.join(blocked, pos, "left_anti"))
    accepted = None
    while True:
        lead = open_keys.groupBy("_key").agg(F.min(pos).alias("_lead"))
        judged = open_keys.join(lead, "_key")
        won = cut_lineage(judged.groupBy(pos).agg(F.min(F.col("_lead") == F.col(pos)).alias("_won")).where("_won").select(pos))
        if won.isEmpty():
            break
        accepted = won if accepted is None else accepted.unionByName(won)
        taken = open_keys.join(won, pos, "left_semi").select("_key").distinct()
        lost = open_keys.join(taken, "_key", "left_semi").select(pos).distinct()
        open_keys = cut_lineage(open_keys.join(lost, pos, "left_anti"))
    no_key = (F.coalesce("url", F.lit("")) == "") & (F.coalesce("original_url", F.lit("")) == "")
    keep = new.where(no_key)
    if accepted is not None:
        keep = keep.unionByName(new.join(accepted, pos, "left_semi").select(*new.columns))
    return existing.select(*new.columns).withColumn("origin", F.lit("existing")).unionByName(
        keep.withColumn("origin", F.lit("new"))
    )


def pick_url_map(maps: DataFrame, as_of: Column, domain: str = "domain", modified: str = "modified_us", max_days: int = 7) -> DataFrame:
    """Per site: a fresh canonical map, else the newest usable one; maps without links are skipped."""
    fresh = F.col("is_canonical") & (as_of - F.col(modified) <= max_days * 86400 * 1_000_000)
    usable = maps.where(F.col("link_count") > 0).withColumn("_fresh", F.coalesce(fresh, F.lit(False)))
    return keep_last(usable, domain, ["_fresh", modified, "map_id"]).drop("_fresh")


def merge_proxies(sources: list[DataFrame]) -> DataFrame:
    """All proxy sources; the last definition of a canonical address wins."""
    tagged = None
    for i, s in enumerate(sources):
        t = s.select("raw", F.lit(i).alias("source"), F.col("pos"))
        tagged = t if tagged is None else tagged.unionByName(t)
    c = U.canonical_proxy(F.col("raw"))
    rows = tagged.select(c.alias("canonical"), U.scheme_of(c).alias("protocol"), U.host_of(c).alias("host"), "raw", "source", "pos")
    return keep_last(rows.where(F.col("canonical").isNotNull()), "canonical", ["source", "pos"])


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """Repeatable random sample of ``n`` rows: smallest keyed hashes (top-k, no full sort)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), key).limit(n)


# Buckets whose sizes are accumulated in one task.
BUCKETS = 4096


def dense_index(df: DataFrame, order: list[str], bucket: Column, name: str = "index") -> DataFrame:
    """Global 0-based position without a global sort.

    ``bucket`` is a coarse, order-compatible whole number; rows are numbered inside their bucket. Bucket sizes are
    accumulated in two levels, within blocks of ``BUCKETS`` buckets and over the blocks, so no task gets all buckets.
    """
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_g", F.floor(F.col("_b") / BUCKETS))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("_g").agg(F.sum("_n").alias("_n")).select("_g", before(Window.orderBy("_g")).alias("_block"))
    inner = sizes.select("_b", "_g", before(Window.partitionBy("_g").orderBy("_b")).alias("_before"))
    starts = inner.join(blocks, "_g").select("_b", (F.col("_block") + F.col("_before")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    out = b.withColumn("_i", inside).join(starts, "_b")
    return out.withColumn(name, F.col("_start") + F.col("_i")).drop("_b", "_i", "_start")


def assign_batches(indexed: DataFrame, size: int, offset: int = 0, max_batches: int = 0, index: str = "index") -> DataFrame:
    """Batch number and label for indexed rows; ``offset`` and ``max_batches`` count batches (0 = no limit).

    Without a batch size everything is one ``full-catalog`` batch.
    """
    if size <= 0:
        return indexed.withColumns({"batch": F.lit(0), "label": F.lit("full-catalog")})
    out = indexed.withColumn("batch", (F.floor(F.col(index) / size) + 1).cast("int")).where(F.col("batch") > max(offset, 0))
    if max_batches > 0:
        out = out.where(F.col("batch") <= max(offset, 0) + max_batches)
    number = F.col("batch").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return out.withColumn("label", F.concat(F.lit("batch-"), padded))


def cache_outputs(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All cached URLs, and those ending in a number (the products-only cache)."""
    tail = F.element_at(F.split(F.regexp_replace("url", r"/+$", ""), "/"), -1)
    return urls, urls.where(tail.rlike(r"^\d+$"))


# Limits of an uploaded URL map.
MAX_LINKS, MAX_TOTAL_LINKS = 50_000, 100_000
MAX_URL_LENGTH, MAX_TITLE_LENGTH = 2048, 512
MAX_UPLOAD_URLS = 200_000


def url_map_violations(maps: DataFrame) -> DataFrame:
    """Broken limits of URL maps with how often: ``(domain, rule, hits)``."""

    def bad(cond) -> Column:
        return F.size(F.filter("links", lambda x: F.coalesce(cond(x), F.lit(True)))).cast("bigint")

    rules = {
        "links_count": (F.size("links") > MAX_LINKS).cast("bigint"),
        "total_links": (F.coalesce("total_links", F.lit(0)) > MAX_TOTAL_LINKS).cast("bigint"),
        "url_length": bad(lambda x: F.length(x["url"]) > MAX_URL_LENGTH),
        "url_form": bad(lambda x: ~U.is_valid_url(x["url"])),
        "title_length": bad(lambda x: F.coalesce(F.length(x["title"]) > MAX_TITLE_LENGTH, F.lit(False))),
        "priority_range": bad(lambda x: ~F.coalesce(x["priority"].between(0, 100), F.lit(True))),
    }
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("hits")) for n, c in rules.items()]))
    return maps.select("domain", entries.alias("_e")).select("domain", "_e.rule", "_e.hits").where("hits > 0")


def upload_check(urls: DataFrame, by: str | None = None) -> DataFrame:
    """Number of URLs and of hosts, and whether an upload stays within one site and the size limit."""
    host = U.normalise_domain(U.host_of(F.col("url")))
    g = urls.groupBy(by) if by else urls
    return g.agg(F.count("*").alias("urls"), F.count_distinct(host).alias("hosts")).withColumn(
        "accepted", (F.col("urls") <= MAX_UPLOAD_URLS) & (F.col("hosts") <= 1)
    )


def static_filter(urls: DataFrame, globs=U.STATIC_GLOBS) -> DataFrame:
    return urls.where(~U.is_static_asset(F.col("url"), globs))


def links_schema() -> T.StructType:
    """One URL-map entry after reading."""
    return T.StructType.fromDDL("url string, title string, priority int, metadata string")
