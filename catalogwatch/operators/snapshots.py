"""Comparing crawls of the same URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.functions.values import strip, to_number
from catalogwatch.operators.catalogue import keep_last
from catalogwatch.operators.timeline import DAY, RunningLast, running

DIFF_COLUMNS = (
    "url", "prev_crawl_at", "curr_crawl_at", "change_type", "fields_changed", "price_prev", "price_curr",
    "availability_prev", "availability_curr", "title_prev", "title_curr",
)
COMPARED = ("price", "availability", "title", "text_hash")
SIDE_COLUMNS = ("fetched_at", *COMPARED, "stock")


def latest_per_url(snapshot: DataFrame, order) -> DataFrame:
    """Last row per URL."""
    return keep_last(snapshot, "url", order)


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def _changed(field: str, normalise: bool) -> Column:
    """Null-safe inequality; blank text equals no text."""
    a, b = F.col(f"p.{field}"), F.col(f"c.{field}")
    if field == "price":
        # both sides are doubles already (see _paired)
        if normalise:
            a, b = F.round(a, 2), F.round(b, 2)
    else:
        a, b = F.nullif(a.cast("string"), F.lit("")), F.nullif(b.cast("string"), F.lit(""))
        if normalise:
            a, b = _plain(a), _plain(b)
    return ~a.eqNullSafe(b)


def _side_column(df: DataFrame, name: str) -> Column:
    """Column of a snapshot with its compared type; text prices are parsed, numeric ones pass as they are."""
    if name not in df.columns:
        return F.lit(None).cast("string").alias(name)
    if name in ("price", "stock"):
        numeric = isinstance(df.schema[name].dataType, T.NumericType)
        return (F.col(name).cast("double") if numeric else to_number(F.col(name))).alias(name)
    return F.col(name)


def _paired(prev: DataFrame, curr: DataFrame, order) -> DataFrame:
    """Full outer join of the last row per URL, each side a struct."""

    def side(df: DataFrame, name: str) -> DataFrame:
        by = [order] if isinstance(order, (str, Column)) else list(order)
        marks = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(by)]
        # only the compared columns go through the shuffle
        slim = df.select("url", *[_side_column(df, c) for c in SIDE_COLUMNS], *marks)
        last = latest_per_url(slim, [f"_o{i}" for i in range(len(by))])
        return last.select("url", F.struct(*SIDE_COLUMNS).alias(name))

    return side(prev, "p").join(side(curr, "c"), "url", "full_outer")


def _kind(normalise: bool) -> tuple[Column, Column]:
    changed = F.array_compact(F.array(*[F.when(_changed(f, normalise), F.lit(f)) for f in COMPARED]))
    kind = (
        F.when(F.col("p").isNull(), "ADDED")
        .when(F.col("c").isNull(), "REMOVED")
        .when(F.size(changed) > 0, "MODIFIED")
        .otherwise("UNCHANGED")
    )
    return kind, changed


def snapshot_diff(prev: DataFrame, curr: DataFrame, order, include_unchanged: bool = False,
                  normalise: bool = False) -> DataFrame:
    """Added, removed and modified URLs with the changed fields.

    One shuffle per side: the keep-last aggregate leaves both sides partitioned by URL, which the
    full outer join reuses.
    """
    kind, changed = _kind(normalise)
    d = _paired(prev, curr, order).withColumns({"change_type": kind, "_f": changed})
    if not include_unchanged:
        d = d.where(F.col("change_type") != "UNCHANGED")
    fields = F.when(F.col("change_type").isin("ADDED", "REMOVED"), F.lower("change_type")).otherwise(F.array_join("_f", ";"))
    return d.select(
        "url",
        F.col("p.fetched_at").alias("prev_crawl_at"),
        F.col("c.fetched_at").alias("curr_crawl_at"),
        "change_type",
        fields.alias("fields_changed"),
        *[F.col(f"{s}.{f}").alias(f"{f}_{n}") for f in ("price", "availability", "title") for s, n in (("p", "prev"), ("c", "curr"))],
    )


def changes(pairs: DataFrame, normalise: bool = False) -> DataFrame:
    """Added and modified rows of ``known, prev_…, curr_…`` pairs, with the changed fields; other columns are kept."""
    def side(name: str) -> Column:
        have = [f"{name}_{c}" for c in SIDE_COLUMNS]
        return F.struct(*[(F.col(h) if h in pairs.columns else F.lit(None).cast("string")).alias(c) for h, c in zip(have, SIDE_COLUMNS)])

    kind, changed = _kind(normalise)
    own = [c for c in pairs.columns if c != "known" and not c.startswith(("prev_", "curr_"))]
    d = pairs.select(*own, F.when(F.col("known"), side("prev")).alias("p"), side("curr").alias("c")).withColumns({"change_type": kind, "_f": changed})
    fields = F.when(F.col("change_type") == "ADDED", "added").otherwise(F.array_join("_f", ";"))
    values = [F.col(f"{s}.{f}").alias(f"{f}_{n}") for f in ("price", "availability", "title") for s, n in (("p", "prev"), ("c", "curr"))]
    return d.where(F.col("change_type") != "UNCHANGED").select(*own, "change_type", fields.alias("fields_changed"), *values)


def wide_diff(prev: DataFrame, curr: DataFrame, order, normalise: bool = False) -> DataFrame:
    """Every URL with price and stock deltas, unchanged ones included."""
    kind, changed = _kind(normalise)
    d = _paired(prev, curr, order)
    return d.select(
        "url",
        kind.alias("change_type"),
        F.when(F.col("p").isNotNull() & F.col("c").isNotNull(), F.array_join(changed, ";")).alias("fields_changed"),
        F.round(F.col("c.price") - F.col("p.price"), 2).alias("price_delta"),
        F.round(F.col("c.stock").cast("double") - F.col("p.stock").cast("double"), 3).alias("stock_delta"),
    )


def long_diff(prev: DataFrame, curr: DataFrame, order, normalise: bool = False) -> DataFrame:
    """One row per URL and changed field with old and new value."""
    kind, _ = _kind(normalise)

    def entry(f: str) -> Column:
        old, new = F.col(f"p.{f}").cast("string"), F.col(f"c.{f}").cast("string")
        one_sided = F.col("p").isNull() | F.col("c").isNull()
        hit = F.when(one_sided, F.coalesce(old, new).isNotNull()).otherwise(_changed(f, normalise))
        return F.when(hit, F.struct(F.lit(f).alias("field"), old.alias("old_value"), new.alias("new_value")))

    d = _paired(prev, curr, order)
    rows = d.select(
        "url",
        kind.alias("change_type"),
        F.col("p.fetched_at").alias("timestamp_prev"),
        F.col("c.fetched_at").alias("timestamp_curr"),
        F.explode(F.array_compact(F.array(*[entry(f) for f in COMPARED]))).alias("_e"),
    )
    return rows.select("url", "change_type", "_e.field", "_e.old_value", "_e.new_value", "timestamp_prev", "timestamp_curr")


def same_set(a: Column, b: Column) -> Column:
    """Do two list fields hold the same values, whatever the order."""
    empty = F.array().cast("array<string>")
    left, right = (F.array_sort(F.array_distinct(F.coalesce(x, empty))) for x in (a, b))
    return left == right


def baseline_jobs(jobs: DataFrame, domain: str, us: str, job: str, success: Column, width: float = DAY) -> DataFrame:
    """Each job with the last successful job of its domain before it."""
    picked = RunningLast(F.when(success, F.col(job)), before=True)
    return running(jobs, domain, us, job, {"baseline_job": picked}, width)


def url_history(crawls: DataFrame, us: str, tie: str, values=("price", "stock"), width: float = DAY) -> DataFrame:
    """Value history per URL: previous value, change, and whether the row is a change point."""
    wrapped = {f"_b_{v}": RunningLast(F.struct(F.col(v).alias("v")), before=True) for v in values}
    out = running(crawls, "url", us, tie, wrapped, width)
    cols = {}
    for v in values:
        before = F.col(f"_b_{v}.v")
        cols[f"prev_{v}"] = before
        cols[f"{v}_delta"] = F.round(F.col(v) - before, 2)
        cols[f"{v}_changed"] = F.col(f"_b_{v}").isNotNull() & ~F.col(v).eqNullSafe(before)
    return out.withColumns(cols).drop(*[f"_b_{v}" for v in values])


def url_set_counts(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """How many URLs were added, removed and kept between two crawls."""
    a = prev.select("url").where(F.col("url").isNotNull()).distinct().withColumn("_p", F.lit(1))
    b = curr.select("url").where(F.col("url").isNotNull()).distinct().withColumn("_c", F.lit(1))
    j = a.join(b, "url", "full_outer")
    return j.agg(
        F.count_if(F.col("_p").isNull()).alias("added"),
        F.count_if(F.col("_c").isNull()).alias("removed"),
        F.count_if(F.col("_p").isNotNull() & F.col("_c").isNotNull()).alias("common"),
        F.count("*").alias("all_urls"),
    )


def upsert_snapshots(old: DataFrame, new: DataFrame, key: str, order) -> DataFrame:
    """Snapshot table after an upsert: newest row per key of both."""
    return keep_last(old.unionByName(new), key, order)
