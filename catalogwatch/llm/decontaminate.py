"""Benchmark decontamination by winnowing. Column functions and joins only.

Both sides are word sequences. Of each run of ``WINDOW - K + 1`` neighbouring k-grams the smallest hash is kept, so every
shared span of ``WINDOW`` words has a k-gram that both sides keep; to be safe the test side, which is small, indexes all
its k-grams. Kept k-grams of the documents are joined with them; around each hit, and only there, the windows that hold
it are compared whole. Items shorter than a window are one window of their own length and are found by their first word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
K = 6
# What lies between words (after lower-casing A-Z): a fixed pattern.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A kept k-gram is packed with its place: the low bits hold the place, the others bits of its hash.
PLACE_BITS = 30


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, split at ASCII characters that are neither digits nor letters."""
    text = F.coalesce(text, F.lit(""))
    # lower() changes more than A-Z, but not in a text of ASCII characters only, where it is much faster.
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, NO_WORD), "")


def _hashed(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("h", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))


def _paired(a: str, b: str, off: int, how: str) -> Column:
    """Elements of ``a`` with those of ``b`` that stand ``off`` further on."""
    n = f"greatest(0, size({b}) - {off})"
    return F.expr(f"zip_with(slice({a}, 1, {n}), slice({b}, {1 + off}, {n}), (x, y) -> {how})")


def _with_grams(rows: DataFrame, k: int) -> DataFrame:
    """Column ``g{k}``: a hash of every run of k words, put together from those of shorter runs."""
    if k == 1:
        return rows.withColumn("g1", F.col("h"))
    if f"g{k}" in rows.columns:
        return rows
    left, right = k // 2, k - k // 2
    rows = _with_grams(_with_grams(rows, left), right)
    turn = 7 * right % 64
    return rows.withColumn(f"g{k}", _paired(f"g{left}", f"g{right}", left, f"shiftleft(x, {turn}) ^ shiftrightunsigned(x, {64 - turn}) ^ y"))


def _with_minima(rows: DataFrame, run: int) -> DataFrame:
    """Column ``least``: the least of each ``run`` neighbours in column ``g``, by doubling."""
    rows, size = rows.withColumn("least", F.col("g")), 1
    while size < run:
        step = min(size, run - size)
        rows, size = rows.withColumn("least", _paired("least", "least", step, "least(x, y)")), size + step
    return rows


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, m, anchors, w``: the windows of each item; m is their length in words, w their hash.

    An item with fewer than ``window`` words is one window, an item without words none.
    """
    rows = _hashed(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "text").where("size(h) > 0")
    rows = rows.withColumn("m", F.least(F.size("h"), F.lit(window)))
    return rows.select("item_id", "m", F.explode(F.expr("transform(sequence(1, size(h) - m + 1), i -> slice(h, i, m))")).alias("h"))


def mark(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, k: int = K,
) -> DataFrame:
    """``doc_id, row, n_words, n_hit, items``: one row per input row; ``items`` are the items with occurring windows.

    A word is hit if it lies in any occurrence of any window. Null and empty texts have no words; repeated rows are kept
    (``row`` tells them apart); items of null or empty text occur nowhere; a null item_id is left out of ``items`` but
    its hits count; an empty table of items hits nothing. Other columns are ignored. Texts are read once, whole.
    """
    context = window - k
    windows = item_windows(items, item_id, item_text, window)
    exact = windows.select(F.col("item_id"), F.col("m").alias("m"), F.xxhash64("h").alias("w")).distinct()
    # What leads to a window: a k-gram of it, or the first word of a short one.
    cut = F.lit(-(1 << PLACE_BITS))
    long = _with_grams(windows.where(F.col("m") == window), k).select(F.explode(f"g{k}").alias("g"), F.lit(window).alias("m"))
    short = windows.where(F.col("m") < window).select(F.col("h")[0].alias("g"), "m")
    leads = long.union(short).select(F.col("g").bitwiseAND(cut).alias("g"), "m").distinct()
    shorts = short.agg(F.count(F.lit(1)) > 0)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    place = (1 << PLACE_BITS) - 1
    rows = _with_grams(_hashed(rows, "text").select("doc_id", "row", "h"), k)
    rows = rows.select("doc_id", "row", "h", F.expr(f"transform(g{k}, (x, i) -> (x & ~{place}L) | i)").alias("g"))
    kept = F.array_distinct("least")
    rows = _with_minima(rows, window - k + 1)
    # Every word, where any item is shorter than a window.
    single = F.when(shorts.scalar(), F.expr(f"transform(h, (x, i) -> (x & ~{place}L) | i)")).otherwise(F.expr("cast(array() as array<bigint>)"))
    rows = rows.select("doc_id", "row", "h", kept.alias("kept"), single.alias("single"))
    # One row for the document itself (no lead), one for each lead with the words around it.
    around = (
        f"transform(kept, x -> struct(x & ~{place}L as g, {window} as m, cast(greatest(0, (x & {place}L) - {context}) as int) as at, "
        f"slice(h, cast(greatest(0, (x & {place}L) - {context}) as int) + 1, {window + context}) as h))"
    )
    alone = f"transform(single, x -> struct(x & ~{place}L as g, 0 as m, cast(x & {place}L as int) as at, slice(h, cast(x & {place}L as int) + 1, {window - 1}) as h))"
    head = "array(struct(cast(null as bigint) as g, size(h) as m, 0 as at, cast(array() as array<bigint>) as h))"
    spread = rows.select("doc_id", "row", F.explode(F.expr(f"concat({head}, {around}, {alone})")).alias("x"))
    spread = spread.select("doc_id", "row", F.col("x.g").alias("g"), F.col("x.m").alias("n"), F.col("x.at").alias("at"), F.col("x.h").alias("h"))
    heads = F.col("g").isNull()
    led = spread.join(leads.select(F.col("g").alias("lead"), F.col("m").alias("lead_m")), (F.col("g") == F.col("lead")) & ((F.col("n") == window) == (F.col("lead_m") == window)), "left")
    led = led.where(heads | F.col("lead").isNotNull())
    # Whole windows around the leads.
    tried = F.expr(
        f"if(g is null, array(struct(0 as at, cast(null as bigint) as w)), "
        f"if(size(h) < lead_m, array(), transform(sequence(0, if(n = {window}, size(h) - lead_m, 0)), "
        "i -> struct(at + i as at, xxhash64(slice(h, i + 1, lead_m)) as w))))"
    )
    tried = led.select("doc_id", "row", "n", heads.alias("head"), F.col("lead_m").alias("m"), F.explode(tried).alias("x"))
    tried = tried.select("doc_id", "row", "n", "head", "m", F.col("x.at").alias("at"), F.col("x.w").alias("w"))
    hit = tried.join(exact.select("item_id", F.col("m").alias("window_m"), F.col("w").alias("window")), (F.col("w") == F.col("window")) & (F.col("m") == F.col("window_m")), "left")
    hit = hit.where(F.col("head") | F.col("window").isNotNull())
    grouped = hit.groupBy("doc_id", "row").agg(
        F.max(F.when(F.col("head"), F.col("n"))).cast("long").alias("n_words"),
        F.collect_set(F.when(~F.col("head"), F.struct("at", "m"))).alias("spans"),
        F.collect_set("item_id").alias("items"),
    )
    return grouped.select("doc_id", "row", "n_words", _covered("spans").alias("n_hit"), "items")


def _covered(spans: str) -> Column:
    """Words under the union of spans (start, length)."""
    return F.expr(
        f"aggregate(array_sort({spans}), named_struct('upto', 0, 'n', 0L), (acc, s) -> named_struct("
        "'upto', greatest(acc.upto, s.at + s.m), 'n', acc.n + greatest(0, s.at + s.m - greatest(acc.upto, s.at))), acc -> acc.n)"
    )


def contaminated() -> Column:
    """At least a twentieth of a document's words is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
