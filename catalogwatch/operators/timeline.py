"""Running values over per-key event timelines that stay bounded per task.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here each timeline is
cut into time cells: rows are windowed inside ``(key, cell)``, every cell is reduced to one summary
row, the summaries are accumulated per key (their number grows with the time span, not with the
rows), and what came before a cell is joined back to its rows.

The cut is by time and not by sampled ranges, so a task that is run again after an executor was
lost sees the same cells. The default cell is a minute: a key with a third of a trillion rows of a
month holds some eight million rows per cell. Sources with coarser time stamps pass a wider one.

Rows without a key or a time belong to no timeline; they are kept, with values of their own cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60.0, 3600.0, 86400.0
MICROS = 1_000_000
CELL = "_cell"


@dataclass(frozen=True)
class RunningSum:
    """Sum of ``value`` up to the row (``before``: up to the row in front of it)."""

    value: Column
    before: bool = False


@dataclass(frozen=True)
class RunningMax:
    value: Column
    before: bool = False


@dataclass(frozen=True)
class RunningLast:
    """Latest non-null ``value`` up to the row (``before``: in front of it)."""

    value: Column
    before: bool = False


def _over(measure, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if measure.before else 0)
    if isinstance(measure, RunningSum):
        return F.sum(measure.value).over(frame)
    if isinstance(measure, RunningMax):
        return F.max(measure.value).over(frame)
    return F.last(measure.value, ignorenulls=True).over(frame)


def _total(measure, order: Column) -> Column:
    if isinstance(measure, RunningSum):
        return F.sum(measure.value)
    if isinstance(measure, RunningMax):
        return F.max(measure.value)
    return F.max_by(measure.value, F.when(measure.value.isNotNull(), order))


def _combine(measure, carried: Column, local: Column) -> Column:
    if isinstance(measure, RunningSum):
        return F.coalesce(carried + local, carried, local)
    if isinstance(measure, RunningMax):
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


def _carry(measure, col: str, prior) -> Column:
    if isinstance(measure, RunningSum):
        return F.sum(col).over(prior)
    if isinstance(measure, RunningMax):
        return F.max(col).over(prior)
    return F.last(col, ignorenulls=True).over(prior)


def cell_of(us: str, width: float) -> Column:
    return F.floor(F.col(us) / F.lit(float(width) * MICROS))


def running(df: DataFrame, keys, us: str, tie, measures: dict, width: float = MINUTE) -> DataFrame:
    """Add running measures in ``(us, tie)`` order per key; ``us`` is the time in microseconds."""
    keys, tie = _names(keys), _names(tie)
    cut = df.withColumn(CELL, cell_of(us, width))
    spots = [*keys, CELL]
    inside = Window.partitionBy(*spots).orderBy(us, *tie)
    order = F.struct(us, *tie)
    totals = cut.groupBy(*spots).agg(*[_total(m, order).alias(f"_t_{n}") for n, m in measures.items()])
    prior = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*spots, *[_carry(m, f"_t_{n}", prior).alias(f"_c_{n}") for n, m in measures.items()])
    local = cut.withColumns({f"_l_{n}": _over(m, inside) for n, m in measures.items()})
    joined = local.join(carried, spots, "left")
    result = {n: _combine(m, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, m in measures.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in result.items()])


def numbered(df: DataFrame, keys, us: str, tie, name: str = "rn", width: float = MINUTE) -> DataFrame:
    """Row number per key in time order."""
    return running(df, keys, us, tie, {name: RunningSum(F.lit(1))}, width)


def streaks(df: DataFrame, keys, us: str, tie, flags: dict[str, Column], width: float = MINUTE) -> DataFrame:
    """For each flag: how many rows in a row it has held up to this row (0 on a row where it does not)."""
    keys, tie = _names(keys), _names(tie)
    spots = [*keys, CELL]
    inside = Window.partitionBy(*spots).orderBy(us, *tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    cut = df.withColumn(CELL, cell_of(us, width)).withColumn("_i", F.row_number().over(inside))
    cut = cut.withColumns(
        {f"_r_{n}": F.max(F.when(~F.coalesce(c, F.lit(False)), F.col("_i"))).over(upto) for n, c in flags.items()}
    )
    totals = cut.groupBy(*spots).agg(F.max("_i").alias("_n"), *[F.max(f"_r_{n}").alias(f"_r_{n}") for n in flags])
    prior = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    start = totals.withColumn("_p", F.coalesce(F.sum("_n").over(prior), F.lit(0)))
    carried = start.select(
        *spots,
        *[(F.col("_p") - F.coalesce(F.max(F.col("_p") + F.col(f"_r_{n}")).over(prior), F.lit(0))).alias(f"_c_{n}") for n in flags],
    )
    joined = cut.join(carried, spots, "left")
    run = lambda n: F.col("_i") - F.coalesce(F.col(f"_r_{n}"), -F.col(f"_c_{n}"), F.lit(0))
    return joined.select(*df.columns, *[run(n).cast("bigint").alias(n) for n in flags])


def trailing_rows(df: DataFrame, keys, us: str, tie, rows: int, aggs: dict[str, Column], before: bool = False,
                  width: float = MINUTE) -> DataFrame:
    """Aggregates over the last ``rows`` rows of a key (``before``: not counting the row itself).

    Rows are numbered, cut into equal blocks, and the tail of a block is also shown to the next
    one, so a task never holds more than a block and its context.
    """
    keys = _names(keys)
    block = max(4096, 8 * rows)
    num = numbered(df, keys, us, tie, "_rn", width)
    b = F.floor((F.col("_rn") - 1) / block)
    tail = (F.col("_rn") - 1) % block >= block - rows
    spots = F.array_compact(
        F.array(
            F.struct(b.alias("b"), F.lit(False).alias("ctx")),
            F.when(tail, F.struct((b + 1).alias("b"), F.lit(True).alias("ctx"))),
        )
    )
    spread = num.withColumn("_s", F.explode(spots)).select(*num.columns, F.col("_s.b").alias("_b"), F.col("_s.ctx").alias("_x"))
    frame = Window.partitionBy(*keys, "_b").orderBy("_rn").rowsBetween(-rows if before else 1 - rows, -1 if before else 0)
    return spread.withColumns({n: a.over(frame) for n, a in aggs.items()}).where(~F.col("_x")).drop("_rn", "_b", "_x")


def trailing_time(df: DataFrame, keys, us: str, tie, seconds: float, sums: dict[str, Column], closed: bool = True,
                  width: float = MINUTE) -> DataFrame:
    """Whole-number sums over the last ``seconds`` up to each row.

    Every row enters the sum at its time and leaves it ``seconds`` later, so a trailing window
    becomes a running sum: linear work, where a range frame would rescan its rows each time.
    ``closed``: a row exactly ``seconds`` old still counts.
    """
    keys, tie = _names(keys), _names(tie)
    span = int(seconds * MICROS)
    rank_in, rank_out = (0, 1) if closed else (1, 0)
    values = {f"_v_{n}": c.cast("bigint") for n, c in sums.items()}
    base = df.withColumns(values)
    marks = F.explode(
        F.array(
            F.struct(F.col(us).alias("at"), F.lit(rank_in).alias("rank"), F.lit(1).alias("sign")),
            F.struct((F.col(us) + span).alias("at"), F.lit(rank_out).alias("rank"), F.lit(-1).alias("sign")),
        )
    )
    events = base.withColumn("_m", marks).withColumns(
        {"_at": F.col("_m.at"), "_rank": F.col("_m.rank"), "_sign": F.col("_m.sign")}
    ).drop("_m")
    measures = {n: RunningSum(F.col(f"_v_{n}") * F.col("_sign")) for n in sums}
    out = running(events, keys, "_at", ["_rank", *tie], measures, width).where(F.col("_sign") == 1)
    return out.select(*df.columns, *sums)


def decayed(df: DataFrame, keys, us: str, tie, value: str, keep: float, name: str, start: float | None = None,
            width: float = MINUTE) -> DataFrame:
    """Last state of ``x = keep * x + (1 - keep) * value`` per key.

    The state is a weighted sum whose weights depend only on how many rows follow, so it is a
    plain aggregate over numbered rows. ``start`` is the state before the first row; without it
    the first value is the state.
    """
    keys = _names(keys)
    present = df.where(F.col(value).isNotNull())
    num = numbered(present, keys, us, tie, "_rn", width)
    counts = present.groupBy(*keys).agg(F.count("*").alias("_n"))
    after = F.col("_n") - F.col("_rn")
    weight = F.pow(F.lit(keep), after) * F.lit(1.0 - keep)
    if start is None:
        weight = F.when(F.col("_rn") == 1, F.pow(F.lit(keep), after)).otherwise(weight)
    total = F.sum(F.col(value) * weight)
    if start is not None:
        total = total + F.lit(start) * F.pow(F.lit(keep), F.max("_n"))
    return num.join(counts, keys, "left").groupBy(*keys).agg(total.alias(name), F.max("_n").alias("n"))


def last_rows(df: DataFrame, keys, order: list, n: int) -> DataFrame:
    """Newest ``n`` rows per key; the limit is applied before the shuffle as well."""
    keys = _names(keys)
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)
