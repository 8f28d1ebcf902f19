"""State machines over events that arrive in any order within the watermark's delay.

Rows of a key wait in its state, in runs sorted by time and id. The key has a timer at the end of the first time cell that it
waits for; when the watermark passes it, Spark calls back, and the machine steps through the merged runs up to the watermark's
cell. Runs are read in chunks, so a task holds a chunk of each run of one key, and of what a micro-batch brings for a key no more
than one run. A machine may name a moment at which it speaks by itself (a deadline), and one at which its state can be
forgotten; the timer is set for these too.

A call costs some milliseconds, however few rows it brings. So keys that have few rows each are dealt into buckets by their hash: a
bucket's rows wait together, and it has the timer and holds the states of its keys. Where these begin with a table, the bucket
holds them in pages, so that the work follows the micro-batch and not the table.
"""

from __future__ import annotations

import bisect
import heapq
import pickle
import zlib
from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegralType, StringType, StructField, StructType

from catalogwatch.streaming.machines import OUTPUT, Machine

# Rows of one entry of a run, of a run that is sorted at once, and of one frame that goes out.
CHUNK = 1000
RUN_ROWS = 20_000
OUT_ROWS = 5000
# Groups of keys: a call for each of them in a micro-batch, whatever the number of keys.
BUCKETS = 1024
BUCKET = "_bucket"
# Keys of a page at most, on the average of a bucket.
PAGE_KEYS = 128
# What is known of a run: its number, its first chunk, its rows, and the time of the first one.
RUN, CHUNK_AT, N, US = range(4)


class Timed(Machine):
    """A machine with a moment of its own. Times are microseconds since 1970."""

    def deadline(self, state: tuple) -> int | None:
        """When :meth:`lapse` is due unless a row up to then changes the state."""
        return None

    def lapse(self, state: tuple, us: int) -> tuple[tuple, tuple | None]:
        """State after the deadline, and the values of a row for it or None."""
        return state, None

    def forget_at(self, state: tuple) -> int | None:
        """When the state may be dropped: rows from then on meet a fresh one."""
        return None

    def known(self, state: tuple | None, row) -> tuple:
        """State with a row of the initial table taken in."""
        raise NotImplementedError


class Silence(Timed):
    """One alarm for each time a run goes without advancing for longer than ``limit_us``; no further event is needed for it."""

    state_schema = "best bigint, last_us bigint, warned boolean"
    columns = ("best", "quiet_since_us")

    def start(self):
        return -1, -1, False

    def step(self, state, row):
        best, last, warned = state
        if last < 0 or row.current > best:
            best, last, warned = max(best, int(row.current)), row.us, False
        return (best, last, warned), None

    def deadline(self, state):
        return None if state[2] or state[1] < 0 else state[1] + self.settings["limit_us"]

    def lapse(self, state, us):
        return (state[0], state[1], True), (state[0], state[1])

    def forget_at(self, state):
        return state[1] + self.settings["forget_us"] if state[2] else None


class DailyBudget(Timed):
    """The gate of a scope on one day: what is used, and whether a request may go, is throttled or is refused.

    Usage stops growing once it has reached the hard limit. The state goes when its day and a grace have passed.
    """

    state_schema = "used bigint, day_end_us bigint"
    columns = ("state", "allowed", "usage", "usage_ratio")

    def start(self):
        return 0, -1

    def step(self, state, row):
        used, end = state
        s = self.settings
        if end < 0:
            end = (row.us // s["day_us"] + 1) * s["day_us"]
        if used >= s["hard"]:
            return (used, end), ("exhausted", False, used, 1.0)
        used += int(row.size)
        share = used / s["soft"]
        if used > s["hard"]:
            return (used, end), ("limit_reached", False, used, 1.0)
        if share >= s["throttle"]:
            return (used, end), ("throttled", True, used, min(share, 1.0))
        return (used, end), ("allowed", True, used, share)

    def forget_at(self, state):
        return state[1] + self.settings["grace_us"] if state[1] >= 0 else None


class MovingBaseline(Timed):
    """Windows with too many errors, or with far more rate-limit answers than the mean of the windows before.

    Rows are closed windows in order of time; the counts of those that began up to ``back_us`` earlier make the baseline. A window
    without any before it has none.
    """

    state_schema = "limited array<bigint>, times array<bigint>"
    columns = ("n", "baseline", "alerts")

    def start(self):
        return [], []

    def step(self, state, row):
        s = self.settings
        kept = [(n, at) for n, at in zip(*state) if at >= row.us - s["back_us"]]
        baseline = sum(n for n, _ in kept) / len(kept) if kept else None
        alerts = ["error_rate"] if row.errors / row.n > s["max_error_share"] else []
        if baseline is not None and row.limited > s["factor"] * baseline:
            alerts.append("limit_spike")
        kept.append((int(row.limited), int(row.us)))
        values = (int(row.n), baseline, ",".join(alerts)) if alerts else None
        return ([n for n, _ in kept], [at for _, at in kept]), values

    def forget_at(self, state):
        return state[1][-1] + self.settings["back_us"] if state[1] else None


class Changes(Timed):
    """The newest row of a key as state: gives the row before and the row after wherever a row comes in.

    ``fields`` is the DDL of what a row holds. A table that is there already is handed in as initial state.
    """

    def __init__(self, key: str, order: tuple[str, ...], **settings) -> None:
        super().__init__(key, order, **settings)
        self.state_schema = f"id bigint, us bigint, {settings['fields']}"
        self.names = StructType.fromDDL(settings["fields"]).fieldNames()
        self.columns = ("known", *(f"{side}_{n}" for side in ("prev", "curr") for n in self.names))

    def output(self) -> str:
        fields = StructType.fromDDL(self.settings["fields"])
        sides = ", ".join(f"{side}_{f.name} {f.dataType.simpleString()}" for side in ("prev", "curr") for f in fields)
        return f"known boolean, {sides}"

    def start(self):
        return None

    def known(self, state: tuple | None, row) -> tuple:
        new = (row.id, row.us, *(getattr(row, n) for n in self.names))
        return new if state is None or (state[1], state[0]) < (new[1], new[0]) else state

    def step(self, state, row):
        new = self.known(None, row)
        if state is not None and (state[1], state[0]) >= (row.us, row.id):  # older than the table was
            return state, None
        before = state[2:] if state is not None else (None,) * len(self.names)
        return new, (state is not None, *before, *new[2:])


OUTPUT.update({
    Silence: "best bigint, quiet_since_us bigint",
    DailyBudget: "state string, allowed boolean, usage bigint, usage_ratio double",
    MovingBaseline: "n bigint, baseline double, alerts string",
})


def plain_rows(frame: pd.DataFrame, fields: StructType) -> Iterator[tuple]:
    """Rows of a frame as tuples in the order of ``fields``, with None for missing values and whole numbers where they are such."""
    columns = []
    for field in fields:
        if frame[field.name].dtype.kind in "biu":  # nothing is missing there
            columns.append(frame[field.name].tolist())
            continue
        values = [None if x is pd.NaT or type(x) is float and x != x else x for x in frame[field.name].tolist()]
        if isinstance(field.dataType, IntegralType):
            values = [None if x is None else int(x) for x in values]
        columns.append(values)
    return zip(*columns)


class Ordered(StatefulProcessor):
    """Steps a machine through the rows of a key in order of (us, id).

    A key has one timer: the end of the first cell that it waits for, whether a row lies there or a moment of the machine. When it
    fires, everything up to the watermark's cell is released at once, so a key costs a few calls per micro-batch however many
    cells its rows lie in.
    """

    def __init__(self, machine: Machine, keys: list[str], fields: StructType, cell_ms: int) -> None:
        self.machine, self.keys, self.fields, self.cell_ms = machine, keys, fields, cell_ms
        self.cell_us = cell_ms * 1000
        self.names = fields.fieldNames()
        self.columns = [*keys, "id", "us", *machine.columns]
        us, id = self.names.index("us"), self.names.index("id")
        self.order = lambda row: (row[us], row[id] is not None, row[id])
        self.time = lambda row: row[us]
        # Does anything happen to a state between rows?
        self.moves = isinstance(machine, Timed) or bool(machine.settings.get("idle_us"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = StructType([StructField("rows", ArrayType(self.fields))])
        self.state = handle.getValueState("state", self.machine.state_schema)
        runs = "array<struct<run:bigint,chunk:bigint,n:bigint,us:bigint>>"
        self.waiting = handle.getValueState("waiting", f"timer_ms bigint, last_us bigint, runs {runs}")
        self.rows = handle.getMapState("rows", "run bigint, chunk bigint", rows)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, last, runs = self._waiting()
        fresh: list[tuple] = []
        for frame in rows:
            fresh.extend(plain_rows(frame, self.fields))
            while len(fresh) >= RUN_ROWS:
                self._add(runs, fresh[:RUN_ROWS])
                fresh = fresh[RUN_ROWS:]
        if fresh:
            self._add(runs, fresh)
        self._wait(timer, timer, last, runs)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, state, out = self.machine, self._load(), []
        timer, last, runs = self._waiting()
        # The watermark's cell begins here: what lies before it is complete.
        edge = timerValues.getCurrentWatermarkInMs() // self.cell_ms * self.cell_us
        Row = namedtuple("Row", self.names)
        for values in heapq.merge(*(self._due(run, edge) for run in runs), key=self.order):
            row = Row(*values)
            state = self._lapse(key, state, last, row.us, out)
            state, values = machine.step(machine.start() if state is None else state, row)
            last = row.us
            if values is not None:
                out.append((*key, row.id, row.us, *values))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
        state = self._lapse(key, state, last, edge, out)
        moments: tuple = ()
        if state is None:
            self.state.clear()
            last = None
        else:
            self.state.update(state)
            moments = tuple((m // self.cell_us + 1) * self.cell_ms for m in self._moments(state, last) if m is not None)
        self._wait(None, min(moments, default=None), last, [run for run in runs if run[N]])
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _load(self) -> tuple | None:
        state = self.state.get()
        return None if state is None else tuple(state)

    def _waiting(self) -> tuple[int | None, int | None, list[list]]:
        """The key's timer, the time of its last row, and its runs of rows."""
        known = self.waiting.get()
        return (None, None, []) if known is None else (known[0], known[1], [list(run) for run in known[2]])

    def _wait(self, timer: int | None, moment: int | None, last: int | None, runs: list[list]) -> None:
        """Sets the key's only timer to the first cell's end that has rows, or to the machine's ``moment`` before it."""
        ends = [(run[US] // self.cell_us + 1) * self.cell_ms for run in runs]
        due = min([*ends, *([] if moment is None else [moment])], default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None and last is None:
            self.waiting.clear()
        else:
            self.waiting.update((due, last, [tuple(run) for run in runs]))

    def _add(self, runs: list[list], rows: list[tuple]) -> None:
        """Keeps rows as a sorted run, together with the youngest runs as long as these are no larger or all fit in one chunk.

        So runs are few, and a row is written again a logarithmic number of times.
        """
        rows.sort(key=self.order)
        while runs and (runs[-1][N] + len(rows) <= CHUNK or runs[-1][N] <= len(rows) <= RUN_ROWS - runs[-1][N]):
            rows = list(heapq.merge(self._due(runs.pop(), None), rows, key=self.order))
        run = max((r[RUN] for r in runs), default=-1) + 1
        for at in range(0, len(rows), CHUNK):
            self.rows.updateValue((run, at // CHUNK), (self._packed(rows[at : at + CHUNK]),))
        runs.append([run, 0, len(rows), self.time(rows[0])])

    def _due(self, run: list, edge: int | None) -> Iterator[tuple]:
        """Takes the rows before ``edge`` out of a run, chunk by chunk; all rows without one."""
        while run[N]:
            at = (run[RUN], run[CHUNK_AT])
            rows = self._unpacked(self.rows.getValue(at)[0])
            n = len(rows) if edge is None else bisect.bisect_left(rows, edge, key=self.time)
            yield from rows[:n]
            run[N] -= n
            if n < len(rows):
                run[US] = self.time(rows[n])
                if n:
                    self.rows.updateValue(at, (self._packed(rows[n:]),))
                return
            self.rows.removeKey(at)
            run[CHUNK_AT] += 1

    def _packed(self, rows: list[tuple]):
        """Rows as an entry of the state holds them."""
        return rows

    def _unpacked(self, held) -> list[tuple]:
        return [tuple(row) for row in held]

    def _moments(self, state: tuple, last: int | None) -> tuple[int | None, int | None]:
        """When the machine speaks by itself, and when its state goes: its own moment, or a key idle for too long."""
        timed = isinstance(self.machine, Timed)
        idle = self.machine.settings.get("idle_us")
        ends = [self.machine.forget_at(state) if timed else None, last + idle if idle and last is not None else None]
        return self.machine.deadline(state) if timed else None, min((x for x in ends if x is not None), default=None)

    def _lapse(self, key, state: tuple | None, last: int | None, us: int, out: list[tuple]) -> tuple | None:
        """Everything that is due before ``us``: deadlines, and forgetting."""
        if not self.moves:
            return state
        while state is not None:
            deadline, forget = self._moments(state, last)
            if deadline is not None and deadline < us and (forget is None or deadline <= forget):
                state, values = self.machine.lapse(state, deadline)
                if values is not None:
                    out.append((*key, None, deadline, *values))
            elif forget is not None and forget < us:
                state = None
            else:
                break
        return state


class Pages(dict):
    """The pages that were read of a bucket's states, by number: states and times of last rows by key.

    ``count`` is the number of all pages, ``keys`` that of the keys on pages that were not read, and ``firsts`` has the first moment
    of every page with any.
    """

    def __init__(self, count: int = 1, keys: int = 0, firsts: dict[int, int] | None = None) -> None:
        super().__init__()
        self.count, self.keys, self.firsts = count, keys, firsts or {}


class OrderedBuckets(Ordered):
    """As :class:`Ordered` for every key of a bucket. ``fields`` hold the keys too; those among ``whole`` are whole numbers as texts.

    Rows and states are kept as bytes, since the state's own rows are converted value by value. A firing goes through the states of
    the bucket's keys once.
    """

    def __init__(self, machine: Machine, keys: list[str], fields: StructType, cell_ms: int, whole: frozenset[str] = frozenset()) -> None:
        super().__init__(machine, keys, fields, cell_ms)
        self.whole = whole
        self.key_of = self._key_of(self.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.states = handle.getValueState("states", "held binary")
        self.rows = handle.getMapState("packed", "run bigint, chunk bigint", "rows binary")

    def _key_of(self, names: list[str]) -> Callable[[tuple], tuple]:
        """What takes the key out of a row with columns of these names."""
        places = [(names.index(k), k in self.whole) for k in self.keys]
        return lambda row: tuple(int(row[i]) if number and row[i] is not None else row[i] for i, number in places)

    def _packed(self, rows: list[tuple]):
        return pickle.dumps(rows, pickle.HIGHEST_PROTOCOL)

    def _unpacked(self, held) -> list[tuple]:
        return pickle.loads(bytes(held))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns, dtype=object)  # whole numbers stay such beside nulls

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, out = self.machine, []
        timer, _, runs = self._waiting()
        edge = timerValues.getCurrentWatermarkInMs() // self.cell_ms * self.cell_us
        pages = self._pages(edge)
        Row = namedtuple("Row", self.names, rename=True)
        for values in heapq.merge(*(self._due(run, edge) for run in runs), key=self.order):
            row, one = Row(*values), self.key_of(values)
            held = self._page(pages, one)
            state, last = held.get(one, (None, None))
            state = self._lapse(one, state, last, row.us, out)
            state, values = machine.step(machine.start() if state is None else state, row)
            held[one] = state, row.us
            if values is not None:
                out.append((*one, row.id, row.us, *values))
            if len(out) >= OUT_ROWS:
                yield self._frame(out)
                out = []
        for held in pages.values():
            for one, (state, last) in list(held.items()):
                state = self._lapse(one, state, last, edge, out)
                if state is None:
                    del held[one]
                    continue
                held[one] = state, last
                if len(out) >= OUT_ROWS:
                    yield self._frame(out)
                    out = []
        self._wait(None, self._timer(self._keep(pages)), None, [run for run in runs if run[N]])
        if out:
            yield self._frame(out)

    def _timer(self, moment: int | None) -> int | None:
        return None if moment is None else (moment // self.cell_us + 1) * self.cell_ms

    def _first(self, held: dict[tuple, tuple]) -> int | None:
        """The first moment of these states."""
        return min((m for state, last in held.values() for m in self._moments(state, last) if m is not None), default=None)

    def _pages(self, edge: int | None) -> Pages:
        """States, of which those are read that have a moment before ``edge``: here all, as one page."""
        known, pages = self.states.get(), Pages()
        pages[0] = {} if known is None else self._unpacked(known[0])
        return pages

    def _page(self, pages: Pages, one: tuple) -> dict[tuple, tuple]:
        """The page that a key belongs to."""
        return pages[0]

    def _keep(self, pages: Pages) -> int | None:
        """Writes pages back, and gives the first moment of all."""
        if pages[0]:
            self.states.update((self._packed(pages[0]),))
        else:
            self.states.clear()
        return self._first(pages[0])


class OrderedTable(OrderedBuckets):
    """As :class:`OrderedBuckets` for keys whose states begin with a table.

    States lie in pages by the hash of their key. A firing reads and writes the pages of the keys that it has rows of, and those
    with a moment that has come. Whenever there are ``PAGE_KEYS`` keys more, one page is split in two, each in its turn, so that a
    bucket is never dealt anew as a whole.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("pages", "page bigint", "held binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        names, pages = [n for n in initialState.columns if n != BUCKET], self._pages(None)
        Row, key_of = namedtuple("Row", names, rename=True), self._key_of(names)
        for values in plain_rows(initialState, StructType([self.fields[n] if n in self.names else StructField(n, StringType()) for n in names])):
            one = key_of(values)
            held = self._page(pages, one)
            held[one] = self.machine.known(held.get(one, (None,))[0], Row(*values)), None
        timer, last, runs = self._waiting()
        self._wait(timer, self._timer(self._keep(pages)), last, runs)

    def _pages(self, edge: int | None) -> Pages:
        known = self.states.get()
        pages = Pages() if known is None else Pages(*self._unpacked(known[0]))
        for at in [at for at, first in pages.firsts.items() if edge is not None and first < edge]:
            self._read(pages, at)
        return pages

    def _page(self, pages: Pages, one: tuple) -> dict[tuple, tuple]:
        at = self._page_at(one, pages.count)
        return pages[at] if at in pages else self._read(pages, at)

    def _page_at(self, one: tuple, count: int) -> int:
        """The number of a key's page among ``count``. Pages from a power of two on were split off those that stand as far from 0."""
        whole = 1 << count.bit_length() - 1
        at = zlib.crc32(repr(one).encode()) % (2 * whole)
        return at if at < count else at - whole

    def _read(self, pages: Pages, at: int) -> dict[tuple, tuple]:
        known = self.held.getValue((at,))
        pages[at] = {} if known is None else self._unpacked(known[0])
        pages.keys -= len(pages[at])
        return pages[at]

    def _split(self, pages: Pages) -> None:
        """Makes one page more. The keys that belong there now all come from one page."""
        new, old = pages.count, pages.count - (1 << pages.count.bit_length() - 1)
        held = pages[old] if old in pages else self._read(pages, old)
        pages.count += 1
        pages[new] = {one: held.pop(one) for one in list(held) if self._page_at(one, pages.count) == new}

    def _keep(self, pages: Pages) -> int | None:
        keys = pages.keys + sum(map(len, pages.values()))
        while keys > pages.count * PAGE_KEYS:
            self._split(pages)
        for at, held in pages.items():
            pages.firsts.pop(at, None)
            if (first := self._first(held)) is not None:
                pages.firsts[at] = first
            self.held.updateValue((at,), (self._packed(held),))
        self.states.update((self._packed((pages.count, keys, pages.firsts)),))
        return min(pages.firsts.values(), default=None)


def run_ordered(
    events: DataFrame, machine: type[Machine], keys: str | list[str], late: str | None, cell_seconds: float = 1.0, ts: str = "ts",
    initial: DataFrame | None = None, **settings,
) -> DataFrame:
    """One row per event (and per deadline, with a null id): the keys, id, us and the machine's values.

    ``events`` have ``id``, ``us`` (microseconds of ``ts``), the keys and what the machine reads. Rows later than ``late`` behind
    the newest are dropped by the watermark; a row comes out when the watermark has passed the end of its cell. Where ``events`` come
    from an operator that has a watermark already, ``late`` is None. ``initial`` is a table of earlier rows, taken in as state. With
    ``idle_us`` among the settings, the state of a key goes when it has had no row for longer. Null keys are a key of their own;
    rows without a time are left out.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    kept = events.where(F.col(ts).isNotNull() & F.col("us").isNotNull())
    kept = kept.withWatermark(ts, late) if late else kept
    made = machine(keys[0], ("us", "id"), **settings)
    values = made.output() if isinstance(made, Changes) else OUTPUT[machine]
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, id {events.schema['id'].dataType.simpleString()}, us bigint, {values}"
    cell_ms = int(cell_seconds * 1000)
    # As texts, since pandas makes whole numbers beside nulls inexact.
    whole = frozenset(k for k in keys if isinstance(events.schema[k].dataType, IntegralType))
    fields = StructType([StructField(f.name, StringType()) if f.name in whole else f for f in events.schema.fields if f.name != ts])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).withColumns({k: F.col(k).cast("string") for k in whole})

    if initial is not None:
        initial = dealt(initial.withColumns({k: F.col(k).cast(events.schema[k].dataType) for k in keys})).groupBy(BUCKET)
    processor = (OrderedBuckets if initial is None else OrderedTable)(made, keys, fields, cell_ms, whole)
    return dealt(kept).groupBy(BUCKET).transformWithStateInPandas(
        processor, outputStructType=schema, outputMode="append", timeMode="eventTime", initialState=initial
    )
