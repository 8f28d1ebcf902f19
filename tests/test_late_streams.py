"""Machines over late events: any order and any cut into micro-batches within the watermark's delay give the same rows."""

import os
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogwatch.operators import snapshots as snap
from catalogwatch.streaming import machines as M
from catalogwatch.streaming import ordered as O
from catalogwatch.streaming import windows as W
from catalogwatch.streaming.runner import drain, use_state_store

US = 1_000_000
DDL = "id long, us long, key string, success boolean, current int, outcome string, size long"


def events(seed=5, n=240):
    rng = random.Random(seed)
    kinds = ["connect_timeout", "http_403", "success", "http_500"]
    rows = [
        (i, rng.randint(1, 1500) * US + rng.randint(0, 2) * 400_000, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.random() < 0.4,
         rng.randint(0, 60), rng.choice(kinds), rng.randint(1, 9))
        for i in range(n)
    ]
    return rows


def land(spark, rows, path, delay, parts, seed):
    """Rows by time of arrival, each up to ``delay`` seconds late, in parts of any size."""
    rng = random.Random(seed)
    arriving = sorted(rows, key=lambda r: (r[1] + rng.uniform(0, delay) * US))
    cuts = sorted(rng.sample(range(1, len(rows)), parts - 1)) if parts > 1 else []
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(arriving[a:b], DDL).coalesce(1).write.parquet(f"{path}/{k:03d}")
    schema = spark.createDataFrame([], DDL).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return s.withColumn("ts", F.timestamp_micros("us"))


def folded(machine, rows, late, cell, **settings):
    """Rows of the same machine, stepped through in order on the driver, up to the last cell that the watermark has passed."""
    edge = (max(r[1] for r in rows) // 1000 - late * 1000) // (cell * 1000) * cell * US
    made = machine("key", ("us", "id"), **settings)
    states, out = {}, {}
    names = [x.split()[0] for x in DDL.split(", ")]
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[1] < edge:
            row = type("Row", (), dict(zip(names, r)))
            states[r[2]], values = made.step(states.get(r[2], made.start()), row)
            out[r[0]] = values
    return out


MACHINES = [
    (M.Circuit, {"threshold": 2, "timeout_us": 60 * US}),
    (M.TokenBucket, {"capacity": 3, "refill": 3, "window_us": 200 * US}),
    (M.Burst, {"max_consecutive": 3, "cooldown_us": 60 * US, "multiplier": 1.5, "allowance": 0, "reset_on_success": True}),
    (M.Fallback, {"steps": M.FETCH_STEPS, "refusals": M.REFUSALS}),
]


@pytest.mark.parametrize("machine,settings", MACHINES, ids=[m.__name__ for m, _ in MACHINES])
def test_any_order_and_cut_gives_the_same_rows(spark, tmp_path, machine, settings):
    rows = events()
    want = folded(machine, rows, 300, 10, **settings)
    for k, parts in enumerate((1, 4)):
        s = land(spark, rows, str(tmp_path / str(k)), 290, parts, k)
        got = drain(O.run_ordered(s, machine, "key", "300 seconds", 10, **settings), "t").collect()
        columns = machine.columns
        assert {r["id"]: tuple(r[c] for c in columns) for r in got} == want
        assert len(got) == len(want) > 150


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    # The watermark of a micro-batch holds for late rows from the next one on.
    times = [[(1, 1000)], [(2, 1500)], [(3, 100), (4, 995), (5, 2000)]]
    for k, part in enumerate([(i, t * US, "a", True, 1, "success", 1) for i, t in own] for own in times):
        spark.createDataFrame(part, DDL).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("ts", F.timestamp_micros("us"))
    out = drain(O.run_ordered(s, M.TokenBucket, "key", "10 seconds", 10, capacity=3, refill=3, window_us=US), "t").collect()
    assert sorted(r["id"] for r in out) == [1, 2, 4]


def alarms(rows, late, cell, limit):
    edge = (max(r[1] for r in rows) // 1000 - late * 1000) // (cell * 1000) * cell * US
    out = []
    for key in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == key and r[1] < edge), key=lambda r: (r[1], r[0]))
        best, advances = -1, []
        for r in own:
            if r[4] > best:
                best = r[4]
                advances.append((r[1], best))
        for (us, b), following in zip(advances, [*(a for a, _ in advances[1:]), None]):
            if (following is not None and following - us > limit) or (following is None and us + limit < edge):
                out.append((key, us + limit, b, us))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [30, 100, 400])
def test_one_alarm_for_each_silence(spark, tmp_path, limit):
    rows = [*events(7, 150), (999, 4000 * US, "end", True, 1, "success", 1), (998, 3000 * US, "late", True, 1, "success", 1)]
    s = land(spark, rows, str(tmp_path / "in"), 290, 3, 1)
    out = drain(O.run_ordered(s, O.Silence, "key", "300 seconds", 10, limit_us=limit * US, forget_us=10**12), "t").collect()
    got = sorted(((r["key"], r["us"], r["best"], r["quiet_since_us"]) for r in out), key=repr)
    assert got == alarms(rows, 300, 10, limit * US)
    assert any(k == "late" for k, *_ in got)  # nothing ever came after its only event


def test_an_alarm_is_withdrawn_by_an_event_that_comes_late(spark, tmp_path):
    # At 95 s the run advances, but that is seen only after an event of another run at 120 s.
    parts = [[(1, 50 * US, "a", True, 1, "", 1), (2, 120 * US, "b", True, 1, "", 1)], [(3, 95 * US, "a", True, 2, "", 1), (4, 300 * US, "b", True, 2, "", 1)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, DDL).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("ts", F.timestamp_micros("us"))
    out = drain(O.run_ordered(s, O.Silence, "key", "60 seconds", 10, limit_us=50 * US, forget_us=10**12), "t").collect()
    assert sorted((r["key"], r["us"] // US) for r in out) == [("a", 145), ("b", 170)]


def run_with_state(spark, stream, folder):
    """Drains into the folder and gives the rows and the state that is left."""
    use_state_store(spark)
    q = stream.writeStream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").format("parquet").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    left = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "state").load()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect(), left.select("key.*").distinct().collect()


def test_budget_of_a_day_goes_with_the_day(spark, tmp_path):
    day = 100 * US
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 999) * US, rng.choice("ab"), True, 0, "", rng.randint(1, 9)) for i in range(300)]
    rows.append((999, 1400 * US, "a", True, 0, "", 1))
    s = land(spark, rows, str(tmp_path / "in"), 40, 4, 2).withColumn("day", F.expr("us div 100000000"))
    rules = {"soft": 60, "hard": 75, "throttle": 0.8, "day_us": day, "grace_us": day}
    out, left = run_with_state(spark, O.run_ordered(s, O.DailyBudget, ["key", "day"], "50 seconds", 10, **rules), str(tmp_path / "run"))
    want, used = {}, {}
    for i, us, key, _, _, _, size in sorted(rows, key=lambda r: (r[1], r[0])):
        if us >= 1350 * US:
            continue
        at = (key, us // day)
        before = used.get(at, 0)
        if before >= 75:
            want[i] = ("exhausted", False, before, 1.0)
            continue
        used[at] = before + size
        share = used[at] / 60
        want[i] = (
            ("limit_reached", False, used[at], 1.0) if used[at] > 75 else ("throttled", True, used[at], min(share, 1.0)) if share >= 0.8
            else ("allowed", True, used[at], share)
        )
    assert {r["id"]: (r["state"], r["allowed"], r["usage"], r["usage_ratio"]) for r in out} == want
    assert {s for s, *_ in want.values()} == {"exhausted", "limit_reached", "throttled", "allowed"} or {s for s, *_ in want.values()} >= {"throttled", "allowed"}
    # The watermark stands at 1350 s: a day that ended before 1250 s has no state any more.
    assert all(r["day"] >= 12 for r in left)


def test_idle_keys_are_forgotten(spark, tmp_path):
    rows = [(1, 10 * US, "a", False, 0, "", 1), (2, 500 * US, "a", False, 0, "", 1), (3, 505 * US, "b", False, 0, "", 1), (4, 900 * US, "c", False, 0, "", 1)]
    s = land(spark, rows, str(tmp_path / "in"), 0, 2, 1)
    out, left = run_with_state(spark, O.run_ordered(s, M.Circuit, "key", "10 seconds", 10, threshold=9, timeout_us=US, idle_us=200 * US), str(tmp_path / "run"))
    assert {r["id"]: r["failure_streak"] for r in out} == {1: 1, 2: 1, 3: 1}
    assert left == []


def test_moving_alerts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 5000) * US, rng.choice("ab"), rng.random() < 0.9, 0, "http_429" if rng.random() < (0.6 if 40 <= i % 100 < 50 else 0.1) else "", 1) for i in range(900)]
    s = land(spark, rows, str(tmp_path / "in"), 250, 4, 3)
    alerts = W.moving_alerts(s, "ts", "key", 600, 300, "260 seconds", 3, ~F.col("success"), F.col("outcome") == "http_429", 0.12, 1.5)
    got = {(r["key"], int(r["start"].timestamp())): (r["n"], r["baseline"], r["alerts"]) for r in drain(alerts, "t").collect()}
    edge = max(r[1] for r in rows) // US - 260
    windows = {}
    for _, us, key, ok, _, outcome, _ in rows:
        for start in (us // US // 300 * 300, us // US // 300 * 300 - 300):
            n, e, x = windows.get((key, start), (0, 0, 0))
            windows[key, start] = n + 1, e + (not ok), x + (outcome == "http_429")
    want = {}
    for (key, start), (n, e, x) in windows.items():
        if start + 600 > edge:
            continue
        back = [windows[key, start - 300 * k][2] for k in (1, 2, 3) if (key, start - 300 * k) in windows]
        base = sum(back) / len(back) if back else None
        said = ",".join(["error_rate"] * (e / n > 0.12) + ["limit_spike"] * (base is not None and x > 1.5 * base))
        if said:
            want[key, start] = (n, base, said)
    assert got == want and {s for *_, s in want.values()} >= {"error_rate", "limit_spike"}


def test_changes_against_a_table_held_as_state(spark, tmp_path):
    fields = "fetched_at string, price double, availability string, title string"
    ddl = f"url string, id long, us long, {fields}"
    old = spark.createDataFrame([("u", 1, 5 * US, "f", 1.0, "x", None), ("gone", 2, 5 * US, "f", 1.0, "x", "t"), ("null", 3, 50 * US, "f", None, None, "")], ddl)
    parts = [
        [("u", 10, 20 * US, "f", 2.0, "x", None), ("new", 11, 40 * US, "f", 9.0, "", "t"), ("null", 12, 30 * US, "f", 3.0, "y", "old")],
        [("u", 12, 15 * US, "f", 1.0, "x", ""), ("new", 13, 60 * US, "g", 9.0, None, "t"), ("null", 14, 60 * US, "f", None, "", "")],
        [("end", 15, 500 * US, "f", 1.0, "x", "t")],
    ]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    s = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("ts", F.timestamp_micros("us"))
    out = drain(O.run_ordered(s, O.Changes, "url", "100 seconds", 10, initial=old, fields=fields), "t")
    got = sorted((r["url"], r["id"], r["change_type"], r["fields_changed"], r["price_prev"], r["price_curr"]) for r in snap.changes(out).collect())
    assert got == [("new", 11, "ADDED", "added", None, 9.0), ("u", 10, "MODIFIED", "price", 1.0, 2.0)]


class Kept:
    """Values and maps of one key in memory; counts the calls."""

    def __init__(self, owner):
        self.owner, self.value, self.entries = owner, None, {}

    def get(self):
        self.owner.calls += 1
        return self.value

    def exists(self):
        return self.get() is not None

    def update(self, value):
        self.owner.calls += 1
        self.value = value

    def clear(self):
        self.update(None)

    def getValue(self, at):
        self.owner.calls += 1
        return self.entries.get(at)

    def updateValue(self, at, value):
        self.owner.calls += 1
        self.entries[at] = value

    def containsKey(self, at):
        return self.getValue(at) is not None

    def removeKey(self, at):
        self.owner.calls += 1
        del self.entries[at]


class OneKey:
    """A handle of one key without Spark."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, *_):
        return Kept(self)

    getMapState = getValueState

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))


def released(batches):
    """Rows of one key, batch by batch with the watermark (s) that comes after, through the processor; ids, calls and the handle."""
    fields = StructType.fromDDL("id long, us long, success boolean")
    handle, out = OneKey(), []
    processor = O.Ordered(M.Circuit("key", ("us", "id"), threshold=2, timeout_us=60 * US), ["key"], fields, 1000)
    processor.init(handle)
    for rows, mark in batches:
        if rows:
            processor.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=fields.names)]), None)
        while handle.timers and min(handle.timers) <= mark * 1000:
            at = min(handle.timers)
            times, moment = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark * 1000), SimpleNamespace(getExpiryTimeInMs=lambda: at)
            for frame in processor.handleExpiredTimer(("k",), times, moment):
                out.extend(frame["id"].tolist())
            handle.timers.discard(at)
    return out, handle


def test_calls_of_a_key_do_not_grow_with_its_cells(spark):
    rows = [(i, i * US, True) for i in range(300)]
    out, handle = released([(rows, 0), ([(300, 900 * US, True)], 600)])
    assert out == list(range(300))
    assert len(handle.timers) == 1 and handle.calls < 40


def test_runs_of_a_key_are_merged_in_order(spark, monkeypatch):
    monkeypatch.setattr(O, "CHUNK", 4)
    monkeypatch.setattr(O, "RUN_ROWS", 32)
    rng = random.Random(3)
    ids = iter(range(10**6))
    batches = [([(next(ids), rng.randint(mark, mark + 150) * US, True) for _ in range(rng.choice([0, 1, 3, 50, 90]))], mark) for mark in range(0, 1500, 7)]
    out, handle = released([*batches, ([], 2000)])
    rows = sorted((us, i) for part, _ in batches for i, us, _ in part)
    assert out == [i for _, i in rows] and len(out) > 1000 and not handle.timers


def test_calls_of_a_bucket_do_not_grow_with_its_keys(spark):
    fields = StructType.fromDDL("id long, us long, key string, success boolean")
    handle = OneKey()
    processor = O.OrderedBuckets(M.Circuit("key", ("us", "id"), threshold=2, timeout_us=60 * US), ["key"], fields, 1000, frozenset(["key"]))
    processor.init(handle)
    rows = [(i, (i * 7 % 300) * US, None if i % 50 == 0 else str(2**53 + i % 50), i % 3 == 0) for i in range(300)]
    processor.handleInputRows((1,), iter([pd.DataFrame(rows, columns=fields.names)]), None)
    out = [x for f in processor.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 600_000), None) for x in f.itertuples(index=False)]
    assert handle.calls < 40
    alone, want = M.Circuit("key", ("us", "id"), threshold=2, timeout_us=60 * US), set()
    states = {}
    for i, us, key, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        states[key], values = alone.step(states.get(key, alone.start()), SimpleNamespace(us=us, success=ok))
        want.add((None if key is None else int(key), i, us, *values))
    assert set(map(tuple, out)) == want and len(out) == 300


def test_keys_of_a_stream_share_buckets(spark, tmp_path):
    rows = [(i, (i + 1) * US, 2**60 + i % 40 if i % 40 else None, True) for i in range(200)]
    spark.createDataFrame(rows, "id long, us long, key long, success boolean").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    s = spark.readStream.schema("id long, us long, key long, success boolean").parquet(f"{tmp_path}/in/*").withColumn("ts", F.timestamp_micros("us"))
    stream = O.run_ordered(s, M.Circuit, "key", "10 seconds", 1, threshold=2, timeout_us=60 * US)
    assert O.BUCKET in stream._jdf.queryExecution().analyzed().toString()
    assert sorted((r["id"], r["key"]) for r in drain(stream, "shared").collect()) == [(i, k) for i, _, k, _ in rows if i < 189]


def test_state_lies_in_a_few_partitions_for_each_core(spark, tmp_path):
    """A store is opened and committed for each partition in every micro-batch, so their number follows the cores, not the session's."""
    name, most = "spark.sql.shuffle.partitions", 2 * spark.sparkContext.defaultParallelism
    known = spark.conf.get(name)
    rows, n = events(n=60), 0
    spark.conf.set(name, 10 * most)
    try:
        s = land(spark, rows, f"{tmp_path}/in", 0, 1, 0)
        stream = O.run_ordered(s, M.Fallback, "key", "300 seconds", 10, steps=M.FETCH_STEPS, refusals=M.REFUSALS)
        out = drain(stream, "few-partitions")
        root = os.path.dirname(out.inputFiles()[0].removeprefix("file:").replace("//", "/"))
        n = len([x for x in os.listdir(f"{root}/../state/state/0") if x.isdigit()])
        got = {r["id"]: (r["step"], r["timeouts"]) for r in out.collect()}
        assert spark.conf.get(name) == str(10 * most)
    finally:
        spark.conf.set(name, known)
    assert 0 < n <= most
    assert got == folded(M.Fallback, rows, 300, 10, steps=M.FETCH_STEPS, refusals=M.REFUSALS)


PAGE = "fetched_at string, price double, availability string, title string"


def pages_of(rng, ids, n, low, high):
    """Rows of ``n`` pages at most, some of them with no address, with several rows each."""
    keys = [None, *(2**60 + i for i in range(n))]
    return [
        (rng.choice(keys), i, rng.randint(low, high) * US, "f", rng.choice([None, 1.0, 2.0]), rng.choice(["x", None]), rng.choice(["t", ""]))
        for i in ids
    ]


def changed(old, new, edge):
    """Rows before ``edge`` beside the row before them, page by page, as (id, known, price before, price)."""
    states, out = {}, set()
    for r in sorted(old, key=lambda r: (r[2], r[1])):
        states[r[0]] = r
    for r in sorted(new, key=lambda r: (r[2], r[1])):
        if r[2] < edge and (r[0] not in states or (states[r[0]][2], states[r[0]][1]) < (r[2], r[1])):
            before = states.get(r[0])
            out.add((r[0], r[1], before is not None, before[4] if before else None, r[4]))
            states[r[0]] = r
    return out


def test_pages_of_a_table_share_buckets(spark, tmp_path, monkeypatch):
    """A call costs some milliseconds: pages that begin with a table are dealt into buckets as others are."""
    monkeypatch.setattr(O, "BUCKETS", 3)
    rng, name = random.Random(6), "spark.sql.execution.arrow.maxRecordsPerBatch"
    ddl, old = f"key long, id long, us long, {PAGE}", pages_of(rng, range(2000), 1200, 1, 900)
    new = pages_of(rng, range(2000, 5000), 1500, 800, 2000)
    new.append((2**60, 5000, 2400 * US, "f", 1.0, "x", "t"))
    known = spark.conf.get(name)
    spark.conf.set(name, 100)
    try:
        for k, cuts in enumerate([[0, 3001], [0, 700, 2200, 3001]]):
            arriving = sorted(new, key=lambda r: (r[2] + rng.uniform(0, 290) * US))
            for at, (a, b) in enumerate(zip(cuts, cuts[1:])):
                spark.createDataFrame(arriving[a:b], ddl).coalesce(1).write.parquet(f"{tmp_path}/{k}/{at:03d}")
            s = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{k}/*").withColumn("ts", F.timestamp_micros("us"))
            stream = O.run_ordered(s, O.Changes, "key", "300 seconds", 10, initial=spark.createDataFrame(old, ddl), fields=PAGE)
            assert O.BUCKET in stream._jdf.queryExecution().analyzed().toString()
            got = [(r["key"], r["id"], r["known"], r["prev_price"], r["curr_price"]) for r in drain(stream, "pages").collect()]
            assert set(got) == changed(old, new, 2100 * US) and len(got) == len(set(got)) > 2500
    finally:
        spark.conf.set(name, known)


def fired(processor, handle, mark):
    """Rows that come out of a bucket's timer when the watermark stands at ``mark`` seconds."""
    out, times = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: mark * 1000)
    while handle.timers and min(handle.timers) <= mark * 1000:
        at = min(handle.timers)
        for frame in processor.handleExpiredTimer((1,), times, None):
            out.extend(frame.itertuples(index=False))
        handle.timers.discard(at)
    return out


def bucket_with_table(old, frames, **settings):
    fields = StructType.fromDDL(f"key string, id long, us long, {PAGE}")
    handle = OneKey()
    processor = O.OrderedTable(O.Changes("key", ("us", "id"), fields=PAGE, **settings), ["key"], fields, 1000, frozenset(["key"]))
    processor.init(handle)
    rows = [(1, *r[1:], None if r[0] is None else str(r[0])) for r in old]  # in another order, with the bucket
    for at in range(0, len(rows), frames):
        processor.handleInitialState((1,), pd.DataFrame(rows[at : at + frames], columns=[O.BUCKET, *fields.names[1:], "key"]), None)

    def batch(new, mark):
        if new:
            processor.handleInputRows((1,), iter([pd.DataFrame([(None if r[0] is None else str(r[0]), *r[1:]) for r in new], columns=fields.names)]), None)
        return {(r.key, r.id, r.known, r.prev_price, r.curr_price) for r in fired(processor, handle, mark)}

    return processor, handle, batch


def test_work_follows_the_micro_batch_and_not_the_table(spark):
    old = [(i, i, US, "f", 1.0, "x", "t") for i in range(20_000)]
    processor, handle, batch = bucket_with_table(old, 7000)
    held = {at: len(processor._unpacked(v[0])) for (at,), v in processor.held.entries.items()}
    assert sum(held.values()) == 20_000 and len(held) >= 20_000 // O.PAGE_KEYS and max(held.values()) < 4 * O.PAGE_KEYS
    handle.calls = 0
    new = [(7, 20_000, 5 * US, "f", 2.0, "x", "t"), (None, 20_001, 6 * US, "f", 3.0, "x", "t"), (7, 20_002, 7 * US, "f", 4.0, "x", "t")]
    assert batch(new, 100) == {(7, 20_000, True, 1.0, 2.0), (None, 20_001, False, None, 3.0), (7, 20_002, True, 2.0, 4.0)}
    assert handle.calls < 30 and not handle.timers


@pytest.mark.parametrize("size", [1, 4, 128])
def test_pages_split_as_keys_come(spark, monkeypatch, size):
    monkeypatch.setattr(O, "PAGE_KEYS", size)
    rng = random.Random(size)
    old, new = pages_of(rng, range(300), 150, 1, 90), pages_of(rng, range(300, 1500), 600, 100, 1000)
    processor, handle, batch = bucket_with_table(old, 50)
    got, arriving = set(), sorted(new, key=lambda r: r[2] + rng.uniform(0, 40) * US)
    for at in range(0, len(arriving), 60):
        got |= batch(arriving[at : at + 60], min((r[2] for r in arriving[at + 60 :]), default=2000 * US) // US - 1)
    assert got == changed(old, new, 2000 * US) and len(got) > 1000
    count, keys, firsts = processor._unpacked(processor.states.get()[0])
    held = [processor._unpacked(v[0]) for v in processor.held.entries.values()]
    assert keys == sum(map(len, held)) == len({r[0] for r in [*old, *new]}) <= count * size and not firsts


def test_idle_pages_of_a_table_are_forgotten(spark):
    processor, handle, batch = bucket_with_table([(k, k, US, "f", 1.0, "x", "t") for k in range(500)], 500, idle_us=100 * US)
    assert len(batch([(k, 500 + k, 50 * US, "f", 2.0, "x", "t") for k in (3, 4)], 60)) == 2
    assert len(handle.timers) == 1 and batch([], 300) == set() and not handle.timers
    held = {one[0] for v in processor.held.entries.values() for one in processor._unpacked(v[0])}
    assert held == set(range(500)) - {3, 4}  # what the table holds had no row that it could be idle after
    assert batch([(3, 1003, 310 * US, "f", 5.0, "x", "t"), (9, 1009, 310 * US, "f", 5.0, "x", "t")], 320) == {
        (3, 1003, False, None, 5.0), (9, 1009, True, 1.0, 5.0)
    }
