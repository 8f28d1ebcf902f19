"""Per-key state machines over request streams.

Each keeps a few numbers per key. Rows of a key arrive per micro-batch and are put into event
order there; what a task holds is one key's share of a micro-batch, which the source's
``maxFilesPerTrigger`` bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000


class Machine(StatefulProcessor):
    """Common frame: load the state tuple, step through the rows, store it again."""

    state_schema = ""
    columns: tuple[str, ...] = ()

    def __init__(self, key: str, order: tuple[str, ...], **settings) -> None:
        self.key, self.order, self.settings = key, list(order), settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else self.start()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        out = []
        for row in batch.itertuples(index=False):
            state, values = self.step(state, row)
            out.append((key[0], row.id, *values))
        self.state.update(state)
        yield pd.DataFrame(out, columns=[self.key, "id", *self.columns])

    def close(self) -> None:
        pass


class Circuit(Machine):
    """Opens after a run of failures for a fixed time; a success closes it."""

    state_schema = "streak bigint, is_open boolean, until_us bigint, opened bigint, recovered bigint"
    columns = ("failure_streak", "is_open", "opened", "recovered")

    def start(self):
        return 0, False, 0, 0, 0

    def step(self, state, row):
        streak, is_open, until, opened, recovered = state
        if row.success:
            streak = 0
            if is_open:
                is_open, recovered = False, recovered + 1
        else:
            streak += 1
            if is_open and row.us > until:
                is_open = False
            if not is_open and streak >= self.settings["threshold"]:
                is_open, opened, until = True, opened + 1, row.us + self.settings["timeout_us"]
        return (streak, is_open, until, opened, recovered), (streak, is_open, opened, recovered)


class TokenBucket(Machine):
    """Requests per client against a bucket that refills with time."""

    state_schema = "tokens bigint, refilled_us bigint"
    columns = ("allowed", "tokens")

    def start(self):
        return self.settings["capacity"], -1

    def step(self, state, row):
        tokens, at = state
        at = row.us if at < 0 else at
        gained = int((row.us - at) / self.settings["window_us"] * self.settings["refill"])
        if gained > 0:
            tokens, at = min(self.settings["capacity"], tokens + gained), row.us
        allowed = tokens >= 1
        tokens -= int(allowed)
        return (tokens, at), (allowed, tokens)


class Burst(Machine):
    """Bursts of paid requests: so many in a row, then a cool-down that may grow; success may reset it."""

    state_schema = "in_burst bigint, until_us bigint, cooldown_us bigint, bursts bigint"
    columns = ("started", "bursts")

    def start(self):
        return 0, 0, self.settings["cooldown_us"], 0

    def step(self, state, row):
        in_burst, until, cooldown, bursts = state
        s = self.settings
        started = row.us >= until and not (s["allowance"] and in_burst >= s["allowance"])
        if started:
            in_burst += 1
            if in_burst >= s["max_consecutive"]:
                bursts += 1
                grown = int(max(s["cooldown_us"], cooldown * s["multiplier"])) if bursts > 1 else s["cooldown_us"]
                cooldown, until = grown, row.us + grown
            if row.success and s["reset_on_success"]:
                in_burst, until, cooldown, bursts = 0, 0, s["cooldown_us"], 0
        return (in_burst, until, cooldown, bursts), (started, bursts)


class Fallback(Machine):
    """Fetch steps of a site: two connect timeouts or one hard refusal move on; success ends the search."""

    state_schema = "step bigint, timeouts bigint, done boolean"
    columns = ("step", "timeouts")

    def start(self):
        return 0, 0, False

    def step(self, state, row):
        step, timeouts, done = state
        used = step
        last = len(self.settings["steps"])  # one past the last step = unavailable
        if row.outcome == "success":
            done = True
        else:
            timeouts += int(row.outcome == "connect_timeout")
            move = (row.outcome == "connect_timeout" and timeouts >= 2) or row.outcome in self.settings["refusals"]
            if move:
                step, timeouts = (last if done or step + 1 >= last else step + 1), 0
        return (step, timeouts, done), (used, timeouts)


class Stall(Machine):
    """Progress of a run: seconds since it last advanced, and whether that is too long."""

    state_schema = "best bigint, last_us bigint"
    columns = ("quiet_seconds", "stalled")

    def start(self):
        return -1, -1

    def step(self, state, row):
        best, last = state
        if last < 0:
            last = row.us
        if row.current > best:
            best, last = int(row.current), row.us
        quiet = (row.us - last) / MICROS
        return (best, last), (quiet, quiet > self.settings["seconds"])


OUTPUT = {
    Circuit: "failure_streak bigint, is_open boolean, opened bigint, recovered bigint",
    TokenBucket: "allowed boolean, tokens bigint",
    Burst: "started boolean, bursts bigint",
    Fallback: "step bigint, timeouts bigint",
    Stall: "quiet_seconds double, stalled boolean",
}
# Fetch steps, and outcomes that refuse a step at once.
FETCH_STEPS = ("direct", "datacenter_proxy", "antibot", "flaresolverr")
REFUSALS = ("http_403", "http_429", "http_503", "captcha", "proxy_unavailable", "fatal_error")


def run_machine(events: DataFrame, machine: type[Machine], key: str, order=("us", "id"), **settings) -> DataFrame:
    """One output row per event: the key, the event id and the machine's values after the event."""
    kind = events.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, id bigint, {OUTPUT[machine]}"
    return events.groupBy(key).transformWithStateInPandas(
        machine(key, order, **settings), outputStructType=schema, outputMode="append", timeMode="none"
    )
