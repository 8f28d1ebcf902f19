"""Bounded timelines against brute force, with one key holding most rows and many equal times."""

import random

import pytest
from pyspark.sql import functions as F

from catalogwatch.operators import timeline as tl

US = 1_000_000


def _rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(600):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}"
        out.append((i, key, rng.randint(0, 900) * US, rng.random() < 0.6, rng.randint(0, 50)))
    return out


@pytest.fixture(scope="module", params=[1, 2])
def data(request, spark):
    rows = _rows(request.param)
    per = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        per.setdefault(r[1], []).append(r)
    return spark.createDataFrame(rows, "id int, key string, us long, ok boolean, v int").cache(), per


@pytest.mark.parametrize("width", [7.0, 60.0, 1e9])
def test_running(data, width):
    df, per = data
    got = {
        r["id"]: r
        for r in tl.running(
            df, "key", "us", "id",
            {
                "n": tl.RunningSum(F.lit(1)), "s0": tl.RunningSum(F.col("v"), before=True), "m": tl.RunningMax(F.col("v")),
                "last_ok": tl.RunningLast(F.when(F.col("ok"), F.col("id")), before=True),
            },
            width,
        ).collect()
    }
    assert len(got) == 600
    for rows in per.values():
        total, best, last = 0, None, None
        for i, (rid, _, _, ok, v) in enumerate(rows):
            g = got[rid]
            assert g["n"] == i + 1 and (g["s0"] or 0) == total and g["last_ok"] == last
            total += v
            best = v if best is None else max(best, v)
            assert g["m"] == best
            last = rid if ok else last


def test_streaks(data):
    df, per = data
    got = {r["id"]: (r["good"], r["bad"]) for r in tl.streaks(df, "key", "us", "id", {"good": F.col("ok"), "bad": ~F.col("ok")}, 30.0).collect()}
    for rows in per.values():
        good = bad = 0
        for rid, _, _, ok, _v in rows:
            good, bad = (good + 1, 0) if ok else (0, bad + 1)
            assert got[rid] == (good, bad)


@pytest.mark.parametrize("closed", [True, False])
def test_trailing_time(data, closed):
    df, per = data
    got = {r["id"]: r["n"] for r in tl.trailing_time(df, "key", "us", "id", 20.0, {"n": F.lit(1)}, closed, 15.0).collect()}
    for rows in per.values():
        for i, r in enumerate(rows):
            low = r[2] - 20 * US
            want = sum(1 for x in rows[: i + 1] if (x[2] >= low if closed else x[2] > low))
            assert got[r[0]] == want


def test_trailing_rows(data, monkeypatch):
    df, per = data
    # small blocks, so that windows reach over block borders
    monkeypatch.setattr(tl, "max", lambda *_: 16, raising=False)
    got = {r["id"]: r["s"] for r in tl.trailing_rows(df, "key", "us", "id", 5, {"s": F.sum("v")}, width=45.0).collect()}
    before = {r["id"]: r["s"] for r in tl.trailing_rows(df, "key", "us", "id", 5, {"s": F.sum("v")}, before=True, width=45.0).collect()}
    for rows in per.values():
        for i, r in enumerate(rows):
            assert got[r[0]] == sum(x[4] for x in rows[max(0, i - 4) : i + 1])
            assert before[r[0]] == (sum(x[4] for x in rows[max(0, i - 5) : i]) if i else None)


def test_decay(data):
    df, per = data
    got = {r["key"]: r["x"] for r in tl.decayed(df, "key", "us", "id", "v", 0.9, "x").collect()}
    for key, rows in per.items():
        x = None
        for r in rows:
            x = r[4] if x is None else 0.9 * x + 0.1 * r[4]
        assert got[key] == pytest.approx(x)
