"""Streams give the same answer whatever the cut into micro-batches."""

import random

from pyspark.sql import functions as F

from catalogwatch.operators import cms, html_table
from catalogwatch.operators import pages as P
from catalogwatch.streaming import machines as M
from catalogwatch.streaming import windows as W
from catalogwatch.streaming.runner import drain, read_landed

US = 1_000_000


def _land(spark, rows, ddl, path, parts):
    """Files in time order; each becomes one micro-batch."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], ddl).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return f"{path}/*"


def _events():
    rng = random.Random(5)
    return [(i, i * 7 * US, "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 3)}", rng.random() < 0.4, rng.randint(0, 99)) for i in range(120)]


DDL = "id long, us long, key string, success boolean, current int"


def _stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_circuit_state_survives_micro_batches(spark, tmp_path):
    rows = _events()
    path = _land(spark, rows, DDL, str(tmp_path / "e"), 4)
    s = _stream(spark, path)
    out = {r["id"]: r for r in drain(M.run_machine(s, M.Circuit, "key", threshold=3, timeout_us=60 * US), "t").collect()}
    state = {}
    for i, us, key, ok, _c in rows:
        streak, is_open, until, opened = state.get(key, (0, False, 0, 0))
        if ok:
            streak, is_open = 0, False
        else:
            streak += 1
            is_open = is_open and us <= until
            if not is_open and streak >= 3:
                is_open, opened, until = True, opened + 1, us + 60 * US
        state[key] = (streak, is_open, until, opened)
        assert (out[i]["failure_streak"], out[i]["is_open"], out[i]["opened"]) == (streak, is_open, opened)


def test_tumbling_counts_over_batches(spark, tmp_path):
    rows = _events()
    path = _land(spark, rows, DDL, str(tmp_path / "e"), 3)
    s = _stream(spark, path).withColumns({"ts": F.timestamp_micros("us"), "latency": F.lit(1.0)})
    got = {(r["start"].timestamp(), r["key"]): r["n"] for r in drain(W.tumbling_counts(s, "ts", "key", "1 minute", "30 seconds"), "t").collect()}
    want = {}
    for _i, us, key, _ok, _c in rows:
        want[(us // US // 60 * 60, key)] = want.get((us // US // 60 * 60, key), 0) + 1
    last = rows[-1][1] // US - 30
    closed = {k: n for k, n in want.items() if k[0] + 60 <= last}
    assert {(int(a), k): n for (a, k), n in got.items()} == closed


def test_snapshot_keeper(spark, tmp_path):
    ddl = "url string, fetched_at string, price double, availability string, title string, n long"
    base, diff = str(tmp_path / "table"), str(tmp_path / "diff")
    spark.createDataFrame([("a", "0", 1.0, "x", "t", 0)], ddl).write.parquet(f"{base}/version=0")
    path = _land(spark, [("a", "1", 2.0, "x", "t", 1), ("b", "1", 5.0, "x", "t", 2), ("a", "2", 2.0, "x", "t", 3), ("b", "2", 6.0, "x", "t", 4)], ddl, str(tmp_path / "in"), 2)
    drain(_stream(spark, path), "t", "append", W.snapshot_keeper(base, diff, "n"))
    got = sorted((r["batch"], r["url"], r["change_type"]) for r in spark.read.parquet(diff).collect())
    assert got == [(0, "a", "MODIFIED"), (0, "b", "ADDED"), (1, "b", "MODIFIED")]
    final = {r["url"]: r["price"] for r in spark.read.parquet(f"{base}/version=2").collect()}
    assert final == {"a": 2.0, "b": 6.0}


def test_read_landed_takes_a_file(spark):
    assert read_landed(spark, "/root/testdata/sf0.001/events.parquet").isStreaming


def test_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.ru/x", "<p>unclosed <b>bold<i>x</p> tail &amp; &nbsp;end"), (2, "https://mpyarn.ru/x", None), (3, "https://b.ru/x", "<title>404 Not Found</title>")],
        "page_id int, url string, html string",
    )
    p = html_table.parse_pages(pages)
    s = {r["page_id"]: r for r in P.page_structure(p, "page_id").collect()}
    assert s[1]["element_count"] == 3 and s[1]["has_body"] is False
    c = {r["page_id"]: (r["cms"], r["confidence"]) for r in cms.detect(pages).collect()}
    assert c[2] == ("cm3", 1.05) and c[1][0] is None
    extra = [cms.Mark("own", "html", "unclosed")]
    assert cms.detect(pages, extra=extra).where("page_id = 1").head()["cms"] == "own"
    v = {r["page_id"]: r for r in P.verdicts(p.fillna({"html": ""}).withColumn("d", F.lit("d")), "d", "page_id", "page_id").collect()}
    assert v[3]["is_valid"] is False and v[3]["block_type"] == "silent_block"
