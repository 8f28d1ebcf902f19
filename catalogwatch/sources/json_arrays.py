"""Elements of one large JSON array, read by many tasks.

An export is one document whose ``products`` (or ``links``, or the document itself) is an array of any length. The file is cut
into byte ranges. A first pass says for each range, for both cases of what its first byte stands in (a text or not), how
depth and quotes change over it; running sums over these few numbers give every range's true state. A second pass finds where the
array begins, and a third one gives the elements that begin in a range, reading on to the end of the last one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_BYTES = 32 << 20
# What is read at once when an element goes on behind its range, and the bytes of values in one batch.
AHEAD = 1 << 16
TASKS_PER_CORE = 16
BATCH_BYTES = 4 << 20
_QUOTE, _BACKSLASH, _COMMA = b'"'[0], b"\\"[0], b","[0]
_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(b"[{")] = 1
_DEPTH[list(b"]}")] = -1


@lru_cache(maxsize=4)
def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)[0]


def read_range(uri: str, offset: int, size: int) -> bytes:
    """Bytes of a file: fewer at its end."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        with open(unquote(parts.path), "rb") as f:
            f.seek(offset)
            return f.read(size)
    with _store(f"{parts.scheme}://{parts.netloc}/").open_input_file(unquote(parts.path)) as f:
        f.seek(offset)
        return f.read(size)


def _escaped_start(uri: str, offset: int) -> bool:
    """Is the byte at ``offset`` behind an odd number of backslashes?"""
    count, size = 0, 64
    while offset:
        size = min(size, offset)
        part = read_range(uri, offset - size, size)
        run = len(part) - len(part.rstrip(b"\\"))
        count += run
        if run < len(part):
            break
        offset, size = offset - size, size * 2
    return bool(count % 2)


class Scan:
    """Quotes and depth over some bytes. ``escaped``: the first byte is taken literally."""

    def __init__(self, data: bytes, escaped: bool):
        x = np.frombuffer(data, np.uint8)
        places = np.arange(len(x))
        slash = x == _BACKSLASH
        # The last byte up to each place that is no backslash; -1 or, behind an open escape, -2 where there is none.
        other = np.maximum.accumulate(np.where(slash, -2 if escaped else -1, places)) if len(x) else places
        run = np.zeros(len(x), np.int64)
        if len(x):
            run[1:] = places[:-1] - other[:-1]
            run[0] = escaped
        quotes = (x == _QUOTE) & (run % 2 == 0)
        self.x, self.quotes = x, quotes
        self.odd = np.cumsum(quotes) % 2 == 1  # a text is open behind each place, if none was at the start
        self.steps = _DEPTH[x]
        self.ends_escaped = bool(len(x) and slash[-1] and (run[-1] % 2 == 0))

    def depth(self, inside: bool) -> np.ndarray:
        """Depth behind each place, from zero."""
        text = self.odd != inside
        return np.cumsum(np.where(text | self.quotes, 0, self.steps), dtype=np.int64)

    def outside(self, inside: bool) -> np.ndarray:
        """Places that are in no text, quotes left out."""
        return ~((self.odd != inside) | self.quotes)


_SUMMARY = "path string, k long, quotes long, turn0 long, turn1 long, low0 long, low1 long"


def _summaries(chunks: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k in zip(*(c.to_pylist() for c in batch.columns)):
                s = Scan(read_range(path, k * size, size), _escaped_start(path, k * size))
                depths = [s.depth(v) for v in (False, True)]
                turns = [int(d[-1]) if len(d) else 0 for d in depths]
                lows = [int(d.min(initial=0)) for d in depths]
                values = [path, k, int(s.quotes.sum() % 2), *turns, *lows]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["path", "k", "quotes", "turn0", "turn1", "low0", "low1"])

    return chunks.select("path", "k").mapInArrow(run, _SUMMARY)


# How far a field's name may stand in front of its bracket.
BACK = 4096


def _begin(path: str, k: int, inside: bool, depth: int, size: int, key: re.Pattern | None) -> tuple[int, int, bool] | None:
    """Offset of the array's bracket, if it lies in this range, the depth inside it, and whether it closes in this range."""
    base = k * size
    own = read_range(path, base, size)
    back = min(BACK, base)
    before = read_range(path, base - back, back)
    names = list(key.finditer(before + own)) if key else []
    if back < base and not names:  # most ranges hold neither the name nor the beginning of the document
        return None
    s = Scan(own, _escaped_start(path, base))
    depths, outside = depth + s.depth(inside), s.outside(inside)

    def found(at: int, level: int) -> tuple[int, int, bool]:
        return base + at, level, bool((outside[at:] & (depths[at:] < level)).any())

    if back == base:  # a bare list is the first thing in the document
        head = (before + own).lstrip(b" \t\r\n\xef\xbb\xbf")
        if head.startswith(b"[") and len(head) <= len(own):
            return found(len(own) - len(head), 1)
    for m in names:
        at = m.end() - 1 - back
        name = before[: m.start()] if m.start() < back else before + own[: m.start() - back]
        quoted = (len(name) - len(name.rstrip(b"\\"))) % 2 == 0
        if at >= 0 and quoted and outside[at] and depths[at] == 2:
            return found(at, 2)
    return None


def json_elements(spark: SparkSession, path, field: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, at, value``: the elements of the array in each file, as they are written, with their place in the file.

    The array is the document itself, or the value of ``field`` at the top of an object (the first of that name that is a list); where
    ``field`` is given, files that are a bare list give that list. A file without the array gives nothing. A document that breaks off gives the elements up to there, the
    broken one too; elements are not looked into, so that what is wrong inside one shows when it is parsed.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    size = chunk_bytes
    last = F.floor((F.col("length") - 1) / size)
    ranges = int(files.agg(F.sum(last + 1)).first()[0] or 0)
    # A fixed number of tasks: the rows are tiny, and the engine would put them all into one.
    tasks = max(1, min(ranges, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    chunks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k")).repartition(tasks, "path", "k")
    upto = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    states = _summaries(chunks, size)
    states = states.withColumn("inside", F.coalesce(F.sum("quotes").over(upto), F.lit(0)) % 2 == 1)
    turn, low = (F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")) for c in ("turn", "low"))
    states = states.select("path", "k", "inside", turn.alias("turn"), low.alias("low"))
    states = states.withColumn("depth", F.coalesce(F.sum("turn").over(upto), F.lit(0)))
    key = rb'"' + re.escape(field.encode()) + rb'"\s*:\s*\[' if field else None

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = re.compile(key) if key else None
        for batch in batches:
            for p, k, inside, depth in zip(*(c.to_pylist() for c in batch.columns)):
                if found := _begin(p, k, inside, depth, size, name):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (p, *found)], names=["path", "start", "level", "closed"])

    spread = states.repartition(tasks, "path", "k")
    starts = spread.select("path", "k", "inside", "depth").mapInArrow(locate, "path string, start long, level long, closed boolean")
    starts = starts.groupBy("path").agg(F.min(F.struct("start", "level", "closed")).alias("s")).select("path", "s.*")
    # Ranges from the array's beginning to the one in which it ends.
    known = spread.join(starts, "path").where((F.col("k") + 1) * size > F.col("start"))
    behind = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    opened = F.col("k") * size > F.col("start")  # the beginning lies in an earlier range
    lowest = F.min(F.when(opened, F.col("depth") + F.col("low"))).over(behind)
    known = known.withColumn("lowest", lowest).where(F.col("lowest").isNull() | (F.col("lowest") >= F.col("level")))
    known = known.where(~opened | ~F.col("closed"))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "at", "value"]
        for batch in batches:
            for p, k, inside, depth, start, level in zip(*(c.to_pylist() for c in batch.columns)):
                places, values, held = [], [], 0
                for at, value in _elements(p, k, inside, depth, start, level, size):
                    places.append(at), values.append(value)
                    held += len(value)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([p] * len(values)), pa.array(places), _texts(values)], names=names)
                        places, values, held = [], [], 0
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(values)), pa.array(places), _texts(values)], names=names)

    columns = ["path", "k", "inside", "depth", "start", "level"]
    return known.select(*columns).repartition(tasks, "path", "k").mapInArrow(elements, "path string, at long, value string")


def _texts(values: list[bytes]) -> pa.Array:
    return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def _elements(path: str, k: int, inside: bool, depth: int, start: int, level: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Elements that begin in range ``k``: behind the array's bracket or behind a comma on its level."""
    base = k * size
    data = read_range(path, base, size)
    s = Scan(data, _escaped_start(path, base))
    depths, outside = depth + s.depth(inside), s.outside(inside)
    first = start - base
    own = np.arange(len(data)) > first
    closes = np.flatnonzero(own & (depths < level) & outside)
    end = int(closes[0]) if len(closes) else None
    commas = np.flatnonzero(own & outside & (depths == level) & (s.x == _COMMA))
    if end is not None:
        commas = commas[commas < end]
    marks = commas.tolist()
    begins = ([first] if 0 <= first < len(data) else []) + marks
    ends = [*marks, end] if begins[:1] == [first] else [*marks[1:], end]
    for a, b in zip(begins, ends):
        if b is not None:
            value = data[a + 1 : b]
        else:
            value = data[a + 1 :] + _rest(path, base + len(data), s, depths, inside, depth, level)
        if value := value.strip(b" \t\r\n"):
            yield base + a + 1, value


def _rest(path: str, at: int, s: Scan, depths: np.ndarray, inside: bool, depth: int, level: int) -> bytes:
    """What belongs to the last element behind its range, up to a comma on the array's level or the array's end."""
    inside = bool(s.odd[-1] != inside) if len(s.x) else inside
    depth, escaped, parts, ahead = int(depths[-1]) if len(depths) else depth, s.ends_escaped, [], AHEAD
    while data := read_range(path, at, ahead):
        s = Scan(data, escaped)
        depths, outside = depth + s.depth(inside), s.outside(inside)
        stops = np.flatnonzero(outside & ((depths < level) | ((depths == level) & (s.x == _COMMA))))
        if len(stops):
            return b"".join([*parts, data[: int(stops[0])]])
        parts.append(data)
        inside, depth, escaped = bool(s.odd[-1] != inside), int(depths[-1]), s.ends_escaped
        at, ahead = at + len(data), ahead * 2
    return b"".join(parts)
