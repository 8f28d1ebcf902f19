"""Removal of long repeated strings with a logarithmic family of suffix arrays.

A string of ``span`` bytes is repeated if it starts anywhere else. Sorting the suffixes of all texts would move many times their
size, so the suffixes are first dealt out by content. Every string of ``span`` bytes has an anchor: its piece of half that length
with the least hash, the leftmost of equals. Equal strings have equal anchors at equal places, so strings meet under the hash of
their anchor. Neighbouring strings mostly share an anchor; such a run of strings, as the bytes it covers, is a context.

Equal contexts are counted, not compared: where a context stands twice, all its strings are repeated. Of the others, only those
whose anchor has several different contexts are looked into. They come to a worker by anchor, batch by batch. A batch gets a
suffix array; it is merge-scanned against the arrays of the levels for strings that they share, and levels of equal size
merge, so that there are never more levels than the logarithm of the number of batches. Anchors of very many contexts don't
go into one task: there the single strings are counted by their digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from catalogwatch.llm.store import settle

SPAN = 400
# Bytes whose strings are looked at together.
BLOCK = 1 << 20
# Bytes of a batch that gets a suffix array, and of a family before it starts anew behind an anchor.
BATCH_BYTES = 1 << 20
FAMILY_BYTES = 8 << 20
# Anchors with more different contexts are counted by string instead of being given to one task.
CONTEXTS_OF_ANCHOR = 4096

_TABLE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _WORD, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_KNOWN_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; one pair a process, as long as the longest block so far."""
    size = 1 << max(12, (n - 1).bit_length())
    if not _KNOWN_POWERS or next(iter(_KNOWN_POWERS)) < size:
        _KNOWN_POWERS.clear()
        _KNOWN_POWERS[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    up, down = next(iter(_KNOWN_POWERS.values()))
    return up[:n], down[:n]


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each piece of ``size`` bytes, from running sums."""
    up, down = _power_tables(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * up, out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: len(x) - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Runs:
    """Runs of strings with one anchor in a block of texts: text, first and last string, anchor, anchor's hash."""

    def __init__(self, x: np.ndarray, ends: np.ndarray, span: int):
        """``ends`` are the ends of the texts that make up ``x``."""
        gram = max(1, span // 2)
        empty = np.empty(0, np.int64)
        self.text = self.first = self.last = self.anchor = empty
        self.hash = empty
        starts = np.concatenate(([0], ends[:-1]))
        if len(x) < span or not (ends - starts >= span).any():
            return
        hashes = gram_hashes(x, gram)
        # A fixed number of bits, or equal strings could have different anchors in blocks of different sizes.
        mask = np.uint64((1 << (BLOCK + span).bit_length()) - 1)
        packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        anchors = (sliding_least(packed, span - gram + 1) & mask).astype(np.int64)
        if len(ends) > 1:
            whole = np.zeros(len(anchors) + 1, np.int32)
            rooms = ends - starts >= span
            np.add.at(whole, starts[rooms], 1)
            np.add.at(whole, ends[rooms] - span + 1, -1)
            at = np.flatnonzero(np.cumsum(whole[:-1]))
        else:
            at = np.arange(len(anchors))
        anchors = anchors[at]
        breaks = np.flatnonzero((np.diff(anchors) != 0) | (np.diff(at) != 1)) + 1
        self.first = at[np.concatenate(([0], breaks))]
        self.last = at[np.concatenate((breaks, [len(at)])) - 1]
        self.anchor = anchors[np.concatenate(([0], breaks))]
        self.text = np.searchsorted(ends, self.first, side="right")
        self.hash = hashes[self.anchor].view(np.int64)


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals that overlap or touch."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], starts[1:] > stops[:-1])) if len(starts) else np.empty(0, bool)
    where = np.flatnonzero(new)
    return starts[where], stops[np.concatenate((where[1:], [len(starts)])) - 1] if len(where) else stops


def _blocks(lengths: np.ndarray, span: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text behind the last, bytes to leave out at its start, bytes to take): whole texts, or parts of a long one.

    Parts of one text overlap by ``span - 1`` bytes, so that each of its strings lies in one part. Cuts hang on the text alone.
    """
    at, size = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if size and size + n > BLOCK:
            yield at, k, 0, size
            at, size = k, 0
        if n > BLOCK:
            for skip in range(0, n - span + 1, BLOCK):
                yield k, k + 1, skip, min(BLOCK + span - 1, n - skip)
            at, size = k + 1, 0
        else:
            size += n
    if size:
        yield at, len(lengths), 0, size


# Texts travel compressed, one frame each.
_PACKED = "k1 long, k2 long, z binary"
LEVEL = 1


def _packed(rows: DataFrame, *keep: str) -> DataFrame:
    """``rows(k1, k2, text)`` with the text compressed: ``k1, k2, z`` and what is to be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            z = pa.array([pack.compress(x.as_buffer()) for x in batch.column("text")], pa.binary())
            columns = [batch.column("k1"), batch.column("k2"), z, *(batch.column(c) for c in keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "z", *keep])

    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("k1", "k2", "text", *keep).mapInArrow(run, _PACKED + kinds)


_SCAN = "k1 long, k2 long, c1 long, c2 long, h long, start long, lo int, hi int, n long, stop long"


def _scan(texts: DataFrame, span: int) -> DataFrame:
    """Contexts of all texts (``n`` of them, at ``start``) and, where ``c1`` is null, bytes ``start`` to ``stop`` known to be repeated.

    Contexts that a block has several times are given once, with their places as such bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = [np.asarray(batch.column(k)) for k in (0, 1)]
            for a, b, skip, size in _blocks(lengths, span):
                if b - a == 1:
                    whole, ends = memoryview(column[a].as_buffer())[skip : skip + size], np.array([size])
                else:
                    whole, ends = memoryview(b"".join([x.as_buffer() for x in column[a:b]])), np.cumsum(lengths[a:b])
                runs = Runs(np.frombuffer(whole, np.uint8), ends, span)
                if len(runs.first):
                    yield _contexts(whole, runs, ends, skip, span, [k[a:b] for k in keys])

    names = [x.split()[0] for x in _SCAN.split(", ")]

    def _contexts(view, runs: Runs, ends, skip: int, span: int, keys) -> pa.RecordBatch:
        digests = b"".join([xxh3_128_digest(view[s : e + span]) for s, e in zip(runs.first.tolist(), runs.last.tolist())])
        pairs = np.frombuffer(digests, "<i8").reshape(-1, 2)
        _, first, inverse = np.unique(np.frombuffer(digests, [("a", "<i8"), ("b", "<i8")]), return_index=True, return_inverse=True)
        n = np.bincount(inverse)
        often = n[inverse] > 1
        begins = np.concatenate(([0], ends[:-1])) - skip
        base = begins[runs.text]
        # A gap between texts, so that runs of two texts don't merge.
        lost_at, lost_to = merged((runs.first + runs.text)[often], (runs.last + runs.text)[often] + span)
        lost_text = np.searchsorted(ends + np.arange(len(ends)), lost_at, side="right")
        lost_base = begins[lost_text] + lost_text
        none = len(lost_at)

        def column(own: np.ndarray, other: np.ndarray | None, kind: pa.DataType) -> pa.Array:
            tail = np.zeros(none, np.int64) if other is None else other
            return pa.array(np.concatenate((own, tail)), kind, mask=np.concatenate((np.zeros(len(own), bool), np.full(none, other is None))))

        text = runs.text[first]
        columns = [
            column(keys[0][text], keys[0][lost_text], pa.int64()), column(keys[1][text], keys[1][lost_text], pa.int64()),
            column(pairs[first, 0], None, pa.int64()), column(pairs[first, 1], None, pa.int64()), column(runs.hash[first], None, pa.int64()),
            column((runs.first - base)[first], lost_at - lost_base, pa.int64()),
            column((runs.anchor - runs.last)[first].astype(np.int32), None, pa.int32()),
            column((runs.anchor - runs.first)[first].astype(np.int32), None, pa.int32()),
            column(n, None, pa.int64()),
            pa.array(np.concatenate((np.zeros(len(first), np.int64), lost_to - lost_base)), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, _SCAN)


# --- suffix arrays ---------------------------------------------------------------------------------


class SuffixArray:
    """Strings of ``span`` bytes of some contexts in lexicographic order: the text, where they start, which context and place."""

    def __init__(self, text: np.ndarray, order: np.ndarray, span: int):
        self.text, self.order, self.span = text, order, span
        self.heads = self._heads()

    def _heads(self) -> np.ndarray:
        """The first eight bytes of each string as a number, in order."""
        width = min(8, self.span)
        out = np.zeros(len(self.order), np.uint64)
        for k in range(width):
            out = (out << np.uint64(8)) | self.text[self.order + k].astype(np.uint64)
        return out

    @classmethod
    def build(cls, text: np.ndarray, starts: np.ndarray, span: int) -> SuffixArray:
        """By doubling: ranks of 1, 2, 4, ... bytes until ``span`` bytes are ranked, over all places of the text.

        Places too near the end rank as if zeros followed; no string starts there.
        """
        rank, have = text.astype(np.int64), 1
        while have < span:
            step = min(have, span - have)
            later = np.zeros(len(rank), np.int64)
            later[: len(rank) - step] = rank[step:]
            both = rank * (int(later.max(initial=0)) + 1) + later
            have += step
            rank = np.unique(both[starts] if have >= span else both, return_inverse=True)[1]
        if span == 1:
            rank = rank[starts]
        return cls(text, starts[np.argsort(rank, kind="stable")], span)

    def strings(self, which: np.ndarray | slice) -> np.ndarray:
        """The strings at places of the order, as values that compare by their bytes."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.span)[self.order[which]]
        return np.ascontiguousarray(view).view(f"S{self.span}").ravel()

    def repeated(self) -> np.ndarray:
        """Places of the order whose string equals a neighbour's."""
        same = np.zeros(len(self.order) + 1, bool)
        for at in range(0, len(self.order) - 1, 8192):
            upto = min(len(self.order) - 1, at + 8192)
            candidates = at + np.flatnonzero(self.heads[at:upto] == self.heads[at + 1 : upto + 1])
            same[candidates + 1] = _equal(self, candidates, self, candidates + 1)
        return np.flatnonzero(same[:-1] | same[1:])


def _equal(a: SuffixArray, at: np.ndarray, b: SuffixArray, bt: np.ndarray) -> np.ndarray:
    left = np.lib.stride_tricks.sliding_window_view(a.text, a.span)[a.order[at]]
    right = np.lib.stride_tricks.sliding_window_view(b.text, b.span)[b.order[bt]]
    return (left == right).all(axis=1)


def places(level: SuffixArray, batch: SuffixArray) -> np.ndarray:
    """For each string of the batch the number of the level's strings before it: a merge, by halving ranges of equal heads."""
    low = np.searchsorted(level.heads, batch.heads, side="left")
    high = np.searchsorted(level.heads, batch.heads, side="right")
    for at in range(0, len(low), 8192):
        open_ = at + np.flatnonzero(low[at : at + 8192] < high[at : at + 8192])
        while len(open_):
            own, middle = batch.strings(open_), (low[open_] + high[open_]) // 2
            less = level.strings(middle) < own
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
    return low


def shared(level: SuffixArray, batch: SuffixArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the level's and of the batch's order whose strings stand in the other one too; ``at`` from :func:`places`."""
    known, new = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for block in range(0, len(at), 8192):
        own = block + np.flatnonzero(at[block : block + 8192] < len(level.order))
        own = own[level.heads[at[own]] == batch.heads[own]]
        same = own[_equal(level, at[own], batch, own)]
        new.append(same)
        known.append(at[same])
    return np.unique(np.concatenate(known)), np.concatenate(new)


class Family:
    """Levels of suffix arrays over contexts that came in batches, and the strings found to be repeated."""

    def __init__(self, span: int):
        self.span = span
        self.levels: list[tuple[int, SuffixArray, np.ndarray]] = []  # (rank, array, owner of each byte of its text)
        self.bytes = 0

    def add(self, texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, place) of strings that are repeated in the batch or between it and the levels.

        A string of an older batch that equals one of this batch is given too. ``ids`` are the numbers of the contexts.
        """
        lengths = np.array([len(x) for x in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        counts = lengths - self.span + 1
        starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        text = np.frombuffer(b"".join(texts), np.uint8)
        batch = SuffixArray.build(text, starts, self.span)
        # Each context's number and beginning, found by where a string starts.
        index = np.stack((begins, ids))
        found = [self._named(batch, index, batch.repeated())]
        scans = [(level, places(level[1], batch)) for level in self.levels]
        for (_, array, own), at in scans:
            old, new = shared(array, batch, at)
            found += [self._named(array, own, old), self._named(batch, index, new)]
        self.bytes += len(text)
        self._keep(batch, index, scans)
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))

    @staticmethod
    def _named(array: SuffixArray, index: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = array.order[which]
        k = np.searchsorted(index[0], at, side="right") - 1
        return index[1][k], at - index[0][k]

    def _keep(self, batch: SuffixArray, index: np.ndarray, scans: list) -> None:
        """Puts the batch in as the lowest level; levels of equal rank merge."""
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, old, own = self.levels.pop()
            at = next((x for level, x in scans if level[1] is old), None) if rank == 0 else None
            batch, index = self._merge(old, own, batch, index, at)
            rank += 1
        self.levels.append((rank, batch, index))

    def _merge(self, old: SuffixArray, own: np.ndarray, new: SuffixArray, index: np.ndarray, at: np.ndarray | None):
        at = places(old, new) if at is None else at
        shift = len(old.text)
        order = np.insert(old.order, at, new.order + shift)
        text = np.concatenate((old.text, new.text))
        return SuffixArray(text, order, self.span), np.concatenate((own, index + np.array([[shift], [0]])), axis=1)

    def clear(self) -> None:
        self.levels, self.bytes = [], 0


_CONTEXTS = "c1 long, c2 long, h long, n long, lo int, hi int, bytes binary"
_FOUND = "c1 long, c2 long, lo int, hi int"


def _spans_found(contexts: np.ndarray, at: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings: context, least and greatest offset of the anchor from a string's start."""
    both = np.unique(np.stack((contexts, at)), axis=1)
    if not both.shape[1]:
        return both[0], both[0], both[0]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(both[0]) != 0) | (np.diff(both[1]) != 1))))
    last = np.concatenate((new[1:], [both.shape[1]])) - 1
    own = both[0][new]
    return own, highs[own] - both[1][last], highs[own] - both[1][new]


def _through_family(contexts: DataFrame, span: int, batch_bytes: int, family_bytes: int) -> DataFrame:
    """Repeated strings of contexts that stand once, among all contexts of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(span)
        c1, c2, highs, texts = [], [], [], []
        done = 0  # contexts of this family already in it

        def add() -> pa.RecordBatch:
            nonlocal done
            ids = np.arange(done, done + len(texts))
            done += len(texts)
            own, low, high = _spans_found(*family.add(texts, ids), np.array(highs, np.int64))
            own = own.tolist()
            columns = [pa.array([c1[k] for k in own], pa.int64()), pa.array([c2[k] for k in own], pa.int64())]
            texts.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["c1", "c2", "lo", "hi"])

        size, before = 0, None
        for batch in batches:
            for a, b, h, hi, text in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "h", "hi", "bytes"))):
                if size >= batch_bytes:
                    yield add()
                    size = 0
                # Strings of different anchors are never equal, so a family may end between anchors.
                if h != before and family.bytes + size >= family_bytes:
                    if texts:
                        yield add()
                    family.clear()
                    c1, c2, highs, size, done = [], [], [], 0, 0
                before = h
                c1.append(a), c2.append(b), highs.append(hi), texts.append(text)
                size += len(text)
        if texts:
            yield add()

    dealt = contexts.select("c1", "c2", "h", "hi", "bytes").repartition("h").sortWithinPartitions("h", "c1", "c2")
    return dealt.mapInArrow(run, _FOUND)


def _by_string(contexts: DataFrame, span: int) -> DataFrame:
    """The same for anchors of very many contexts: strings counted by digest, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c1, c2, hi, text in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "hi", "bytes"))):
                n = len(text) - span + 1
                view = memoryview(text)
                digests = np.frombuffer(b"".join([xxh3_128_digest(view[k : k + span]) for k in range(n)]), "<i8").reshape(-1, 2)
                columns = [np.full(n, c1), np.full(n, c2), (hi - np.arange(n)).astype(np.int32), digests[:, 0].copy(), digests[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["c1", "c2", "at", "w1", "w2"])

    strings = settle(contexts.select("c1", "c2", "hi", "bytes").mapInArrow(run, "c1 long, c2 long, at int, w1 long, w2 long"), "repeat-strings")
    several = strings.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    return strings.join(several, ["w1", "w2"], "left_semi").select("c1", "c2", F.col("at").alias("lo"), F.col("at").alias("hi"))


def _contexts_with_bytes(wanted: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """Contexts cut out of their texts; each text is read once for all its contexts, whatever number of copies it has."""
    facts = F.collect_list(F.struct("c1", "c2", "h", "n", "start", "lo", "hi")).alias("facts")
    own = wanted.groupBy("k1", "k2").agg(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("bytes", pa.binary())])
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for z, facts in zip(batch.column(0), batch.column(1)):
                view = memoryview(unpack.decompress(z.as_buffer()))
                facts = facts.as_py()
                for at in range(0, len(facts), 4096):
                    some = facts[at : at + 4096]
                    columns = [pa.array([f[c] for f in some], schema.field(c).type) for c in schema.names[:-1]]
                    cut = [bytes(view[f["start"] : f["start"] + f["hi"] - f["lo"] + span]) for f in some]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], schema=schema)

    one = _packed(texts).groupBy("k1", "k2").agg(F.first("z").alias("z"))
    return one.join(own, ["k1", "k2"]).select("z", "facts").mapInArrow(run, _CONTEXTS)


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def _keys() -> list[Column]:
    return [F.xxhash64(F.lit(k), "text").alias(f"k{k}") for k in (1, 2)]


def repeated_spans(
    docs: DataFrame, text: str = "text", span: int = SPAN, contexts_of_anchor: int = CONTEXTS_OF_ANCHOR,
    batch_bytes: int = BATCH_BYTES, family_bytes: int = FAMILY_BYTES,
) -> DataFrame:
    """``k1, k2, spans``: what to remove of each text that loses anything, by the two hashes of its bytes.

    ``spans`` are ``array<struct<start, stop>>`` in order, which may overlap. Digests of 128 bits stand for equal texts, contexts
    and counted strings; whether an anchor has several contexts is told by 64 of them.
    """
    if span < 1:
        raise ValueError("a span has at least one byte")
    texts = docs.select(_bytes(text).alias("text")).where(F.octet_length("text") >= span).select(*_keys(), "text")
    scan = settle(_scan(texts, span), "repeat-scan")
    places_, known = scan.where("c1 IS NOT NULL"), scan.where("c1 IS NULL").select("k1", "k2", "start", "stop")

    several = (F.min("c1") != F.max("c1")).alias("several")
    anchors = places_.groupBy("h").agg(several, F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).where("n > 1")
    met = settle(places_.join(anchors.select("h", "several", "rows"), "h"), "repeat-met")
    # An anchor that always has the same context: all its strings are repeated wherever it stands.
    whole = met.where("NOT several").select("k1", "k2", "start", (F.col("start") + F.col("hi") - F.col("lo") + span).alias("stop"))

    mixed = met.where("several")
    # What identifies a context fixes its anchor and length; any one place serves to read its bytes.
    one = [F.first(c).alias(c) for c in ("k1", "k2", "start")]
    facts = [F.sum("n").alias("n"), F.max("rows").alias("rows"), *one]
    contexts = settle(mixed.groupBy("c1", "c2", "h", "lo", "hi").agg(*facts), "repeat-contexts")
    bodies = settle(_contexts_with_bytes(contexts, texts, span), "repeat-bodies")
    crowds = contexts.where(F.col("rows") > contexts_of_anchor).select("h").distinct()
    found = _through_family(bodies.join(crowds, "h", "left_anti"), span, batch_bytes, family_bytes).union(
        _by_string(bodies.join(crowds, "h", "left_semi"), span)
    )
    lost = found.union(contexts.where("n > 1").select("c1", "c2", "lo", "hi")).groupBy("c1", "c2").agg(F.collect_set(F.struct("lo", "hi")).alias("cut"))
    at = F.col("start") + F.col("hi")  # the anchor's place
    spots = mixed.select("k1", "k2", "c1", "c2", at.alias("at")).join(lost, ["c1", "c2"]).select("k1", "k2", "at", F.explode("cut").alias("x"))
    spots = spots.select("k1", "k2", (F.col("at") - F.col("x.hi")).alias("start"), (F.col("at") - F.col("x.lo") + span).alias("stop"))
    return whole.union(spots).union(known).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, **sizes: int) -> DataFrame:
    """``doc_id, n_bytes, removed array<struct<start, stop>>, kept binary`` of every row.

    Removed is each byte covered by a string of ``span`` bytes that also starts anywhere else, in the same text too; overlaps
    count, matches never cross documents, and strings are judged on the input. Removed runs are maximal. A null or empty text, and
    one shorter than ``span``, loses nothing; rows that repeat a text are documents of their own and lose it all. A null doc_id
    keeps its row. An empty table gives an empty table; other columns, whatever their names, are ignored.
    """
    spans = repeated_spans(docs, text, span, **sizes)
    rows = _packed(docs.select(F.col(doc_id).alias("doc_id"), _bytes(text).alias("text")).select("doc_id", *_keys(), "text"), "doc_id")
    runs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def made(ids: pa.Array, done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in done], kind) for k, kind in enumerate((pa.int64(), runs, pa.binary()))]
        return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_bytes", "removed", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            done, size, first = [], 0, 0
            for k, (z, own) in enumerate(zip(batch.column("z"), batch.column("spans"))):
                whole = unpack.decompress(z.as_buffer())
                both = np.array([(x["start"], x["stop"]) for x in own.as_py() or ()], np.int64).reshape(-1, 2)
                starts, stops = merged(both[:, 0], both[:, 1])
                edges = [0, *np.stack((starts, stops), 1).ravel().tolist(), len(whole)]
                kept = b"".join([whole[a:b] for a, b in zip(edges[::2], edges[1::2])])
                done.append((len(whole), [{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist())], kept))
                size += len(kept)
                if size >= BLOCK:
                    yield made(batch.column("doc_id").slice(first, k + 1 - first), done)
                    done, size, first = [], 0, k + 1
            if done:
                yield made(batch.column("doc_id").slice(first), done)

    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, removed array<struct<start:bigint,stop:bigint>>, kept binary")
