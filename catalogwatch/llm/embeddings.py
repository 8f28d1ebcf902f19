"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors by a word of random hyperplane bits, so that near ones come to stand side by side, and
compares every vector with a bounded window of its neighbours. How many vectors share the leading bits is counted: where
they are more than a window, they are compared whole, in blocks, so that the chance to find a pair depends on its angle
only and not on how the vectors lie. Verified pairs of all passes are united to components. Windows don't show every link
of a dense group; as linked vectors are in one component, the links are then counted whole within each component, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogwatch.llm.graph import components
from catalogwatch.llm.store import settle

LEAST_COSINE = 0.9
BITS = 62
WINDOW = 128
SEED = 20_240_117
# Chance, at most, that no pass brings a pair at the threshold into one window.
MISSED = 0.02
# Members of a component, and of a crowded prefix, that are compared as one block; rows of it that are multiplied at once.
BLOCK = 512
CROWD_BLOCK = 2048
ROWS = 256


def prefix_for(rows: int, window: int = WINDOW) -> int:
    """Leading bits that would cut the rows down to a window if each halved them."""
    return min(BITS, max(0, math.ceil(math.log2(max(rows, 2) / window))))


def passes_for(rows: int, cosine: float = LEAST_COSINE, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes that find a pair at the threshold with probability ``1 - missed``, whatever the number of rows and their places.

    Two vectors at an angle share each bit with probability ``1 - angle / pi``, and all rows that share the leading bits
    of :func:`prefix_for` are compared.
    """
    together = (1 - math.acos(cosine) / math.pi) ** prefix_for(rows, window)
    return max(2, math.ceil(math.log(missed) / math.log(1 - min(together, 0.999))))


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v, fine``; fine: neither null nor empty, all components finite, not all of them zero."""
    kind = vectors.schema[embedding].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as floats
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    return rows.withColumn("fine", F.coalesce(fine, F.lit(False)))


def _keys(passes: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim in np.unique(lengths := batch.column(1).value_lengths().to_numpy()).tolist():
                part = batch.filter(pa.array(lengths == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, passes * bits))
                on = (unit_rows(part.column(1)) @ planes[dim] >= 0).reshape(-1, passes, bits)
                words = on.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(np.arange(0, words.size + 1, passes, dtype=np.int32), words.ravel())],
                    names=["rep", "v", "words"],
                )

    return run


def _forest(n: int, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Of verified pairs of ``n`` rows as many as join the same rows: a pair within an already joined group adds nothing."""
    above = list(range(n))
    kept = []
    for a, b in zip(left, right):
        x, y = a, b
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        if x != y:
            above[x] = y
            kept.append((a, b))
    return kept


def _window_pairs(window: int, least: float):
    """Verified pairs (u, v), u < v, within ``window`` places in the sorted rows of a partition, as far as they join groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # pass, dimension, ids and vectors of the last rows
        for batch in batches:
            passes, dims = batch.column(0).to_numpy(), batch.column(3).value_lengths().to_numpy()
            cuts = np.flatnonzero((passes[1:] != passes[:-1]) | (dims[1:] != dims[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(passes)]):
                for at in range(a, b, 1024):
                    part = batch.slice(at, min(b, at + 1024) - at)
                    ids, rows, key = part.column(2).to_numpy(), unit_rows(part.column(3)), (int(passes[at]), int(dims[at]))
                    if before and before[0] == key:
                        old_ids, old = before[1], before[2]
                    else:
                        old_ids, old = ids[:0], rows[:0]
                    all_ids, every = np.concatenate([old_ids, ids]), np.concatenate([old, rows])
                    i, j = np.nonzero(rows @ every.T >= least)
                    gap = i + len(old_ids) - j  # places back
                    near = (gap > 0) & (gap <= window)
                    pairs = _forest(len(all_ids), (i[near] + len(old_ids)).tolist(), j[near].tolist())
                    if pairs:
                        x, y = all_ids[np.array(pairs).T]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])
                    before = (key, all_ids[-window:], every[-window:])

    return run


def _by_block(work):
    """``work(block, same)`` for each block of rows of one (group, i, j) that stand side by side in a sorted partition; same: i = j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from work(pa.Table.from_batches(held).combine_chunks(), key[1] == key[2])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in (0, 1, 2)]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                now = tuple(int(k[a]) for k in keys) if b > a else key
                if now != key:
                    yield from flush()
                    held, key = [], now
                held.append(batch.slice(a, b - a))
        yield from flush()

    return run


def _block_links(least: float):
    """Weights of linked partners, for blocks of a component's members."""

    def work(block: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        side, ids, weight = (block.column(c).to_numpy() for c in ("side", "rep", "weight"))
        rows = unit_rows(block.column("v").chunk(0))
        mine, other = (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if same:
            other = mine
        hit = rows[mine] @ rows[other].T >= least
        sums = [(ids[mine], hit @ weight[other])]
        if same:
            sums = [(ids[mine], sums[0][1] - hit.diagonal() * weight[mine])]
        else:
            sums.append((ids[other], hit.T @ weight[mine]))
        for i, n in sums:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n.astype(np.int64))], names=["rep", "n"])

    return _by_block(work)


def _block_pairs(least: float):
    """Verified pairs (u, v), u < v, of blocks of a crowded prefix, as far as they join groups."""

    def work(block: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        side, ids = block.column("side").to_numpy(), block.column("rep").to_numpy()
        rows = unit_rows(block.column("v").chunk(0))
        mine = np.flatnonzero(side == 0)
        other = mine if same else np.flatnonzero(side == 1)
        group = np.arange(len(ids))  # of each row, the group that the pairs so far join it to
        pairs: list[tuple[int, int]] = []
        for at in range(0, len(mine), ROWS):
            hit = rows[mine[at : at + ROWS]] @ rows[other].T >= least
            for k in np.flatnonzero(hit.any(axis=1)).tolist():
                a, linked = mine[at + k], other[hit[k]]
                groups, first = np.unique(group[linked], return_index=True)
                fresh = groups != group[a]
                if fresh.any():
                    pairs += [(ids[a], ids[b]) for b in linked[first[fresh]]]
                    group[np.isin(group, groups[fresh])] = group[a]
        if pairs:
            x, y = np.array(pairs, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])

    return _by_block(work)


def _dealt(members: DataFrame, *keep: str) -> DataFrame:
    """Rows of ``members`` (group, blocks, rep …) once for each pair of blocks (i, j) of their group they take part in."""
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A member meets every block of its group once: as the first side of (own, later), as the second of (earlier, own).
    meets = F.expr("transform(sequence(0, blocks - 1), b -> struct(least(b, block) as i, greatest(b, block) as j, if(b < block, 1, 0) as side))")
    met = members.select("group", "rep", *keep, F.explode(meets).alias("m")).select("group", "m.i", "m.j", "m.side", "rep", *keep)
    return met.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")


def _crowds(spread: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """``group, pass, dim, prefix, members`` of the prefixes that more rows share than a window holds, from their counts.

    Where comparing these whole would take more comparisons than all rows of a length, which then are one group of pass 0.
    """
    counts = spread.groupBy("pass", "dim", "prefix").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > window)
    counts = settle(counts, "vector-prefixes")
    work = F.sum(F.col("members").cast("double") * F.col("members"))
    lengths = classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    dear = counts.groupBy("dim").agg(work.alias("work")).join(lengths, "dim").where(F.col("work") > F.col("rows").cast("double") * F.col("rows"))
    whole = dear.select(F.lit(-1).alias("pass"), "dim", F.lit(0).cast("long").alias("prefix"), F.col("rows").alias("members"))
    parts = counts.join(dear.select("dim"), "dim", "left_anti").select("pass", "dim", "prefix", "members")
    return settle(parts.union(whole).withColumn("group", F.monotonically_increasing_id()), "vector-crowds")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE, window: int = WINDOW,
    passes: int | None = None,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per input row, other columns ignored.

    Vectors link at a cosine of ``least`` or more, in double precision. Null, empty and zero vectors and those with null or
    non-finite components link with nothing and are their own component, and so do vectors of different lengths among each
    other. Equal vectors are one class, whose links count with its size. Repeated ids are rows of their own; a null vec_id
    is never the smallest of its component. An empty table gives an empty table. ``passes`` follows from the number of
    different vectors (:func:`passes_for`) unless it is given.
    """
    rows = usable(vectors, vec_id, embedding).withColumn("row", F.monotonically_increasing_id())
    # A class has the number of its first row as its node, so null and repeated ids do no harm.
    rows = settle(rows, "vectors")
    classes = rows.where("fine").groupBy("v").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"))
    classes = settle(classes, "classes")
    total = classes.count()
    passes, prefix = passes or passes_for(total, least, window), prefix_for(total, window)
    kind = classes.schema["v"].dataType.simpleString()
    words = settle(classes.select("rep", "v").mapInArrow(_keys(passes, BITS), f"rep long, v {kind}, words array<long>"), "vector-words")
    spread = words.select(F.posexplode("words").alias("pass", "word"), "rep", "v", F.size("v").alias("dim"))
    spread = spread.withColumn("prefix", F.shiftright("word", BITS - prefix))
    crowds = _crowds(spread, classes, window)
    # Ranges of (pass, prefix), and within crowded ones of (word, rep): what a window holds isn't cut, and equal words are
    # split, so no task depends on how many rows look alike.
    crowded = spread.join(crowds.where("pass >= 0").select("pass", "dim", "prefix", "group", "members"), ["pass", "dim", "prefix"], "left")
    within = [F.when(F.col("group").isNotNull(), F.col(c)) for c in ("word", "rep")]
    ordered = crowded.repartitionByRange("pass", "dim", "prefix", *within).sortWithinPartitions("pass", "dim", "word", "rep")
    near = ordered.select("pass", "word", "rep", "v").mapInArrow(_window_pairs(window, least), "u long, v long")
    blocks = F.ceil(F.col("members") / CROWD_BLOCK).cast("int").alias("blocks")
    every = words.withColumn("dim", F.size("v")).join(crowds.where("pass < 0").select("dim", "group", "members"), "dim")
    dense = crowded.where(F.col("group").isNotNull()).select("group", blocks, "rep", "v").union(every.select("group", blocks, "rep", "v"))
    whole = _dealt(dense, "v").mapInArrow(_block_pairs(least), "u long, v long")
    pairs = near.union(whole).distinct()
    joined = settle(components(pairs, "vectors").select(F.col("node").alias("rep"), "component"), "vector-components")

    sizes = joined.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("c"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    members = joined.join(sizes.select("component", blocks.alias("blocks")), "component").join(classes, "rep")
    dealt = _dealt(members.withColumnRenamed("component", "group"), "weight", "v")
    counted = dealt.mapInArrow(_block_links(least), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))

    smallest = joined.join(classes.select("rep", "least_id"), "rep").groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = joined.join(smallest, "component").join(counted, "rep", "left").select("rep", "component_id", "n")
    full = classes.join(known, "rep", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")
    )
    fine = rows.where("fine").join(full, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = fine.union(alone)
    return done.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
