"""Centroid clustering in whole numbers, with centroids ruled out in a rotated space.

The principal axes of all vectors are fitted once. Of each vector are stored its whole-number components, its leading
rotated coordinates and the norm of what those leave out. Between a vector and a centroid, the squared distance of the
leading coordinates plus the squared difference of the two norms is never more than the squared distance itself. A centroid
whose bound lies above the distance to a first guess is out; the others are compared in whole numbers, so that neither the
rotation nor rounding can show in a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogwatch.llm.store import settle

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
LEADING = 16
SALT = "2:"
# Components of this size or more could make a squared distance that 64 bits don't hold.
COMPONENT_LIMIT = 1 << 27
# Relative room for rounding in a bound; doubles err by less than a thousandth of it.
SLACK = 1e-9
ROWS = 4096

_STORED = "vec_id long, v array<int>, lead array<double>, rest double"


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as int64; raises where the exact distances would leave 64 bits."""
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() >= COMPONENT_LIMIT:
        raise OverflowError(f"components must stay below {COMPONENT_LIMIT / scale} in size")
    return scaled.astype(np.int64)


class Rotation:
    """Leading principal axes about a centre, and the bound they give."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray):
        self.centre, self.axes = centre, axes

    @classmethod
    def fit(cls, n: int, sums: np.ndarray, products: np.ndarray, leading: int) -> Rotation:
        """From the number of vectors, their sum and the sum of their outer products."""
        centre = sums / max(n, 1)
        spread = products / max(n, 1) - np.outer(centre, centre)
        _, axes = np.linalg.eigh(spread)  # ascending
        return cls(centre, np.ascontiguousarray(axes[:, ::-1][:, :leading]))

    def apply(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the rest, a row each."""
        moved = v - self.centre
        lead = moved @ self.axes
        rest = np.einsum("ij,ij->i", moved, moved) - np.einsum("ij,ij->i", lead, lead)
        return lead, np.sqrt(np.maximum(rest, 0.0))


def lower_bounds(lead: np.ndarray, rest: np.ndarray, lead_c: np.ndarray, rest_c: np.ndarray) -> np.ndarray:
    """(rows, centroids): never above the squared distance, rounding included."""
    size, size_c = np.einsum("ij,ij->i", lead, lead), np.einsum("ij,ij->i", lead_c, lead_c)
    projected = size[:, None] + size_c[None, :] - 2.0 * (lead @ lead_c.T)
    room = SLACK * (1.0 + (size + rest**2)[:, None] + (size_c + rest_c**2)[None, :])
    return projected + (rest[:, None] - rest_c[None, :]) ** 2 - room


def _exact(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def nearest(v: np.ndarray, bounds: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of the nearest centroid (ties: the smaller number), and how many pairs were compared."""
    best = bounds.argmin(axis=1)
    distance = _exact(v, centroids[best])
    survives = bounds <= distance[:, None]
    survives[np.arange(len(v)), best] = False
    compared = len(v) + int(survives.sum())
    for c in range(len(centroids)):
        rows = np.flatnonzero(survives[:, c])
        if not len(rows):
            continue
        d = _exact(v[rows], centroids[c])
        better = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        distance[rows[better]], best[rows[better]] = d[better], c
    return best, distance, compared


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind).reshape(-1, width)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def _moments(kept: DataFrame, width: int, scale: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and outer products: width * (width + 1) + 1 numbers a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for part in _pieces(batches):
            v = whole_numbers(_matrix(part.column(0), width, np.float64), scale).astype(np.float64)
            total += np.concatenate(([len(v)], v.sum(axis=0), (v.T @ v).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    rows = kept.select("embedding").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(1 + width + width * width)
    for i, x in rows:
        total[i] = x
    return int(total[0]), total[1 : 1 + width], total[1 + width :].reshape(width, width)


def _stored(kept: DataFrame, rotation: Rotation, width: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            v = whole_numbers(_matrix(part.column(1), width, np.float64), scale)
            lead, rest = rotation.apply(v)
            columns = [part.column(0), _lists(v.astype(np.int32)), _lists(lead), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "lead", "rest"])

    return kept.mapInArrow(run, _STORED)


def _assigned(part: pa.RecordBatch, width: int, leading: int, rotation: Rotation, centroids: np.ndarray):
    v = _matrix(part.column("v"), width, np.int64)
    lead = _matrix(part.column("lead"), leading, np.float64)
    bounds = lower_bounds(lead, part.column("rest").to_numpy(), *rotation.apply(centroids))
    return v, *nearest(v, bounds, centroids)[:2]


def _sums(stored: DataFrame, rotation: Rotation, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> number of its vectors and their componentwise sum. A task gives a row for each cluster and component."""
    k, width = centroids.shape
    leading = rotation.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), np.int64)
        for part in _pieces(batches):
            v, cluster, _ = _assigned(part, width, leading, rotation, centroids)
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            sums[found, :width] += np.add.reduceat(v[order], starts, axis=0)
            sums[:, width] += np.bincount(cluster, minlength=k)
        full = np.flatnonzero(sums[:, width])
        where = np.repeat(full, width + 1), np.tile(np.arange(width + 1), len(full))
        yield pa.RecordBatch.from_arrays([*map(pa.array, where), pa.array(sums[full].ravel())], names=["cluster", "i", "x"])

    rows = stored.mapInArrow(run, "cluster long, i long, x long")
    # Decimals, as a sum over very many vectors may leave 64 bits.
    total: dict[int, list[int]] = {}
    for cluster, i, x in rows.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        total.setdefault(cluster, [0] * (width + 1))[i] = int(x)
    return {c: (x[width], x[:width]) for c, x in total.items()}


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
    width: int = DIMENSIONS, scale: int = SCALE, leading: int = LEADING, salt: str = SALT,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector, and the final centroids.

    Kept are vectors of exactly ``width`` components, none null or non-finite. The first centroids are the ``k`` kept vectors
    with the smallest sha256 of ``salt`` and the id (a null id comes last; rows of one id by their components); with fewer
    vectors there are fewer centroids. Ties go to the smaller number, an empty cluster keeps its centroid. Repeated rows
    count as often as they stand there. An empty table gives an empty table; other columns are ignored. Components of
    ``COMPONENT_LIMIT / scale`` or more in size raise, as a squared distance could leave 64 bits.
    To the driver come the moments and, each round, one row for each centroid and component.
    """
    x = F.col(embedding)
    sound = (F.size(x) == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    n, sums, products = _moments(kept, width, scale)
    leading = min(leading, width)
    rotation = Rotation.fit(n, sums, products, leading)
    stored = settle(_stored(kept, rotation, width, scale), "centroid-vectors")

    named = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = stored.select(named.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    if not len(centroids):
        empty = stored.select(
            "vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"),
            F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"),
        )
        return empty.where(F.lit(False)), centroids
    for _ in range(rounds):
        for c, (count, total) in _sums(stored, rotation, centroids).items():
            centroids[c] = [s // count for s in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            _, number, distance = _assigned(part, width, leading, rotation, centroids)
            columns = [part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    done = settle(stored.mapInArrow(assign, "vec_id long, cluster int, distance long"), "centroid-rows")
    inertia = dict(done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    whole = reduce(lambda a, b: a + b, inertia.values(), Decimal(0))
    facts = [(c, int(d), int(whole), centroid_digest(centroids[c])) for c, d in sorted(inertia.items())]
    facts = done.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
