"""SimHash near-duplicates, joined by deletion-variant signatures.

With two differing bits and two segments of 32 bits, one segment differs in one bit at most. A segment is therefore
indexed as it is and under its variants with one bit wiped out; segments that differ in one bit or none share a variant,
equal variants are joined, and the whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from catalogwatch.llm.graph import components
from catalogwatch.llm.store import settle

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# Shingles whose bits are counted at once: bounds a worker's memory for a text of any length.
BLOCK = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 values of all word shingles, as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= k:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        upto = min(n, at + BLOCK)
        cuts = zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist())
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in cuts], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long with the same bits. One row per input row."""
    pair = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pair.mapInArrow(_fingerprints, "doc_id long, fp long")


def _half(fp: Column, s: int) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if s else F.shiftrightunsigned(fp, 32)


def _variants(fp: Column, value: int) -> Column:
    """Keys of both halves: each half as it is, and with each bit wiped out that holds ``value``, else null.

    A key packs the half, the wiped bit (32: none) and the remaining bits into one long. As one side of the join wipes
    zeros and the other wipes ones, equal halves meet under one key only, not under all 32.
    """
    keys = []
    for s in (0, 1):
        half = _half(fp, s)
        keys.append(half.bitwiseOR(F.lit((s << 6 | 32) << 32)))
        for b in range(32):
            holds = half.bitwiseAND(F.lit(1 << b)) == F.lit(value << b)
            rest = half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b)))
            keys.append(F.when(holds, rest.bitwiseOR(F.lit((s << 6 | b) << 32))))
    return F.array(*keys)


def linked_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints(fp)``, all different -> pairs ``(u, v)``, each once, that differ in ``max_bits`` or fewer bits.

    Complete for ``max_bits`` up to 3: with two halves, one of them then differs in one bit at most.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find at most three differing bits")

    def side(name: str, value: int) -> DataFrame:
        keyed = prints.select(F.col("fp").alias(name), F.explode(_variants(F.col("fp"), value)).alias("key"))
        return keyed.where("key IS NOT NULL")

    differ = F.col("u").bitwiseXOR(F.col("v"))
    whole = F.shiftright("key", 32).bitwiseAND(F.lit(63)) == 32
    # A pair that the first half finds isn't taken from the second one again.
    once = (F.shiftright("key", 38) == 0) | (F.bit_count(_half(differ, 0)) >= 2)
    # A row gives dozens of keys, which the engine's size estimate doesn't count: left to it, the keys would be broadcast.
    met = side("u", 0).join(side("v", 1).hint("merge"), "key")
    return met.where((F.bit_count(differ) <= max_bits) & once & (~whole | (F.col("u") < F.col("v")))).select("u", "v")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id`` (the smallest doc_id reachable over links).

    Documents of one fingerprint are one node, so copies are never expanded into pairs. Null and empty texts have
    fingerprint zero and link like any other; repeated rows give repeated rows; a null doc_id keeps its row and is never
    the smallest. An empty table gives an empty table; other columns are ignored.
    """
    rows = settle(with_fingerprints(docs, doc_id, text), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(linked_fingerprints(nodes.select("fp")), "simhash")
    groups = joined.withColumnRenamed("node", "fp").join(nodes, "fp")
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    # Linked fingerprints only; the others are their own group, so the table that is joined stays small.
    found = groups.join(least, "component").select("fp", "component_id")
    alone = nodes.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(alone, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
