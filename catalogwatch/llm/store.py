"""The shared folder: tables that cut lineage, and binary files that workers write and map."""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogwatch.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name below the cluster's checkpoint folder, as a URI that driver and executors can all open."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base}/llm/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and it outlives lost executors."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The path of a mounted file, or None where the folder is in a store that has to be read by stream."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _file_system(uri: str):
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Writes beside the target and renames, so that a repeated or killed task never leaves a half file."""
    store, path = _file_system(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def map_array(uri: str, kind: str) -> np.ndarray:
    """A file of one number kind as an array: memory-mapped where the folder is mounted, else read."""
    path = local_path(uri)
    if path:
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, kind)
    store, path = _file_system(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def hash_sample(rows: DataFrame, key: str, about: int) -> DataFrame:
    """About ``about`` rows, chosen by a hash of ``key``: a fixed choice without a sort, a cap per task or a gathering.

    The bound is ``about`` in expectation; copies of one key go in or out together.
    """
    total = rows.count()
    if total <= about:
        return rows
    cut = int(2**63 * (2 * about / total - 1))
    return rows.where(F.xxhash64(F.col(key), F.lit("sample")) < F.lit(cut))


def kept_in_worker(key: tuple, make: Callable, family: str | None = None):
    """``make()`` once per key and Python process; of each kind (the key's first part) only the last one is kept.

    A worker serves many stages of an application, so only one family of kinds is held at a time: what an earlier
    operator has left is freed when the next one begins. ``family`` is the kind unless it is named.

    Functions travel to the workers with their globals, so a module's own globals start anew with each task; this state
    stands in the process and outlives tasks where workers are reused. It holds nothing that can't be made again.
    """
    state = sys.modules.setdefault("catalogwatch_worker_state", types.ModuleType("catalogwatch_worker_state")).__dict__
    family = family or key[0]
    if state.get("family") != family:
        state["family"], state["made"] = family, {}
    made = state["made"]
    if key[0] not in made or made[key[0]][0] != key:
        made.pop(key[0], None)  # freed before the next one is made
        value = make()
        made[key[0]] = (key, value)
    return made[key[0]][1]


def forget_newest(known: dict, most: int) -> None:
    """Halves a full store. The oldest entries stay: a frequent key is met early, a rare one at any time."""
    for _ in range(len(known) - most // 2):
        known.popitem()
