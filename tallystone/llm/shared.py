"""The shared folder: where lineage is cut and models are left for the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset and the master is local (tests), a local one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallystone-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends in files that outlive executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str):
    """Column names that df doesn't have, in any case of letters: one, or a tuple of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else tuple(out)


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def write_blob(path: str, data: bytes) -> None:
    """Whole or not at all, so that a task may run twice."""
    if (here := _local(path)) is not None:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        part = f"{here}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, here)
        return
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(part := f"{name}.{uuid.uuid4().hex}") as f:
        f.write(data)
    fs.move(part, name)


def map_blob(path: str) -> np.ndarray:
    """Bytes of a blob: memory-mapped where the shared folder is mounted, else read."""
    if (here := _local(path)) is not None:
        return np.asarray(np.memmap(here, np.uint8, "r")) if os.path.getsize(here) else np.empty(0, np.uint8)
    return _fetched(path)


@lru_cache(16)
def _fetched(path: str) -> np.ndarray:
    """A blob of a folder that isn't mounted; a task that asks for it again has it still."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as f:
        return np.frombuffer(f.read(), np.uint8)


def sorted_lists(values: DataFrame, name: str) -> list[tuple[int, int, str]]:
    """A column of distinct longs as sorted files in the shared folder, one for each range: (smallest, largest, path).

    Executors map the files and look up by binary search, so nothing of their size goes through the driver.
    """
    import pyarrow as pa

    path = new_path(values.sparkSession, name)

    def save(batches):
        got = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if got:
            v = np.sort(np.concatenate(got))
            to = f"{path}/{v[0]}.i64"
            write_blob(to, v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v[0]]), pa.array([v[-1]]), pa.array([to])], ["lo", "hi", "path"])

    column = values.columns[0]
    parts = values.repartitionByRange(column).mapInArrow(save, "lo long, hi long, path string")
    return sorted((r.lo, r.hi, r.path) for r in parts.collect())


def in_lists(lists: list[tuple[int, int, str]], values: np.ndarray) -> np.ndarray:
    """Which of the sorted values are in the lists."""
    out = np.zeros(len(values), bool)
    for lo, hi, path in lists:
        i, j = np.searchsorted(values, lo), np.searchsorted(values, hi, "right")
        if i < j:
            v = map_blob(path).view(np.int64)
            at = np.searchsorted(v, values[i:j])
            out[i:j] = v[np.minimum(at, len(v) - 1)] == values[i:j]
    return out
