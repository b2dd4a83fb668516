"""The event log: monthly files of JSON lines, the only source of truth.

Order is (file, line). Spark has no line numbers, but the start of a file's block and an id that rises within the scan's
partitions give the same order.
"""

from __future__ import annotations

import json
import os
import secrets
import shutil
import time
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

try:
    import fcntl
except ImportError:  # pragma: no cover - not POSIX
    fcntl = None

ENVELOPE = ("type", "at", "writer")
#: All fields that some event has; what an event lacks is null.
SCHEMA = """
id string, type string, at string, writer string, episode_id string,
source struct<kind:string,session_id:string,path:string,turn_range:array<int>>,
name string, entity_type string, aliases array<string>, context string, source_episode_id string, episode_count int,
note string, sources array<string>, confusable_with array<string>, confirm_rule string, proposal_id string, entity_id string,
alias string, kind string, reason string, collides_with string, key string, text string, date_hint string, source_file string,
decision string, mtime double
"""


class InvalidEvent(ValueError):
    """An event without a type, time or writer."""


def now_iso() -> str:
    now = datetime.now().replace(microsecond=0)
    return now.astimezone().isoformat()


def new_id(prefix: str) -> str:
    return f"{prefix}_{time.time_ns() // 1_000_000}_{secrets.token_hex(4)}"


def check(event: dict) -> None:
    for k in ENVELOPE:
        if not isinstance(event.get(k), str) or not event[k]:
            raise InvalidEvent(f"{k!r} must be a string that isn't empty: {event!r}")


@contextmanager
def _locked(handle, path: Path):
    if fcntl:
        fcntl.flock(handle, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(handle, fcntl.LOCK_UN)
        return
    own = path.with_name(path.name + ".lock")
    until = time.monotonic() + 30
    while True:
        try:
            os.close(os.open(own, os.O_CREAT | os.O_EXCL))
            break
        except FileExistsError:
            if time.monotonic() > until:
                raise TimeoutError(f"locked by another process: {own}") from None
            time.sleep(0.05)
    try:
        yield
    finally:
        own.unlink(missing_ok=True)


def append(folder: Path, *events: dict) -> list[str]:
    """Writes events (all of them or, if one is invalid, none) and returns their ids; the dicts aren't changed."""
    for e in events:
        check(e)
    by: dict[str, list[dict]] = {}
    ids = []
    for e in events:
        e = {**e, "id": e.get("id") or new_id("ev")}
        ids.append(e["id"])
        month = datetime.fromisoformat(e["at"].replace("Z", "+00:00")).strftime("%Y-%m")
        by.setdefault(month, []).append(e)
    Path(folder).mkdir(parents=True, exist_ok=True)
    for month, some in by.items():
        path = Path(folder) / f"{month}.jsonl"
        with path.open("ab") as f, _locked(f, path):
            f.write("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in some).encode())
            f.flush()
            os.fsync(f.fileno())
    return ids


def emit(folder: Path, type: str, writer: str, **rest) -> str:
    """One event, now unless `at` is among the rest."""
    (id,) = append(folder, {"at": now_iso(), **rest, "writer": writer, "type": type})
    return id


def append_frame(rows: DataFrame, folder: str | Path) -> int:
    """Many events at once: checked, given ids, written by the executors, then named as files of their months, which `read` lists after the months' own.

    Returns the number of files. None is seen by a reader before all are checked and written.
    """
    folder = Path(folder)
    bad = " or ".join(f"coalesce({k}, '') = ''" for k in ENVELOPE)
    id = F.expr("coalesce(id, concat('ev_', uuid()))") if "id" in rows.columns else F.expr("concat('ev_', uuid())")
    checked = rows.withColumn("type", F.when(F.expr(bad), F.raise_error(F.lit("an event lacks its type, time or writer"))).otherwise(F.col("type"))).withColumn("id", id)
    stamp = f"{time.time_ns()}-{secrets.token_hex(4)}"
    part = folder / f".bulk-{stamp}"
    checked.withColumn("month", F.substring("at", 1, 7)).write.partitionBy("month").json(f"file://{part.absolute()}")
    files = sorted(part.glob("month=*/part-*"))
    for i, f in enumerate(files):
        os.replace(f, folder / f"{f.parent.name[6:]}.part-{stamp}-{i:06}.jsonl")
    shutil.rmtree(part)
    return len(files)


def read(spark: SparkSession, folder: str | Path, types: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Columns of SCHEMA with file, block, row: their order is the log's. Blank, corrupt and non-object lines are left out.

    since: files of more than a month before are not read (an event's month is in its own offset), the rest is compared
    as instants; events whose time can't be read are dropped then.
    """
    if not Path(folder).exists() or not any(Path(folder).glob("*.jsonl")):
        return spark.createDataFrame([], f"{SCHEMA}, file string, block long, row long")
    files = sorted(Path(folder).glob("*.jsonl"))
    if since:
        y, m = int(since[:4]), int(since[5:7])
        least = f"{y - (m == 1):04d}-{(m - 2) % 12 + 1:02d}"
        files = [f for f in files if f.stem[:7] >= least]
        if not files:
            return spark.createDataFrame([], f"{SCHEMA}, file string, block long, row long")
    lines = spark.read.text([str(f) for f in files]).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = lines.where(F.trim("value").startswith("{") & F.expr("try_parse_json(value)").isNotNull())
    rows = rows.withColumn("e", F.from_json("value", SCHEMA)).select("e.*", "file", "block", "row")
    if types is not None:
        rows = rows.where(F.col("type").isin(types) if types else F.lit(False))
    if since:
        rows = rows.where(F.expr("try_to_timestamp(at)") >= F.expr(f"try_to_timestamp('{since}')"))
    return rows


def with_position(rows: DataFrame) -> DataFrame:
    """`pos`, which sorts in log order: where the line stands. It takes no shuffle."""
    return rows.withColumn("pos", F.struct("file", "block", "row"))
