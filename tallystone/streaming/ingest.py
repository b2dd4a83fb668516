"""Ingestion as a stream of session files. The checkpoint only says which files to look at again: cursors and idempotency
still come from the log, so the checkpoint may be deleted at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallystone.config import Config
from tallystone.operators import ingest


def start(spark: SparkSession, cfg: Config, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ingestion for each batch of new files; with once, stops when all files are seen."""

    def batch(files: DataFrame, _: int) -> None:
        if not files.isEmpty():
            ingest.run(files.sparkSession, cfg, backfill=True)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").load(str(cfg.sessions))
    writer = files.select("path", "modificationTime").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="15 minutes").start()
