"""Continuous ingest: new files of a folder become model tables, micro-batch by micro-batch; windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..sources import ingest


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts of events(ts, event_type, value) by tumbling window and type; late: the watermark of a stream."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.count("value").alias("valued"))


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Parses files as they arrive and saves their tables; a file's rows replace what an earlier attempt saved, so a repeated batch changes nothing."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)

    def save(batch: DataFrame, _: int) -> None:
        found = ingest.elements(batch.select("path", "length", "content")).persist()
        for name, rows in ingest.model(found).items():
            store.save(name, rows)
        found.unpersist()

    writer = files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
