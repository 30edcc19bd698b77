"""Change streams: events of a key that follow within a gap are one trigger; the same code for batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n): runs of events less than ``gap`` apart. A stream needs ``late``, its watermark."""
    rows = events.select(key, F.col(ts).cast("timestamp").alias("_ts"))
    if late:
        rows = rows.withWatermark("_ts", late)
    out = rows.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def watch_folder(spark: SparkSession, folder: str, schema, action: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "json"):
    """Runs ``action`` once per batch of new files; files that come meanwhile wait for the next one."""
    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Watchers:
    """One streaming query a folder; watching a folder again gives its running query."""

    def __init__(self):
        self.running: dict[str, object] = {}

    def watch(self, spark: SparkSession, folder: str, schema, action: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "json"):
        known = self.running.get(folder)
        if known is None or not known.isActive:
            known = self.running[folder] = watch_folder(spark, folder, schema, action, checkpoint, fmt)
        return known

    def stop(self, folder: str) -> None:
        query = self.running.pop(folder, None)
        if query is not None:
            query.stop()
