"""A source tree as a stream: listings at intervals, what differs from the last one, and an action after a quiet time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.incremental import snapshot_diff
from tessera.plans.scratch import Scratch
from tessera.sources.files import source_files


def listing(spark: SparkSession, tree: str) -> DataFrame:
    """(path, stamp) of the source files below a folder; no content is read."""
    stamp = F.concat_ws(" ", F.col("length").cast("string"), F.col("modificationTime").cast("double").cast("string"))
    return source_files(spark, tree).select(F.col("rel_path").alias("path"), stamp.alias("stamp"))


class TreeWatch:
    """Runs ``action`` (a sync) when a tree has changed and then been quiet for ``quiet`` seconds after the *last* change.

    A clock stream ticks every ``every`` seconds and each tick compares a listing with the one before, a table of the scratch
    folder. What changes while the action runs differs from the listing taken before it, so it is seen afterwards and
    leads to another run. A failing action stops the query with its error.
    """

    def __init__(self, spark: SparkSession, tree: str, action: Callable[[], object], quiet: float = 2.0, every: float = 0.5, now: Callable[[], float] = time.time):
        self.spark, self.tree, self.action, self.quiet, self.every, self.now = spark, tree, action, quiet, every, now
        self.scratch = Scratch(spark)
        self.known: DataFrame | None = None
        self.changed_at: float | None = None
        self.changes: list[dict[str, int]] = []
        self.runs = 0

    def tick(self) -> bool:
        """One look at the tree; whether the action ran."""
        seen = self.scratch.save(listing(self.spark, self.tree), "tree")
        before, self.known = self.known, seen
        if before is None:
            self.changed_at = self.now() - self.quiet  # the first look finds everything new, and nothing has to settle
        else:
            kinds = {r["change"]: r["count"] for r in snapshot_diff(before, seen, "path", "stamp").groupBy("change").count().collect()}
            self.scratch.drop(before)
            if kinds:
                self.changes.append(kinds)
                self.changed_at = self.now()
        if self.changed_at is None or self.now() - self.changed_at < self.quiet:
            return False
        self.changed_at = None
        self.action()
        self.runs += 1
        return True

    def start(self, checkpoint: str):
        """The streaming query that ticks until it is stopped."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        tick = clock.writeStream.foreachBatch(lambda df, i: self.tick() and None).option("checkpointLocation", checkpoint)
        return tick.trigger(processingTime=f"{max(1, round(self.every * 1000))} milliseconds").start()
