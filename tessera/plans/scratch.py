"""Intermediate tables in the cluster's shared checkpoint folder: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and Spark runs in one process a local folder takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Parquet tables of one job under ``<checkpoint dir>/tessera-<id>``.

    ``save`` writes and rereads, ``drop`` deletes what later steps do not read. What remains (the result may read it)
    goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: set[str] = set()
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        self._paths.add(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def sweep(self) -> None:
        """Lets the driver collect garbage, upon which Spark deletes the shuffle files of steps whose tables are saved.

        The plan of the last step is free only when the listeners have seen its end, shortly after its table is written.
        """
        gc.collect()
        time.sleep(0.3)
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)
            self._paths.discard(t._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables but these, which a result still reads, and lets shuffle files go."""
        for path in self._paths - {t._scratch_path for t in tables}:
            self._delete(path)
        self._paths = {t._scratch_path for t in tables}
        self.sweep()

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; a leftover folder is harmless
            pass
