"""Sinks: snapshot tables that change only where they differ, lists, and documents as files."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.incremental import snapshot_diff


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Warehouse:
    """Tables of an index as Parquet below a folder, one folder a version. A manifest names the version of every table, and
    the last manifest is what readers see.

    All tables of a commit are written whole before its manifest, which appears in one step and never takes another's
    place. So readers see all of a commit or nothing, and what dies before leaves at most folders that nothing names.
    """

    #: Commits whose versions stay, for readers that have begun.
    KEPT = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> list[int]:
        path, fs = _path(self.spark, f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[: -len(".json")]) for n in names if re.fullmatch(r"\d+\.json", n))

    def _manifest(self, n: int | None = None) -> dict[str, str]:
        """The folder of each table at the last commit, or at commit n."""
        n = n or (self._manifests() or [0])[-1]
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.root}/manifests/{n:09d}.json").first()[0]) if n else {}

    def _version(self, table: str) -> int:
        folder = self._manifest().get(table)
        return int(re.match(r"v(\d+)", folder)[1]) if folder else 0

    def exists(self, table: str) -> bool:
        return table in self._manifest()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/{self._manifest()[table]}")

    def commit(self, tables: dict[str, tuple[DataFrame, str]]) -> set[str]:
        """The tables(rows, key) that differ from what is stored, which become visible at once. Raises FileExistsError, with
        nothing changed, if another commit came between."""
        last = (self._manifests() or [0])[-1]
        before = self._manifest(last)
        changed = {t for t, (rows, key) in tables.items() if not self._same(before.get(t), t, rows, key)}
        if not changed:
            return changed
        next_ = lambda t: f"v{int(re.match(r'v(\d+)', before.get(t, 'v0'))[1]) + 1}-{uuid.uuid4().hex[:12]}"
        after = before | {t: next_(t) for t in changed}  # two writers never share a folder
        for t in sorted(changed):
            tables[t][0].write.parquet(f"{self.root}/{t}/{after[t]}")
        if not create_text(self.spark, f"{self.root}/manifests/{last + 1:09d}.json", json.dumps(after, sort_keys=True)):
            for t in changed:
                self._delete(f"{self.root}/{t}/{after[t]}")
            raise FileExistsError(f"commit {last + 1} is another writer's")
        self._clean()
        return changed

    def _same(self, folder: str | None, table: str, rows: DataFrame, key: str) -> bool:
        if folder is None:
            return False
        old, columns = self.spark.read.parquet(f"{self.root}/{table}/{folder}"), sorted(rows.columns)
        digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("_sha"))
        return sorted(old.columns) == columns and snapshot_diff(digest(old), digest(rows), key, "_sha").isEmpty()

    def _delete(self, path: str) -> None:
        p, fs = _path(self.spark, path)
        fs.delete(p, True)

    def _clean(self) -> None:
        """Manifests before the last KEPT go, with the versions that only they name."""
        all_ = self._manifests()
        named = lambda ns: {f"{self.root}/{t}/{v}" for n in ns for t, v in self._manifest(n).items()}
        for path in named(all_[: -self.KEPT]) - named(all_[-self.KEPT :]):
            self._delete(path)
        for n in all_[: -self.KEPT]:
            self._delete(f"{self.root}/manifests/{n:09d}.json")

    def write_if_different(self, table: str, rows: DataFrame, key: str) -> bool:
        """Whether the table changed: a commit of this table alone."""
        return bool(self.commit({table: (rows, key)}))

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds measurements; earlier rows are never rewritten."""
        rows.write.mode("append").parquet(f"{self.root}/{table}/log")

    def read_log(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/log")


def _written(spark: SparkSession, path: str, text: str) -> str:
    """A file beside ``path`` with the text, complete."""
    beside = f"{path}.{uuid.uuid4().hex[:12]}.part"
    part, fs = _path(spark, beside)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.hsync() if hasattr(out, "hsync") else out.flush()
    out.close()
    return beside


def _rename(spark: SparkSession, part: str, path: str, *options: str) -> None:
    """In one step; FileContext leaves no moment without the file."""
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, len(options))
    for i, o in enumerate(options):
        how[i] = getattr(kind, o)
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(part)
    where = _path(spark, path)[1].makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, part)[1].makeQualified(source), where, how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and moved there over the one before."""
    _rename(spark, _written(spark, path, text), path, "OVERWRITE")


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file could be created; one that is there stays as it is."""
    part = _written(spark, path, text)
    try:
        _rename(spark, part, path)
    except Py4JJavaError as e:
        p, fs = _path(spark, part)
        fs.delete(p, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def write_file_list(files: DataFrame, folder: str) -> None:
    """The paths, in order, as text; the list is short beside the files, so one part keeps its order plain."""
    files.select(F.col("file")).orderBy("file").coalesce(1).write.mode("overwrite").text(folder)


def write_labels(spark: SparkSession, path: str, labels: dict[str, str], language: str, incomplete: bool = False) -> None:
    """Labels as JSON with their language, and a mark if most are not translated."""
    write_text(spark, path, json.dumps({"language": language} | labels | ({"_translation_incomplete": True} if incomplete else {}), ensure_ascii=False, indent=2))


def read_labels(spark: SparkSession, path: str, language: str) -> dict[str, str]:
    """The labels of a file in this language; none if it is missing, broken or of another."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return {}
    try:
        found = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect()))
    except ValueError:
        return {}
    return {k: v for k, v in found.items() if k != "_translation_incomplete"} if isinstance(found, dict) and found.get("language") == language else {}


def write_documents(docs: DataFrame, folder: str) -> DataFrame:
    """(file, written): docs(file, text) as files below a folder on any mounted file system, by the executors; a file that has
    the same text already is not touched. Each is written beside its place and moved there, so a task may run twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for batch in batches:
            done = []
            for name, text in zip(batch.file, batch.text, strict=True):
                path = os.path.join(folder, name)
                data = text.encode("utf-8", "surrogatepass")
                try:
                    with open(path, "rb") as f:
                        same = f.read() == data
                except FileNotFoundError:
                    same = False
                if not same:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    part = f"{path}.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(data)
                        f.flush()
                        os.fsync(f.fileno())
                    os.replace(part, path)
                done.append((name, not same))
            yield pd.DataFrame(done, columns=["file", "written"])

    return docs.select("file", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "file string, written boolean")
