"""Source trees as tables: one row per file, found, filtered and read by Spark's binaryFile source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of source files by language.
LANGUAGES = {
    "c": ("c", "h"),
    "cpp": ("cpp", "hpp", "cc", "cxx", "hh"),
    "python": ("py",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "shell": ("sh", "bash"),
    "rust": ("rs",),
}
#: Directories that are never searched, beside those that begin with a dot.
SKIPPED = ("build", "builddir", "subprojects", "__pycache__", "node_modules", "venv", "env", "pip_package")


def language(path: Column) -> Column:
    """Language by the extension, any case; null for other files."""
    ext, out = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)), F.lit(None).cast("string")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def is_source(rel_path: Column) -> Column:
    """Whether a path below the root has a known extension and no skipped or hidden directory above it."""
    hidden = rel_path.rlike(r"(^|/)\.[^/]*/")
    skipped = rel_path.rlike(rf"(^|/)({'|'.join(SKIPPED)})/")
    return language(rel_path).isNotNull() & ~hidden & ~skipped


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """The binaryFile rows of every source file below root, with ``rel_path``; contents are read only if they are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.split("://", 1)[-1].rstrip("/") + "/")
    # The source reports absolute URIs: what follows the root in them is the relative path.
    rel = F.substring(F.col("path"), F.instr(F.col("path"), base) + F.length(base), F.length("path"))
    return files.withColumn("rel_path", F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B")))).where(is_source(F.col("rel_path")))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, language, content, file_hash) of every source file below root, invalid UTF-8 replaced.

    The filter on the path is applied before contents are decoded; file_hash is the SHA-256 of the bytes. No order is
    implied; sort by rel_path for reports. Spark passes over files of zero bytes, which have no symbols.
    """
    files = source_files(spark, root)
    return files.select("rel_path", language(F.col("rel_path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("file_hash"))


def read_docs(spark: SparkSession, root: str) -> DataFrame:
    """(file_name, path, text) of the markdown documents below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("wholetext", "true").text(root)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
