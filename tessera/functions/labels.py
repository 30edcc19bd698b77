"""Labels of documents: defaults, localised ones over them, and how many are still the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(defaults: DataFrame, loaded: DataFrame) -> DataFrame:
    """(key, text): the loaded(key, text) where it has a text, else the default; other keys that are loaded stay too."""
    mine = loaded.where(F.coalesce("text", F.lit("")) != "").select("key", F.col("text").alias("_own"))
    return defaults.select("key", "text").join(mine, "key", "full_outer").select("key", F.coalesce("_own", "text").alias("text"))


def untranslated(defaults: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row: untranslated (labels but the neutral ones that are still the default, or not loaded) and incomplete, whether
    these are most of them. defaults(key, text, neutral)."""
    mine = loaded.select("key", F.col("text").alias("_own"))
    rows = defaults.where(~F.col("neutral")).join(mine, "key", "left")
    still = F.count_if(F.coalesce("_own", "text") == F.col("text"))
    return rows.agg(still.alias("untranslated"), (2 * still > F.count("*")).alias("incomplete"))
