"""Semi-join of wide rows with few wanted keys: a bitmap of bounded size spares most rows the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the broadcast bitmap: at most 2**25 / 8 bytes = 4 MB, however many keys are wanted.
BITS = 2**25
_PART = 32_768  # bits of one bitmap_construct_agg


def possible(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose key is in wanted(key), and a share of the others (1 - exp(-wanted / BITS)); null keys go.

    One bit per wanted key, hashed to BITS, is broadcast. With very many wanted keys all rows pass.
    """
    return split(rows, wanted, key)[0]


def split(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What ``possible`` lets through, and the rows that surely are not in wanted; null keys are in neither."""
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))
    bits = wanted.where(F.col(key).isNotNull()).select(at.alias("_at")).groupBy((F.col("_at") / _PART).cast("int").alias("_part"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("_at") % _PART).alias("_bits"))
    placed = rows.where(F.col(key).isNotNull()).withColumn("__hash", at)
    placed = placed.withColumns({"__at": F.col("__hash") % _PART, "__part": (F.col("__hash") / _PART).cast("int")})
    byte = F.conv(F.hex(F.substring("_bits", (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(__byte, cast(__at % 8 as int)) & 1") == 1, F.lit(False))
    met = lambda how: placed.join(F.broadcast(bits), placed["__part"] == bits["_part"], how).withColumn("__byte", byte)
    return met("inner").where(hit).select(*rows.columns), met("left").where(~hit).select(*rows.columns)


def semi_join(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose key is in wanted(key), all columns kept; null keys go. The rows that the bitmap lets through are joined exactly."""
    return possible(rows, wanted, key).join(wanted, key, "left_semi")
