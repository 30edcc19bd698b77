"""Cost fits and timing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the cost model.
NO_SAMPLES, NO_DATA, RIDGE, PIVOT, FLOOR = [0.8, 0.02, 0.0, 0.0], [0.8, 0.03, 0.0, 0.0], 1e-5, 1e-12, 0.05


def power_sums(x: Column, y: Column, degree: int = 3) -> list[Column]:
    """Sums of x^p (p to twice the degree) and y x^p (p to the degree), x at least 1 and y at least 0.01: one aggregation, partial first."""
    x, y = F.greatest(x.cast("double"), F.lit(1.0)), F.greatest(y.cast("double"), F.lit(0.01))
    return [F.sum(F.pow(x, p)).alias(f"sx{p}") for p in range(2 * degree + 1)] + [F.sum(y * F.pow(x, p)).alias(f"sy{p}") for p in range(degree + 1)]


def solved(sums: DataFrame, degree: int = 3) -> DataFrame:
    """sums(sx0.., sy0..) plus ``coeffs``, lowest first: the least squares with a ridge, solved in every row.

    The rows of the system are an array, and a fold over its unknowns clears each one's column in the other rows. The
    matrix is symmetric and positive, so the diagonal serves; an unknown whose diagonal entry vanishes is 0.
    """
    n = range(degree + 1)
    row = lambda i: F.array(*[F.col(f"sx{i + j}") + (RIDGE if i == j else 0.0) for j in n], F.col(f"sy{i}"))
    gone = lambda m, k: F.abs(m[k][k]) < PIVOT
    clear = lambda m, k: F.transform(m, lambda r, i: F.when((i == k) | gone(m, k), r).otherwise(F.zip_with(r, m[k], lambda x, y: x - r[k] / m[k][k] * y)))
    m = F.aggregate(F.array(*map(F.lit, n)), F.array(*map(row, n)), clear)
    return sums.withColumn("coeffs", F.transform(m, lambda r, i: F.when(F.abs(r[i]) < PIVOT, 0.0).otherwise(r[degree + 1] / r[i])))


def fits(samples: DataFrame, x: str, y: str, by: tuple[str, ...] = (), degree: int = 3) -> DataFrame:
    """(by..., n, coeffs): a polynomial for each group of samples; of a single sample its value, at least 0.1. Without samples
    there is no row, but the fixed coefficients where there are no groups either. No sum reaches the driver."""
    sums = samples.groupBy(*by).agg(F.count("*").alias("n"), F.max(y).cast("double").alias("one"), *power_sums(F.col(x), F.col(y), degree))
    lone = F.array(F.greatest(F.lit(0.1), F.col("one")), *[F.lit(0.0)] * degree)
    none = F.array(*map(F.lit, NO_SAMPLES[: degree + 1]))
    return solved(sums, degree).select(*by, "n", F.when(F.col("n") == 0, none).when(F.col("n") == 1, lone).otherwise(F.col("coeffs")).alias("coeffs"))


def category_fits(log: DataFrame, key: str, category: str, x: str, y: str, order: list, last: int = 100, degree: int = 3) -> DataFrame:
    """(key, category, n, coeffs) from the ``last`` measurements of each, by ``order``: what predictions read."""
    w = Window.partitionBy(key, category).orderBy(*order)
    recent = log.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= last)
    return fits(recent.select(F.col(key).alias("key"), F.col(category).alias("category"), x, y), x, y, ("key", "category"), degree)


def cold_flags(events: DataFrame, key: str, ts: str, tie: str, idle_s: int = 60) -> DataFrame:
    """events plus ``is_cold``: the first of its key, or more than idle_s after the one before."""
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(Window.partitionBy(key).orderBy(ts, tie)))
    return events.withColumn("is_cold", gap.isNull() | (gap > idle_s * 1_000_000))


def cold_starts(events: DataFrame, key: str, order: list[str], seconds: str, old: str = "0.7", digits: int = 2) -> DataFrame:
    """(key, cold, most_cold) of the cold events(is_cold): old * before + (1 - old) * now, in order, rounded at every step
    to the even neighbour in decimals, and the longest. One number a cold start is kept in order; there are few, as each
    follows an idle time."""
    kind = f"decimal(20,{digits})"
    value = F.bround(F.greatest(F.col(seconds).cast("double"), F.lit(0.01)), digits)
    rows = events.where("is_cold").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, value.cast(kind).alias("v")))).alias("xs"), F.max(value).alias("most_cold"))
    weight = F.lit(old).cast("decimal(5,4)")
    step = lambda s, x: F.when(s.isNull(), x["v"]).otherwise(F.bround(weight * s + (1 - weight) * x["v"], digits).cast(kind))
    return rows.select(key, F.aggregate("xs", F.lit(None).cast(kind), step).cast("double").alias("cold"), "most_cold")


def last_n(events: DataFrame, key: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
