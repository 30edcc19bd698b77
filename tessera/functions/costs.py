"""Cost model: work, predicted durations and lengths, timeouts, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.reduce import FLOOR, NO_DATA

#: Characters by kind family: (kinds, base, a line, a unit of complexity); the last is for all others.
CHARS = (
    (("function", "async_function", "method", "constructor", "destructor", "fn"), 400, 5, 15),
    (("type", "struct", "class", "data_models", "interface"), 550, 7, 20),
    (("var", "variable", "field", "const", "enum_constant", "property"), 320, 3, 10),
    (("module_doc", "modules"), 850, 8, 25),
    (("overview",), 1200, 12, 35),
    (("readme",), 1600, 15, 40),
    (("execution_model",), 1100, 10, 30),
)
OTHER_CHARS, LEAST_CHARS = (450, 6, 18), 150
#: Default timeout, slack after a cold start, factor on the estimate, characters added to a request.
TIMEOUT, COLD_SLACK, RATE_FACTOR, MORE_CHARS = 120, 60.0, 2.5, 500
#: Seconds that a clean, a static and an unknown symbol take.
CLEAN_S, STATIC_S = 0.0, 0.001


def work(lines: Column, complexity: Column) -> Column:
    """Lines times the square root of the complexity, both at least 1."""
    return F.greatest(F.lit(1.0), lines.cast("double")) * F.sqrt(F.greatest(F.lit(1.0), complexity.cast("double")))


def polynomial(coeffs: Column, x: Column) -> Column:
    """Value of an array of coefficients, lowest first, at x of at least 1; at least FLOOR."""
    x = F.greatest(x.cast("double"), F.lit(1.0))
    terms = F.transform(coeffs, lambda c, i: c * F.pow(x, i))
    return F.greatest(F.lit(FLOOR), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))


def predict_durations(wanted: DataFrame, fits: DataFrame) -> DataFrame:
    """wanted(key, category, lines, complexity) plus ``seconds``: by the coefficients of its category, else of the first
    category of the key that has any, else by fixed ones. fits(key, category, coeffs)."""
    known = fits.where(F.size("coeffs") > 0)
    own = known.select(F.col("key").alias("_key"), F.col("category").alias("_category"), F.col("coeffs").alias("_own"))
    first = known.groupBy(F.col("key").alias("_any_key")).agg(F.min_by("coeffs", "category").alias("_any"))
    out = wanted.join(own, (F.col("key") == F.col("_key")) & (F.col("category") == F.col("_category")), "left")
    out = out.join(first, F.col("key") == F.col("_any_key"), "left")
    coeffs = F.coalesce("_own", "_any", F.array(*map(F.lit, NO_DATA)))
    return out.select(*wanted.columns, polynomial(coeffs, work(F.col("lines"), F.col("complexity"))).alias("seconds"))


def predict_chars(kind: Column, lines: Column, complexity: Column, coeffs: Column | None = None) -> Column:
    """Characters that a description of this kind takes, at least LEAST_CHARS; by the fit where there is one."""
    n, c = F.greatest(F.lit(1), lines), F.greatest(F.lit(1.0), complexity.cast("double"))
    grown = lambda base, a, b: F.lit(base) + F.bround(a * n + b * c, 0)
    k = F.lower(F.btrim(F.coalesce(kind, F.lit("general"))))
    guess = grown(*OTHER_CHARS)
    for kinds, base, a, b in reversed(CHARS):
        guess = F.when(k.isin(*kinds), grown(base, a, b)).otherwise(guess)
    if coeffs is not None:
        guess = F.when(F.coalesce(F.size(coeffs), F.lit(0)) > 0, F.bround(polynomial(coeffs, work(lines, complexity)), 0)).otherwise(guess)
    return F.greatest(F.lit(LEAST_CHARS), guess).cast("long")


def estimate(dirty: Column, static: Column, predicted: Column) -> Column:
    """Seconds a symbol still takes."""
    return F.when(~dirty, CLEAN_S).when(static, STATIC_S).otherwise(predicted)


def totals(symbols: DataFrame, workers: int = 1, *by: str) -> DataFrame:
    """symbols, cached, to_generate and eta (seconds over the workers, one at least) of symbols(dirty, seconds)."""
    n = F.count("*")
    return symbols.groupBy(*by).agg(
        n.alias("symbols"), F.count_if(~F.col("dirty")).alias("cached"), F.count_if("dirty").alias("to_generate"),
        (F.sum("seconds") / max(1, workers)).alias("eta"),
    )


def server_rates(requests: DataFrame, key: str, digits: int | None = 2) -> DataFrame:
    """(key, rate): characters a second, in and out, of the warm requests(in_chars, out_chars, seconds, is_cold), to two
    digits or as it is; null without any time. Sizes are at least 1 and 0, times at least 0.01 and to two digits, and added up
    as decimals, so that whole rates do not depend on the order of rows; as doubles only where a time is no such number."""
    warm = requests.where(~F.col("is_cold"))
    chars = F.greatest(F.col("in_chars"), F.lit(1)) + F.greatest(F.col("out_chars"), F.lit(0))
    seconds = F.bround(F.greatest(F.col("seconds").cast("double"), F.lit(0.01)), 2)
    exact = seconds.try_cast("decimal(18,2)")
    time = F.when(F.count(exact) == F.count(seconds), F.sum(exact).cast("double")).otherwise(F.sum(seconds))
    total = warm.groupBy(key).agg(F.sum(chars).alias("_chars"), time.alias("_seconds"))
    rate = F.try_divide(F.col("_chars").cast("double"), F.col("_seconds"))
    return total.select(key, (rate if digits is None else F.bround(rate, digits)).alias("rate"))


def adaptive_timeout(in_chars: Column, first: Column, cold: Column, rate: Column, default: int = TIMEOUT) -> Column:
    """Seconds: the default, more for the first request after a known cold start, more for a slow server."""
    cold_wait = F.when(first & (cold > 0), cold + COLD_SLACK)
    needed = F.when(rate > 0, F.try_divide((in_chars + MORE_CHARS).cast("double"), rate) * RATE_FACTOR)
    return F.bround(F.greatest(F.lit(float(default)), cold_wait, needed), 0).cast("long")


def retry(attempt: Column, seed: int, temperature: float) -> tuple[Column, Column, Column]:
    """(seed, temperature, seconds to wait) of an attempt, counted from 1."""
    return F.lit(seed) + 17 * (attempt - 1), F.least(F.lit(0.7), F.lit(temperature) + 0.1 * (attempt - 1)), attempt
