"""Synthetic request tables: uniform and skewed; their distribution profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names and shares of the skewed generator.
STATUS, STATUS_SHARES = ("OK", "ERROR", "WARN"), (0.80, 0.15, 0.05)
REGION, REGION_SHARES = ("NYC", "SF", "LA", "CHI"), (0.40, 0.30, 0.20, 0.10)
BUSINESS = 0.67


def _pick(names: tuple, shares: tuple, seed: int) -> Column:
    u, out, upto = F.rand(seed), F.lit(names[-1]), sum(shares[:-1])
    for name, share in reversed(list(zip(names[:-1], shares[:-1], strict=True))):
        out = F.when(u < upto, name).otherwise(out)
        upto -= share
    return out


def requests(spark: SparkSession, n: int, seed: int = 42, skewed: bool = False) -> DataFrame:
    """status, region, hour, timestamp, request_id: made on the executors, the same for a seed and partition count."""
    even = lambda names: tuple(1 / len(names) for _ in names)
    ids = spark.range(n)
    hour = F.floor(F.rand(seed + 2) * 24)
    if skewed:
        hour = F.when(F.rand(seed + 3) < BUSINESS, 9 + F.floor(F.rand(seed + 4) * 9)).otherwise(hour)
    out = ids.select("id", _pick(STATUS, STATUS_SHARES if skewed else even(STATUS), seed).alias("status"), _pick(REGION, REGION_SHARES if skewed else even(REGION), seed + 1).alias("region"), hour.cast("int").alias("hour"))
    stamp = F.concat(F.lit("2024-01-15T"), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit(":00Z"))
    return out.select("status", "region", "hour", stamp.alias("timestamp"), F.concat(F.lit("req-"), F.col("id").cast("string")).alias("request_id"))


def profile(df: DataFrame, *columns: str) -> DataFrame:
    """(name, value, n): rows, distinct combinations, and how often each value of each column occurs."""
    total = df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("name"), F.lit(None).cast("string").alias("value"), "n")
    combos = df.select(*columns).distinct().agg(F.count("*").alias("n")).select(F.lit("combinations").alias("name"), F.lit(None).cast("string").alias("value"), "n")
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return total.union(combos).union(each.groupBy("x").agg(F.count("*").alias("n")).select("x.name", "x.value", "n"))
