"""Usage reports over an append-only ledger of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90, "all": None}


def in_period(calls: DataFrame, period: str, now, at: str = "ts") -> DataFrame:
    days = PERIODS[period]
    return calls if days is None else calls.where(F.col(at) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def totals(calls: DataFrame, duration: str = "duration_ms", ok: str = "ok") -> DataFrame:
    good = F.sum(F.col(ok).cast("int"))
    return calls.agg(F.count("*").alias("calls"), F.coalesce(good, F.lit(0)).alias("succeeded"), F.coalesce(F.count("*") - good, F.lit(0)).alias("failed"), F.round(F.avg(duration), 1).alias("mean_ms"), F.coalesce(F.try_divide(good, F.count("*")), F.lit(0.0)).alias("success_rate"))


def by(calls: DataFrame, *keys: str, duration: str = "duration_ms", ok: str = "ok", limit: int = 50) -> DataFrame:
    """The same figures by key, most calls first."""
    got = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum((~F.col(ok)).cast("int")).alias("failed"), F.round(F.avg(duration), 1).alias("mean_ms"))
    return got.orderBy(F.desc("calls"), *keys).limit(limit)


def by_day(calls: DataFrame, at: str = "ts", limit: int = 180) -> DataFrame:
    days = calls.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("calls"))
    return days.orderBy(F.desc("day")).limit(limit).orderBy("day")


def by_dimension(calls: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Calls of each row of a dimension, zero where it has none."""
    return dimension.join(calls.groupBy(key).agg(F.count("*").alias("calls")), key, "left").withColumn("calls", F.coalesce("calls", F.lit(0).cast("long")))


def retain(calls: DataFrame, key: str, most: int = 50_000) -> DataFrame:
    """The newest `most` rows: those at or above the key that many rows from the top."""
    top = calls.select(key).orderBy(F.desc(key)).limit(most).agg(F.min(key).alias("__least"))
    return calls.crossJoin(F.broadcast(top)).where(F.col(key) >= F.col("__least")).drop("__least")  # one row
