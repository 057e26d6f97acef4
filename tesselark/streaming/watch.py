"""Structured Streaming forms: a watched tree, usage windows, idempotent episodes and live intents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watch(engine, path: str, repo_id: str, every: str = "1 second"):
    """Index a tree again whenever a file of it is new, edited or gone; a trigger's changes make one run, and runs don't overlap.

    A file source knows each path once, so the ticks of a clock look at the tree's listing instead.
    """
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    seen: list = [None]

    def run(batch: DataFrame, _: int) -> None:
        listing = engine.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rows = listing.select(F.xxhash64("path", "modificationTime", "length").alias("h"))
        now = rows.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).head()
        if now != seen[0]:
            engine.index_directory(path, repo_id)
            seen[0] = now

    return ticks.writeStream.queryName(f"watch:{path}").foreachBatch(run).trigger(processingTime=every).option("checkpointLocation", f"{engine.home}/checkpoints/watch-{repo_id}").start()


def usage_windows(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Calls and failures of each tool in each window; rows later than the watermark are dropped."""
    return calls.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), "tool").agg(F.count("*").alias("calls"), F.sum((~F.col("ok")).cast("int")).alias("failed"))


def bursts(events: DataFrame, gap: str = "600 seconds", late: str = "10 minutes", at: str = "ts", key: str = "path") -> DataFrame:
    """Changes closer together than the gap as one burst of each key."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("burst"), key).agg(F.count("*").alias("changes"))


def once(episodes: DataFrame, late: str = "1 day", at: str = "reference_time", key: str = "episode_key") -> DataFrame:
    """Each episode once, however often it is delivered within the watermark."""
    return episodes.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def live_intents(intents: DataFrame, ttl: str = "120 seconds", at: str = "at") -> DataFrame:
    """Targets with their writers in sliding windows as long as an intent lives."""
    rows = intents.withWatermark(at, ttl).select(at, "agent", F.explode("targets").alias("target"))
    return rows.groupBy(F.window(at, ttl, "30 seconds").alias("window"), "target").agg(F.approx_count_distinct("agent").alias("agents"))
