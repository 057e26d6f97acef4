"""Coordination of several writers: intents, conflict classes, leases and escalations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 120
DESTRUCTIVE = ("delete", "rename")


def active(intents: DataFrame, now, ttl: int = TTL_SECONDS, at: str = "at") -> DataFrame:
    """Intents younger than the time to live, without cancelled ones."""
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at)
    live = intents.where((age >= 0) & (age < ttl))
    return live.where(~F.coalesce("cancelled", F.lit(False))) if "cancelled" in intents.columns else live


def conflicts(intents: DataFrame) -> DataFrame:
    """(intent, conflict_class, active_conflicts): A alone, B others modify the same target, C destruction meets another writer.

    Other agents on a target are counted per target, so no pairs are made.
    """
    t = intents.select("intent", "agent", "kind", F.explode("targets").alias("target")).distinct()
    destroys = F.col("kind").isin(*DESTRUCTIVE)
    per = t.groupBy("target", "agent").agg(F.count("*").alias("own"), F.sum(destroys.cast("int")).alias("own_d"))
    all_ = per.groupBy("target").agg(F.sum("own").alias("all"), F.sum("own_d").alias("all_d"))
    met = t.join(per, ["target", "agent"]).join(all_, "target").select("intent", (F.col("all") - F.col("own")).alias("others"), ((destroys & (F.col("all") > F.col("own"))) | (F.col("all_d") > F.col("own_d"))).alias("c"))
    return met.groupBy("intent").agg(F.when(F.max("c"), "C").when(F.max("others") > 0, "B").otherwise("A").alias("conflict_class"), F.sum("others").alias("active_conflicts"))


def leases(requests: DataFrame) -> DataFrame:
    """(request, target, granted, blocker): the earliest request of a target holds it."""
    order = Window.partitionBy("target").orderBy("at", "request")
    holder = F.first("request").over(order)
    return requests.select("request", "target", (holder == F.col("request")).alias("granted"), F.when(holder != F.col("request"), holder).alias("blocker"))


def escalations(episodes: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Class C episodes with the state of their escalation."""
    r = resolutions.groupBy("episode").agg(F.max_by("directive", "at").alias("directive"), F.max_by("winner", "at").alias("winner"))
    return episodes.where("conflict_class = 'C'").join(r, "episode", "left").withColumn("status", F.when(F.col("directive").isNull(), "pending").otherwise("resolved"))


def summary(intents: DataFrame, classes: DataFrame, held: DataFrame) -> DataFrame:
    a = intents.agg(F.count_distinct("agent").alias("agents"), F.count("*").alias("intents"))
    c = classes.agg(F.coalesce(F.sum((F.col("conflict_class") != "A").cast("int")), F.lit(0)).cast("long").alias("overlaps"), F.coalesce(F.sum((F.col("conflict_class") == "C").cast("int")), F.lit(0)).cast("long").alias("pending"))
    h = held.agg(F.coalesce(F.sum(F.col("granted").cast("int")), F.lit(0)).cast("long").alias("leases"))
    return a.crossJoin(c).crossJoin(h)  # one row each
