"""Durable history: episodes, validity intervals, replay, lineage and evolution.

A change is (sequence, stable_key, previous_stable_key, change_type, ...).  Validity
intervals are derived from the change log rather than kept up to date row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import components

CHANGE_TYPES = ("added", "modified", "removed", "renamed")


def invalid_changes(changes: DataFrame) -> DataFrame:
    """Changes whose type and before and after states disagree, with the reason."""
    reason = (
        F.when(~F.col("change_type").isin(*CHANGE_TYPES), "unknown_change_type")
        .when((F.col("change_type") == "added") & F.col("before").isNotNull(), "added_has_before")
        .when((F.col("change_type") == "removed") & F.col("after").isNotNull(), "removed_has_after")
        .when((F.col("change_type") != "added") & F.col("before").isNull(), "before_missing")
        .when((F.col("change_type") != "removed") & F.col("after").isNull(), "after_missing")
        .when((F.col("change_type") == "renamed") & F.col("previous_stable_key").isNull(), "previous_key_missing")
    )
    return changes.withColumn("reason", reason).where("reason is not null")


def new_episodes(episodes: DataFrame, known: DataFrame) -> DataFrame:
    """Episodes not recorded yet, with the next sequence numbers; equal keys with another fingerprint are conflicts."""
    k = known.select("episode_key", F.col("fingerprint").alias("__known"))
    tagged = episodes.join(k, "episode_key", "left")
    status = F.when(F.col("__known").isNull(), "new").when(F.col("__known") == F.col("fingerprint"), "duplicate").otherwise("conflict")
    tagged = tagged.withColumn("status", status).drop("__known")
    base = known.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("__base"))
    order = F.row_number().over(Window.partitionBy("status").orderBy("reference_time", "episode_key"))
    return tagged.withColumn("__n", order).crossJoin(F.broadcast(base)).withColumn("sequence", F.when(F.col("status") == "new", F.col("__base") + F.col("__n"))).drop("__n", "__base")  # one row


def intervals(changes: DataFrame) -> DataFrame:
    """(stable_key, valid_from, valid_to, state): half-open validity of each version of each key.

    A change with a before-state closes its previous key, one with an after-state opens its
    own; an open version ends at the key's next event.  A close without an open is a version
    from before the log, with a null start.
    """
    closes = changes.where("change_type != 'added'").select(F.coalesce("previous_stable_key", "stable_key").alias("stable_key"), "sequence", F.lit(0).alias("opens"), F.col("before").alias("state"))
    opens = changes.where("change_type != 'removed'").select("stable_key", "sequence", F.lit(1).alias("opens"), F.col("after").alias("state"))
    events = closes.unionByName(opens)
    order = Window.partitionBy("stable_key").orderBy("sequence", "opens")
    marked = events.withColumn("next", F.lead("sequence").over(order)).withColumn("previous", F.lag("opens").over(order))
    versions = marked.where("opens = 1").select("stable_key", F.col("sequence").alias("valid_from"), F.col("next").alias("valid_to"), "state")
    baseline = marked.where("opens = 0 and previous is null").select("stable_key", F.lit(None).cast(changes.schema["sequence"].dataType).alias("valid_from"), F.col("sequence").alias("valid_to"), "state")
    return versions.unionByName(baseline)


def replay(versions: DataFrame, sequence: int) -> DataFrame:
    """The versions that were valid at a sequence number."""
    return versions.where((F.col("valid_from").isNull() | (F.col("valid_from") <= sequence)) & (F.col("valid_to").isNull() | (F.col("valid_to") > sequence)))


def changes_since(episodes: DataFrame, changes: DataFrame, since, limit: int = 100, by: str = "sequence") -> DataFrame:
    """Episodes strictly after a sequence or time, each with its changes, and whether more follow."""
    picked = episodes.where(F.col(by) > F.lit(since)).orderBy("sequence").limit(limit + 1)
    n = F.row_number().over(Window.orderBy("sequence"))
    picked = picked.withColumn("__n", n).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("__n") <= limit).drop("__n")  # limit + 1 rows
    nested = changes.join(F.broadcast(picked.select("sequence")), "sequence", "left_semi").groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("stable_key", "change_type"))).alias("changes"))
    return picked.join(nested, "sequence", "left")


def lineage(changes: DataFrame, key) -> DataFrame:
    """Every key that a key was or became by renames: its component, found in a number of rounds that grows with the log of a chain."""
    links = changes.where("previous_stable_key is not null and previous_stable_key != stable_key").select(F.col("stable_key").alias("a"), F.col("previous_stable_key").alias("b"))
    own = changes.sparkSession.range(1).select(F.lit(key).cast(changes.schema["stable_key"].dataType).alias("stable_key"))
    found = cut(components(links, rounds=1000).select(F.col("node").alias("stable_key"), "component"))
    mine = found.join(F.broadcast(own), "stable_key", "left_semi").select("component")  # one row at most
    return own.unionByName(found.join(F.broadcast(mine), "component", "left_semi").select("stable_key")).distinct()


def timeline(changes: DataFrame, key, start=None, end=None, at: str = "reference_time", descending: bool = False, limit: int = 100) -> DataFrame:
    """The changes of a key and of all it was renamed from or to, within times that are compared as timestamps."""
    rows = changes.join(lineage(changes, key), "stable_key", "left_semi")
    if start is not None:
        rows = rows.where(F.col(at) >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col(at) <= F.lit(end).cast("timestamp"))
    order = [F.desc("sequence"), F.desc("stable_key")] if descending else ["sequence", "stable_key"]
    return rows.orderBy(*order).limit(limit)


def episode_summary(changes: DataFrame, *keys: str) -> DataFrame:
    """Counts by change type; a fixed set of columns, so nothing has to be known of the data."""
    return changes.groupBy(*keys).agg(*(F.sum((F.col("change_type") == t).cast("int")).cast("long").alias(t) for t in CHANGE_TYPES), F.count("*").alias("total"))


def evolution(changes: DataFrame, at: str = "reference_time") -> DataFrame:
    return changes.groupBy("stable_key").agg(F.count("*").alias("changes"), F.count_distinct("change_type").alias("kinds"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def stats(episodes: DataFrame, versions: DataFrame, at: str = "reference_time") -> DataFrame:
    """Counts of episodes, versions and open versions with the first and last time."""
    e = episodes.agg(F.count("*").alias("episodes"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    v = versions.agg(F.count("*").alias("versions"), F.coalesce(F.sum(F.col("valid_to").isNull().cast("int")), F.lit(0)).cast("long").alias("open_versions"))
    return e.crossJoin(v)  # one row each


def state_diff(before: DataFrame, after: DataFrame, key: str = "stable_key", fingerprint: str = "fingerprint") -> DataFrame:
    """(key, change_type) between two states; unchanged rows are left out."""
    b = before.select(F.col(key).alias("k"), F.col(fingerprint).alias("f0"))
    a = after.select(F.col(key).alias("k"), F.col(fingerprint).alias("f1"))
    kind = F.when(F.col("f0").isNull(), "added").when(F.col("f1").isNull(), "removed").when(F.col("f0") != F.col("f1"), "modified")
    return b.join(a, "k", "full").select(F.col("k").alias(key), kind.alias("change_type")).where("change_type is not null")
