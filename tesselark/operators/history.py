"""Co-change, churn and hotspots from a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cochange(changes: DataFrame, target, commit: str = "commit", item: str = "file", most_items: int = 20, least: int = 2, limit: int = 20) -> DataFrame:
    """Items that change together with `target`, with coupling and Jaccard figures.

    Commits with more than `most_items` items say little and are left out.  The self join is
    narrowed first to the commits that hold the target.
    """
    most = max(2, min(most_items or 20, 200))
    rows = changes.select(commit, item).distinct()
    small = rows.groupBy(commit).agg(F.count("*").alias("n")).where(F.col("n") <= most).select(commit)
    eligible = rows.join(small, commit, "left_semi")
    mine = eligible.where(F.col(item) == target).select(commit)
    total = mine.agg(F.count("*").alias("target_commits"))
    each = eligible.groupBy(item).agg(F.count("*").alias("partner_commits"))
    together = eligible.where(F.col(item) != target).join(mine, commit, "left_semi").groupBy(item).agg(F.count("*").alias("cochanges"), F.slice(F.array_sort(F.collect_set(commit)), 1, 5).alias("samples"))
    out = together.where(F.col("cochanges") >= least).join(each, item).crossJoin(F.broadcast(total))  # one row
    both = F.col("cochanges").cast("double")
    out = out.withColumn("coupling", both / F.greatest(F.lit(1), F.least("target_commits", "partner_commits"))).withColumn("jaccard", both / (F.col("target_commits") + F.col("partner_commits") - F.col("cochanges")))
    return out.orderBy(F.desc("coupling"), F.desc("cochanges"), item).limit(limit)


def partners(changes: DataFrame, targets: DataFrame, commit: str = "commit", item: str = "file", most_items: int = 20) -> DataFrame:
    """(target, partner, cochanges, coupling) of everything that changes together with any of the targets."""
    rows = changes.select(commit, F.col(item).alias("partner")).distinct()
    small = rows.groupBy(commit).agg(F.count("*").alias("n")).where(F.col("n") <= most_items).select(commit)
    eligible = rows.join(small, commit, "left_semi")
    each = eligible.groupBy("partner").agg(F.count("*").alias("commits"))
    mine = eligible.join(targets.select(F.col(item).alias("partner")).distinct(), "partner", "left_semi").select(commit, F.col("partner").alias("target"))
    met = mine.join(eligible, commit).where("target != partner").groupBy("target", "partner").agg(F.count("*").alias("cochanges"))
    met = met.join(each, "partner").join(each.select(F.col("partner").alias("target"), F.col("commits").alias("own")), "target")
    return met.select("target", "partner", "cochanges", (F.col("cochanges") / F.greatest(F.lit(1), F.least("commits", "own"))).alias("coupling"))


def pair_cochange(changes: DataFrame, commit: str, item: str, most_items: int = 20, least: int = 2) -> DataFrame:
    """All pairs of items that change together; a commit of at most `most_items` items makes a bounded number of pairs."""
    rows = changes.select(commit, item).distinct()
    lists = rows.groupBy(commit).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("xs")).where(F.col("n").between(2, most_items))
    pairs = lists.select(F.explode(F.expr("flatten(transform(xs, (x, i) -> transform(slice(xs, i + 2, size(xs)), y -> named_struct('a', x, 'b', y))))")).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("cochanges")).where(F.col("cochanges") >= least)


def churn(changes: DataFrame, item: str, kind: str, at: str, half_life_days: float = 90.0) -> DataFrame:
    """Weighted changes of each item, halving with age; ages count from the newest change of all."""
    newest = changes.agg(F.max(at).alias("__now"))
    age = (F.unix_micros("__now") - F.unix_micros(at)) / F.lit(86_400_000_000.0)
    weight: Column = F.when(F.col(kind) == "modified", 1.0).when(F.col(kind) == "renamed", 0.75).otherwise(0.5)
    rows = changes.crossJoin(F.broadcast(newest)).withColumn("__w", weight * F.pow(F.lit(0.5), age / half_life_days))  # one row
    return rows.groupBy(item).agg(F.count("*").alias("changes"), F.sum("__w").alias("weighted_churn"), F.max(at).alias("last_changed"))


def hotspots(complexity: DataFrame, churned: DataFrame, item: str, limit: int = 50) -> DataFrame:
    """Complexity times log of churn, largest first."""
    joined = complexity.join(churned, item, "left")
    score = (F.col("cyclomatic") + F.col("cognitive")) * F.log2(F.lit(2.0) + F.coalesce("weighted_churn", F.lit(0.0)))
    return joined.withColumn("score", score).orderBy(F.desc("score"), item).limit(limit)
