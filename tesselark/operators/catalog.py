"""Lookups and reports over the tables of an index: symbols, repositories, projects and resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_contains


def symbol_matches(symbols: DataFrame, name: str, fuzzy: bool = True, kind: str | None = None, file_path: str | None = None) -> DataFrame:
    """Symbols (name, qualified_name, ...) that match, with match_rank: qualified name, name, prefix, anything."""
    n = name.lower()
    if fuzzy:
        hit = symbols.where(like_contains("name", name) | like_contains("qualified_name", name))
    else:
        hit = symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))
    hit = hit.where(F.col("kind") == kind) if kind else hit
    hit = hit.where(F.col("file_path") == file_path) if file_path else hit
    rank = F.when(F.lower("qualified_name") == n, 0).when(F.lower("name") == n, 1).when(F.lower("name").startswith(n), 2).otherwise(3)
    return hit.withColumn("match_rank", rank)


def with_counts(repositories: DataFrame, key: str = "repo_id", **tables: DataFrame) -> DataFrame:
    """repositories with the number of rows that each table has of them, 0 where none."""
    out = repositories
    for name, rows in tables.items():
        counted = rows.groupBy(key).agg(F.count("*").alias(name))
        out = out.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def symbol_stats(symbols: DataFrame, levels: Sequence[str], file: str, occurrences: str) -> DataFrame:
    """Symbols, files and occurrences by all levels, by each shorter list of them, and in total."""
    sets = [[F.col(c) for c in levels[:n]] for n in range(len(levels), -1, -1)]
    # a file's rows are added up before each of them is told for every level
    each = symbols.groupBy(*levels, file).agg(F.count("*").alias("symbols"), F.sum(F.col(occurrences).cast("decimal(18,2)")).alias("occurrences"))
    grouped = each.groupingSets(sets, *[F.col(c) for c in levels])
    return grouped.agg(F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.count_distinct(file).alias("files"), F.sum("occurrences").cast("double").alias("occurrences"))


def diagnostics(calls: DataFrame, *by: str) -> DataFrame:
    """Resolved, ambiguous and unresolved calls, and the share of the resolved; 1 where there are no calls."""
    each = [F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0).cast("long")).alias(s) for s in ("resolved", "ambiguous", "unresolved")]
    got = calls.groupBy(*by).agg(F.count("*").alias("calls"), *each)
    return got.withColumn("resolution_rate", F.coalesce(F.try_divide("resolved", "calls"), F.lit(1.0)))


def unmatched(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key nothing known has."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def projects(repositories: DataFrame, project: str, name: str, main: Column) -> DataFrame:
    """(project, worktrees): the repositories of a project, its main one first, then by name."""
    rows = F.array_sort(F.collect_list(F.struct((~main).alias("other"), F.col(name).alias("name"))))
    return repositories.groupBy(project).agg(F.transform(rows, lambda x: x["name"]).alias("worktrees"))
