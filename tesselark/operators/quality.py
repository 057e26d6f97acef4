"""Dead code, bridges and style of a code graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dead_code(symbols: DataFrame, used: DataFrame, rules: Sequence[tuple[str, Column]], key: str = "stable_key") -> DataFrame:
    """(key, excluded_by): unused symbols, and the first rule that excuses each of them; null is a candidate."""
    unused = symbols.join(used.select(key).distinct(), key, "left_anti")
    reason = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules], F.lit(None).cast("string"))
    return unused.withColumn("excluded_by", reason)


def exclusion_counts(dead: DataFrame) -> DataFrame:
    return dead.groupBy(F.coalesce("excluded_by", F.lit("candidate")).alias("excluded_by")).agg(F.count("*").alias("symbols"))


#: The order of the exclusions for code symbols, over columns that the caller joins on.
def code_rules() -> list[tuple[str, Column]]:
    from ..functions.text import is_entry_path, is_test_path

    return [
        ("exported", F.col("exported")),
        ("entry_file", is_entry_path("file_path")),
        ("test_file", is_test_path("file_path")),
        ("route_handler", F.col("kind") == "RouteHandler"),
        ("constructor", F.col("kind") == "Constructor"),
        ("module", F.col("kind") == "Module"),
        ("type", F.col("kind").isin("Interface", "TypeAlias", "Enum", "Namespace")),
        ("special_method", F.col("name").rlike(r"^__.*__$")),
        ("unresolved_call", F.coalesce("unresolved_calls", F.lit(0)) > 0),
        ("reflection", F.coalesce("reflected", F.lit(False))),
    ]


def bridges(edges: DataFrame, cuts: DataFrame, least: int = 2) -> DataFrame:
    """Articulation points with enough neighbours, the best connected first."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("n")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("n"))).where("node != n")
    degree = both.groupBy("node").agg(F.count_distinct("n").alias("neighbours"))
    return cuts.select("node").join(degree, "node").where(F.col("neighbours") >= least).withColumn("score", F.log2(F.lit(1.0) + F.col("neighbours"))).orderBy(F.desc("score"), "node")


def style(texts: DataFrame, dimensions: dict[str, dict[str, str]], text: str = "text", by: str = "lang") -> DataFrame:
    """(by, dimension, choice, matches, dominance, confidence): the preferred choice of each style dimension.

    dimensions: name -> {choice: pattern}.  Confidence is .25 + .7 dominance min(1, log2(total + 1) / 5).
    """
    counts = [F.sum(F.regexp_count(F.col(text), F.lit(p))).alias(f"{d}\t{c}") for d, cs in dimensions.items() for c, p in cs.items()]
    wide = texts.groupBy(by).agg(*counts)
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("choice"), F.col(f"{d}\t{c}").cast("long").alias("matches")) for d, cs in dimensions.items() for c in cs]))
    rows = wide.select(by, cells.alias("x")).select(by, "x.*")
    total = rows.groupBy(by, "dimension").agg(F.sum("matches").alias("total"), F.max_by(F.struct("choice", "matches"), F.struct("matches", "choice")).alias("top"))
    dominance = F.coalesce(F.try_divide(F.col("top.matches"), F.col("total")), F.lit(0.0))
    return total.where("total > 0").select(by, "dimension", F.col("top.choice").alias("choice"), F.col("top.matches").alias("matches"), F.round(dominance, 6).alias("dominance"), F.round(0.25 + 0.7 * dominance * F.least(F.lit(1.0), F.log2(F.col("total") + F.lit(1.0)) / 5), 6).alias("confidence"))
