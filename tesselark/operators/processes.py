"""Process models inferred from flows, their refresh, and briefings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(steps: DataFrame, process: str, ordinal: str, step: str, kind: str, most: int = 100) -> DataFrame:
    """(process, kind, digest, steps, n_steps): identity from the start, second, third and last step."""
    lists = steps.where(F.col(ordinal) < most).groupBy(process).agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, step))), lambda x: x[step]).alias("steps"), F.min_by(kind, ordinal).alias("kind"))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    ident = F.concat_ws("|", text(F.col("kind")), text(F.col("steps")[0]), text(F.try_element_at("steps", F.lit(2))), text(F.try_element_at("steps", F.lit(3))), text(F.element_at("steps", -1)))
    return lists.select(process, "kind", F.substring(F.sha2(ident, 256), 1, 16).alias("digest"), "steps", F.size("steps").alias("n_steps"))


def numbered(steps: DataFrame, process: Sequence[str], order: Sequence[str]) -> DataFrame:
    """steps with their ordinal in their process, from 1."""
    return steps.withColumn("ordinal", F.row_number().over(Window.partitionBy(*process).orderBy(*order)))


def refresh(known: DataFrame, found: DataFrame, complete: bool = True, key: str = "process_key") -> DataFrame:
    """(key, change): added, modified, reactivated, unchanged or retired; nothing retires on a partial search."""
    k = known.select(F.col(key).alias("k"), F.col("fingerprint").alias("f0"), "active")
    f = found.select(F.col(key).alias("k"), F.col("fingerprint").alias("f1"))
    change = (
        F.when(F.col("f0").isNull(), "added").when(F.col("f1").isNull() & F.col("active") & F.lit(complete), "retired").when(F.col("f1").isNull(), "kept")
        .when(~F.col("active"), "reactivated").when(F.col("f0") != F.col("f1"), "modified").otherwise("unchanged")
    )
    return k.join(f, "k", "full").select(F.col("k").alias(key), change.alias("change"))


def membership(steps: DataFrame, symbol, step: str = "stable_key") -> DataFrame:
    return steps.where(F.col(step) == F.lit(symbol))


def section(df: DataFrame | None, name: str, spark) -> DataFrame:
    """(section, status, n): available, available_empty, or missing where the source table is."""
    if df is None:
        return spark.range(1).select(F.lit(name).alias("section"), F.lit("missing").alias("status"), F.lit(None).cast("long").alias("n"))
    return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), F.when(F.col("n") > 0, "available").otherwise("available_empty").alias("status"), "n")


def briefing(spark, **tables: DataFrame | None) -> DataFrame:
    out = None
    for name, df in tables.items():
        s = section(df, name, spark)
        out = s if out is None else out.unionByName(s)
    return out
