"""Short answers: the first rows, chosen fields, and texts that a session has seen already by hash alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(df: DataFrame, order: Sequence[Column | str], fields: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows in order with some of the fields, and how many there are in all."""
    total = df.agg(F.count("*").alias("total_rows"))
    top = df.orderBy(*order).limit(rows).select(*fields)
    return top.crossJoin(F.broadcast(total))  # one row


def unseen(df: DataFrame, text: str, seen: DataFrame, key: str = "text_sha256") -> DataFrame:
    """df with the hash of a text column; texts whose hash the session has are left out as null."""
    hashed = df.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    known = seen.select(key).distinct().withColumn("__seen", F.lit(True))
    return hashed.join(known, key, "left").withColumn(text, F.when(F.col("__seen").isNull(), F.col(text))).drop("__seen")


def context_window(lines: DataFrame, hits: DataFrame, around: int = 5, path: str = "file_path") -> DataFrame:
    """Lines within `around` of a hit, each once."""
    wanted = hits.select(path, F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - around), F.col("line") + around)).alias("line")).distinct()
    return lines.join(wanted, [path, "line"]).orderBy(path, "line")
