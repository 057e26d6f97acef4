"""Top-k, pages, stratified samples and budgets with total orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key: the first in `order`, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def latest_by(df: DataFrame, keys: Sequence[str], by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row with the largest `by` of each key, by a map-side combined aggregate."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*by)).alias("__v")).select(*keys, "__v.*")


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank_in_group", rank).where(F.col("rank_in_group") <= n)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page; has_more comes from asking for one row beyond it."""
    got = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = got.withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows at most
    more = F.max("__n").over(Window.partitionBy(F.lit(1))) > limit
    return numbered.withColumn("has_more", more).where(F.col("__n") <= limit).drop("__n")


def rotating_page(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The next `limit` keys after `last`, wrapping around."""
    return df.orderBy(F.col(key) <= F.lit(last), key).limit(limit)


def round_robin(df: DataFrame, cluster: str, key: str, score: str, most: int, share: float = 0.22) -> DataFrame:
    """At most `most` rows: a reserved share dealt over the clusters in turn, the largest first, the rest by score.

    Only the first `most` rows of a cluster, and the first `most` clusters, can be chosen, so
    the final ranking sees a bounded number of rows.
    """
    sizes = df.groupBy(cluster).agg(F.count("*").alias("__size"))
    top = sizes.orderBy(F.desc("__size"), cluster).limit(most)
    n_clusters = sizes.count()
    reserve = min(most, max(n_clusters, int(share * most)))
    best = [F.desc(score), F.col(key)]
    rows = per_group(df, [cluster], best, most)
    dealt = rows.join(F.broadcast(top), cluster).orderBy("rank_in_group", F.desc("__size"), cluster).limit(reserve).select(*df.columns)
    rest = df.join(F.broadcast(dealt.select(key)), key, "left_anti").orderBy(*best).limit(max(0, most - reserve))
    return dealt.unionByName(rest.select(*df.columns)).orderBy(key)


def greedy_budget(df: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows of each group that fit a budget in order; a row that doesn't fit is skipped, later ones may fit."""
    schema = df.schema

    def pick(key, batches):
        left = budget
        for pdf in batches:
            keep = []
            for c in pdf[cost]:
                ok = c <= left
                left -= c if ok else 0
                keep.append(ok)
            yield pdf[keep]

    from collections.abc import Iterator

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        it: Iterator[pd.DataFrame] = pick(None, [pdf.sort_values(order)])
        return next(it)

    return df.groupBy(group).applyInPandas(run, schema)
