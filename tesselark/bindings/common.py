"""How the relational test tables stand for the engine's inputs.

commit = order, file = part or supplier; a directed edge leads from one line item's supplier
to the next one's of the same order; a symbol is a part, a repository a nation, an episode a
user's event, a call an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, confidence) over suppliers, of every line item."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    before = F.lag("l_suppkey").over(order).alias("source")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), before).where("source is not null and source != target")
    confidence = F.round(F.least(F.lit(0.99), 0.5 + 0.1 * F.col("n")), 2).alias("confidence")
    return steps.groupBy("source", "target").agg(F.count("*").alias("n")).select("source", "target", confidence)


#: The edges of supplier_edges for DuckDB.
EDGES_SQL = """steps AS (SELECT l_suppkey AS target, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS source
  FROM lineitem),
edges AS MATERIALIZED (SELECT source, target, round(least(0.99, 0.5 + 0.1 * count(*)), 2) AS confidence FROM steps
  WHERE source IS NOT NULL AND source <> target GROUP BY source, target)"""


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: a user is a symbol, clicks rename it to the next user's key."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "click", "renamed").otherwise("modified")
    rows = e.select(F.col("event_id").alias("sequence"), F.col("ts").alias("reference_time"), F.col("user_id").alias("stable_key"), kind.alias("change_type"), "value")
    previous = F.when(F.col("change_type") == "renamed", F.col("stable_key") + 1)
    return rows.withColumn("previous_stable_key", previous).withColumn("before", F.when(F.col("change_type") != "added", F.col("value"))).withColumn("after", F.when(F.col("change_type") != "removed", F.col("value")))


CHANGES_SQL = """changes AS (SELECT event_id AS sequence, ts AS reference_time, user_id AS stable_key,
  CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'click' THEN 'renamed' ELSE 'modified' END AS change_type,
  CASE WHEN event_type = 'click' THEN user_id + 1 END AS previous_stable_key, value,
  CASE WHEN event_type <> 'signup' THEN value END AS before, CASE WHEN event_type <> 'error' THEN value END AS after FROM events)"""
