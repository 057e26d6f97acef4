"""Change risk, findings and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blast_risk

# Severities, and the thresholds from which a change is reported.
SEVERITIES = ("critical", "error", "warning", "info")
THRESHOLDS = {"cyclomatic": 12, "cognitive": 15, "complexity_delta": 4, "hotspot_score": 24, "cross_module_files": 1}
FINDING = ("severity", "confidence", "code", "file_path", "line", "message")


def severity_rank(column="severity"):
    out = F.lit(len(SEVERITIES))
    for k, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(F.col(column) == s, k).otherwise(out)
    return out


def impact_risk(reached: DataFrame, nodes: DataFrame, node: str = "node", file: str = "file_path") -> DataFrame:
    """(origin, symbols, files, risk) of searched impacts."""
    got = reached.join(nodes.select(F.col(node).alias("node"), file), "node").groupBy("origin").agg(F.count_distinct("node").alias("symbols"), F.count_distinct(file).alias("files"))
    return got.withColumn("risk", blast_risk("symbols", "files"))


def aggregate_risk(changed: DataFrame) -> DataFrame:
    """Risk of a whole change from one row of counts: symbols, files, changed_symbols, changed_files, strong_cochanges, unmapped, decisions."""
    base = F.when((F.col("symbols") >= 40) | (F.col("files") >= 15), 3).when((F.col("symbols") >= 15) | (F.col("files") >= 7), 2).when((F.col("symbols") >= 5) | (F.col("files") >= 3), 1).otherwise(0)
    level = F.greatest(base, F.when((F.col("changed_symbols") >= 10) | (F.col("changed_files") >= 5), 2).otherwise(0))
    level = F.when(F.col("strong_cochanges") >= 3, F.least(F.lit(3), level + 1)).otherwise(level)
    level = F.greatest(level, F.when((F.col("strong_cochanges") > 0) | (F.col("unmapped") > 0) | (F.col("decisions") > 0), 1).otherwise(0))
    return changed.withColumn("risk", F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), level + 1))


def dedupe(findings: DataFrame) -> DataFrame:
    """The most severe, then the most confident finding of each code and place, in order."""
    order = Window.partitionBy("code", "file_path", "line").orderBy(severity_rank(), F.desc("confidence"), "message")
    best = findings.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    return best.orderBy(severity_rank(), "file_path", "line", "code", "message")


def literal_rules(lines: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Findings of rules that look for a literal in changed lines; rules come from a checked, bounded file."""
    out = None
    for r in rules:
        text = F.col("text") if r.get("case_sensitive", True) else F.lower("text")
        needle = r["contains"] if r.get("case_sensitive", True) else r["contains"].lower()
        hit = lines.where(text.contains(F.lit(needle)))
        if r.get("file"):
            hit = hit.where(F.col("file_path").contains(F.lit(r["file"])))
        rows = hit.select(F.lit(r.get("severity", "warning")).alias("severity"), F.lit(1.0).alias("confidence"), F.lit(f"local-rule:{r['id']}").alias("code"), "file_path", "line", F.lit(r.get("message", r["contains"])).alias("message"))
        out = rows if out is None else out.unionByName(rows)
    return out


def verdict(findings: DataFrame) -> DataFrame:
    worst = F.min(severity_rank())
    return findings.agg(F.count("*").alias("findings"), F.when(worst <= 1, "changes_requested").when(worst == 2, "review_required").otherwise("no_blocking_findings").alias("verdict"))
