"""Decisions, their scopes and verdicts, and worktree overlays with three-way merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import latest_by


def current_status(log: DataFrame, key: str = "decision_id") -> DataFrame:
    """The newest status of each decision in an append-only log."""
    return latest_by(log, [key], ["at", "status"], ["status", "at"])


def governing(decisions: DataFrame, scopes: DataFrame, repository, file=None, symbol=None) -> DataFrame:
    """Active decisions whose scope is the repository, the file or the symbol, each once by its narrowest scope."""
    wanted = [("repository", repository, 3), ("file", file, 2), ("symbol", symbol, 1)]
    parts = [scopes.where((F.col("scope_type") == t) & (F.col("scope_key") == F.lit(k))).select("decision_id", F.lit(n).alias("width"), "scope_type") for t, k, n in wanted if k is not None]
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    best = met.groupBy("decision_id").agg(F.min_by("scope_type", "width").alias("scope_type"), F.min("width").alias("width"))
    out = decisions.where("status = 'active'").join(best, "decision_id")
    return out.withColumn("implied_prohibition", F.col("kind").isin("ban", "convention"))


def verify(decisions: DataFrame, observations: DataFrame) -> DataFrame:
    """A verdict on each decision from its latest observation; without one nothing can be proved."""
    last = latest_by(observations, ["decision_id"], ["at", "held"], ["held", "location"])
    verdict = (
        F.when(F.col("status") == "superseded", "Superseded").when(F.col("status") == "rejected", "Rejected")
        .when(F.col("held").isNull(), "CannotProve").when(F.col("held"), "Held").otherwise("ViolatedAt")
    )
    return decisions.join(last, "decision_id", "left").select("decision_id", verdict.alias("verdict"), F.when(verdict == "ViolatedAt", F.col("location")).alias("location"))


def plan_merge(source: DataFrame, target: DataFrame, fields: Sequence[str], key: str = "stable_key") -> DataFrame:
    """(key, action): how two overlays of one base merge, symbol by symbol.

    Overlays have key, change_type (added, modified, removed), base_fingerprint and fields.
    Fields that only one side changed from the base (base_<field>) merge; fields that both
    changed differently conflict.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col(key).alias("k"), F.col("change_type").alias(f"{p}_type"), F.col("base_fingerprint").alias(f"{p}_base"), *(F.col(f).alias(f"{p}_{f}") for f in fields), *(F.col(f"base_{f}").alias(f"{p}_base_{f}") for f in fields))

    both = side(source, "s").join(side(target, "t"), "k", "full")
    same, clash = F.lit(True), F.lit(False)
    for f in fields:
        s, t, b = F.col(f"s_{f}"), F.col(f"t_{f}"), F.col(f"s_base_{f}")
        same = same & s.eqNullSafe(t)
        clash = clash | (~s.eqNullSafe(t) & ~s.eqNullSafe(b) & ~t.eqNullSafe(b))
    one = F.col("s_type")
    two = F.col("t_type")
    action = (
        F.when(two.isNull(), "take_source").when(one.isNull(), "keep_target")
        .when((one == "removed") & (two == "removed"), "noop")
        .when((one == "removed") | (two == "removed"), "conflict:delete_modify")
        .when((one == two) & same, "noop")
        .when((one == "added") & (two == "added"), "conflict:add_add")
        .when(one != two, "conflict:change_type_mismatch")
        .when(~F.col("s_base").eqNullSafe(F.col("t_base")), "conflict:symbol_base_mismatch")
        .when(clash, "conflict:edit_edit").otherwise("merge")
    )
    merged = [F.when(F.col(f"s_{f}").eqNullSafe(F.col(f"s_base_{f}")), F.col(f"t_{f}")).otherwise(F.col(f"s_{f}")).alias(f) for f in fields]
    return both.select(F.col("k").alias(key), action.alias("action"), *merged)


def mergeable(plan: DataFrame) -> bool:
    return plan.where(F.col("action").startswith("conflict")).isEmpty()


def check_merge(plan: DataFrame, expected_revision: int, revision: int) -> None:
    """Refuse a merge where the target has moved on or the plan has conflicts."""
    if expected_revision != revision:
        raise ValueError(f"target is at revision {revision}, the plan was made at {expected_revision}")
    if not mergeable(plan):
        raise ValueError("the plan has conflicts")


def apply_merge(plan: DataFrame, target: DataFrame, expected_revision: int, revision: int, key: str = "stable_key") -> DataFrame:
    """The target's symbols after a merge."""
    check_merge(plan, expected_revision, revision)
    changed = plan.where(F.col("action").isin("take_source", "merge")).select(key, *[c for c in plan.columns if c not in (key, "action")])
    kept = target.join(changed, key, "left_anti").select(*changed.columns)
    return kept.unionByName(changed)
