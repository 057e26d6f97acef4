"""What a repository looks like right now, as one row with a snapshot id."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from .git import git


def inspect(root: str) -> dict:
    """Head, branch and changed paths of a working tree; outside git only the root."""
    try:
        head = git(root, "rev-parse", "HEAD").strip()
        branch = git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
        dirty = sorted(p[3:] for p in git(root, "status", "--porcelain", "-z").split("\0") if p)
    except Exception:  # no repository, no git or no commit: there is no evidence
        head, branch, dirty = None, None, []
    evidence = {"branch": branch, "dirty": dirty, "head": head, "root": root}
    return evidence | {"snapshot_id": hashlib.sha256(json.dumps(evidence, sort_keys=True).encode()).hexdigest()}


def state(spark: SparkSession, root: str) -> DataFrame:
    s = inspect(root)
    return spark.createDataFrame([(s["root"], s["head"], s["branch"], s["dirty"], s["snapshot_id"])], "root string, head string, branch string, dirty array<string>, snapshot_id string")


def fresh(root: str, snapshot_id: str) -> bool:
    """Whether nothing has changed since a snapshot."""
    return inspect(root)["snapshot_id"] == snapshot_id
