"""Session settings and the shared folder for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tesselark", **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI, adaptive execution."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder of the session, so that loops keep a short lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def within(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; reads no further."""
    return df.limit(rows + 1).count() <= rows
