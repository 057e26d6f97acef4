"""Source trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never read, and the languages of file extensions.
IGNORED = ("node_modules", "dist", "build", "out", "coverage", "target", "vendor", "venv", "__pycache__", "site-packages")
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "kt": "kotlin", "swift": "swift", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "php": "php", "rb": "ruby",
}
MOST_BYTES = 2 << 20


def language(path="file_path"):
    """Language of a path by its extension; null where it isn't source code."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension)


def scan(spark: SparkSession, root: str, repo_id: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(repo_id, file_path, language, size, mtime_ms, content, hash) of a tree's source files.

    Hidden and ignored folders, other extensions and large files are left out before contents
    are decoded; folder and size filters reach the file listing.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    rows = raw.withColumn("file_path", F.substring_index("path", root.rstrip("/") + "/", -1)).where(~F.col("file_path").rlike(r"(^|/)\.")).where(~F.col("file_path").rlike(rf"(^|/)({'|'.join(IGNORED)})/"))
    rows = rows.withColumn("language", language()).where("language is not null")
    return rows.select(F.lit(repo_id).alias("repo_id"), "file_path", "language", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000.0).alias("mtime_ms"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"))


def reusable(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with reuse: same size and time as before, or same content hash; such files aren't parsed again."""
    k = known.select("repo_id", "file_path", F.col("size").alias("s0"), F.col("mtime_ms").alias("m0"), F.col("hash").alias("h0"))
    same = ((F.col("size") == F.col("s0")) & (F.abs(F.col("mtime_ms") - F.col("m0")) < 0.01)) | (F.col("hash") == F.col("h0"))
    return found.join(k, ["repo_id", "file_path"], "left").withColumn("reuse", F.coalesce(same, F.lit(False))).drop("s0", "m0", "h0")
