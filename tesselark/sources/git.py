"""Git history and diffs as DataFrames: loaders on the driver, parsers that run anywhere."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

_SKIP = re.compile(r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|go\.sum)$|\.(png|jpe?g|gif|svg|ico|pdf|woff2?|min\.js|map)$", re.I)


def git(root: str, *args: str, timeout: int = 30) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, check=True).stdout


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.since, self.most = options["path"], options.get("since", ""), int(options.get("maxcommits", "1000"))

    def read(self, partition):
        args = ["log", f"--max-count={self.most}", "--name-status", "-z", "--format=%x1e%H%x1f%cI%x1f%s%x1f"]
        if self.since:
            args.insert(1, f"--since={self.since}")
        yield from log_rows(git(self.root, *args))


class GitLog(DataSource):
    """spark.read.format("gitlog").option("path", root): (commit, at, subject, change, score, previous, file)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "commit string, at string, subject string, change string, score double, previous string, file string"

    def reader(self, schema):
        return _LogReader(self.options)


def read_log(spark: SparkSession, root: str, since: str = "", most: int = 1000) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").option("path", root).option("since", since).option("maxcommits", str(most)).load()


def log_rows(text: str) -> Iterator[tuple]:
    for block in text.split("\x1e")[1:]:
        commit, at, subject, rest = block.split("\x1f", 3)
        for change, score, previous, file in name_status(rest.lstrip("\0\n")):
            if not _SKIP.search(file):
                yield commit, at, subject, change, score, previous, file


def name_status(text: str) -> Iterator[tuple[str, float | None, str | None, str]]:
    """(change, similarity, previous path, path) of NUL-separated name-status output."""
    names = {"A": "added", "M": "modified", "D": "removed", "R": "renamed", "C": "added", "T": "modified"}
    parts = iter(text.split("\0"))
    for token in parts:
        token = token.strip("\n")
        if not token or token[0] not in names:
            continue
        if token[0] in "RC":
            previous, file = next(parts), next(parts)
            yield names[token[0]], float(token[1:] or 100) / 100, previous, file
        else:
            yield names[token[0]], None, None, next(parts)


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _unquote(path: str) -> str:
    if len(path) > 1 and path[0] == path[-1] == '"':
        raw = re.sub(rb"\\([0-7]{3})", lambda m: bytes([int(m[1], 8)]), path[1:-1].encode("latin-1", "backslashreplace"))
        return raw.decode("utf-8", "replace").replace('\\"', '"').replace("\\\\", "\\")
    return path


def parse_diff(text: str, strict: bool = False) -> list[dict]:
    """Changed lines of the new side: file_path, start_line, end_line, added, removed.

    A pure deletion counts at the line where the new side stands; a file without hunks has a
    null range.  With strict, hunk sizes that don't add up raise ValueError.
    """
    out: list[dict] = []
    path, old, seen = None, None, False
    left_old = left_new = line = 0
    run: dict | None = None

    def close() -> None:
        nonlocal run
        if run:
            out.append(run)
        run = None

    def finish() -> None:
        close()
        if strict and (left_old or left_new):
            raise ValueError(f"a hunk of {path} is cut short")
        if path and not seen:
            out.append({"file_path": path, "start_line": None, "end_line": None, "added": [], "removed": []})

    for row in text.splitlines():
        if left_old <= 0 and left_new <= 0 and row.startswith("diff --git "):
            finish()
            path, seen, left_old, left_new = None, False, 0, 0
            m = re.match(r'diff --git ("?a/.*?"?) ("?b/.*"?)$', row)
            if m:
                path = _unquote(m[2])
                path = path.removeprefix("b/")
        elif left_old <= 0 and left_new <= 0 and row.startswith("--- "):
            old = _unquote(row[4:].split("\t")[0])
        elif left_old <= 0 and left_new <= 0 and row.startswith("+++ "):
            new = _unquote(row[4:].split("\t")[0])
            name = old if new == "/dev/null" else new
            path = re.sub(r"^[ab]/", "", name or "")
        elif m := _HUNK.match(row):
            close()
            if strict and (left_old or left_new):
                raise ValueError(f"a hunk of {path} is cut short")
            seen = True
            left_old, line, left_new = int(m[2] or 1), int(m[3]), int(m[4] or 1)
        elif left_old > 0 or left_new > 0:
            kind, body = row[:1], row[1:]
            if kind == "\\":
                continue
            if kind in "+-" and kind:
                run = run or {"file_path": path, "start_line": line, "end_line": line, "added": [], "removed": []}
                run["added" if kind == "+" else "removed"].append(body)
                if kind == "+":
                    run["end_line"] = line
                    line += 1
                    left_new -= 1
                else:
                    left_old -= 1
            else:
                close()
                line += 1
                left_old -= 1
                left_new -= 1
            if strict and (left_old < 0 or left_new < 0):
                raise ValueError(f"a hunk of {path} is too long")
    finish()
    return out


def diff_ranges(diffs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """parse_diff over a column of diffs."""
    kind = diffs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [{id_col: i} | r for i, t in zip(pdf[id_col], pdf[text_col]) for r in parse_diff(t or "")]
            yield pd.DataFrame(rows, columns=[id_col, "file_path", "start_line", "end_line", "added", "removed"]).astype({"start_line": "Int64", "end_line": "Int64"})

    return diffs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, file_path string, start_line long, end_line long, added array<string>, removed array<string>")
