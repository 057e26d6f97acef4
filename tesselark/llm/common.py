"""Shared helpers: Arrow text access, vectorised word hashing and checkpointing.

Text is handled as UTF-8 bytes straight from the Arrow buffers, in pieces of about a
megabyte; a single longer text is a piece of its own, so that temporary arrays are bounded
by that or by a small multiple of the longest text, not by a batch.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

PIECE = 1 << 20
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_powers: list[np.ndarray] = []
_tables: list[str] = []

#: White space of the operators' contracts: space and \t\n\v\f\r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: the session's own folder, or one made here in local mode where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared checkpoint folder and read again: lineage ends here.

    The table outlives lost executors; it is deleted by release(), or when the driver exits.
    """
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(release, spark)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables() -> int:
    """How many stored tables there are."""
    return len(_tables)


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the stored tables from number `first` to before `last`, whose rows nothing reads any more."""
    for k in range(first, len(_tables) if last is None else last):
        if _tables[k]:
            _delete(spark, _tables[k])
            _tables[k] = ""


def few(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, stored and counted, with a broadcast hint if it has at most `rows` rows; for narrow rows such as ids.

    A join against it then needs no shuffle of the other side; beyond the bound it is shuffled.
    """
    from pyspark.sql import functions as F

    kept = stored(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def one_text_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the documents with an id: one row each, with the greatest text where rows of an id differ."""
    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    again = few(rows.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id"))
    if again.isEmpty():
        return rows
    merged = rows.join(again, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    return rows.join(again, "id", "left_anti").unionByName(merged)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Let no Arrow batch of this session exceed `most` bytes, however long its rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > most:
        spark.conf.set(key, str(most))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, PIECE + 1)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, r, np.uint64), dtype=np.uint64)]) for r in (_ROOT, _INV)]
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, fold: np.ndarray = LOWER, prefixes: tuple[int, ...] = ()):
    """Start, end and 64-bit hash of each maximal run of `letters` bytes within each row, in order.

    The last item holds, for each length in `prefixes`, the hash of the word's first bytes
    (0 where the word is no longer than that).
    """
    out, lo, hi = [], int(offsets[0]), int(offsets[-1])
    while lo < hi:
        end = min(lo + PIECE, hi)
        if end < hi:  # cut between words, or after a row
            row = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
            gap = np.flatnonzero(~letters[data[max(lo, end - 4096) : end]])
            if row > lo:
                end = row
            elif len(gap):
                end = max(lo, end - 4096) + int(gap[-1]) + 1
            else:
                stop = int(offsets[np.searchsorted(offsets, end, side="left")])
                at = end
                while at < stop:
                    gap = np.flatnonzero(~letters[data[at : min(at + PIECE, stop)]])
                    if len(gap):
                        at += int(gap[0]) + 1
                        break
                    at = min(at + PIECE, stop)
                end = at
        b = data[lo:end]
        mask = letters[b]
        cuts = offsets[np.searchsorted(offsets, lo, side="left") : np.searchsorted(offsets, end, side="right")] - lo
        before = np.empty(len(b), bool)
        before[0] = False
        before[1:] = mask[:-1]
        before[cuts[cuts < len(b)]] = False
        after = np.empty(len(b), bool)
        after[-1] = False
        after[:-1] = mask[1:]
        after[cuts[cuts > 0] - 1] = False
        s, e = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
        p, q = powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((fold[b].astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=total[1:])
        inv = q[s]
        first = total[s]
        h = mix((total[e] - first) * inv + (e - s).astype(np.uint64))
        pre = [np.where(e - s > k, mix((total[np.minimum(s + k, len(b))] - first) * inv + np.uint64(7919 * k)), np.uint64(0)) for k in prefixes]
        out.append((s + lo, e + lo, h, *pre))
        lo = end
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for _ in prefixes]
    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
    return cols[0], cols[1], cols[2], cols[3:]


def per_row(counts_at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `counts_at` between consecutive `bounds`."""
    total = np.concatenate([[0], np.cumsum(counts_at)])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i], ..., start[i]+length[i]-1 for each i, end to end."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def map_text(df: DataFrame, id_col: str, text_col: str, schema: str, rows: Callable) -> DataFrame:
    """rows(ids, data, offsets) -> list of Arrow arrays, called on pieces of a partition."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bounded_batches(df.sparkSession)

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            ids = batch.column(0)
            for i, j in pieces(off):
                cols = rows(ids.slice(i, j - i), data, off[i : j + 1])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
