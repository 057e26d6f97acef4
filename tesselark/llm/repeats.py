"""Removal of repeated byte strings by bucket-pointer refinement.

A suffix array of all bytes isn't sorted; only its buckets are refined until each says
whether a window of `length` bytes occurs twice.

0. The initial buckets are those of q-grams.  Of the q-grams inside a window the one with
   the smallest hash is its anchor; equal windows have equal anchors at equal offsets, so a
   run of windows with one anchor is one record: (anchor's bucket, name of the run's bytes,
   place).  There is about one record for each 85 bytes.
1. A bucket with one record holds no repeat.  Runs whose whole bytes have one name are
   repeated throughout.  What is left differs only further away from the anchor: one record
   of each distinct run goes on, the buckets that are settled don't.
2. Refinement: every position of an open run has the bucket of its q-gram, and the bucket of
   2h bytes there is named by the pair of the buckets of h bytes at it and at the offset h
   later.  These names are made once a run and reused: by the next doubling, and for strings
   of any length, which are named by the buckets at the offsets that cover them.  A run is
   cut into shorter runs of windows at fixed offsets from the anchor; each goes to the bucket
   of (its bucket, the bucket of what all its windows share), and sorting by that brings the
   members of a refined bucket together.  The rules of step 1 apply again, with runs of 13
   windows and then with single windows, whose bucket is that of all their bytes.

Buckets are named by pairs of independent 64-bit hashes, so that no count of all buckets is
needed for a name; runs and windows are told apart by all 128 bits.

Runs that repeat within a text (a periodic one is nothing else) are merged before the
shuffle.  The initial buckets are counted by pre-aggregation, and rows meet their bucket's
count in a join that may split a hot bucket.

Edge cases: null and empty texts have no bytes; texts shorter than `length` lose none; a row
is known by its id and its text, so that rows of one id with different texts, or without an
id, are told apart; a repeated row repeats its text, so both lose it; windows never cross
texts; overlapping occurrences count; a very long text is read in overlapping parts; all
occurrences tie, none is spared; an empty table gives an empty result; columns beside id
and text play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_batches, mix, pieces, ragged, stored, utf8

GRAM = 32
#: Windows of a run at each refinement.
STEPS = (13, 1)
_PIECE = 8 << 20
#: Positions whose buckets are named at a time.
_CHUNK = 1 << 20
_RECORD = "core long, span long, span2 long, row long, twin long, at long, low int, high int, n int"
_out = pa.schema([(c, pa.int32() if kind == "int" else pa.int64()) for c, kind in (x.split() for x in _RECORD.split(", "))])


def _grams(b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    h = mix(np.arange(1 + seed, 257 + seed, dtype=np.uint64))[b]
    size = 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
        size *= 2
    return mix(h)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(b: np.ndarray, off: np.ndarray, length: int):
    """(bucket, row, anchor, first window, last window) of each run of windows with one anchor; positions in b."""
    if len(b) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = _grams(b)
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    anchor = (_smallest(key, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    n = len(b) - length + 1
    good = np.zeros(n + 1, np.int32)
    lo, hi = off[:-1], off[1:] - length + 1
    some = hi > lo
    np.add.at(good, lo[some], 1)
    np.add.at(good, hi[some], -1)
    good = np.cumsum(good[:n]) > 0
    turn = np.ones(n, bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | ~good[:-1]
    first = np.flatnonzero(good & turn)
    stop = np.ones(n, bool)
    stop[:-1] = (anchor[1:] != anchor[:-1]) | ~good[1:]
    last = np.flatnonzero(good & stop)
    at = anchor[first]
    return h[at], np.searchsorted(off, first, side="right") - 1, at, first, last


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the bucket that is refined from bucket a by bucket b at a later offset."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(0x2545F4914F6CDD1D)))


class Buckets:
    """The buckets of the positions of some bytes, by doubling from q-grams up to `most` bytes."""

    def __init__(self, b: np.ndarray, most: int):
        self.width = GRAM
        self.names = [_grams(b), _grams(b, 1000)]
        while 2 * self.width <= most:
            w = self.width
            self.names = [_pair(x[:-w], x[w:]) for x in self.names]
            self.width *= 2

    def of(self, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The buckets of `size` bytes, at least `width`, from each start: by those at the offsets that cover them."""
        out = [x[start] for x in self.names]
        done = np.full(len(start), self.width)
        for _ in range(-(-int(size.max(initial=0)) // self.width) - 1):
            more = np.flatnonzero(done < size)
            at = start[more] + np.minimum(done[more], size[more] - self.width)
            for name, x in zip(out, self.names):
                name[more] = _pair(name[more], x[at])
            done[more] += self.width
        return [_pair(name, size.astype(np.uint64)) for name in out]


def _record(core, span, span2, row, twin, at, low, high, n, covered=None) -> pa.RecordBatch:
    """A batch of records; those `covered` have no bucket, they only say that their windows repeat."""
    core = pa.array(np.asarray(core, np.uint64).view(np.int64), mask=covered)
    rest = [np.asarray(span, np.uint64).view(np.int64), np.asarray(span2, np.uint64).view(np.int64), row, twin, at, low, high, n]
    return pa.RecordBatch.from_arrays([core, *(pa.array(np.asarray(c), f.type) for c, f in zip(rest, list(_out)[1:]))], schema=_out)


def _names(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell the strings raw[start:end] apart."""
    import xxhash

    one, view = xxhash.xxh3_128_digest, memoryview(raw)
    both = np.frombuffer(b"".join([one(view[a:b]) for a, b in zip(start.tolist(), end.tolist())]), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _within(core, span, row, first, last):
    """(kept runs, how often each occurs in its text, starts and ends of the stretches that runs met before cover)."""
    order = np.lexsort((first, span, core, row))
    new = np.ones(len(order), bool)
    new[1:] = (core[order][1:] != core[order][:-1]) | (span[order][1:] != span[order][:-1]) | (row[order][1:] != row[order][:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = np.sort(order[~new])
    if not len(again):
        return order[new], count, again, again, again
    a, z, r = first[again], last[again], row[again]
    cut = np.ones(len(again), bool)
    cut[1:] = (a[1:] > z[:-1] + 1) | (r[1:] != r[:-1])
    return order[new], count, r[cut], a[cut], z[np.append(np.flatnonzero(cut)[1:], len(again)) - 1]


def _first_records(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(2))
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, j in pieces(off):
                lo, hi = int(off[i]), int(off[j])
                for start in range(lo, max(hi - length + 1, lo + 1), _PIECE):  # a very long text in overlapping parts
                    end = min(start + _PIECE + length - 1, hi)
                    b = data[start:end]
                    own = np.clip(off[i : j + 1], start, end) - start
                    core, row, at, first, last = runs(b, own, length)
                    if not len(first):
                        continue
                    span, span2 = _names(b.tobytes(), first, last + length)
                    begin = off[i:j] - start
                    k, n, r, a, z = _within(core, span, row, first, last)
                    yield _record(core[k], span[k], span2[k], ids[i:j][row[k]], twins[i:j][row[k]], (at - begin[row])[k], (at - last)[k], (at - first)[k], n)
                    if len(r):
                        none = np.zeros(len(r), np.uint64)
                        yield _record(none, none, none, ids[i:j][r], twins[i:j][r], a - begin[r], a - z, np.zeros(len(r)), np.ones(len(r)), np.ones(len(r), bool))

    return docs.mapInArrow(run, _RECORD)


def _cut(b: np.ndarray, begin: np.ndarray, core: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, length: int):
    """The shorter runs of some runs, whose bytes begin in b at `begin`: (run, bucket, name, second name, low, high)."""
    first = low // step
    count = high // step - first + 1
    k = np.repeat(np.arange(len(low)), count)
    c = ragged(first, count)
    near, far = np.maximum(low[k], c * step), np.minimum(high[k], c * step + step - 1)
    buckets = Buckets(b, length - step + 1)
    zero = begin + high  # where the run's anchor lies in b
    one, two = buckets.of(zero[k] - far, far - near + length)
    if step == 1:
        return k, one, two, np.zeros(len(k), np.uint64), near, far
    shared = buckets.of(zero[k] - c * step, np.full(len(k), length - step + 1))[0]
    return k, _pair(_pair(core[k], shared), c.astype(np.uint64)), one, two, near, far


def _refine(placed: DataFrame, open_: DataFrame, step: int, length: int) -> DataFrame:
    """Records of runs of `step` windows out of the open ones; needs the texts' q-grams."""
    lists = open_.groupBy("row", "twin").agg(F.collect_list(F.struct("core", "at", "low", "high")).alias("runs"))
    joined = placed.join(lists, ["row", "twin"]).select("row", "twin", "id", "text", "runs")  # all columns: one exchange of the texts is reused

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(3))
            runs_ = batch.column(4)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(runs_.offsets.to_numpy()))
            fields = runs_.flatten()
            core, at, low, high = (pc_field(fields, name) for name in ("core", "at", "low", "high"))
            core = core.view(np.uint64)
            rows, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            start, size = off[owner] + at - high, high - low + length
            for i, j in pieces(np.concatenate([[0], np.cumsum(size)]), _CHUNK):
                b = data[ragged(start[i:j], size[i:j])]
                begin = np.cumsum(size[i:j]) - size[i:j]
                k, c, span, span2, near, far = _cut(b, begin, core[i:j], low[i:j], high[i:j], step, length)
                who = owner[i:j][k]
                yield _record(c, span, span2, rows[who], twins[who], at[i:j][k], near, far, np.ones(len(k)))

    return joined.mapInArrow(run, _RECORD)


def pc_field(records: pa.StructArray, name: str) -> np.ndarray:
    return records.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


_COVER = ("row", "twin", "at", "low", "high")
_NAME = ("span", "span2")


def _first_buckets(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated runs, open runs) of the initial buckets: those with more than one record.

    Buckets are counted with map-side aggregation and joined back, which lets Spark split a hot one.
    """
    own = records.where("core is null or n > 1").select(*_COVER)
    buckets = records.where("core is not null").groupBy("core").agg(F.count("*").alias("m"), *(f(c).alias(f"{c}_{n}") for c in _NAME for f, n in ((F.min, "a"), (F.max, "b"))))
    buckets = buckets.where("m > 1").select("core", F.expr("span_a = span_b and span2_a = span2_b").alias("one"))
    met = stored(records.join(buckets, "core"))
    kinds = stored(met.where("not one").groupBy("core", *_NAME).agg(F.count("*").alias("m"), F.min(F.struct(*_COVER)).alias("x")))
    again = met.where("not one").join(kinds.where("m > 1").select("core", *_NAME), ["core", *_NAME])
    done = own.unionByName(met.where("one").select(*_COVER)).unionByName(again.select(*_COVER))
    return done, kinds.select("core", "x.*")


def _later_buckets(records: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """The same for refined buckets, which hold one record of each distinct run; over a single exchange."""
    bucket, kind = Window.partitionBy("core"), Window.partitionBy("core", *_NAME)
    x = records.repartition(slots, "core").withColumn("m", F.count("*").over(bucket))
    x = x.withColumn("k", F.count("*").over(kind)).withColumn("r", F.row_number().over(kind.orderBy("row", "twin", "at", "low"))).where("m > 1")
    return x.where("k > 1").select(*_COVER), x.where("k < m and r = 1").select("core", *_COVER)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, n_bytes, spans array<struct<start,end>>, kept binary) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if length < GRAM:
        raise ValueError(f"length is below {GRAM}")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(id_col)
    rows = docs.select(F.coalesce(key, F.xxhash64(text, F.lit(1))).alias("row"), F.xxhash64(text).alias("twin"), F.col(id_col).alias("id"), text.alias("text"))
    done, open_ = _first_buckets(stored(_first_records(rows.select("row", "twin", "text").where(F.octet_length("text") >= length), length)))
    placed = rows.repartition(slots, "row", "twin")  # one shuffle of the texts serves both refinements and the result
    for step in STEPS:
        if length - step + 1 < GRAM:
            continue
        more, open_ = _later_buckets(_refine(placed, open_, step, length), slots)
        done = done.unionByName(more)
    cover = done.select("row", "twin", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
    spans = cover.groupBy("row", "twin").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = placed.join(spans, ["row", "twin"], "left").select("row", "twin", "id", "text", "spans")
    schema = f"{id_col} {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def cut(batches):
        for batch in batches:
            data, off = utf8(batch.column(3))
            lists = batch.column(4)
            kept, found = [], []
            for k in range(batch.num_rows):
                b = data[off[k] : off[k + 1]]
                own = lists[k].as_py()
                if not own:
                    kept.append(b.tobytes())
                    found.append([])
                    continue
                edge = np.zeros(len(b) + 1, np.int32)
                np.add.at(edge, [s["start"] for s in own], 1)
                np.add.at(edge, [s["end"] for s in own], -1)
                gone = np.cumsum(edge[:-1]) > 0
                flank = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                found.append([{"start": int(a), "end": int(z)} for a, z in zip(np.flatnonzero(flank == 1), np.flatnonzero(flank == -1))])
                kept.append(b[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(np.diff(off)), pa.array(found, out[2].type), pa.array(kept, pa.binary())], schema=out)

    return joined.mapInArrow(cut, schema)
