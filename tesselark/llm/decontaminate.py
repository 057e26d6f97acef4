"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the benchmark windows: `window` consecutive words of an item, or the whole
item where it is shorter.  Patterns of one length form one matcher.  Its shift table,
indexed by a hash of the last two words, says how far the window may move without
missing an occurrence; where it says zero, the bucket of that suffix hash lists the
patterns to test, their word hashes are compared and then their bytes.  Many text
segments are scanned in step, so each step is one gather over an array.

A benchmark beyond `block_bytes` is searched a block at a time, over rows that are numbered
and stored first; the result is the same for every size of block.

Edge cases: a null or empty text, or one without words, has no hits; an item without
words has no windows; items without an id are left out; an item's repeated rows are one
item; rows repeat as given, each with its own result, with or without an id; a very long
text is scanned whole, in segments; all items that hold a window tie, all are reported; an
empty table of documents or items gives no rows or no hits; columns beside id and text play
no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, bounded_batches, few, map_text, mix, pieces, stored, utf8, words

#: Bytes of benchmark text in one matcher set; larger benchmarks are searched in several passes.
BLOCK_BYTES = 16 << 20
_SEGMENT = 192


def normal(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words joined by single spaces, lower-cased."""
    return b" ".join(LOWER[data[a:b]].tobytes() for a, b in zip(start.tolist(), end.tolist()))


class Matcher:
    """Wu-Manber tables of patterns of `width` words."""

    def __init__(self, patterns: dict[bytes, tuple[np.ndarray, list[int]]], width: int):
        self.width, self.block = width, min(2, width)
        self.text = list(patterns)
        self.hashes = np.array([patterns[t][0] for t in self.text], np.uint64).reshape(len(self.text), width)
        self.items = [sorted(set(patterns[t][1])) for t in self.text]
        self.bits = max(12, int(np.ceil(np.log2(max(1, len(self.text)) * width * 8))))
        far = width - self.block + 1
        self.shift = np.full(1 << self.bits, far, np.int16)
        for j in range(self.block - 1, width):
            np.minimum.at(self.shift, self._key(self.hashes[:, : j + 1]), width - 1 - j)
        suffix = self._key(self.hashes)
        order = np.argsort(suffix, kind="stable")
        self.order, bounds = order, np.searchsorted(suffix[order], np.arange((1 << self.bits) + 1))
        self.first, self.count = bounds[:-1], np.diff(bounds)

    def _key(self, h: np.ndarray) -> np.ndarray:
        """Table index of the block that ends each row of word hashes."""
        return self._pair(h[:, -self.block], h[:, -1])

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = b if self.block == 1 else a * np.uint64(3) + b
        return (mix(x) >> np.uint64(64 - self.bits)).astype(np.int64)

    def scan(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position where it starts, pattern) of each place whose word hashes equal a pattern's."""
        w = self.width
        key = np.zeros(len(h), np.int64)
        if self.block == 1:
            key[:] = self._pair(h, h)
        elif len(h) > 1:
            key[1:] = self._pair(h[:-1], h[1:])
        lo, hi = bounds[:-1] + w - 1, bounds[1:]
        n = np.maximum(0, -(-(hi - lo) // _SEGMENT))
        row = np.repeat(np.arange(len(n)), n)
        at = lo[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * _SEGMENT
        stop = np.minimum(at + _SEGMENT, hi[row])
        stops = []
        while len(at):
            step = self.shift[key[at]]
            zero = step == 0
            if zero.any():
                stops.append(at[zero])
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not stops:
            z = np.zeros(0, np.int64)
            return z, z
        end = np.concatenate(stops)
        k, found = key[end], []
        for r in range(int(self.count[k].max(initial=0))):
            some = self.count[k] > r
            e, p = end[some], self.order[self.first[k[some]] + r]
            same = self.hashes[p, 0] == h[e - w + 1]
            for j in range(1, w):
                same &= self.hashes[p, j] == h[e - w + 1 + j]
            found.append((e[same] - w + 1, p[same]))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def matchers(item_ids: list[int], texts: list[str | None], window: int = 8) -> list[Matcher]:
    """One matcher for each pattern length that the items have."""
    data, off = utf8(pa.array(texts, pa.string()))
    s, e, h, _ = words(data, off, ALNUM)
    at = np.searchsorted(s, off)
    by_width: dict[int, dict] = {}
    for k, item in enumerate(item_ids):
        n = int(at[k + 1] - at[k])
        width = min(window, n)
        for i in range(at[k], at[k + 1] - width + 1 if n else at[k]):
            own = by_width.setdefault(width, {}).setdefault(normal(data, s[i : i + width], e[i : i + width]), (h[i : i + width], []))
            own[1].append(item)
    return [Matcher(p, w) for w, p in sorted(by_width.items())]


def search(docs: DataFrame, benchmark: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, spans array<struct<start,end>>, items array<long>) for each document row.

    Spans are the merged word ranges inside occurrences; items are those with an occurring window.
    Only a block of the benchmark of bounded size is broadcast at a time.
    """
    bench = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    size = bench.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<long>"
    if blocks == 1:
        return _pass(docs, bench, window, id_col, text_col, schema)
    rows = _numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "uid")
    found = _in_blocks(rows.select(F.struct("uid", "id").alias("k"), "t"), bench, blocks, window)
    return found.select(F.col("k.id").alias(id_col), "n_words", "spans", "items")


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of each row, stored, so that every pass sees the same numbers."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()))


def _in_blocks(rows: DataFrame, bench: DataFrame, blocks: int, window: int) -> DataFrame:
    """(k, n_words, spans, items) of rows (k, t), whose k are unique: a pass for each block of the benchmark, merged by k."""
    schema = f"k {rows.schema['k'].dataType.simpleString()}, n_words long, spans array<struct<start:long,end:long>>, items array<long>"
    every = None
    for b in range(blocks):
        one = _pass(rows, bench.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b), window, "k", "t", schema)
        every = one if every is None else every.unionByName(one)
    spans, items = F.flatten(F.collect_list("spans")), F.flatten(F.collect_list("items"))
    merged = every.groupBy("k").agg(F.max("n_words").alias("n_words"), F.sort_array(spans).alias("s"), F.array_sort(F.array_distinct(items)).alias("items"))
    last = "element_at(a, -1)"
    grown = f"concat(slice(a, 1, size(a) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, x.end))))"
    joined = f"aggregate(s, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> if(size(a) > 0 and {last}.end >= x.start, {grown}, concat(a, array(x))))"
    return merged.select("k", "n_words", F.expr(joined).alias("spans"), "items")


def _pass(docs: DataFrame, bench: DataFrame, window: int, id_col: str, text_col: str, schema: str) -> DataFrame:
    got = bench.collect()  # within block_bytes
    tables = docs.sparkSession.sparkContext.broadcast(matchers([r[0] for r in got if r[0] is not None], [r[1] for r in got if r[0] is not None], window))

    def rows(ids, data, off):
        return [ids, *scan_rows(tables.value, data, off)]

    return map_text(docs, id_col, text_col, schema, rows)


def scan_rows(tables: list[Matcher], data: np.ndarray, off: np.ndarray):
    """Word counts, merged spans and items of each row."""
    s, e, h, _ = words(data, off, ALNUM)
    bounds = np.searchsorted(s, off)
    n = len(off) - 1
    edge = np.zeros(len(s) + 1, np.int32)
    pairs: list[np.ndarray] = []
    for m in tables:
        start, pattern = m.scan(h, bounds)
        ok = [normal(data, s[a : a + m.width], e[a : a + m.width]) == m.text[p] for a, p in zip(start.tolist(), pattern.tolist())]
        start, pattern = start[ok], pattern[ok]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + m.width, -1)
        doc = np.searchsorted(bounds, start, side="right") - 1
        for p in np.unique(pattern):
            who = np.unique(doc[pattern == p])
            pairs += [np.stack([who, np.full(len(who), i)], 1) for i in m.items[p]]
    hit = np.cumsum(edge[:-1]) > 0
    change = np.empty(len(s), bool)
    if len(s):
        change[0] = hit[0]
        change[1:] = hit[1:] & ~hit[:-1]
        change[bounds[:-1][bounds[:-1] < len(s)]] |= hit[bounds[:-1][bounds[:-1] < len(s)]]
    a = np.flatnonzero(change)
    stop = np.concatenate([~hit[1:], [True]]) if len(s) else np.zeros(0, bool)
    if len(s):
        stop[bounds[1:][bounds[1:] > 0] - 1] = True
    z = np.flatnonzero(stop & hit) + 1
    doc = np.searchsorted(bounds, a, side="right") - 1
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(a - bounds[doc]), pa.array(z - bounds[doc])], names=["start", "end"]))
    both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(both[:, 0], np.arange(n + 1)).astype(np.int32)), pa.array(both[:, 1].astype(np.int64)))
    return np.diff(bounds), spans, items


def report(found: DataFrame, id_col: str = "doc_id", least_items: int = 2) -> DataFrame:
    """Counts, the digest of the items and the verdict, from search()'s rows."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        id_col, "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, with windows of fewer than `least_items` items.

    With one block of patterns rows are dropped where they are read; with several, by a join of row numbers.
    """
    bench = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null")
    size = bench.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    if size > block_bytes:
        uid = "uid"
        while uid in docs.columns:
            uid += "_"
        rows = _numbered(docs, uid)
        found = _in_blocks(rows.select(F.col(uid).alias("k"), F.col(text_col).alias("t")), bench, -(-size // block_bytes), window)
        gone = few(found.where(F.size("items") >= least_items).select(F.col("k").alias(uid)))
        return rows.join(gone, uid, "left_anti").select(*docs.columns)
    got = bench.collect()  # within block_bytes
    tables = docs.sparkSession.sparkContext.broadcast(matchers([r[0] for r in got], [r[1] for r in got], window))
    at = docs.columns.index(text_col)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(at))
            good = [len(x) < least_items for i, j in pieces(off) for x in scan_rows(tables.value, data, off[i : j + 1])[2].to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
