"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs, pairs that skip a
word, and the leading bytes of longer words (so that inflected forms share a feature).
Each coordinate has its own learning rate, and the L1 term keeps a weight at exactly zero
until its evidence exceeds it; what remains is small enough to broadcast.  A text's score
is the logistic function of its non-zero weights' sum.

Edge cases: a null or empty text has the bias alone as its score; labels without a
document, null labels and null ids are ignored; one document with several labels is
learned from once per row, repeated rows of a document as often as they are; rows are scored
one by one, repeated ones alike; a very long text is read whole; a score of exactly the
limit (a tie) counts as toxic; without labels every score is that of the bias, one half; an
empty table of documents gives an empty result; columns beside id and text play no part,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, bounded_batches, map_text, mix, pieces, utf8, words

DIMENSIONS_LOG2 = 20
#: Labelled rows that are learned from at most: those with the smallest hash of their id.
TRAIN_ROWS = 10_000
PREFIXES = (4, 5)
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 8.0, 0.1, 4


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of each feature occurrence."""
    s, _, h, pre = words(data, off, ALNUM, prefixes=PREFIXES)
    row = np.searchsorted(off, s, side="right") - 1
    rows, values = [row], [mix(h + np.uint64(1))]
    for gap in (1, 2):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            values.append(mix(h[:-gap][same] * np.uint64(3) + h[gap:][same] + np.uint64(gap << 8)))
    for p in pre:
        some = p != 0
        rows.append(row[some])
        values.append(p[some])
    return np.concatenate(rows), (np.concatenate(values) >> np.uint64(64 - DIMENSIONS_LOG2)).astype(np.int64)


def learn(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (coordinates, label); returns the non-zero coordinates, their weights and the bias."""
    size = (1 << DIMENSIONS_LOG2) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == bias, 0.0, L1)
        out = -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= l1, 0.0, out)

    for _ in range(PASSES):
        for at, label in examples:
            at = np.append(at, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1])


def held_out(id_col) -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False)) if isinstance(id_col, str) else id_col


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS):
    """Weights from a bounded sample of the labelled rows that are not held out."""
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").where(~held_out("i"))
    marks = marks.orderBy(F.xxhash64("i"), "i", "y").limit(rows)
    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(marks), "i")  # at most `rows` rows

    def each(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            for k in range(batch.num_rows):
                _, at = features(data, off[k : k + 2])
                at = np.unique(at).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), pa.array([at.tobytes()], pa.binary())], names=["i", "y", "at"])

    kind = docs.schema[id_col].dataType.simpleString()
    sparse = found.select("i", "t", "y").mapInArrow(each, f"i {kind}, y int, at binary")

    def fit(batches):
        got = [(repr(i), y, a) for b in batches for i, y, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        order = np.random.default_rng(7).permutation(len(got))
        got.sort()
        at, w, bias = learn([(np.frombuffer(got[k][2], np.int32).astype(np.int64), got[k][1]) for k in order])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], names=["at", "w"])

    model = sparse.repartition(1).mapInArrow(fit, "at long, w double").collect()  # 2**20 weights at most
    at, w = (np.array([r[k] for r in model], d) for k, d in ((0, np.int64), (1, np.float64)))
    return at[at >= 0], w[at >= 0], float(w[at < 0].sum())


def scorer(model):
    """score(data, offsets) for the model's weights."""
    at, w, bias = model
    dense = np.zeros(1 << DIMENSIONS_LOG2, np.float64)
    dense[at] = w

    def score(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, f = features(data, off)
        some = dense[f] != 0
        key = np.unique(row[some] << DIMENSIONS_LOG2 | f[some])
        total = bias + np.bincount(key >> DIMENSIONS_LOG2, dense[key & ((1 << DIMENSIONS_LOG2) - 1)], len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    return score


_scorers: dict = {}


def _scorer(shared):
    if shared.id not in _scorers:
        _scorers.clear()
        _scorers[shared.id] = scorer(shared.value)
    return _scorers[shared.id]


class _Shared:
    """A broadcast model with an id to cache by."""

    def __init__(self, spark, model):
        import uuid

        self.id, self.b = uuid.uuid4().hex, spark.sparkContext.broadcast(model)

    @property
    def value(self):
        return self.b.value


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    shared = _Shared(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(ids, data, off):
        return [ids, _scorer(shared)(data, off)]

    got = map_text(docs, id_col, text_col, f"{id_col} {kind}, score double", rows)
    return got.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the limit."""
    shared = _Shared(docs.sparkSession, model)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(at))
            good = np.concatenate([_scorer(shared)(data, off[i : j + 1]) < limit for i, j in pieces(off)]) if batch.num_rows else np.zeros(0, bool)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
