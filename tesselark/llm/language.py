"""Language identification by a small byte convolutional network, trained in numpy.

A text is cut into fixed windows of bytes.  Byte embeddings pass through filters of
several widths, each filter's largest response in the window is kept, and a softmax over
those gives the window's language.  A text's language is that of its windows' mean log
probability, each weighted by the bytes that it holds.  For scoring, embedding and filters
are folded into tables that are indexed by a byte or a pair of bytes, so a window costs
five gathers per position.

Learning is from a bounded sample: about `docs_each` documents of each language, those with
the smallest hash of their id, and `windows_each` windows of each, spread evenly over it.

Edge cases: `und` with score 0 for a null text or one without a letter; a text of any
length is read whole, a few hundred windows at a time; null languages, texts and ids aren't
learned from; without labelled rows every text is `und`; repeated rows are scored alike, and
learned from as often as they are; languages with one score tie for the first by name; an
empty table gives an empty result; columns other than id, text and lang play no part,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, map_text, utf8
from .toxicity import _Shared, held_out

WINDOW, EMBED, FILTERS, WIDTHS = 128, 8, 8, (2, 3, 4)
#: Documents of each language that are learned from, about; those with the smallest hash of their id.
TRAIN_DOCS_EACH = 600
#: Windows of each such document.
TRAIN_WINDOWS_EACH = 6
EPOCHS, BATCH, RATE = 4, 64, 0.01


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, row, number of bytes) of each window of the rows."""
    n = -(-np.diff(off) // WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    start = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    return start, row, np.minimum(off[1:][row] - start, WINDOW)


def contents(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The windows as a byte matrix, padded with zeros."""
    if not len(start):
        return np.zeros((0, WINDOW), np.uint8)
    x = data[np.minimum(start[:, None] + np.arange(WINDOW), len(data) - 1)]
    x[np.arange(WINDOW) >= size[:, None]] = 0
    return x


class Network:
    """Parameters, Adam training and fast scoring."""

    def __init__(self, classes: list[str], parameters: list[np.ndarray] | None = None):
        self.classes = classes
        r = np.random.default_rng(11)
        self.p = parameters or [
            r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            *(r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS),
            np.zeros(len(WIDTHS) * FILTERS, np.float32),
            r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32),
            np.zeros(len(classes), np.float32),
        ]

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        r = np.random.default_rng(5)
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for k in range(0, len(x), BATCH):
                t += 1
                for i, g in enumerate(self._gradients(x[order[k : k + BATCH]], y[order[k : k + BATCH]])):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.p[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        table, *filters, bias, out, shift = self.p
        b = len(x)
        emb = table[x]
        pooled, where, patches = [], [], []
        for w, f in zip(WIDTHS, filters):
            n = WINDOW - w + 1
            z = sum((emb[:, j : j + n] @ f[j * EMBED : (j + 1) * EMBED] for j in range(w)), np.float32(0))
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
            where.append(at)
        pre = np.concatenate(pooled, 1) + bias
        act = np.maximum(pre, 0)
        z = act @ out + shift
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(b), y] -= 1
        p /= b
        d = (p @ out.T) * (pre > 0)
        g_table, g_filters = np.zeros_like(table), []
        for i, (w, f) in enumerate(zip(WIDTHS, filters)):
            own = d[:, i * FILTERS : (i + 1) * FILTERS]
            spots = where[i][:, :, None] + np.arange(w)
            codes = x[np.arange(b)[:, None, None], spots]
            patches = table[codes].reshape(b, FILTERS, w * EMBED)
            g_filters.append(np.einsum("bf,bfk->kf", own, patches))
            back = (own[:, :, None] * f.T[None]).reshape(b, FILTERS, w, EMBED)
            np.add.at(g_table, codes.ravel(), back.reshape(-1, EMBED))
        return [g_table, *g_filters, d.sum(0), act.T @ p, p.sum(0)]

    def fold(self) -> None:
        """Tables of what a byte, or a pair, adds to each filter."""
        table, *filters, _, _, _ = self.p
        one = lambda f, j: table @ f[j * EMBED : (j + 1) * EMBED]
        two = lambda f, j: (one(f, j)[:, None] + one(f, j + 1)[None]).reshape(65536, FILTERS)
        self.tables = [[(j, two(f, j) if j + 1 < w else one(f, j)) for j in range(0, w, 2)] for w, f in zip(WIDTHS, filters)]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        *_, bias, out, shift = self.p
        pooled = []
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        for w, parts in zip(WIDTHS, self.tables):
            n, z = WINDOW - w + 1, None
            for j, t in parts:
                got = t.take(pair[:, j : j + n] if len(t) > 256 else x[:, j : j + n], axis=0)
                z = got if z is None else np.add(z, got, out=z)
            pooled.append(z.max(1))
        z = np.maximum(np.concatenate(pooled, 1) + bias, 0) @ out + shift
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, probability) of each row; rows without bytes get class 0."""
        start, row, left = windows(off)
        total = np.zeros((len(off) - 1, len(self.classes)))
        for k in range(0, len(start), 512):
            x = contents(data, start[k : k + 512], left[k : k + 512])
            np.add.at(total, row[k : k + 512], self.log_probabilities(x) * left[k : k + 512, None])
        total /= np.maximum(np.diff(off), 1)[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = TRAIN_DOCS_EACH, windows_each: int = TRAIN_WINDOWS_EACH
) -> tuple[list[str], list[np.ndarray]] | None:
    """(languages, parameters) from a bounded sample of the documents that are not held out."""
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    known = known.where("l is not null and t is not null and i is not null").where(~held_out("i"))
    counts = few(known.groupBy("l").agg(F.count("*").alias("n")), 100_000)
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.join(counts, "l").where(draw < docs_each / F.col("n"))
    per = windows_each

    def cut(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            start, row, left = windows(off)
            keep = []
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for k in range(batch.num_rows):
                a, b = first[k], first[k + 1]
                keep += sorted({int(a + (b - a) * j // per) for j in range(per)}) if b > a else []
            x = contents(data, start[keep], left[keep])
            own = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column(2).take(own), batch.column(0).take(own), pa.array([y.tobytes() for y in x], pa.binary())], names=["l", "i", "x"])

    def fit(batches):
        got = sorted((l, repr(i), k) for b in batches for l, i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        classes = sorted({g[0] for g in got})
        net = Network(classes)
        if got:
            number = {c: k for k, c in enumerate(classes)}
            net.train(np.stack([np.frombuffer(g[2], np.uint8) for g in got]), np.array([number[g[0]] for g in got]))
        for p in net.p:
            yield pa.RecordBatch.from_arrays([pa.array([classes], pa.list_(pa.string())), pa.array([list(p.shape)], pa.list_(pa.int64())), pa.array([p.tobytes()], pa.binary())], names=["classes", "shape", "data"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = picked.select("i", "t", "l").mapInArrow(cut, f"l string, i {kind}, x binary")
    model = sample.repartition(1).mapInArrow(fit, "classes array<string>, shape array<long>, data binary").collect()
    return (list(model[0][0]), [np.frombuffer(r[2], np.float32).reshape(r[1]).copy() for r in model]) if model and model[0][0] else None


_networks: dict = {}


def _network(shared) -> Network:
    if shared.id not in _networks:
        _networks.clear()
        net = Network(*shared.value)
        net.fold()
        _networks[shared.id] = net
    return _networks[shared.id]


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    letters = docs.select(F.col(id_col), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))
    if model is None:
        return letters.select(id_col, held_out(id_col).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = _Shared(docs.sparkSession, model)

    def rows(ids, data, off):
        net = _network(shared)
        who, p = net.predict(data, off)
        some = np.diff(off) > 0
        return [ids, [net.classes[k] if ok else "und" for k, ok in zip(who.tolist(), some.tolist())], np.where(some, p, 0.0)]

    got = map_text(letters, id_col, "text", f"{id_col} {kind}, lang_pred string, score double", rows)
    return got.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
