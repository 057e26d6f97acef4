"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every text.  The votes of all
documents are counted by pattern (seven labellers have at most 3**7 patterns, whatever the
corpus), and expectation-maximisation over those counts estimates how often each labeller
gives each vote to good and to bad texts.  A pattern's posterior then labels a bounded
sample of documents, on which a logistic scorer over hashed features is trained: words,
word shapes (runs of upper-case, lower-case, digits and each symbol), pairs of shapes and
repeated neighbours, as shares of the text.  The scorer is applied to every document.

Edge cases: a null or empty text has only abstentions, the share as posterior and the bias
as score; an empty table gives an empty result, and a model that knows no pattern; repeated
rows are counted and learned from as often as they are, and scored alike; rows with a null id
are counted and scored, but not learned from; a very long text is read whole; a score of
exactly one half (a tie) counts as good; columns beside id and text play no part, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, map_text, mix, per_row, utf8, words
from .quality import STOP_WORDS
from .toxicity import _Shared

LABELLERS = ("symbols", "capitals", "repetition", "stop_words", "sentences", "neighbours", "word_length")
DIMENSIONS_LOG2 = 18
#: Documents that the scorer is trained on at most: those with the smallest hash of their id.
TRAIN_DOCS = 6_000
PASSES, RATE, L2 = 4, 0.5, 1e-6

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]~^=_\\@"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")
_SHAPE[[9, 10, 11, 12, 13]] = 32


def _stop_hashes() -> np.ndarray:
    data, off = utf8(pa.array(list(STOP_WORDS)))
    return np.unique(words(data, off, NOT_SPACE)[2])


def votes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of votes for each text: 1 good, 0 bad, -1 abstains."""
    s, e, h, _ = words(data, off, NOT_SPACE)
    bounds = np.searchsorted(s, off)
    n = np.diff(bounds)
    lo, hi = int(off[0]), int(off[-1])
    b = data[lo:hi]
    share = lambda x, y: np.divide(x, y, out=np.zeros(len(x)), where=y > 0)
    symbols = share(per_row(_SYMBOL[b], off - lo).astype(float), n)
    capitals = share(per_row(_UPPER[b], off - lo).astype(float), per_row(_LETTER[b], off - lo))
    ends = share(per_row(_STOP[b], off - lo).astype(float), n)
    length = share(per_row(e - s, bounds).astype(float), n)
    stop = share(per_row(np.isin(h, _stop_hashes()), bounds).astype(float), n)
    row = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    neighbours = share(per_row(same, bounds).astype(float), n)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = share(np.bincount(row[order][new], minlength=len(n)).astype(float), n)
    long_ = n >= 20

    def vote(good, bad):
        return np.where(n == 0, -1, np.where(bad, 0, np.where(good, 1, -1)))

    return np.stack([
        vote(symbols < 0.02, symbols > 0.2),
        vote(capitals < 0.3, capitals > 0.6),
        vote(long_ & (distinct > 0.4), long_ & (distinct < 0.12)),
        vote(stop > 0.1, long_ & (stop < 0.03)),
        vote((ends > 0.02) & (ends < 0.25), long_ & ((ends > 0.5) | (ends == 0))),
        vote(long_ & (neighbours < 0.02), long_ & (neighbours > 0.1)),
        vote((length >= 3) & (length <= 9), (length < 2) | (length > 14)),
    ], 1)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(share of each class, P(vote | class) by labeller, class and vote) by expectation-maximisation.

    Class 0 is good text.  Bad text is of several kinds, and most labellers call most kinds
    good; so there is one class of bad text for each labeller, which starts as what that
    labeller calls bad.  P(vote bad | 0) and P(vote bad | the others) are its accuracies.
    """
    keys = sorted(patterns)
    n = len(LABELLERS)
    v = np.array(keys, np.int64).reshape(len(keys), n) + 1
    c = np.array([patterns[k] for k in keys], float)
    share = np.array([0.8] + [0.2 / n] * n)
    table = np.empty((n, n + 1, 3))
    for k in range(n):
        marginal = np.bincount(v[:, k], c, 3) + 1.0
        table[k] = marginal / marginal.sum()
        table[k, 0] = (0.1, 0.02, 0.88)
        table[k, k + 1] = (0.05, 0.9, 0.05)
    for _ in range(rounds if len(keys) else 0):
        w = _responsibility(v - 1, share, table) * c[:, None]
        share = (w.sum(0) + 1e-3) / (w.sum() + 1e-3 * (n + 1))
        for k in range(n):
            for y in range(n + 1):
                counts = np.bincount(v[:, k], w[:, y], 3) + 0.5
                table[k, y] = counts / counts.sum()
    return share, table


def _responsibility(v: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    z = np.tile(np.log(share), (len(v), 1))
    for k in range(v.shape[1]):
        z += np.where((v[:, k] < 0)[:, None], 0.0, np.log(table[k])[:, v[:, k] + 1].T)
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def posterior(v: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """P(good) of each row of votes; abstentions say nothing."""
    return _responsibility(v, share, table)[:, 0]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate, value): hashed features as roots of their share of the text's words."""
    s, _, h, _ = words(data, off, NOT_SPACE)
    row = np.searchsorted(off, s, side="right") - 1
    lo, hi = int(off[0]), int(off[-1])
    kind = _SHAPE[data[lo:hi]]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    cuts = off[:-1] - lo
    keep[cuts[cuts < len(kind)]] = True
    short = np.concatenate([[0], np.cumsum(keep)])[off - lo]
    shape = words(kind[keep], short, NOT_SPACE)[2]
    rows, values = [row, row], [mix(h + np.uint64(11)), mix(shape + np.uint64(12))]
    if len(h) > 1:
        next_ = row[1:] == row[:-1]
        twin = next_ & (h[1:] == h[:-1])
        rows += [row[1:][next_], row[1:][twin]]
        values += [mix(shape[:-1][next_] * np.uint64(3) + shape[1:][next_] + np.uint64(13)), np.full(int(twin.sum()), 0x9E3779B97F4A7C15, np.uint64)]
    at = np.concatenate(values) >> np.uint64(64 - DIMENSIONS_LOG2)
    key, count = np.unique(np.concatenate(rows).astype(np.int64) << DIMENSIONS_LOG2 | at.astype(np.int64), return_counts=True)
    row_of = key >> DIMENSIONS_LOG2
    n = np.bincount(row, minlength=len(off) - 1)
    return row_of, key & ((1 << DIMENSIONS_LOG2) - 1), np.sqrt(count / n[row_of])


def fit(examples: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic regression with adaptive rates on soft labels."""
    w, g2, bias, b2 = np.zeros(1 << DIMENSIONS_LOG2), np.full(1 << DIMENSIONS_LOG2, 1e-6), 0.0, 1e-6
    for _ in range(PASSES):
        for at, x, y in examples:
            d = 1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -35, 35))) - y
            g = d * x + L2 * w[at]
            g2[at] += g * g
            w[at] -= RATE * g / np.sqrt(g2[at])
            b2 += d * d
            bias -= RATE * d / np.sqrt(b2)
    return w, float(bias)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_DOCS):
    """(class shares, vote tables, weights, bias)."""
    names = ", ".join(f"{x} int" for x in LABELLERS)

    def each(ids, data, off):
        return [*votes(data, off).T]

    counted = map_text(docs, id_col, text_col, names, lambda ids, data, off: each(ids, data, off)).groupBy(*LABELLERS).count()
    patterns = {tuple(r[:-1]): r[-1] for r in counted.collect()}  # 3**7 rows at most
    share, table = estimate(patterns)
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null")
    ids = sample.select("i").orderBy(F.xxhash64("i"), "i").limit(rows)
    picked = sample.join(F.broadcast(ids.distinct()), "i")  # at most `rows` ids

    def learn(batches):
        got = []
        for batch in batches:
            data, off = utf8(batch.column(1))
            for k in range(batch.num_rows):
                _, at, x = features(data, off[k : k + 2])
                got.append((repr(batch.column(0)[k].as_py()), at, x, float(posterior(votes(data, off[k : k + 2]), share, table)[0])))
        got.sort(key=lambda g: g[0])
        order = np.random.default_rng(3).permutation(len(got))
        w, bias = fit([got[k][1:] for k in order])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], names=["at", "w"])

    model = picked.repartition(1).mapInArrow(learn, "at long, w double").collect()  # 2**18 weights at most
    at, w = (np.array([r[k] for r in model], d) for k, d in ((0, np.int64), (1, np.float64)))
    return share, table, at[at >= 0], w[at >= 0], float(w[at < 0].sum())


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, posterior, score, predicted, kept) of every document; 1 is good."""
    shared = _Shared(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()
    dense: dict = {}

    def rows(ids, data, off):
        share, table, at, w, bias = shared.value
        if "w" not in dense:
            dense["w"] = np.zeros(1 << DIMENSIONS_LOG2)
            dense["w"][at] = w
        row, f, x = features(data, off)
        z = bias + np.bincount(row, dense["w"][f] * x, len(off) - 1)
        return [ids, posterior(votes(data, off), share, table), 1 / (1 + np.exp(-np.clip(z, -35, 35)))]

    got = map_text(docs, id_col, text_col, f"{id_col} {kind}, posterior double, score double", rows)
    good = F.col("score") >= 0.5
    return got.select(id_col, "posterior", "score", good.cast("int").alias("predicted"), good.alias("kept"))
