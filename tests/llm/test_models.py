"""The fitted operators against plain forms of their methods, and every query with SQL against DuckDB."""

import glob
import math
import os

import numpy as np
import pytest

pytest.importorskip("tesselark.llm.queries")
DATA = "/root/testdata/sf0.001"


def test_ftrl_equals_the_plain_update():
    """Per-coordinate z and n, weights from them, one example at a time, in dictionaries."""
    from tesselark.llm import toxicity as t

    r = np.random.default_rng(1)
    examples = []
    for _ in range(150):
        label = int(r.integers(2))
        at = np.unique(r.integers(0, 40, 12) + (40 if label else 0) * (r.random(12) < 0.5))
        examples.append((at.astype(np.int64), label))
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == "bias" else t.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((t.BETA + math.sqrt(n[i])) / t.ALPHA + t.L2)

    for _ in range(t.PASSES):
        for at, label in examples:
            ids = [*at.tolist(), "bias"]
            w = {i: weight(i) for i in ids}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in ids:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / t.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    at, w, bias = t.learn(examples)
    assert at.tolist() == sorted(want) and np.allclose(w, [want[i] for i in sorted(want)]) and abs(bias - weight("bias")) < 1e-9
    assert 0 < len(want) < len(z)  # L1 leaves some at zero


def test_skip_grams_and_n_grams_are_features():
    from tesselark.llm import toxicity as t
    from tesselark.llm.common import utf8

    def of(*texts):
        import pyarrow as pa

        data, off = utf8(pa.array(texts))
        row, at = t.features(data, off)
        return [set(at[row == k].tolist()) for k in range(len(texts))]

    a, b, c, d = of("ab cd ef", "ab xx ef", "AB CD", "ef ab")
    assert c < a and len(a) == 3 + 2 + 1 and len(a & b) == 3  # two words and the pair that skips one
    assert len(a & d) == 2  # pairs are ordered


def test_network_equals_plain_convolution():
    """Embedding, filters at every place, the largest response, rectified, softmax; by loops."""
    from tesselark.llm import language as n

    r = np.random.default_rng(2)
    net = n.Network(["aa", "bb", "cc"])
    net.p[-3] += r.normal(0, 0.1, net.p[-3].shape).astype(np.float32)
    net.fold()
    text = bytes(r.integers(32, 127, 300).astype(np.uint8))
    data, off = np.frombuffer(text, np.uint8), np.array([0, 300])
    table, *filters, bias, out, shift = [p.astype(float) for p in net.p]
    total, size = np.zeros(3), 0
    for lo in range(0, 300, n.WINDOW):
        own = text[lo : lo + n.WINDOW]
        x = [*own, *[0] * (n.WINDOW - len(own))]
        pooled = []
        for w, f in zip(n.WIDTHS, filters):
            best = np.full(n.FILTERS, -np.inf)
            for k in range(n.WINDOW - w + 1):
                best = np.maximum(best, sum(table[x[k + j]] @ f[j * n.EMBED : (j + 1) * n.EMBED] for j in range(w)))
            pooled.append(best)
        z = np.maximum(np.concatenate(pooled) + bias, 0) @ out + shift
        z -= np.log(np.exp(z - z.max()).sum()) + z.max()
        total += z * len(own)
        size += len(own)
    p = np.exp(total / size)
    p /= p.sum()
    who, score = net.predict(data, off)
    assert who[0] == p.argmax() and abs(score[0] - p.max()) < 1e-4


def test_gradients_equal_differences():
    from tesselark.llm import language as n

    r = np.random.default_rng(3)
    net = n.Network(["aa", "bb"])
    net.p = [p.astype(np.float64) for p in net.p]
    x, y = r.integers(0, 256, (4, n.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        net.fold()
        return -net.log_probabilities(x)[np.arange(4), y].mean()

    for p, g in zip(net.p, net._gradients(x, y)):
        for _ in range(4):
            at = tuple(int(r.integers(s)) for s in p.shape) if p is not net.p[0] else (int(x[0, r.integers(n.WINDOW)]), int(r.integers(n.EMBED)))
            old, e = p[at], 1e-6
            p[at] = old + e
            up = loss()
            p[at] = old - e
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 1e-4


def test_expectation_maximisation_equals_loops():
    """The same start and smoothing, one document at a time."""
    from tesselark.llm import weaklabels as w

    r = np.random.default_rng(4)
    n = len(w.LABELLERS)
    rows = [tuple(int(x) for x in r.choice([-1, 0, 1], n, p=[0.2, 0.2, 0.6])) for _ in range(60)]
    patterns = {}
    for x in rows:
        patterns[x] = patterns.get(x, 0) + 1
    share = np.array([0.8] + [0.2 / n] * n)
    table = np.empty((n, n + 1, 3))
    for k in range(n):
        marginal = np.array([sum(x[k] == v for x in rows) for v in (-1, 0, 1)]) + 1.0
        table[k] = marginal / marginal.sum()
        table[k, 0] = (0.1, 0.02, 0.88)
        table[k, k + 1] = (0.05, 0.9, 0.05)
    for _ in range(12):
        p = []
        for x in rows:
            q = np.array([share[y] * np.prod([table[k, y, x[k] + 1] for k in range(n) if x[k] >= 0]) for y in range(n + 1)])
            p.append(q / q.sum())
        p = np.array(p)
        share = (p.sum(0) + 1e-3) / (p.sum() + 1e-3 * (n + 1))
        for k in range(n):
            for y in range(n + 1):
                c = np.array([sum(p[i, y] for i, x in enumerate(rows) if x[k] == v) for v in (-1, 0, 1)]) + 0.5
                table[k, y] = c / c.sum()
    got_share, got_table = w.estimate(patterns, rounds=12)
    assert np.allclose(got_share, share) and np.allclose(got_table, table)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_agree_with_sql(spark):
    import duckdb

    from tesselark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert {"op2_line_dedup", "op4_decontaminate", "op8_quality_rules", "op10_ngram_jaccard"} <= set(ORACLES)
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == columns, name
        want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
        assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want, name
