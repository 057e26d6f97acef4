"""Graph and search operators against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tesselark.operators import graph, search, services, temporal


def test_pagerank_equals_power_iteration(spark):
    r = np.random.default_rng(3)
    n = 12
    pairs = [(int(a), int(b), float(c)) for a, b, c in zip(r.integers(0, 9, 40), r.integers(0, n, 40), r.random(40))] + [(1, 99, 0.5)]
    teleport = r.integers(1, 5, n).astype(float)
    nodes = spark.createDataFrame([(k, float(t)) for k, t in enumerate(teleport)], "node int, teleport double")
    got = {x["node"]: x["rank"] for x in graph.pagerank(nodes, spark.createDataFrame(pairs, "source int, target int, confidence double")).collect()}
    w = np.zeros((n, n))
    leaks = np.zeros(n)
    for a, b, c in pairs:
        if b < n:
            w[a, b] += max(0.1, c)
        else:
            leaks[a] += max(0.1, c)
    total = w.sum(1) + leaks
    tp = teleport / teleport.sum()
    rank = tp.copy()
    for _ in range(24):
        flow = 0.85 * (rank[total > 0, None] * w[total > 0] / total[total > 0, None]).sum(0)
        rank = flow + (1 - flow.sum()) * tp
    assert sorted(got) == list(range(n)) and np.allclose([got[k] for k in range(n)], rank) and abs(sum(got.values()) - 1) < 1e-9


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    r = np.random.default_rng(5)
    v = np.round(r.normal(size=(300, 6)), 1)
    v[10] = v[11] = v[12]
    v[13] = 0
    rows = [(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(None, [1.0] * 6), (900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = df.where("vec_id % 20 = 0 or vec_id in (11, 13)")
    got = {(x["query"], x["rank"]): (x["vec_id"], x["similarity"]) for x in search.nearest(df, queries, 4).collect()}
    v32 = v.astype(np.float32).astype(float)
    want = {}
    for q in [*range(0, 300, 20), 11]:
        s = [(round(float(v32[q] @ v32[k] / np.sqrt((v32[q] @ v32[q]) * (v32[k] @ v32[k]))), 6), k) for k in range(300) if k not in (q, 13)]
        for rank, (x, k) in enumerate(sorted(s, key=lambda t: (-t[0], t[1]))[:4], 1):
            want[q, rank] = k, x
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert search.nearest(df, queries.limit(0), 4).count() == 0


def test_lineage_of_a_long_chain(spark):
    rows = [(k, k + 1) for k in range(400)] + [(1000, 1001), (2000, None)]
    changes = spark.createDataFrame(rows, "stable_key long, previous_stable_key long")
    assert sorted(x[0] for x in temporal.lineage(changes, 7).collect()) == list(range(401))
    assert [x[0] for x in temporal.lineage(changes, 2000).collect()] == [2000]
    assert [x[0] for x in temporal.lineage(changes, -5).collect()] == [-5]


def test_fuzzy_tokens_equal_all_pairs(spark):
    words = ["request", "requests", "reqeust", "response", "abc", "abcd", "abdc", "quest", "banana", "bananas", "bandana"]
    t = spark.createDataFrame([(w,) for w in words], "token string")
    got = {(r[0], r[1]): round(r[2], 9) for r in search.fuzzy_tokens(t, t).collect()}
    grams = lambda w: {f"^{w}$"[k : k + 3] for k in range(len(w))}
    want = {}
    for a in words:
        for b in words:
            s = 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))
            if a != b and min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 2 and s >= 0.55:
                want[a, b] = round(s, 9)
    assert got == want


def greedy_communities(rows, passes=20):
    """The plain form: one level of greedy modularity, nodes visited in order."""
    near = {}
    for s, t, w in rows:
        if s != t:
            near.setdefault(s, {})[t] = near.setdefault(s, {}).get(t, 0.0) + w
            near.setdefault(t, {})[s] = near.setdefault(t, {}).get(s, 0.0) + w
    degree = {n: sum(x.values()) for n, x in near.items()}
    label, total, m2 = {n: n for n in near}, dict(degree), sum(degree.values())
    for _ in range(passes):
        before = dict(label)
        for n in sorted(near):
            own = label[n]
            total[own] -= degree[n]
            ties = {}
            for o, w in near[n].items():
                ties[label[o]] = ties.get(label[o], 0.0) + w
            best, gain = own, ties.get(own, 0.0) - total[own] * degree[n] / m2
            for c in sorted(ties):
                g = ties[c] - total[c] * degree[n] / m2
                if g > gain + 1e-12 or (abs(g - gain) <= 1e-12 and c < best):
                    best, gain = c, g
            total[best] += degree[n]
            label[n] = best
        if label == before:
            break
    return label


def test_communities_equal_the_plain_form(spark):
    r = np.random.default_rng(8)
    rows = [(g, f"n{a}", f"n{b}", int(w) / 4) for g in ("x", "y") for a, b, w in zip(r.integers(0, 60, 150), r.integers(0, 60, 150), r.integers(1, 5, 150))]
    df = spark.createDataFrame([*rows, ("z", "n1", "n1", 1.0)], "repo_id string, source string, target string, weight double").repartition(3)
    got = {(x["repo_id"], x["node"]): x["community"] for x in graph.communities(df).collect()}
    assert got == {(g, n): c for g in ("x", "y") for n, c in greedy_communities([x[1:] for x in rows if x[0] == g]).items()}


def test_communities_hold_no_neighbours_in_memory():
    """What the task keeps of a batch doesn't grow with the neighbours in it."""
    import tracemalloc

    import pyarrow as pa

    n = 1500
    near = pa.array([[k for k in range(n) if k != v] for v in range(n)], pa.list_(pa.int32()))
    weights = pa.ListArray.from_arrays(near.offsets, pa.array(np.ones(n * (n - 1))))
    whole = pa.RecordBatch.from_arrays([pa.array(["g"] * n), pa.array(range(n), pa.int32()), near, weights], names=["g", "i", "j", "w"])
    tracemalloc.start()
    got = list(graph._greedy(2)(whole.slice(k, 50) for k in range(0, n, 50)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].num_rows == n and peak < n * (n - 1) * 12 / 4


def sparse_graphs():
    r = np.random.default_rng(11)
    for n in (2, 5, 9, 16, 30):
        for m in (n // 2 + 1, n, n + n // 3, 2 * n):
            for _ in range(12):
                rows = [(int(a), int(b)) for a, b in zip(r.integers(0, n, m), r.integers(0, n, m)) if a != b]
                if rows:
                    yield rows


def cut_nodes(pairs):
    from test_whole_tables import cut_nodes as plain

    return plain(pairs)


def test_forests_keep_the_cut_nodes():
    """Thinned in parts, merged and thinned again, edges have the cut nodes of the whole, and fewer than two for each node."""
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in rows], pa.int64()) for k in (0, 1)], names=["x", "y"])

    for rows in sparse_graphs():
        parts = [b for k in range(3) for b in graph._thin([batch(rows[k::3])])]
        merged = list(graph._thin(parts))
        assert merged[0].num_rows < 2 * len({x for p in rows for x in p})
        got = [x for b in graph._cut_nodes(merged) for x in b.column(0).to_pylist()]
        assert set(got) == cut_nodes(set(rows)), rows


def test_articulation_of_groups(spark):
    rows = [(g, f"{a}", f"{b}") for g in ("x", "y") for a, b in ([(1, 2), (2, 3), (3, 1), (3, 4)] if g == "x" else [(1, 2), (2, 3), (2, 2)])]
    df = spark.createDataFrame(rows, "component string, source string, target string").repartition(4)
    assert sorted(map(tuple, graph.articulation(df).collect())) == [("x", "3"), ("y", "2")]


def test_links_of_a_hot_path_are_counted_not_made(spark):
    """400,000 routes and as many clients of one path: their pairs could not be made here."""
    n = 400_000
    method = F.expr("elt(cast(id % 3 as int) + 1, 'any', 'get', 'POST')")
    routes = spark.range(n).select(F.lit("/a/7").alias("path"), method.alias("method"))
    clients = spark.range(n + 1).select(F.when(F.col("id") < n, "https://h/a/9").otherwise("/b").alias("path"), F.lit("get").alias("method"))
    got = [tuple(r) for r in services.api_link_counts(routes, clients).collect()]
    assert got == [("/a/{}", n * sum(k % 3 < 2 for k in range(n)))]


def test_link_counts_equal_the_links(spark):
    r = np.random.default_rng(2)
    sides = []
    for name in ("route", "client"):
        rows = [(k, f"/p/{int(p)}/x{int(q)}", m, 0.9) for k, (p, q, m) in enumerate(zip(r.integers(0, 9, 60), r.integers(0, 4, 60), r.choice(["get", "POST", "", "any"], 60)))]
        sides.append(spark.createDataFrame(rows, f"{name} int, path string, method string, confidence double"))
    want = services.api_links(*sides).groupBy("path").count()
    assert sorted(map(tuple, services.api_link_counts(*sides).collect())) == sorted(map(tuple, want.collect()))


def test_similar_tokens_of_many_that_share_common_grams(spark, monkeypatch):
    """Tokens that share their grams with all queries but are similar to few; several blocks of queries."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    r = np.random.default_rng(4)
    words = sorted({"".join(r.choice(list("ab\u00e9"), int(n))) for n in r.integers(3, 9, 200)}) + ["ab" * 200, "ab" * 201]
    t, q = (spark.createDataFrame([(w,) for w in x], "token string") for x in (words, words[::5] + words[-1:]))
    got = sorted(map(tuple, search.fuzzy_tokens(t, q).collect()))
    pairs = t.crossJoin(q.withColumnRenamed("token", "query_token"))
    want = pairs.select("query_token", "token", search.fuzzy("query_token", "token").alias("similarity")).where("similarity > 0")
    assert got == sorted(map(tuple, want.collect())) and got


def test_no_pairs_are_made_of_dissimilar_tokens(spark):
    t = spark.createDataFrame([("abcde",)], "token string")
    plan = search.fuzzy_tokens(t, t)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
