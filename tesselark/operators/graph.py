"""Graph operators over (source, target, confidence) edges.

Searches keep a frontier and the visited nodes as DataFrames; each level is one join and one
anti-join, checkpointed, so a level's cost follows the frontier and not the paths.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Edges that a task gathers at a time.
_EDGES = 1 << 20


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to, confidence, side): the steps of a search in a direction; callers come before callees."""
    up = edges.select(F.col("target").alias("at"), F.col("source").alias("to"), "confidence", F.lit(0).alias("side"))
    down = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "confidence", F.lit(1).alias("side"))
    return {"upstream": up, "downstream": down, "both": up.unionByName(down)}[direction]


def impact(edges: DataFrame, starts: DataFrame, direction: str = "upstream", depth: int = 5, start_col: str = "node") -> DataFrame:
    """(origin, node, depth, parent, confidence): nodes within `depth` steps of each start, each by its first path.

    All starts are searched at once.  Among the parents of a node at its depth, the one found
    first (smallest order), then the most confident edge, counts.
    """
    steps = directed(edges, direction)
    first = starts.select(F.col(start_col).alias("origin")).distinct()
    none = F.lit(None)
    kind = edges.schema["source"].dataType
    frontier = first.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"), none.cast(kind).alias("parent"), F.lit(1.0).alias("confidence"))
    seen = frontier = cut(frontier)
    for level in range(1, depth + 1):
        reach = frontier.select("origin", F.col("node").alias("at")).join(steps, "at")
        fresh = reach.join(seen.select("origin", F.col("node").alias("to")), ["origin", "to"], "left_anti")
        best = fresh.groupBy("origin", "to").agg(F.min(F.struct("at", "side", (-F.col("confidence")).alias("c"))).alias("b"))
        frontier = cut(best.select("origin", F.col("to").alias("node"), F.lit(level).alias("depth"), F.col("b.at").alias("parent"), (-F.col("b.c")).alias("confidence")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def dependency_path(edges: DataFrame, source, target, max_depth: int = 20, min_confidence: float = 0.0) -> DataFrame:
    """(ordinal, node, confidence) of the shortest path, the most confident of equals; empty where there is none."""
    kind = edges.schema["source"].dataType
    usable = edges.where(F.col("confidence") >= min_confidence).groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(1.0).alias("product"), F.array(F.lit(source).cast(kind)).alias("path"), F.array(F.lit(1.0)).alias("steps"))
    seen = frontier.select("node")
    goal = F.lit(target).cast(kind)
    for _ in range(max_depth):
        if not frontier.where(F.col("node") == goal).isEmpty():
            break
        nxt = frontier.join(usable, frontier["node"] == usable["source"]).join(seen.select(F.col("node").alias("target")), "target", "left_anti")
        scored = nxt.select(F.col("target").alias("node"), (F.col("product") * F.col("confidence")).alias("product"), F.concat("path", F.array("target")).alias("path"), F.concat("steps", F.array("confidence")).alias("steps"))
        frontier = cut(scored.groupBy("node").agg(F.min(F.struct((-F.col("product")).alias("p"), "path", "steps")).alias("b")).select("node", (-F.col("b.p")).alias("product"), "b.path", "b.steps"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node"))
    hit = frontier.where(F.col("node") == goal)
    return hit.select(F.posexplode(F.arrays_zip("path", "steps")).alias("ordinal", "s"), "product").select("ordinal", F.col("s.path").alias("node"), F.col("s.steps").alias("confidence"), "product")


def flows(edges: DataFrame, starts: DataFrame, max_depth: int = 8, branching: int = 5, limit: int = 100, min_confidence: float = 0.0, start_col: str = "node") -> DataFrame:
    """Simple paths from each start: (path, terminal, confidence), in order of path.

    A path ends at a leaf, where all its next nodes are in it already, or at the depth bound.
    Paths that end are set aside; only open ones are extended.
    """
    usable = edges.where(F.col("confidence") >= min_confidence).groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "target"))
    usable = usable.withColumn("__r", rank).where(F.col("__r") <= branching).drop("__r")
    open_ = starts.select(F.array(start_col).alias("path"), F.col(start_col).alias("at"), F.lit(1.0).alias("confidence"))
    done = None
    for _ in range(max_depth):
        tried = open_.join(usable.withColumnRenamed("confidence", "c"), open_["at"] == usable["source"], "left")
        cycle = tried.withColumn("back", F.coalesce(F.array_contains("path", F.col("target")), F.lit(False)))
        onward = cycle.where("target is not null and not back").select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("at"), (F.col("confidence") * F.col("c")).alias("confidence"))
        ends = cycle.groupBy("path", "confidence").agg(F.max((F.col("target").isNotNull() & ~F.col("back")).cast("int")).alias("goes"), F.max(F.col("back").cast("int")).alias("back"))
        ends = ends.where("goes = 0").select("path", F.when(F.col("back") == 1, "cycle_guard").otherwise("leaf").alias("terminal"), "confidence")
        done = ends if done is None else done.unionByName(ends)
        open_ = cut(onward)
        if open_.isEmpty():
            break
    done = done.unionByName(open_.select("path", F.lit("depth_bound").alias("terminal"), "confidence"))
    return done.orderBy("path").limit(limit)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 24, damping: float = 0.85, weight: str = "teleport") -> DataFrame:
    """(node, rank): weighted personalised PageRank with a fixed number of rounds.

    Edge weight is max(0.1, confidence), parallel edges add up, and dangling rank is dealt
    out by the teleport weights, which also are the initial ranks.

    A round's rank is the damped flow of the last one plus a multiple of the teleport vector
    that keeps the sum at one.  So it is a combination of that vector's images under the flow;
    a round computes one image, by one join and one aggregate, and the factors follow from the
    images' sums, which are all that the driver sees.
    """
    total = nodes.agg(F.sum(weight).alias("__t"))
    v = cut(nodes.crossJoin(F.broadcast(total)).select("node", (F.col(weight) / F.col("__t")).alias("x")))  # one row
    w = edges.groupBy("source", "target").agg(F.sum(F.greatest(F.lit(0.1), "confidence")).alias("w"))
    out = w.groupBy("source").agg(F.sum("w").alias("o"))
    known = v.select(F.col("node").alias("target"))
    share = cut(w.join(out, "source").join(known, "target").select("source", "target", (damping * F.col("w") / F.col("o")).alias("share")))
    images, sums = [v], []
    for _ in range(rounds):
        flow = share.join(images[-1].select(F.col("node").alias("source"), "x"), "source")
        images.append(cut(flow.groupBy(F.col("target").alias("node")).agg(F.sum(F.col("x") * F.col("share")).alias("x"))))
        sums.append(images[-1].agg(F.sum("x")).head()[0] or 0.0)
    factors = [1.0]
    for _ in range(rounds):
        factors = [1 - sum(a * s for a, s in zip(factors, sums)), *factors]
    weighted = [m.select("node", (F.lit(a) * F.col("x")).alias("x")) for a, m in zip(factors, images)]
    every = weighted[0]
    for m in weighted[1:]:
        every = every.unionByName(m)
    return every.groupBy("node").agg(F.sum("x").alias("rank"))


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component): smallest node reachable over undirected pairs, by label passing with pointer jumps."""
    links = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = cut(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = links.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("component"))
    for _ in range(rounds):
        near = links.join(label.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        new = label.join(near, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        over = new.select(F.col("node").alias("c"), F.col("c").alias("up"))
        new = cut(new.join(over, "c", "left").select("node", F.least("c", F.coalesce("up", "c")).alias("component"), "old"))
        changed = not new.where("component != old").isEmpty()
        label = new.select("node", "component")
        if not changed:
            break
    return label


def communities(edges: DataFrame, group: str = "repo_id", passes: int = 20) -> DataFrame:
    """(group, node, community): greedy modularity, one level, nodes visited in order; sequential within a group.

    Each group is one task: the order of visits is part of the result.  The task keeps a label, a
    degree, a total and a place for each node; the neighbours, which are numbered and gathered in
    many tasks before, are read from its scratch file at each visit.
    """
    pairs = cut(edges.where("source != target").select(group, "source", "target", "weight"))
    tasks = max(1, -(-2 * pairs.count() // _EDGES))
    ends = pairs.select(group, F.col("source").alias("node")).unionByName(pairs.select(group, F.col("target").alias("node"))).distinct()
    nodes = cut(ends.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy("node")) - 1))

    def number(df: DataFrame, column: str, name: str) -> DataFrame:
        n = nodes.select(F.col(group).alias("__g"), F.col("node").alias("__n"), F.col("i").alias(name))
        return df.join(n, F.col(group).eqNullSafe(F.col("__g")) & (F.col(column) == F.col("__n"))).drop("__g", "__n", column)

    e = number(number(pairs, "source", "i"), "target", "j").select(group, "i", "j", F.col("weight").cast("double").alias("w"))
    both = e.unionByName(e.select(group, F.col("j").alias("i"), F.col("i").alias("j"), "w")).repartition(tasks, group, "i")
    near = both.groupBy(group, "i", "j").agg(F.sum("w").alias("w")).groupBy(group, "i").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("x"))
    packed = near.select(group, "i", F.col("x.j").alias("j"), F.col("x.w").alias("w")).repartition(group)
    kind = edges.schema[group].dataType.simpleString()
    got = packed.mapInArrow(_greedy(passes), f"__g {kind}, i int, c int")
    names = nodes.select(F.col(group).alias("__h"), F.col("i").alias("__i"), "node")
    own = got.join(names, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("i") == F.col("__i"))).select("__g", "node", "c")
    labels = names.withColumnRenamed("node", "community")
    return own.join(labels, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("c") == F.col("__i"))).select(F.col("__g").alias(group), "node", "community")


def _greedy(passes: int):
    """mapInArrow function: (group, node, community) from (group, node, neighbours, weights); nodes are 0, 1, ... in each group."""

    def run(batches):
        schema, places = None, {}
        with _scratch() as file:
            end = 0
            for batch in batches:
                schema = batch.schema
                j, w = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
                sizes = np.diff(np.asarray(batch.column(2).offsets))
                first = np.cumsum(sizes) - sizes
                degree = np.bincount(np.repeat(np.arange(len(sizes)), sizes), w, len(sizes))
                file.write(j.astype(np.int32).tobytes())
                file.write(w.astype(np.float64).tobytes())
                for g, *row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (end + 4 * first).tolist(), (end + 4 * len(j) + 8 * first).tolist(), sizes.tolist(), degree.tolist()):
                    places.setdefault(g, []).append(row)
                end += 12 * len(j)
            file.flush()
            for g, rows in places.items():
                label = _visit(file.fileno(), sorted(rows), passes)
                columns = [pa.array([g] * len(label), schema.field(0).type), pa.array(np.arange(len(label), dtype=np.int32)), pa.array(label.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["__g", "i", "c"])

    return run


def _scratch():
    """A file of this task among Spark's own scratch files, gone when closed."""
    where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=where if os.path.isdir(where) else None)


def _visit(file: int, rows: list, passes: int) -> np.ndarray:
    """The label of each node; rows are (node, place of its neighbours, place of their weights, how many, degree)."""
    n = len(rows)
    degree = np.array([r[4] for r in rows])
    label, total, m2 = np.arange(n), degree.copy(), sum(degree.tolist())
    for _ in range(passes):
        moved = False
        for v, j_at, w_at, size, d in rows:
            j = np.frombuffer(os.pread(file, 4 * size, j_at), np.int32)
            w = np.frombuffer(os.pread(file, 8 * size, w_at), np.float64)
            own = int(label[v])
            total[own] -= d
            c, place = np.unique(label[j], return_inverse=True)
            gains = np.bincount(place, w) - total[c] * d / m2
            k = int(np.searchsorted(c, own))
            best, gain = own, float(gains[k]) if k < len(c) and c[k] == own else float(-total[own] * d / m2)
            # only those that exceed all before them, or equal the own label's gain, can be taken
            most = np.maximum.accumulate(np.concatenate([[-np.inf], gains[:-1]]))
            for k in np.flatnonzero((gains > most - 1e-11) & (gains >= gain - 1e-11)):
                g = float(gains[k])
                if g > gain + 1e-12 or (abs(g - gain) <= 1e-12 and c[k] < best):
                    best, gain = int(c[k]), g
            total[best] += d
            moved |= best != own
            label[v] = best
        if not moved:
            break
    return label


def articulation(edges: DataFrame, group: str = "component") -> DataFrame:
    """(group, node): nodes whose removal splits their component.

    A task keeps two forests of its edges only: a breadth-first one and one of the rest.  For
    every node, what hangs together without it does so in these too, so a union of such forests
    has the cut nodes of all edges.  They are merged, eight tasks' at a time, until one task
    searches fewer than two edges for each node, without recursion.
    """
    pairs = cut(edges.where("source != target").select(group, "source", "target"))
    ends = pairs.select(group, F.col("source").alias("node")).unionByName(pairs.select(group, F.col("target").alias("node"))).distinct()
    nodes = cut(ends.withColumn("i", F.monotonically_increasing_id()))

    def number(df: DataFrame, column: str, name: str) -> DataFrame:
        n = nodes.select(F.col(group).alias("__g"), F.col("node").alias("__n"), F.col("i").alias(name))
        return df.join(n, F.col(group).eqNullSafe(F.col("__g")) & (F.col(column) == F.col("__n"))).drop("__g", "__n", column)

    left = cut(number(number(pairs, "source", "x"), "target", "y").select("x", "y"))
    parts = left.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 8)
        left = cut(left.coalesce(parts).mapInArrow(_thin, "x long, y long"))
    return left.coalesce(1).mapInArrow(_cut_nodes, "i long").join(nodes, "i").select(group, "node")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the edges of a spanning forest, and each node's component."""
    label, left, kept = np.arange(n), np.arange(len(a)), []
    random, place = np.random.default_rng(0), np.empty(n, np.int64)
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate([*kept, np.zeros(0, np.int64)]), label
        order = random.permutation(n)
        below = order[x] < order[y]
        high, low = np.where(below, y, x), np.where(below, x, y)
        place[high] = np.arange(len(left))  # one edge of each
        one = np.flatnonzero(place[high] == np.arange(len(left)))
        kept.append(left[one])
        up = np.arange(n)
        up[high[one]] = low[one]
        while True:
            over = up[up]
            if (over == up).all():
                break
            up = over
        label = up[label]


def _sparse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a breadth-first forest, and of a spanning forest of the others."""
    ids, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    n, m = len(ids), len(x)
    # of parallel edges one, or the second forest would take those of the first again
    one = np.unique(np.minimum(ends[:m], ends[m:]) * n + np.maximum(ends[:m], ends[m:]), return_index=True)[1]
    x, y, ends, m = x[one], y[one], np.concatenate([ends[:m][one], ends[m:][one]]), len(one)
    a, b = ends[:m], ends[m:]
    _, label = _forest(a, b, n)
    order = np.argsort(ends, kind="stable")
    to, edge = np.concatenate([b, a])[order], order % m
    start = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    at = np.unique(label)
    seen, place, tree = np.zeros(n, bool), np.empty(n, np.int64), np.zeros(m, bool)
    seen[at] = True
    while len(at):
        size = start[at + 1] - start[at]
        steps = np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        steps = steps[~seen[to[steps]]]
        place[to[steps][::-1]] = np.arange(len(steps))[::-1]  # the first of those that are at the front
        steps = steps[place[to[steps]] == np.arange(len(steps))]
        at = to[steps]
        tree[edge[steps]] = seen[at] = True
    rest = np.flatnonzero(~tree)
    tree[rest[_forest(a[rest], b[rest], n)[0]]] = True
    return x[tree], y[tree]


def _sparse_edges(batches) -> tuple[np.ndarray, np.ndarray]:
    kept, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for batch in batches:
        kept.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        held += batch.num_rows
        if held >= max(_EDGES, len(kept[0][0])):
            kept, held = [_sparse(*map(np.concatenate, zip(*kept)))], 0
    x, y = map(np.concatenate, zip(*kept))
    return _sparse(x, y) if len(x) else (x, y)


def _thin(batches):
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in _sparse_edges(batches)], names=["x", "y"])


def _cut_nodes(batches):
    ids, ends = np.unique(np.concatenate(_sparse_edges(batches)), return_inverse=True)
    n, m = len(ids), len(ends) // 2
    to = np.concatenate([ends[m:], ends[:m]])[np.argsort(ends, kind="stable")].tolist()
    start = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]).tolist()
    at, stop, order, low, cuts, clock = start[:-1], start[1:], [-1] * n, [0] * n, set(), 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = clock
        clock += 1
        stack, children = [(root, -1)], 0
        while stack:
            v, parent = stack[-1]
            if at[v] == stop[v]:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[v])
                    if parent != root and low[v] >= order[parent]:
                        cuts.add(parent)
                    children += parent == root
                continue
            step = to[at[v]]
            at[v] += 1
            if order[step] < 0:
                order[step] = low[step] = clock
                clock += 1
                stack.append((step, v))
            elif step != parent:
                low[v] = min(low[v], order[step])
        if children > 1:
            cuts.add(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids[sorted(cuts)].astype(np.int64))], names=["i"])


def edge_rank(edges: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """The edges with the largest confidence times one plus both ends' scores."""
    s = scores.select(F.col("node").alias("source"), F.col("score").alias("a"))
    t = scores.select(F.col("node").alias("target"), F.col("score").alias("b"))
    ranked = edges.join(s, "source").join(t, "target").withColumn("weight", F.col("confidence") * (1 + F.col("a") + F.col("b")))
    return ranked.select("source", "target", "confidence", "weight").orderBy(F.desc("weight"), "source", "target").limit(limit)


def presentation_score(nodes: DataFrame, tests_in_focus: bool = False) -> DataFrame:
    """Rank adjusted for what readers look for: tests, tiny, private and module names count less, exported ones more."""
    from ..functions.text import is_test_path

    s = F.col("rank")
    s = s * F.when(is_test_path("file_path", True) & F.lit(not tests_in_focus), 0.15).otherwise(1.0)
    s = s * F.when(F.length("name") <= 2, 0.2).otherwise(1.0)
    s = s * F.when(F.col("name").startswith("_"), 0.6).otherwise(1.0)
    s = s * F.when(F.col("kind") == "Module", 0.5).otherwise(1.0)
    return nodes.withColumn("score", s * F.when(F.col("exported"), 1.2).otherwise(1.0))


def directory_clusters(files: DataFrame, path: str = "file_path", most: int | None = 420) -> DataFrame:
    """(path, cluster): two directory levels, three where two hold more than `most` files; None never asks for the third."""
    from ..functions.text import top_directory

    if most is None:
        return files.select(path, top_directory(path, 2).alias("cluster"))
    two = files.select(path, top_directory(path, 2).alias("two"), top_directory(path, 3).alias("three"))
    busy = two.groupBy("two").agg(F.count("*").alias("n"))
    return two.join(busy, "two").select(path, F.when(F.col("n") > most, F.col("three")).otherwise(F.col("two")).alias("cluster"))
