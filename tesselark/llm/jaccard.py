"""N-gram Jaccard join: exact links between whole texts, by a token-group matrix.

1. A text becomes the set of its distinct word shingles (64-bit hashes).  Texts with equal
   sets form one class, stood for by its smallest id.
2. Which classes can be linked at all is found without comparing pairs.  Sets that reach
   the similarity differ in at most D tokens, so if tokens are dealt over D+1+s parts by
   hash, s+1 parts are the same in both; each class emits a hash of each part.  D follows
   from the size, in size intervals that adjacent classes share.  A class with fewer shared
   parts than that has no link, and two groups with fewer have none between them.
3. The classes that share a part are dealt into groups of similar documents: those that
   share most parts with one of them, their lead, in bounded blocks.  A group stores its
   members and the union of their tokens: a row of the token-group matrix.
4. A document that is a query to a group is compared with the group's union first; that
   overlap bounds the one with every member, so only groups whose bound reaches the query's
   need are opened, and only there are exact overlaps counted.  First every group meets
   itself and the group of its lead, which connects large families at a cost linear in
   their size.  Of the sets of parts whose sets aren't all connected yet, those leave whose
   overlap with the union of all other components bounds their similarity below the
   threshold; the others are dealt into groups anew and are queries to the families that
   share enough parts with them through sets of other components.
5. A pair of groups reports a spanning forest of its links, not all of them; components
   are found over those.

No candidate is capped or dropped.  Edge cases: a null or empty text, or one without
words, has no shingles and stays alone; a text shorter than a shingle is one shingle;
repeated rows of an id are one document, of which the greatest text counts where they
differ; rows without an id are left out; a very long text is one set, which may fill a
group alone; of linked documents (all tie) the smallest id names the component; an empty
table gives an empty result; columns beside id and text play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, bounded_batches, few, map_text, mix, one_text_each, ragged, stored, words
from .components import components

#: Tokens of a group, about; bounds what one task holds of it.
GROUP_TOKENS = 1 << 17
#: Documents with one set from which on their class is broadcast, while such classes are few.
HOT_COPIES = 1_000
#: Parts beyond D+1: so many, and D divided by SPARE_SHARE.  Linked sets then have one part more than these in
#: common at least, of which some may hold no token.
SPARE, SPARE_SHARE = 16, 4


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and n+1 bounds."""
    s, _, h, _ = words(data, off, NOT_SPACE)
    bounds = np.searchsorted(s, off)
    x = h[: max(0, len(h) - width + 1)].copy() if len(h) >= width else np.zeros(0, np.uint64)
    for j in range(1, width):
        x = mix(x * np.uint64(3) + h[j : j + len(x)])
    out, ends = [], [0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(x[a : b - width + 1]))
        elif b > a:
            y = h[a : a + 1]
            for j in range(a + 1, b):
                y = mix(y * np.uint64(3) + h[j : j + 1])
            out.append(y + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
        ends.append(ends[-1] + len(out[-1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(ends)


def intervals(most: int, percent: int) -> np.ndarray:
    """Upper ends of size intervals such that linked sets lie in the same or in adjacent ones."""
    ends, low = [0], 1
    while ends[-1] < most:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return np.array(ends)


def part_hashes(tokens: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the parts of each set, end to end, n+1 bounds, and how many of them a link needs in common.

    A set emits the parts of its own interval and of the next one, where it may be the smaller.
    Parts without tokens are left out where a set has at most as many as there are spare ones.
    """
    size = np.diff(bounds)
    upper = intervals(int(size.max(initial=0)) * 100 // percent + 2, percent)
    own = np.searchsorted(upper, size)
    upper = np.append(upper, (upper[-1] + 1) * 100 // percent)
    every, rows, need = [], [], np.full(len(size), np.iinfo(np.int32).max)
    row = np.repeat(np.arange(len(size)), size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    for step in (0, 1):
        level = own + step
        differ = 2 * upper[np.minimum(level, len(upper) - 1)] * (100 - percent) // (100 + percent)
        spare = SPARE + differ // SPARE_SHARE
        k = np.where((size > 0) & (differ > 0), differ + 1 + spare, 0)
        base = np.cumsum(k) - k
        total = int(k.sum())
        if not total:
            continue
        keep = k[row] > 0
        part = ((tokens >> np.uint64(32)) * k[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[row]
        at = np.searchsorted(part[keep], np.arange(total + 1))
        place = np.concatenate([np.flatnonzero(keep), [len(tokens)]])
        first, last = place[at[:-1]], place[at[1:]]
        empty = at[1:] == at[:-1]
        # sets whose tokens aren't contiguous with the next kept set end where they end
        owner = np.repeat(np.arange(len(size)), k)
        edge = np.minimum(last, bounds[1:][owner])
        value = np.where(empty, np.uint64(0), sums[edge] - sums[np.minimum(first, edge)])
        number = np.arange(total) - base[owner]
        label = (level[owner].astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)
        blank = np.bincount(owner, empty, len(size)).astype(np.int64)
        many = blank > spare
        need = np.minimum(need, np.where(many, 1, spare + 1 - blank))
        use = ~empty | many[owner]
        every.append(mix(value + mix(label + np.uint64(1)))[use])
        rows.append(owner[use])
    if not every:
        return np.zeros(0, np.uint64), np.zeros(len(size) + 1, np.int64), need
    value, owner = np.concatenate(every), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return value[order], np.searchsorted(owner[order], np.arange(len(size) + 1)), need


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, parts: bool) -> DataFrame:
    """(doc, n, ha, hb[, need, parts]): set size, 128-bit set hash and part hashes."""
    kind = docs.schema[id_col].dataType.simpleString()
    as_long = lambda x: x.view(np.int64)

    def rows(ids, data, off):
        tokens, bounds = shingle_sets(data, off, width)
        n = np.diff(bounds)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
        ha, hb = (mix(x[bounds[1:]] - x[bounds[:-1]]) for x in sums)
        out = [ids, n, as_long(ha), as_long(hb)]
        if parts:
            value, at, need = part_hashes(tokens, bounds, percent)
            out.append(need)
            out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(as_long(value))))
        return out

    schema = f"doc {kind}, n long, ha long, hb long" + (", need int, parts array<long>" if parts else "")
    return map_text(docs, id_col, text_col, schema, rows)


def _tokens(docs: DataFrame, width: int) -> DataFrame:
    """(rep, tokens binary) of the documents given as (rep, text)."""
    kind = docs.schema["rep"].dataType.simpleString()

    def rows(ids, data, off):
        tokens, bounds = shingle_sets(data, off, width)
        raw = tokens.tobytes()
        return [ids, pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())]

    return map_text(docs, "rep", "text", f"rep {kind}, tokens binary", rows)


class Group:
    """Members of one group as ids, sets, and the sorted union of their tokens."""

    def __init__(self, members: list[dict]):
        members.sort(key=lambda m: m["rep"])
        self.ids = [m["rep"] for m in members]
        self.sets = [np.frombuffer(m["tokens"], np.uint64) for m in members]
        self.size = np.array([len(x) for x in self.sets])
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(self.sets)), self.size)[order]
        self.union, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(flat)))

    def overlaps(self, query: np.ndarray, need: int) -> np.ndarray | None:
        """Overlap of the query with each member, or None where the union shows that none reaches `need`."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        hit = at[self.union[at] == query]
        if len(hit) < need:
            return None
        return np.bincount(self.owner[ragged(self.first[hit], self.count[hit])], minlength=len(self.ids))


def forest(x: Group, y: Group | None, percent: int) -> list[tuple]:
    """Edges of a spanning forest of the links within x, or between x and y."""
    z = x if y is None else y
    ids = x.ids if y is None else x.ids + y.ids
    shift = 0 if y is None else len(x.ids)
    label = np.arange(len(ids))
    edges = []
    for i, q in enumerate(x.sets):
        n = len(q)
        if (o := z.overlaps(q, -(-percent * n // 100))) is None:
            continue
        near = shift + np.flatnonzero(100 * o >= percent * (n + z.size - o))
        apart = near[label[near] != label[i]]
        if len(apart):
            others, one = np.unique(label[apart], return_index=True)
            edges += [(ids[i], ids[k]) for k in apart[one].tolist()]
            label[np.isin(label, others)] = label[i]
    return edges


def _verified(asked: DataFrame, members: DataFrame, kind: str, percent: int) -> DataFrame:
    """(a, b) spanning forests of the pairs of groups asked for as (f, i, h, j, rep, left).

    A group is block i of family f; `left` is true for its members, false for those of block j
    of family h, and null where a group meets itself.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    pair = ["f", "i", "h", "j"]
    sides = asked.groupBy(*pair).agg(F.max("left").alias("a"), F.min("left").alias("b"), F.count("*").alias("m"))
    live = sides.where("a != b or a is null and m > 1").select(*pair)
    full = asked.join(live, pair, "left_semi").join(members, "rep")
    both = full.groupBy(*pair).agg(F.collect_list(F.struct("rep", "left", "tokens")).alias("x")).select("x")
    schema = f"a {kind}, b {kind}"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def verify(batches):
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                rows = batch.column(0)[k].as_py()
                x = Group([r for r in rows if r["left"] is not False])
                y = None if rows[0]["left"] is None else Group([r for r in rows if not r["left"]])
                for p, q in forest(x, y, percent):
                    a.append(p)
                    b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(a, out[0].type), pa.array(b, out[1].type)], schema=out)

    return stored(both.mapInArrow(verify, schema))


def _blocks(size: str) -> F.Column:
    """How many blocks of GROUP_TOKENS hold the sets of a family."""
    return F.ceil(F.sum(size) / F.lit(GROUP_TOKENS)).cast("int").alias("blocks")


def _block(blocks: str) -> F.Column:
    return F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")


def _within_families(placed: DataFrame) -> DataFrame:
    """Every group with itself and with the group that its lead is in: as many pairs as there are groups."""
    own = placed.select("rep", "f", "i")
    heads = own.select(F.col("rep").alias("f"), F.col("f").alias("h"), F.col("i").alias("j"))
    ties = stored(own.select("f", "i").distinct().join(heads, "f").where("f != h or i != j"))
    alone = own.select("f", "i", F.col("f").alias("h"), F.col("i").alias("j"), "rep", F.lit(None).cast("boolean").alias("left"))
    left = ties.join(own, ["f", "i"]).withColumn("left", F.lit(True))
    right = ties.join(own.select("rep", F.col("f").alias("h"), F.col("i").alias("j")), ["h", "j"]).withColumn("left", F.lit(False))
    return alone.unionByName(left).unionByName(right)


def _between_components(seen: DataFrame) -> DataFrame:
    """The pairs of groups, dealt anew, that sets of different components may be linked through.

    A set is a query to a family of which a part's sets have other components; it needs as many
    such parts, and both sides of a pair of families must have queries to the other.
    """
    held = seen.groupBy("part", F.col("f").alias("o")).agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
    met = seen.join(held, "part").where("a != comp or b != comp").groupBy("rep", "f", "o")
    query = met.agg(F.count("*").alias("m"), F.first("need").alias("need"), F.first("n").alias("n")).where("m >= need")
    query = stored(query.select("rep", "n", "f", "o"))
    inner = query.where("f = o")
    inner = inner.join(inner.groupBy("f").agg(_blocks("n")), "f").withColumn("own", _block("blocks")).withColumn("k", F.explode(F.expr("sequence(0, blocks - 1)")))
    within = inner.select("f", F.least("own", "k").alias("i"), F.col("f").alias("h"), F.greatest("own", "k").alias("j"), "rep", F.expr("nullif(own, k) < k").alias("left"))
    cross = query.where("f != o").select("rep", "n", F.least("f", "o").alias("f"), F.greatest("f", "o").alias("h"), (F.col("f") < F.col("o")).alias("left"))
    sides = cross.groupBy("f", "h", "left").agg(_blocks("n"))
    cross = cross.join(sides, ["f", "h", "left"]).join(sides.select("f", "h", (~F.col("left")).alias("left"), F.col("blocks").alias("others")), ["f", "h", "left"])
    cross = cross.withColumn("own", _block("blocks")).withColumn("k", F.explode(F.expr("sequence(0, others - 1)")))
    between = cross.select("f", F.expr("if(left, own, k)").alias("i"), "h", F.expr("if(left, k, own)").alias("j"), "rep", "left")
    return stored(within.unionByName(between))


def _apart(seen: DataFrame) -> DataFrame:
    """The rows (part, rep, need, n, f, comp) of parts that several components have; a part of one component is settled."""
    mixed = seen.groupBy("part").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("part")
    return stored(seen.join(mixed, "part", "left_semi"))


def _reachable(seen: DataFrame, members: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """The rows of sets that a set of another component may reach, by the overlap with the union of all others.

    Of a set's n tokens only those count that another component has, o of them.  A partner has
    as many parts in common as the set needs, so that it is no smaller than that many of the
    smallest sets of its parts allow: it has `low` tokens at least.  The similarity is then at
    most o / (n + max(low, o) - o).  Sets below the threshold leave, and what only they share
    with others counts no more; each round costs the tokens once, whatever the size of a group.
    """
    kind = members.schema["rep"].dataType.simpleString()

    def spread(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                t = np.frombuffer(batch.column(2)[k].as_py(), np.int64)
                for i in range(0, len(t), 1 << 16):
                    x = t[i : i + (1 << 16)]
                    same = pa.array(np.zeros(len(x), np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1).take(same), batch.column(1).slice(k, 1).take(same), pa.array(x)], names=["rep", "comp", "token"])

    whose = members.join(seen.select("rep", "comp").distinct(), "rep").select("rep", "comp", "tokens")
    tokens = stored(whose.mapInArrow(spread, f"rep {kind}, comp {kind}, token long"))
    for _ in range(rounds):
        live = tokens.join(seen.select("rep").distinct(), "rep", "left_semi")
        common = live.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("token")
        over = live.join(common, "token", "left_semi").groupBy("rep").agg(F.count("*").alias("o"))
        least = seen.groupBy("part").agg(F.min("n").alias("least"))
        lows = seen.join(least, "part").groupBy("rep").agg(F.first("n").alias("n"), F.first("need").alias("need"), F.sort_array(F.collect_list("least")).alias("lows"))
        lows = lows.where("size(lows) >= need").select("rep", "n", F.element_at("lows", F.col("need")).alias("low"))
        kept = lows.join(over, "rep").where(F.expr(f"100 * o >= {percent} * (n + greatest(low, o) - o)")).select("rep")
        seen = _apart(seen.join(stored(kept), "rep", "left_semi"))
    return seen


def classed(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, n, rep): the set size of each document and the smallest document with the same set.

    Classes with many members are met through a broadcast while there are few of them, so that
    their rows stay where they are.
    """
    slim = stored(signatures(texts, "id", "text", width, percent, False))
    same = slim.where("n > 0").groupBy("ha", "hb").agg(F.min("doc").alias("rep"), F.count("*").alias("m")).where("m > 1")
    names = stored(same)
    hot = few(names.where(F.col("m") > HOT_COPIES).select("ha", "hb", F.col("rep").alias("hot")))
    cold = names.where(F.col("m") <= HOT_COPIES).select(F.col("ha").alias("ka"), F.col("hb").alias("kb"), F.col("rep").alias("cold"))
    met = slim.join(hot, ["ha", "hb"], "left")
    # what is settled, or has no set, goes to no one's key
    free = F.col("hot").isNotNull() | (F.col("n") == 0)
    met = met.withColumn("ka", F.when(free, F.xxhash64("doc")).otherwise(F.col("ha")))
    met = met.withColumn("kb", F.when(free, F.xxhash64("doc", F.lit(1))).otherwise(F.col("hb")))
    return stored(met.join(cold, ["ka", "kb"], "left").select("doc", "n", F.coalesce("hot", "cold", "doc").alias("rep")))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """((doc, n, rep) of every document, (a, b) forest of links between class representatives)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = one_text_each(docs, id_col, text_col)
    member = classed(texts, width, percent)
    copies = few(member.where("rep != doc").select(F.col("doc").alias("id")))
    parts = signatures(texts.join(copies, "id", "left_anti"), "id", "text", width, percent, True)
    dealt = parts.where("n > 0").select(F.col("doc").alias("rep"), "need", F.explode("parts").alias("part")).repartition(slots, "part")
    touching = stored(dealt.withColumn("m", F.count("*").over(Window.partitionBy("part"))).where("m > 1").drop("m"))
    # a set that shares fewer parts than a link needs has no link
    able = stored(touching.groupBy("rep").agg(F.count("*").alias("m"), F.first("need").alias("need")).where("m >= need").select("rep", "need"))
    close = touching.select("rep", "part").join(able.select("rep"), "rep", "left_semi")
    # similar sets gather round one of them: each names the smallest of those it shares a part with, the most often named counts
    leads = close.join(close.groupBy("part").agg(F.min("rep").alias("lead")), "part").groupBy("rep", "lead").agg(F.count("*").alias("m"))
    lead = stored(leads.groupBy("rep").agg(F.max_by("lead", F.struct("m", "lead")).alias("lead")))
    for _ in range(3):  # a lead is never larger than its set, so following leads ends at a family's root
        over = lead.select(F.col("rep").alias("lead"), F.col("lead").alias("up"))
        lead = stored(lead.join(over, "lead", "left").select("rep", F.coalesce("up", "lead").alias("lead")))
    sized = stored(able.join(lead, "rep").join(member.select(F.col("doc").alias("rep"), "n"), "rep"))
    wanted = texts.withColumnRenamed("id", "rep").join(few(able.select("rep")), "rep", "left_semi")
    members = stored(_tokens(wanted, width))
    weight = sized.groupBy("lead").agg(_blocks("n"))
    placed = stored(sized.join(weight, "lead").select("rep", "need", "n", F.col("lead").alias("f"), _block("blocks").alias("i")))
    edges = _verified(_within_families(placed), members, kind, percent)
    # what is connected by now needs no more links
    found = components(edges).select(F.col("node").alias("rep"), "component")
    joined = stored(placed.join(found, "rep", "left").select("rep", "need", "n", "f", F.coalesce("component", "rep").alias("comp")))
    seen = _reachable(_apart(touching.select("rep", "part").join(joined, "rep")), members, percent)
    return member, edges.unionByName(_verified(_between_components(seen), members, kind, percent))


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    member, edges = links(docs, id_col, text_col, width, percent)
    found = components(edges).select(F.col("node").alias("rep"), "component")
    return member.join(found, "rep", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
