"""Hybrid retrieval: postings, BM25, identifier evidence, hashed vectors and fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_grams, code_tokens, dice, every_gram, fnv1a, identifier
from ..session import cut

# Weights of the fields in term frequencies and in features.
TERM_WEIGHTS = {"name": 6.0, "qualified_name": 4.0, "file_path": 2.0, "signature": 2.0, "body_text": 1.0}
FEATURE_WEIGHTS = {"name": 5.0, "qualified_name": 3.5, "file_path": 2.0, "signature": 1.75, "kind": 1.5, "body_text": 1.0}
K1, B = 1.2, 0.75


def postings(docs: DataFrame, weights: dict[str, float], key: str = "id") -> DataFrame:
    """(key, term, tf): weighted term frequencies over the fields that docs has."""
    def field(name: str, weight: float) -> Column:  # a lambda's second argument would be an index
        return F.transform(code_tokens(F.coalesce(F.col(name).cast("string"), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    fields = [field(f, w) for f, w in weights.items() if f in docs.columns]
    rows = docs.select(key, F.explode(F.concat(*fields)).alias("x")).select(key, "x.term", "x.w")
    return rows.groupBy(key, "term").agg(F.sum("w").alias("tf"))


def bm25(post: DataFrame, query_terms: DataFrame, lengths: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(query, key, score) of every document that holds a term of a query; `query_terms` is (query, term).

    Postings are restricted to the queries' terms before lengths and frequencies meet.  Where
    stored `lengths` (key, dl) are given, `post` is a stored table too; else it is written
    once here and read three times.
    """
    if lengths is None:
        post = cut(post)
        lengths = post.groupBy(key).agg(F.sum("tf").alias("dl"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    terms = query_terms.select("query", "term").distinct()
    hit = post.join(terms.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    scored = hit.join(df, "term").join(lengths, key).crossJoin(F.broadcast(corpus))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return scored.select(key, "term", part.alias("part")).join(terms, "term").groupBy("query", key).agg(F.sum("part").alias("score"))


def exact_score(name, qualified_name, query_tokens, query) -> Column:
    """1 for the identifier itself, 0.82 for a prefix, 0.9 where it holds all of several query tokens; word separators don't count."""
    n, full, q = identifier(name), identifier(qualified_name), identifier(query)
    own = F.concat(code_tokens(name), code_tokens(qualified_name))
    every = (F.size(query_tokens) > 1) & (F.size(F.array_except(query_tokens, own)) == 0)
    same, begins = (n == q) | (full == q), n.startswith(q) | full.startswith(q)
    return F.when(q == "", 0.0).when(same, 1.0).when(begins, 0.82).when(every, 0.9).otherwise(0.0)


def coverage(own_tokens, query_tokens, concepts_of=None) -> Column:
    """Share of an identifier's distinct tokens that the query has, or shares a concept with."""
    own = F.array_distinct(own_tokens)
    hit = F.filter(own, lambda t: F.array_contains(query_tokens, t))
    if concepts_of is not None:
        near = concepts_of(query_tokens)
        hit = F.filter(own, lambda t: F.array_contains(query_tokens, t) | F.arrays_overlap(concepts_of(F.array(t)), near))
    return F.coalesce(F.try_divide(F.size(hit), F.size(own)), F.lit(0.0))


def fuzzy(token_a, token_b, threshold: float = 0.55) -> Column:
    """Dice of padded trigrams for tokens of four letters or more, of about equal length, that differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (token_a, token_b))
    d = dice(char_grams(a), char_grams(b))
    fits = (a != b) & (F.length(a) >= 4) & (F.length(b) >= 4) & (F.abs(F.length(a) - F.length(b)) <= 2)
    return F.when(fits & (d >= threshold), d).otherwise(0.0)


def fuzzy_tokens(tokens: DataFrame, query_tokens: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(query_token, token, similarity) of similar tokens, as `fuzzy` has them.

    Query tokens are broadcast in blocks of a fixed size, as a table of which of them hold a
    trigram.  A token adds the rows of its own trigrams, which counts what it shares with each
    query token, so no pairs are made but those that are similar.
    """
    def grams(df: DataFrame) -> DataFrame:
        return df.select("token").where(F.length("token") >= 4).distinct().select("token", F.length("token").alias("length"), char_grams("token").alias("grams"))

    t, q = cut(grams(tokens)), cut(grams(query_tokens))
    count, held = q.agg(F.count("*"), F.coalesce(F.sum(F.size("grams")), F.lit(0))).head()
    blocks = max(1, -(-count // QUERY_BLOCK), -(-held // (8 * QUERY_BLOCK)))
    found = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b).orderBy("length", "token").collect()  # about QUERY_BLOCK rows
        block = tokens.sparkSession.sparkContext.broadcast([(r[0], r[1], r[2]) for r in part])
        one = t.mapInArrow(_similar(block, threshold), "query_token string, token string, similarity double")
        found = one if found is None else found.unionByName(one)
    return found


def _similar(block, threshold: float):
    """mapInArrow function: the tokens of a partition that are similar to the block's, which are in order of length."""

    def run(batches):
        names = pa.array([r[0] for r in block.value], pa.string())
        length = np.array([r[1] for r in block.value], np.int64)
        sizes = np.array([len(r[2]) for r in block.value], np.int64)
        place: dict[str, int] = {}
        cells = [(place.setdefault(g, len(place)), k) for k, r in enumerate(block.value) for g in r[2]]
        holds = np.zeros((len(place) + 1, len(sizes)), np.uint8 if sizes.max(initial=0) < 256 else np.int32)  # the last row is for other trigrams
        holds[[c[0] for c in cells], [c[1] for c in cells]] = 1
        known = pa.array(list(place), pa.string())
        for batch in batches:
            lists = batch.column(2)
            flat = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), len(place)).to_numpy()
            n = pc.list_value_length(lists).to_numpy()
            first = np.cumsum(n) - n
            kinds, of = np.unique(np.stack([batch.column(1).to_numpy(), n]), axis=1, return_inverse=True)
            of = of.ravel()
            for kind, (own, size) in enumerate(kinds.T):
                lo, hi = np.searchsorted(length, [own - 2, own + 3])
                near, total = holds[:, lo:hi], size + sizes[lo:hi]
                least = np.maximum(1, np.ceil(threshold / 2 * total - 1e-6)).astype(np.int64)
                rows = np.flatnonzero(of == kind) if lo < hi else ()
                step = max(1, _CELLS // (hi - lo + 1) // 4)
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    shared = np.zeros((len(some), hi - lo), holds.dtype)
                    for k in range(size):
                        shared += near[flat[first[some] + k]]
                    r, c = np.nonzero(shared >= least)
                    similarity = 2.0 * shared[r, c] / total[c]
                    pair = pa.RecordBatch.from_arrays([names.take(pa.array(c + lo)), batch.column(0).take(pa.array(some[r])), pa.array(similarity)], names=["query_token", "token", "similarity"])
                    yield pair.filter(pc.and_(pa.array(similarity >= threshold), pc.not_equal(pair.column(0), pair.column(1))))

    return run


def features(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "id") -> DataFrame:
    """(key, feature, weight): tokens, their character trigrams and neighbouring pairs."""
    weights = weights or FEATURE_WEIGHTS
    out = None
    for f, w in weights.items():
        if f not in docs.columns:
            continue
        base = docs.select(key, code_tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("ts"))
        rows = base.select(key, F.explode(_field_features(w)).alias("x")).select(key, "x.feature", "x.w")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(key, "feature").agg(F.sum("w").alias("weight"))


def _field_features(weight: float) -> Column:
    def some(prefix: str, text: Column, share: float) -> Column:
        return F.struct(F.concat(F.lit(prefix), text).alias("feature"), F.lit(share * weight).alias("w"))

    grams = F.flatten(F.transform(F.filter("ts", lambda t: F.length(t).between(5, 32)), lambda t: every_gram(t)))
    pairs = F.expr("transform(slice(ts, 1, greatest(size(ts) - 1, 0)), (t, i) -> concat(t, ':', ts[i + 1]))")
    return F.concat(
        F.transform("ts", lambda t: some("token:", t, 1.0)),
        F.transform(grams, lambda g: some("char3:", g, 0.08)),
        F.transform(pairs, lambda p: some("pair:", p, 0.3)),
    )


def _place(dimensions: int) -> list[Column]:
    h = fnv1a("feature")
    return [(h % dimensions).cast("int").alias("index"), F.when(F.shiftrightunsigned(h, 31) % 2 == 1, -1.0).otherwise(1.0).alias("sign")]


def vocabulary(feats: DataFrame, dimensions: int = 384, key: str = "id") -> DataFrame:
    """(feature, index, sign, idf, unseen): each feature's cell, hashed once, and how telling it is; `unseen` is for one that no document has."""
    total = feats.agg(F.count_distinct(key).alias("n"))
    df = feats.groupBy("feature").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.select("feature", *_place(dimensions), idf.alias("idf"), F.ln(1 + (F.col("n") + 0.5) / 0.5).alias("unseen"))


def embed(feats: DataFrame, dimensions: int = 384, key: str = "id", known: DataFrame | None = None) -> DataFrame:
    """(key, index, value): signed hashed vectors of length one, in sparse form.

    Features weigh by their idf in a `known` vocabulary, alike without one.
    """
    value = F.col("sign") * (1 + F.ln(F.greatest("weight", F.lit(1e-4))))
    if known is None:
        placed = feats.select(key, "weight", *_place(dimensions))
    else:
        value = value * F.col("idf")
        placed = feats.join(known, "feature")
    cells = placed.select(key, "index", value.alias("v")).groupBy(key, "index").agg(F.sum("v").alias("v"))
    lists = cells.groupBy(key).agg(F.collect_list(F.struct("index", "v")).alias("cells"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))  # as many cells as dimensions at most
    each = lists.select(key, "norm", F.explode("cells").alias("c"))
    return each.select(key, "c.index", F.coalesce(F.try_divide(F.col("c.v"), F.col("norm")), F.lit(0.0)).alias("value"))


def query_vocabulary(asked: DataFrame, known: DataFrame, dimensions: int = 384) -> DataFrame:
    """The vocabulary of a query's features, with the default for those that no document has."""
    unseen = known.agg(F.first("unseen").alias("unseen"))
    mine = asked.select("feature").distinct().join(known.select("feature", "idf"), "feature", "left").crossJoin(F.broadcast(unseen))  # one row
    return mine.select("feature", *_place(dimensions), F.coalesce("idf", "unseen", F.lit(1.0)).alias("idf"), "unseen")


def vector_scores(doc_vectors: DataFrame, query_vectors: DataFrame, key: str = "id") -> DataFrame:
    """(query, key, vector): cosine over sparse unit vectors; negative similarity counts as none."""
    got = doc_vectors.join(query_vectors.withColumnRenamed("value", "q"), "index").groupBy("query", key).agg(F.sum(F.col("value") * F.col("q")).alias("vector"))
    return got.withColumn("vector", F.greatest(F.lit(0.0), "vector"))


#: Queries that are broadcast at a time.
QUERY_BLOCK = 4096
_ROWS, _CELLS = 2048, 1 << 22


def _best(similarity: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, ties by id; NaN is none."""
    some = np.flatnonzero(~np.isnan(similarity))
    if len(some) > k:
        values = similarity[some]
        least = np.partition(values, len(values) - k)[len(values) - k]
        some = some[values >= least]
    return some[np.lexsort((ids[some], -similarity[some]))[:k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query, rank, key, similarity): the k most similar vectors of each query by exact cosine, rounded to six digits.

    Queries are broadcast in blocks of a fixed number; a task multiplies its vectors with a
    block and keeps its own k best of a query, so the shuffle carries k rows for a query and
    task.  Null vectors and those of length zero are similar to nothing; keys are integers.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null").distinct()
    asked = cut(asked.withColumn("n", F.monotonically_increasing_id()))
    total = asked.count()
    blocks = -(-total // QUERY_BLOCK)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    top = None
    for b in range(max(1, blocks)):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))) == b).select("id", "v").collect()  # about QUERY_BLOCK rows
        ids = np.array([r[0] for r in part], np.int64)
        block = spark.sparkContext.broadcast((ids, _unit(np.array([r[1] for r in part], np.float64))))
        one = rows.mapInArrow(_scan(block, k), "query long, id long, similarity double")
        top = one if top is None else top.unionByName(one)
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    ranked = top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query", "rank", F.col("id").alias(key), "similarity")


def _unit(x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.full_like(x, np.nan), where=length > 0)


def _scan(block, k: int):
    """mapInArrow function: the k best of a partition for each query of the block."""

    def run(batches):
        asked, q = block.value
        found: list[list[np.ndarray]] = [[np.zeros(0), np.zeros(0, np.int64)] for _ in asked]
        for batch in batches:
            lists = batch.column(1)
            for lo in range(0, batch.num_rows if len(asked) else 0, _ROWS):
                part = lists.slice(lo, _ROWS)
                ids = batch.column(0).slice(lo, _ROWS).to_numpy(zero_copy_only=False)
                v = _unit(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1))
                step = max(1, _CELLS // len(part))
                for a in range(0, len(asked), step):
                    for j, row in enumerate(np.round(q[a : a + step] @ v.T, 6), a):
                        row[ids == asked[j]] = np.nan
                        both = np.concatenate([found[j][0], row]), np.concatenate([found[j][1], ids])
                        keep = _best(*both, k)
                        found[j] = [both[0][keep], both[1][keep]]
        sizes = [len(f[0]) for f in found]
        if sum(sizes):
            columns = [np.repeat(asked, sizes), np.concatenate([f[1] for f in found]), np.concatenate([f[0] for f in found])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "id", "similarity"])

    return run


def rank_fusion(ranked: DataFrame, key: str = "id", rank: str = "rank", k: int = 60) -> DataFrame:
    """Reciprocal ranks scaled to one for the first place, the best over a key's aliases."""
    return ranked.groupBy(key).agg(F.max((1.0 / (k + F.col(rank))) / (1.0 / (k + 1))).alias("external"))


def fuse(candidates: DataFrame) -> DataFrame:
    """Total score from a candidate's evidence columns, which are 0 where there is none."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0)) if n in candidates.columns else F.lit(0.0)
    by = ["query"] if "query" in candidates.columns else []
    most = candidates.groupBy(*by).agg(F.max(c("lexical")).alias("__most"))
    met = candidates.join(most, "query") if by else candidates.crossJoin(F.broadcast(most))  # one row
    lexical = F.coalesce(F.try_divide(c("lexical"), F.col("__most")), F.lit(0.0))
    total = 2 * c("exact") + 0.2 * c("coverage") + 0.4 * c("fuzzy") + 0.45 * lexical + 0.25 * c("vector") + F.least(0.15 * c("concept"), F.lit(0.15)) + 0.15 * c("external") + 0.12 * c("production") - 0.25 * c("test_path")
    return met.withColumn("score", total).drop("__most")


def retrieval_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Target recall and mean reciprocal rank of ranked results (case, rank, id) against (case, id)."""
    hit = expected.join(results, ["case", "id"], "left")
    return hit.groupBy("case").agg(F.count("*").alias("targets"), F.count("rank").alias("found"), F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("reciprocal")).agg(F.sum("targets").alias("targets"), F.sum("found").alias("found"), (F.sum("found") / F.sum("targets")).alias("recall"), F.avg("reciprocal").alias("mrr"))
