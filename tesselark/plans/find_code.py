"""Hybrid code search: every kind of evidence joined onto the candidates, fused and paged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_tokens, is_test_path, like_contains, stem_of
from ..operators import search
from ..session import cut

# Words of one concept match each other weakly.
CONCEPTS = {
    "authentication": (
        "access", "allowed", "auth", "authenticate", "authentication", "authorize", "authorization", "credential",
        "deny", "forbid", "identity", "jwt", "login", "logout", "oauth", "password", "permission", "permit", "policy",
        "protect", "protected", "role", "session", "signin", "signout", "token",
    ),
    "persistence": (
        "cache", "database", "db", "document", "insert", "model", "persist", "persistence", "query", "record",
        "repository", "row", "save", "sql", "storage", "store", "table", "transaction", "update",
    ),
    "http": (
        "api", "axios", "client", "controller", "endpoint", "fetch", "handler", "http", "middleware", "request",
        "response", "rest", "route", "router", "server", "status", "url",
    ),
    "validation": (
        "assert", "check", "constraint", "guard", "invalid", "parse", "sanitize", "schema", "validate", "validation",
        "validator", "verify",
    ),
    "failure": (
        "catch", "error", "exception", "fail", "failure", "fallback", "fault", "recover", "recovery", "retry", "throw",
        "timeout",
    ),
    "transformation": (
        "adapt", "convert", "decode", "deserialize", "encode", "format", "map", "normalize", "parse", "render",
        "serialize", "transform",
    ),
    "messaging": (
        "email", "event", "mail", "message", "notification", "notify", "publish", "queue", "send", "sms", "subscribe",
        "webhook",
    ),
    "billing": (
        "bill", "billing", "charge", "checkout", "invoice", "order", "pay", "payment", "price", "purchase", "refund",
        "subscription",
    ),
    "account": ("account", "actor", "customer", "member", "organization", "owner", "principal", "profile", "tenant", "user"),
    "creation": ("add", "build", "create", "generate", "initialize", "make", "new", "register"),
    "deletion": ("clear", "delete", "destroy", "drop", "erase", "invalidate", "purge", "remove", "revoke"),
    "reading": ("fetch", "find", "get", "load", "lookup", "query", "read", "retrieve", "search"),
    "mutation": ("change", "edit", "modify", "patch", "replace", "set", "update", "write"),
    "concurrency": ("async", "concurrent", "job", "lock", "parallel", "promise", "schedule", "task", "thread", "worker"),
    "configuration": ("config", "configuration", "environment", "feature", "flag", "option", "preference", "setting"),
    "observability": ("audit", "debug", "log", "metric", "monitor", "observe", "telemetry", "trace"),
    "cryptography": ("cipher", "decrypt", "digest", "encrypt", "hash", "key", "secret", "sign", "signature"),
}


def concepts(tokens):
    """Concepts that an array of stemmed tokens touches."""
    stems = {name: F.array(*(F.lit(stem_of(w)) for w in words)) for name, words in CONCEPTS.items()}
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(tokens, x), F.lit(name)) for name, x in stems.items()]))


def build(docs: DataFrame) -> dict[str, DataFrame]:
    """What a search needs of its documents (id, name, qualified_name, kind, file_path, signature, body_text), to be stored once.

    postings: (id, term, tf); lengths: (id, dl); terms: (term, df); vocabulary and vectors:
    (id, index, value); names: the tokens of each identifier.
    """
    post = cut(search.postings(docs, search.TERM_WEIGHTS))
    feats = cut(search.features(docs))
    known = cut(search.vocabulary(feats))
    own = F.concat(code_tokens(F.col("name")), code_tokens(F.col("qualified_name")))
    names = docs.select("id", "name", "qualified_name", "kind", "file_path", own.alias("own"), code_tokens("name").alias("tokens"))
    return {
        "postings": post, "lengths": post.groupBy("id").agg(F.sum("tf").alias("dl")), "vocabulary": known,
        "vectors": search.embed(feats, known=known), "names": names,
    }


def find_code(
    docs: DataFrame, query: str, limit: int = 20, offset: int = 0, kind: str | None = None, file_path: str | None = None,
    external: DataFrame | None = None, index: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """A page of documents for one query, with the evidence behind each score.

    Without a stored `index` of the documents one is made of those that the filters leave.  The
    query is one row; it reads its own terms' postings and its own cells' vectors only, and
    only documents with some evidence are scored and sorted.
    """
    if index is None:
        if kind:
            docs = docs.where(F.lower("kind") == kind.lower())
        if file_path:
            docs = docs.where(like_contains("file_path", file_path))
        index = build(docs)
    spark, names = docs.sparkSession, index["names"]
    if kind:
        names = names.where(F.lower("kind") == kind.lower())
    if file_path:
        names = names.where(like_contains("file_path", file_path))
    q = spark.range(1).select(F.lit(0).alias("query"), code_tokens(F.lit(query)).alias("q_tokens"), F.lit(query).alias("q_text"))
    terms = cut(q.select("query", F.explode("q_tokens").alias("term")))
    lexical = search.bm25(index["postings"], terms, index["lengths"]).select("id", F.col("score").alias("lexical"))
    asked = cut(search.features(q.select(F.lit(0).alias("id"), F.col("q_text").alias("name")), {"name": 1.0}))
    query_vector = search.embed(asked, known=search.query_vocabulary(asked, index["vocabulary"])).select(F.col("id").alias("query"), "index", "value")
    vector = search.vector_scores(index["vectors"], F.broadcast(query_vector)).select("id", "vector")  # as many cells as dimensions at most
    tokens = names.select("id", F.explode("tokens").alias("token"))
    near = search.fuzzy_tokens(tokens, terms.select(F.col("term").alias("token")))
    fuzzy = tokens.join(near, "token").groupBy("id").agg(F.max("similarity").alias("fuzzy"))
    base = names.crossJoin(F.broadcast(q))  # one row
    shared = F.size(F.array_intersect(concepts(F.col("own")), concepts(F.col("q_tokens"))))
    base = base.select(
        "id", "name", "qualified_name", "kind", "file_path", "query",
        search.exact_score(F.col("name"), F.col("qualified_name"), F.col("q_tokens"), F.col("q_text")).alias("exact"),
        search.coverage(F.col("own"), F.col("q_tokens"), concepts).alias("coverage"), shared.cast("double").alias("concept"),
        F.when(is_test_path("file_path") & F.lit(not file_path), 1.0).otherwise(0.0).alias("test_path"),
        F.when(is_test_path("file_path"), 0.0).otherwise(1.0).alias("production"),
    )
    got = base.join(lexical, "id", "left").join(vector, "id", "left").join(fuzzy, "id", "left")
    if external is not None:
        got = got.join(search.rank_fusion(external), "id", "left")
    evidence = (F.col("exact") > 0) | (F.col("coverage") > 0) | (F.coalesce("lexical", F.lit(0.0)) > 0) | (F.coalesce("fuzzy", F.lit(0.0)) > 0) | (F.coalesce("vector", F.lit(0.0)) > 0.2)
    scored = search.fuse(cut(got.where(evidence)))  # read twice
    out = scored.select("id", "name", "file_path", F.round("score", 6).alias("score"), F.round("lexical", 6).alias("lexical"), F.round("vector", 6).alias("vector"), "exact", "coverage")
    return out.orderBy(F.desc("score"), "name", "file_path", "id").offset(offset).limit(limit)


def lexical_search(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """BM25 alone, exact and prefix names first; at most twelve terms."""
    spark = docs.sparkSession
    terms = spark.range(1).select(F.lit(0).alias("query"), F.explode(F.slice(code_tokens(F.lit(query)), 1, 12)).alias("term"))
    got = search.bm25(search.postings(docs, search.TERM_WEIGHTS), terms).join(docs.select("id", "name", "file_path"), "id")
    rank = F.when(F.lower("name") == query.lower(), 0).when(F.lower("name").startswith(query.lower()), 1).otherwise(2)
    return got.withColumn("match_rank", rank).orderBy("match_rank", F.desc("score"), "name", "id").limit(limit)


def promote(ranked: DataFrame, calls: DataFrame, anchors: int = 3, beyond: int = 6, share: float = 0.25, most: int = 2) -> DataFrame:
    """(id, position): callees of the first hits, themselves ranked, move up right behind their caller."""
    a = ranked.where(F.col("rank") <= anchors).select(F.col("id").alias("source"), F.col("rank").alias("anchor"), F.col("score").alias("top"))
    c = ranked.where(F.col("rank") > beyond).select(F.col("id").alias("target"), F.col("rank").alias("own"), "score")
    moves = calls.join(a, "source").join(c, "target").where(F.col("score") >= share * F.col("top")).groupBy("target").agg(F.min("anchor").alias("anchor"), F.min("own").alias("own"))
    moves = moves.orderBy("anchor", "own").limit(most)
    placed = ranked.join(F.broadcast(moves.select(F.col("target").alias("id"), "anchor")), "id", "left")
    return placed.select("id", F.struct(F.coalesce("anchor", "rank").alias("a"), F.col("anchor").isNotNull().alias("b"), F.col("rank").alias("c")).alias("position")).orderBy("position")
