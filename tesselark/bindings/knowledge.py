"""History, retrieval, decisions, overlays, processes, coordination, quality and review on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import fleet, history, memory, processes, quality, ranges, review, search, temporal
from .common import CHANGES_SQL, event_changes, table

Q, O = {}, {}


def q(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return put


_INTERVALS = f"""{CHANGES_SQL},
ev AS (SELECT coalesce(previous_stable_key, stable_key) AS stable_key, sequence, 0 AS opens, before AS state FROM changes WHERE change_type <> 'added'
  UNION ALL SELECT stable_key, sequence, 1, after FROM changes WHERE change_type <> 'removed'),
mk AS (SELECT *, lead(sequence) OVER w AS nxt, lag(opens) OVER w AS prev FROM ev WINDOW w AS (PARTITION BY stable_key ORDER BY sequence, opens)),
versions AS (SELECT stable_key, sequence AS valid_from, nxt AS valid_to, state FROM mk WHERE opens = 1 UNION ALL SELECT stable_key, NULL, sequence, state FROM mk WHERE opens = 0 AND prev IS NULL)"""


@q(f"WITH {_INTERVALS} SELECT * FROM versions")
def version_intervals(spark, d):
    return temporal.intervals(event_changes(spark, d))


@q(f"WITH {_INTERVALS} SELECT * FROM versions WHERE (valid_from IS NULL OR valid_from <= 5000) AND (valid_to IS NULL OR valid_to > 5000)")
def episode_replay(spark, d):
    return temporal.replay(temporal.intervals(event_changes(spark, d)), 5000)


@q("SELECT event_id AS sequence, ts AS reference_time, true AS has_more, [user_id || ':' || event_type] AS changes FROM events WHERE event_id > 700 ORDER BY event_id LIMIT 40")
def temporal_changes_since(spark, d):
    e = table(spark, d, "events")
    episodes = e.select(F.col("event_id").alias("sequence"), F.col("ts").alias("reference_time"))
    changes = e.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("stable_key"), F.col("event_type").alias("change_type"))
    got = temporal.changes_since(episodes, changes, 700, 40)
    return got.withColumn("changes", F.transform("changes", lambda x: F.concat_ws(":", x["stable_key"].cast("string"), x["change_type"])))


@q(f"""WITH RECURSIVE {CHANGES_SQL}, l AS (SELECT stable_key AS a, previous_stable_key AS b FROM changes WHERE previous_stable_key IS NOT NULL UNION SELECT previous_stable_key, stable_key FROM changes WHERE previous_stable_key IS NOT NULL),
k(key) AS (SELECT CAST(5 AS BIGINT) UNION SELECT l.b FROM k JOIN l ON l.a = k.key)
SELECT key AS stable_key FROM k""")
def symbol_lineage(spark, d):
    return temporal.lineage(event_changes(spark, d), 5)


@q(f"""WITH RECURSIVE {CHANGES_SQL}, c AS (SELECT * FROM changes), l AS (SELECT stable_key AS a, previous_stable_key AS b FROM c WHERE previous_stable_key IS NOT NULL UNION SELECT previous_stable_key, stable_key FROM c WHERE previous_stable_key IS NOT NULL),
k(key) AS (SELECT CAST(5 AS BIGINT) UNION SELECT l.b FROM k JOIN l ON l.a = k.key)
SELECT sequence, stable_key, change_type FROM c WHERE stable_key IN (SELECT key FROM k) AND reference_time >= TIMESTAMP '2024-01-05' ORDER BY sequence, stable_key LIMIT 100""")
def temporal_timeline(spark, d):
    return temporal.timeline(event_changes(spark, d), 5, start="2024-01-05 00:00:00").select("sequence", "stable_key", "change_type")


@q(f"""WITH {CHANGES_SQL} SELECT CAST(reference_time AS DATE) AS day, CAST(sum(CASE WHEN change_type = 'added' THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN change_type = 'modified' THEN 1 ELSE 0 END) AS BIGINT) AS modified,
CAST(sum(CASE WHEN change_type = 'removed' THEN 1 ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN change_type = 'renamed' THEN 1 ELSE 0 END) AS BIGINT) AS renamed, count(*) AS total FROM changes GROUP BY 1""")
def episode_summary(spark, d):
    return temporal.episode_summary(event_changes(spark, d).withColumn("day", F.to_date("reference_time")), "day")


@q(f"WITH {CHANGES_SQL} SELECT stable_key, count(*) AS changes, count(DISTINCT change_type) AS kinds, min(reference_time) AS first_at, max(reference_time) AS last_at FROM changes GROUP BY 1")
def evolution(spark, d):
    return temporal.evolution(event_changes(spark, d))


@q(f"WITH {_INTERVALS} SELECT (SELECT count(*) FROM changes) AS episodes, (SELECT min(reference_time) FROM changes) AS first_at, (SELECT max(reference_time) FROM changes) AS last_at, count(*) AS versions, CAST(sum(CASE WHEN valid_to IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS open_versions FROM versions")
def temporal_stats(spark, d):
    c = event_changes(spark, d)
    return temporal.stats(c, temporal.intervals(c))


_CHURN = f"""{CHANGES_SQL}, ch AS (SELECT stable_key AS item, count(*) AS changes, sum(CASE change_type WHEN 'modified' THEN 1.0 WHEN 'renamed' THEN 0.75 ELSE 0.5 END * pow(0.5, (epoch_us((SELECT max(reference_time) FROM changes)) - epoch_us(reference_time)) / 86400000000.0 / 90.0)) AS weighted_churn, max(reference_time) AS last_changed FROM changes GROUP BY 1)"""


def _churn(spark, d):
    c = event_changes(spark, d).withColumn("reference_time", F.col("reference_time").cast("timestamp")).withColumnRenamed("stable_key", "item")
    return history.churn(c, "item", "change_type", "reference_time")


@q(f"WITH {_CHURN} SELECT item, changes, round(weighted_churn, 6) AS weighted_churn FROM ch")
def weighted_churn(spark, d):
    return _churn(spark, d).select("item", "changes", F.round("weighted_churn", 6).alias("weighted_churn"))


@q(f"""WITH {_CHURN} SELECT c_custkey AS item, round((o + t) * log2(2.0 + coalesce(weighted_churn, 0)), 5) AS score FROM (SELECT o_custkey AS c_custkey, count(*) AS o, count(DISTINCT o_orderpriority) AS t FROM orders GROUP BY 1) x LEFT JOIN ch ON ch.item = c_custkey ORDER BY (o + t) * log2(2.0 + coalesce(weighted_churn, 0)) DESC, item LIMIT 50""")
def find_hotspots(spark, d):
    cx = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("cyclomatic"), F.count_distinct("o_orderpriority").alias("cognitive"))
    return history.hotspots(cx, _churn(spark, d), "item").select("item", F.round("score", 5).alias("score"))


@q("""WITH p AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
tf AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS tf FROM p GROUP BY 1, 2), dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY 1), c AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
qt AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT query, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM qt JOIN tf ON tf.term = qt.term JOIN df ON df.term = tf.term JOIN dl ON dl.id = tf.id, c GROUP BY 1, 2""")
def bm25_scores(spark, d):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    post = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(words("text")).alias("term")).groupBy("id", "term").agg(F.count("*").cast("double").alias("tf"))
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(words("text")).alias("term"))
    return search.bm25(post, terms).select("query", "id", F.round("score", 6).alias("score"))


_GRAMS = "list_distinct(list_transform(generate_series(1, length({0})), lambda i: substr('^' || {0} || '$', i, 3)))"


@q(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), qt AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS query_token FROM benchmark),
g AS MATERIALIZED (SELECT token, {_GRAMS.format("token")} AS gs FROM t WHERE length(token) >= 4), h AS MATERIALIZED (SELECT query_token, {_GRAMS.format("query_token")} AS gs FROM qt WHERE length(query_token) >= 4),
m AS (SELECT query_token, token, count(*) AS c, any_value(n) AS n, any_value(k) AS k FROM (SELECT token, len(gs) AS n, unnest(gs) AS gram FROM g) x JOIN (SELECT query_token, len(gs) AS k, unnest(gs) AS gram FROM h) y ON x.gram = y.gram
  WHERE token <> query_token AND abs(length(token) - length(query_token)) <= 2 GROUP BY 1, 2)
SELECT query_token, token, round(2.0 * c / (n + k), 6) AS similarity FROM m WHERE 2.0 * c / (n + k) >= 0.55""")
def fuzzy_identifiers(spark, d):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    t = table(spark, d, "documents").select(F.explode(words("text")).alias("token"))
    b = table(spark, d, "benchmark").select(F.explode(words("text")).alias("token"))
    return search.fuzzy_tokens(t, b).withColumn("similarity", F.round("similarity", 6))


@q("""WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.v), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.v, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS similarity FROM embeddings e, q WHERE e.vec_id <> query)
SELECT query, CAST(rank AS INTEGER) AS rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def nearest_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return search.nearest(e, e.where("vec_id % 20 = 0"), 10)


@q("""SELECT doc_id AS id, max((1.0 / (60 + rank)) / (1.0 / 61)) AS external FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) GROUP BY 1""")
def reciprocal_ranks(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return search.rank_fusion(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.row_number().over(w).alias("rank")))


_STEM = """list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: CASE WHEN length(t) <= 3 THEN t WHEN t LIKE '%ies' AND length(t) > 5 THEN substr(t, 1, length(t) - 3) || 'y' WHEN t LIKE '%ing' AND length(t) > 6 THEN substr(t, 1, length(t) - 3)
WHEN t LIKE '%ed' AND length(t) > 5 THEN substr(t, 1, length(t) - 2) WHEN t LIKE '%es' AND length(t) > 5 THEN substr(t, 1, length(t) - 2) WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 4 THEN substr(t, 1, length(t) - 1) ELSE t END), lambda t: length(t) > 1)"""


@q(f"""WITH f AS (SELECT p_partkey AS id, 5.0 AS w, {_STEM.format("p_name")} AS ts FROM part UNION ALL SELECT p_partkey, 3.5, {_STEM.format("p_brand")} FROM part UNION ALL SELECT p_partkey, 1.5, {_STEM.format("p_type")} FROM part),
x AS (SELECT id, 'token:' || t AS feature, w FROM (SELECT id, w, unnest(ts) AS t FROM f)
  UNION ALL SELECT id, 'char3:' || unnest(list_transform(generate_series(1, length(t)), lambda i: substr('^' || t || '$', i, 3))), 0.08 * w FROM (SELECT id, w, unnest(ts) AS t FROM f) WHERE length(t) BETWEEN 5 AND 32
  UNION ALL SELECT id, 'pair:' || unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ':' || ts[i + 1])), 0.3 * w FROM f),
g AS (SELECT id, feature, CAST(sum(w) AS DOUBLE) AS weight FROM x GROUP BY 1, 2),
h AS (SELECT id, weight, list_reduce(list_transform(string_split(feature, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h FROM g),
c AS (SELECT id, CAST(h % 384 AS INTEGER) AS index, sum(CASE WHEN h >= 2147483648 THEN -1.0 ELSE 1.0 END::DOUBLE * (1 + ln(greatest(weight, 1e-4)))) AS v FROM h GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM c GROUP BY 1)
SELECT c.id, index, round(CASE WHEN norm > 0 THEN v / norm ELSE 0 END, 6) + 0 AS value FROM c JOIN n ON n.id = c.id""")
def hashed_embeddings(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("qualified_name"), F.col("p_type").alias("kind"))
    return search.embed(search.features(docs), 384).withColumn("value", F.round("value", 6))


@q()
def find_code(spark, d):
    from ..plans.find_code import find_code as plan

    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("qualified_name"), F.col("p_type").alias("kind"), F.concat_ws("/", "p_brand", "p_name").alias("file_path"), F.lit("").alias("signature"), F.col("p_name").alias("body_text"))
    return plan(docs, "red rings", limit=20)


@q("""WITH r AS (SELECT q AS case_, row_number() OVER (PARTITION BY q ORDER BY n_chars DESC, doc_id) AS rank, doc_id AS id FROM (SELECT source AS q, n_chars, doc_id FROM documents)), e AS (SELECT d.source AS case_, l.doc_id AS id FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 1),
j AS (SELECT e.case_, e.id, r.rank FROM e LEFT JOIN r ON r.case_ = e.case_ AND r.id = e.id AND r.rank <= 20), c AS (SELECT case_, count(*) AS targets, count(rank) AS found, coalesce(max(1.0 / rank), 0.0) AS reciprocal FROM j GROUP BY 1)
SELECT CAST(sum(targets) AS BIGINT) AS targets, CAST(sum(found) AS BIGINT) AS found, CAST(sum(found) AS DOUBLE) / sum(targets) AS recall, avg(reciprocal) AS mrr FROM c""")
def retrieval_metrics(spark, d):
    from ..operators.ranking import per_group

    docs = table(spark, d, "documents").select(F.col("source").alias("case"), "n_chars", F.col("doc_id").alias("id"))
    ranked = per_group(docs, ["case"], [F.desc("n_chars"), F.col("id")], 20).select("case", "id", F.col("rank_in_group").alias("rank"))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return search.retrieval_metrics(ranked, docs.join(good, "id").select("case", "id"))


@q("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
h AS (SELECT doc_id AS file_path, line, text, instr(text, 'stupid') AS e, instr(lower(text), 'stupid') AS f FROM l WHERE instr(lower(text), 'stupid') > 0),
r AS (SELECT *, bool_or(e > 0) OVER (PARTITION BY file_path) AS any_ FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line) AS n FROM r WHERE NOT any_ OR e > 0)
SELECT file_path, CAST(line AS INTEGER) AS line, CAST(CASE WHEN e > 0 THEN e ELSE f END AS INTEGER) AS "column", CASE WHEN e > 0 THEN 'exact' ELSE 'case_insensitive' END AS match, text FROM k WHERE n <= 20""")
def literal_evidence(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), F.col("text").alias("content"))
    return ranges.literal_evidence(docs, "stupid")


@q("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id = 17)
SELECT doc_id AS file_path, CAST(line AS INTEGER) AS line, text, CAST(n AS INTEGER) AS total_lines, CAST(1 AS INTEGER) AS previous_start, CAST(CASE WHEN n > 5 THEN 6 END AS INTEGER) AS next_start FROM l WHERE line BETWEEN 2 AND 5""")
def source_window(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), F.col("text").alias("content"))
    return ranges.source_window(docs, 17, 2, 5)


@q("""WITH last AS (SELECT user_id AS decision_id, arg_max({'h': event_type <> 'error', 'v': value}, (ts, event_id)) AS x FROM events GROUP BY 1),
d AS (SELECT c_custkey AS decision_id, CASE WHEN c_custkey % 7 = 0 THEN 'superseded' WHEN c_custkey % 11 = 0 THEN 'rejected' ELSE 'active' END AS status FROM customer),
v AS (SELECT d.decision_id, CASE WHEN status = 'superseded' THEN 'Superseded' WHEN status = 'rejected' THEN 'Rejected' WHEN x IS NULL THEN 'CannotProve' WHEN x.h THEN 'Held' ELSE 'ViolatedAt' END AS verdict, x.v AS v FROM d LEFT JOIN last ON last.decision_id = d.decision_id)
SELECT decision_id, verdict, CASE WHEN verdict = 'ViolatedAt' THEN v END AS location FROM v""")
def verify_intent(spark, d):
    o = table(spark, d, "events").select(F.col("user_id").alias("decision_id"), F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("held"), F.col("value").alias("location"))
    status = F.when(F.col("c_custkey") % 7 == 0, "superseded").when(F.col("c_custkey") % 11 == 0, "rejected").otherwise("active")
    return memory.verify(table(spark, d, "customer").select(F.col("c_custkey").alias("decision_id"), status.alias("status")), o)


@q("""WITH s AS (SELECT c_custkey AS decision_id, 'symbol' AS t, c_custkey AS k FROM customer UNION ALL SELECT c_custkey, 'file', c_nationkey FROM customer UNION ALL SELECT c_custkey, 'repository', c_nationkey % 5 FROM customer),
m AS (SELECT decision_id, t, CASE t WHEN 'symbol' THEN 1 WHEN 'file' THEN 2 ELSE 3 END AS w FROM s WHERE (t = 'symbol' AND k = 77) OR (t = 'file' AND k = 4) OR (t = 'repository' AND k = 2)),
b AS (SELECT decision_id, min(w) AS width, arg_min(t, w) AS scope_type FROM m GROUP BY 1)
SELECT b.decision_id, scope_type, CAST(width AS INTEGER) AS width, c_mktsegment AS kind, c_mktsegment IN ('ban', 'convention') AS implied_prohibition FROM b JOIN customer ON c_custkey = b.decision_id WHERE c_acctbal > 5000""")
def governing_contracts(spark, d):
    c = table(spark, d, "customer")
    scopes = [c.select(F.col("c_custkey").alias("decision_id"), F.lit(t).alias("scope_type"), k.cast("long").alias("scope_key")) for t, k in (("symbol", F.col("c_custkey")), ("file", F.col("c_nationkey")), ("repository", F.col("c_nationkey") % 5))]
    decisions = c.select(F.col("c_custkey").alias("decision_id"), F.when(F.col("c_acctbal") > 5000, "active").otherwise("retired").alias("status"), F.col("c_mktsegment").alias("kind"))
    return memory.governing(decisions, scopes[0].unionByName(scopes[1]).unionByName(scopes[2]), 2, 4, 77).drop("status")


@q("""WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 5 = 0 THEN 'added' ELSE 'modified' END AS ty, p_size AS base, p_name || CASE WHEN p_partkey % 4 = 0 THEN '!' ELSE '' END AS n, p_name AS bn, p_size + 1 AS z, p_size AS bz FROM part WHERE p_partkey % 2 = 0),
t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'removed' WHEN p_partkey % 10 = 0 THEN 'added' ELSE 'modified' END AS ty, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_size END AS base, p_name || CASE WHEN p_partkey % 3 = 0 THEN '?' ELSE '' END AS n, p_name AS bn, CASE WHEN p_partkey % 8 = 0 THEN p_size + 2 ELSE p_size END AS z, p_size AS bz FROM part WHERE p_partkey % 3 <> 1)
SELECT coalesce(s.k, t.k) AS stable_key, CASE WHEN t.ty IS NULL THEN 'take_source' WHEN s.ty IS NULL THEN 'keep_target' WHEN s.ty = 'removed' AND t.ty = 'removed' THEN 'noop' WHEN s.ty = 'removed' OR t.ty = 'removed' THEN 'conflict:delete_modify'
WHEN s.ty = t.ty AND s.n = t.n AND s.z = t.z THEN 'noop' WHEN s.ty = 'added' AND t.ty = 'added' THEN 'conflict:add_add' WHEN s.ty <> t.ty THEN 'conflict:change_type_mismatch' WHEN s.base <> t.base THEN 'conflict:symbol_base_mismatch'
WHEN (s.n <> t.n AND s.n <> s.bn AND t.n <> s.bn) OR (s.z <> t.z AND s.z <> s.bz AND t.z <> s.bz) THEN 'conflict:edit_edit' ELSE 'merge' END AS action,
CASE WHEN s.n IS NOT DISTINCT FROM s.bn THEN t.n ELSE s.n END AS name, CASE WHEN s.z IS NOT DISTINCT FROM s.bz THEN t.z ELSE s.z END AS size FROM s FULL JOIN t ON s.k = t.k""")
def plan_worktree_merge(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    end = lambda n, mark: F.concat("p_name", F.when(k % n == 0, mark).otherwise(""))
    s = p.where("p_partkey % 2 = 0").select(k.alias("stable_key"), F.when(k % 7 == 0, "removed").when(k % 5 == 0, "added").otherwise("modified").alias("change_type"), F.col("p_size").alias("base_fingerprint"), end(4, "!").alias("name"), F.col("p_name").alias("base_name"), (F.col("p_size") + 1).alias("size"), F.col("p_size").alias("base_size"))
    t = p.where("p_partkey % 3 != 1").select(k.alias("stable_key"), F.when(k % 6 == 0, "removed").when(k % 10 == 0, "added").otherwise("modified").alias("change_type"), F.when(k % 13 == 0, 0).otherwise(F.col("p_size")).alias("base_fingerprint"), end(3, "?").alias("name"), F.col("p_name").alias("base_name"), F.when(k % 8 == 0, F.col("p_size") + 2).otherwise(F.col("p_size")).alias("size"), F.col("p_size").alias("base_size"))
    return memory.plan_merge(s, t, ["name", "size"])


@q("""WITH l AS (SELECT conv_id, list(text ORDER BY turn) AS steps, arg_min(role, turn) AS kind FROM conversations GROUP BY 1)
SELECT conv_id, kind, substr(sha256(concat_ws('|', kind, coalesce(steps[1], ''), coalesce(steps[2], ''), coalesce(steps[3], ''), coalesce(steps[len(steps)], ''))), 1, 16) AS digest, CAST(len(steps) AS INTEGER) AS n_steps FROM l""")
def process_candidates(spark, d):
    return processes.candidates(table(spark, d, "conversations"), "conv_id", "turn", "text", "role").drop("steps")


@q("""WITH k AS (SELECT conv_id AS k, count(*) AS f, conv_id % 4 <> 0 AS active FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1), f AS (SELECT conv_id AS k, count(*) + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS f FROM conversations WHERE conv_id % 7 <> 0 GROUP BY 1)
SELECT coalesce(k.k, f.k) AS process_key, CASE WHEN k.f IS NULL THEN 'added' WHEN f.f IS NULL AND active THEN 'retired' WHEN f.f IS NULL THEN 'kept' WHEN NOT active THEN 'reactivated' WHEN k.f <> f.f THEN 'modified' ELSE 'unchanged' END AS change FROM k FULL JOIN f ON k.k = f.k""")
def refresh_processes(spark, d):
    n = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("process_key")).agg(F.count("*").alias("fingerprint"))
    known = n.where("process_key % 3 != 0").withColumn("active", F.col("process_key") % 4 != 0)
    found = n.where("process_key % 7 != 0").withColumn("fingerprint", F.col("fingerprint") + F.when(F.col("process_key") % 5 == 0, 1).otherwise(0))
    return processes.refresh(known, found)


@q("""SELECT 'processes' AS section, 'available' AS status, count(*) AS n FROM conversations UNION ALL SELECT 'decisions', 'available_empty', 0 UNION ALL SELECT 'hotspots', 'missing', NULL""")
def codebase_briefing(spark, d):
    c = table(spark, d, "conversations")
    return processes.briefing(spark, processes=c, decisions=c.where("turn < 0"), hotspots=None)


def _intents(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("intent"), F.col("user_id").alias("agent"), F.when(F.col("event_type") == "error", "delete").otherwise("modify").alias("kind"), F.array(F.col("event_id") % 90, F.col("user_id") % 40).alias("targets"), "ts")


_INTENTS = """t AS (SELECT DISTINCT event_id AS intent, user_id AS agent, event_type = 'error' AS del, unnest([event_id % 90, user_id % 40]) AS target FROM events),
c AS (SELECT a.intent, count(b.intent) AS others, coalesce(bool_or((a.del OR b.del) AND b.intent IS NOT NULL), false) AS c FROM t a LEFT JOIN t b ON a.target = b.target AND a.agent <> b.agent GROUP BY 1)"""


@q(f"""WITH {_INTENTS} SELECT intent, CASE WHEN c THEN 'C' WHEN others > 0 THEN 'B' ELSE 'A' END AS conflict_class, others AS active_conflicts FROM c""")
def fleet_conflicts(spark, d):
    return fleet.conflicts(_intents(spark, d))


@q("""SELECT event_id AS intent FROM events WHERE epoch(date_trunc('second', TIMESTAMP '2024-01-10 00:00:00')) - floor(epoch(ts)) >= 0 AND epoch(TIMESTAMP '2024-01-10 00:00:00') - floor(epoch(ts)) < 3600""")
def fleet_active(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("intent"), F.col("ts").cast("timestamp").alias("at"))
    return fleet.active(e, "2024-01-10 00:00:00", 3600).select("intent")


@q("""SELECT event_id AS request, user_id AS target, event_id = first_value(event_id) OVER w AS granted, nullif(first_value(event_id) OVER w, event_id) AS blocker FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def fleet_leases(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("request"), F.col("user_id").alias("target"), F.col("ts").alias("at"))
    return fleet.leases(e)


@q("""WITH u AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
SELECT coalesce(CASE WHEN o_orderstatus = 'F' THEN 'exported' WHEN o_orderpriority LIKE '1%' THEN 'entry_file' WHEN o_totalprice > 200000 THEN 'test_file' END, 'candidate') AS excluded_by, count(*) AS symbols FROM u GROUP BY 1""")
def find_dead_code(spark, d):
    rules = [("exported", F.col("o_orderstatus") == "F"), ("entry_file", F.col("o_orderpriority").startswith("1")), ("test_file", F.col("o_totalprice") > 200000)]
    return quality.exclusion_counts(quality.dead_code(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), rules, "o_orderkey"))


_STYLE = {"ending": {"period": r"\.", "comma": ","}, "breaks": {"newline": "\n", "pipe": r"\|"}}


@q("""WITH c AS (SELECT lang, sum(len(regexp_extract_all(text, '\\.'))) AS p, sum(len(regexp_extract_all(text, ','))) AS c, sum(len(regexp_extract_all(text, chr(10)))) AS n, sum(len(regexp_extract_all(text, '\\|'))) AS b FROM documents GROUP BY 1),
r AS (SELECT lang, 'ending' AS dimension, CASE WHEN p >= c THEN 'period' ELSE 'comma' END AS choice, greatest(p, c) AS m, p + c AS t FROM c UNION ALL SELECT lang, 'breaks', CASE WHEN n > b THEN 'newline' ELSE 'pipe' END, greatest(n, b), n + b FROM c)
SELECT lang, dimension, choice, CAST(m AS BIGINT) AS matches, round(CAST(m AS DOUBLE) / t, 6) AS dominance, round(0.25 + 0.7 * (CAST(m AS DOUBLE) / t) * least(1.0, log2(t + 1) / 5), 6) AS confidence FROM r WHERE t > 0""")
def style_fingerprint(spark, d):
    return quality.style(table(spark, d, "documents"), _STYLE)


def _findings(spark, d):
    sev = F.expr("elt(cast(o_orderkey % 4 as int) + 1, 'critical', 'error', 'warning', 'info')")
    return table(spark, d, "orders").select(sev.alias("severity"), F.round(F.col("o_totalprice") / 1e6, 4).alias("confidence"), (F.col("o_orderkey") % 7).cast("string").alias("code"), (F.col("o_custkey") % 30).cast("string").alias("file_path"), (F.col("o_orderkey") % 3).cast("int").alias("line"), F.col("o_orderpriority").alias("message"))


_FINDINGS = """f AS (SELECT ['critical','error','warning','info'][o_orderkey % 4 + 1] AS severity, o_orderkey % 4 AS s, round(o_totalprice / 1e6, 4) AS confidence, CAST(o_orderkey % 7 AS VARCHAR) AS code, CAST(o_custkey % 30 AS VARCHAR) AS file_path, CAST(o_orderkey % 3 AS INTEGER) AS line, o_orderpriority AS message FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY code, file_path, line ORDER BY s, confidence DESC, message) AS r FROM f)"""


@q(f"WITH {_FINDINGS} SELECT severity, confidence, code, file_path, line, message FROM b WHERE r = 1")
def review_findings(spark, d):
    return review.dedupe(_findings(spark, d))


@q(f"WITH {_FINDINGS} SELECT count(*) AS findings, CASE WHEN min(s) <= 1 THEN 'changes_requested' WHEN min(s) = 2 THEN 'review_required' ELSE 'no_blocking_findings' END AS verdict FROM b WHERE r = 1")
def review_verdict(spark, d):
    return review.verdict(review.dedupe(_findings(spark, d)))


@q("""WITH l AS (SELECT doc_id AS file_path, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line FROM documents)
SELECT 'error' AS severity, 1.0::DOUBLE AS confidence, 'local-rule:r1' AS code, file_path, line, 'no idiots' AS message FROM l WHERE contains(text, 'idiot') UNION ALL SELECT 'warning', 1.0, 'local-rule:r2', file_path, line, 'LICENSED' FROM l WHERE contains(lower(text), 'licensed')""")
def literal_rules(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return review.literal_rules(lines, [{"id": "r1", "contains": "idiot", "severity": "error", "message": "no idiots"}, {"id": "r2", "contains": "LICENSED", "case_sensitive": False}])


@q("""WITH r AS (SELECT user_id AS file_path, CAST(event_id % 400 AS BIGINT) AS a, CAST(event_id % 400 + 5 AS BIGINT) AS z FROM events), s AS (SELECT p_partkey % 150 AS file_path, p_partkey AS symbol, CAST(p_size * 7 AS BIGINT) AS a, CAST(p_size * 7 + p_size AS BIGINT) AS z FROM part),
h AS (SELECT DISTINCT r.file_path, r.a AS ra, r.z AS rz, s.symbol, s.a, s.z FROM r JOIN s ON s.file_path = r.file_path AND s.a <= r.z AND s.z >= r.a)
SELECT file_path, ra AS start_line, rz AS end_line, symbol FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.file_path = x.file_path AND y.ra = x.ra AND y.rz = x.rz AND y.a >= x.a AND y.z <= x.z AND y.z - y.a < x.z - x.a)""")
def changed_symbols(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("file_path"), (F.col("event_id") % 400).alias("start_line"), (F.col("event_id") % 400 + 5).alias("end_line")).distinct()
    p = F.col("p_size").cast("long")
    s = table(spark, d, "part").select((F.col("p_partkey") % 150).alias("file_path"), F.col("p_partkey").alias("symbol"), (p * 7).alias("start_line"), (p * 7 + p).alias("end_line"))
    return ranges.map_ranges(r, s)


@q("""SELECT p_partkey, list_filter(list_transform(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda t: CASE WHEN length(t) <= 3 THEN t WHEN t LIKE '%ies' AND length(t) > 5 THEN substr(t, 1, length(t) - 3) || 'y' WHEN t LIKE '%ing' AND length(t) > 6 THEN substr(t, 1, length(t) - 3)
WHEN t LIKE '%ed' AND length(t) > 5 THEN substr(t, 1, length(t) - 2) WHEN t LIKE '%es' AND length(t) > 5 THEN substr(t, 1, length(t) - 2) WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 4 THEN substr(t, 1, length(t) - 1) ELSE t END), lambda t: length(t) > 1) AS tokens FROM part""")
def code_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", fx.code_tokens(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"))).alias("tokens"))
