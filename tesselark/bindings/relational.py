"""Lookups, aggregates, windows, set operations and usage reports on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import blast_risk
from ..operators import catalog, history, processes, ranges, ranking, usage
from ..plans import link
from .common import table

Q, O = {}, {}


def q(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return put


@q("""WITH r AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem),
e AS (SELECT * FROM r WHERE c IN (SELECT c FROM r GROUP BY c HAVING count(*) <= 20)),
m AS (SELECT c FROM e WHERE f = 7), n AS (SELECT f, count(*) AS partner_commits FROM e GROUP BY f),
t AS (SELECT f, count(*) AS cochanges FROM e WHERE f <> 7 AND c IN (SELECT c FROM m) GROUP BY f),
x AS (SELECT t.f AS file, cochanges, partner_commits, (SELECT count(*) FROM m) AS target_commits FROM t JOIN n ON t.f = n.f WHERE cochanges >= 1)
SELECT file, cochanges, partner_commits, target_commits, CAST(cochanges AS DOUBLE) / greatest(1, least(target_commits, partner_commits)) AS coupling,
CAST(cochanges AS DOUBLE) / (target_commits + partner_commits - cochanges) AS jaccard FROM x ORDER BY coupling DESC, cochanges DESC, file LIMIT 20""")
def cochange_context(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))
    return history.cochange(rows, 7, least=1).drop("samples")


@q("""WITH r AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS f FROM lineitem),
e AS (SELECT c FROM r GROUP BY c HAVING count(*) BETWEEN 2 AND 20)
SELECT x.f AS a, y.f AS b, count(*) AS cochanges FROM r x JOIN r y ON x.c = y.c AND x.f < y.f WHERE x.c IN (SELECT c FROM e) GROUP BY 1, 2 HAVING count(*) >= 2""")
def cochange_pairs(spark, d):
    return history.pair_cochange(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@q("""SELECT p_partkey AS id, p_name AS name, p_brand AS qualified_name, CASE WHEN lower(p_brand) = 'ring' THEN 0 WHEN lower(p_name) = 'ring' THEN 1
WHEN lower(p_name) LIKE 'ring%' THEN 2 ELSE 3 END AS match_rank FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%'
ORDER BY match_rank, name, id LIMIT 20""")
def find_symbol(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("qualified_name"))
    return catalog.symbol_matches(p, "ring").orderBy("match_rank", "name", "id").limit(20)


@q("""SELECT n.n_nationkey AS repo_id, n_name AS name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS files,
(SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS symbols,
(SELECT count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = n.n_nationkey) AS edges FROM nation n""")
def list_repositories(spark, d):
    c, s, o, n = (table(spark, d, t) for t in ("customer", "supplier", "orders", "nation"))
    files = c.select(F.col("c_nationkey").alias("repo_id"), "c_custkey")
    edges = o.join(files, F.col("o_custkey") == F.col("c_custkey"))
    repositories = n.select(F.col("n_nationkey").alias("repo_id"), F.col("n_name").alias("name"))
    return catalog.with_counts(repositories, files=files, symbols=s.withColumnRenamed("s_nationkey", "repo_id"), edges=edges)


@q("""SELECT l_returnflag AS kind, l_linestatus AS status, count(*) AS symbols, count(DISTINCT l_partkey) AS files, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS occurrences FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def repository_stats(spark, d):
    items = table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "kind", "l_linestatus": "status"})
    return catalog.symbol_stats(items, ["kind", "status"], "l_partkey", "l_quantity")


@q("""SELECT l_linestatus AS parser_mode, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS resolved, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous,
CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS unresolved, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS resolution_rate FROM lineitem GROUP BY 1""")
def index_diagnostics(spark, d):
    status = F.when(F.col("l_returnflag") == "R", "resolved").when(F.col("l_returnflag") == "A", "ambiguous").when(F.col("l_returnflag") == "N", "unresolved")
    calls = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("parser_mode"), status.alias("status"))
    return catalog.diagnostics(calls, "parser_mode").drop("calls")


@q("""SELECT o_orderkey AS unresolved FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def unresolved_imports(spark, d):
    known = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unresolved"))
    return catalog.unmatched(table(spark, d, "orders").select(F.col("o_orderkey").alias("unresolved")), known, "unresolved")


@q("""SELECT count(*) AS calls, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(avg(value), 1) AS mean_ms,
sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS success_rate FROM events""")
def usage_totals(spark, d):
    return usage.totals(_calls(spark, d))


def _calls(spark, d):
    return table(spark, d, "events").select("ts", "user_id", F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("ok"))


@q("""SELECT event_type AS tool, count(*) AS calls, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(avg(value), 1) AS mean_ms FROM events GROUP BY 1 ORDER BY calls DESC, tool LIMIT 50""")
def usage_by_tool(spark, d):
    return usage.by(_calls(spark, d), "tool")


@q("""SELECT * FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY 1 ORDER BY day DESC LIMIT 180) ORDER BY day""")
def usage_by_day(spark, d):
    return usage.by_day(_calls(spark, d))


@q("""SELECT c.c_custkey AS user_id, (SELECT count(*) FROM events e WHERE e.user_id = c.c_custkey) AS calls FROM customer c""")
def usage_by_repository(spark, d):
    return usage.by_dimension(_calls(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")


@q("""SELECT event_id, user_id FROM events WHERE event_id >= (SELECT min(event_id) FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 5000))""")
def usage_retention(spark, d):
    return usage.retain(table(spark, d, "events").select("event_id", "user_id"), "event_id", 5000)


@q("""SELECT p_type AS language, p_partkey AS id, CAST(rn AS INTEGER) AS rank_in_group, n AS total FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS rn, count(*) OVER () AS n FROM part) WHERE rn <= 5""")
def stratified_sample(spark, d):
    p = table(spark, d, "part")
    total = p.agg(F.count("*").alias("total"))
    return ranking.per_group(p, ["p_type"], ["p_name", "p_partkey"], 5).crossJoin(F.broadcast(total)).select(F.col("p_type").alias("language"), F.col("p_partkey").alias("id"), "rank_in_group", "total")


@q("""SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(spark, d):
    return ranking.latest_by(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@q("""WITH e AS (SELECT user_id AS file_path, CAST(floor(epoch(ts) / 600) AS BIGINT) AS a FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)),
r AS (SELECT file_path, a AS start_line, a + 20 AS end_line FROM e),
m AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT file_path, min(start_line) AS start_line, max(end_line) AS end_line FROM g GROUP BY file_path, i""")
def merged_ranges(spark, d):
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600)
    e = table(spark, d, "events").select(F.col("user_id").alias("file_path"), at.alias("start_line"), (at + 20).alias("end_line"))
    return ranges.merge_ranges(e)


@q("""SELECT p_partkey, p_name FROM part ORDER BY p_partkey <= 1990, p_partkey LIMIT 25""")
def rotating_page(spark, d):
    return ranking.rotating_page(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 1990, 25)


@q("""SELECT p_partkey, p_retailprice, true AS has_more FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 30""")
def offset_page(spark, d):
    return ranking.page(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 15, 30)


@q("""WITH s AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), k AS (SELECT greatest(count(*), 44) AS r FROM s),
r AS (SELECT p_partkey, p.p_brand, p_retailprice, n, row_number() OVER (PARTITION BY p.p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part p JOIN s ON p.p_brand = s.p_brand),
a AS (SELECT p_partkey, p_brand, p_retailprice FROM r ORDER BY rn, n DESC, p_brand LIMIT (SELECT least(200, r) FROM k)),
b AS (SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM a) ORDER BY p_retailprice DESC, p_partkey LIMIT (SELECT 200 - least(200, r) FROM k))
SELECT * FROM a UNION ALL SELECT * FROM b""")
def round_robin_nodes(spark, d):
    return ranking.round_robin(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_partkey", "p_retailprice", 200)


@q("""WITH RECURSIVE o AS (SELECT p_type, p_partkey, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part),
g AS (SELECT p_type, p_partkey, p_size, i, p_size <= 300 AS ok, 300 - CASE WHEN p_size <= 300 THEN p_size ELSE 0 END AS rest FROM o WHERE i = 1
UNION ALL SELECT o.p_type, o.p_partkey, o.p_size, o.i, o.p_size <= g.rest, g.rest - CASE WHEN o.p_size <= g.rest THEN o.p_size ELSE 0 END FROM g JOIN o ON o.p_type = g.p_type AND o.i = g.i + 1)
SELECT p_type, p_partkey, p_size FROM g WHERE ok""")
def greedy_budget(spark, d):
    return ranking.greedy_budget(table(spark, d, "part").select("p_type", "p_partkey", "p_size"), "p_type", "p_partkey", "p_size", 300)


@q("""SELECT c_custkey, symbols, files, CASE WHEN symbols >= 40 OR files >= 15 THEN 'critical' WHEN symbols >= 15 OR files >= 7 THEN 'high' WHEN symbols >= 5 OR files >= 3 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT o_custkey AS c_custkey, count(*) AS symbols, count(DISTINCT o_orderpriority) AS files FROM orders GROUP BY 1)""")
def blast_risks(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("symbols"), F.count_distinct("o_orderpriority").alias("files"))
    return g.withColumn("risk", blast_risk("symbols", "files"))


@q("""WITH b AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0), a AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 4 <> 0)
SELECT coalesce(b.p_partkey, a.p_partkey) AS stable_key, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.p_partkey IS NULL THEN 'removed' ELSE 'modified' END AS change_type
FROM b FULL JOIN a ON a.p_partkey = b.p_partkey WHERE b.p_partkey IS NULL OR a.p_partkey IS NULL OR a.p_size <> b.p_size""")
def change_classification(spark, d):
    from ..operators.temporal import state_diff

    p = table(spark, d, "part")
    before = p.where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("stable_key"), F.col("p_size").alias("fingerprint"))
    after = p.where("p_partkey % 4 != 0").select(F.col("p_partkey").alias("stable_key"), F.expr("if(p_partkey % 5 = 0, p_size + 1, p_size)").alias("fingerprint"))
    return state_diff(before, after)


@q("""SELECT l_orderkey AS target, min(l_suppkey) AS resolved FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1""")
def unique_target_guard(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_suppkey").alias("resolved"))
    return link.unique_target(items, ["target"], "resolved")


@q("""SELECT n_regionkey AS project, list(n_name ORDER BY n_name <> 'CHINA', n_name) AS worktrees FROM nation GROUP BY 1""")
def project_groups(spark, d):
    nations = table(spark, d, "nation").withColumnRenamed("n_regionkey", "project")
    return catalog.projects(nations, "project", "n_name", F.col("n_name") == "CHINA")


@q("""WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT doc_id FROM d WHERE rn = 1""")
def first_wins_distinct(spark, d):
    rows = table(spark, d, "documents").select(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"), "doc_id", (-F.col("n_chars")).alias("o"))
    return ranking.first_wins(rows, ["h", "s"], ["o", "doc_id"]).select("doc_id")


@q("""SELECT l_suppkey AS source, l_partkey AS target, round(max(l_discount), 4) AS confidence FROM lineitem GROUP BY 1, 2""")
def deduplicated_edges(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_discount").alias("confidence"))
    return link.distinct_edges(items).withColumn("confidence", F.round("confidence", 4))


@q("""SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS ordinal FROM orders""")
def ordered_steps(spark, d):
    steps = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return processes.numbered(steps, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_custkey")


@q("""SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size > 20) AS total_rows FROM part WHERE p_size > 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 5""")
def compact_answer(spark, d):
    from ..plans.compact import compact

    return compact(table(spark, d, "part").where("p_size > 20"), [F.desc("p_retailprice"), "p_partkey"], ["p_partkey", "p_name"])
