"""The engine's calls: one method for each, DataFrames in and out.

State is append-only: every write is a Parquet part under the engine's folder, and the
current state of anything is the latest row of its key.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import clamp, is_entry_path
from .operators import catalog, fleet, graph, history, memory, processes, quality, ranges, ranking, review, search, services, temporal, usage
from .plans import find_code as code_search
from .plans import index
from .sources import git
from .session import cut

# Fixed schemas of the append-only tables.
LOGS = {
    "generations": "repo_id string, generation string, root string, at timestamp",
    "episodes": "repo_id string, episode_key string, type string, sequence long, reference_time timestamp, fingerprint string, message string",
    "changes": "repo_id string, sequence long, reference_time timestamp, entity_type string, stable_key string, previous_stable_key string, change_type string, before string, after string, file_path string",
    "decisions": "repo_id string, decision_id string, kind string, title string, rationale string, tags array<string>, alternatives array<string>, provenance string, at timestamp",
    "decision_status": "decision_id string, status string, superseded_by string, at timestamp",
    "decision_scopes": "decision_id string, scope_type string, scope_key string",
    "observations": "decision_id string, held boolean, location string, at timestamp",
    "overlays": "repo_id string, name string, base string, status string, revision long, at timestamp",
    "overlay_symbols": "repo_id string, name string, revision long, stable_key string, change_type string, base_fingerprint string, signature string, base_signature string, body string, base_body string",
    "identities": "service_key string, name string, confidence double, evidence string, at timestamp",
    "service_links": "service_key string, repo_id string, role string, confidence double, created_at timestamp, removed boolean",
    "service_operations": "op string, repo_id string, direction string, protocol string, key string, confidence double, broker string, service string, base_url_known boolean, at timestamp",
    "processes": "repo_id string, process_key string, name string, source string, steps array<string>, fingerprint string, active boolean, at timestamp",
    "refreshes": "repo_id string, process_key string, change string, at timestamp",
    "usage": "repo_id string, tool string, duration_ms double, ok boolean, ts timestamp",
    "intents": "intent string, agent string, kind string, targets array<string>, at timestamp, cancelled boolean",
    "leases": "request string, agent string, target string, at timestamp, released boolean",
    "fleet_episodes": "episode string, agent string, conflict_class string, at timestamp",
    "resolutions": "episode string, directive string, winner string, at timestamp",
}


class Engine:
    """All calls over one state folder."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    # state ----------------------------------------------------------------------------------

    def log(self, name: str) -> DataFrame:
        """An append-only table; empty where nothing has been written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(LOGS[name]).parquet(f"{self.home}/{name}") if there else self.spark.createDataFrame([], LOGS[name])

    def append(self, name: str, *rows: dict) -> None:
        from pyspark.sql.types import StructType

        names = StructType.fromDDL(LOGS[name]).fieldNames()
        self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], LOGS[name]).coalesce(1).write.mode("append").parquet(f"{self.home}/{name}")

    @staticmethod
    def now() -> datetime:
        return datetime.now(timezone.utc).replace(tzinfo=None)

    def latest(self, name: str, *keys: str, by: str = "at") -> DataFrame:
        df = self.log(name)
        rest = [c for c in df.columns if c not in keys]
        return ranking.latest_by(df, list(keys), [by], rest)

    def repository(self, repo_id: str | None = None) -> tuple[str, str]:
        """(repository, folder of its current generation); the id may be left out where there is only one."""
        rows = self.latest("generations", "repo_id")
        rows = (rows if repo_id is None else rows.where(F.col("repo_id") == repo_id)).limit(2).collect()
        if len(rows) != 1:
            raise ValueError("repo_id is required" if rows else "no such repository is indexed")
        return rows[0]["repo_id"], f"{self.home}/repos/{rows[0]['repo_id']}/{rows[0]['generation']}"

    def tables(self, repo_id: str | None = None) -> dict[str, DataFrame]:
        return index.load(self.spark, self.repository(repo_id)[1])

    def symbol_edges(self, repo_id: str | None = None, kinds: tuple[str, ...] = ("calls", "dom-selector")) -> DataFrame:
        return self.tables(repo_id)["edges"].where(F.col("kind").isin(*kinds))

    # indexing and lookups ---------------------------------------------------------------------

    def index_directory(self, path: str, repo_id: str, force: bool = False) -> DataFrame:
        try:
            known = self.tables(repo_id)
        except ValueError:
            known = None
        generation = uuid.uuid4().hex
        after = index.index_directory(self.spark, path, repo_id, f"{self.home}/repos/{repo_id}/{generation}", known, force)
        diff = index.changes(known, after)
        self.append("generations", {"repo_id": repo_id, "generation": generation, "root": path, "at": self.now()})
        if not diff.isEmpty():
            sequence = 1 + (self.log("episodes").where(F.col("repo_id") == repo_id).agg(F.max("sequence")).head()[0] or 0)
            self.append("episodes", {"repo_id": repo_id, "episode_key": f"index:{generation}", "type": "index", "sequence": sequence, "reference_time": self.now(), "fingerprint": generation})
            rows = diff.select(F.lit(repo_id).alias("repo_id"), F.lit(sequence).cast("long").alias("sequence"), F.current_timestamp().alias("reference_time"), F.lit("symbol").alias("entity_type"), "stable_key", F.lit(None).cast("string").alias("previous_stable_key"), "change_type", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), F.substring_index("stable_key", ":", 1).alias("file_path"))
            rows.write.mode("append").parquet(f"{self.home}/changes")
        return after["files"].agg(F.count("*").alias("files")).crossJoin(after["symbols"].agg(F.count("*").alias("symbols"))).crossJoin(after["edges"].agg(F.count("*").alias("edges")))  # one row each

    def list_indexed_repositories(self) -> DataFrame:
        return self.latest("generations", "repo_id").orderBy(F.desc("at"), "repo_id")

    def get_repository_stats(self, repo_id: str | None = None) -> DataFrame:
        t = self.tables(repo_id)
        count = lambda df, what, by: df.groupBy(by).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.col(by).alias("key"), "n")
        return count(t["files"], "files", "language").unionByName(count(t["symbols"], "symbols", "kind")).unionByName(count(t["edges"], "edges", "kind")).orderBy("what", "key")

    def get_index_diagnostics(self, repo_id: str | None = None) -> DataFrame:
        return catalog.diagnostics(self.tables(repo_id)["calls"])

    def find_symbol(self, name: str, repo_id: str | None = None, fuzzy: bool = True, kind: str | None = None, file_path: str | None = None, limit: int | None = None) -> DataFrame:
        hit = catalog.symbol_matches(self.tables(repo_id)["symbols"], name, fuzzy, kind, file_path)
        return hit.orderBy("match_rank", "name", "file_path", "start_line").limit(clamp(limit, 20, 1, 100)).drop("body")

    def best_symbol(self, name: str, repo_id: str | None = None, file_path: str | None = None) -> str:
        s = self.tables(repo_id)["symbols"]
        hit = s.where((F.col("stable_key") == name) | (F.col("qualified_name") == name) | (F.col("name") == name))
        hit = hit.where(F.col("file_path") == file_path) if file_path else hit
        row = hit.orderBy(F.desc(F.col("stable_key") == name), F.desc(F.col("qualified_name") == name), F.desc("exported"), "file_path", "start_line").select("stable_key").head()
        if row is None:
            raise ValueError(f"no symbol {name}")
        return row[0]

    def find_code(self, query: str, repo_id: str | None = None, file_path: str | None = None, kind: str | None = None, limit: int | None = None, cursor: int = 0) -> DataFrame:
        t = self.tables(repo_id)
        stored = {name: t[f"search_{name}"] for name in index.SEARCH_TABLES}
        return code_search.find_code(index.search_documents(t["symbols"]), query, clamp(limit, 20, 1, 100), cursor, kind, file_path, index=stored)

    def get_source_window(self, file_path: str, repo_id: str | None = None, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
        return ranges.source_window(self.tables(repo_id)["files"], file_path, start_line, end_line)

    def get_symbol_context(self, symbol: str, repo_id: str | None = None, file_path: str | None = None) -> DataFrame:
        key, e = self.best_symbol(symbol, repo_id, file_path), self.symbol_edges(repo_id)
        callers = e.where(F.col("target") == key).select(F.lit("caller").alias("relation"), F.col("source").alias("symbol"), "confidence")
        callees = e.where(F.col("source") == key).select(F.lit("callee").alias("relation"), F.col("target").alias("symbol"), "confidence")
        return callers.unionByName(callees).orderBy("relation", F.desc("confidence"), "symbol")

    def get_code_relationships(self, repo_id: str | None = None, symbol: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
        e = self.tables(repo_id)["edges"]
        e = e.where(F.col("kind") == category) if category else e
        e = e.where((F.col("source") == symbol) | (F.col("target") == symbol) | (F.col("label") == symbol)) if symbol else e
        return e.orderBy("kind", "source", "target", "label").limit(clamp(limit, 200, 1, 1000))

    # graph ------------------------------------------------------------------------------------

    def get_impact(self, target: str, repo_id: str | None = None, file_path: str | None = None, direction: str = "upstream", depth: int | None = None, edge_kinds: tuple[str, ...] = ("calls", "dom-selector")) -> DataFrame:
        key = self.best_symbol(target, repo_id, file_path)
        start = self.spark.range(1).select(F.lit(key).alias("node"))
        return graph.impact(self.symbol_edges(repo_id, tuple(edge_kinds)), start, direction, clamp(depth, 5, 1, 15))

    def get_dependency_path(self, source: str, target: str, repo_id: str | None = None, max_depth: int | None = None, min_confidence: float = 0.0) -> DataFrame:
        return graph.dependency_path(self.symbol_edges(repo_id), self.best_symbol(source, repo_id), self.best_symbol(target, repo_id), clamp(max_depth, 20, 1, 50), min_confidence)

    def get_execution_flows(self, repo_id: str | None = None, include_entry_points: bool = True, max_depth: int | None = None, max_results: int | None = None, max_branching: int | None = None, min_confidence: float = 0.0) -> DataFrame:
        t = self.tables(repo_id)
        handlers = t["api_operations"].where("kind = 'route' and handler is not null").select(F.col("handler").alias("name"))
        starts = t["symbols"].join(handlers, "name", "left_semi")
        if include_entry_points:
            starts = starts.unionByName(t["symbols"].where(is_entry_path("file_path")))
        return graph.flows(self.symbol_edges(repo_id), starts.select(F.col("stable_key").alias("node")).distinct(), clamp(max_depth, 8, 1, 20), clamp(max_branching, 5, 1, 20), clamp(max_results, 100, 1, 500), min_confidence)

    def ranked_symbols(self, repo_id: str | None = None, focus: tuple[str, ...] = ()) -> DataFrame:
        s = self.tables(repo_id)["symbols"]
        weight = F.lit(1.0) + F.when(F.col("exported"), 0.5).otherwise(0.0)
        for term in focus:
            weight = weight + F.when(F.lower("name") == term.lower(), 30.0).when(F.lower("qualified_name").contains(term.lower()), 8.0).otherwise(0.0)
        ranks = graph.pagerank(s.select(F.col("stable_key").alias("node"), weight.alias("teleport")), self.symbol_edges(repo_id, ("calls",)))
        nodes = s.join(ranks.withColumnRenamed("node", "stable_key"), "stable_key")
        return graph.presentation_score(nodes, any("test" in t.lower() for t in focus))

    def get_code_graph(self, repo_id: str | None = None, focus: tuple[str, ...] = (), max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
        nodes = cut(self.ranked_symbols(repo_id, focus).select(F.col("stable_key").alias("node"), "name", "file_path", "kind", "score"))
        clusters = graph.directory_clusters(nodes.select("file_path").distinct())
        kept = ranking.round_robin(nodes.join(clusters, "file_path"), "cluster", "node", "score", clamp(max_nodes, 1200, 50, 12000))
        return kept, graph.edge_rank(self.symbol_edges(repo_id), kept, clamp(max_edges, 4000, 100, 40000))

    def get_repo_map(self, repo_id: str | None = None, focus: tuple[str, ...] = (), token_budget: int | None = None, max_symbols: int | None = None) -> DataFrame:
        top = self.ranked_symbols(repo_id, focus).orderBy(F.desc("score"), "stable_key").limit(clamp(max_symbols, 100, 10, 500))
        blocks = top.groupBy("file_path").agg(F.sum("score").alias("score"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("start_line", "signature"))), lambda x: x["signature"])).alias("text"))
        costed = blocks.select(F.lit(1).alias("map"), "file_path", (-F.col("score")).alias("rank"), (F.length("text") + F.length("file_path")).alias("cost"), "text")
        return ranking.greedy_budget(costed, "map", "rank", "cost", max(400, 4 * clamp(token_budget, 2000, 100, 20000)))

    def get_architecture(self, repo_id: str | None = None) -> dict[str, DataFrame]:
        t = self.tables(repo_id)
        files = t["edges"].where("kind = 'imports'").select("repo_id", "source", "target", F.lit(0.7).alias("weight"))
        return {
            "languages": t["files"].groupBy("language").count().orderBy(F.desc("count")),
            "packages": t["files"].groupBy(F.regexp_extract("file_path", r"^([^/]*)/", 1).alias("package")).count().orderBy(F.desc("count"), "package").limit(30),
            "entry_points": t["files"].where(is_entry_path("file_path")).select("file_path").orderBy("file_path").limit(50),
            "central_symbols": self.ranked_symbols(repo_id).select("stable_key", "score").orderBy(F.desc("score"), "stable_key").limit(30),
            "communities": graph.communities(files),
        }

    def get_api_topology(self, repo_id: str | None = None, path: str | None = None, method: str | None = None, limit: int | None = None) -> DataFrame:
        api = self.tables(repo_id)["api_operations"].withColumn("op", F.concat_ws(":", "file_path", "start_line"))
        links = services.api_links(api.where("kind = 'route'").withColumnRenamed("op", "route"), api.where("kind = 'client'").withColumnRenamed("op", "client"))
        links = links.where(F.col("path") == path) if path else links
        return links.orderBy("path", "client", "route").limit(clamp(limit, 200, 1, 5000))

    def get_cochange_context(self, target: str, root: str, since: str = "", max_commits: int | None = None, max_files_per_commit: int = 20, min_cochanges: int = 2, limit: int | None = None) -> DataFrame:
        log = git.read_log(self.spark, root, since, clamp(max_commits, 1000, 1, 10000))
        return history.cochange(log, target, "commit", "file", max_files_per_commit, min_cochanges, clamp(limit, 20, 1, 100))

    # change workflow --------------------------------------------------------------------------

    def changed_ranges(self, diff: str | None = None, changes: list[dict] | None = None, strict: bool = False) -> DataFrame:
        rows = git.parse_diff(diff, strict) if diff is not None else (changes or [])
        data = [(r["file_path"], r.get("start_line"), r.get("end_line")) for r in rows]
        return ranges.merge_ranges(self.spark.createDataFrame(data, "file_path string, start_line long, end_line long"))

    def change_preflight(self, repo_id: str | None = None, diff: str | None = None, changes: list[dict] | None = None, impact_depth: int | None = None) -> dict[str, DataFrame]:
        t = self.tables(repo_id)
        changed = self.changed_ranges(diff, changes)
        symbols = t["symbols"].where("kind != 'Module'").withColumn("symbol", F.col("stable_key"))
        mapped = cut(ranges.map_ranges(changed, symbols))
        reached = cut(graph.impact(self.symbol_edges(repo_id), mapped.select(F.col("symbol").alias("node")), "upstream", clamp(impact_depth, 3, 1, 15)))
        unmapped = changed.join(mapped.select("file_path").distinct(), "file_path", "left_anti").withColumn("reason", F.lit("no_symbol_in_range"))
        partners = self._partners(repo_id, changed.select("file_path").distinct())
        strong = partners.where("coupling >= 0.5 and cochanges >= 2").agg(F.count_distinct("partner").alias("strong_cochanges"))
        governed = self._decided(mapped.select("symbol").distinct())
        total = reached.join(symbols.select(F.col("symbol").alias("node"), "file_path"), "node").agg(F.count_distinct("node").alias("symbols"), F.count_distinct("file_path").alias("files"))
        counts = total.crossJoin(mapped.agg(F.count_distinct("symbol").alias("changed_symbols"))).crossJoin(changed.agg(F.count_distinct("file_path").alias("changed_files")))
        counts = counts.crossJoin(unmapped.agg(F.count("*").alias("unmapped"))).crossJoin(strong).crossJoin(governed.agg(F.count_distinct("decision_id").alias("decisions")))  # one row each
        return {"ranges": changed, "symbols": mapped, "unmapped": unmapped, "impact": reached, "cochange": partners, "decisions": governed, "risk": review.aggregate_risk(counts)}

    def _partners(self, repo_id: str | None, files: DataFrame, since: str = "1 year ago", max_commits: int = 1000) -> DataFrame:
        """Files that change together with some files, other than these, by the git log of the indexed root; none where it is no repository."""
        repo, _ = self.repository(repo_id)
        root = self.latest("generations", "repo_id").where(F.col("repo_id") == repo).head()["root"]
        try:
            git.git(root, "rev-parse", "HEAD")
        except Exception:  # no repository, or one without commits
            return self.spark.createDataFrame([], "target string, partner string, cochanges long, coupling double")
        targets = files.select(F.col("file_path").alias("file"))
        found = history.partners(git.read_log(self.spark, root, since, max_commits), targets)
        return cut(found.join(targets.select(F.col("file").alias("partner")), "partner", "left_anti"))

    def _decided(self, symbols: DataFrame) -> DataFrame:
        """(decision_id, title, symbol) of the active decisions about some symbols."""
        scopes = self.log("decision_scopes").where("scope_type = 'symbol'").select("decision_id", F.col("scope_key").alias("symbol"))
        return self.decisions().where("status = 'active'").join(scopes, "decision_id").join(symbols, "symbol", "left_semi").select("decision_id", "title", "symbol")

    def review_change(self, repo_id: str | None = None, diff: str | None = None, changes: list[dict] | None = None, rules: tuple[dict, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(findings, verdict) of a change: its reach, the complexity, churn and use of its symbols, its lines, rules and decisions."""
        if diff is None and not changes:
            raise ValueError("a diff or changed ranges are required")
        pre = self.change_preflight(repo_id, diff, changes)
        symbols = self.tables(repo_id)["symbols"]
        touched = pre["symbols"].select(F.col("symbol").alias("stable_key")).distinct()
        s = cut(symbols.join(touched, "stable_key", "left_semi"))
        files = pre["ranges"].select("file_path").distinct()
        found = [*self._reach_findings(pre, symbols, s, files), *self._symbol_findings(repo_id, s), self._decision_findings(pre, s)]
        parsed = git.parse_diff(diff or "")
        added = [(r["file_path"], k, x) for r in parsed for k, x in enumerate(r["added"], r["start_line"] or 1)]
        lines = self.spark.createDataFrame(added, "file_path string, line int, text string")
        found += self._line_findings(lines)
        if rules:
            found.append(review.literal_rules(lines, list(rules)))
        every = cut(found[0])
        for part in found[1:]:
            every = every.unionByName(cut(part))
        found = review.dedupe(every)
        return found, review.verdict(found)

    @staticmethod
    def _finding(rows: DataFrame, severity, confidence, code: str, line, message) -> DataFrame:
        sev = F.lit(severity) if isinstance(severity, str) else severity
        sure = F.lit(confidence) if isinstance(confidence, float) else confidence
        return rows.select(sev.alias("severity"), sure.cast("double").alias("confidence"), F.lit(code).alias("code"), "file_path", line.cast("int").alias("line"), message.alias("message"))

    def _reach_findings(self, pre: dict, symbols: DataFrame, s: DataFrame, files: DataFrame) -> list[DataFrame]:
        """Symbols and files beyond the change that depend on it; exports, heritage and endpoints in its files."""
        beyond = pre["impact"].join(symbols.select(F.col("stable_key").alias("node"), "file_path"), "node").join(files, "file_path", "left_anti")
        wide = beyond.agg(F.count_distinct("node").alias("n"), F.count_distinct("file_path").alias("m")).where(F.col("m") >= review.THRESHOLDS["cross_module_files"])
        first = s.orderBy("file_path", "start_line", "stable_key").limit(1).select("file_path", "start_line")
        message = F.concat_ws(" ", F.col("n").cast("string"), F.lit("upstream symbols in"), F.col("m").cast("string"), F.lit("other files depend on the change"))
        reach = self._finding(first.crossJoin(wide), F.when(F.col("m") >= 5, "error").otherwise("warning"), 0.92, "cross-module-blast-radius", F.col("start_line"), message)  # one row each
        open_ = s.where("exported").join(files, "file_path", "left_semi").groupBy("file_path").agg(F.min("start_line").alias("start_line"), F.count("*").alias("n"))
        return [reach, self._finding(open_, "warning", 0.82, "cross-module-contract-surface", F.col("start_line"), F.concat(F.col("n").cast("string"), F.lit(" exported symbols change")))]

    def _symbol_findings(self, repo_id: str | None, s: DataFrame) -> list[DataFrame]:
        """Complex symbols, complex ones that change often, and symbols that nothing uses."""
        t = review.THRESHOLDS
        heavy = s.where((F.col("cyclomatic") >= t["cyclomatic"]) | (F.col("cognitive") >= t["cognitive"]))
        severe = (F.col("cyclomatic") >= 1.5 * t["cyclomatic"]) | (F.col("cognitive") >= 1.5 * t["cognitive"])
        line, name = F.col("start_line"), F.col("qualified_name")
        found = [self._finding(heavy, F.when(severe, "error").otherwise("warning"), 0.8, "changed-symbol-complexity", line, name)]
        repo, _ = self.repository(repo_id)
        churned = history.churn(self._changes(repo).select("stable_key", "change_type", "reference_time"), "stable_key", "change_type", "reference_time")
        score = (F.col("cyclomatic") + F.col("cognitive")) * F.log2(F.lit(2.0) + F.col("weighted_churn"))
        hot = s.join(churned, "stable_key").where(score >= t["hotspot_score"])
        found.append(self._finding(hot, "warning", 0.8, "high-churn-complex-symbol", line, name))
        unused = s.join(self.dead_symbols(repo_id).select("stable_key"), "stable_key", "left_semi")
        return [*found, self._finding(unused, "warning", 0.7, "changed-dead-code-candidate", line, name)]

    def _decision_findings(self, pre: dict, s: DataFrame) -> DataFrame:
        governed = pre["decisions"].join(s.select(F.col("stable_key").alias("symbol"), "file_path", "start_line"), "symbol")
        return self._finding(governed, "info", 1.0, "governing-contract-review", F.col("start_line"), F.col("title"))

    def _line_findings(self, lines: DataFrame) -> list[DataFrame]:
        """Handlers that swallow errors and returns that override them."""
        silent = lines.where(F.col("text").rlike(r"catch\s*(\([^)]*\))?\s*\{\s*\}|except[^:]*:\s*pass"))
        over = lines.where(F.col("text").rlike(r"finally\s*\{.*\breturn\b"))
        found = self._finding(silent, "warning", 0.82, "silent-error-handling", F.col("line"), F.trim("text"))
        return [found, self._finding(over, "error", 0.9, "finally-control-flow-override", F.col("line"), F.trim("text"))]

    # history ----------------------------------------------------------------------------------

    def _changes(self, repo_id: str) -> DataFrame:
        return self.log("changes").where(F.col("repo_id") == repo_id)

    def get_changes_since(self, since, repo_id: str | None = None, limit: int | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        by = "sequence" if isinstance(since, int) else "reference_time"
        since = since if by == "sequence" else datetime.fromisoformat(str(since).replace("Z", "+00:00")).replace(tzinfo=None)
        return temporal.changes_since(self.log("episodes").where(F.col("repo_id") == repo), self._changes(repo), since, clamp(limit, 100, 1, 500), by)

    get_temporal_changes_since = get_changes_since

    def get_timeline(self, symbol: str, repo_id: str | None = None, limit: int | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        return self._changes(repo).where(F.col("stable_key") == self.best_symbol(symbol, repo)).orderBy("sequence").limit(clamp(limit, 100, 1, 500))

    def record_temporal_episode(self, repo_id: str, episode_key: str, type: str, changes: list[dict], reference_time: datetime | None = None, message: str | None = None) -> str:  # noqa: A002
        """new, or duplicate where the same key and content are there; other content under a key is an error."""
        at = reference_time or self.now()
        rows = self.spark.createDataFrame([(c["stable_key"], c.get("previous_stable_key"), c["change_type"], c.get("before"), c.get("after")) for c in changes], "stable_key string, previous_stable_key string, change_type string, before string, after string")
        bad = temporal.invalid_changes(rows).head()
        if bad is not None:
            raise ValueError(f"{bad['stable_key']}: {bad['reason']}")
        if len({c["stable_key"] for c in changes}) < len(changes):
            raise ValueError("a key changes twice in one episode")
        import hashlib

        print_ = hashlib.sha256(json.dumps(changes, sort_keys=True).encode()).hexdigest()
        known = self.log("episodes").where(F.col("repo_id") == repo_id)
        row = self.spark.createDataFrame([(episode_key, print_, at)], "episode_key string, fingerprint string, reference_time timestamp")
        status, sequence = temporal.new_episodes(row, known).select("status", "sequence").head()
        if status == "conflict":
            raise ValueError(f"{episode_key} is recorded with other changes")
        if status == "new":
            self.append("episodes", {"repo_id": repo_id, "episode_key": episode_key, "type": type, "sequence": sequence, "reference_time": at, "fingerprint": print_, "message": message})
            self.append("changes", *({"repo_id": repo_id, "sequence": sequence, "reference_time": at, "entity_type": "symbol"} | c for c in changes))
        return status

    def replay_history(self, repo_id: str, root: str, max_commits: int = 200) -> int:
        """File-level episodes from the git log, oldest first; commits that are there already are left alone."""
        rows = git.read_log(self.spark, root, "", max_commits).collect()  # bounded by max_commits
        commits: dict[str, list] = {}
        for r in rows:
            commits.setdefault(r["commit"], []).append(r)
        new = 0
        for commit, files in reversed(list(commits.items())):
            changes = [{"stable_key": f["file"], "previous_stable_key": f["previous"], "change_type": f["change"], "before": None if f["change"] == "added" else f["previous"] or f["file"], "after": None if f["change"] == "removed" else f["file"]} for f in files]
            at = datetime.fromisoformat(files[0]["at"]).astimezone(timezone.utc).replace(tzinfo=None)
            new += self.record_temporal_episode(repo_id, f"git:{commit}", "commit", changes, at, files[0]["subject"]) == "new"
        return new

    def capture_working_tree_episode(self, repo_id: str, root: str, message: str = "") -> str:
        import hashlib

        names = list(git.name_status(git.git(root, "diff", "--name-status", "-z", "HEAD"))) + [("added", None, None, p) for p in git.git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]
        changes = [{"stable_key": f, "previous_stable_key": prev, "change_type": c, "before": None if c == "added" else prev or f, "after": None if c == "removed" else f} for c, _, prev, f in names]
        key = hashlib.sha256((git.git(root, "diff", "HEAD") + json.dumps(changes)).encode()).hexdigest()
        return self.record_temporal_episode(repo_id, f"worktree:{key}", "worktree", changes, None, message) if changes else "unchanged"

    def get_temporal_timeline(self, stable_key: str, repo_id: str | None = None, start=None, end=None, direction: str = "asc", limit: int | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        return temporal.timeline(self._changes(repo), stable_key, start, end, descending=direction == "desc", limit=clamp(limit, 100, 1, 500))

    def get_evolution(self, repo_id: str | None = None, stable_key: str | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        rows = self._changes(repo)
        rows = rows.join(temporal.lineage(rows, stable_key), "stable_key", "left_semi") if stable_key else rows
        return temporal.evolution(rows).orderBy(F.desc("changes"), "stable_key").limit(50)

    def get_episode_replay(self, sequence: int, repo_id: str | None = None, limit: int | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        return temporal.replay(temporal.intervals(self._changes(repo)), sequence).orderBy("stable_key").limit(clamp(limit, 500, 1, 5000))

    def get_temporal_stats(self, repo_id: str | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        return temporal.stats(self.log("episodes").where(F.col("repo_id") == repo), temporal.intervals(self._changes(repo)))

    # decisions and overlays -------------------------------------------------------------------

    def record_structured_decision(self, title: str, rationale: str, repo_id: str | None = None, kind: str = "choice", status: str = "active", alternatives=(), tags=(), scopes: tuple[tuple[str, str], ...] = (), provenance: str | None = None) -> str:
        if kind not in ("choice", "ban", "convention", "contract"):
            raise ValueError(f"unknown kind {kind}")
        repo, _ = self.repository(repo_id)
        key = uuid.uuid4().hex
        self.append("decisions", {"repo_id": repo, "decision_id": key, "kind": kind, "title": title, "rationale": rationale, "tags": list(tags), "alternatives": list(alternatives), "provenance": provenance, "at": self.now()})
        self.append("decision_status", {"decision_id": key, "status": status, "at": self.now()})
        self.append("decision_scopes", *({"decision_id": key, "scope_type": t, "scope_key": k} for t, k in (scopes or (("repository", repo),))))
        return key

    def record_decision(self, title: str, rationale: str, repo_id: str | None = None, alternatives=(), tags=(), symbols=(), status: str = "active") -> str:
        return self.record_structured_decision(title, rationale, repo_id, "choice", status, alternatives, tags, tuple(("symbol", s) for s in symbols))

    def decisions(self) -> DataFrame:
        return self.log("decisions").join(self.latest("decision_status", "decision_id").select("decision_id", "status", "superseded_by"), "decision_id", "left")

    def get_decision(self, decision_id: str) -> DataFrame:
        scopes = self.log("decision_scopes").groupBy("decision_id").agg(F.array_sort(F.collect_list(F.struct("scope_type", "scope_key"))).alias("scopes"))
        return self.decisions().where(F.col("decision_id") == decision_id).join(scopes, "decision_id", "left")

    def get_decision_provenance(self, decision_id: str) -> DataFrame:
        return self.get_decision(decision_id).select("decision_id", "provenance", "at")

    def set_decision_status(self, decision_id: str, status: str, superseded_by: str | None = None) -> None:
        if superseded_by == decision_id:
            raise ValueError("a decision can't supersede itself")
        self.append("decision_status", {"decision_id": decision_id, "status": status, "superseded_by": superseded_by, "at": self.now()})

    def recall_decision(self, query: str, status: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
        from .functions.text import code_tokens

        d = self.decisions()
        d = d.where(F.col("status") == status) if status else d
        d = d.where(F.col("kind") == kind) if kind else d
        post = search.postings(d.select(F.col("decision_id").alias("id"), F.col("title").alias("name"), F.col("rationale").alias("body_text"), F.concat_ws(" ", "tags").alias("signature")), search.TERM_WEIGHTS)
        terms = self.spark.range(1).select(F.lit(0).alias("query"), F.explode(code_tokens(F.lit(query))).alias("term"))
        return d.join(search.bm25(post, terms).select(F.col("id").alias("decision_id"), "score"), "decision_id").orderBy(F.desc("score"), "decision_id").limit(clamp(limit, 20, 1, 100))

    recall_decisions = recall_decision

    def verify_intent(self, decision_id: str, held: bool | None = None, location: str | None = None) -> DataFrame:
        if held is not None:
            self.append("observations", {"decision_id": decision_id, "held": held, "location": location, "at": self.now()})
        return memory.verify(self.decisions().where(F.col("decision_id") == decision_id), self.log("observations"))

    def governing_contracts(self, repo_id: str | None = None, file_path: str | None = None, symbol: str | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        return memory.governing(self.decisions(), self.log("decision_scopes"), repo, file_path, symbol)

    def why_is_this_here(self, repo_id: str | None = None, file_path: str | None = None, symbol: str | None = None) -> DataFrame:
        return self.governing_contracts(repo_id, file_path, symbol).select("decision_id", "title", "rationale", "scope_type").orderBy("scope_type", "decision_id")

    def create_worktree_overlay(self, name: str, repo_id: str | None = None) -> None:
        repo, generation = self.repository(repo_id)
        self.append("overlays", {"repo_id": repo, "name": name, "base": generation, "status": "open", "revision": 0, "at": self.now()})

    def list_worktrees(self, repo_id: str | None = None, name: str | None = None, status: str | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        o = self.latest("overlays", "repo_id", "name").where(F.col("repo_id") == repo)
        o = o.where(F.col("name") == name) if name else o
        return o.where(F.col("status") == status) if status else o

    get_worktree_overlay = list_worktrees

    def _overlay(self, name: str, repo_id: str | None) -> dict:
        row = self.list_worktrees(repo_id, name).head()
        if row is None:
            raise ValueError(f"no overlay {name}")
        return row.asDict()

    def set_worktree_status(self, name: str, status: str, repo_id: str | None = None) -> None:
        o = self._overlay(name, repo_id)
        if o["status"] != "open":
            raise ValueError(f"{name} is {o['status']}")
        self.append("overlays", o | {"status": status, "at": self.now()})

    def record_worktree_changes(self, name: str, changes: list[dict], repo_id: str | None = None) -> None:
        o = self._overlay(name, repo_id)
        self.append("overlays", o | {"revision": o["revision"] + 1, "at": self.now()})
        self.append("overlay_symbols", *({"repo_id": o["repo_id"], "name": name, "revision": o["revision"] + 1} | c for c in changes))

    def overlay_symbols(self, name: str, repo_id: str | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        return self.latest("overlay_symbols", "repo_id", "name", "stable_key", by="revision").where((F.col("repo_id") == repo) & (F.col("name") == name))

    def plan_worktree_merge(self, source_name: str, target_name: str, repo_id: str | None = None) -> DataFrame:
        return memory.plan_merge(self.overlay_symbols(source_name, repo_id), self.overlay_symbols(target_name, repo_id), ["signature", "body"])

    def apply_worktree_merge(self, source_name: str, target_name: str, repo_id: str | None = None, expected_revision: int | None = None) -> DataFrame:
        """The target's symbols after its next revision, to which what the source changed is written; the source stays as it is."""
        o = self._overlay(target_name, repo_id)
        if o["status"] != "open":
            raise ValueError(f"{target_name} is {o['status']}")
        plan = cut(self.plan_worktree_merge(source_name, target_name, repo_id))
        memory.check_merge(plan, o["revision"] if expected_revision is None else expected_revision, o["revision"])
        sides = [self.overlay_symbols(n, repo_id).select("stable_key", "change_type", "base_fingerprint", "base_signature", "base_body") for n in (source_name, target_name)]
        taken = plan.where("action = 'take_source'").join(sides[0], "stable_key").unionByName(plan.where("action = 'merge'").join(sides[1], "stable_key"))
        rows = taken.withColumns({"repo_id": F.lit(o["repo_id"]), "name": F.lit(target_name), "revision": F.lit(o["revision"] + 1).cast("long")})
        names = [c.split()[0] for c in LOGS["overlay_symbols"].split(", ")]
        rows.select(*names).write.mode("append").parquet(f"{self.home}/overlay_symbols")
        self.append("overlays", o | {"revision": o["revision"] + 1, "at": self.now()})
        return self.overlay_symbols(target_name, repo_id)

    # services ---------------------------------------------------------------------------------

    def upsert_service_identity(self, service_key: str, evidence: str, name: str | None = None, confidence: float = 1.0) -> str:
        now = self.latest("identities", "service_key").where(F.col("service_key") == service_key).head()
        if now is not None and (now["name"], now["confidence"], now["evidence"]) == (name, confidence, evidence):
            return "unchanged"
        self.append("identities", {"service_key": service_key, "name": name, "confidence": confidence, "evidence": evidence, "at": self.now()})
        return "created" if now is None else "changed"

    def link_repository_service(self, repo_id: str, service_key: str, role: str, confidence: float = 1.0) -> None:
        if role not in ("provider", "consumer", "both"):
            raise ValueError(f"unknown role {role}")
        self.append("service_links", {"service_key": service_key, "repo_id": repo_id, "role": role, "confidence": confidence, "created_at": self.now(), "removed": False})

    def unlink_repository_service(self, repo_id: str, service_key: str, role: str | None = None) -> None:
        self.append("service_links", *({"service_key": service_key, "repo_id": repo_id, "role": r, "confidence": 0.0, "created_at": self.now(), "removed": True} for r in ([role] if role else ["provider", "consumer", "both"])))

    def service_links(self) -> DataFrame:
        live = self.latest("service_links", "service_key", "repo_id", "role", by="created_at").where("not removed")
        return services.canonical_links(live)

    def list_service_identities(self, include_unlinked: bool = True, limit: int | None = None) -> DataFrame:
        got = self.latest("identities", "service_key").join(self.service_links().select("service_key", "repo_id", "role"), "service_key", "left" if include_unlinked else "inner")
        return got.orderBy("service_key", "repo_id").limit(clamp(limit, 200, 1, 5000))

    def refresh_service_identities(self) -> DataFrame:
        repos = self.latest("generations", "repo_id").select("repo_id")
        routes = self.log("service_operations").where("direction = 'inbound'").select("repo_id", F.col("key").alias("path"))
        return services.infer_identities(repos, self.service_links(), routes)

    def record_service_operations(self, repo_id: str, operations: list[dict]) -> None:
        if len(operations) > 5000:
            raise ValueError("at most 5000 operations at once")
        if bad := {o.get("protocol") for o in operations} - {"http", "graphql", "grpc", "websocket", "queue"}:
            raise ValueError(f"unknown protocol {sorted(map(str, bad))}")
        self.append("service_operations", *({"op": uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(o, sort_keys=True) + repo_id).hex, "repo_id": repo_id, "confidence": 0.9, "base_url_known": False, "at": self.now()} | o for o in operations))

    def get_cross_repository_topology(self, min_confidence: float = 0.0, protocol: str | None = None) -> DataFrame:
        ops = self.latest("service_operations", "op")
        ops = ops.where(F.col("protocol") == protocol) if protocol else ops
        return services.rendezvous(ops.where("direction = 'outbound'"), ops.where("direction = 'inbound'"), min_confidence)

    def get_service_diagram(self, min_confidence: float = 0.0) -> DataFrame:
        return services.diagram(self.get_cross_repository_topology(min_confidence))

    def get_service_callers(self, repo_id: str, direction: str = "both") -> DataFrame:
        return services.callers(self.get_cross_repository_topology(), repo_id, direction)

    # quality ----------------------------------------------------------------------------------

    def calculate_cyclomatic_complexity(self, repo_id: str | None = None, file_path: str | None = None, minimum_cyclomatic: int = 0, limit: int | None = None) -> DataFrame:
        s = self.tables(repo_id)["symbols"].where(F.col("cyclomatic") >= minimum_cyclomatic).where("kind in ('Function', 'Method', 'Constructor')")
        s = s.where(F.col("file_path") == file_path) if file_path else s
        density = (F.col("cyclomatic") + F.col("cognitive")) / (F.col("end_line") - F.col("start_line") + 1)
        return s.select("stable_key", "file_path", "cyclomatic", "cognitive", density.alias("density")).orderBy(F.desc("cyclomatic"), F.desc("cognitive"), "stable_key").limit(clamp(limit, 100, 1, 1000))

    def find_hotspots(self, repo_id: str | None = None, limit: int | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        c = self._changes(repo).select("stable_key", "change_type", "reference_time")
        churned = history.churn(c, "stable_key", "change_type", "reference_time")
        return history.hotspots(self.tables(repo)["symbols"].select("stable_key", "cyclomatic", "cognitive"), churned, "stable_key", clamp(limit, 50, 1, 500))

    def find_dead_code(self, repo_id: str | None = None, limit: int | None = None) -> DataFrame:
        return self.dead_symbols(repo_id).orderBy("file_path", "start_line", "stable_key").limit(clamp(limit, 100, 1, 1000))

    def dead_symbols(self, repo_id: str | None = None) -> DataFrame:
        """All symbols that nothing uses and no rule excuses."""
        t = self.tables(repo_id)
        open_calls = t["calls"].where("status != 'resolved'").groupBy(F.col("callee").alias("name")).agg(F.sum("occurrences").alias("unresolved_calls"))
        words = t["files"].where(F.col("content").rlike(r"getattr|\[['\"]|Reflect|eval|import_module")).select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"['\"]([A-Za-z_]\w*)['\"]"), F.lit(1)))).alias("name")).distinct().withColumn("reflected", F.lit(True))
        s = t["symbols"].join(open_calls, "name", "left").join(words, "name", "left")
        used = t["edges"].where("kind = 'calls' and source != target").select(F.col("target").alias("stable_key"))
        return quality.dead_code(s, used, quality.code_rules()).where("excluded_by is null").select("stable_key", "file_path", "start_line", "kind")

    def find_bridge_symbols(self, repo_id: str | None = None, minimum_degree: int = 2, limit: int | None = None) -> DataFrame:
        e = cut(self.symbol_edges(repo_id).select("source", "target").distinct())
        return quality.bridges(e, graph.articulation(e.withColumn("component", F.lit(0))), minimum_degree).limit(clamp(limit, 50, 1, 500))

    def get_style_fingerprint(self, repo_id: str | None = None) -> DataFrame:
        dims = {"quotes": {"single": "'[^'\n]*'", "double": "\"[^\"\n]*\""}, "indent": {"tabs": r"\n\t+", "spaces": r"\n +"}, "ends": {"semicolon": r";\s*\n", "none": r"[^;{}\s]\s*\n"}, "naming": {"camel": r"\b[a-z]+[A-Z]\w*", "snake": r"\b[a-z]+_[a-z]\w*"}}
        return quality.style(self.tables(repo_id)["files"], dims, "content", "language")

    # processes and briefings ------------------------------------------------------------------

    def upsert_process_model(self, process_key: str, name: str, steps: list[str], repo_id: str | None = None) -> None:
        import hashlib

        repo, _ = self.repository(repo_id)
        self.append("processes", {"repo_id": repo, "process_key": process_key, "name": name, "source": "configured", "steps": steps, "fingerprint": hashlib.sha256("|".join(steps).encode()).hexdigest(), "active": True, "at": self.now()})

    def retire_process_model(self, process_key: str, repo_id: str | None = None) -> None:
        row = self.get_process_flow(process_key, repo_id).head()
        if row is None:
            raise ValueError(f"no process {process_key}")
        self.append("processes", row.asDict() | {"active": False, "at": self.now()})

    def list_processes(self, repo_id: str | None = None, active: bool | None = None, source: str | None = None, limit: int | None = None) -> DataFrame:
        return self._processes(repo_id, active, source).orderBy("process_key").limit(clamp(limit, 100, 1, 1000))

    def _processes(self, repo_id: str | None = None, active: bool | None = None, source: str | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        p = self.latest("processes", "repo_id", "process_key").where(F.col("repo_id") == repo)
        p = p if active is None else p.where(F.col("active") == active)
        p = p.where(F.col("source") == source) if source else p
        return p.withColumn("n_steps", F.size("steps"))

    def get_process_flow(self, process_key: str, repo_id: str | None = None) -> DataFrame:
        return self._processes(repo_id).where(F.col("process_key") == process_key)

    def get_process_membership(self, symbol_stable_key: str, repo_id: str | None = None) -> DataFrame:
        return self._processes(repo_id).where(F.array_contains("steps", symbol_stable_key))

    def refresh_processes(self, repo_id: str | None = None, max_processes: int = 200) -> DataFrame:
        repo, _ = self.repository(repo_id)
        flows = self.get_execution_flows(repo, max_results=max_processes)
        complete = flows.count() < max_processes
        found = flows.select(F.concat(F.lit("flow:"), F.substring(F.sha2(F.concat_ws("|", "path"), 256), 1, 16)).alias("process_key"), F.col("path").alias("steps"), F.sha2(F.concat_ws("|", "path"), 256).alias("fingerprint"))
        known = self._processes(repo, source="inferred")
        change = cut(processes.refresh(known, found, complete))
        rows = change.join(found, "process_key", "left").join(known.select("process_key", F.col("steps").alias("s0"), F.col("fingerprint").alias("f0")), "process_key", "left").where("change in ('added', 'modified', 'reactivated', 'retired')")
        rows.select(F.lit(repo).alias("repo_id"), "process_key", F.col("process_key").alias("name"), F.lit("inferred").alias("source"), F.coalesce("steps", "s0").alias("steps"), F.coalesce("fingerprint", "f0").alias("fingerprint"), (F.col("change") != "retired").alias("active"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.home}/processes")
        change.select(F.lit(repo).alias("repo_id"), "process_key", "change", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.home}/refreshes")
        return change.groupBy("change").count()

    def list_process_refreshes(self, repo_id: str | None = None, limit: int | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        return self.log("refreshes").where(F.col("repo_id") == repo).orderBy(F.desc("at"), "process_key").limit(clamp(limit, 100, 1, 1000))

    def get_codebase_briefing(self, repo_id: str | None = None) -> DataFrame:
        repo, _ = self.repository(repo_id)
        return processes.briefing(self.spark, processes=self._processes(repo), decisions=self.decisions().where(F.col("repo_id") == repo), hotspots=self.find_hotspots(repo), entry_points=self.get_architecture(repo)["entry_points"])

    def get_daily_briefing(self, repo_id: str | None = None, hours: int = 24) -> DataFrame:
        repo, _ = self.repository(repo_id)
        recent = lambda df, at: df.where((F.col("repo_id") == repo) & (F.col(at) >= F.current_timestamp() - F.expr(f"INTERVAL {hours} HOURS")))
        return processes.briefing(self.spark, changes=recent(self.log("changes"), "reference_time"), decisions=recent(self.log("decisions"), "at"), process_changes=recent(self.log("refreshes"), "at"))

    # usage and coordination -------------------------------------------------------------------

    def record_usage(self, tool: str, duration_ms: float, ok: bool, repo_id: str | None = None) -> None:
        self.append("usage", {"repo_id": repo_id, "tool": tool, "duration_ms": duration_ms, "ok": ok, "ts": self.now()})

    def get_usage_stats(self, repo_id: str | None = None, period: str = "7d") -> dict[str, DataFrame]:
        calls = usage.in_period(self.log("usage"), period, self.now())
        calls = calls.where(F.col("repo_id") == repo_id) if repo_id else calls
        return {"totals": usage.totals(calls), "by_tool": usage.by(calls, "tool"), "by_day": usage.by_day(calls)}

    def fleet_publish_intent(self, agent: str, kind: str, targets: list[str]) -> DataFrame:
        if not 0 < len(targets) <= 200:
            raise ValueError("one to 200 targets")
        key = uuid.uuid4().hex
        self.append("intents", {"intent": key, "agent": agent, "kind": kind, "targets": targets, "at": self.now(), "cancelled": False})
        return fleet.conflicts(self._live()).where(F.col("intent") == key)

    def _live(self) -> DataFrame:
        return fleet.active(self.latest("intents", "intent"), self.now())

    def fleet_cancel_intent(self, intent: str, agent: str) -> None:
        row = self.latest("intents", "intent").where(F.col("intent") == intent).head()
        if row is None or row["agent"] != agent:
            raise ValueError("only its owner can cancel an intent")
        self.append("intents", row.asDict() | {"cancelled": True, "at": self.now()})

    def fleet_acquire_lease(self, agent: str, targets: list[str]) -> DataFrame:
        key = uuid.uuid4().hex
        self.append("leases", *({"request": f"{key}:{agent}", "agent": agent, "target": t, "at": self.now(), "released": False} for t in targets))
        held = self.log("leases")
        live = held.join(held.where("released").select("request", "target"), ["request", "target"], "left_anti")
        return fleet.leases(live).where(F.col("request") == f"{key}:{agent}")

    def fleet_release_lease(self, request: str, agent: str) -> None:
        if not request.endswith(f":{agent}"):
            raise ValueError("only its owner can release a lease")
        rows = self.log("leases").where((F.col("request") == request) & ~F.col("released")).collect()  # one request's targets
        self.append("leases", *(r.asDict() | {"released": True, "at": self.now()} for r in rows))

    def fleet_record_episode(self, agent: str, conflict_class: str) -> str:
        key = uuid.uuid4().hex
        self.append("fleet_episodes", {"episode": key, "agent": agent, "conflict_class": conflict_class, "at": self.now()})
        return key

    def fleet_list_escalations(self) -> DataFrame:
        return fleet.escalations(self.log("fleet_episodes"), self.log("resolutions"))

    def fleet_resolve_escalation(self, episode: str, directive: str, winner: str | None = None) -> None:
        self.append("resolutions", {"episode": episode, "directive": directive, "winner": winner, "at": self.now()})

    def fleet_status(self) -> DataFrame:
        live = self._live()
        return fleet.summary(live, fleet.conflicts(live), fleet.leases(self.log("leases").where("not released")))

    def fleet_get_graph(self) -> DataFrame:
        return self._live().select("agent", F.explode("targets").alias("target"), "kind").distinct()

    # watching ---------------------------------------------------------------------------------

    def watch_directory(self, path: str, repo_id: str):
        from .streaming.watch import watch

        return watch(self, path, repo_id)

    def list_watched_paths(self) -> list[str]:
        return sorted(q.name for q in self.spark.streams.active if q.name and q.name.startswith("watch:"))

    def unwatch_directory(self, path: str) -> None:
        for q in self.spark.streams.active:
            if q.name == f"watch:{path}":
                q.stop()
