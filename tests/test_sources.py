import contextlib
import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from tesselark.sources import code, git


def facts(text, language, what):
    return [r for r in code.facts_of(text, language) if r["fact"] == what]


def test_python_facts():
    text = "import os\nfrom .m import f as g\n\n__all__ = ['A']\n\nclass A:\n    def __init__(self):\n        self.x()\n\n    def x(self):\n        for i in range(3):\n            if i and g(i):\n                pass\n"
    kinds = {r["qualified_name"]: (r["kind"], r["exported"]) for r in facts(text, "python", "symbol")}
    assert kinds["A"] == ("Class", True) and kinds["A.__init__"] == ("Constructor", False) and kinds["A.x"][0] == "Method"
    assert {(r["specifier"], r["local"], r["imported"]) for r in facts(text, "python", "import")} == {("os", "os", "*"), (".m", "g", "f")}
    assert ("A.__init__", "x", "self") in {(r["owner"], r["callee"], r["qualifier"]) for r in facts(text, "python", "call")}


def test_python_with_errors_falls_back():
    rows = code.facts_of("def ok():\n  pass\ndef broken(:\n", "python")
    assert {r["mode"] for r in rows} == {"heuristic-fallback"} and "ok" in {r.get("name") for r in rows}


def test_javascript_facts():
    text = 'import { a as b } from "./u.js";\nexport function run(p) {\n  if (p) { return b(p); }\n}\nclass K { visit(a) { helper(a); } }\napp.get("/users/:id", handler);\nfetch("/users/1", { method: "PUT" });\n// call(no)\n'
    assert {(r["qualified_name"], r["kind"]) for r in facts(text, "javascript", "symbol")} >= {("run", "Function"), ("K", "Class"), ("K.visit", "Method")}
    assert {r["callee"] for r in facts(text, "javascript", "call")} >= {"b", "helper"}
    assert "call" not in {r["callee"] for r in facts(text, "javascript", "call")}
    assert {(r["kind"], r["method"], r["path"]) for r in facts(text, "javascript", "api")} == {("route", "GET", "/users/:id"), ("client", "PUT", "/users/1")}


@pytest.mark.parametrize(("language", "text", "name"), [("go", "func (s *S) Run() {\n}\n", "Run"), ("rust", "pub fn run() {\n}\n", "run"), ("java", "public class A {\n}\n", "A"), ("ruby", "class A\n  def run\n  end\nend\n", "run")])
def test_other_languages(language, text, name):
    assert name in {r["name"] for r in facts(text, language, "symbol")}


def test_declarations_without_a_keyword_and_their_ends():
    def of(text, language):
        return {r["qualified_name"]: (r["kind"], r["exported"], r["start_line"], r["end_line"]) for r in facts(text, language, "symbol") if r["kind"] != "Module"}

    script = "export const f = async (x: A): B => {\n  return x;\n}\nconst g = y => y + 1\nexport const MAX_N = 3;\nexport const enum E { A }\ntype T<A> =\n  | A\n  | null;\nfor (const z of q) { run(z) }\nclass K {\n  static async go<T>(a) {\n  }\n  get v() { return 1 }\n}\nfoo(function () { });\n"
    want = {"f": ("Function", True, 1, 3), "g": ("Function", False, 4, 4), "MAX_N": ("Constant", True, 5, 5), "E": ("Enum", True, 6, 6), "T": ("TypeAlias", False, 7, 9), "K": ("Class", False, 11, 15), "K.v": ("Method", False, 14, 14)}
    assert {k: v for k, v in of(script, "typescript").items() if k in want} == want and "run" not in of(script, "typescript")
    java = "public class A {\n  private static List<String> m(int a)\n      throws X {\n    if (a) { b(); }\n    return new C();\n  }\n  public A() {\n  }\n  int x = f();\n}\n"
    assert of(java, "java") == {"A": ("Class", True, 1, 10), "A.m": ("Method", False, 2, 6), "A.A": ("Constructor", True, 7, 8)}
    assert of("func (s *S) run(a int) error {\n}\nfunc Top() {\n}\ntype A struct {\n x int\n}\n", "go") == {"run": ("Method", False, 1, 2), "Top": ("Function", True, 3, 4), "A": ("Struct", True, 5, 7)}
    assert of("pub(crate) async fn run(x: u8) -> u8 {\n 1\n}\nstruct P;\n", "rust") == {"run": ("Function", True, 1, 3), "P": ("Struct", False, 4, 4)}
    assert of("class A\n  def self.go!\n    if x\n    end\n  end\nend\n", "ruby") == {"A": ("Class", False, 1, 6), "A.go!": ("Method", False, 2, 5)}
    # brackets that never close end with the text
    assert of("function f(a {\n  x(\n", "javascript") in ({}, {"f": ("Function", False, 1, 2)})


def test_empty_and_duplicates():
    assert code.facts_of(None, "javascript") == []
    rows = facts("def f():\n  pass\ndef f():\n  pass\n", "python", "symbol")
    assert [r["qualified_name"] for r in rows] == ["f", "f#2"]


DIFF = "diff --git a/x.js b/x.js\n--- a/x.js\n+++ b/x.js\n@@ -4 +4 @@\n-a\n+b\ndiff --git a/bin b/bin\nBinary files differ\n"


def test_diff():
    rows = git.parse_diff(DIFF, strict=True)
    assert [(r["file_path"], r["start_line"], r["end_line"]) for r in rows] == [("x.js", 4, 4), ("bin", None, None)]
    assert git.parse_diff("") == []
    with pytest.raises(ValueError, match="short"):
        git.parse_diff("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\n", strict=True)


def test_name_status():
    assert list(git.name_status("M\0a.py\0R090\0b.py\0c.py\0D\0d.py\0")) == [("modified", None, None, "a.py"), ("renamed", 0.9, "b.py", "c.py"), ("removed", None, None, "d.py")]


@pytest.fixture
def repository(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "a")
    os.makedirs(tmp_path / "src")
    for k in range(3):
        (tmp_path / "src/a.py").write_text(f"def a():\n    return b({k})\n\ndef b(x):\n    return x\n")
        (tmp_path / "src/main.py").write_text(f"from src.a import a\n\ndef start():\n    return a() + {k}\n")
        run("add", ".")
        run("commit", "-qm", f"c{k}")
    return tmp_path


def test_engine_end_to_end(spark, repository, tmp_path_factory):
    from tesselark.api import Engine

    e = Engine(spark, str(tmp_path_factory.mktemp("home")))
    counts = e.index_directory(str(repository), "r").head()
    assert counts["files"] == 2 and counts["edges"] >= 3
    assert {r["node"] for r in e.get_impact("b").collect()} == {"src/a.py:a:Function", "src/main.py:start:Function"}
    assert [r["node"] for r in e.get_dependency_path("start", "b").orderBy("ordinal").collect()] == ["src/main.py:start:Function", "src/a.py:a:Function", "src/a.py:b:Function"]
    assert e.get_dependency_path("b", "start").isEmpty()
    assert e.find_symbol("sta").head()["name"] == "start"
    assert e.get_cochange_context("src/a.py", str(repository)).head()["cochanges"] == 3
    assert e.replay_history("r", str(repository)) == 3 and e.replay_history("r", str(repository)) == 0
    assert e.get_source_window("src/a.py").count() == 6
    assert e.get_index_diagnostics().head()["resolved"] >= 2
    assert e.get_execution_flows().count() >= 1 and e.get_repo_map().count() == 2 and e.get_code_graph()[0].count() >= 3
    pre = e.change_preflight(changes=[{"file_path": "src/a.py", "start_line": 5, "end_line": 5}])
    assert [r["symbol"] for r in pre["symbols"].collect()] == ["src/a.py:b:Function"]
    # src/main.py changed with src/a.py three times: one strong partner makes a low risk medium, a decision leaves it so
    assert [tuple(r) for r in pre["cochange"].select("partner", "cochanges", "coupling").collect()] == [("src/main.py", 3, 1.0)]
    assert pre["risk"].select("strong_cochanges", "decisions", "risk").head()[:] == (1, 0, "medium")
    e.record_decision("b stays pure", "tests rely on it", symbols=["src/a.py:b:Function"])
    assert e.change_preflight(changes=[{"file_path": "src/a.py", "start_line": 5, "end_line": 5}])["risk"].select("decisions", "risk").head()[:] == (1, "medium")
    found, verdict = e.review_change(diff="diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -2 +2 @@\n-    return b(2)\n+    except E: pass\n")
    got = {(r["code"], r["severity"], r["confidence"]) for r in found.collect()}
    assert got >= {("silent-error-handling", "warning", 0.82), ("cross-module-blast-radius", "warning", 0.92), ("cross-module-contract-surface", "warning", 0.82)}
    assert verdict.head()["verdict"] == "review_required"  # warnings alone don't block
    found, verdict = e.review_change(diff="diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -5 +5 @@\n-    return x\n+    try { } finally { return x }\n")
    assert verdict.head()["verdict"] == "changes_requested" and "governing-contract-review" in {r["code"] for r in found.collect()}
    assert e.find_code("start").head()["name"] == "start"
    assert e.find_dead_code().count() >= 0 and e.find_bridge_symbols().count() >= 0 and e.get_style_fingerprint().count() >= 1
    assert e.refresh_processes().count() >= 1 and e.list_processes().count() >= 1
    assert {r["section"] for r in e.get_codebase_briefing().collect()} == {"processes", "decisions", "hotspots", "entry_points"}
    (repository / "src/a.py").write_text("def a():\n    return 1\n")
    e.index_directory(str(repository), "r")
    assert {r["change_type"] for r in e.get_timeline("a").collect()} >= {"added", "modified"}


def test_engine_memory_services_and_fleet(spark, repository, tmp_path_factory):
    from tesselark.api import Engine

    e = Engine(spark, str(tmp_path_factory.mktemp("home")))
    with pytest.raises(ValueError, match="no such"):
        e.repository()
    e.index_directory(str(repository), "r")
    d = e.record_structured_decision("No globals", "They leak state", kind="ban", scopes=(("file", "src/a.py"),))
    assert e.verify_intent(d).head()["verdict"] == "CannotProve"
    assert e.verify_intent(d, False, "src/a.py:1").head()[:] == (d, "ViolatedAt", "src/a.py:1")
    assert e.governing_contracts(file_path="src/a.py").head()["implied_prohibition"]
    assert e.recall_decision("globals").head()["decision_id"] == d
    with pytest.raises(ValueError):
        e.set_decision_status(d, "superseded", d)
    for name, body in (("x", "1"), ("y", "2")):
        e.create_worktree_overlay(name)
        e.record_worktree_changes(name, [{"stable_key": "k", "change_type": "modified", "base_fingerprint": "f", "body": body, "base_body": "0"}])
    assert e.plan_worktree_merge("x", "y").head()["action"] == "conflict:edit_edit"
    with pytest.raises(ValueError, match="conflicts"):
        e.apply_worktree_merge("x", "y")
    e.create_worktree_overlay("z")
    e.record_worktree_changes("z", [{"stable_key": "m", "change_type": "added", "body": "new"}])
    e.record_worktree_changes("z", [{"stable_key": "k", "change_type": "modified", "base_fingerprint": "f", "body": "2", "base_body": "0"}])
    with pytest.raises(ValueError, match="revision"):
        e.apply_worktree_merge("z", "y", expected_revision=0)
    assert {(r["stable_key"], r["body"]) for r in e.apply_worktree_merge("z", "y").collect()} == {("k", "2"), ("m", "new")}
    assert {(r["stable_key"], r["body"], r["change_type"]) for r in e.overlay_symbols("y").collect()} == {("k", "2", "modified"), ("m", "new", "added")}
    assert e.list_worktrees(name="y").head()["revision"] == 2
    for repo, direction in (("r", "outbound"), ("s", "inbound")):
        e.record_service_operations(repo, [{"direction": direction, "protocol": "queue", "key": "jobs", "confidence": 1.0}])
    assert e.get_cross_repository_topology().head()["confidence"] == 0.85
    assert e.upsert_service_identity("svc", "config") == "created" and e.upsert_service_identity("svc", "config") == "unchanged"
    e.link_repository_service("r", "svc", "provider")
    e.link_repository_service("r", "svc", "consumer")
    assert e.list_service_identities().head()["role"] == "both"
    assert e.fleet_publish_intent("a", "modify", ["t"]).head()["conflict_class"] == "A"
    assert e.fleet_publish_intent("b", "delete", ["t"]).head()["conflict_class"] == "C"
    lease = e.fleet_acquire_lease("a", ["t"]).head()
    assert lease["granted"] and not e.fleet_acquire_lease("b", ["t"]).head()["granted"]
    with pytest.raises(ValueError, match="owner"):
        e.fleet_release_lease(lease["request"], "b")
    episode = e.fleet_record_episode("b", "C")
    assert e.fleet_list_escalations().head()["status"] == "pending"
    e.fleet_resolve_escalation(episode, "wait", "a")
    assert e.fleet_list_escalations().head()["status"] == "resolved"
    assert e.fleet_status().head()["agents"] == 2
    e.record_usage("find_code", 12.0, True)
    assert e.get_usage_stats()["totals"].head()["calls"] == 1
    assert e.record_temporal_episode("r", "k1", "manual", [{"stable_key": "z", "change_type": "added", "after": "1"}]) == "new"
    assert e.record_temporal_episode("r", "k1", "manual", [{"stable_key": "z", "change_type": "added", "after": "1"}]) == "duplicate"
    with pytest.raises(ValueError, match="other changes"):
        e.record_temporal_episode("r", "k1", "manual", [{"stable_key": "z", "change_type": "added", "after": "2"}])


def test_processes_beyond_a_page(spark, repository, tmp_path_factory):
    from tesselark.api import Engine

    e = Engine(spark, str(tmp_path_factory.mktemp("home")))
    e.index_directory(str(repository), "r")
    rows = [("r", f"p{k:05}", "n", "configured", [f"s{k}"], "f", True, None) for k in range(1200)]
    from tesselark.api import LOGS

    spark.createDataFrame(rows, LOGS["processes"]).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{e.home}/processes")
    assert e.get_process_flow("p01150").head()["steps"] == ["s1150"]
    assert [r["process_key"] for r in e.get_process_membership("s1199").collect()] == ["p01199"]
    assert e.list_processes(limit=5000).count() == 1000


def test_watcher_sees_edits_and_deletions(spark, repository, tmp_path_factory):
    from tesselark.api import Engine

    e = Engine(spark, str(tmp_path_factory.mktemp("home")))
    q = e.watch_directory(str(repository / "src"), "r")

    def until(want):
        end = time.time() + 90
        while time.time() < end:
            with contextlib.suppress(ValueError):
                if {r["name"] for r in e.tables()["symbols"].where("kind = 'Function'").collect()} == want:
                    return True
            time.sleep(1)
        return False

    try:
        assert until({"a", "b", "start"})
        (repository / "src/a.py").write_text("def a():\n    return 1\n\ndef c():\n    return 2\n")
        assert until({"a", "c", "start"})
        (repository / "src/main.py").unlink()
        assert until({"a", "c"})
        assert e.list_watched_paths() == [f"watch:{repository}/src"]
    finally:
        q.stop()


def test_bursts_once_and_live_intents(spark, tmp_path):
    from tesselark.streaming import watch

    def run(name, rows, schema, plan, mode="append"):
        spark.createDataFrame(rows, schema).withColumn("at", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)")).write.parquet(str(tmp_path / name))
        source = spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
        plan(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-c")).start().awaitTermination(60)
        return spark.table(name).collect()

    got = run("bursts", [(0, "p"), (60, "p"), (5000, "p"), (0, "q")], "s int, path string", lambda d: watch.bursts(d, at="at"), "complete")
    assert sorted((r["path"], r["changes"]) for r in got) == [("p", 1), ("p", 2), ("q", 1)]
    got = run("onces", [(0, "k"), (5, "k"), (9, "l")], "s int, episode_key string", lambda d: watch.once(d, at="at"))
    assert sorted(r["episode_key"] for r in got) == ["k", "l"]
    got = run("intents", [(0, "a", ["t"]), (10, "b", ["t"])], "s int, agent string, targets array<string>", lambda d: watch.live_intents(d), "complete")
    assert max(r["agents"] for r in got) == 2


def test_streams(spark, tmp_path):
    from tesselark.streaming import watch

    rows = [("2024-01-01 00:00:01", "find", True), ("2024-01-01 00:30:00", "find", False), ("2024-01-01 03:00:00", "map", True)]
    spark.createDataFrame(rows, "ts string, tool string, ok boolean").selectExpr("cast(ts as timestamp) ts", "tool", "ok").write.parquet(str(tmp_path / "in"))
    calls = spark.readStream.schema("ts timestamp, tool string, ok boolean").parquet(str(tmp_path / "in"))
    q = watch.usage_windows(calls).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted((r["tool"], r["calls"], r["failed"]) for r in spark.table("windows").collect()) == [("find", 2, 1), ("map", 1, 0)]


def test_exports_heritage_selectors_and_paths():
    text = "export * from './a';\nexport { b as c } from './b';\nexport default run;\nmodule.exports.z = q;\nexport class K extends ns.B implements I, J {\n  el(x: Shape) { return document.querySelector('[data-id=\"save\"]'); }\n}\nconst v = <b data-id=\"save\"/>;\nconst ENDPOINTS = { users: '/api/users' };\n"
    rows = code.facts_of(text, "typescript")
    pick = lambda fact, *keys: {tuple(r.get(k) for k in keys) for r in rows if r["fact"] == fact}
    assert pick("export", "kind", "name", "specifier") >= {("re-export-all", "*", "./a"), ("re-export", "c", "./b"), ("default", "default", None), ("commonjs-named", "z", None), ("local", "K", None)}
    assert pick("relationship", "kind", "name") >= {("extends", "ns.B"), ("implements", "I"), ("implements", "J"), ("type-reference", "Shape")}
    assert pick("selector", "kind", "name") == {("consumer", "[data-id=save]"), ("producer", "[data-id=save]")}
    assert ("client", "ANY", "/api/users") in pick("api", "kind", "method", "path")
    assert code.framework_path("src/app/(shop)/users/[id]/@m/route.ts") == "/users/[id]" and code.framework_path("pages/api/x/index.js") == "/api/x" and code.framework_path("a/b.ts") is None


def test_rule_files(tmp_path):
    from tesselark.sources import rules

    want = [{"id": "r1", "contains": "eval(", "severity": "high", "case_sensitive": False}]
    assert rules.parse("# x\nrules:\n  - id: r1\n    contains: 'eval('\n    severity: high\n    case_sensitive: false\n") == want
    (tmp_path / "r.json").write_text('{"rules": [{"id": "a", "contains": "b"}]}')
    assert rules.load(str(tmp_path), "r.json") == [{"id": "a", "contains": "b"}]
    for bad in ("../r.json", "/etc/passwd", "a\x00b"):
        with pytest.raises(ValueError, match="unsafe"):
            rules.load(str(tmp_path), bad)
    with pytest.raises(ValueError, match="repeat"):
        rules.parse('[{"id": "a", "contains": "b"}, {"id": "a", "contains": "c"}]')


def test_state_and_compaction(spark, repository):
    from tesselark.plans import compact
    from tesselark.sources import state

    before = state.inspect(str(repository))
    assert before["head"] and before["dirty"] == [] and state.fresh(str(repository), before["snapshot_id"])
    (repository / "new.py").write_text("x = 1\n")
    assert not state.fresh(str(repository), before["snapshot_id"]) and state.inspect(str(repository))["dirty"] == ["new.py"]
    assert state.inspect("/")["head"] is None
    df = spark.createDataFrame([(k, f"t{k % 2}") for k in range(8)], "id int, text string")
    top = compact.compact(df, ["id"], ["id"], 3).collect()
    assert [r["id"] for r in top] == [0, 1, 2] and top[0]["total_rows"] == 8
    first = compact.unseen(df, "text", df.limit(0).withColumn("text_sha256", df["text"]))
    assert first.where("text is null").count() == 0
    assert compact.unseen(df, "text", first.where("id = 0")).where("text is not null").count() == 4
