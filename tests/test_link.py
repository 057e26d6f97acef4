"""Linking tiers, exports and selectors on small tables."""

from tesselark.plans import link


def test_imports(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/a.ts", "src/lib/index.ts", "src/util.ts", "pkg/m.py", "pkg/sub/__init__.py", "deep/only.go")], "repo_id string, file_path string")
    wanted = [("src/a.ts", "./util", "src/util.ts"), ("src/a.ts", "./lib", "src/lib/index.ts"), ("src/lib/index.ts", "../a", "src/a.ts"), ("src/a.ts", "react", None), ("pkg/sub/__init__.py", "..m", "pkg/m.py"), ("src/a.ts", "pkg.m", None), ("pkg/m.py", "pkg.sub", "pkg/sub/__init__.py"), ("src/a.ts", "./gone/only", "deep/only.go")]
    imports = spark.createDataFrame([("r", f, s) for f, s, _ in wanted], "repo_id string, file_path string, specifier string")
    got = {(r["file_path"], r["specifier"]): r["target_path"] for r in link.resolve_imports(imports, files).collect()}
    assert got == {(f, s): t for f, s, t in wanted}


def test_call_tiers(spark):
    symbols = spark.createDataFrame(
        [("r", "a.py", "a:f", "f", "f"), ("r", "a.py", "a:C.go", "go", "C.go"), ("r", "b.py", "b:g", "g", "g"), ("r", "b.py", "b:only", "only", "only"), ("r", "b.py", "b:twice", "twice", "twice"), ("r", "c.py", "c:twice", "twice", "twice")],
        "repo_id string, file_path string, stable_key string, name string, qualified_name string",
    )
    bindings = spark.createDataFrame([("a.py", "h", "g", "named", "b.py"), ("a.py", "mod", "*", "namespace", "b.py")], "file_path string, local string, imported string, kind string, target_path string")
    calls = [("go", "self", "C", "a:C.go", 0.99, "resolved"), ("go", "C", "", "a:C.go", 0.99, "resolved"), ("g", "mod", "", "b:g", 0.97, "resolved"), ("f", None, "", "a:f", 0.99, "resolved"), ("h", None, "", "b:g", 0.97, "resolved"), ("only", None, "", "b:only", 0.70, "resolved"), ("twice", None, "", None, None, "ambiguous"), ("none", None, "", None, None, "unresolved"), ("only", "x", "", None, None, "unresolved")]
    frame = spark.createDataFrame([("r", "a.py", "s", o, c, q, 1) for c, q, o, *_ in calls], "repo_id string, file_path string, source string, owner string, callee string, qualifier string, occurrences int")
    got = {(r["callee"], r["qualifier"]): (r["target"], r["confidence"], r["status"]) for r in link.resolve_calls(frame, symbols, bindings).collect()}
    assert got == {(c, q): (t, k, s) for c, q, _, t, k, s in calls}


def test_exports_through_barrels(spark):
    exports = spark.createDataFrame([("a", "x", "a:x"), ("b", "y", "b:y"), ("b", "default", "b:d"), ("index", "y", "index:y")], "file_path string, name string, target string")
    stars = spark.createDataFrame([("index", "a"), ("index", "b"), ("top", "index"), ("index", "top")], "file_path string, from_path string")
    got = {(r["file_path"], r["name"]): r["target"] for r in link.resolve_exports(exports, stars).collect()}
    assert got[("top", "x")] == "a:x" and got[("index", "y")] == "index:y" and got[("top", "y")] == "index:y" and ("index", "default") not in got


def test_selectors_and_relationships(spark):
    s = spark.createDataFrame([("r", "data-x", "p", "producer", 0.9), ("r", "data-x", "c", "consumer", 0.8), ("r", "data-x", "p", "consumer", 0.8)], "repo_id string, selector string, symbol string, role string, confidence double")
    assert [(r["source"], r["target"], r["confidence"]) for r in link.selector_edges(s).collect()] == [("c", "p", 0.8)]
    symbols = spark.createDataFrame([("r", "a", "a:B", "B"), ("r", "b", "b:D", "D")], "repo_id string, file_path string, stable_key string, name string")
    none = spark.createDataFrame([], "file_path string, local string, imported string, kind string, target_path string")
    rel = spark.createDataFrame([("r", "a", "a:K", "ns.B"), ("r", "a", "a:K", "D"), ("r", "a", "a:B", "B")], "repo_id string, file_path string, source string, target_name string")
    got = {(r["source"], r["target"]) for r in link.resolve_relationships(rel, symbols, none).collect()}
    assert got == {("a:K", "a:B"), ("a:K", "b:D")}
