import pytest
from pyspark.sql import functions as F

from tesselark.functions import text as fx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_tokens(spark):
    assert one(spark, fx.code_tokens(F.lit("HTTPClient_authorizeRequests.ts"))) == ["http", "client", "authorize", "request", "ts"]
    assert one(spark, fx.code_tokens(F.lit("ÜberHTTPClient"))) == ["über", "http", "client"]
    assert one(spark, fx.code_tokens(F.lit(""))) == []


def test_paths(spark):
    cases = {"https://x.org/users/42?q=1": "/users/{}", "/users/:id/": "/users/{}", "/a//b/[id]": "/a/b/{}", "${BASE}/v1/{x}": "/v1/{}", "": "/", "v1/1/2": "/v1/{}/{}", "/list{}": "/list"}
    for given, want in cases.items():
        assert one(spark, fx.normal_api_path(F.lit(given))) == want, given
    assert one(spark, fx.top_directory(F.lit("a/b/c.py"), 2)) == "a/b"
    assert one(spark, fx.top_directory(F.lit("c.py"), 2)) == "."
    assert one(spark, fx.is_test_path(F.lit("src/tests/a.py"))) and not one(spark, fx.is_test_path(F.lit("src/latest/a.py")))


def test_hash_and_similarity(spark):
    assert one(spark, fx.fnv1a(F.lit("abc"))) == 440920331
    assert one(spark, fx.dice(fx.char_grams(F.lit("night")), fx.char_grams(F.lit("nigth")))) > 0
    assert one(spark, fx.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)


def test_clamp():
    assert [fx.clamp(v, 20, 1, 100) for v in (None, 0, 5, 1000, -3, "x")] == [20, 20, 5, 100, 1, 20]


def test_fixed_values(spark):
    assert one(spark, fx.code_tokens(F.lit("where have all these been added while parsing"))) == ["all", "added", "pars"]
    for path, test, graph, entry in (("a/fixtures/b.py", True, True, False), ("e2e/x.ts", False, True, False), ("src/worker.ts", False, False, True), ("bin/run", False, False, True), ("x.spec.ts", True, True, False), ("test_a.py", False, False, False)):
        assert (one(spark, fx.is_test_path(F.lit(path))), one(spark, fx.is_test_path(F.lit(path), True)), one(spark, fx.is_entry_path(F.lit(path)))) == (test, graph, entry), path


def test_concepts_and_identifiers(spark):
    from tesselark.operators import search
    from tesselark.plans.find_code import CONCEPTS, concepts

    assert len(CONCEPTS) == 17
    assert one(spark, concepts(fx.code_tokens(F.lit("parseQueries")))) == ["persistence", "validation", "transformation", "reading"]
    assert one(spark, concepts(fx.code_tokens(F.lit("signin")))) == ["authentication"]
    tokens = fx.code_tokens(F.lit("login user"))
    assert one(spark, search.coverage(fx.code_tokens(F.lit("authenticateUserName")), tokens, concepts)) == 2 / 3
    exact = lambda n, q: one(spark, search.exact_score(F.lit(n), F.lit(n), fx.code_tokens(F.lit(q)), F.lit(q)))
    assert [exact("load_user", "loadUser"), exact("loadUserName", "load user"), exact("nameOfLoadedUser", "user load"), exact("x", "load")] == [1.0, 0.82, 0.9, 0.0]


def test_risk_levels(spark):
    from tesselark.operators import review

    names = "symbols int, files int, changed_symbols int, changed_files int, strong_cochanges int, unmapped int, decisions int"
    cases = {(0, 0, 1, 1, 0, 0, 0): "low", (0, 0, 1, 1, 1, 0, 0): "medium", (0, 0, 1, 1, 3, 0, 0): "medium", (0, 0, 10, 1, 0, 0, 0): "high", (0, 0, 1, 5, 3, 0, 0): "critical", (0, 0, 1, 1, 0, 1, 0): "medium", (0, 0, 1, 1, 0, 0, 2): "medium", (40, 1, 1, 1, 9, 1, 1): "critical"}
    rows = spark.createDataFrame(list(cases), names)
    assert [r["risk"] for r in review.aggregate_risk(rows).collect()] == list(cases.values())
