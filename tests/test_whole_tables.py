"""Queries without SQL on small tables that a subset of the rows would answer wrongly."""

import datetime

from tesselark.bindings import QUERIES

ITEMS = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp"


def items(spark, folder, orders, flag="R", year=1995):
    """A lineitem table of orders, each a list of suppliers."""
    rows = [(k, n, 1, s, flag, datetime.datetime(year, 1, 1)) for k, o in enumerate(orders) for n, s in enumerate(o)]
    spark.createDataFrame(rows, ITEMS).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def cut_nodes(pairs):
    """Nodes without which some component falls apart, by trying each of them."""

    def parts(nodes):
        left, n = set(nodes), 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                v = todo.pop()
                near = {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}
                todo += near & left
                left -= near
        return n

    nodes = {x for p in pairs for x in p}
    return {v for v in nodes if parts(nodes - {v}) > parts(nodes)}


# two triangles that meet in 101, a tail from 104, and a ring of low ids closed by a high one
LINKS = [[100, 101, 102, 100], [101, 103, 104, 101], [104, 105], [3, 6, 9], [9, 500], [500, 3], [41, 1]]


def test_bridges_of_every_supplier(spark, tmp_path):
    d = items(spark, tmp_path, LINKS)
    got = [r["node"] for r in QUERIES["bridge_symbols"](spark, d).collect()]
    assert got == [101, 104]
    assert set(got) == cut_nodes({(a, b) for o in LINKS for a, b in zip(o, o[1:])})


def test_bridges_of_every_line_item(spark, tmp_path):
    d = items(spark, tmp_path, LINKS, "N", 1998)
    assert [r["node"] for r in QUERIES["bridge_symbols"](spark, d).collect()] == [101, 104]


def test_communities_of_every_line_item(spark, tmp_path):
    """Two triangles with one edge between them are two communities."""
    d = items(spark, tmp_path, [[1, 2, 3, 1], [11, 12, 13, 11], [3, 11]], "N", 1998)
    got = {r["node"]: r["community"] for r in QUERIES["file_communities"](spark, d).collect()}
    assert sorted(got) == [1, 2, 3, 11, 12, 13]
    assert got[1] == got[2] == got[3] != got[11] == got[12] == got[13]


def test_clusters_of_many_files_have_two_levels_as_in_sql(spark, tmp_path):
    import duckdb

    from tesselark.bindings import ORACLES

    rows = [(k, "b1", "t1", f"n{k % 3}") for k in range(500)] + [(500, "b1", "t2", "n"), (501, "b2", "t1", None), (502, None, "t1", "n")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["directory_clusters"](spark, str(tmp_path)).select("cluster", "files").collect()}
    assert got == set(con.execute(f"SELECT cluster, files FROM ({ORACLES['directory_clusters']})").fetchall())


def test_busy_directories_have_three_levels(spark):
    from tesselark.operators import graph

    files = spark.createDataFrame([(f"a/b/{c}/{k}",) for c in "xy" for k in range(3)] + [("a/c/d/1",)], "file_path string")
    got = {r["cluster"] for r in graph.directory_clusters(files, most=5).collect()}
    assert got == {"a/b/x", "a/b/y", "a/c"}


def test_stats_add_up_a_file_before_the_levels(spark):
    from tesselark.operators import catalog

    df = spark.createDataFrame([("a", "x", 1, 1.5), ("a", "x", 1, 2.0), ("a", "y", 1, 1.0), ("b", "x", None, 4.0), (None, "x", 2, 0.5)], "kind string, status string, file int, n double")
    got = catalog.symbol_stats(df, ["kind", "status"], "file", "n")
    assert {tuple(r) for r in got.collect()} == {
        ("a", "x", 2, 1, 3.5), ("a", "y", 1, 1, 1.0), ("b", "x", 1, 0, 4.0), (None, "x", 1, 1, 0.5),
        ("a", None, 3, 1, 4.5), ("b", None, 1, 0, 4.0), (None, None, 1, 1, 0.5), (None, None, 5, 2, 9.0),
    }
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan.split("Scan")[0] and plan.rindex("HashAggregate") > plan.rindex("Expand")
