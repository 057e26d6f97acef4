"""Linking of extracted facts into the code graph: imports, exports, calls and relationships.

Each tier of a cascade is a left join against targets that are unique for their key; the
first tier that answers wins, so order of evidence is the order of a coalesce.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Extensions and index names that an import specifier may leave out, in order.
EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".json")
INDEX_NAMES = ("/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/__init__.py")
SAME_FILE, IMPORTED, GLOBAL = 0.99, 0.97, 0.70


def unique_target(rows: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Keys with exactly one distinct target; min and max tell without collecting the targets."""
    return rows.groupBy(*keys).agg(F.min(target).alias(target), F.max(target).alias("__most")).where(F.col(target) == F.col("__most")).drop("__most")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (repo_id, file_path, specifier) with target_path: relative, rooted or dotted, else a unique base name."""
    folder = F.regexp_replace("file_path", r"[^/]*$", "")
    relative = F.when(F.col("specifier").startswith("."), F.concat(folder, F.col("specifier")))
    dots = F.length(F.regexp_extract("specifier", r"^(\.+)", 1))
    dotted = F.regexp_replace(F.regexp_replace("specifier", r"^\.+", ""), r"\.", "/")
    above = F.concat(folder, F.when(dots > 1, F.array_join(F.array_repeat(F.lit("../"), dots - 1), "")).otherwise(F.lit("")), dotted)
    bases = F.array_compact(F.array(relative, F.regexp_replace("specifier", "^/", ""), F.when(F.col("file_path").endswith(".py"), F.when(dots > 0, above).otherwise(dotted)), F.when(F.col("file_path").endswith(".py") & (dots == 0), F.concat(folder, dotted))))
    tails = F.array(*[F.lit(x) for x in (*EXTENSIONS, *INDEX_NAMES)])
    tried = F.flatten(F.transform(bases, lambda b: F.transform(tails, lambda t: F.concat(b, t))))
    clean = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), r"[^/.][^/]*/\.\./", ""), r"[^/.][^/]*/\.\./", ""), r"[^/.][^/]*/\.\./", ""), "^/", "")
    keyed = imports.withColumn("__i", F.xxhash64("repo_id", "file_path", "specifier"))
    options = keyed.select("repo_id", "__i", F.posexplode(F.transform(tried, clean)).alias("rank", "path"))
    known = files.select("repo_id", F.col("file_path").alias("path"))
    first = options.join(known, ["repo_id", "path"]).groupBy("__i").agg(F.min_by("path", "rank").alias("exact"))
    names = unique_target(files.select("repo_id", F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "").alias("base"), F.col("file_path").alias("only")), ["repo_id", "base"], "only")
    base = F.regexp_replace(F.element_at(F.split("specifier", r"[/.]"), -1), r"\.[^.]*$", "")
    out = keyed.join(first, "__i", "left").withColumn("base", base).join(names, ["repo_id", "base"], "left")
    local = F.col("specifier").startswith(".") | F.col("specifier").startswith("/")
    return out.withColumn("target_path", F.coalesce("exact", F.when(local, F.col("only")))).drop("__i", "exact", "base", "only")


def resolve_exports(exports: DataFrame, stars: DataFrame, rounds: int = 16) -> DataFrame:
    """(file_path, name, target): exported names through barrels; a file's own export hides a starred one.

    exports: (file_path, name, target); stars: (file_path, from_path).
    """
    found = cut(exports.select("file_path", "name", "target", F.lit(0).alias("hop")))
    frontier = found
    for hop in range(1, rounds + 1):
        up = stars.select(F.col("file_path").alias("barrel"), F.col("from_path").alias("file_path"))
        nxt = frontier.where("name != 'default'").join(up, "file_path").select(F.col("barrel").alias("file_path"), "name", "target").distinct()
        frontier = cut(nxt.join(found, ["file_path", "name"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return unique_target(found.select("file_path", "name", "target"), ["file_path", "name"], "target")


def resolve_calls(calls: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """calls with target, confidence and status, by the tiers of evidence.

    calls: (repo_id, file_path, source, owner, callee, qualifier, occurrences);
    symbols: (repo_id, file_path, stable_key, name, qualified_name);
    bindings: (file_path, local, imported, kind, target_path) of resolved imports.
    """
    keyed = calls.withColumn("__c", F.xxhash64("repo_id", "file_path", "source", "callee", F.coalesce("qualifier", F.lit(""))))
    by_qualified = unique_target(symbols, ["repo_id", "file_path", "qualified_name"], "stable_key")
    by_name = unique_target(symbols, ["repo_id", "file_path", "name"], "stable_key")
    globally = symbols.groupBy("repo_id", "name").agg(F.count_distinct("stable_key").alias("n"), F.min("stable_key").alias("only"))

    def look(condition, left, right, tier):
        r = right.select(*[F.col(k).alias(f"__{k}") for k in right.columns])
        return keyed.where(condition).join(r, left(r)).select("__c", F.col("__stable_key").alias(tier))

    own = F.col("qualifier").isin("this", "super", "self", "cls")
    plain = F.col("qualifier").isNull() | (F.col("qualifier") == "")
    same = lambda r, n: (F.col("repo_id") == F.col("__repo_id")) & (F.col("file_path") == F.col("__file_path")) & (n == F.col(f"__{'qualified_name' if '__qualified_name' in r.columns else 'name'}"))
    t1 = look(own, lambda r: same(r, F.concat_ws(".", "owner", "callee")), by_qualified, "t1")
    t2 = look(~own & ~plain, lambda r: same(r, F.concat_ws(".", "qualifier", "callee")), by_qualified, "t2")
    t4 = look(plain, lambda r: same(r, F.col("callee")), by_name, "t4")
    b = bindings.select(F.col("file_path").alias("bf"), "local", "imported", "kind", F.col("target_path").alias("bt"))
    spaces = keyed.where(~own & ~plain).join(b.where("kind in ('namespace', 'commonjs', 'default')"), (F.col("file_path") == F.col("bf")) & (F.col("qualifier") == F.col("local")))
    names = by_name.select(F.col("repo_id").alias("nr"), F.col("file_path").alias("nf"), F.col("name").alias("nn"), F.col("stable_key").alias("key"))
    t3 = unique_target(spaces.join(names, (F.col("repo_id") == F.col("nr")) & (F.col("bt") == F.col("nf")) & (F.col("callee") == F.col("nn"))).select("__c", F.col("key").alias("t3")), ["__c"], "t3")
    direct = keyed.where(plain).join(b.where("kind in ('named', 'default', 'commonjs')"), (F.col("file_path") == F.col("bf")) & (F.col("callee") == F.col("local")))
    t5 = unique_target(direct.join(names, (F.col("repo_id") == F.col("nr")) & (F.col("bt") == F.col("nf")) & (F.col("imported") == F.col("nn"))).select("__c", F.col("key").alias("t5")), ["__c"], "t5")
    out = keyed
    for t in (t1, t2, t3, t4, t5):
        out = out.join(t, "__c", "left")
    g = globally.select(F.col("repo_id").alias("gr"), F.col("name").alias("gn"), F.col("n").alias("gc"), F.col("only"))
    out = out.join(g, (F.col("repo_id") == F.col("gr")) & (F.col("callee") == F.col("gn")), "left")
    last = F.when(plain & (F.col("gc") == 1), F.col("only"))
    target = F.coalesce("t1", "t2", "t3", "t4", "t5", last)
    confidence = F.when(F.coalesce("t1", "t2").isNotNull(), SAME_FILE).when(F.col("t3").isNotNull(), IMPORTED).when(F.col("t4").isNotNull(), SAME_FILE).when(F.col("t5").isNotNull(), IMPORTED).when(last.isNotNull(), GLOBAL)
    status = F.when(target.isNotNull(), "resolved").when(F.col("gc") > 1, "ambiguous").otherwise("unresolved")
    return out.select(*calls.columns, target.alias("target"), confidence.alias("confidence"), status.alias("status"))


def resolve_relationships(relations: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """Heritage and type references: in the same file, through an import, else a unique name of the repository; no self-edges."""
    leaf = F.element_at(F.split("target_name", r"\."), -1)
    keyed = relations.withColumn("leaf", leaf)
    local = unique_target(symbols, ["repo_id", "file_path", "name"], "stable_key").select("repo_id", "file_path", F.col("name").alias("leaf"), F.col("stable_key").alias("a"))
    b = bindings.select("file_path", F.col("local").alias("leaf"), "imported", F.col("target_path"))
    names = unique_target(symbols, ["file_path", "name"], "stable_key").select(F.col("file_path").alias("target_path"), F.col("name").alias("imported"), F.col("stable_key").alias("b"))
    through = unique_target(b.join(names, ["target_path", "imported"]), ["file_path", "leaf"], "b")
    whole = unique_target(symbols, ["repo_id", "name"], "stable_key").select("repo_id", F.col("name").alias("leaf"), F.col("stable_key").alias("c"))
    out = keyed.join(local, ["repo_id", "file_path", "leaf"], "left").join(through, ["file_path", "leaf"], "left").join(whole, ["repo_id", "leaf"], "left")
    return out.withColumn("target", F.coalesce("a", "b", "c")).where("target is null or target != source").drop("leaf", "a", "b", "c")


def selector_edges(selectors: DataFrame) -> DataFrame:
    """Consumers of a DOM selector joined with its producers; the weaker confidence counts."""
    p = selectors.where("role = 'producer'").select("repo_id", "selector", F.col("symbol").alias("target"), F.col("confidence").alias("pc"))
    c = selectors.where("role = 'consumer'").select("repo_id", "selector", F.col("symbol").alias("source"), F.col("confidence").alias("cc"))
    return c.join(p, ["repo_id", "selector"]).where("source != target").select("repo_id", "source", "target", F.col("selector").alias("label"), F.least("pc", "cc").alias("confidence"), F.lit("dom-selector").alias("kind"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge of each kind, ends and label, the most confident."""
    keys = [c for c in ("repo_id", "kind", "source", "target", "source_file", "target_file", "label") if c in edges.columns]
    return edges.groupBy(*keys).agg(F.max("confidence").alias("confidence"))
