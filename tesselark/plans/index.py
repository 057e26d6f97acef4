"""Indexing a source tree: facts, links and the code graph, written as one generation of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_api_path
from ..sources import code, tree
from . import find_code, link


def build(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of the graph from (repo_id, file_path, language, content, hash, ...)."""
    facts = code.extract(files)
    return relate(files, facts)


def relate(files: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    symbols = facts.where("fact = 'symbol'").select("repo_id", "file_path", code.stable_key().alias("stable_key"), "name", "qualified_name", "kind", "start_line", "end_line", "exported", "signature", "cyclomatic", "cognitive", "body", "mode", F.sha2(F.coalesce("body", F.lit("")), 256).alias("fingerprint"))
    imports = facts.where("fact = 'import'").select("repo_id", "file_path", "specifier", "kind", "local", "imported")
    targets = link.resolve_imports(imports.select("repo_id", "file_path", "specifier").distinct(), files.select("repo_id", "file_path"))
    imports = imports.join(targets, ["repo_id", "file_path", "specifier"], "left")
    owner = symbols.select("repo_id", "file_path", F.col("qualified_name").alias("owner"), F.col("stable_key").alias("source"))
    first = owner.groupBy("repo_id", "file_path", "owner").agg(F.min("source").alias("source"))
    calls = facts.where("fact = 'call'").select("repo_id", "file_path", "owner", "callee", "qualifier", "occurrences").join(first, ["repo_id", "file_path", "owner"], "left")
    around = calls.withColumn("owner", F.regexp_replace("owner", r"\.?[^.]+$", ""))
    resolved = link.resolve_calls(around, symbols, imports.where("target_path is not null").select("file_path", "local", "imported", "kind", "target_path"))
    call_edges = resolved.where("target is not null and source is not null").select("repo_id", F.lit("calls").alias("kind"), "source", "target", F.col("callee").alias("label"), "confidence")
    import_edges = imports.where("target_path is not null").select("repo_id", F.lit("imports").alias("kind"), F.col("file_path").alias("source"), F.col("target_path").alias("target"), F.col("specifier").alias("label"), F.lit(link.SAME_FILE).alias("confidence"))
    named = lambda fact: facts.where(F.col("fact") == fact).select("repo_id", "file_path", "owner", F.col("name").alias("target_name"), "kind", "confidence").join(first, ["repo_id", "file_path", "owner"], "left")
    bindings = imports.where("target_path is not null").select("file_path", "local", "imported", "kind", "target_path")
    relations = link.resolve_relationships(named("relationship").where("source is not null"), symbols, bindings)
    relation_edges = relations.where("target is not null").select("repo_id", "kind", "source", "target", F.col("target_name").alias("label"), "confidence")
    selectors = named("selector").select("repo_id", F.col("target_name").alias("selector"), F.coalesce("source", F.concat_ws(":", "file_path", "owner")).alias("symbol"), F.col("kind").alias("role"), "confidence")
    selector_edges = link.selector_edges(selectors).select("repo_id", "kind", "source", "target", "label", "confidence")
    exports = facts.where("fact = 'export'").select("repo_id", "file_path", "kind", "name", "local", "specifier")
    api = facts.where("fact = 'api'").select("repo_id", "file_path", "kind", "method", normal_api_path("path").alias("path"), F.col("name").alias("handler"), "confidence", "start_line")
    return {
        "files": files.drop("reuse"),
        "symbols": symbols,
        "imports": imports,
        "calls": resolved,
        "relationships": relations.select("repo_id", "file_path", "kind", "source", "target_name", "target", "confidence"),
        "exports": exports,
        "edges": link.distinct_edges(call_edges.unionByName(import_edges).unionByName(relation_edges).unionByName(selector_edges)),
        "api_operations": api,
        "diagnostics": facts.where("fact = 'diagnostic'").select("repo_id", "file_path", F.col("name").alias("diagnostic"), "mode"),
    }


def index_directory(spark: SparkSession, root: str, repo_id: str, store: str, known: dict[str, DataFrame] | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Scan, extract, link and write a new generation under `store`; unchanged files keep their facts.

    A generation is a folder of its own, so readers see the old one or the new one whole.
    """
    found = tree.scan(spark, root, repo_id)
    if known is not None and not force:
        split = tree.reusable(found, known["files"])
        fresh = code.extract(split.where("not reuse"))
        kept = known["facts"].join(split.where("reuse").select("repo_id", "file_path"), ["repo_id", "file_path"], "left_semi")
        facts = kept.select(*fresh.columns).unionByName(fresh)
    else:
        facts = code.extract(found)
    facts.write.mode("errorifexists").parquet(f"{store}/facts")
    facts = spark.read.parquet(f"{store}/facts")
    for name, df in relate(found, facts).items():
        df.write.mode("errorifexists").parquet(f"{store}/{name}")
    tables = load(spark, store, searched=False)
    for name, df in find_code.build(search_documents(tables["symbols"])).items():
        df.write.mode("errorifexists").parquet(f"{store}/search_{name}")
    return load(spark, store)


def search_documents(symbols: DataFrame) -> DataFrame:
    """What code search reads of a symbol; the first 3,000 characters of its body."""
    return symbols.select(F.col("stable_key").alias("id"), "name", "qualified_name", "kind", "file_path", "signature", F.substring("body", 1, 3000).alias("body_text"))


TABLES = ("facts", "files", "symbols", "imports", "calls", "relationships", "exports", "edges", "api_operations", "diagnostics")


SEARCH_TABLES = ("postings", "lengths", "vocabulary", "vectors", "names")


def load(spark: SparkSession, store: str, searched: bool = True) -> dict[str, DataFrame]:
    names = [*TABLES, *(f"search_{t}" for t in SEARCH_TABLES if searched)]
    return {t: spark.read.parquet(f"{store}/{t}") for t in names}


def changes(before: dict[str, DataFrame] | None, after: dict[str, DataFrame]) -> DataFrame:
    """Added, modified and removed symbols between two generations, by stable key and body."""
    from ..operators.temporal import state_diff

    old = before["symbols"] if before else after["symbols"].limit(0)
    return state_diff(old, after["symbols"])
