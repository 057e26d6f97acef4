"""API topology and cross-repository service rendezvous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import methods_agree, normal_api_path, normal_method
from ..session import cut

#: Ends of a route, mounts composed.
MOUNT_PASSES = 12


def compose_mounts(routes: DataFrame, mounts: DataFrame, passes: int = MOUNT_PASSES) -> DataFrame:
    """Routes with the prefixes under which their files are mounted, directly or through other mounts.

    routes: (route, file, path, method, ...); mounts: (parent, child, prefix).
    """
    prefixes = mounts.select(F.col("child").alias("file"), F.col("parent").alias("up"), F.col("prefix").alias("prefix"))
    done = frontier = cut(prefixes)
    for _ in range(passes - 1):
        over = mounts.select(F.col("child").alias("up"), F.col("parent").alias("next"), F.col("prefix").alias("outer"))
        nxt = frontier.join(over, "up").select("file", F.col("next").alias("up"), F.concat("outer", "prefix").alias("prefix"))
        frontier = cut(nxt.join(done, ["file", "up", "prefix"], "left_anti").distinct())
        if frontier.isEmpty():
            break
        done = done.unionByName(frontier)
    roots = done.join(mounts.select(F.col("child").alias("up")).distinct(), "up", "left_anti")
    composed = routes.join(roots.select("file", "prefix"), "file", "left")
    return composed.withColumn("path", normal_api_path(F.concat(F.coalesce("prefix", F.lit("")), F.col("path"))))


def api_links(routes: DataFrame, clients: DataFrame) -> DataFrame:
    """(client, route, path, confidence): clients and routes with the same path and agreeing methods."""
    r = routes.select("route", normal_api_path("path").alias("path"), normal_method("method").alias("rm"), F.col("confidence").alias("rc"))
    c = clients.select("client", normal_api_path("path").alias("path"), normal_method("method").alias("cm"), F.col("confidence").alias("cc"))
    return c.join(r, "path").where(methods_agree("cm", "rm")).select("client", "route", "path", F.least("cc", "rc").alias("confidence"))


def api_link_counts(routes: DataFrame, clients: DataFrame) -> DataFrame:
    """(path, links): how many api_links each path has, from its routes and clients of each method, without making them."""
    r = routes.groupBy(normal_api_path("path").alias("path"), normal_method("method").alias("rm")).agg(F.count("*").alias("routes"))
    c = clients.groupBy(normal_api_path("path").alias("path"), normal_method("method").alias("cm")).agg(F.count("*").alias("clients"))
    return c.join(r, "path").where(methods_agree("cm", "rm")).groupBy("path").agg(F.sum(F.col("routes") * F.col("clients")).alias("links"))


def rendezvous(outbound: DataFrame, inbound: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Outbound operations matched with inbound ones of other repositories.

    Both have (op, repo_id, protocol, key, confidence, broker, service, base_url_known).  An
    unstated broker matches any at a penalty; several accepted providers make a match ambiguous,
    counted before the confidence filter.
    """
    o = outbound.select(F.col("op").alias("outbound"), F.col("repo_id").alias("source_repo"), "protocol", "key", F.col("confidence").alias("oc"), F.col("broker").alias("ob"), F.col("base_url_known").alias("known"))
    i = inbound.select(F.col("op").alias("inbound"), F.col("repo_id").alias("target_repo"), "protocol", "key", F.col("confidence").alias("ic"), F.col("broker").alias("ib"), "service")
    met = o.join(i, ["protocol", "key"]).where("source_repo != target_repo").where("ob is null or ib is null or ob = ib")
    penalty = F.when((F.col("protocol") == "queue") & (F.col("ob").isNull() | F.col("ib").isNull()), 0.85).otherwise(1.0)
    several = met.groupBy("outbound").agg(F.when(F.min("target_repo") < F.max("target_repo"), 2).otherwise(1).alias("providers"))
    met = met.join(several, "outbound")
    identity = F.when(F.col("protocol") != "http", 1.0).when(F.col("known"), 0.98).when(F.col("providers") > 1, 0.55).otherwise(0.75)
    out = met.withColumn("confidence", F.round(F.least("oc", "ic") * penalty * identity, 6)).withColumn("status", F.when((F.col("providers") > 1) & ~((F.col("protocol") == "http") & F.col("known")), "ambiguous").otherwise("resolved"))
    return out.where(F.col("confidence") >= min_confidence).select("outbound", "inbound", "source_repo", "target_repo", "protocol", "service", "status", "confidence")


def unmatched(outbound: DataFrame, matches: DataFrame, inbound: DataFrame) -> DataFrame:
    """Outbound operations without a match, with the reason."""
    left = outbound.join(matches.select(F.col("outbound").alias("op")).distinct(), "op", "left_anti")
    known = inbound.select("protocol", "key", F.col("repo_id").alias("r")).groupBy("protocol", "key").agg(F.count_distinct("r").alias("n"), F.min("r").alias("r"))
    j = left.join(known, ["protocol", "key"], "left")
    reason = F.when(F.col("n").isNull(), "no_provider").when((F.col("n") == 1) & (F.col("r") == F.col("repo_id")), "same_repository").otherwise("incompatible")
    return j.select("op", reason.alias("reason"))


def diagram(matches: DataFrame) -> DataFrame:
    return matches.groupBy("source_repo", "target_repo", "protocol", "status").agg(F.count("*").alias("operations"), F.min("confidence").alias("confidence"), F.slice(F.array_sort(F.collect_set("outbound")), 1, 5).alias("examples"))


def callers(matches: DataFrame, repo, direction: str = "both") -> DataFrame:
    inn, out = F.col("target_repo") == F.lit(repo), F.col("source_repo") == F.lit(repo)
    return matches.where({"inbound": inn, "outbound": out, "both": inn | out}[direction])


def canonical_links(links: DataFrame) -> DataFrame:
    """One link of each service and repository; provider and consumer make both."""
    got = links.groupBy("service_key", "repo_id").agg(F.max(F.col("role").isin("provider", "both")).alias("p"), F.max(F.col("role").isin("consumer", "both")).alias("c"), F.min("confidence").alias("confidence"), F.min("created_at").alias("created_at"))
    return got.select("service_key", "repo_id", F.when(F.col("p") & F.col("c"), "both").when(F.col("p"), "provider").otherwise("consumer").alias("role"), "confidence", "created_at")


def infer_identities(repositories: DataFrame, configured: DataFrame, routes: DataFrame) -> DataFrame:
    """An inferred provider identity for each repository without a configured one."""
    absolute = routes.groupBy("repo_id").agg(F.max(F.col("path").rlike("^https?://")).alias("absolute"))
    return repositories.join(configured.select("repo_id").distinct(), "repo_id", "left_anti").join(absolute, "repo_id", "left").select("repo_id", F.concat(F.lit("inferred:"), F.col("repo_id").cast("string")).alias("service_key"), F.when(F.coalesce("absolute", F.lit(False)), 0.7).otherwise(0.5).alias("confidence"))
