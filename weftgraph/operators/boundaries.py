"""Boundaries (roots, folders, regions), inferred layers and domains, overrides, and their validation.

Provenance never upgrades: whatever rests on anything but verified or derived
facts is heuristic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators.cluster import adaptive_clusters
from weftgraph.plans.fixpoint import forget, written

KINDS = ("module-root", "folder", "region")


def propagated(origins: Column, otherwise: str = "derived") -> Column:
    """heuristic if any of the origins (an array) is neither verified nor derived."""
    return F.when(F.exists(origins, lambda o: ~o.isin("verified", "derived")), "heuristic").otherwise(otherwise)


def folder_boundaries(files: DataFrame) -> DataFrame:
    """(kind, path, parent, n_files, contained) for every directory on the way to a file."""
    pairs = files.select("path", F.explode(paths.ancestors(F.col("path"))).alias("folder"))
    g = pairs.groupBy("folder").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("path")).alias("contained"))
    return g.select(F.lit("folder").alias("kind"), F.col("folder").alias("path"), F.when(F.col("folder").contains("/"), paths.directory(F.col("folder"))).alias("parent"), "n_files", "contained")


def region_boundaries(files: DataFrame) -> DataFrame:
    g = adaptive_clusters(files).groupBy("folder").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("path")).alias("contained"))
    return g.select(F.lit("region").alias("kind"), F.col("folder").alias("path"), F.lit(None).cast("string").alias("parent"), "n_files", "contained")


def root_boundaries(roots: DataFrame, contains: DataFrame) -> DataFrame:
    """roots(root_id, root_path, confidence), contains(root_id, path)."""
    g = contains.groupBy("root_id").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("path")).alias("contained"))
    j = roots.join(g, "root_id", "left")
    return j.select(F.lit("module-root").alias("kind"), F.col("root_path").alias("path"), F.lit(None).cast("string").alias("parent"), F.coalesce("n_files", F.lit(0).cast("long")).alias("n_files"), F.coalesce("contained", F.array().cast("array<string>")).alias("contained"))


def in_order(boundaries: DataFrame) -> DataFrame:
    return boundaries.orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "path")


def endless(links: DataFrame) -> DataFrame:
    """(key) of links(key, up), one up for each key, from which going up never ends: every round doubles the steps that are taken."""
    links = written(links.select("key", "up").dropDuplicates(["key"]))
    n = live = links.count()
    steps = 1
    while live and steps <= n:
        far = links.select(F.col("key").alias("up"), F.col("up").alias("further"))
        further = written(links.join(far, "up").select("key", F.col("further").alias("up")))  # what reaches a top has no row left
        forget(links)
        links = further
        live, steps = links.count(), 2 * steps
    return links.select("key")


def boundary_violations(boundaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule, subject): repeated boundaries, unknown, repeated or unordered members, missing parents, parents that lead into a circle."""
    key = F.concat("kind", F.lit(":"), "path")
    b = boundaries.withColumn("key", key)
    member = b.select("key", F.posexplode("contained").alias("pos", "member"))
    after = F.lag("member").over(Window.partitionBy("key").orderBy("pos"))
    above = b.where("parent is not null").select("key", "kind", F.concat("kind", F.lit(":"), "parent").alias("parent_key"))
    parts = {
        "duplicate-boundary": b.groupBy("key").count().where("count > 1").select("key"),
        "unknown-member": member.join(nodes.select(F.col("path").alias("member")), "member", "left_anti").select("key").distinct(),
        "duplicate-member": member.groupBy("key", "member").count().where("count > 1").select("key").distinct(),
        "unordered-members": member.withColumn("before", after).where("before > member").select("key").distinct(),
        "missing-parent": above.join(b.select(F.col("key").alias("parent_key")), "parent_key", "left_anti").select("key"),
        "parent-cycle": endless(above.select("key", F.col("parent_key").alias("up"))),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), F.col("key").alias("subject")) for rule, df in parts.items()])


def boundaries_of(boundaries: DataFrame, path: str) -> DataFrame:
    """All boundaries that contain a node."""
    return boundaries.where(F.array_contains("contained", path)).select("kind", "path")


def clusters_from(boundaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, folder) by the region boundaries, for nodes of the graph."""
    m = boundaries.where("kind = 'region'").select(F.col("path").alias("folder"), F.explode("contained").alias("member"))
    return m.join(nodes.select(F.col("path").alias("member")), "member", "left_semi").select(F.col("member").alias("path"), "folder")


def inferred(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(path, kind, name, origin): a layer and a domain for each file that has one; overrides(path, kind, name) win."""
    p = F.col("path")
    own = files.select("path", F.explode(F.create_map(F.lit("layer"), paths.layer(p), F.lit("domain"), paths.domain(p))).alias("kind", "name")).where("name is not null")
    if overrides is None:
        return own.withColumn("origin", F.lit("heuristic"))
    o = overrides.select("path", "kind", F.col("name").alias("user"))
    both = own.join(o, ["path", "kind"], "full").where(F.coalesce("user", "name").isNotNull())
    return both.select("path", "kind", F.coalesce("user", "name").alias("name"), F.when(F.col("user").isNotNull(), "user-defined").otherwise("heuristic").alias("origin"))


def inference_groups(assigned: DataFrame) -> DataFrame:
    """(kind, name, n_files, origin): user-defined only if every member is."""
    return assigned.groupBy("kind", "name").agg(F.count("*").alias("n_files"), F.when(F.bool_and(F.col("origin") == "user-defined"), "user-defined").otherwise("heuristic").alias("origin"))
