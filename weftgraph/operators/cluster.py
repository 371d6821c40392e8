"""Folder clusters and the folder tree; with repo_id, within each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators.scoped import scope
from weftgraph.plans.fixpoint import written

#: A region splits above so many files, into sub-folders of at least so many, at most so deep (fixed values).
MAX_REGION, MIN_REGION, MAX_DEPTH = 30, 3, 3


def proposed(files: DataFrame) -> DataFrame:
    return files.select(*scope(files), "path", paths.proposed_folder(F.col("path")).alias("folder"))


def merge_small(clusters: DataFrame) -> DataFrame:
    """Folders of under three files become ``other``. Folders are counted and joined, so no folder lies in one task whole."""
    g = scope(clusters)
    small = clusters.groupBy(*g, "folder").agg(F.count("*").alias("n")).where(F.col("n") < MIN_REGION).select(*g, "folder", F.lit(True).alias("small"))
    return clusters.join(small, [*g, "folder"], "left").select(*g, "path", F.when(F.col("small"), "other").otherwise(F.col("folder")).alias("folder"))


def legacy_clusters(files: DataFrame) -> DataFrame:
    return merge_small(proposed(files))


def folder_tree(files: DataFrame) -> DataFrame:
    """(path, parent, depth, own_files, all_files, children, shown): every folder; shown is the folder that a chain of
    folders with nothing else in them ends in (a folder without files of its own and with one child merges into it)."""
    g = scope(files)
    pairs = files.select(*g, F.col("path").alias("file"), F.explode(paths.ancestors(F.col("path"))).alias("folder"))
    total = pairs.groupBy(*g, "folder").agg(F.count("*").alias("all_files"), F.count_if(paths.directory(F.col("file")) == F.col("folder")).alias("own_files"))
    total = total.withColumn("parent", F.when(F.col("folder").contains("/"), paths.directory(F.col("folder"))).otherwise(""))
    kids = total.groupBy(*g, "parent").agg(F.count("*").alias("children")).withColumnRenamed("parent", "folder")
    flat = total.join(kids, [*g, "folder"], "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    flat = flat.withColumn("merges", (F.col("own_files") == 0) & (F.col("children") == 1))
    # the nearest folder at or below that doesn't merge: below a chain there is one line of folders only
    ends = flat.where("not merges").select(*g, F.col("folder").alias("end"), F.explode(F.concat(paths.ancestors(F.col("folder")), F.array("folder"))).alias("folder"))
    shown = ends.groupBy(*g, "folder").agg(F.min_by("end", F.size(F.split("end", "/"))).alias("shown"))
    depth = F.size(F.split("folder", "/"))
    return flat.join(shown, [*g, "folder"]).select(*g, F.col("folder").alias("path"), "parent", depth.cast("long").alias("depth"), "own_files", "all_files", "children", F.when(F.col("merges"), F.col("shown")).otherwise(F.col("folder")).alias("shown"))


def split_once(clusters: DataFrame) -> DataFrame:
    """Regions of more than thirty files, split into their own sub-folders of at least three where two or more qualify.

    clusters(path, folder, place): place is the folder that the region's files lie in. Chains of folders that hold
    nothing else are passed through first.
    """
    g = scope(clusters)
    inside = F.expr("substring(path, length(place) + 2)")
    deep = clusters.withColumn("rest", F.when(F.col("path").startswith(F.concat("place", F.lit("/"))), inside))
    child = F.when(F.col("rest").contains("/"), F.concat("place", F.lit("/"), F.element_at(F.split("rest", "/"), 1)))
    sized = deep.withColumn("child", child)
    large = sized.groupBy(*g, "folder").agg(F.count("*").alias("n")).where(F.col("n") > MAX_REGION).select(*g, "folder")
    fit = sized.where("child is not null").groupBy(*g, "folder", "child").agg(F.count("*").alias("m")).where(F.col("m") >= MIN_REGION)
    several = fit.groupBy(*g, "folder").agg(F.count("*").alias("q")).where("q >= 2").select(*g, "folder")
    leave = fit.join(large, [*g, "folder"], "left_semi").join(several, [*g, "folder"], "left_semi").select(*g, "folder", "child", F.lit(True).alias("leaves"))
    out = sized.join(leave, [*g, "folder", "child"], "left").withColumn("goes", F.coalesce("leaves", F.lit(False)))
    return out.select(*g, "path", F.when(F.col("goes"), F.col("child")).otherwise(F.col("folder")).alias("folder"), F.when(F.col("goes"), F.col("child")).otherwise(F.col("place")).alias("place"), "goes")


def sink_chains(clusters: DataFrame, tree: DataFrame) -> DataFrame:
    """place moves down chains; a region that was split off is named by where its chain ends."""
    g = scope(clusters, tree)
    ends = tree.select(*g, F.col("path").alias("place"), "shown")
    moved = clusters.join(ends, [*g, "place"], "left").withColumn("end", F.coalesce("shown", "place"))
    return moved.select(*g, "path", F.when(F.col("goes"), F.col("end")).otherwise(F.col("folder")).alias("folder"), F.col("end").alias("place"), "goes")


def adaptive_clusters(files: DataFrame) -> DataFrame:
    """(path, folder): proposed folders, small ones merged, large ones split up to three deep."""
    g = scope(files)
    tree = written(folder_tree(files).select(*g, "path", "shown"))
    at = merge_small(proposed(files)).withColumn("place", F.col("folder")).withColumn("goes", F.lit(False))
    for _ in range(MAX_DEPTH):
        at = written(sink_chains(split_once(sink_chains(at, tree)), tree))
    return at.select(*g, "path", "folder")


def apply_clusters(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    g = scope(nodes, clusters)
    return nodes.join(clusters.select(*g, "path", "folder"), [*g, "path"], "left").withColumn("folder", F.coalesce("folder", F.lit("other")))


def find_folder(tree: DataFrame, name: str) -> DataFrame:
    """The tree's row of this folder, or the one that its chain ends in."""
    end = tree.where(F.col("path") == name).select(F.col("shown").alias("path"))
    return tree.join(end, "path", "left_semi")
