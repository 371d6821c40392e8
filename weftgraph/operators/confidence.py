"""How well things are known, by path and edge, and the node and edge tables of views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_path(files: DataFrame, errors: DataFrame) -> DataFrame:
    """(path, confidence): heuristic for files with parse errors, else verified."""
    bad = errors.select("path").distinct().withColumn("bad", F.lit(True))
    return files.select("path").join(bad, "path", "left").select("path", F.when(F.col("bad"), "heuristic").otherwise("verified").alias("confidence"))


def edge_confidence(edges: DataFrame, known: DataFrame) -> DataFrame:
    k = known.select(F.col("path").alias("src"), "confidence")
    return edges.join(k, "src", "left").withColumn("confidence", F.when(F.col("confidence") == "heuristic", "heuristic").otherwise("derived"))


def unresolved_by_file(unresolved: DataFrame) -> DataFrame:
    """(path, n_unresolved, specifiers) of unresolved(path, specifier)."""
    return unresolved.groupBy("path").agg(F.countDistinct("specifier").alias("n_unresolved"), F.array_join(F.sort_array(F.collect_set("specifier")), " ").alias("specifiers"))


def reduced_by_region(clusters: DataFrame, known: DataFrame) -> DataFrame:
    return clusters.join(known, "path").groupBy("folder").agg(F.count_if(F.col("confidence") != "verified").alias("n_reduced"))


def with_folders(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    a, b = clusters.select(F.col("path").alias("src"), F.col("folder").alias("src_folder")), clusters.select(F.col("path").alias("dst"), F.col("folder").alias("dst_folder"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "src_folder", "dst_folder")


def folder_edges(edges: DataFrame, clusters: DataFrame, tasks: int | None = None) -> DataFrame:
    """(src_folder, dst_folder) that an edge joins; with ``tasks`` edges are dealt out to so many, so that what one holds needn't grow with the graph."""
    between = with_folders(edges, clusters).where("src_folder <> dst_folder").select("src_folder", "dst_folder")
    return (between.repartition(tasks, "src_folder", "dst_folder") if tasks else between).distinct()


def interior_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    return with_folders(edges, clusters).where("src_folder = dst_folder").select(F.col("src_folder").alias("folder"), "src", "dst")


def boundary_stubs(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(region, path, direction, neighbour): one for each file of a region and neighbouring region on an edge out of or into it."""
    e = with_folders(edges, clusters).where("src_folder <> dst_folder")
    out = e.select(F.col("src_folder").alias("region"), F.col("src").alias("path"), F.lit("out").alias("direction"), F.col("dst_folder").alias("neighbour"))
    into = e.select(F.col("dst_folder").alias("region"), F.col("dst").alias("path"), F.lit("in").alias("direction"), F.col("src_folder").alias("neighbour"))
    return out.unionByName(into).distinct()


def grid(nodes: DataFrame, order: str, columns: int = 4, width: int = 260, height: int = 140) -> DataFrame:
    """(…, x, y) in rows of four: the layout without a layout engine. The nodes of one figure."""
    from pyspark.sql import Window

    rk = F.row_number().over(Window.orderBy(order)) - 1
    return nodes.withColumn("x", (rk % columns * width).cast("long")).withColumn("y", (F.floor(rk / columns) * height).cast("long"))


#: What a parse error means for a file, by its severity and reason (fixed values).
SCOPES = {"fatal": "No imports could be read from this file", "partial": "Some imports may be missing"}
CAUSES = {"syntax": "the file has a syntax error.", "timeout": "the file took too long to analyse.", "unreadable": "the file could not be read as source text."}
OTHER_CAUSE = "the file could not be fully analysed."


def file_evidence(files: DataFrame, errors: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(path, confidence, reduced_because, unresolved, derived_from) of every file of files(path, origin, derived_from).

    errors(path, severity, reason, nth) say why a file is known less well, in their order; unresolved(path, specifier).
    """
    scope = F.when(F.col("severity") == "fatal", SCOPES["fatal"]).otherwise(SCOPES["partial"])
    cause = F.coalesce(F.create_map(*[F.lit(x) for kv in CAUSES.items() for x in kv])[F.col("reason")], F.lit(OTHER_CAUSE))
    why = errors.select("path", F.struct("nth", F.concat(scope, F.lit(" — "), cause).alias("text")).alias("e"))
    why = why.groupBy("path").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["text"]).alias("reduced_because"))
    loose = unresolved.groupBy("path").agg(F.sort_array(F.collect_set("specifier")).alias("unresolved"))
    none = F.array().cast("array<string>")
    out = files.join(why, "path", "left").join(loose, "path", "left")
    known = F.when(F.col("origin") == "heuristic", "heuristic").otherwise("verified")
    return out.select("path", known.alias("confidence"), F.coalesce("reduced_because", none).alias("reduced_because"), F.coalesce("unresolved", none).alias("unresolved"), F.size("derived_from").alias("derived_from"))


def unresolved_stubs(unresolved: DataFrame) -> DataFrame:
    """(id, path, specifier, confidence): one node for each file and specifier, and the edge to it, of which nothing is known."""
    return unresolved.select("path", "specifier").distinct().select(F.concat("path", F.lit("->?"), "specifier").alias("id"), "path", "specifier", F.lit("unknown").alias("confidence"))
