"""Search items and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths, texts


def search_items(degree: DataFrame, symbols: DataFrame | None = None, externals: DataFrame | None = None) -> DataFrame:
    """(id, label, context, kind, weight): files by name, symbols(path, name), and a row for each package and file that imports it (path, name)."""
    p = F.col("path")
    files = degree.select(F.col("path").alias("id"), paths.name_of(p).alias("label"), paths.directory(p).alias("context"), F.lit("file").alias("kind"), F.col("in_degree").alias("weight"))
    out = files
    if symbols is not None:
        s = symbols.join(degree, "path").select(F.concat("path", F.lit("#"), "name").alias("id"), F.col("name").alias("label"), F.col("path").alias("context"), F.lit("symbol").alias("kind"), F.col("in_degree").alias("weight"))
        out = out.unionByName(s)
    if externals is not None:
        e = externals.select(F.concat("name", F.lit("@"), "path").alias("id"), F.col("name").alias("label"), F.col("path").alias("context"), F.lit("package").alias("kind"), F.lit(0).cast("long").alias("weight"))
        out = out.unionByName(e.distinct())
    return out


def rank(items: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, label, kind, score, weight, total): best score, weight, label first; total counts matches before the limit.

    An empty query ranks all but symbols by weight, and total counts symbols too. A top-k report.
    """
    query = query.strip()
    if not query:
        total = items.agg(F.count("*").alias("total"))
        scored = items.where("kind <> 'symbol'").withColumn("score", F.lit(0))
    else:
        scored = items.withColumn("score", texts.score(F.col("label"), F.col("context"), query)).where("score is not null")
        total = scored.agg(F.count("*").alias("total"))
    top = scored.orderBy(F.desc("score"), F.desc("weight"), "label", "id").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("id", "label", "kind", F.col("score").cast("long").alias("score"), "weight", "total")  # total is one row
