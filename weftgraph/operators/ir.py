"""The provenance-carrying graph: nodes of four kinds, contains and imports edges, and their validation.

Nodes and edges carry provenance as (origin, derived_from). Nothing rests on
better grounds than what it is made from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import identity, paths

NODE_KINDS = ("file", "module-root", "external-dependency", "unresolved-import")
EDGE_KINDS = ("contains", "imports")
ORIGINS = ("verified", "derived", "heuristic", "unknown", "assisted", "user-defined")


def build(extractions: DataFrame, manifest: str = "package.json", root_confidence: str = "verified") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one repository from extractions(path, line_count, errors, imports, approximate, externals, unresolved).

    nodes(id, kind, path, name, line_count, confidence, origin, root_id), edges(id, kind, src, dst, origin).
    imports, approximate (a subset of imports, targets that stand for more), externals and unresolved are arrays.
    """
    fp = identity.derive(f":{manifest}")
    root = identity.derive(f"root:{fp}")
    x = extractions.withColumn("origin", F.when(F.coalesce(F.col("errors"), F.lit(0)) > 0, "heuristic").otherwise("verified"))
    ids = x.select("path", identity.file_id(F.lit(fp), F.col("path")).alias("file_id"), "origin", "line_count", "imports", "approximate", "externals", "unresolved")
    null = F.lit(None).cast("string")
    files = ids.select(
        F.col("file_id").alias("id"), F.lit("file").alias("kind"), "path", paths.name_of(F.col("path")).alias("name"), F.col("line_count").cast("long").alias("line_count"),
        F.when(F.col("origin") == "verified", "precise").otherwise("heuristic").alias("confidence"), "origin", F.lit(root).alias("root_id"),
    )
    spark = extractions.sparkSession
    roots = spark.range(1).select(F.lit(root).alias("id"), F.lit("module-root").alias("kind"), F.lit("").alias("path"), F.lit(manifest).alias("name"), F.lit(None).cast("long").alias("line_count"), F.lit("precise" if root_confidence == "verified" else "heuristic").alias("confidence"), F.lit(root_confidence).alias("origin"), F.lit(root).alias("root_id"))
    ext = ids.select("file_id", "origin", F.explode("externals").alias("name")).distinct()
    ext = ext.withColumn("id", identity.external_id(F.lit(fp), F.col("name")))
    ext_nodes = ext.select("id", "name").distinct().select("id", F.lit("external-dependency").alias("kind"), null.alias("path"), "name", F.lit(None).cast("long").alias("line_count"), F.lit("precise").alias("confidence"), F.lit("verified").alias("origin"), F.lit(root).alias("root_id"))
    un = ids.select("file_id", "origin", F.explode("unresolved").alias("name")).distinct()
    un = un.withColumn("id", identity.unresolved_id(F.lit(fp), F.col("file_id"), F.col("name")))
    un_nodes = un.select("id", F.lit("unresolved-import").alias("kind"), null.alias("path"), "name", F.lit(None).cast("long").alias("line_count"), F.lit("precise").alias("confidence"), F.lit("verified").alias("origin"), F.lit(root).alias("root_id"))
    target = ids.select(F.col("path").alias("to_path"), F.col("file_id").alias("dst"))
    imp = ids.select(F.col("file_id").alias("src"), "origin", F.coalesce("approximate", F.array().cast("array<string>")).alias("approximate"), F.explode("imports").alias("to_path")).distinct()
    imp = imp.join(target, "to_path").select("src", "dst", F.when((F.col("origin") == "heuristic") | F.array_contains("approximate", F.col("to_path")), "heuristic").otherwise("derived").alias("origin"))
    imp = imp.groupBy("src", "dst").agg(F.max("origin").alias("origin"))
    loose = [d.select(F.col("file_id").alias("src"), F.col("id").alias("dst"), F.when(F.col("origin") == "heuristic", "heuristic").otherwise("derived").alias("origin")) for d in (ext, un)]
    imports = reduce(DataFrame.unionByName, [imp.select("src", "dst", "origin"), *loose]).withColumn("kind", F.lit("imports"))
    contains = ids.select(F.lit(root).alias("src"), F.col("file_id").alias("dst"), F.lit("derived").alias("origin"), F.lit("contains").alias("kind"))
    edges = imports.unionByName(contains).select(identity.edge_id(F.col("src"), F.col("kind"), F.col("dst")).alias("id"), "kind", "src", "dst", "origin")
    return reduce(DataFrame.unionByName, [roots, files, ext_nodes, un_nodes]), edges


def symbol_ordinals(symbols: DataFrame) -> DataFrame:
    """symbols(path, kind, qualified_name, pos) with ``ordinal``: how many of the same kind and name come before."""
    w = Window.partitionBy("path", "kind", "qualified_name").orderBy("pos")
    return symbols.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def declaration_violations(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, subject): symbols(path, name, start_line, start_col, end_line, end_col, nth) with positions that can't be."""
    s = symbols.join(files.select("path", "line_count"), "path")
    before = F.lag(F.struct("start_line", "start_col")).over(Window.partitionBy("path").orderBy("nth"))
    s = s.withColumn("before", before)
    rules = {
        "position-not-positive": (F.least("start_line", "start_col", "end_line", "end_col") < 1),
        "end-before-start": F.struct("end_line", "end_col") < F.struct("start_line", "start_col"),
        "end-after-file": F.col("end_line") > F.col("line_count"),
        "out-of-order": F.struct("start_line", "start_col") < F.col("before"),
    }
    return reduce(DataFrame.unionByName, [s.where(c).select(F.lit(r).alias("rule"), F.concat("path", F.lit("#"), "name").alias("subject")) for r, c in rules.items()])


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, subject): all breaches of the referential rules; a graph is valid if there is none."""
    kind = nodes.select("id", "kind")
    a, b = kind.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), kind.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    typed = edges.join(a, "src").join(b, "dst")
    roots = nodes.where("kind = 'module-root'").select(F.col("id").alias("root_id"))

    def repeated(df: DataFrame) -> DataFrame:
        return df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("subject"))

    parts = {
        "duplicate-node": repeated(nodes), "duplicate-edge": repeated(edges),
        "dangling-source": edges.join(a, "src", "left_anti").select(F.col("id").alias("subject")),
        "dangling-target": edges.join(b, "dst", "left_anti").select(F.col("id").alias("subject")),
        "unknown-root": nodes.join(roots, "root_id", "left_anti").select(F.col("id").alias("subject")),
        "contains-kinds": typed.where("kind = 'contains' and not (src_kind = 'module-root' and dst_kind = 'file')").select(F.col("id").alias("subject")),
        "imports-kinds": typed.where("kind = 'imports' and not (src_kind = 'file' and dst_kind in ('file', 'external-dependency', 'unresolved-import'))").select(F.col("id").alias("subject")),
        "unknown-kind": nodes.where(~F.col("kind").isin(*NODE_KINDS)).select(F.col("id").alias("subject")),
        "unknown-edge-kind": edges.where(~F.col("kind").isin(*EDGE_KINDS)).select(F.col("id").alias("subject")),
        "unknown-origin": nodes.where(~F.col("origin").isin(*ORIGINS)).select(F.col("id").alias("subject")),
        "negative-lines": nodes.where("line_count < 0").select(F.col("id").alias("subject")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(r).alias("rule"), "subject") for r, df in parts.items()])


def path_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(path), edges(src, dst)) of files and the imports between them."""
    f = nodes.where("kind = 'file'").select("id", "path")
    a, b = f.select(F.col("id").alias("src"), F.col("path").alias("from_path")), f.select(F.col("id").alias("dst"), F.col("path").alias("to_path"))
    e = edges.where("kind = 'imports'").join(a, "src").join(b, "dst")
    return f.select("path"), e.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))


def root_confidence(files: DataFrame, structural_python: bool = False, structural_go: bool = False) -> DataFrame:
    """One row (origin): heuristic if a guessed layout applies to files of its language, else verified."""
    py, go = F.bool_or(F.col("path").endswith(".py")), F.bool_or(F.col("path").endswith(".go"))
    guess = (F.lit(structural_python) & F.coalesce(py, F.lit(False))) | (F.lit(structural_go) & F.coalesce(go, F.lit(False)))
    return files.agg(F.when(guess, "heuristic").otherwise("verified").alias("origin"))
