"""Reachability from entry points, what nothing reaches, and caveats; with repo_id, within each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators.scoped import node_of, scope
from weftgraph.plans.fixpoint import reachable


def implied_edges(nodes: DataFrame) -> DataFrame:
    """Edges that languages imply: reaching a Go file reaches its directory's files, reaching a Python file the
    ``__init__.py`` of its own and every directory above.

    A Go directory is a node of its own ("dir:...") between its files: a star, not all pairs.
    """
    g = scope(nodes)
    p = F.col("path")
    go = nodes.where(p.endswith(".go")).select(*g, p, F.concat(F.lit("dir:"), paths.directory(p)).alias("dir"))
    star = go.select(*g, p.alias("src"), F.col("dir").alias("dst")).unionByName(go.select(*g, F.col("dir").alias("src"), p.alias("dst")))
    inits = nodes.where(paths.name_of(p) == "__init__.py").select(*g, p.alias("dst"))
    above = F.transform(F.concat(F.array(F.lit("")), paths.ancestors(p)), lambda d: F.when(d == "", "__init__.py").otherwise(F.concat(d, F.lit("/__init__.py"))))
    py = nodes.where(p.endswith(".py")).select(*g, p.alias("src"), F.explode(above).alias("dst")).join(inits, [*g, "dst"], "left_semi").where("src <> dst")
    return star.unionByName(py.select(*g, "src", "dst"))


def reached(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(path) of nodes that an entry leads to; entries that are no nodes count for nothing."""
    g = scope(nodes, edges, entries)
    known = entries.join(nodes.select(*g, "path"), [*g, "path"], "left_semi").select(node_of(g, F.col("path")).alias("node"))
    # one label for all seeds: which entry reaches a node doesn't matter
    every = edges.select(*g, "src", "dst").unionByName(implied_edges(nodes)).select(node_of(g, F.col("src")).alias("src"), node_of(g, F.col("dst")).alias("dst"))
    start = known.select(F.lit("").alias("src"), F.col("node").alias("dst"))
    root = nodes.sparkSession.createDataFrame([("",)], "node string")
    seen = reachable(every.unionByName(start), root)
    named = nodes.select(*g, "path").withColumn("node", node_of(g, F.col("path")))
    return named.join(seen.select("node"), "node", "left_semi").select(*g, "path")


def unreachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame, skipped_roots: DataFrame | None = None) -> DataFrame:
    """(path) of nodes that no entry leads to, without declaration files and files under skipped roots; nothing at all without an entry."""
    g = scope(nodes, edges, entries, skipped_roots)
    known = entries.join(nodes.select(*g, "path"), [*g, "path"], "left_semi")
    left = nodes.select(*g, "path").join(reached(nodes, edges, entries), [*g, "path"], "left_anti").where(~paths.is_declaration(F.col("path")))
    if skipped_roots is not None:
        below = left.select(*g, "path", F.explode(paths.ancestors(F.col("path"))).alias("root")).join(skipped_roots.select(*g, "root"), [*g, "root"], "left_semi")
        left = left.join(below.select(*g, "path").distinct(), [*g, "path"], "left_anti")
    if g:
        return left.join(known.select(*g).distinct(), g, "left_semi")
    return left.join(known.select(F.lit(True).alias("any_entry")).limit(1), F.lit(True), "left_semi")


def caveats(unreachable_count: int, dynamic_files: int, unresolved: int, frameworks: list[tuple[str, str]], wildcard_exports: list[tuple[str, str]]) -> list[str]:
    """What could hide a path to a listed file (only if files are listed), and roots that are skipped. frameworks are (name, root)."""
    out = []
    if unreachable_count:
        if dynamic_files:
            out.append(f"{dynamic_files} {'file computes' if dynamic_files == 1 else 'files compute'} the target of an import at run time; listed files may be loaded that way.")
        if unresolved:
            out.append(f"{unresolved} internal {'import has' if unresolved == 1 else 'imports have'} no file as target; a path may be missing.")
        if here := [name for name, root in frameworks if not root]:
            out.append(f"The conventions of {', '.join(here)} are not known; files loaded by convention may be listed.")
        out += [f'The export "{key}" exposes {target}; listed files that match it may be public.' for key, target in wildcard_exports]
    out += [f"{root}/ uses {name}, whose conventions are not known; its files are not reported." for name, root in frameworks if root]
    return out


def describe(entries: DataFrame, dead: DataFrame, path: str) -> DataFrame:
    """(path, role, reason): entry, unreachable, or no row."""
    a = entries.where(F.col("path") == path).select("path", F.lit("entry").alias("role"), "reason")
    b = dead.where(F.col("path") == path).select("path", F.lit("unreachable").alias("role"), F.lit(None).cast("string").alias("reason"))
    return a.unionByName(b.join(a, "path", "left_anti"))
