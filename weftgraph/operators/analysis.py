"""Analysis end to end: from the files of many repositories to resolved imports, graphs, errors and observations.

Every text is parsed once, and the result written; resolution is joins of
imports with the listing. All tables have repo_id: repositories with equal
paths don't meet.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators import graph, resolve
from weftgraph.plans.fixpoint import written
from weftgraph.sources import extract, scan

MANIFESTS = ("package.json", "pyproject.toml", "setup.cfg", "go.mod", "tsconfig.json", "jsconfig.json")


@dataclass(frozen=True)
class Analysis:
    """files: path, language, line_count, capabilities and parse errors of each source; imports: each specifier with its target and status;
    declarations; roots: where Python imports begin; nodes and edges: the files without errors and what they import; errors.
    """

    files: DataFrame
    imports: DataFrame
    declarations: DataFrame
    roots: DataFrame
    nodes: DataFrame
    edges: DataFrame
    errors: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def resolved(imports: DataFrame, listing: DataFrame, sources: DataFrame, manifests: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo_id, path, specifier, target, approximate, status) of imports(repo_id, path, language, specifier), each language by its rules."""
    own = lambda language: imports.where(F.col("language") == language).drop("language")
    exact = F.lit(False).alias("approximate")
    columns = ["repo_id", "path", "specifier", "target", "approximate", "status"]
    script = resolve.resolve_typescript(own("typescript"), sources, listing, resolve.aliases(manifests)).withColumn("approximate", exact)
    python = resolve.resolve_python(own("python"), resolve.python_modules(listing, roots), roots).withColumn("approximate", exact)
    module = resolve.go_module(manifests.where(F.col("path") == "go.mod")).select("repo_id", "module")
    go = resolve.resolve_go(own("go"), resolve.go_packages(sources, module), module)
    # each language's rows are written by a job of its own: one plan of all three is too large for a small driver
    return reduce(DataFrame.unionByName, [written(x.select(*columns)) for x in (script, python, go)])


def analyze(contents: DataFrame, configs: DataFrame | None = None) -> Analysis:
    """The tables of contents(repo_id, path, content), which has every file; null is the content of one that couldn't be read.

    Files in excluded folders are listed, so that imports of them are told from typing errors, but not parsed. A file
    with an error has no imports and is no node.
    """
    listing = written(contents.select("repo_id", "path"))
    manifests = written(contents.where(paths.name_of(F.col("path")).isin(*MANIFESTS)))
    chosen = scan.sources(listing, configs=manifests if configs is None else configs)
    sources = written(chosen.select("repo_id", "path"))
    parsed = written(extract.parsed(contents.join(sources, ["repo_id", "path"], "left_semi")))
    roots = written(resolve.import_roots(listing, manifests))
    sound = parsed.where(F.size("errors") == 0)
    imports = sound.select("repo_id", "path", "language", F.explode("imports.specifier").alias("specifier")).distinct()
    found = resolved(written(imports), listing, sources, manifests, roots)
    nodes = sound.select("repo_id", "path", "language", "line_count")
    reached = found.where("status = 'internal'").select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst"), "approximate")
    known = nodes.select("repo_id", F.col("path").alias("dst"))
    edges = reached.join(known, ["repo_id", "dst"], "left_semi").groupBy("repo_id", "src", "dst").agg(F.bool_and("approximate").alias("approximate"))
    return Analysis(
        files=parsed.select("repo_id", "path", "language", "line_count", F.size("errors").alias("n_errors"), F.when(F.exists("errors", lambda e: e["reason"] == "unreadable"), F.array().cast("array<string>")).otherwise(F.array(F.lit("imports"), F.lit("declarations"))).alias("capabilities")),
        imports=found,
        declarations=parsed.select("repo_id", "path", F.explode("declarations").alias("d")).select("repo_id", "path", "d.*"),
        roots=roots,
        nodes=nodes,
        edges=written(edges.select("repo_id", F.concat("src", F.lit("->"), "dst").alias("id"), "src", "dst", "approximate")),
        errors=parsed.select("repo_id", "path", F.explode("errors").alias("e")).select("repo_id", "path", "e.*"),
    )


def observations(a: Analysis) -> DataFrame:
    """(repo_id, path, in_degree, out_degree, is_hub, is_orphan) of every node, within its repository."""
    degree = graph.degrees(a.nodes, a.edges)
    hub = graph.hubs(degree).select("repo_id", "path", F.lit(True).alias("is_hub"))
    return degree.join(hub, ["repo_id", "path"], "left").select("repo_id", "path", "in_degree", "out_degree", F.coalesce("is_hub", F.lit(False)).alias("is_hub"), (F.col("in_degree") == 0).alias("is_orphan"))
