"""Point queries, degrees, hubs, orphans and region roll-ups of a path graph.

nodes(path, ...) and edges(id, src, dst) are plain tables; where they have
repo_id, every operator but the point queries works within each repository. Ids are compared and
ordered by code units; pass ``collation="UNICODE"`` where names are shown to
people and locale order is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.scoped import scope
from weftgraph.plans.fixpoint import ancestor_counts, reachable


def build_graph(files: DataFrame) -> DataFrame:
    """edges(id, src, dst) from files(path, imports): imports of unknown files are dropped; repeated imports and self-loops stay."""
    g = scope(files)
    known = files.select(*g, F.col("path").alias("dst"))
    raw = files.select(*g, F.col("path").alias("src"), F.explode("imports").alias("dst"))
    return raw.join(known, [*g, "dst"], "left_semi").select(*g, F.concat("src", F.lit("->"), "dst").alias("id"), "src", "dst")


def get_node(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == path)


def get_edge(nodes: DataFrame, edges: DataFrame, edge_id: str) -> DataFrame:
    """The edge of this id, unless an end of it is no node."""
    one = edges.where(F.col("id") == edge_id)
    for end in ("src", "dst"):
        one = one.join(nodes.select(F.col("path").alias(end)), end, "left_semi")
    return one.select("id", "src", "dst")


def ordered(df: DataFrame, column: str, collation: str | None) -> DataFrame:
    return df.orderBy(F.expr(f"{column} COLLATE {collation}") if collation else column)


def neighbors(nodes: DataFrame, edges: DataFrame, path: str, direction: str = "outgoing", kinds: list[str] | None = None, collation: str | None = None) -> DataFrame:
    """Distinct adjacent nodes; nothing for an unknown path."""
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(*kinds))
    # both directions from one row: the edges are read once
    out, into = F.when(F.col("src") == path, F.col("dst")), F.when(F.col("dst") == path, F.col("src"))
    wanted = {"outgoing": [out], "incoming": [into], "both": [out, into]}[direction]
    chosen = edges.where(F.coalesce(*wanted).isNotNull()).select(F.explode(F.array(*wanted)).alias("path")).where("path is not null").distinct()
    return ordered(nodes.join(chosen, "path", "left_semi"), "path", collation)


def impact(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(path): all that import the node directly or not, without itself even on a cycle."""
    seeds = nodes.where(F.col("path") == path).select(F.col("path").alias("node"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, seeds).where(F.col("node") != path).select(F.col("node").alias("path"))


def all_impacts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, n_impacted) for every node; see ancestor_counts(), which says for what nodes pairs are kept."""
    known = nodes.select(F.col("path").alias("node")).distinct()
    counts = ancestor_counts(known, edges)
    return known.join(counts, "node", "left").select(F.col("node").alias("path"), F.coalesce("n", F.lit(0).cast("long")).alias("n_impacted"))


def degrees(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, in_degree, out_degree): repeated edges and self-loops count, isolated nodes have zero.

    With ``tasks`` the ends of edges are dealt out to so many tasks, so that what one adds up needn't grow with the graph.
    """
    g = scope(nodes, edges)
    # both ends of an edge from one row: the edges are read once
    end = lambda c, i, o: F.struct(*g, F.col(c).alias("path"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.explode(F.array(end("dst", 1, 0), end("src", 0, 1))).alias("e")).select("e.*")
    if tasks:
        ends = ends.repartition(tasks, *g, "path")
    total = ends.groupBy(*g, "path").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = F.lit(0).cast("long")
    return nodes.select(*g, "path").join(total, [*g, "path"], "left").select(*g, "path", F.coalesce("i", zero).alias("in_degree"), F.coalesce("o", zero).alias("out_degree"))


#: Below this many nodes the hub threshold is fixed, from it on it is the 95th percentile.
SMALL_GRAPH, SMALL_THRESHOLD, PERCENTILE = 20, 15, 0.95


def hubs(degree: DataFrame) -> DataFrame:
    """(path, in_degree) of nodes that very many import: over 15 in a graph of under 20 nodes, else at or above the nearest-rank 95th percentile and above zero."""
    g = scope(degree)
    # degrees are few: counted first, the rank is found among them and no sort holds a whole repository
    counts = degree.groupBy(*g, "in_degree").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*g)
    upto = counts.select(*g, "in_degree", F.sum("m").over(w.orderBy("in_degree")).alias("upto"), F.sum("m").over(w).alias("n"))
    limits = upto.groupBy(*g).agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(PERCENTILE).cast("decimal(4,2)")), F.col("in_degree"))).alias("p"))
    over = F.when(F.col("n") < SMALL_GRAPH, F.col("in_degree") > SMALL_THRESHOLD).otherwise((F.col("in_degree") >= F.col("p")) & (F.col("in_degree") > 0))
    both = degree.join(limits, g) if g else degree.crossJoin(F.broadcast(limits))  # without repo_id limits is one row
    return both.where(over).select(*g, "path", "in_degree")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    g = scope(nodes, edges)
    return nodes.select(*g, "path").join(edges.select(*g, F.col("dst").alias("path")), [*g, "path"], "left_anti")


def region_edges(folders: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(source, target, n_edges) between different folders; folders(path, folder).

    With ``tasks`` the edges between folders are dealt out to so many tasks, so that what one counts needn't grow with the graph.
    """
    g = scope(folders, edges)
    a = folders.select(*g, F.col("path").alias("src"), F.col("folder").alias("source"))
    b = folders.select(*g, F.col("path").alias("dst"), F.col("folder").alias("target"))
    between = edges.join(a, [*g, "src"]).join(b, [*g, "dst"]).where("source <> target").select(*g, "source", "target")
    if tasks:
        between = between.repartition(tasks, *g, "source", "target")
    return between.groupBy(*g, "source", "target").agg(F.count("*").alias("n_edges"))


def stroke_width(n: Column) -> Column:
    return F.least(F.greatest(F.lit(1.25) + F.lit(0.75) * F.log2(F.greatest(F.lit(1), n)), F.lit(1.25)), F.lit(4.5))


def size_share(df: DataFrame, n: str, share: str = "share") -> DataFrame:
    """df with its share of the largest n, which is one row sent to all tasks: a window over everything would be one task."""
    largest = df.agg(F.max(n).alias("largest"))
    return df.crossJoin(F.broadcast(largest)).withColumn(share, F.col(n) / F.col("largest")).drop("largest")


# What a file at the top, and else what a dependency, says about the framework, in order.
CONFIG_SIGNALS = (
    (r"^next\.config\.(js|ts|mjs)$", "Next.js"), (r"^nuxt\.config\.", "Nuxt"), (r"^vite\.config\.(js|ts|mjs)$", "Vite"),
    (r"^remix\.config\.(js|ts)$", "Remix"), (r"^angular\.json$", "Angular"), (r"^svelte\.config\.(js|ts)$", "SvelteKit"),
    (r"^astro\.config\.(mjs|ts)$", "Astro"), (r"^gatsby-config\.(js|ts)$", "Gatsby"),
)
DEPENDENCY_SIGNALS = (
    ("next", "Next.js"), ("nuxt", "Nuxt"), ("@remix-run/react", "Remix"), ("@angular/core", "Angular"), ("svelte", "Svelte"), ("vue", "Vue"),
    ("gatsby", "Gatsby"), ("astro", "Astro"), ("@solidjs/start", "SolidStart"), ("solid-js", "Solid"), ("preact", "Preact"),
)


def framework(top_files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row (framework): of the first config file signal that matches top_files(name), else of the first dependency(name); null if none does."""

    def first(df: DataFrame, rules, matches) -> Column:
        return F.min(F.coalesce(*[F.when(matches(r), F.struct(F.lit(i).alias("prio"), F.lit(f).alias("framework"))) for i, (r, f) in enumerate(rules)]))

    a = top_files.agg(first(top_files, CONFIG_SIGNALS, lambda r: F.col("name").rlike(r)).alias("config"))
    b = dependencies.agg(first(dependencies, DEPENDENCY_SIGNALS, lambda r: F.col("name") == r).alias("dep"))
    return a.crossJoin(b).select(F.coalesce("config.framework", "dep.framework").alias("framework"))  # one row each


def repo_meta(files: DataFrame, folders: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of files, folders and dependencies (all edges), and the main language (Python on a tie, null without files of either)."""
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    n = files.agg(
        F.count("*").alias("n_files"), F.count_if(ext == ".py").alias("py"), F.count_if(ext.isin(".ts", ".tsx", ".mts", ".cts")).alias("ts"), F.count_if(ext.isin(".js", ".jsx", ".mjs", ".cjs")).alias("js")
    )
    top = F.greatest("py", "ts", "js")
    named = n.withColumn("language", F.when(top == 0, None).when(F.col("py") == top, "Python").when(F.col("ts") == top, "TypeScript").otherwise("JavaScript"))
    f, e = folders.agg(F.countDistinct("folder").alias("n_folders")), edges.agg(F.count("*").alias("n_dependencies"))
    return named.crossJoin(f).crossJoin(e).select("n_files", "n_folders", "n_dependencies", "language")  # one row each


def rule_of(reason: Column) -> Column:
    """An entry's reason without what stands in parentheses at its end."""
    return F.regexp_replace(reason, r"\s*\([^()]*\)$", "")


def entry_groups(entries: DataFrame) -> DataFrame:
    """(rule, n_entries, least_path) of entries(path, reason); tests come last, then the most first."""
    g = entries.groupBy(rule_of(F.col("reason")).alias("rule")).agg(F.count("*").alias("n_entries"), F.min("path").alias("least_path"))
    return g.orderBy(F.col("rule") == "test file", F.desc("n_entries"), "rule")


def top_lens(scored: DataFrame, by: str, n: int) -> DataFrame:
    """The first n paths by a measure, ties by path: a top-k report."""
    return scored.orderBy(F.desc(by), "path").limit(n)


def emphasis(entries: DataFrame, unreachable: DataFrame) -> DataFrame:
    """(path, lens): entries that are no tests, and files nothing reaches."""
    a = entries.where(rule_of(F.col("reason")) != "test file").select("path", F.lit("entry").alias("lens"))
    return a.unionByName(unreachable.select("path", F.lit("unreachable").alias("lens")))
