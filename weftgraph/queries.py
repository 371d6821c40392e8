"""Queries over the driver tables and the SQL that gives the same rows: name -> f(spark, sf_dir), name -> SQL.

Iterative operators, user functions and streaming have no SQL; tests hold them against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import adapters as ad
from weftgraph.functions import identity, measures, paths, texts
from weftgraph.operators import analysis, boundaries, cluster, confidence, cycles, diagram, entrypoints, evidence, extractions as extracted, graph, ir, reach, resolve, search, tour
from weftgraph.plans import fixpoint
from weftgraph.sources import extract, scan, store
from weftgraph.streaming import limits, retention

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def trade(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return ad.trade_nodes(s, d), ad.trade_edges(s, d)


def chains(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # dealt out by path once more: the joins on paths take over the number of tasks
    nodes = ad.order_nodes(s, d).select("path", "line_count")
    return nodes.repartition(ad.order_tasks(s, d), "path"), ad.order_edges(s, d)


def by_form(table: DataFrame, key: str, forms: tuple[str, ...]) -> DataFrame:
    """(path): for each row the form that its key's remainder names, with the key in it."""
    each = F.array(*[F.format_string(x, key) for x in forms])
    return table.select(F.element_at(each, (F.col(key) % len(forms) + 1).cast("int")).alias("path"))


def regions(nodes: DataFrame) -> DataFrame:
    """Nations lie in their region's folder."""
    return nodes.select("path", paths.directory(F.col("path")).alias("folder"))


O, T, FS, PE = f"WITH RECURSIVE {ad.ORDERS}", f"WITH RECURSIVE {ad.TRADE}", f"WITH {ad.FILES}", f"WITH {ad.PART_EDGES}"
DEG = """, deg AS (SELECT path, (SELECT count(*) FROM edges WHERE dst = path) AS in_degree, (SELECT count(*) FROM edges WHERE src = path) AS out_degree FROM nodes)"""
FOLD = """, fold AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS folder FROM nodes)"""
ASIA = "ASIA/NATION_17"
FIRST = "(SELECT min(path) FROM nodes)"


def first_path(nodes: DataFrame) -> str:
    return nodes.agg(F.min("path")).first()[0]


# --- graph --------------------------------------------------------------------------------------------------


@query(O + " SELECT id, src, dst FROM edges")
def g1_build_graph(s, d):
    nodes, edges = chains(s, d)
    extra = F.array(F.lit("nowhere"))
    files = nodes.join(edges.groupBy(F.col("src").alias("path")).agg(F.collect_list("dst").alias("own")), "path", "left")
    return graph.build_graph(files.select("path", F.concat(F.coalesce("own", F.array().cast("array<string>")), extra).alias("imports")))


@query(O + " SELECT path, line_count FROM nodes WHERE path = 'lib/BUILDING.ts'")
def g2_get_node(s, d):
    return graph.get_node(ad.order_nodes(s, d).select("path", "line_count"), "lib/BUILDING.ts")


@query(O + " SELECT id, src, dst FROM edges WHERE id = (SELECT min(id) FROM edges)")
def g3_get_edge(s, d):
    nodes, edges = chains(s, d)
    return graph.get_edge(nodes, edges, edges.agg(F.min("id")).first()[0])


@query(O + f" SELECT path, line_count FROM nodes WHERE path IN (SELECT dst FROM edges WHERE src = {FIRST} UNION SELECT src FROM edges WHERE dst = {FIRST})")
def g4_neighbors(s, d):
    nodes, edges = chains(s, d)
    return graph.neighbors(nodes, edges, first_path(nodes), "both")


REACH_ALL = ", back AS (SELECT path AS seed, path AS node FROM nodes UNION SELECT seed, src FROM back JOIN edges ON dst = node)"


@query(O + REACH_ALL + f" SELECT node AS path FROM back WHERE seed = (SELECT dst FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) AND node <> seed")
def g5_impact(s, d):
    nodes, edges = chains(s, d)
    top = edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()["dst"]
    return graph.impact(nodes, edges, top)


@query(O + REACH_ALL + " SELECT seed AS path, count(*) - 1 AS n_impacted FROM back GROUP BY seed")
def g5_all_impacts(s, d):
    return graph.all_impacts(*chains(s, d))


@query()
def g6_find_cycles(s, d):
    nodes, edges = trade(s, d)
    one = F.lit("trade").alias("repo_id")
    return cycles.find_cycles(nodes.select(one, "path"), edges.select(one, "src", "dst"))


SCC = ", fwd AS (SELECT path AS a, path AS b FROM nodes UNION SELECT a, dst FROM fwd JOIN edges ON src = b), scc AS (SELECT x.a AS node, min(x.b) AS component FROM fwd x JOIN fwd y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query(O + SCC + " SELECT node, component FROM scc")
def g7_strong_components(s, d):
    nodes, edges = chains(s, d)
    return fixpoint.strong_components(nodes.select(F.col("path").alias("node")), edges)


@query(T + ", sym AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), und AS (SELECT path AS a, path AS b FROM nodes UNION SELECT a, dst FROM und JOIN sym ON src = b) SELECT a AS node, min(b) AS component FROM und GROUP BY a")
def g7_components(s, d):
    nodes, edges = trade(s, d)
    return fixpoint.components(nodes.select(F.col("path").alias("node")), edges)


@query(O + " SELECT e.src AS a, e.dst AS b, CASE WHEN e.src < e.dst THEN e.src || '|' || e.dst ELSE e.dst || '|' || e.src END AS form FROM edges e JOIN edges f ON e.src = f.dst AND e.dst = f.src")
def g8_canonical_cycles(s, d):
    _, edges = chains(s, d)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    form = F.replace(cycles.canonical(F.array("src", "dst")), F.lit("\x00"), F.lit("|"))
    return edges.join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"), form.alias("form"))


# --- observations -------------------------------------------------------------------------------------------


@query(O + DEG + " SELECT path, in_degree, out_degree FROM deg")
def a1_degrees(s, d):
    return graph.degrees(*chains(s, d), ad.order_tasks(s, d))


@query(O + DEG + " SELECT path, in_degree FROM deg, (SELECT quantile_disc(in_degree, 0.95) AS p FROM deg) WHERE in_degree >= p AND in_degree > 0")
def a2_hubs(s, d):
    return graph.hubs(graph.degrees(*chains(s, d), ad.order_tasks(s, d)))


PDEG = ", pdeg AS (SELECT p.path, count(e.src) AS in_degree FROM parts p LEFT JOIN pedges e ON e.dst = p.path GROUP BY p.path)"


@query(PE + PDEG + " SELECT path, in_degree FROM pdeg, (SELECT quantile_disc(in_degree, 0.95) AS p FROM pdeg) WHERE in_degree >= p AND in_degree > 0")
def a2_part_hubs(s, d):
    return graph.hubs(graph.degrees(ad.part_files(s, d), ad.part_edges(s, d)))


@query(PE + " SELECT path FROM parts WHERE path NOT IN (SELECT dst FROM pedges)")
def a3_orphans(s, d):
    return graph.orphans(ad.part_files(s, d), ad.part_edges(s, d))


RE = ", ends AS MATERIALIZED (SELECT a.folder AS source, b.folder AS target FROM edges JOIN fold a ON src = a.path JOIN fold b ON dst = b.path), re AS (SELECT source, target, count(*) AS n_edges FROM ends WHERE source <> target GROUP BY 1, 2)"


@query(O + FOLD + RE + " SELECT source, target, n_edges FROM re")
def a5_region_edges(s, d):
    nodes, edges = chains(s, d)
    return graph.region_edges(regions(nodes), edges, ad.order_tasks(s, d))


@query(O + FOLD + RE + " SELECT source, target, round(least(greatest(1.25 + 0.75 * log2(greatest(1, n_edges)), 1.25), 4.5), 6) AS width, round(n_edges / (max(n_edges) OVER ())::DOUBLE, 6) AS share FROM re")
def a6_stroke_and_share(s, d):
    nodes, edges = chains(s, d)
    r = graph.size_share(graph.region_edges(regions(nodes), edges, ad.order_tasks(s, d)), "n_edges")
    return r.select("source", "target", F.round(graph.stroke_width(F.col("n_edges")), 6).alias("width"), F.round("share", 6).alias("share"))


@query(f"WITH {ad.PART_EDGES} SELECT count(*) AS n_files, (SELECT count(DISTINCT regexp_replace(path, '/?[^/]*$', '')) FROM parts) AS n_folders, (SELECT count(*) FROM pedges) AS n_dependencies, 'TypeScript' AS language FROM parts")
def a7_repo_meta(s, d):
    f = ad.part_files(s, d)
    return graph.repo_meta(f, f.select(paths.directory(F.col("path")).alias("folder")), ad.part_edges(s, d))


@query("SELECT CASE WHEN count(*) > 0 THEN 'Nuxt' END AS framework FROM nation WHERE n_nationkey = 3")
def a7_framework(s, d):
    key = F.col("n_nationkey")
    top = ad.table(s, d, "nation").select(F.when(key == 3, "nuxt.config.ts").when(key == 5, "vite.config.ts").otherwise(F.concat(F.lower("n_name"), F.lit(".md"))).alias("name"))
    return graph.framework(top, ad.table(s, d, "customer").select(F.when(F.col("c_custkey") == 1, "next").otherwise("vue").alias("name")))


@query(O + DEG + " SELECT path, in_degree FROM deg ORDER BY in_degree DESC, path LIMIT 5")
def a8_hub_lens(s, d):
    return graph.top_lens(graph.degrees(*chains(s, d), ad.order_tasks(s, d)).select("path", "in_degree"), "in_degree", 5)


REASON = "CASE WHEN o_orderkey % 5 = 0 THEN 'test file' ELSE 'rule ' || o_orderpriority || ' (' || o_orderstatus || ')' END"


@query(f"WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, {REASON} AS reason FROM orders) SELECT regexp_replace(reason, '\\s*\\([^()]*\\)$', '') AS rule, count(*) AS n_entries, min(path) AS least_path FROM e GROUP BY 1")
def a9_entry_groups(s, d):
    o = ad.table(s, d, "orders")
    return graph.entry_groups(o.select(F.col("o_orderkey").cast("string").alias("path"), F.expr(REASON).alias("reason")))


@query(f"WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, {REASON} AS reason FROM orders) SELECT path, 'entry' AS lens FROM e WHERE reason <> 'test file' UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'unreachable' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def a10_emphasis(s, d):
    o, c = ad.table(s, d, "orders"), ad.table(s, d, "customer")
    dead = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.col("c_custkey").cast("string").alias("path"))
    return graph.emphasis(o.select(F.col("o_orderkey").cast("string").alias("path"), F.expr(REASON).alias("reason")), dead)


# --- clusters and boundaries --------------------------------------------------------------------------------

PROPOSED = ", prop AS (SELECT path, CASE WHEN path LIKE 'src/%' THEN 'src/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS folder FROM files)"


@query(FS + PROPOSED + " SELECT path, folder FROM prop")
def c1_proposed_folder(s, d):
    return cluster.proposed(ad.customer_files(s, d))


@query(FS + ", seg AS (SELECT path, split_part(path, '/', 3) || '/' || (c_custkey % 97) AS folder FROM files) SELECT path, CASE WHEN count(*) OVER (PARTITION BY folder) < 3 THEN 'other' ELSE folder END AS folder FROM seg")
def c2_merge_small(s, d):
    f = ad.customer_files(s, d)
    return cluster.merge_small(f.select("path", F.concat(F.split("path", "/")[2], F.lit("/"), (F.col("c_custkey") % 97).cast("string")).alias("folder")))


def split_sql(level: int, start: str) -> str:
    """One split round over rows (path, folder, place), for trees without chains."""
    return f""", k{level} AS (SELECT *, CASE WHEN starts_with(path, place || '/') AND contains(substr(path, length(place) + 2), '/') THEN place || '/' || split_part(substr(path, length(place) + 2), '/', 1) END AS child, count(*) OVER (PARTITION BY folder) AS n FROM {start}),
m{level} AS (SELECT *, CASE WHEN child IS NOT NULL THEN count(*) OVER (PARTITION BY folder, child) END AS m FROM k{level}),
q{level} AS (SELECT folder, count(DISTINCT child) FILTER (WHERE m >= 3) AS q FROM m{level} GROUP BY folder),
s{level} AS (SELECT path, CASE WHEN n > 30 AND q >= 2 AND m >= 3 THEN child ELSE folder END AS folder, CASE WHEN n > 30 AND q >= 2 AND m >= 3 THEN child ELSE place END AS place FROM m{level} JOIN q{level} USING (folder))"""


ADAPTIVE = FS + PROPOSED + ", s0 AS (SELECT path, CASE WHEN count(*) OVER (PARTITION BY folder) < 3 THEN 'other' ELSE folder END AS folder, CASE WHEN count(*) OVER (PARTITION BY folder) < 3 THEN 'other' ELSE folder END AS place FROM prop)" + split_sql(1, "s0") + split_sql(2, "s1") + split_sql(3, "s2")


@query(ADAPTIVE + " SELECT path, folder FROM s3")
def c3_adaptive_clusters(s, d):
    return cluster.adaptive_clusters(ad.customer_files(s, d))


@query(FS + PROPOSED + " SELECT path, CASE WHEN count(*) OVER (PARTITION BY folder) < 3 THEN 'other' ELSE folder END AS folder FROM prop")
def c4_legacy_clusters(s, d):
    return cluster.legacy_clusters(ad.customer_files(s, d))


@query(FS + " SELECT path, line_count, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'other' END AS folder FROM files")
def c5_apply_clusters(s, d):
    f = ad.customer_files(s, d)
    return cluster.apply_clusters(f, f.where("c_custkey % 2 = 0").select("path", F.lit("even").alias("folder")))


ANC = """, anc AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS folder FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM {t}))"""


@query(FS + ANC.format(t="files") + " SELECT folder AS path, regexp_replace(folder, '/?[^/]*$', '') AS parent, CAST(len(string_split(folder, '/')) AS BIGINT) AS depth, count(*) AS all_files, count(*) FILTER (WHERE regexp_replace(path, '/?[^/]*$', '') = folder) AS own_files FROM anc GROUP BY folder")
def c6_folder_tree(s, d):
    return cluster.folder_tree(ad.customer_files(s, d)).select("path", "parent", "depth", "all_files", "own_files")


@query(FS + ANC.format(t="files") + " SELECT folder AS path, count(*) AS all_files FROM anc WHERE folder = 'src/ASIA' GROUP BY folder")
def c7_find_folder(s, d):
    return cluster.find_folder(cluster.folder_tree(ad.customer_files(s, d)), "src/ASIA").select("path", "all_files")


@query(FS + r" SELECT path, regexp_matches(path, '(^|/)(tests?|__tests__|specs?|e2e)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|_test\.(go|py)$', 'i') AS is_test FROM files")
def c8_is_test(s, d):
    return ad.customer_files(s, d).select("path", paths.is_test(F.col("path")).alias("is_test"))


@query(T + " SELECT 'module-root' AS kind, 'trade' AS path, count(*) AS n_files FROM nodes")
def c9_root_boundaries(s, d):
    nodes, _ = trade(s, d)
    roots = s.createDataFrame([("r", "trade", "verified")], "root_id string, root_path string, confidence string")
    return boundaries.root_boundaries(roots, nodes.select(F.lit("r").alias("root_id"), "path")).select("kind", "path", "n_files")


@query(FS + ANC.format(t="files") + " SELECT 'folder' AS kind, folder AS path, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/?[^/]*$', '') END AS parent, count(*) AS n_files, min(path) AS first_file FROM anc GROUP BY folder")
def c10_folder_boundaries(s, d):
    b = boundaries.folder_boundaries(ad.customer_files(s, d))
    return b.select("kind", "path", "parent", "n_files", F.col("contained")[0].alias("first_file"))


@query(ADAPTIVE + " SELECT folder AS path, count(*) AS n_files, min(path) AS first_file FROM s3 GROUP BY folder")
def c11_region_boundaries(s, d):
    return boundaries.region_boundaries(ad.customer_files(s, d)).select("path", "n_files", F.col("contained")[0].alias("first_file"))


@query()
def c12_boundary_ids(s, d):
    b = boundaries.in_order(boundaries.folder_boundaries(ad.customer_files(s, d)))
    return b.select("kind", "path", identity.boundary_id(F.col("kind"), F.col("path")).alias("id"))


@query(FS + " SELECT 'unknown-member' AS rule, 'folder:' || p AS subject FROM (SELECT DISTINCT unnest(['src', 'src/ASIA', 'src/ASIA/NATION_17']) AS p) WHERE EXISTS (SELECT 1 FROM files WHERE starts_with(path, p || '/') AND path LIKE 'src/ASIA/NATION_17/%') UNION ALL SELECT 'unknown-member', 'folder:src/ASIA/NATION_17/' || g FROM (SELECT DISTINCT split_part(path, '/', 4) AS g FROM files WHERE path LIKE 'src/ASIA/NATION_17/%')")
def c13_boundary_violations(s, d):
    f = ad.customer_files(s, d)
    return boundaries.boundary_violations(boundaries.folder_boundaries(f), f.where("path not like 'src/ASIA/NATION_17/%'"))


@query(FS + ANC.format(t="files") + " SELECT 'folder' AS kind, folder AS path FROM anc WHERE path = (SELECT min(path) FROM files)")
def c14_boundaries_of(s, d):
    f = ad.customer_files(s, d)
    return boundaries.boundaries_of(boundaries.folder_boundaries(f), f.agg(F.min("path")).first()[0])


@query(ADAPTIVE + " SELECT path, folder FROM s3 WHERE path IN (SELECT path FROM files WHERE c_custkey % 3 = 0)")
def c15_clusters_from_model(s, d):
    f = ad.customer_files(s, d)
    return boundaries.clusters_from(boundaries.region_boundaries(f), f.where("c_custkey % 3 = 0"))


@query("SELECT CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Src/API/' || c_name WHEN 2 THEN 'pkg/Core/x/' || c_name ELSE 'Billing/deep/' || c_name END AS path, CASE c_custkey % 4 WHEN 1 THEN 'api' WHEN 2 THEN 'core' WHEN 3 THEN 'Billing' END AS layer FROM customer")
def c16_layers(s, d):
    c = ad.table(s, d, "customer")
    lead = F.element_at(F.array(*map(F.lit, ("", "Src/API/", "pkg/Core/x/", "Billing/deep/"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.concat(lead, "c_name").alias("path")).select("path", paths.layer(F.col("path")).alias("layer"))


@query("SELECT CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'SRC/Billing/' WHEN 2 THEN 'Billing/x/' WHEN 3 THEN 'api/x/' ELSE 'src/' END || c_name AS path, CASE WHEN c_custkey % 5 IN (1, 2) THEN 'Billing' END AS domain FROM customer")
def c17_domains(s, d):
    c = ad.table(s, d, "customer")
    lead = F.element_at(F.array(*map(F.lit, ("", "SRC/Billing/", "Billing/x/", "api/x/", "src/"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select(F.concat(lead, "c_name").alias("path")).select("path", paths.domain(F.col("path")).alias("domain"))


@query(FS + """, own AS (SELECT path, 'layer' AS kind, split_part(path, '/', 1) AS name, c_custkey FROM files UNION ALL SELECT path, 'domain', CASE WHEN path LIKE 'src/%' THEN split_part(path, '/', 2) ELSE 'tests' END, c_custkey FROM files),
o AS (SELECT kind, CASE WHEN kind = 'domain' AND c_custkey % 10 = 0 THEN 'chosen' ELSE name END AS name, kind = 'domain' AND c_custkey % 10 = 0 AS own FROM own)
SELECT kind, name, count(*) AS n_files, CASE WHEN bool_and(own) THEN 'user-defined' ELSE 'heuristic' END AS origin FROM o GROUP BY kind, name""")
def c18_inference_groups(s, d):
    f = ad.customer_files(s, d)
    o = f.where("c_custkey % 10 = 0").select("path", F.lit("domain").alias("kind"), F.lit("chosen").alias("name"))
    return boundaries.inference_groups(boundaries.inferred(f, o))


# --- entries and reachability -------------------------------------------------------------------------------


@query("""WITH f AS (SELECT c_custkey % 10 AS k, CASE c_custkey % 10 WHEN 0 THEN 'app/c' || c_custkey || '/page.tsx' WHEN 1 THEN 'pages/c' || c_custkey || '.js' WHEN 2 THEN 'c' || c_custkey || '.config.ts' WHEN 3 THEN 'cypress/c' || c_custkey || '.ts'
  WHEN 4 THEN 'specs/c' || c_custkey || '.ts' WHEN 5 THEN 'examples/c' || c_custkey || '.ts' WHEN 6 THEN 'bench/c' || c_custkey || '.ts' WHEN 7 THEN 'bin/c' || c_custkey || '.ts' WHEN 8 THEN 'lib/c' || c_custkey || '.ts' ELSE 'e2e/c' || c_custkey || '.ts' END AS path FROM customer)
SELECT path, CASE k WHEN 0 THEN 'Next.js route (' || path || ')' WHEN 1 THEN 'Next.js route (' || path || ')' WHEN 2 THEN 'config file' WHEN 5 THEN 'example or demo (examples/)' WHEN 6 THEN 'benchmark (bench/)' WHEN 7 THEN 'script (bin/)' ELSE 'test file' END AS reason FROM f WHERE k NOT IN (4, 8)""")
def e6_conventions(s, d):
    forms = ("app/c%d/page.tsx", "pages/c%d.js", "c%d.config.ts", "cypress/c%d.ts", "specs/c%d.ts", "examples/c%d.ts", "bench/c%d.ts", "bin/c%d.ts", "lib/c%d.ts", "e2e/c%d.ts")
    return entrypoints.by_convention(by_form(ad.table(s, d, "customer"), "c_custkey", forms)).select("path", "reason")


@query("""WITH f AS (SELECT p_partkey % 8 AS k, 'x/' || CASE p_partkey % 8 WHEN 0 THEN 'p' || p_partkey || '.test.vue' WHEN 1 THEN '__mocks__/p' || p_partkey || '.ts' WHEN 2 THEN 'p' || p_partkey || '.stories.mdx' WHEN 3 THEN 'test_p' || p_partkey || '.py'
  WHEN 4 THEN 'p' || p_partkey || '_test.go' WHEN 5 THEN p_partkey || '/conftest.py' WHEN 6 THEN 'latest' || p_partkey || '.py' ELSE 'spec/p' || p_partkey || '.ts' END AS path FROM part)
SELECT path, CASE k WHEN 2 THEN 'Storybook story' ELSE 'test file' END AS reason FROM f WHERE k < 6""")
def e7_anywhere(s, d):
    forms = ("x/p%d.test.vue", "x/__mocks__/p%d.ts", "x/p%d.stories.mdx", "x/test_p%d.py", "x/p%d_test.go", "x/%d/conftest.py", "x/latest%d.py", "x/spec/p%d.ts")
    return entrypoints.anywhere(by_form(ad.table(s, d, "part"), "p_partkey", forms)).select("path", "reason")


@query("""SELECT CASE doc_id % 5 WHEN 0 THEN doc_id || '.py' WHEN 1 THEN doc_id || '/manage.py' ELSE doc_id || '.go' END AS path,
CASE doc_id % 5 WHEN 0 THEN 'Python __main__ guard' WHEN 1 THEN 'Python entry module (manage.py)' ELSE 'Go package main' END AS reason FROM documents WHERE doc_id % 5 < 3""")
def e8_content_rules(s, d):
    doc = ad.table(s, d, "documents")
    which = F.col("doc_id") % 5
    tail = F.when(which == 0, '\nif __name__ == "__main__":\n').when(which.isin(2, 3), "\npackage main\n").otherwise("\n")
    path = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".py", "/manage.py", ".go", "_test.go", ".py"))), (which + 1).cast("int")))
    return entrypoints.by_content(doc.select(path.alias("path"), F.concat(F.coalesce("text", F.lit("")), tail).alias("content"))).select("path", "reason")


@query("SELECT CAST(doc_id AS VARCHAR) || '.js' AS path FROM documents WHERE doc_id % 5 = 0")
def e9_dynamic_imports(s, d):
    doc = ad.table(s, d, "documents")
    body = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "\nimport(name)\n").otherwise('\nimport("x")\n'))
    none = s.createDataFrame([], "path string, reason string")
    return entrypoints.dynamic_import_files(doc.select(F.concat(F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), body.alias("content")), none)


@query("SELECT DISTINCT p_brand AS root, CASE p_partkey % 6 WHEN 0 THEN 'Astro' ELSE 'Remix' END AS framework FROM part WHERE p_partkey % 6 < 2")
def e10_frameworks(s, d):
    which = F.col("p_partkey") % 6
    name = F.when(which == 0, "astro").when(which == 1, F.concat(F.lit("@remix-run/p"), F.col("p_partkey").cast("string"))).when(which == 2, "react").otherwise("not-astro")
    return entrypoints.unknown_frameworks(ad.table(s, d, "part").select(F.col("p_brand").alias("root"), name.alias("name")))


@query("""SELECT 'package.json "exports" ("./p' || p_partkey || '")' AS reason, path FROM (SELECT p_partkey, 'src/p' || p_partkey || '.ts' AS path FROM part WHERE p_partkey % 3 = 0)""")
def e3_exports(s, d):
    """A manifest's exports: of three parts one is exported, one excluded by a null key with a star, and one a family of files."""
    p = ad.table(s, d, "part")
    n = F.col("p_partkey").cast("string")
    key = F.when(n % 3 == 0, F.concat(F.lit("./p"), n)).when(n % 3 == 1, F.concat(F.lit("./internal/p"), n)).otherwise(F.concat(F.lit("./all"), n, F.lit("/*")))
    target = F.when(n % 3 == 2, F.concat(F.lit("./src/all"), n, F.lit("/*.js"))).otherwise(F.concat(F.lit("./dist/p"), n, F.lit(".js")))
    entry = F.concat(F.lit('"'), key, F.lit('": "'), target, F.lit('"'))
    listed = F.concat(F.lit('{"exports": {"./internal/*": null, '), F.array_join(F.collect_list(entry), ", "), F.lit("}}"))  # the text of one manifest
    manifest = p.agg(listed.alias("content")).select(F.lit("package.json").alias("path"), "content")
    return entrypoints.by_manifest(p.select(F.concat(F.lit("src/p"), n, F.lit(".ts")).alias("path")), manifest).select("reason", "path")


SEEDS = "(SELECT path FROM nodes WHERE path LIKE 'ASIA/%')"
REACHED = f", hit AS (SELECT path AS node FROM nodes WHERE path IN {SEEDS} UNION SELECT dst FROM hit JOIN edges ON src = node)"


@query(O + REACHED + " SELECT node AS path FROM hit")
def r1_reached(s, d):
    nodes, edges = chains(s, d)
    return reach.reached(nodes, edges, nodes.where("path like 'ASIA/%'"))


@query(PE.replace("WITH", "WITH RECURSIVE", 1) + ", hit AS (SELECT path AS node FROM parts WHERE p_partkey = 1 UNION SELECT dst FROM hit JOIN pedges ON src = node) SELECT path FROM parts WHERE path NOT IN (SELECT node FROM hit)")
def r2_unreachable(s, d):
    p = ad.part_files(s, d)
    return reach.unreachable(p, ad.part_edges(s, d), p.where("p_partkey = 1")).select("path")


@query(PE + """, far AS (SELECT DISTINCT b.path AS node FROM pedges JOIN parts b ON b.path = dst) SELECT CASE WHEN path IN (SELECT node FROM far) OR path IN (SELECT src FROM pedges) THEN (SELECT min(path) FROM parts WHERE path IN (SELECT src FROM pedges) OR path IN (SELECT node FROM far)) ELSE path END AS component, count(*) AS n FROM parts GROUP BY 1""")
def g7_part_components(s, d):
    """Components of the whole part graph: every part with a line hangs together with the others over the suppliers' keys."""
    # parts have numbers already: their paths only name the components
    line = ad.table(s, d, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst"))
    files = ad.part_files(s, d).select(F.col("p_partkey").cast("long").alias("node"), "path")
    c = fixpoint.components(files.select("node"), line).withColumnRenamed("component", "number")
    return c.join(files, "node").groupBy("number").agg(F.min("path").alias("component"), F.count("*").alias("n")).drop("number")


@query(PE + " SELECT path, 'entry' AS role, 'given' AS reason FROM parts WHERE p_partkey = 1 UNION ALL SELECT path, 'unreachable', NULL FROM parts WHERE p_partkey = (SELECT max(p_partkey) FROM parts)")
def r4_describe(s, d):
    """Of an entry, of what it reaches (no row) and of what nothing reaches."""
    p = ad.part_files(s, d)
    entries = p.where("p_partkey = 1").select("path", F.lit("given").alias("reason"))
    dead = reach.unreachable(p, ad.part_edges(s, d), entries).select("path")
    last = p.agg(F.max("p_partkey")).first()[0]
    named = [p.where(F.col("p_partkey") == k).first()["path"] for k in (1, 2, last)]
    out = [reach.describe(entries, dead, x) for x in named]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- confidence and views -----------------------------------------------------------------------------------

BAD = "CASE WHEN length(path) % 3 = 0 THEN 'heuristic' ELSE 'verified' END"


def known(nodes: DataFrame) -> DataFrame:
    return confidence.by_path(nodes, nodes.where("length(path) % 3 = 0"))


@query(T + f" SELECT path, {BAD} AS confidence FROM nodes")
def p1_by_path(s, d):
    return known(ad.trade_nodes(s, d))


@query(O + " SELECT id, CASE WHEN length(src) % 3 = 0 THEN 'heuristic' ELSE 'derived' END AS confidence FROM edges")
def p2_edge_confidence(s, d):
    nodes, edges = chains(s, d)
    return confidence.edge_confidence(edges, known(nodes)).select("id", "confidence")


HREFS = r"links AS (SELECT CAST(page_id AS VARCHAR) AS path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS specifier FROM pages)"


def hrefs(s: SparkSession, d: str) -> DataFrame:
    p = ad.table(s, d, "pages")
    return p.select(F.col("page_id").cast("string").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("specifier"))


@query(f"WITH {HREFS} SELECT path, count(DISTINCT specifier) AS n_unresolved FROM links GROUP BY path")
def p3_unresolved_by_file(s, d):
    return confidence.unresolved_by_file(hrefs(s, d)).select("path", "n_unresolved")


@query(O + FOLD + " SELECT folder, count(*) FILTER (WHERE length(path) % 3 = 0) AS n_reduced FROM fold GROUP BY folder")
def p5_reduced_by_region(s, d):
    nodes, _ = chains(s, d)
    return confidence.reduced_by_region(regions(nodes), known(nodes))


@query(O + FOLD + " SELECT DISTINCT a.folder AS src_folder, b.folder AS dst_folder FROM edges JOIN fold a ON src = a.path JOIN fold b ON dst = b.path WHERE a.folder <> b.folder")
def v1_folder_edges(s, d):
    nodes, edges = chains(s, d)
    return confidence.folder_edges(edges, regions(nodes), ad.order_tasks(s, d))


@query(O + FOLD + " SELECT a.folder AS folder, src, dst FROM edges JOIN fold a ON src = a.path JOIN fold b ON dst = b.path WHERE a.folder = b.folder")
def v2_interior_edges(s, d):
    nodes, edges = chains(s, d)
    return confidence.interior_edges(edges, regions(nodes))


@query(O + FOLD + ", x AS (SELECT src, dst, a.folder AS sf, b.folder AS df FROM edges JOIN fold a ON src = a.path JOIN fold b ON dst = b.path WHERE a.folder <> b.folder) SELECT DISTINCT sf AS region, src AS path, 'out' AS direction, df AS neighbour FROM x UNION SELECT DISTINCT df, dst, 'in', sf FROM x")
def v3_boundary_stubs(s, d):
    nodes, edges = chains(s, d)
    return confidence.boundary_stubs(edges, regions(nodes))


@query(f"WITH {HREFS} SELECT DISTINCT path, specifier FROM links")
def v4_unresolved_stubs(s, d):
    return hrefs(s, d).distinct()


@query(T + " SELECT path, CAST((rk % 4) * 260 AS BIGINT) AS x, CAST((rk // 4) * 140 AS BIGINT) AS y FROM (SELECT path, row_number() OVER (ORDER BY path) - 1 AS rk FROM nodes)")
def v6_grid(s, d):
    return confidence.grid(ad.trade_nodes(s, d).select("path"), "path")


# --- diagrams -----------------------------------------------------------------------------------------------


def units_of(nodes: DataFrame) -> DataFrame:
    return diagram.top_units(nodes)


UNITS = ", units AS (SELECT path, line_count, split_part(path, '/', 1) AS unit FROM nodes)"
UE = ", ue AS (SELECT a.unit AS source, b.unit AS target, count(*) AS n FROM edges JOIN units a ON src = a.path JOIN units b ON dst = b.path GROUP BY 1, 2)"
UX = ", ux AS (SELECT e.*, EXISTS (SELECT 1 FROM ue f WHERE f.source = e.target AND f.target = e.source) AS mutual FROM ue e WHERE source <> target)"


@query(FS + " SELECT path, CASE WHEN path LIKE 'src/%' THEN 'src/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS unit FROM files")
def d2_top_units(s, d):
    return diagram.top_units(ad.customer_files(s, d)).select("path", "unit")


@query(FS + ", u AS (SELECT path, split_part(path, '/', 3) AS unit FROM files), r AS (SELECT unit, row_number() OVER (ORDER BY count(*), unit) AS rk, count(*) OVER () AS k FROM u GROUP BY unit) SELECT path, CASE WHEN k > 10 AND rk <= k - 9 THEN (k - 9) || ' small folders' ELSE u.unit END AS unit FROM u JOIN r ON u.unit = r.unit")
def d3_merge_smallest(s, d):
    f = ad.customer_files(s, d).select("path", F.split("path", "/")[2].alias("unit"))
    return diagram.merge_smallest(f, 10)


@query()
def d4_expand(s, d):
    tree = cluster.folder_tree(ad.customer_files(s, d))
    top = tree.where("depth <= 4").select("path", "parent", "own_files", "all_files").collect()  # folders down to four levels: a figure's material
    kids: dict[str, dict[str, int]] = {}
    for r in top:
        kids.setdefault(r.path, {})
        if r.parent:
            kids.setdefault(r.parent, {})[r.path] = r.all_files
    loose = {r.path: r.own_files if r.path.count("/") < 3 else r.all_files for r in top}
    return s.createDataFrame([(u,) for u in diagram.expand(kids, loose, 24)], "unit string")


@query(O + UNITS + ", e AS (SELECT a.unit AS source, b.unit AS target, id, row_number() OVER (PARTITION BY a.unit, b.unit ORDER BY id) AS rk FROM edges JOIN units a ON src = a.path JOIN units b ON dst = b.path) SELECT source, target, count(*) AS n, string_agg(id, ' ' ORDER BY id) FILTER (WHERE rk <= 5) AS samples FROM e GROUP BY 1, 2")
def d7_unit_edges(s, d):
    nodes, edges = chains(s, d)
    return diagram.unit_edges(units_of(nodes), edges).withColumn("samples", F.array_join("samples", " "))


@query(O + UNITS + UE + UX + """, w AS (SELECT source AS a, target AS b FROM ux UNION SELECT a, target FROM w JOIN ux ON source = b)
SELECT source, target, n, mutual, EXISTS (SELECT 1 FROM w WHERE a = target AND b = source) AS in_cycle FROM ux""")
def d8_d9_flagged(s, d):
    nodes, edges = chains(s, d)
    return diagram.flagged(diagram.unit_edges(units_of(nodes), edges)).drop("samples")


SHARED = ", shared AS (SELECT target AS unit, count(DISTINCT source) AS importers FROM ux GROUP BY target HAVING count(DISTINCT source) >= 3 AND count(DISTINCT source) >= 0.6 * ((SELECT count(DISTINCT unit) FROM units) - 1) AND (SELECT count(DISTINCT unit) FROM units) >= 4)"


@query(O + UNITS + UE + UX + SHARED + " SELECT unit, importers FROM shared")
def d10_shared_parts(s, d):
    nodes, edges = chains(s, d)
    u = units_of(nodes)
    return diagram.shared_parts(u, diagram.unit_edges(u, edges))


@query(O + UNITS + UE + UX + SHARED + """, al AS (SELECT *, target IN (SELECT unit FROM shared) OR (source IN (SELECT unit FROM shared) AND mutual) AS aside FROM ux),
rk AS (SELECT *, row_number() OVER (PARTITION BY (NOT aside AND NOT mutual) ORDER BY n DESC, source || '->' || target) AS r, count(*) FILTER (WHERE NOT aside AND mutual) OVER () AS many FROM al)
SELECT source, target, n, mutual, CASE WHEN aside THEN 'set-aside' WHEN mutual OR r <= greatest(4 - many, 0) THEN 'kept' ELSE 'dropped' END AS fate FROM rk""")
def d11_select_edges(s, d):
    nodes, edges = chains(s, d)
    u = units_of(nodes)
    between = diagram.unit_edges(u, edges)
    return diagram.select_edges(diagram.flagged(between), diagram.shared_parts(u, between), 4).select("source", "target", "n", "mutual", "fate")


@query(O + UNITS + UE + " SELECT u.unit, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, CAST(0 AS BIGINT) AS tests, count(*) FILTER (WHERE length(path) % 3 = 0) AS reduced, coalesce(max(n), 0) AS internal FROM units u LEFT JOIN ue ON source = u.unit AND target = u.unit GROUP BY u.unit")
def d12_unit_measures(s, d):
    nodes, edges = chains(s, d)
    return diagram.unit_measures(units_of(nodes), edges, known(nodes))


@query("WITH u AS (SELECT DISTINCT o_orderkey % 50 AS f, split_part(p_name, ' ', 1) AS package FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) SELECT package, count(DISTINCT f) AS files FROM u GROUP BY package ORDER BY files DESC, package LIMIT 8")
def d13_external_packages(s, d):
    line, part = ad.table(s, d, "lineitem").select("l_orderkey", "l_partkey"), ad.table(s, d, "part").select("p_partkey", "p_name")
    x = line.join(part, line["l_partkey"] == part["p_partkey"]).select((F.col("l_orderkey") % 50).cast("string").alias("path"), F.concat(F.split("p_name", " ")[0], F.lit("/sub")).alias("specifier")).distinct()
    return diagram.external_packages(x, None)


def moved_units(nodes: DataFrame) -> DataFrame:
    """Two nations in the wrong region, so that they look misplaced."""
    return nodes.select("path", "line_count", F.when(F.col("path") == ASIA, "AFRICA").otherwise(F.split("path", "/")[0]).alias("unit"))


PUNITS = ", punits AS (SELECT path, split_part(path, '/', 1) AS unit FROM parts)"


@query(PE + """, lines AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), sides AS (SELECT 'parts/p' || l_partkey AS path, CASE WHEN l_suppkey % 10 = 0 THEN 'other' ELSE 'supply' END AS other, 'parts' AS unit FROM lines
UNION ALL SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'other' ELSE 'supply' END || '/s' || l_suppkey, 'parts', CASE WHEN l_suppkey % 10 = 0 THEN 'other' ELSE 'supply' END FROM lines),
g AS (SELECT path, unit, sum(n) AS total, max(n) AS most, max_by(other, (n, other)) AS other FROM (SELECT path, unit, other, count(*) AS n FROM sides GROUP BY ALL) GROUP BY 1, 2)
SELECT path, unit, other, CAST(total AS BIGINT) AS total, most FROM g WHERE total >= 3 AND most >= 0.8 * total ORDER BY total DESC, path LIMIT 3""")
def d18_misplaced(s, d):
    """Parts and suppliers in units of their own, an edge for each pair in a line."""
    line = ad.table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    supply = F.when(F.col("l_suppkey") % 10 == 0, "other").otherwise("supply")
    a, b = F.concat(F.lit("parts/p"), F.col("l_partkey").cast("string")), F.concat(supply, F.lit("/s"), F.col("l_suppkey").cast("string"))
    units = line.select(a.alias("path"), F.lit("parts").alias("unit")).unionByName(line.select(b.alias("path"), supply.alias("unit"))).distinct()
    return diagram.misplaced(units, line.select(a.alias("src"), b.alias("dst")))


@query(O + UNITS + f", l AS (SELECT path, specifier FROM (SELECT path, unnest(range((length(path) % 4) * 20)) AS specifier FROM nodes)), u AS (SELECT unit, count(*) AS bad FROM l JOIN units USING (path) GROUP BY unit), g AS (SELECT unit, count(*) AS good FROM edges JOIN units ON src = path GROUP BY unit) SELECT unit AS subject, bad AS figure FROM u LEFT JOIN g USING (unit) WHERE bad >= 3 AND bad > 0.1 * (bad + coalesce(good, 0))")
def d19_unresolved_heavy(s, d):
    nodes, edges = chains(s, d)
    loose = nodes.where("length(path) % 4 > 0").select("path", F.explode(F.sequence(F.lit(1), (F.length("path") % 4 * 20).cast("int"))).alias("specifier"))
    return diagram.unresolved_heavy(units_of(nodes), edges, loose)


@query(O + UNITS + UE + UX + SHARED + """, w AS (SELECT source AS a, target AS b FROM ux UNION SELECT a, target FROM w JOIN ux ON source = b), cyc AS (SELECT source AS x FROM ux WHERE EXISTS (SELECT 1 FROM w WHERE a = target AND b = source)
 UNION SELECT target FROM ux WHERE EXISTS (SELECT 1 FROM w WHERE a = target AND b = source)), cc AS (SELECT x, (SELECT min(y.x) FROM cyc y WHERE y.x = c.x OR EXISTS (SELECT 1 FROM w WHERE a = c.x AND b = y.x)) AS least FROM cyc c)
SELECT 'cycle' AS kind, least AS subject, count(*) AS figure FROM cc GROUP BY least UNION ALL SELECT 'hub', unit, importers FROM shared
UNION ALL SELECT 'isolated', unit, count(*) FROM units WHERE unit NOT IN (SELECT source FROM ux UNION SELECT target FROM ux) GROUP BY unit""")
def d20_findings(s, d):
    nodes, edges = chains(s, d)
    return diagram.findings(units_of(nodes), edges).where("kind in ('cycle', 'hub', 'isolated')")


@query(PE + PDEG + PUNITS + " SELECT unit, path, rank FROM (SELECT unit, path, row_number() OVER (PARTITION BY unit ORDER BY in_degree DESC, path) AS rank FROM pdeg JOIN punits USING (path)) WHERE rank <= 3")
def d23_key_files(s, d):
    p = ad.part_files(s, d)
    deg = graph.degrees(p, ad.part_edges(s, d)).select("path", "in_degree")
    return diagram.key_files(deg, p.select(F.split("path", "/")[0].alias("unit")).distinct())


@query(O + UNITS + UE + UX + """, ul AS (SELECT unit, '  ' || regexp_replace(unit, '[^A-Za-z0-9]', '_', 'g') || '["' || unit || '<br/>' || format('{:,}', count(*)) || CASE WHEN count(*) = 1 THEN ' file' ELSE ' files' END || ' · ' || format('{:,}', sum(line_count)::BIGINT) || ' lines"]' AS line FROM units GROUP BY unit),
el AS (SELECT source, target, '  ' || regexp_replace(source, '[^A-Za-z0-9]', '_', 'g') || CASE WHEN n >= 2 THEN ' -->|' || n || '| ' ELSE ' --> ' END || regexp_replace(target, '[^A-Za-z0-9]', '_', 'g') AS line FROM ux),
cy AS (SELECT DISTINCT regexp_replace(source, '[^A-Za-z0-9]', '_', 'g') AS c FROM ux WHERE mutual)
SELECT concat_ws(chr(10), 'flowchart LR', (SELECT string_agg(line, chr(10) ORDER BY unit) FROM ul), (SELECT string_agg(line, chr(10) ORDER BY source, target) FROM el), '  classDef cycle stroke:#7A5312,stroke-width:2px', (SELECT '  class ' || string_agg(c, ',' ORDER BY c) || ' cycle' FROM cy)) AS text""")
def d24_mermaid(s, d):
    nodes, edges = chains(s, d)
    u = units_of(nodes)
    m = diagram.unit_measures(u, edges).select(F.col("unit").alias("id"), F.col("unit").alias("label"), "files", "lines")
    return diagram.mermaid(m, diagram.flagged(diagram.unit_edges(u, edges)))


# --- search, tours, evidence --------------------------------------------------------------------------------


@query(T + DEG + r" SELECT path AS id, regexp_extract(path, '([^/]*)$', 1) AS label, regexp_replace(path, '/?[^/]*$', '') AS context, 'file' AS kind, in_degree AS weight FROM deg UNION ALL SELECT path || '#' || regexp_extract(path, '([^/]*)$', 1), regexp_extract(path, '([^/]*)$', 1), path, 'symbol', in_degree FROM deg")
def s1_search_items(s, d):
    nodes, edges = trade(s, d)
    return search.search_items(graph.degrees(nodes, edges), nodes.select("path", paths.name_of(F.col("path")).alias("name")))


RANKED = """, items AS (SELECT path AS id, regexp_extract(path, '([^/]*)$', 1) AS label, regexp_replace(path, '/?[^/]*$', '') AS context, in_degree AS weight FROM deg),
tier AS (SELECT *, CASE WHEN lower(label) = 'in' THEN 1000 WHEN starts_with(lower(label), 'in') THEN 800 WHEN regexp_matches(lower(label), '[/\\-_.@: ]in') THEN 600 WHEN regexp_matches(lower(label), 'i.*n') THEN 400 END AS a,
 CASE WHEN lower(context) = 'in' THEN 1000 WHEN starts_with(lower(context), 'in') THEN 800 WHEN regexp_matches(lower(context), '[/\\-_.@: ]in') THEN 600 WHEN regexp_matches(lower(context), 'i.*n') THEN 400 END - 150 AS b FROM items),
scored AS (SELECT id, label, 'file' AS kind, CAST(coalesce(a, b) AS BIGINT) AS score, weight FROM tier WHERE coalesce(a, b) IS NOT NULL)"""


@query(T + DEG + RANKED + " SELECT id, label, kind, score, weight, (SELECT count(*) FROM scored) AS total FROM scored ORDER BY score DESC, weight DESC, label, id LIMIT 20")
def s3_rank(s, d):
    return search.rank(search.search_items(graph.degrees(*trade(s, d))), "in", 20)


@query()
def t1_tour(s, d):
    nodes, edges = trade(s, d)
    entries = nodes.where("path like 'ASIA/%'").select("path", F.lit('package.json "main"').alias("reason"))
    return tour.tour(nodes, edges, regions(nodes), entries)


@query(T + ", w AS (SELECT path, min(line_count % 7) AS nth, row_number() OVER (ORDER BY path) AS i FROM nodes GROUP BY path), r AS (SELECT path, row_number() OVER (ORDER BY path DESC) AS step FROM nodes) SELECT step, path FROM r WHERE step <= 10")
def t2_chosen_tour(s, d):
    from pyspark.sql import Window

    nodes = ad.trade_nodes(s, d)
    n = nodes.select(F.row_number().over(Window.orderBy(F.desc("path"))).alias("nth"), "path")
    twice = n.unionByName(n.select((F.col("nth") + 100).alias("nth"), "path")).unionByName(s.createDataFrame([(0, "nowhere")], "nth int, path string"))
    return tour.chosen_tour(twice, nodes)


@query(PE + " SELECT path, 0 AS in_degree, count(*) AS out_degree FROM parts JOIN pedges ON src = path WHERE path NOT IN (SELECT dst FROM pedges) GROUP BY path ORDER BY out_degree DESC, path LIMIT 8")
def x2_likely_entries(s, d):
    return evidence.likely_entries(graph.degrees(ad.part_files(s, d), ad.part_edges(s, d))).select("path", "in_degree", "out_degree")


@query(O + FOLD + RE + ", two AS (SELECT source AS folder, 'out' AS direction, target AS other, n_edges FROM re UNION ALL SELECT target, 'in', source, n_edges FROM re), r AS (SELECT *, row_number() OVER (PARTITION BY folder, direction ORDER BY n_edges DESC, other) AS rank FROM two) SELECT r.folder, f.n_files, direction, other, n_edges, rank FROM r JOIN (SELECT folder, count(*) AS n_files FROM fold GROUP BY folder) f ON r.folder = f.folder WHERE rank <= 4")
def x2_region_table(s, d):
    nodes, edges = chains(s, d)
    return evidence.region_table(regions(nodes), edges)


@query(O + DEG + FOLD + ", j AS (SELECT folder, path, in_degree * 1000 + line_count AS weight FROM deg JOIN fold USING (path) JOIN nodes USING (path)), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY weight DESC, path) AS rank FROM j) SELECT folder, path, weight, rank FROM r WHERE rank <= 6")
def x3_region_key_files(s, d):
    nodes, edges = chains(s, d)
    return evidence.region_key_files(regions(nodes), graph.degrees(nodes, edges), nodes)


@query(PE + PDEG + " SELECT path, rank() OVER (ORDER BY in_degree DESC) AS rank FROM pdeg")
def x4_import_rank(s, d):
    return evidence.import_rank(graph.degrees(ad.part_files(s, d), ad.part_edges(s, d)))


CLAIM = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"


@query(f"WITH c AS (SELECT {CLAIM} AS claim_id, 'doc' AS kind, CAST(conv_id AS VARCHAR) AS id FROM conversations UNION ALL SELECT {CLAIM}, 'doc', CAST(conv_id + turn AS VARCHAR) FROM conversations), e AS (SELECT DISTINCT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS id, TRUE AS ok FROM labels) SELECT claim_id FROM c LEFT JOIN e USING (kind, id) GROUP BY claim_id HAVING bool_and(coalesce(ok, FALSE))")
def x6_supported_claims(s, d):
    c = ad.table(s, d, "conversations")
    cid = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("claim_id")
    cited = c.select(cid, F.explode(F.array(F.col("conv_id").cast("string"), (F.col("conv_id") + F.col("turn")).cast("string"))).alias("id"))
    known_ids = ad.table(s, d, "labels").select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    return evidence.supported_claims(cited.withColumn("kind", F.lit("doc")), known_ids)


@query()
def x7_unsupported_figures(s, d):
    doc = ad.table(s, d, "documents")
    return evidence.unsupported_figures(doc.select(F.col("doc_id").alias("claim_id"), "text"), ad.table(s, d, "benchmark").select("text"))


@query("""SELECT source AS unit, min_by(lang || ' part', doc_id) AS text, 'caption' AS kind FROM documents WHERE doc_id % 5 = 0 GROUP BY source
UNION ALL SELECT NULL, text, 'note' FROM (SELECT 'see ' || source || ' ' || doc_id AS text, doc_id FROM documents WHERE doc_id % 5 = 2 ORDER BY doc_id LIMIT 6)""")
def x8_final_notes(s, d):
    """Claims of five kinds: good captions, captions with a digit, good notes, notes with a figure that nothing has, and captions that cite two."""
    doc = ad.table(s, d, "documents")
    which, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    text = F.when(which == 0, F.concat(F.lit("  "), "lang", F.lit(" part.. "))).when(which == 1, F.concat("lang", F.lit(" part 1"))).when(which == 2, F.concat(F.lit("see "), "source", F.lit(" "), n)).when(which == 3, "has 987654321 files").otherwise("two parts")
    region = F.struct(F.lit("region").alias("kind"), F.col("source").alias("id"))
    cited = F.when(which == 4, F.array(region, F.struct(F.lit("edge").alias("kind"), F.lit("e").alias("id")))).otherwise(F.array(region))
    claims = doc.select(F.col("doc_id").alias("nth"), F.when(which.isin(2, 3), "note").otherwise("caption").alias("section"), text.alias("text"), cited.alias("citations"))
    known = doc.where(which == 2).select(F.explode(texts.figures(F.concat(F.lit("see "), "source", F.lit(" "), n))).alias("figure")).distinct()
    return evidence.final_notes(claims, known)


@query("SELECT vec AS subject, sha256('v1' || chr(10) || vec) AS key FROM (SELECT CAST(doc_id AS VARCHAR) AS vec FROM documents)")
def x9_cache_keys(s, d):
    doc = ad.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("subject"), F.lit("v1").alias("version"))
    return doc.select("subject", evidence.cache_key("version", "subject").alias("key"))


@query(FS + " SELECT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS folder, count(*) AS n_files FROM files GROUP BY 1 ORDER BY n_files DESC, folder LIMIT 12")
def x2_top_folders(s, d):
    return evidence.top_folders(ad.customer_files(s, d))


# --- the provenance graph -----------------------------------------------------------------------------------


def extractions(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = trade(s, d)
    imp = edges.groupBy(F.col("src").alias("path")).agg(F.collect_list("dst").alias("imports"))
    none = F.array().cast("array<string>")
    top = F.array(paths.directory(F.col("path")))
    return nodes.join(imp, "path", "left").select(
        "path", "line_count", (F.length("path") % 3 == 0).cast("int").alias("errors"), F.coalesce("imports", none).alias("imports"), none.alias("approximate"), top.alias("externals"), F.when(F.length("path") % 2 == 0, F.array(F.lit("./gone"))).otherwise(none).alias("unresolved"),
    )


@query(T + " SELECT 'file' AS kind, count(*) AS n, count(*) FILTER (WHERE length(path) % 3 = 0) AS reduced FROM nodes UNION ALL SELECT 'module-root', 1, 0 UNION ALL SELECT 'external-dependency', count(DISTINCT split_part(path, '/', 1)), 0 FROM nodes UNION ALL SELECT 'unresolved-import', count(*) FILTER (WHERE length(path) % 2 = 0), 0 FROM nodes")
def ir1_nodes(s, d):
    nodes, _ = ir.build(extractions(s, d))
    return nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("origin") == "heuristic").alias("reduced"))


@query(T + ", x AS (SELECT src, dst FROM edges UNION SELECT path, 'ext' FROM nodes UNION SELECT path, 'gone' FROM nodes WHERE length(path) % 2 = 0) SELECT 'imports' AS kind, CASE WHEN length(src) % 3 = 0 THEN 'heuristic' ELSE 'derived' END AS origin, count(*) AS n FROM x GROUP BY 1, 2 UNION ALL SELECT 'contains', 'derived', count(*) FROM nodes")
def ir7_edges(s, d):
    _, edges = ir.build(extractions(s, d))
    return edges.groupBy("kind", "origin").agg(F.count("*").alias("n"))


@query(T + " SELECT 'dangling-target' AS rule, count(*) AS n FROM nodes UNION ALL SELECT 'duplicate-node', count(*) FROM nodes WHERE length(path) % 4 = 0 HAVING count(*) > 0")
def ir10_violations(s, d):
    """Of a graph from which external packages are missing, so that each file's import of one dangles, and in which some files occur twice."""
    nodes, edges = ir.build(extractions(s, d))
    broken = nodes.where("kind <> 'external-dependency'").unionByName(nodes.where("kind = 'file' and length(path) % 4 = 0"))
    return ir.violations(broken, edges).groupBy("rule").agg(F.count("*").alias("n"))


@query()
def ir2_ids(s, d):
    nodes, _ = ir.build(extractions(s, d))
    return nodes.select("kind", "path", "id")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS path, l_returnflag AS kind, l_linestatus AS qualified_name, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) - 1 AS ordinal FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)")
def ir3_symbol_ordinals(s, d):
    line = ad.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("kind"), F.min("l_linestatus").alias("qualified_name"))
    return ir.symbol_ordinals(line.select(F.col("l_orderkey").cast("string").alias("path"), "kind", "qualified_name", F.col("l_linenumber").alias("pos")))


# --- sources, extraction, resolution ------------------------------------------------------------------------


@query("SELECT doc_id, CAST(len(string_split_regex(text, '\\r?\\n')) AS BIGINT) AS lines FROM documents")
def ext11_line_count(s, d):
    return ad.table(s, d, "documents").select("doc_id", texts.line_count(F.col("text")).cast("long").alias("lines"))


@query(f"""WITH {ad.PARTS} SELECT path, CASE p_partkey % 7 WHEN 0 THEN '/' || path WHEN 1 THEN '/style' || p_partkey || '.css' WHEN 2 THEN '/gone' || p_partkey WHEN 3 THEN 'pkg' || p_partkey WHEN 4 THEN '@/' || path WHEN 5 THEN '@/style' || p_partkey || '.css' ELSE './gone' || p_partkey END AS specifier,
CASE WHEN p_partkey % 7 IN (0, 4) THEN path END AS target, CASE p_partkey % 7 WHEN 0 THEN 'internal' WHEN 1 THEN 'asset' WHEN 4 THEN 'internal' WHEN 2 THEN 'unresolved' WHEN 6 THEN 'unresolved' ELSE 'external' END AS status FROM parts""")
def res4_classification(s, d):
    p = ad.part_files(s, d)
    n = F.col("p_partkey").cast("string")
    forms = (F.concat(F.lit("/"), "path"), F.concat(F.lit("/style"), n, F.lit(".css")), F.concat(F.lit("/gone"), n), F.concat(F.lit("pkg"), n), F.concat(F.lit("@/"), "path"), F.concat(F.lit("@/style"), n, F.lit(".css")), F.concat(F.lit("./gone"), n))
    imports = p.select("path", F.element_at(F.array(*forms), (F.col("p_partkey") % 7 + 1).cast("int")).alias("specifier"))
    listing = p.select("path").unionByName(p.select(F.concat(F.lit("style"), n, F.lit(".css")).alias("path")))
    config = s.createDataFrame([("tsconfig.json", '{"compilerOptions": {/* here */ "paths": {"@/*": ["*",],}}}')], "path string, content string")
    aliases = resolve.aliases(config)
    return resolve.resolve_typescript(imports, p, listing, aliases)


@query("""WITH f AS (SELECT DISTINCT p_brand AS b FROM part), i AS (SELECT p_partkey % 5 AS k, lower(replace(replace(p_brand, '#', ''), ' ', '')) AS b, p_partkey AS n FROM part)
SELECT 'main.py' AS path, CASE k WHEN 0 THEN b || '.m.f' || n WHEN 1 THEN b || '.gone.x' || n WHEN 2 THEN 'os.p' || n WHEN 3 THEN b || '.m' ELSE 'm' || n END AS specifier,
CASE k WHEN 0 THEN b || '/m.py' WHEN 1 THEN b || '/__init__.py' WHEN 3 THEN b || '/m.py' END AS target, CASE WHEN k IN (0, 1, 3) THEN 'internal' ELSE 'external' END AS status FROM (SELECT DISTINCT k, b, CASE WHEN k = 3 THEN 0 ELSE n END AS n FROM i)""")
def res7_python(s, d):
    """Names of symbols fall back to the innermost module or package above them."""
    p = ad.table(s, d, "part")
    brand, n = F.lower(F.regexp_replace("p_brand", "[# ]", "")), F.col("p_partkey").cast("string")
    forms = (F.concat(brand, F.lit(".m.f"), n), F.concat(brand, F.lit(".gone.x"), n), F.concat(F.lit("os.p"), n), F.concat(brand, F.lit(".m")), F.concat(F.lit("m"), n))
    imports = p.select(F.lit("main.py").alias("path"), F.element_at(F.array(*forms), (F.col("p_partkey") % 5 + 1).cast("int")).alias("specifier")).distinct()
    files = p.select(F.explode(F.array(F.concat(brand, F.lit("/__init__.py")), F.concat(brand, F.lit("/m.py")), F.lit("main.py"))).alias("path")).distinct()
    return resolve.resolve_python(imports, resolve.python_modules(files))


@query(f"WITH {ad.PART_EDGES} SELECT src AS path, '/' || replace(dst, '.ts', CASE WHEN length(dst) % 2 = 0 THEN '' ELSE '.js' END) AS specifier, dst AS target, 'internal' AS status FROM pedges")
def res1_typescript(s, d):
    p, e = ad.part_files(s, d), ad.part_edges(s, d)
    spec = F.concat(F.lit("/"), F.when(F.length("dst") % 2 == 0, F.replace("dst", F.lit(".ts"), F.lit(""))).otherwise(F.replace("dst", F.lit(".ts"), F.lit(".js"))))
    return resolve.resolve_typescript(e.select(F.col("src").alias("path"), spec.alias("specifier")), p, p, tasks=ad.line_tasks(s, d))


@query(f"WITH {ad.PARTS} SELECT 'm/' || regexp_replace(path, '/?[^/]*$', '') AS import_path, min(replace(path, '.ts', '.go')) AS target, count(*) AS n_files FROM parts GROUP BY 1")
def res12_go_packages(s, d):
    p = ad.part_files(s, d).select(F.replace("path", F.lit(".ts"), F.lit(".go")).alias("path"))
    return resolve.go_packages(p, "m")


@query()
def ext5_python_imports(s, d):
    doc = ad.table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.format_string("\nimport os, m%d\nfrom .a import b\nfrom x import *\n", F.col("doc_id"))).alias("content"))
    return extract.extracted(doc, "python")


@query(FS + " SELECT path FROM files WHERE c_custkey % 5 > 0")
def src3_sources(s, d):
    f = ad.customer_files(s, d).select(F.concat(F.when(F.col("c_custkey") % 5 == 0, "node_modules/").otherwise(""), "path", F.lit(".ts")).alias("path"))
    return scan.sources(f).select(F.replace("path", F.lit(".ts"), F.lit("")).alias("path"))


@query("""SELECT page_id, CASE page_id % 11 WHEN 1 THEN 'absolute-path' WHEN 2 THEN 'absolute-path' WHEN 4 THEN 'traversal' WHEN 5 THEN 'traversal' WHEN 6 THEN 'traversal' WHEN 8 THEN 'absolute-path' WHEN 9 THEN 'traversal' WHEN 10 THEN 'path-too-long' END AS reason FROM pages""")
def src7_valid_paths(s, d):
    n = F.col("page_id").cast("string")
    forms = [F.concat(F.lit("a/p"), n), F.concat(F.lit("/p"), n), F.lit("C:\\x"), F.lit("C:x"), F.lit("a/.."), F.lit("."), F.concat(F.lit("../"), n), F.lit("a/./b/../c"), F.lit("\\\\server\\x"), F.lit(""), F.repeat(F.lit("a/"), 3000)]
    path = F.element_at(F.array(*forms), (F.col("page_id") % 11 + 1).cast("int"))
    return ad.table(s, d, "pages").select("page_id", paths.valid_path(path).alias("reason"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'binary' WHEN 2 THEN 'binary' WHEN 3 THEN 'empty' WHEN 4 THEN 'invalid-encoding' ELSE CASE WHEN length(coalesce(text, '')) = 0 THEN 'empty' ELSE 'text' END END AS kind FROM documents")
def src9_sniff(s, d):
    whole = F.coalesce("text", F.lit("")).cast("binary")
    escapes, nul, broken = F.unhex(F.lit("1B" * 20 + "616263")), F.concat(F.unhex(F.lit("00")), whole), F.unhex(F.lit("FFFE" * 10 + "6162"))
    which = F.col("doc_id") % 5
    body = F.when(which == 1, nul).when(which == 2, escapes).when(which == 3, F.unhex(F.lit(""))).when(which == 4, broken).otherwise(whole)
    return ad.table(s, d, "documents").select("doc_id", scan.sniff(body).alias("kind"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src13_json(s, d):
    return ad.table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


# --- state and time -----------------------------------------------------------------------------------------


@query()
def st1_rate_limit(s, d):
    e = ad.table(s, d, "events").select(F.col("user_id").cast("string").alias("client"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))
    return limits.limited_batch(e, (limits.Rule("hour", 3_600_000, 2),))


NOW = "TIMESTAMP '1996-06-01 00:00:00'"


@query(f"SELECT o_orderkey, strftime(due, '%Y-%m-%d') AS expires_at, expired FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 7 DAY WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 30 DAY END AS due, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 7 DAY WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 30 DAY END <= {NOW}, FALSE) AS expired FROM orders)")
def st6_expiry(s, d):
    o = ad.table(s, d, "orders")
    choice = F.when(F.col("o_orderkey") % 3 == 0, "7d").when(F.col("o_orderkey") % 3 == 1, "30d").otherwise("manual")
    at = retention.expires_at(F.col("o_orderdate"), choice)
    return o.select("o_orderkey", F.date_format(at, "yyyy-MM-dd").alias("expires_at"), retention.is_expired(at, F.expr(NOW)).alias("expired"))


@query("SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS expiry_day FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-01'")
def st7_sweep(s, d):
    o = ad.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("expiry_day"))
    return retention.sweep(o, F.to_date(F.lit("1996-06-01"))).withColumn("expiry_day", F.col("expiry_day").cast("string"))


@query("SELECT 'p' || event_id AS path, 'fatal' AS severity, CASE event_type WHEN 'error' THEN 'timeout' ELSE 'unreadable' END AS reason, props AS message FROM events WHERE event_type IN ('error', 'click')")
def st10_events_as_errors(s, d):
    e = ad.table(s, d, "events")
    kind = F.when(F.col("event_type") == "error", "resource").when(F.col("event_type") == "click", "path").otherwise("other")
    return retention.as_parse_errors(e.select(kind.alias("type"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"), F.col("props").alias("detail")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '1.2.3.4' ELSE 'unknown-client' END AS client FROM events")
def st10b_client_key(s, d):
    which = F.col("event_id") % 3
    forwarded = F.when(which == 0, F.concat(F.lit(" "), "event_type", F.lit(", proxy"))).when(which == 1, " , proxy")
    return ad.table(s, d, "events").select("event_id", limits.client_key(forwarded, F.when(which == 2, "  ").otherwise(" 1.2.3.4 ")).alias("client"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def extra_windowed_counts(s, d):
    w = retention.windowed_counts(ad.table(s, d, "events"), "ts", "event_type", "1 hour")
    return w.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


# --- stored analyses, evidence, figures ---------------------------------------------------------------------


@query("SELECT 'src/' || p_partkey || '.ts' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'bad ' || p_partkey || '; worse' END AS message FROM part UNION ALL SELECT 'zip/' || event_id, props FROM events WHERE event_type = 'error'")
def ext12_errors_and_events(s, d):
    """Files of which a third have two errors, with the messages of events: errors are joined, events follow, files without errors have none."""
    n = F.col("p_partkey").cast("string")
    message = F.struct(F.concat(F.lit("bad "), n).alias("message"))
    errors = F.when(F.col("p_partkey") % 3 == 0, F.array(message, F.struct(F.lit("worse").alias("message")))).otherwise(F.array().cast("array<struct<message:string>>"))
    none = F.array().cast("array<string>")
    x = ad.table(s, d, "part").select(F.concat(F.lit("src/"), n, F.lit(".ts")).alias("path"), F.lit(1).alias("line_count"), none.alias("imports"), none.alias("external_imports"), errors.alias("errors"))
    events = ad.table(s, d, "events").where("event_type = 'error'").select(F.concat(F.lit("zip/"), F.col("event_id").cast("string")).alias("path"), F.col("props").alias("detail"))
    return extracted.path_files(x).select("path", F.lit(None).cast("string").alias("message")).unionByName(extracted.with_events(extracted.parse_errors(x), events))


@query("""SELECT 'e' || event_id AS path, CASE WHEN event_id % 4 = 0 THEN 'heuristic' ELSE 'verified' END AS confidence,
CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN 'No imports could be read from this file' ELSE 'Some imports may be missing' END || ' — the file has a syntax error.|' ||
 CASE WHEN event_id % 8 = 0 THEN 'No imports could be read from this file' ELSE 'Some imports may be missing' END || ' — the file could not be fully analysed.' ELSE '' END AS because,
CASE WHEN event_id % 5 = 0 THEN './a ./b' ELSE '' END AS unresolved, CAST(event_id % 3 AS INTEGER) AS derived_from FROM events""")
def p4_file_evidence(s, d):
    e = ad.table(s, d, "events").select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"))
    files = e.select("path", F.when(F.col("event_id") % 4 == 0, "heuristic").otherwise("verified").alias("origin"), F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), (F.col("event_id") % 3).cast("int")).alias("derived_from"))
    bad = e.where("event_id % 4 = 0").withColumn("severity", F.when(F.col("event_id") % 8 == 0, "fatal").otherwise("partial"))
    errors = bad.select("path", "severity", F.lit("odd").alias("reason"), F.lit(2).alias("nth")).unionByName(bad.select("path", "severity", F.lit("syntax").alias("reason"), F.lit(1).alias("nth")))
    loose = e.where("event_id % 5 = 0").select("path", F.explode(F.array(F.lit("./b"), F.lit("./a"), F.lit("./b"))).alias("specifier"))
    got = confidence.file_evidence(files, errors, loose)
    return got.select("path", "confidence", F.array_join("reduced_because", "|").alias("because"), F.array_join("unresolved", " ").alias("unresolved"), "derived_from")


@query("SELECT DISTINCT 'o' || l_orderkey || '->?./s' || l_suppkey AS id, 'unknown' AS confidence FROM lineitem")
def v4_stub_ids(s, d):
    line = ad.table(s, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), F.concat(F.lit("./s"), F.col("l_suppkey").cast("string")).alias("specifier"))
    return confidence.unresolved_stubs(line).select("id", "confidence")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 230 WHEN 1 THEN 220 ELSE 190 END AS width,
CAST(CASE c_custkey % 3 WHEN 0 THEN 86 WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 104.5 ELSE 86 END ELSE 67.5 END + CASE WHEN c_custkey % 5 < 2 THEN 20.5 ELSE 0 END AS DOUBLE) AS height FROM customer""")
def v5_boxes(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("file", "folder", "unresolved"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    known = F.element_at(F.array(*map(F.lit, ("heuristic", "unknown", "verified", "derived", "verified"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return ad.table(s, d, "customer").select("c_custkey", measures.box_width(kind).alias("width"), measures.box_height(kind, known, F.col("c_custkey") % 2 == 0).alias("height"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name ELSE left(p_name, 4) || '…' || right(p_name, 3) END AS middle, CASE WHEN length(p_name) <= 5 THEN p_name ELSE left(p_name, 4) || '…' END AS tail,
CASE WHEN p_partkey < 1000 THEN CAST(p_partkey AS VARCHAR) ELSE regexp_replace(printf('%.1f', CASE WHEN p_partkey % 1000 IN (250, 750) THEN (p_partkey + 50) / 1000 ELSE p_partkey / 1000 END), '\\.0$', '') || 'k' END AS n FROM part""")
def m1_text_measures(s, d):
    p = ad.table(s, d, "part")
    return p.select("p_partkey", measures.truncate_middle(F.col("p_name"), 8).alias("middle"), measures.truncate_end(F.col("p_name"), 5).alias("tail"), measures.format_count(F.col("p_partkey")).alias("n"))


@query(PE + """ SELECT a.path AS subject, count(e.dst) AS n, CASE WHEN count(e.dst) > 0 THEN 'Node ' || chr(39) || a.path || chr(39) || ' has ' || count(e.dst) || ' outgoing neighbor(s).' END AS claim, count(e.dst) = 0 AS uncertain
FROM parts a LEFT JOIN (SELECT DISTINCT src, dst FROM pedges) e ON e.src = a.path GROUP BY a.path""")
def g10_neighbor_answers(s, d):
    p, e = ad.part_files(s, d), ad.part_edges(s, d)
    got = evidence.answered("neighbors-outgoing", p.select(F.col("path").alias("subject")), e.select(F.col("src").alias("subject"), F.col("dst").alias("id")))
    return got.select("subject", F.size("value").cast("long").alias("n"), "claim", "uncertain")


@query(PE.replace("WITH", "WITH RECURSIVE", 1) + PDEG + """, me AS (SELECT path FROM parts WHERE p_partkey = 1), up AS (SELECT path AS node FROM me UNION SELECT src FROM up JOIN pedges ON dst = node)
SELECT path, (SELECT count(DISTINCT dst) FROM pedges WHERE src = me.path) AS imports, (SELECT count(DISTINCT src) FROM pedges WHERE dst = me.path) AS imported_by,
(SELECT count(*) FROM up WHERE node <> me.path AND node NOT IN (SELECT src FROM pedges WHERE dst = me.path)) AS indirect, (SELECT count(*) + 1 FROM pdeg WHERE in_degree > (SELECT in_degree FROM pdeg x WHERE x.path = me.path)) AS rank, (SELECT count(*) FROM parts) AS of FROM me""")
def x4_file_facts(s, d):
    p = ad.part_files(s, d)
    return evidence.file_facts(p, ad.part_edges(s, d), p.where("p_partkey = 1").first()["path"])


@query("SELECT c_custkey, c_custkey % 2 = 0 AS owned FROM customer")
def st9_owner_tokens(s, d):
    c = ad.table(s, d, "customer")
    kept = F.when(F.col("c_custkey") % 2 == 0, store.owner_hash(F.col("c_name"))).when(F.col("c_custkey") % 3 == 0, F.upper(store.owner_hash(F.col("c_name")))).otherwise(store.owner_hash(F.lit("another")))
    return c.select("c_custkey", store.owns(F.col("c_name"), kept).alias("owned"))


@query("""WITH v AS (SELECT user_id AS owner, event_type AS kind, event_id % 17 AS id, max(event_id) AS nth FROM events GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY nth DESC) AS back FROM v)
SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY nth) AS step, kind, id FROM r WHERE back <= 12""")
def pos2_trail(s, d):
    e = ad.table(s, d, "events")
    return retention.trail(e.select(F.col("user_id").alias("owner"), F.col("event_type").alias("kind"), (F.col("event_id") % 17).alias("id"), F.col("event_id").alias("nth")))


@query(FS + " SELECT path, line_count, '00000000-0000-0000-0000-00000000000' || (c_custkey % 3) AS analysis_id FROM files WHERE c_custkey % 3 > 0 UNION ALL SELECT path, line_count, 'alone' FROM files WHERE c_custkey % 3 = 1")
def snk1_store(s, d):
    """Two analyses saved and read back: both, and one by its id. The store's folder is one of the session's shared folder."""
    kept = store.Store(s, f"{fixpoint.shared_dir(s)}/store-{uuid.uuid4().hex}")
    f = ad.customer_files(s, d)
    ids = {k: f"00000000-0000-0000-0000-00000000000{k}" for k in (1, 2)}
    for k, name in ids.items():
        kept.save(name, files=f.where(F.col("c_custkey") % 3 == k).select("path", "line_count"))
    alone = kept.load(ids[1], "files").withColumn("analysis_id", F.lit("alone"))
    return kept.load_all("files").select("path", "line_count", "analysis_id").unionByName(alone)


# --- many repositories ------------------------------------------------------------------------------------


def repositories(s: SparkSession, d: str) -> DataFrame:
    """(repo_id, path, content): the documents of a source as a repository of scripts, Python and Go files that hold the whole texts as comments.

    A file imports the one three documents before it and what is nowhere; some scripts lack a brace, some files can't be read.
    """
    doc = ad.table(s, d, "documents").select("doc_id", "source", "text").where("doc_id is not null")
    n, before = F.col("doc_id").cast("string"), F.when(F.col("doc_id") >= 3, (F.col("doc_id") - 3).cast("string")).otherwise("none")
    text = F.coalesce("text", F.lit(""))
    script = F.concat(F.lit("/* "), F.replace(text, F.lit("*/"), F.lit("* /")), F.lit(' */\nimport { a } from "./d'), before, F.lit('";\nimport "react";\nexport function f() { return `${require("./gone")}`; '), F.when(F.col("doc_id") % 13 == 7, "").otherwise("}"), F.lit("\n"))
    hashed = F.concat(F.lit("# "), F.regexp_replace(text, r"[\x00\r\n\f]", "\n# "))
    python = F.concat(hashed, F.lit("\nimport os, pkg.d"), before, F.lit("\nclass C:\n    def m(self):\n        pass\n"))
    slashed = F.concat(F.lit("// "), F.regexp_replace(text, r"\n", "\n// "))
    go = F.concat(slashed, F.lit('\npackage p\nimport (\n  "fmt"\n  "m/g'), before, F.lit('"\n)\nfunc F() {}\n'))
    kind = F.col("doc_id") % 3
    path = F.when(kind == 0, F.concat(F.lit("src/d"), n, F.lit(".ts"))).when(kind == 1, F.concat(F.lit("pkg/d"), n, F.lit(".py"))).otherwise(F.concat(F.lit("g"), n, F.lit("/m.go")))
    body = F.when(F.col("doc_id") % 11 != 5, F.when(kind == 0, script).when(kind == 1, python).otherwise(go))
    repo = F.coalesce("source", F.lit("?")).alias("repo_id")
    mod = doc.select(repo).distinct().select("repo_id", F.lit("go.mod").alias("path"), F.lit("module m\n").alias("content"))
    return doc.select(repo, path.alias("path"), body.alias("content")).unionByName(mod)


REPOS = """WITH f AS (SELECT doc_id AS n, coalesce(source, '?') AS repo_id, doc_id % 3 AS k, CASE doc_id % 3 WHEN 0 THEN 'src/d' || doc_id || '.ts' WHEN 1 THEN 'pkg/d' || doc_id || '.py' ELSE 'g' || doc_id || '/m.go' END AS path,
  doc_id % 11 = 5 AS lost, doc_id % 3 = 0 AND doc_id % 13 = 7 AS broken, text FROM documents WHERE doc_id IS NOT NULL),
sound AS (SELECT * FROM f WHERE NOT lost AND NOT broken), near AS (SELECT a.*, b.path AS target, b.lost OR b.broken AS bad FROM sound a LEFT JOIN f b ON a.repo_id = b.repo_id AND a.n - 3 = b.n)"""


@query(REPOS + """ SELECT repo_id, 'node' AS kind, path AS a, CASE k WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'go' END AS b FROM sound UNION ALL SELECT repo_id, 'edge', path, target FROM near WHERE target IS NOT NULL AND NOT bad
UNION ALL SELECT repo_id, 'error', path, CASE WHEN lost THEN 'Unable to read file' ELSE chr(39) || '}' || chr(39) || ' expected.' END FROM f WHERE lost OR broken UNION ALL SELECT repo_id, 'unresolved', path, './gone' FROM sound WHERE k = 0
UNION ALL SELECT repo_id, 'unresolved', path, CASE k WHEN 0 THEN './d' WHEN 1 THEN 'pkg.d' ELSE 'm/g' END || CASE WHEN n >= 3 THEN CAST(n - 3 AS VARCHAR) ELSE 'none' END FROM near WHERE target IS NULL
UNION ALL SELECT repo_id, 'external', path, CASE k WHEN 0 THEN 'react' WHEN 1 THEN 'os' ELSE 'fmt' END FROM sound
UNION ALL SELECT repo_id, 'declaration', path, unnest(CASE k WHEN 0 THEN ['function f'] WHEN 1 THEN ['class C', 'method C.m'] ELSE ['function F'] END) FROM f WHERE NOT lost""")
def ext1_analysis(s, d):
    """Whole texts of many repositories to stored nodes, edges, errors and what is left over."""
    a = analysis.analyze(repositories(s, d))
    kept = store.Store(s, f"{fixpoint.shared_dir(s)}/analyses-{uuid.uuid4().hex}")
    key = str(uuid.uuid4())
    kept.save(key, nodes=a.nodes, edges=a.edges, errors=a.errors)
    part = lambda df, kind, x, y: df.select("repo_id", kind.alias("kind"), F.col(x).alias("a"), y.alias("b"))
    out = part(kept.load(key, "nodes"), F.lit("node"), "path", F.col("language")).unionByName(part(kept.load(key, "edges"), F.lit("edge"), "src", F.col("dst")))
    out = out.unionByName(part(kept.load(key, "errors"), F.lit("error"), "path", F.col("message")))
    out = out.unionByName(part(a.imports.where("status in ('unresolved', 'external')"), F.col("status"), "path", F.col("specifier")))
    return out.unionByName(part(a.declarations, F.lit("declaration"), "path", F.concat_ws(" ", "kind", "qualified_name")))


@query(REPOS + """, e AS (SELECT repo_id, path AS src, target AS dst FROM near WHERE target IS NOT NULL AND NOT bad), deg AS (SELECT s.repo_id, s.path, count(e.src) AS i FROM sound s LEFT JOIN e ON e.repo_id = s.repo_id AND e.dst = s.path GROUP BY 1, 2),
lim AS (SELECT repo_id, count(*) AS n, quantile_disc(i, 0.95) AS p FROM deg GROUP BY repo_id)
SELECT repo_id, path, i AS in_degree, (SELECT count(*) FROM e WHERE e.repo_id = deg.repo_id AND e.src = deg.path) AS out_degree, CASE WHEN n < 20 THEN i > 15 ELSE i >= p AND i > 0 END AS is_hub, i = 0 AS is_orphan FROM deg JOIN lim USING (repo_id)""")
def a4_repository_observations(s, d):
    """Degrees, hubs and orphans, each repository by its own threshold."""
    return analysis.observations(analysis.analyze(repositories(s, d)))


@query("""SELECT repo_id, root, confidence, package_name FROM (SELECT DISTINCT 'r' || page_id % 5 AS repo_id, page_id % 5 AS k FROM pages)
JOIN (VALUES (0, 'lib', 'declared', 'p'), (1, 'python', 'declared', NULL), (2, 'src', 'structural-heuristic', NULL), (3, '', 'structural-heuristic', NULL), (4, '', 'declared', NULL)) v(k, root, confidence, package_name) USING (k)""")
def res10_import_roots(s, d):
    """Five repositories' manifests beside the pages as files: a declared table, setup.cfg with a continued line, a guess, none, and a flat layout."""
    p = ad.table(s, d, "pages")
    repo = F.concat(F.lit("r"), (F.col("page_id") % 5).cast("string"))
    lead = F.element_at(F.array(*map(F.lit, ("lib/", "python/", "src/", "other/", "lib/"))), (F.col("page_id") % 5 + 1).cast("int"))
    files = p.select(repo.alias("repo_id"), F.concat(lead, F.lit("m"), F.col("page_id").cast("string"), F.lit(".py")).alias("path"))
    said = [("r0", "pyproject.toml", '[project]\nname = "p"\n[tool.setuptools.packages.find]\nwhere = ["gone", "lib"]\n'), ("r1", "setup.cfg", "[options]\npackage_dir =\n    = python\n"), ("r1", "pyproject.toml", "broken = ["), ("r4", "pyproject.toml", '[tool.flit.module]\nname = "m"\n')]
    return resolve.import_roots(files, s.createDataFrame(said, "repo_id string, path string, content string"))


@query("""SELECT 'main.py' AS path, 'n' || k % 50 || '.s' || k % 3 || '.m' || k || CASE WHEN k % 2 = 0 THEN '.f' ELSE '' END AS specifier, CASE WHEN k % 3 > 0 THEN 'n' || k % 50 || '/s' || k % 3 || '/m' || k || '.py' END AS target,
CASE WHEN k % 3 > 0 THEN 'internal' WHEN k % 50 < 25 THEN 'unresolved' ELSE 'external' END AS status FROM (SELECT c_custkey AS k FROM customer)""")
def res9_namespaces(s, d):
    """Modules in namespace packages; names of missing ones are unresolved where the first part is a package with files of its own, else external."""
    k = ad.table(s, d, "customer").select("c_custkey")
    part = lambda m: (F.col("c_custkey") % m if m else F.col("c_custkey")).cast("string")
    stem = F.concat(F.lit("n"), part(50), F.lit("/s"), part(3), F.lit("/m"), part(None))
    files = k.where("c_custkey % 3 > 0").select(F.concat(stem, F.lit(".py")).alias("path"))
    tops = k.where("c_custkey % 50 < 25").select(F.concat(F.lit("n"), part(50), F.lit("/top.py")).alias("path")).distinct()
    listing = files.unionByName(tops).unionByName(s.createDataFrame([("main.py",)], "path string"))
    imports = k.select(F.lit("main.py").alias("path"), F.concat(F.replace(stem, F.lit("/"), F.lit(".")), F.when(F.col("c_custkey") % 2 == 0, ".f").otherwise("")).alias("specifier"))
    return resolve.resolve_python(imports, resolve.python_modules(listing))


@query("""WITH RECURSIVE b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 7 THEN 2 * c_custkey WHEN c_custkey > 1 THEN c_custkey // 2 END AS up FROM customer),
walk AS (SELECT k, up, 0 AS n FROM b WHERE up IS NOT NULL UNION ALL SELECT walk.k, b.up, n + 1 FROM walk JOIN b ON b.k = walk.up WHERE b.up IS NOT NULL AND n < 64)
SELECT 'parent-cycle' AS rule, 'folder:c' || k AS subject FROM walk WHERE n = 64 UNION ALL SELECT 'missing-parent', 'folder:c' || k FROM b WHERE up NOT IN (SELECT k FROM b)
UNION ALL SELECT 'unordered-members', 'folder:c' || c_custkey FROM customer WHERE c_custkey % 90 = 1 UNION ALL SELECT 'duplicate-member', 'folder:c' || c_custkey FROM customer WHERE c_custkey % 90 = 2 UNION ALL SELECT 'unknown-member', 'folder:c' || c_custkey FROM customer WHERE c_custkey % 90 = 3""")
def c13_parent_cycles(s, d):
    """Customers as folders under half their number; some lie under twice it, and so in a circle; and members of each wrong kind."""
    c, k = ad.table(s, d, "customer"), F.col("c_custkey")
    up = F.when(k % 50 == 7, 2 * k).when(k > 1, F.floor(k / 2).cast("long"))
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    members = F.when(k % 90 == 1, F.array(F.lit("b"), F.lit("a"))).when(k % 90 == 2, F.array(F.lit("a"), F.lit("a"))).when(k % 90 == 3, F.array(F.lit("a"), F.lit("x"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    rows = c.select(F.lit("folder").alias("kind"), name(k).alias("path"), name(up).alias("parent"), F.lit(2).cast("long").alias("n_files"), members.alias("contained"))
    return boundaries.boundary_violations(rows, s.createDataFrame([("a",), ("b",)], "path string"))


@query(O + """, f AS (SELECT path, CASE WHEN path LIKE 'lib/%' THEN 'lib' ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS folder FROM nodes), reg AS (SELECT min(folder) AS folder FROM f WHERE folder <> 'lib'),
own AS (SELECT path FROM f WHERE folder = (SELECT folder FROM reg)), deg AS (SELECT path, (SELECT count(*) FROM edges WHERE src = path) + (SELECT count(*) FROM edges WHERE dst = path) AS d FROM own),
rk AS (SELECT path, row_number() OVER (ORDER BY d DESC, path) AS r, count(*) OVER () AS n FROM deg), m AS (SELECT path, CASE WHEN n <= 32 OR r <= 31 THEN 'f:' || path ELSE 'u:#overflow' END AS unit FROM rk),
x AS MATERIALIZED (SELECT a.folder AS ff, b.folder AS tf, u.unit AS fu, v.unit AS tu FROM edges JOIN f a ON src = a.path JOIN f b ON dst = b.path LEFT JOIN m u ON u.path = src LEFT JOIN m v ON v.path = dst)
SELECT coalesce(fu, 'b:in:' || ff) AS source, coalesce(tu, 'b:out:' || tf) AS target, count(*) AS n FROM x WHERE ff = (SELECT folder FROM reg) OR tf = (SELECT folder FROM reg) GROUP BY 1, 2 UNION ALL SELECT unit, 'u:#unresolved', count(*) FROM m WHERE length(path) % 4 = 0 GROUP BY unit""")
def d6_region_figure(s, d):
    """The first nation's orders: the best connected ones, the rest together, and what leads in and out of the nation."""
    nodes, edges = chains(s, d)
    top = F.split("path", "/")
    files = nodes.select("path", F.when(F.col("path").startswith("lib/"), "lib").otherwise(F.concat_ws("/", top[0], top[1])).alias("folder"))
    first = files.where("folder <> 'lib'").agg(F.min("folder")).first()[0]
    loose = nodes.where("length(path) % 4 = 0").select("path", F.lit("./gone").alias("specifier"))
    return diagram.region_figure(files, edges, first, loose)[2]


@query(O + f" SELECT path, line_count FROM nodes WHERE path IN (SELECT dst FROM edges WHERE src = {FIRST})")
def g4_outgoing(s, d):
    nodes, edges = chains(s, d)
    return graph.neighbors(nodes, edges, first_path(nodes), "outgoing")


@query("""SELECT doc_id AS id, doc_id % 4 <> 3 AS ok, CASE WHEN doc_id % 4 <> 3 THEN 'about ' || doc_id END AS answer, CASE WHEN doc_id % 4 = 2 THEN '' WHEN doc_id % 4 <> 3 THEN 'node:n' || doc_id END AS cited, CASE WHEN doc_id % 4 = 1 THEN 1 WHEN doc_id % 4 <> 3 THEN 0 END AS n_steps FROM documents""")
def x9a_parsed_answers(s, d):
    """Answers made of documents' numbers and whole texts: fenced, with words around, with parts of wrong kinds, and without an object."""
    doc = ad.table(s, d, "documents")
    n, which = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    quoted = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))
    node = F.concat(F.lit('{"kind": "node", "id": "n'), n, F.lit('"}'))
    body = F.concat(
        F.lit('{"summary": " about '), n, F.lit(' ", "claims": [7, {"text": "x", "citations": ['), F.when(which == 2, F.lit('{"kind": "guess", "id": "z"}, 3')).otherwise(node),
        F.lit(']}], "readingOrder": ['), F.when(which == 1, F.lit('{"id": "a", "reason": "b"}, {"id": "c"}')).otherwise(F.lit('"a"')), F.lit('], "more": '), quoted, F.lit("}"),
    )
    text = F.when(which == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(which == 1, F.concat(F.lit("Here it is:\n"), body, F.lit(" That is all."))).when(which == 2, body).otherwise(F.concat(F.lit("no object in ["), n, F.lit("]")))
    got = evidence.parsed_answers(doc.select(F.col("doc_id").alias("id"), text.alias("text")))
    cited = F.array_join(F.transform(F.flatten(F.transform("claims", lambda c: c["citations"])), lambda c: F.concat(c["kind"], F.lit(":"), c["id"])), " ")
    return got.select("id", "ok", "answer", cited.alias("cited"), F.when(F.col("ok"), F.size("reading_order")).alias("n_steps"))
