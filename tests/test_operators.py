"""Operators on small fixtures with known results."""

import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import identity, paths, texts
from weftgraph.operators import boundaries, cluster, confidence, cycles, diagram, entrypoints, evidence, graph, ir, reach, registry, resolve, search, tour
from weftgraph.plans import fixpoint
from weftgraph.sources import extract, scan
from weftgraph.streaming import limits, retention


def files_of(spark, spec):
    return spark.createDataFrame([(p, 10, list(i)) for p, i in spec.items()], "path string, line_count long, imports array<string>")


def graph_of(spark, spec):
    f = files_of(spark, spec)
    return f.select("path", "line_count"), graph.build_graph(f)


def col(df, name="path"):
    return sorted(r[name] for r in df.collect())


@pytest.fixture(scope="module")
def abc(spark):
    return graph_of(spark, {"a": ["b"], "b": ["a", "c", "gone"], "c": []})


def test_point_queries(spark, abc):
    nodes, edges = abc
    assert sorted(r.id for r in edges.collect()) == ["a->b", "b->a", "b->c"]
    assert col(graph.neighbors(nodes, edges, "b")) == ["a", "c"] and col(graph.neighbors(nodes, edges, "a", "incoming")) == ["b"]
    assert col(graph.neighbors(nodes, edges, "b", "both")) == ["a", "c"] and graph.neighbors(nodes, edges, "x").count() == 0
    assert col(graph.impact(nodes, edges, "c")) == ["a", "b"] and col(graph.impact(nodes, edges, "a")) == ["b"] and graph.impact(nodes, edges, "x").count() == 0
    assert [r.path for r in graph.neighbors(*graph_of(spark, {"m": ["B", "a-b", "_z", "a", "b"], "B": [], "a-b": [], "_z": [], "a": [], "b": []}), "m", collation="UNICODE").collect()] == ["_z", "a", "a-b", "b", "B"]


def test_cycles(spark, abc):
    one = F.lit("r").alias("repo_id")
    nodes, edges = abc
    got = cycles.find_cycles(nodes.select(one, "path"), edges.select(one, "src", "dst")).collect()
    assert [list(r.cycle) for r in got] == [["a", "b", "a"]]
    assert cycles.find_cycles(nodes.select(one, "path"), edges.where("src = 'b' and dst = 'c'").select(one, "src", "dst")).count() == 0
    spin = spark.createDataFrame([(["c", "a", "b"],), (["b", "c", "a"],)], "c array<string>")
    assert {r.x for r in spin.select(cycles.canonical(F.col("c")).alias("x")).collect()} == {"a\x00b\x00c"}


def test_impacts_within_repositories(spark):
    rng = random.Random(8)
    rows = [(r, f"n{rng.randrange(12)}", f"n{rng.randrange(14)}") for r in "xyz" for _ in range(14)]
    nodes = spark.createDataFrame([(r, f"n{i}") for r in "xyz" for i in range(12)], "repo_id string, path string")  # n12 and n13 are unknown
    edges = spark.createDataFrame(rows, "repo_id string, src string, dst string")
    asked = spark.createDataFrame([(r, f"n{i}") for r in "xy" for i in range(14)] + [("z", "n0")], "repo_id string, subject string")
    got = {(r.repo_id, r.subject, r.path) for r in cycles.impacts(nodes, edges, asked).collect()}
    want = set()
    for r, s in [(r, f"n{i}") for r in "xy" for i in range(12)] + [("z", "n0")]:
        seen = {s}
        for _ in range(12):
            seen |= {a for q, a, b in rows if q == r and b in seen and int(b[1:]) < 12}
        want |= {(r, s, p) for p in seen - {s}}
    assert got == want and len(want) > 30
    one = nodes.where("repo_id = 'x'").select("path")
    by_rounds = {r.path for r in graph.impact(one, edges.where("repo_id = 'x' and dst not in ('n12', 'n13')"), "n3").collect()}
    assert by_rounds == {p for r, s, p in got if (r, s) == ("x", "n3")}


def test_fixpoints_against_brute_force(spark):
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(9)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(11)})
    nodes, edges = spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(pairs, "src string, dst string")
    out = {n: {n} for n in names}
    und = {n: {n} for n in names}
    for _ in names:
        for a, b in pairs:
            for n in names:
                if a in out[n]:
                    out[n].add(b)
                if a in und[n] or b in und[n]:
                    und[n] |= {a, b}
    assert {(r.seed, r.node) for r in fixpoint.reachable(edges, nodes).collect()} == {(n, m) for n in names for m in out[n]}
    assert {(r.node, r.component) for r in fixpoint.components(nodes, edges).collect()} == {(n, min(und[n])) for n in names}
    strong = {n: min(m for m in out[n] if n in out[m]) for n in names}
    assert {(r.node, r.component) for r in fixpoint.strong_components(nodes, edges).collect()} == set(strong.items())
    assert {(r.src, r.dst) for r in fixpoint.closure(edges).collect()} == {(a, m) for a, b in pairs for m in out[b]} | {(n, m) for n in names for b in [y for x, y in pairs if x == n] for m in out[b]}


def test_small_graphs_have_a_fixed_hub_threshold(spark):
    d = spark.createDataFrame([("a", 15, 0), ("b", 16, 0), ("c", 0, 0)], "path string, in_degree long, out_degree long")
    assert col(graph.hubs(d)) == ["b"]


CLUSTERS = [
    ({"lib/analysis": 20, "lib/ai": 6, "lib/safety": 8, "lib/tiny": 1, "lib": 1}, {"lib": 2, "lib/ai": 6, "lib/analysis": 20, "lib/safety": 8}),
    ({"lib/core": 40, "lib/x": 1}, {"lib": 41}),
    ({"lib/analysis/parsers": 18, "lib/analysis/ir": 16, "lib/ai": 5}, {"lib/ai": 5, "lib/analysis/ir": 16, "lib/analysis/parsers": 18}),
    ({"lib/core/a": 16, "lib/core/b": 16}, {"lib/core/a": 16, "lib/core/b": 16}),
    ({"src": 31, "src/ui": 4}, {"src": 31, "src/ui": 4}),
    ({"": 3, "tools": 1, "lib": 4}, {"lib": 4, "other": 1, "root": 3}),
]


@pytest.mark.parametrize("folders, want", CLUSTERS)
def test_adaptive_clusters(spark, folders, want):
    rows = [(f"{f}/f{i:02d}.ts" if f else f"f{i:02d}.ts",) for f, n in folders.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    got = cluster.adaptive_clusters(spark.createDataFrame(rows, "path string"))
    assert {r.folder: r["count"] for r in got.groupBy("folder").count().collect()} == want and got.select("path").distinct().count() == len(rows)


@pytest.mark.parametrize(
    "spec, entries, want",
    [
        ({"a.ts": ["b.ts"], "b.ts": ["c.ts"], "c.ts": [], "island.ts": []}, ["a.ts"], ["island.ts"]),
        ({"a.ts": ["b.ts"], "b.ts": ["a.ts"], "x.ts": ["y.ts"], "y.ts": ["x.ts"]}, ["a.ts"], ["x.ts", "y.ts"]),
        ({"a.ts": [], "b.ts": []}, [], []),
        ({"a.ts": [], "b.ts": []}, ["gone.ts"], []),
        ({"a.ts": [], "t.d.ts": []}, ["a.ts"], []),
        ({"p/q/m.py": [], "p/__init__.py": [], "p/q/__init__.py": [], "other/__init__.py": []}, ["p/q/m.py"], ["other/__init__.py"]),
        ({"m/a.go": [], "m/b.go": [], "other/c.go": []}, ["m/a.go"], ["other/c.go"]),
    ],
)
def test_reachability(spark, spec, entries, want):
    nodes, edges = graph_of(spark, spec)
    e = spark.createDataFrame([(x,) for x in entries], "path string")
    assert col(reach.unreachable(nodes, edges, e)) == want


def test_caveats():
    assert reach.caveats(0, 3, 2, [("Nuxt", "")], [("./*", "src/*")]) == []
    got = reach.caveats(4, 1, 2, [("Nuxt", ""), ("Astro", "web")], [("./*", "src/*")])
    assert len(got) == 5 and "1 file computes" in got[0] and "web/ uses Astro" in got[-1]


def test_entry_rules(spark):
    files = spark.createDataFrame([(p,) for p in ["app/page.tsx", "lib/x.ts", "src/index.ts", "vite.config.ts", "a/b.test.ts", "pkg/src/main.ts", "src/lib/api.ts", "types.d.ts", "tool/run.py", "cmd/m.go"]], "path string")
    manifests = spark.createDataFrame([("package.json", '{"main": "dist/index.js", "exports": {".": {"import": "./dist/lib/api.js"}, "./*": "./src/*"}, "types": "./types.d.ts"}'), ("broken/package.json", "{")], "path string, content string")
    contents = spark.createDataFrame([("tool/run.py", 'x = 1\nif __name__ == "__main__":\n    pass'), ("cmd/m.go", "package main\n")], "path string, content string")
    roots = spark.createDataFrame([("", 0), ("pkg", 1)], "root string, nth int")
    got = {r.path: r.reason for r in entrypoints.entry_points(files, manifests, contents, roots).collect()}
    assert got == {
        "app/page.tsx": "Next.js route (app/page.tsx)", "src/index.ts": 'package.json "main"', "vite.config.ts": "config file", "a/b.test.ts": "test file",
        "pkg/src/main.ts": "conventional root file", "src/lib/api.ts": 'package.json "exports" (".")', "tool/run.py": "Python __main__ guard", "cmd/m.go": "Go package main",
    }
    assert [tuple(r) for r in entrypoints.wildcard_exports(manifests).collect()] == [("package.json", "./*", "src/*")]


def entries_of(spark, files, manifest, at="package.json"):
    f = spark.createDataFrame([(p,) for p in files], "path string")
    m = spark.createDataFrame([(at, manifest)], "path string, content string")
    return {r.path: r.reason for r in entrypoints.entry_points(f, m).collect()}


def test_manifest_fields(spark):
    # both sides of a browser map, an excluded subpath, conditions and arrays, names of package imports, a manifest further down
    assert entries_of(spark, ["lib/server.ts", "lib/client.ts"], '{"browser": {"./lib/server.js": "./lib/client.js", "fs": false}}') == {"lib/server.ts": 'package.json "browser" map', "lib/client.ts": 'package.json "browser" map'}
    got = entries_of(spark, ["src/a.js", "src/internal/y.js", "lib/z.js"], '{"exports": {"./a": {"import": ["./src/a.js"]}, "./internal/*": null, "./internal/y": "./src/internal/y.js", "./other": "./lib/z.js", "./p": "#p"}}')
    assert got == {"src/a.js": 'package.json "exports" ("./a")', "lib/z.js": 'package.json "exports" ("./other")'}
    got = entries_of(spark, ["src/internal/y.js"], '{"exports": {"./internal/*": null, "./y": "./src/internal/y.js"}}')
    assert got == {"src/internal/y.js": 'package.json "exports" ("./y")'}
    assert entries_of(spark, ["p/x/m.ts", "p/src/deep.ts"], '{"bin": {"x": "./dist/deep.js"}, "module": "x/m"}', "p/package.json") == {"p/src/deep.ts": 'p/package.json "bin"', "p/x/m.ts": 'p/package.json "module"'}
    f = spark.createDataFrame([("src/tool/cli.py",), ("tool/cli.py",), ("tool/other.py",)], "path string")
    m = spark.createDataFrame([("pyproject.toml", '[project.scripts]\ntool = "tool.cli:main"\n')], "path string, content string")
    assert {r.path: r.reason for r in entrypoints.entry_points(f, m).collect()} == {"src/tool/cli.py": "pyproject.toml script", "tool/cli.py": "pyproject.toml script"}


def test_framework_roots_and_folders(spark):
    want = {
        "src/middleware.ts": "Next.js middleware (src/middleware.ts)", "proxy.ts": "Next.js proxy (proxy.ts)", "cypress/a.ts": "test file", "bin/run.js": "script (bin/)",
        "demos/x.ts": "example or demo (demos/)", "a/__mocks__/b.ts": "test file", "a/x.test.vue": "test file",
    }
    files = spark.createDataFrame([(p,) for p in [*want, "specs/a.ts", "script/x.ts", "lib/y.ts"]], "path string")
    assert {r.path: r.reason for r in entrypoints.entry_points(files).collect()} == want


def test_typescript_resolution(spark):
    listing = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/b.tsx", "src/c/index.ts", "src/d.js", "lib/e.ts", "style.css", "src/deep/f.ts"]], "path string")
    sources = listing.where("path <> 'style.css'")
    spec = ["./b", "./c", "./d.js", "./b.js", "../style.css", "./none", "@/e", "@/deep/f", "react", "@/gone", "@/../style.css"]
    imports = spark.createDataFrame([("src/a.ts", s) for s in spec], "path string, specifier string")
    config = '{"compilerOptions": {"baseUrl": "./", // here\n "paths": {"@/*": ["lib/*"], "@/deep/*": ["src/deep/*"],}}}'
    aliases = resolve.aliases(spark.createDataFrame([("tsconfig.json", config)], "path string, content string"))
    got = {r.specifier: (r.target, r.status) for r in resolve.resolve_typescript(imports, sources, listing, aliases).collect()}
    assert got == {
        "./b": ("src/b.tsx", "internal"), "./c": ("src/c/index.ts", "internal"), "./d.js": ("src/d.js", "internal"), "./b.js": ("src/b.tsx", "internal"),
        "../style.css": (None, "asset"), "./none": (None, "unresolved"), "@/e": ("lib/e.ts", "internal"), "@/deep/f": ("src/deep/f.ts", "internal"),
        "react": (None, "external"), "@/gone": (None, "external"), "@/../style.css": (None, "external"),
    }


def test_python_and_go_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ["pkg/__init__.py", "pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/b.py", "main.py"]], "path string")
    imports = [("pkg/sub/b.py", s) for s in ["..a.name", ".c", "pkg.a", "os.path", "pkg.gone.x", "pkg.sub.Thing", "....x"]] + [("main.py", "pkg")]
    got = {r.specifier: (r.target, r.status) for r in resolve.resolve_python(spark.createDataFrame(imports, "path string, specifier string"), resolve.python_modules(files)).collect()}
    assert got["..a.name"] == ("pkg/a.py", "internal") and got["pkg.a"] == ("pkg/a.py", "internal") and got["os.path"] == (None, "external")
    assert got["pkg.sub.Thing"] == ("pkg/sub/__init__.py", "internal") and got["pkg"] == ("pkg/__init__.py", "internal")
    assert got["pkg.gone.x"] == ("pkg/__init__.py", "internal") and got["....x"][1] == "unresolved"
    bare = resolve.python_modules(spark.createDataFrame([("space/a.py",), ("main.py",)], "path string"))  # a folder without __init__.py has no file for names
    one = spark.createDataFrame([("main.py", "space.gone")], "path string, specifier string")
    assert [(r.target, r.status) for r in resolve.resolve_python(one, bare).collect()] == [(None, "unresolved")]
    go = spark.createDataFrame([(p,) for p in ["u/a.go", "u/b.go", "u/a_test.go", "main.go", "vendor/x/y.go"]], "path string")
    spec = spark.createDataFrame([("main.go", s) for s in ["ex.com/m/u", "fmt", "ex.com/m/gone"]], "path string, specifier string")
    pk = resolve.go_packages(go, "ex.com/m")
    assert {r.specifier: (r.target, r.approximate, r.status) for r in resolve.resolve_go(spec, pk, "ex.com/m").collect()} == {"ex.com/m/u": ("u/a.go", True, "internal"), "fmt": (None, False, "external"), "ex.com/m/gone": (None, False, "unresolved")}


def test_extraction():
    code = """import a from './a'; export { b } from "./b"
// import x from './no'
const s = "import y from './no'"; import type { T } from './t'
const c = require('./c'); import('./d').then(f); import e = require("./e");
import('./' + name); /re'gex/.test(s); const t = `import './no'`
import './side'
"""
    assert [s for s, _ in extract.script_imports(code)] == ["./a", "./b", "./t", "./c", "./d", "./e", "./side"]
    assert [s for s, _ in extract.python_imports("import os, a.b as c\nfrom . import x\nfrom .m import (y,\n z)\nfrom q import *\n")] == ["os", "a.b", ".x", ".m.y", ".m.z", "q"]
    assert [s for s, _ in extract.python_imports("import os\ndef broken(:\nfrom a import b\n")] == ["os", "a.b"] and len(extract.python_errors("def (:")) == 1
    assert [s for s, _ in extract.go_imports('package p\nimport "fmt"\nimport (\n a "x/y"\n // "no"\n "z"\n)\n')] == ["fmt", "x/y", "z"]
    assert [(k, q) for k, _, q, *_ in extract.python_declarations("class A:\n  def __init__(s): pass\n  def m(s): pass\ndef f(): pass\n")] == [("class", "A"), ("constructor", "A.__init__"), ("method", "A.m"), ("function", "f")]
    assert [(k, q) for k, _, q, *_ in extract.go_declarations("type S struct {}\nfunc (s *S) M() {}\nfunc F() {}\ntype I interface{}\ntype N int\n")] == [("class", "S"), ("method", "S.M"), ("function", "F"), ("interface", "I"), ("type", "N")]
    assert [(k, n) for k, n, *_ in extract.script_declarations("export function f() {}\nexport const g = (a) => a\nclass C {}\ninterface I {}\ntype T = 1\nenum E {}\nconst v = 3\n")] == [("function", "f"), ("function", "g"), ("class", "C"), ("interface", "I"), ("type", "T"), ("enum", "E")]


def test_identity(spark):
    assert identity.derive(":package.json") == "6YaJZwLmtYTJ2jMajtsls5"
    got = spark.range(1).select(identity.root_fingerprint(F.lit(""), F.lit("package.json")).alias("x")).first()["x"]
    assert got == "6YaJZwLmtYTJ2jMajtsls5"


def test_provenance_graph(spark):
    x = spark.createDataFrame(
        [("a.ts", 3, 0, ["b.ts"], [], ["react"], ["./gone"]), ("b.ts", 1, 1, ["a.ts"], [], ["react"], []), ("c.go", 1, 0, ["a.ts"], ["a.ts"], [], [])],
        "path string, line_count int, errors int, imports array<string>, approximate array<string>, externals array<string>, unresolved array<string>",
    )
    nodes, edges = ir.build(x)
    nodes, edges = nodes.cache(), edges.cache()
    assert {(r.kind, r["count"]) for r in nodes.groupBy("kind").count().collect()} == {("file", 3), ("module-root", 1), ("external-dependency", 1), ("unresolved-import", 1)}
    assert sorted((r.kind, r.origin, r["count"]) for r in edges.groupBy("kind", "origin").count().collect()) == [("contains", "derived", 3), ("imports", "derived", 3), ("imports", "heuristic", 3)]
    assert ir.violations(nodes, edges).count() == 0
    broken = ir.violations(nodes.unionByName(nodes.where("kind = 'file'").limit(1)).where("kind <> 'unresolved-import'"), edges)
    assert {r.rule for r in broken.collect()} == {"duplicate-node", "dangling-target"}
    back, links = ir.path_graph(nodes, edges)
    assert back.count() == 3 and links.count() == 3
    d = spark.createDataFrame([("a.ts", "f", 1, 1, 2, 1, 0), ("a.ts", "g", 1, 0, 9, 1, 1)], "path string, name string, start_line int, start_col int, end_line int, end_col int, nth int")
    assert {r.rule for r in ir.declaration_violations(d, x).collect()} == {"position-not-positive", "end-after-file", "out-of-order"}


def test_boundary_checks(spark):
    f = spark.createDataFrame([("lib/api/x.ts",), ("src/user/y.ts",), ("z.ts",)], "path string")
    b = boundaries.folder_boundaries(f).unionByName(boundaries.region_boundaries(f))
    assert boundaries.boundary_violations(b, f).count() == 0
    assert {r.rule for r in boundaries.boundary_violations(b.where("path <> 'lib'"), f.where("path <> 'z.ts'")).collect()} == {"missing-parent", "unknown-member"}
    got = {(r.path, r.kind): r.name for r in boundaries.inferred(f).collect()}
    assert got == {("lib/api/x.ts", "layer"): "api", ("src/user/y.ts", "layer"): "src", ("src/user/y.ts", "domain"): "user"}
    assert spark.range(1).select(boundaries.propagated(F.array(F.lit("verified"), F.lit("assisted"))).alias("x")).first()["x"] == "heuristic"


def test_search_tiers(spark):
    labels = ["bxuxixlxdxexr.ts", "ir-builder.ts", "builder.test.ts", "builder", "myBuilder.ts", "none"]
    items = spark.createDataFrame([(x, x, "", "file", 0) for x in labels] + [("s", "builder", "", "symbol", 9)], "id string, label string, context string, kind string, weight long")
    got = [r.label for r in search.rank(items.where("kind = 'file'"), "builder").collect()]
    assert got == ["builder", "builder.test.ts", "ir-builder.ts", "myBuilder.ts", "bxuxixlxdxexr.ts"]
    empty = search.rank(items, "", 3).collect()
    assert len(empty) == 3 and empty[0].total == 7 and all(r.kind == "file" for r in empty)
    assert texts.segments_of("ir-builder", texts.matched_indices("ir-builder", "build")) == [("ir-", False), ("build", True), ("er", False)]


def test_diagram(spark):
    many = {f"lib/core/f{i:02d}.ts": ["lib/parse/f00.ts"] for i in range(6)} | {f"lib/parse/f{i:02d}.ts": [] for i in range(4)}
    spec = many | {"app/a.ts": ["lib/core/f00.ts", "ui/m.ts"], "ui/m.ts": ["app/a.ts"], "ui/n.ts": [], "alone/x.ts": [], "tests/t.test.ts": ["app/a.ts"]}
    nodes, edges = graph_of(spark, spec)
    u = diagram.top_units(nodes)
    kinds = {(r.kind, r.subject) for r in diagram.findings(u, edges).collect()}
    assert ("cycle", "app") in kinds and ("isolated", "alone") in kinds and not [k for k in kinds if k[0] == "test-leak"]
    text = diagram.mermaid(diagram.unit_measures(u, edges).select(F.col("unit").alias("id"), F.col("unit").alias("label"), "files", "lines"), diagram.flagged(diagram.unit_edges(u, edges))).first()["text"]
    assert '  ui["ui<br/>2 files · 20 lines"]' in text and "  class app,ui cycle" in text and "  app --> lib" in text
    ids = diagram.mermaid_ids(spark.createDataFrame([("a-b",), ("a.b",), ("a_b_2",)], "id string"))
    assert {r.id: r.name for r in ids.collect()} == {"a-b": "a_b", "a.b": "a_b_2", "a_b_2": "a_b_2_2"}
    assert diagram.expand({"lib": {"lib/a": 10, "lib/b": 5}, "lib/a": {}, "lib/b": {}, "app": {}}, {"lib": 2, "lib/a": 10, "lib/b": 5, "app": 3}, 24) == ["app", "lib/*", "lib/a", "lib/b"]
    assert diagram.expand({"lib": {"lib/a": 10}, "lib/a": {}}, {"lib": 3, "lib/a": 10}, 24) == ["lib"]  # one sub-folder is no division


def test_findings_of_large_and_leaking_units(spark):
    rows = [(f"flat/f{i}.ts", "flat") for i in range(70)] + [(f"deep/in/{k}/f{i}.ts", "deep") for k in "ab" for i in range(40)] + [(f"one/{k}/f{i}.ts", "one") for k, n in (("a", 68), ("b", 2)) for i in range(n)]
    rows += [("a/x.ts", "a"), ("b/y.ts", "b"), ("b/y.test.ts", "b")] + [(f"r{i}.ts", "(root files)") for i in range(61)]
    units = spark.createDataFrame([(*r, 1) for r in rows], "path string, unit string, line_count long")
    edges = spark.createDataFrame([("a/x.ts", "b/y.test.ts"), ("b/y.ts", "b/y.test.ts"), ("flat/f0.ts", "b/y.test.ts"), ("b/y.test.ts", "a/x.ts")], "src string, dst string")
    got = [(r.kind, r.subject, r.figure) for r in diagram.findings(units, edges).collect()]
    assert [g for g in got if g[0] == "test-leak"] == [("test-leak", "a,b,flat", 3)]
    assert sorted(g[1] for g in got if g[0] == "oversized") == ["flat", "one"]


def test_misplaced(spark):
    units = spark.createDataFrame([("a/x.ts", "a"), ("a/y.ts", "a"), *((f"b/{i}.ts", "b") for i in range(5)), ("c/z.ts", "c")], "path string, unit string")
    edges = spark.createDataFrame([*(("a/x.ts", f"b/{i}.ts") for i in range(4)), ("c/z.ts", "a/x.ts"), ("a/y.ts", "b/0.ts"), ("a/y.ts", "c/z.ts")], "src string, dst string")
    assert [tuple(r) for r in diagram.misplaced(units, edges).collect()] == [("a/x.ts", "a", "b", 5, 4)]


def test_layers_and_domains(spark):
    rows = {"API/x.ts": ("api", None), "SRC/user/y.ts": ("SRC", "user"), "src/Core/z.ts": ("core", None), "w.ts": (None, None), "src/one.ts": ("src", None), "Billing/a/b.ts": ("Billing", "Billing")}
    df = spark.createDataFrame([(p,) for p in rows], "path string").select("path", paths.layer(F.col("path")).alias("l"), paths.domain(F.col("path")).alias("d"))
    assert {r.path: (r.l, r.d) for r in df.collect()} == rows


def test_search_trims(spark):
    items = spark.createDataFrame([("a", "build", "", "file", 0)], "id string, label string, context string, kind string, weight long")
    assert [r.id for r in search.rank(items, "  build ").collect()] == ["a"] and [r.id for r in search.rank(items, "  ").collect()] == ["a"]


def test_final_notes(spark):
    region = lambda *ids: [("region", i) for i in ids]
    rows = [
        (1, "caption", "  Parsers. ", region("p")), (2, "caption", "again", region("p")), (3, "caption", "has 3", region("q")), (4, "caption", "two", region("q", "r")), (5, "caption", "...", region("s")),
        (6, "caption", "x" * 49, region("t")), (7, "caption", "é" * 48, region("t")), (8, "note", "12 files", region("p")), (9, "note", "13 files", region("p")), (10, "note", "y" * 241, region("p")),
        *((20 + i, "note", f"note {'abcdefgh'[i]}", region("p")) for i in range(8)),
    ]
    claims = spark.createDataFrame(rows, "nth long, section string, text string, citations array<struct<kind:string,id:string>>")
    got = evidence.final_notes(claims, spark.createDataFrame([("12",)], "figure string")).collect()
    assert sorted((r.unit, r.text) for r in got if r.kind == "caption") == [("p", "Parsers"), ("t", "é" * 48)]
    assert sorted(r.text for r in got if r.kind == "note") == ["12 files", *(f"note {c}" for c in "abcde")]


def test_tour(spark):
    spec = {"src/index.ts": ["src/a/x.ts", "src/b/y.ts"], "src/a/x.ts": ["src/b/y.ts"], "src/a/x2.ts": ["src/b/y.ts"], "src/a/x3.ts": [], "src/b/y.ts": [], "src/c/p.ts": [], "src/c/q.ts": [], "src/c/r.ts": [], "tests/t.test.ts": ["src/a/x3.ts"]}
    nodes, edges = graph_of(spark, spec)
    entries = spark.createDataFrame([("src/index.ts", "conventional root file"), ("tests/t.test.ts", "test file")], "path string, reason string")
    folders = nodes.select("path", paths.directory(F.col("path")).alias("folder"))
    got = [r.path for r in tour.tour(nodes, edges, folders, entries).orderBy("step").collect()]
    assert got[0] == "src/index.ts" and got[1] == "src/b/y.ts" and not [p for p in got if p.startswith("src/c/")] and len(got) <= 7 and "tests/t.test.ts" not in got


def steps_of(spark, spec, entries=(), folder=lambda p: p.rpartition("/")[0] or "root"):
    nodes, edges = graph_of(spark, spec)
    folders = spark.createDataFrame([(p, folder(p)) for p in spec], "path string, folder string")
    e = spark.createDataFrame(list(entries), "path string, reason string")
    return [r.path for r in tour.tour(nodes, edges, folders, e).orderBy("step").collect()]


def test_tour_rules(spark):
    # a second start is of another kind though of the same tier; configuration is no start's rival
    spec = {"src/index.ts": ["lib/a.ts"], "bin/x.ts": ["lib/a.ts"], "app/layout.tsx": ["lib/a.ts"], "lib/a.ts": ["lib/b.ts"], "lib/b.ts": []}
    got = steps_of(spark, spec, [("src/index.ts", "conventional root file"), ("app/layout.tsx", "Next.js route (app/layout.tsx)"), ("bin/x.ts", "script (bin/)")])
    assert got[:2] == ["app/layout.tsx", "src/index.ts"] and "bin/x.ts" not in got
    # the region of a start comes after others, files that only declare don't count unless most lean on them
    spec = {"m/index.ts": ["m/h.ts", "n/k.ts"], "m/h.ts": ["n/types.ts"], "m/g.ts": ["m/h.ts", "n/k.ts"], "n/k.ts": ["n/types.ts"], "n/types.ts": [], "n/l.ts": ["n/types.ts", "o/constants.ts"], "o/constants.ts": []}
    assert steps_of(spark, spec, [("m/index.ts", "conventional root file")]) == ["m/index.ts", "n/types.ts", "m/h.ts", "n/k.ts"]
    # without entries: the file that imports most and that only tests import; configuration and tests are noise
    spec = {"a.ts": ["b.ts", "c.ts"], "b.ts": ["c.ts"], "c.ts": [], "a.test.ts": ["a.ts"], "vite.config.ts": ["a.ts", "b.ts", "c.ts"], "z.ts": ["b.ts"]}
    assert steps_of(spark, spec)[0] == "z.ts"
    # nothing at all to say: the first file
    assert steps_of(spark, {"b.ts": [], "a.ts": []}) == ["a.ts"] and steps_of(spark, {"x.ts": []}, [("x.ts", "config file")]) == ["x.ts"]


def test_claims(spark):
    c = spark.createDataFrame([("x", "file", "a"), ("x", "file", "b"), ("y", "file", "a")], "claim_id string, kind string, id string")
    assert col(evidence.supported_claims(c, spark.createDataFrame([("file", "a")], "kind string, id string")), "claim_id") == ["y"]
    t = spark.createDataFrame([("x", "has 1,200 files in v2 and 3.5 parts"), ("y", "gpt-4o")], "claim_id string, text string")
    e = spark.createDataFrame([("1200 files",)], "text string")
    assert [(r.claim_id, r.figure) for r in evidence.unsupported_figures(t, e).collect()] == [("x", "3.5")]


def test_rate_limits(spark, tmp_path):
    rule = (limits.Rule("r", 60_000, 2),)
    hits = [("a", 0), ("a", 10_000), ("a", 10_000), ("a", 60_001), ("b", 5)]
    df = spark.createDataFrame(hits, "client string, t_ms long")
    got = [(r.client, r.t_ms, r.admitted, r.retry_after_s) for r in limits.limited_batch(df, rule).orderBy("client", "t_ms", F.desc("admitted")).collect()]
    assert got == [("a", 0, True, None), ("a", 10_000, True, None), ("a", 10_000, False, 50), ("a", 60_001, True, None), ("b", 5, True, None)]
    # as a stream, in two files
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    df.where("t_ms < 10001").coalesce(1).write.parquet(src)
    df.where("t_ms > 10001").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(src)
    q = limits.limited_stream(stream, rule).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120), "the stream did not end"
    have = [(r.client, r.t_ms, r.admitted, r.retry_after_s) for r in spark.table("decided").orderBy("client", "t_ms", F.desc("admitted")).collect()]
    assert have == got


def test_state_of_idle_clients_goes(spark, tmp_path):
    """Batches in order of time: decisions are the batch's, a hit before its client's latest is marked, and clients whose windows have passed have no state left."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rules = (limits.Rule("r", 60_000, 2), limits.Rule("day", 300_000, 3))
    rng = random.Random(5)
    rounds = [[(f"c{rng.randrange(4)}", k * 200_000 + rng.randrange(150_000)) for _ in range(25)] for k in range(5)] + [[("z", 3_000_000)], [("z", 3_000_001), ("z", 2_999_000)], [("y", 6_000_000)], [("y", 6_000_001)]]
    src, decided = tmp_path / "in", []
    src.mkdir()
    for k, hits in enumerate(rounds):
        spark.createDataFrame(hits, "client string, t_ms long").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("client string, t_ms long").parquet(str(src)).withColumn("at", F.timestamp_millis("t_ms")).withWatermark("at", "300 seconds")
        q = limits.limited_stream(stream, rules, "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120), "the stream did not end"
    key = lambda r: (r.client, r.t_ms, not r.admitted)
    decided = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key)
    every = spark.createDataFrame([h for hits in rounds for h in hits], "client string, t_ms long")
    want = sorted(limits.limited_batch(every, rules).where("t_ms <> 2999000").collect(), key=key)
    assert [(r.client, r.t_ms, r.admitted, r.rule, r.retry_after_s) for r in decided if not r.late] == [tuple(r) for r in want]
    assert [(r.client, r.t_ms) for r in decided if r.late] == [("z", 2_999_000)]
    left = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "cp"))
    assert {r.key.client for r in left.collect()} <= {"y", "z"}


def test_region_figure(spark):
    spec = {f"lib/a/f{i}.ts": ["lib/a/f0.ts", "ui/x.ts"] if i % 2 else ["lib/b/g.ts"] for i in range(40)} | {"lib/b/g.ts": ["lib/a/f1.ts"], "ui/x.ts": ["lib/a/f0.ts", "core/c.ts"], "core/c.ts": ["lib/b/g.ts"], "lib/a/t.test.ts": ["lib/a/f0.ts", "ui/x.ts"]}
    nodes, edges = graph_of(spark, spec)
    files = nodes.select("path", F.split("path", "/")[0].alias("folder"))
    loose = spark.createDataFrame([("lib/a/f39.ts", "./u"), ("lib/a/f0.ts", "./v"), ("ui/x.ts", "./w"), ("lib/a/t.test.ts", "./q")], "path string, specifier string")
    members, units, links = diagram.region_figure(files, edges, "lib", loose)
    unit = {r.path: r.unit for r in members.collect()}
    shown = [p for p in spec if p.startswith("lib/") and "test" not in p]
    degree = {p: sum((a == p) + (b == p) for a, bs in spec.items() for b in bs) for p in shown}
    top = sorted(shown, key=lambda p: (-degree[p], p))[:31]
    assert unit == {p: f"f:{p}" if p in top else "u:#overflow" for p in shown}
    want = {}
    for a, bs in spec.items():
        for b in bs:
            if a.startswith("lib/") or b.startswith("lib/"):
                ends = (unit.get(a) if a.startswith("lib/") else f"b:in:{a.split('/')[0]}", unit.get(b) if b.startswith("lib/") else f"b:out:{b.split('/')[0]}")
                if None not in ends:
                    want[ends] = want.get(ends, 0) + 1
    for p in ("lib/a/f39.ts", "lib/a/f0.ts"):
        want[unit[p], "u:#unresolved"] = want.get((unit[p], "u:#unresolved"), 0) + 1
    assert {(r.source, r.target): r.n for r in links.collect()} == want
    kinds = {r.id: (r.kind, r.label, r.files) for r in units.collect()}
    assert kinds["u:#overflow"] == ("overflow", "+ 10 more files", 10) and kinds["b:out:ui"] == ("boundary", "ui", 1) and kinds["u:#unresolved"] == ("unresolved", "2 unresolved imports", 0) and len(kinds) == 31 + 1 + 4 - 1 + 1
    only = diagram.region_figure(files.where("path like '%test%'"), edges, "lib")[0]
    assert col(only) == ["lib/a/t.test.ts"]


def test_leaks_into_tests_that_are_not_on_the_figure(spark):
    units = spark.createDataFrame([("lib/a.ts", "lib", 1), ("ui/b.ts", "ui", 1)], "path string, unit string, line_count long")
    edges = spark.createDataFrame([("lib/a.ts", "tests/x.test.ts"), ("lib/a.ts", "ui/b.ts"), ("tests/x.test.ts", "ui/b.ts")], "src string, dst string")
    assert [(r.subject, r.figure) for r in diagram.findings(units, edges).where("kind = 'test-leak'").collect()] == [("lib", 1)]


def test_parents_that_lead_into_a_circle(spark):
    parents = {"a": "b", "b": "a", "c": "b", "d": None, "e": "d", "f": "gone", "g": "g", "h": "g"}
    rows = [("folder", k, v, 0, []) for k, v in parents.items()]
    got = boundaries.boundary_violations(spark.createDataFrame(rows, "kind string, path string, parent string, n_files long, contained array<string>"), spark.createDataFrame([], "path string"))
    assert {(r.rule, r.subject) for r in got.collect()} == {("parent-cycle", f"folder:{k}") for k in "abcgh"} | {("missing-parent", "folder:f")}


def test_answers(spark):
    long = "x" * 3000
    texts_ = {
        1: '```json\n{"answer": " a b‑c​ ", "claims": [{"text": "t", "section": 5, "citations": [{"kind": "edge", "id": 3}, {"kind": "page", "id": "p"}, null]}, 4, "x"], "uncertainty": ""}\n```',
        2: f'Sure: {{"summary": "", "answer": "{long}", "readingOrder": [{{"id": "a", "reason": "r"}}, {{"id": "b"}}, {{"reason": "r"}}], "claims": {{}}}} Bye',
        3: "no json", 4: "[1]", 5: None, 6: "} {", 7: '{"claims": [{"text": {"a": 1}}]}',
    }
    got = {r.id: r for r in evidence.parsed_answers(spark.createDataFrame(list(texts_.items()), "id int, text string")).collect()}
    assert got[1].answer == "a b-c" and [(c.text, c.section, [tuple(x) for x in c.citations]) for c in got[1].claims] == [("t", None, [("edge", "")])] and got[1].uncertainty is None
    assert got[2].answer == long[:2000] and [tuple(s) for s in got[2].reading_order] == [("a", "r")] and got[2].claims == []
    assert [got[i].ok for i in range(1, 8)] == [True, True, False, False, False, False, True] and got[3].claims is None
    assert [c.text for c in got[7].claims] == [""]


def test_work_within_a_budget(spark, tmp_path):
    from weftgraph.sources.store import BudgetSpent, Store

    store, key = Store(spark, str(tmp_path)), "1" * 8 + "-0000-0000-0000-" + "0" * 12
    store.save_within(key, 100, lambda check: {"nodes": spark.range(3)})
    assert store.load(key, "nodes").count() == 3
    late = "2" + key[1:]

    def slow(check):
        import time as clock

        def wait(batches):
            for b in batches:
                clock.sleep(30)
                yield b

        return {"nodes": spark.range(3), "edges": spark.range(2).repartition(2).mapInPandas(wait, "id long")}

    with pytest.raises(BudgetSpent):
        store.save_within(late, 5, slow)
    assert store.load(late, "nodes") is None and store.load(late, "edges") is None
    assert spark.range(5).count() == 5  # later work is not cancelled


def test_steps_over_stored_edges_deal_out_the_frontier_only(spark, tmp_path):
    from weftgraph.sources.store import Store

    store = Store(spark, str(tmp_path))
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 50}") for i in range(200)], "src string, dst string")
    try:
        store.save_adjacency("kept_edges", edges, 4)
        frontier = spark.createDataFrame([("n7",), ("n9",)], "path string")
        assert col(store.step("kept_edges", frontier)) == ["n13", "n49"] and col(store.step("kept_edges", frontier, True)) == sorted(f"n{i}" for i in range(200) if i * 7 % 50 in (7, 9))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = store.step("kept_edges", frontier)._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("FileScan")].splitlines()[-6:] if "FileScan" in plan else []
        assert scan and not any("Exchange" in x for x in scan), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for end in ("src", "dst"):
            spark.sql(f"DROP TABLE IF EXISTS kept_edges_by_{end}")


def test_sources(spark, tmp_path):
    assert [scan.sniff_one(x) for x in (b"", b"a\x00b", b"\x01\x02\x03abc", "é".encode() * 50, b"\xff" * 20 + b"ab")] == ["empty", "binary", "binary", "text", "invalid-encoding"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("ok/a.ts", "x")
        z.writestr("../up.ts", "x")
        z.writestr("/abs.ts", "x")
        link = zipfile.ZipInfo("link")
        link.external_attr = 0xA1FF << 16
        z.writestr(link, "a")
        z.writestr("a/../b.ts", "x")
        z.writestr("hurt.ts", "some text")
    whole = bytearray(buf.getvalue())
    whole[whole.index(b"some text")] ^= 1
    arch = spark.createDataFrame([("z.zip", whole), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    got = {(r.archive, r.path): r.status for r in scan.archive_entries(arch).collect()}
    assert got == {("z.zip", "ok/a.ts"): None, ("z.zip", "../up.ts"): "traversal", ("z.zip", "/abs.ts"): "absolute-path", ("z.zip", "link"): "symlink", ("z.zip", "a/../b.ts"): None, ("z.zip", "hurt.ts"): "unreadable", ("bad.zip", ""): "not-an-archive"}
    tree = ["package.json", "src/a.ts", "dist/a.js", "src/dist/b.ts", ".hidden/c.ts", "node_modules/x/d.ts", "x.egg-info/e.py", "env/pyvenv.cfg", "env/lib/f.py", "readme.md"]
    listing = spark.createDataFrame([(p,) for p in tree], "path string")
    assert col(scan.sources(listing)) == ["src/a.ts", "src/dist/b.ts"]
    assert col(scan.project_root(spark.createDataFrame([("top/" + p,) for p in tree], "path string"))) == sorted(tree)
    with pytest.raises(scan.ScanLimit):
        scan.within_limits(listing, 3)
    assert scan.sniff_one(b"\x1b" * 20 + b"abc") == "binary" and scan.sniff_one(b"\x08\x0c" * 3 + b"a" * 10) == "binary" and scan.sniff_one(b"\t\r\n" * 9) == "text"
    tops = spark.createDataFrame([(p,) for p in ["top/a.ts", ".git/x", "__MACOSX/top/._a.ts", ".env", "notes.md"]], "path string")
    assert col(scan.project_root(tops)) == ["a.ts"]
    for kept in ("jsconfig.json", "setup.cfg", "x.ts"):
        assert scan.project_root(tops.unionByName(spark.createDataFrame([(kept,)], "path string"))).count() == 6
    # the project's root needs no marker, and a configuration names its output
    out = spark.createDataFrame([(p,) for p in ["build/a.ts", "sub/build/b.ts", "sub/out/c.ts", "sub/src/d.ts", "sub/tsconfig.json"]], "path string")
    assert col(scan.sources(out.where("path <> 'sub/tsconfig.json'"))) == ["sub/build/b.ts", "sub/out/c.ts", "sub/src/d.ts"]
    config = spark.createDataFrame([("sub/tsconfig.json", '{ // a comment\n "compilerOptions": {"outDir": "./out", /* "outDir": "src" */ "x": "http://y",},}')], "path string, content string")
    assert col(scan.sources(out, configs=config)) == ["sub/src/d.ts"]
    valid = {"a": None, ".": "traversal", "a/..": "traversal", "C:x": None, "C:/x": "absolute-path", "\\\\s\\x": "absolute-path", "a/../../b": "traversal", "": "traversal", "a\x00": "traversal", "a/" * 2500: "path-too-long"}
    df = spark.createDataFrame([(p,) for p in valid], "path string")
    assert {r.path: r.r for r in df.select("path", paths.valid_path(F.col("path")).alias("r")).collect()} == valid
    (tmp_path / "t" / "src").mkdir(parents=True)
    (tmp_path / "t" / "src" / "a.ts").write_text("import './b'")
    (tmp_path / "t" / "n.md").write_text("no")
    assert [r.path for r in scan.read_tree(spark, str(tmp_path / "t")).collect()] == ["src/a.ts"]
    ref = spark.createDataFrame([("https://host.com/o/r.git",), ("host.com/o/r/tree/main/x",), ("nope",)], "u string").select(scan.repository_reference(F.col("u")).alias("x"))
    assert [tuple(r.x) for r in ref.collect()] == [("o", "r", None), ("o", "r", "main/x"), (None, None, None)]


def test_registries(spark):
    reg = registry.ParserRegistry()
    parser = registry.Parser("py", (".py",), ("imports",), lambda c: extract.extracted(c, "python"))
    reg.register(parser)
    for other in (parser, registry.Parser("other", (".py",), (), parser.parse)):
        with pytest.raises(registry.RegistryError):
            reg.register(other)
    assert reg.extract(spark.createDataFrame([("a.py", "import os"), ("b.ts", "import 'x'")], "path string, content string").repartition(1)).count() == 1
    runs = registry.AnalyzerRegistry()
    runs.register(registry.Analyzer("one", 1, lambda r: r["in"], requires={"symbols": "degrade"}))
    runs.register(registry.Analyzer("two", 2, lambda r: r["one"], ("one",)))
    runs.register(registry.Analyzer("three", 2, lambda r: r["in"], requires={"imports": "skip"}))
    with pytest.raises(registry.RegistryError):
        runs.register(registry.Analyzer("four", 1, lambda r: r["in"], ("two",)))
    got = runs.run({"in": spark.range(1)}, {"symbols": 3, "imports": 1})
    assert [(r.id, r.status, r.reason) for r in got] == [("one", "degraded", "symbols"), ("two", "degraded", "one"), ("three", "skipped", "imports")]


def test_retention(spark, tmp_path):
    df = spark.createDataFrame([("a", "7d"), ("b", "manual")], "id string, choice string").withColumn("created", F.lit("2024-01-01").cast("timestamp"))
    at = df.withColumn("expires_at", retention.expires_at(F.col("created"), F.col("choice")))
    assert col(retention.live(at, F.lit("2024-01-08").cast("timestamp")), "id") == ["b"] and col(retention.live(at, F.lit("2024-01-07").cast("timestamp")), "id") == ["a", "b"]
    retention.save_by_day(at.where("expires_at is not null"), str(tmp_path / "days"))
    assert col(retention.sweep(spark.read.parquet(str(tmp_path / "days")), F.to_date(F.lit("2024-02-01"))), "id") == ["a"]


def test_python_imports_of_whole_documents(spark, tmp_path):
    from weftgraph import queries

    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(9001, None), (9002, ""), (9003, "import a.b, c as d"), (9004, "not python at all\nimport e\n from .f import g"), (9005, "x = 1\n" * 30_000), (9006, "'''\nimport hidden\n'''"), (9007, "(" + "-" * 40_000 + "1)")]
    spark.createDataFrame([*real, *odd], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.path, r.line, r.specifier) for r in queries.QUERIES["ext5_python_imports"](spark, str(tmp_path)).collect())
    assert not [t for _, t in real for line in (t or "").split("\n") if line.split()[:1] in (["import"], ["from"])]  # prose imports nothing
    want = [("9003.py", 1, "a.b"), ("9003.py", 1, "c"), ("9004.py", 2, "e"), ("9004.py", 3, ".f.g")]
    for d, t in [*real, *odd]:
        n = (t or "").count("\n") + 1
        want += [(f"{d}.py", n + 1, "os"), (f"{d}.py", n + 1, f"m{d}"), (f"{d}.py", n + 2, ".a.b"), (f"{d}.py", n + 3, "x")]
    assert got == sorted(want)


def test_store(spark, tmp_path):
    from weftgraph.sources.store import Store, owner_hash

    one, two = "0f" * 18, "aa-" * 12
    kept = Store(spark, str(tmp_path / "s"))
    assert kept.load(one, "files") is None and kept.load_explanation(one, "a" * 64) is None
    kept.save(one, files=spark.createDataFrame([("a",)], "path string"), edges=spark.createDataFrame([("a", "b")], "src string, dst string"))
    kept.save(two, files=spark.createDataFrame([("x",), ("y",)], "path string"))
    kept.save(two, files=spark.createDataFrame([("z",)], "path string"))
    assert col(kept.load(one, "files")) == ["a"] and col(kept.load(two, "files")) == ["z"] and kept.load(two, "edges") is None
    assert sorted((r.path, r.analysis_id) for r in kept.load_all("files").collect()) == [("a", one), ("z", two)]
    for wrong in ("../x", "", one + "0"):
        with pytest.raises(ValueError):
            kept.load(wrong, "files")
    kept.save_explanation(one, "a" * 64, "why")
    kept.save_explanation(one, "not a key", "why")
    assert kept.load_explanation(one, "a" * 64) == "why" and kept.load_explanation(two, "a" * 64) is None and kept.load_explanation(one, "not a key") is None
    owners = spark.createDataFrame([(one, "t", "2024-01-08 10:00:00"), (two, "u", None)], "id string, token string, at string")
    kept.register(owners.select("id", owner_hash(F.col("token")).alias("token_hash"), F.col("at").cast("timestamp").alias("expires_at")))
    assert col(kept.expiring("2024-01-08"), "id") == [one] and kept.expiring("2024-01-07").count() == 0
    kept.delete(one)
    assert kept.load(one, "files") is None and kept.load_explanation(one, "a" * 64) is None and col(kept.load(two, "files")) == ["z"]


def test_answers_without_findings(spark):
    asked, found = spark.createDataFrame([("a",), ("b",)], "subject string"), spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "subject string, id string")
    got = {r.subject: r for r in evidence.answered("impact", asked, found).collect()}
    assert got["a"].citations == ["a", "x", "y"] and got["a"].claim == "Changing 'a' may affect 2 transitive importer(s)." and not got["a"].uncertain
    assert got["b"].claim is None and got["b"].uncertain and got["b"].value == []


def test_counts_are_rounded_like_doubles(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from weftgraph.functions import measures

    values = [0, 999, 1000, 1049, 1050, 1150, 1250, 1949, 1950, 12_000, 999_950, 1_023_950, 2_047_950, 3_000_050, 987_654_350, *range(50, 200_000, 100)]
    got = {r.n: r.x for r in spark.createDataFrame([(v,) for v in values], "n long").select("n", measures.format_count(F.col("n")).alias("x")).collect()}
    for v in values:
        exact = str(Decimal(v / 1000).quantize(Decimal("0.1"), ROUND_HALF_UP)).removesuffix(".0") + "k"
        assert got[v] == (str(v) if v < 1000 else exact)


DIRECTED = ("g4_outgoing", "g5_impact", "a1_degrees", "a2_hubs", "r1_reached", "v3_boundary_stubs", "d7_unit_edges", "d8_d9_flagged", "d10_shared_parts", "x3_region_key_files")


@pytest.mark.parametrize("name", DIRECTED)
def test_turning_the_edges_round_changes_the_rows(spark, monkeypatch, name):
    from weftgraph import adapters, queries

    def rows():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        return sorted(map(str, df.collect()))

    edges, straight = adapters.order_edges, rows()
    monkeypatch.setattr(adapters, "order_edges", lambda s, d: edges(s, d).select("id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    assert straight and rows() != straight


def test_order_graph_is_dealt_out_by_its_size(spark, monkeypatch):
    """More orders make more tasks, not larger ones."""
    from weftgraph import adapters

    monkeypatch.setattr(adapters, "TASK_ORDERS", 100)
    edges = adapters.order_edges(spark, "/root/testdata/sf0.001")
    assert adapters.order_tasks(spark, "/root/testdata/sf0.001") == 15
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("], 15") >= 3


def test_units_with_very_many_edges_are_ranked_in_parts(spark):
    units = spark.range(700).selectExpr("concat(if(id < 350, 'a/', 'b/'), id) as path", "if(id < 350, 'a', 'b') as unit")
    edges = spark.range(350).selectExpr("concat('a/', id) as src", "concat('b/', id + 350) as dst")
    got = diagram.unit_edges(units, edges)
    assert "part#" in got._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(f"a/{i}->b/{i + 350}" for i in range(350))[:5]
    assert [tuple(r) for r in got.collect()] == [("a", "b", 350, want)]


def test_components_of_numbers_move_no_names(spark):
    """Numbered nodes stay numbers; edges of unknown nodes, loops and copies of edges change nothing."""
    nodes = spark.createDataFrame([(i,) for i in (3, 7, 9, 12, 40)], "node long")
    edges = spark.createDataFrame([(9, 7), (9, 7), (12, 9), (40, 40), (3, 5), (5, 40)], "src long, dst long")
    want = {(3, 3), (7, 7), (9, 7), (12, 7), (40, 40)}
    assert {tuple(r) for r in fixpoint.components(nodes, edges).collect()} == want
    names = nodes.selectExpr("concat('n', node) as node"), edges.selectExpr("concat('n', src) as src", "concat('n', dst) as dst")
    assert {tuple(r) for r in fixpoint.components(*names).collect()} == {("n3", "n3"), ("n7", "n12"), ("n9", "n12"), ("n12", "n12"), ("n40", "n40")}
    held = fixpoint.stars(edges)
    assert {f.dataType.typeName() for f in held.schema} == {"long"} and {tuple(r) for r in held.collect()} == {(3, 3), (5, 3), (40, 3), (7, 7), (9, 7), (12, 7)}


def test_chains_rings_and_branches_are_drawn_together_exactly(spark):
    rng = random.Random(5)
    nodes, edges = [], []
    for g in range(60):
        own = [f"{g}x{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 11))]
        nodes += own
        edges += list(zip(own, own[1:])) if g % 3 else [(own[i], own[rng.randrange(i)]) for i in range(1, len(own))]
        edges += [(own[-1], own[0])] if g % 6 == 1 else [(rng.choice(own), rng.choice(own)) for _ in range(g % 4)]
        edges += [(f"unknown{g}", own[0]), (own[-1], f"unknown{g}")] if g % 5 == 0 else []
    # three rings without mutual edges, a node between two of them: colours are needed
    ring = [[f"r{k}{i}" for i in range(4)] for k in range(3)]
    for own in ring:
        edges += [(own[i], own[(i + 1) % 4]) for i in range(4)] + [(own[0], own[2])]
    edges += [("r00", "z"), ("z", "r10"), ("r11", "r20")] + edges[:9]
    nodes += [x for own in ring for x in own] + ["z", "alone"]

    def reach(known):
        out = {}
        for a, b in edges:
            if not known or {a, b} <= set(nodes):
                out.setdefault(a, set()).add(b)
        found = {}
        for v in {*nodes, *(x for e in edges for x in e if not known)}:
            found[v], ahead = {v}, [v]
            while ahead:
                new = out.get(ahead.pop(), set()) - found[v]
                found[v] |= new
                ahead += new
        return found

    n, e = spark.createDataFrame([(x,) for x in nodes], "path string"), spark.createDataFrame(edges, "src string, dst string")
    inside, every = reach(True), reach(False)
    strong = {(v, min(w for w in inside[v] if v in inside[w])) for v in nodes}
    counts = {(v, sum(v in r for r in every.values()) - 1) for v in nodes}
    assert {tuple(r) for r in fixpoint.strong_components(n.select(F.col("path").alias("node")), e).collect()} == strong
    assert {tuple(r) for r in graph.all_impacts(n, e).collect()} == counts


def test_no_pairs_are_kept_of_a_chain(spark, monkeypatch):
    seen, pairs = [], fixpoint.reachable
    monkeypatch.setattr(fixpoint, "reachable", lambda edges, seeds, *a: seen.append(seeds.count()) or pairs(edges, seeds, *a))
    monkeypatch.setattr(graph, "reachable", fixpoint.reachable)
    chain = spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}") for i in range(40)], "src string, dst string")
    got = graph.all_impacts(spark.createDataFrame([(f"c{i:03}",) for i in range(41)], "path string"), chain)
    assert {tuple(r) for r in got.collect()} == {(f"c{i:03}", i) for i in range(41)} and seen == [0]


def test_degrees_are_added_up_in_as_many_tasks_as_asked(spark, abc):
    nodes, edges = abc
    got = graph.degrees(nodes, edges, 7)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in graph.degrees(nodes, edges).collect()}
    dealt = [x for x in got._jdf.queryExecution().toString().splitlines() if "REPARTITION_BY_NUM" in x]
    assert dealt and all(", 7)" in x for x in dealt)


def test_region_edges_are_dealt_out_and_shares_need_no_single_task(spark):
    folders = spark.createDataFrame([(f"d{i % 9}/f{i}", f"d{i % 9}") for i in range(90)], "path string, folder string")
    pairs = [(f"d{i % 9}/f{i}", f"d{j % 9}/f{j}") for i in range(90) for j in (0, (i * 7 + 1) % 90)]
    edges = spark.createDataFrame([(f"{a}->{b}", a, b) for a, b in pairs], "id string, src string, dst string")
    want = Counter((a.split("/")[0], b.split("/")[0]) for a, b in pairs if a.split("/")[0] != b.split("/")[0])
    dealt = graph.region_edges(folders, edges, 7)
    assert dealt.rdd.getNumPartitions() == 7
    assert {(r.source, r.target): r.n_edges for r in dealt.collect()} == want
    once = confidence.folder_edges(edges, folders, 7)
    assert once.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, once.collect())) == sorted(want)
    shares = graph.size_share(dealt, "n_edges")
    assert shares.columns == ["source", "target", "n_edges", "share"]
    assert "Window" not in shares._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.source, r.target): r.share for r in shares.collect()} == pytest.approx({k: n / max(want.values()) for k, n in want.items()})
    assert graph.size_share(dealt.limit(0), "n_edges").count() == 0
