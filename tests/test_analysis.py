"""Reading source files, resolving imports, and the analysis of several repositories."""

import os
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.operators import analysis, resolve
from weftgraph.sources import extract, script
from weftgraph.sources.store import Store


def found(text, jsx=False):
    imports, _, errors = script.read(text, jsx)
    return [s for s, _ in imports], errors


@pytest.mark.parametrize(
    "text, want",
    [
        ('import a from "./a"; import * as b from "./b"; import "./c"; export * from "./d"; export { x } from "./e"; export * as n from "./f"', ["./a", "./b", "./c", "./d", "./e", "./f"]),
        ('import f = require("./f"); import type { T } from "./t"; export type { U } from "./u"; import d, { e as e1 } from "./v"', ["./f", "./t", "./u", "./v"]),
        ('import("./a"); import("./b", { with: {} }); import(name); import("./c" + x); import(`./d`); import(`./${e}`)', ["./a", "./b", "./d"]),
        ('const a = require("./a"); module.exports = require(\'./b\'); require("./c",); const { x } = require(`./d`)', ["./a", "./b", "./c", "./d"]),
        ('module.require("./a"); require.resolve("./b"); new require("./c"); require("./d", 1); require("./e" + 1); a?.require("./f")', []),
        ('const x = `${require("./a")} ${`${import("./b")}`} require("./no")`; // require("./no")\n"require(\'./no\')" /* import "./no" */', ["./a", "./b"]),
        ('function w(require) { require("./no"); } require("./yes")', ["./yes"]),
        ('(function (e, require, m) { require("./no") })()', []),
        ('const f = (require) => require("./no"); const g = require => { require("./no") }; require("./yes")', ["./yes"]),
        ('function f() { if (1) { var require = 2 } require("./no") } require("./yes")', ["./yes"]),
        ('{ let require = 1; require("./no") } require("./yes")', ["./yes"]),
        ('try {} catch (require) { require("./no") } for (const require of x) { require("./no") } require("./yes")', ["./yes"]),
        ('function require(x) {}; require("./no")', []),
        ('import require from "x"; require("./no")', ["x"]),
        ('const { require } = x; require("./no")', []),
        ('const require = createRequire(import.meta.url); require("./yes")', ["./yes"]),
        ('const load = module.createRequire("x"); load("./yes"); function f() { const load = 1; load("./no") }', ["./yes"]),
        ("const x = a / 2; const re = /[\"'`{]/g; if (x) y = b / c / d; require('./a')", ["./a"]),
        ("import x from './a\\u0062'", ["./ab"]),
    ],
)
def test_script_imports(text, want):
    assert found(text) == (want, [])


def test_jsx():
    code = 'const A = () => <div className="a{" {...p}>Don\'t :) {require("./a")} <b/> <></> </div>; import("./b")'
    assert found(code, True) == (["./a", "./b"], [])
    assert found("const f = <T,>(x: T) => x; const g = <T extends U>(x: T) => x; import('./k')", True) == (["./k"], [])


@pytest.mark.parametrize(
    "text, error",
    [
        ("import './a'\nfunction f() {\n  return 1;\n", ("'}' expected.", 4, 1)),
        ("a)\n", ("Declaration or statement expected.", 1, 2)),
        ("f(1]", ("')' expected.", 1, 4)),
        ("x = 'abc\ny", ("Unterminated string literal.", 1, 9)),
        ("x = `abc", ("Unterminated template literal.", 1, 9)),
        ("/* abc", ("'*/' expected.", 1, 7)),
        ("é𝒳 = [", ("']' expected.", 1, 8)),
    ],
)
def test_script_errors(text, error):
    imports, _, errors = script.read(text)
    assert imports == [] and errors[0] == error


def test_script_declarations():
    code = """export class A extends B {
  constructor(private a: string) { super(); }
  async m<T>(x: T): Promise<{a: number}> {
    const inner = () => { return 1; };
    if (x) { foo(x) }
    return { obj() { return 1 }, "str-name"(y) {}, [key]() {} };
  }
  get acc() { return 1 }
  abstract z(): void;
  static *gen() {}
}
export default function main(a = {b: 1}) { call(function named() {}); }
export const arrow = async (x: number): Promise<void> => {
  while (x) { x-- }
};
const short = x => x + 1, other = function () {};
export interface I { m(): void; n: string }
export type T<K> = { a: K } | string;
declare enum E { A, B }
function over(a: string): void;
let v = foo(() => {})
"""
    got = [(k, q, a, b) for k, _, q, *at in script.read(code)[1] for a, b in [(tuple(at[:2]), tuple(at[2:]))]]
    assert got == [
        ("class", "A", (1, 1), (11, 2)), ("constructor", "A.constructor", (2, 3), (2, 46)), ("method", "A.m", (3, 3), (7, 4)), ("function", "A.m.inner", (4, 11), (4, 38)),
        ("method", "A.m.obj", (6, 14), (6, 32)), ("method", "A.m.str-name", (6, 34), (6, 50)), ("method", "A.m.[key]", (6, 52), (6, 62)),
        ("method", "A.z", (9, 3), (9, 22)), ("method", "A.gen", (10, 3), (10, 19)), ("function", "main", (12, 1), (12, 72)), ("function", "arrow", (13, 14), (15, 2)),
        ("function", "short", (16, 7), (16, 25)), ("function", "other", (16, 27), (16, 49)), ("interface", "I", (17, 1), (17, 44)), ("type", "T", (18, 1), (18, 38)),
        ("enum", "E", (19, 1), (19, 24)), ("function", "over", (20, 1), (20, 32)),
    ]


WORDS = ["import", "from", "require", "(", ")", "{", "}", "[", "]", "`", "${", "'", '"', "=>", "function", "class", "const", "let", "type", "=", ":", ";", ",", "<", ">", "/", "*", "\n", "x", "a.b", "/*", "//", "\\", "for", "catch", "async", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=40).map(" ".join) | st.text(max_size=60))
def test_no_text_raises(text):
    for path in ("a.ts", "a.tsx", "a.py", "a.go", "a.txt"):
        extract.read_file(path, text)


@pytest.mark.parametrize(
    "text",
    ["import a from './a';\n" * 40_000, "function f() { return g(() => { a(`x${b}`) }) }\n" * 10_000, "(" * 100_000, "{" * 50_000 + "}" * 50_000, "() => " * 40_000, "a<b<c<" * 20_000, "x = 1+" * 40_000, "(): a " * 30_000,
     "type A = " * 20_000, "class A { m() {} }\n" * 10_000, "function require(){}\nrequire('a')\n" * 10_000],
)
def test_long_scripts_take_seconds(text):
    begin = time.process_time()
    extract.read_file("a.ts", text)
    assert time.process_time() - begin < 10


@pytest.mark.parametrize("text", ["x = " + "1+" * 30_000 + "1", "a" + ".b" * 30_000, "-" * 30_000 + "1", "(" * 5_000, "\0", "if x:\n" + "".join(" " * i + "if x:\n" for i in range(1, 300))])
def test_deep_python_is_an_error_not_a_failure(text):
    _, imports, declarations, errors = extract.read_file("a.py", "import os\n" + text)
    assert [s for s, _ in imports] == ["os"] and (not errors or declarations == [])


def test_paths_above_the_top_and_files_that_are_no_sources(spark):
    listing = spark.createDataFrame([(p,) for p in ["a.ts", "lib/x.ts", "src/data.json", "src/a.ts", "src/x.css", "dist/y.js", ".hidden.ts", "libx.ts", "src/t/one.ts"]], "path string")
    sources = listing.where("path like '%.ts'")
    config = '{"compilerOptions": {"baseUrl": "src", "paths": {"lib": ["a"], "@t/*": ["t/*", "../lib/*"], "@t/on*": ["t/no*"], "*.x": ["t/*"], "out": ["../../a"]}}}'
    asked = [("a.ts", "../lib/x"), ("src/a.ts", "./data"), ("src/a.ts", "./x.css"), ("src/a.ts", "../dist/y.js"), ("src/a.ts", "./gone.js"), ("a.ts", "lib"), ("a.ts", "libx"), ("a.ts", "@t/one"), ("a.ts", "@t/x"), ("a.ts", "one.x"), ("a.ts", "out"), ("src/a.ts", "../.hidden"), ("src/t/one.ts", "../../../a")]
    got = resolve.resolve_typescript(spark.createDataFrame(asked, "path string, specifier string"), sources, listing, resolve.aliases(spark.createDataFrame([("tsconfig.json", config), ("jsconfig.json", "{}")], "path string, content string")))
    assert {(r.path, r.specifier): (r.target, r.status) for r in got.collect()} == {
        ("a.ts", "../lib/x"): (None, "unresolved"), ("src/a.ts", "./data"): (None, "asset"), ("src/a.ts", "./x.css"): (None, "asset"), ("src/a.ts", "../dist/y.js"): (None, "unresolved"),
        ("src/a.ts", "./gone.js"): (None, "unresolved"), ("a.ts", "lib"): ("src/a.ts", "internal"), ("a.ts", "libx"): (None, "external"), ("a.ts", "@t/one"): ("src/t/one.ts", "internal"),
        ("a.ts", "@t/x"): ("lib/x.ts", "internal"), ("a.ts", "one.x"): ("src/t/one.ts", "internal"), ("a.ts", "out"): (None, "external"), ("src/a.ts", "../.hidden"): (".hidden.ts", "internal"),
        ("src/t/one.ts", "../../../a"): (None, "unresolved"),
    }
    broken = resolve.aliases(spark.createDataFrame([("tsconfig.json", "{ no"), ("jsconfig.json", config)], "path string, content string"))
    assert broken.count() == 0


def test_packages_and_namespaces(spark):
    paths_ = ["src/app/__init__.py", "src/app/core.py", "src/app/core/deep.py", "src/space/one.py", "src/space/sub/__init__.py", "src/top.py", "src/bare/inner/x.py", "src/.hid/y.py", "src/build/z.py", "src/app/data/note.txt", "src/app/data.py", "tests/t.py"]
    listing = spark.createDataFrame([(p,) for p in paths_], "path string")
    roots = resolve.import_roots(listing, spark.createDataFrame([], "path string, content string"))
    assert [tuple(r) for r in roots.collect()] == [("src", "structural-heuristic", None)]
    modules = resolve.python_modules(listing, roots)
    assert {(r.module, r.path, r.is_package) for r in modules.collect()} == {
        ("app", "src/app/__init__.py", True), ("app.core", None, True), ("app.core.deep", "src/app/core/deep.py", False), ("space", None, True), ("space.one", "src/space/one.py", False),
        ("space.sub", "src/space/sub/__init__.py", True), ("top", "src/top.py", False), ("bare.inner", None, True), ("bare.inner.x", "src/bare/inner/x.py", False),
    }
    asked = [("src/app/core/deep.py", s) for s in ["app.core", "app.core.deep.f", "space", "space.gone", "space.one.f", "bare.inner.x", "bare.gone", "top.f", ".", ".deep", "..gone", "...top", "....x", "os", "app.data.x"]] + [("tests/t.py", ".x"), ("src/top.py", ".")]
    got = {(r.path, r.specifier): (r.target, r.status) for r in resolve.resolve_python(spark.createDataFrame(asked, "path string, specifier string"), modules, roots).collect()}
    deep = {s: got["src/app/core/deep.py", s] for p, s in asked if p == "src/app/core/deep.py"}
    assert deep == {
        "app.core": ("src/app/__init__.py", "internal"), "app.core.deep.f": ("src/app/core/deep.py", "internal"), "space": (None, "unresolved"), "space.gone": (None, "unresolved"), "space.one.f": ("src/space/one.py", "internal"),
        "bare.inner.x": ("src/bare/inner/x.py", "internal"), "bare.gone": (None, "external"), "top.f": ("src/top.py", "internal"), ".": ("src/app/__init__.py", "internal"), ".deep": ("src/app/core/deep.py", "internal"),
        "..gone": ("src/app/__init__.py", "internal"), "...top": ("src/top.py", "internal"), "....x": (None, "unresolved"), "os": (None, "external"), "app.data.x": ("src/app/__init__.py", "internal"),
    }
    assert got["tests/t.py", ".x"] == (None, "unresolved") and got["src/top.py", "."] == (None, "unresolved")


@pytest.mark.parametrize(
    "manifests, want",
    [
        ({"pyproject.toml": '[project]\nname = "p"\n[tool.setuptools.packages.find]\nwhere = ["none", "python"]'}, ("python", "declared", "p")),
        ({"pyproject.toml": '[tool.setuptools]\npackage-dir = {"" = "lib"}'}, ("lib", "declared", None)),
        ({"pyproject.toml": '[tool.hatch.build.targets.wheel]\npackages = ["python/app"]'}, ("python", "declared", None)),
        ({"pyproject.toml": '[tool.poetry]\npackages = [{include = "app", from = "lib"}]'}, ("lib", "declared", None)),
        ({"pyproject.toml": '[tool.flit.module]\nname = "app"'}, ("", "declared", None)),
        ({"pyproject.toml": "project = 1", "setup.cfg": "[options]\npackage_dir =\n    = lib\n"}, ("lib", "declared", None)),
        ({"pyproject.toml": '[project]\nname = "q"', "setup.cfg": "[options]\npackage_dir = lib\n[options.packages.find]\n# here\nwhere = python"}, ("python", "declared", "q")),
        ({"pyproject.toml": "not [ toml", "setup.cfg": "[options.packages.find]\nwhere = gone"}, ("src", "structural-heuristic", None)),
        ({"sub/pyproject.toml": '[tool.flit.module]\nname = "app"'}, ("src", "structural-heuristic", None)),
    ],
)
def test_import_roots(spark, manifests, want):
    listing = spark.createDataFrame([(p,) for p in ["python/app/a.py", "lib/b.py", "src/x/c.py", *manifests]], "path string")
    assert [tuple(r) for r in resolve.import_roots(listing, spark.createDataFrame(list(manifests.items()), "path string, content string")).collect()] == [want]


FILES = {
    "one": {
        "src/index.ts": 'import { b } from "./b"\nimport c from "@/deep/c"\nimport React from "react"\nimport "./gone"\nimport d from "./data.json"\n',
        "src/b.ts": 'export const b = () => 1\nconst x = require("./index")\n', "src/deep/c.ts": "export class C {\n  m() {}\n}\n", "src/bad.ts": 'import "./b"\nfunction f() {\n', "src/data.json": "{}",
        "src/lost.ts": None, "node_modules/react/index.js": "x", "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "notes.md": "text", "src/usesbad.ts": 'import "./bad"\n',
    },
    "two": {
        "src/index.ts": 'import "./only"\n', "src/only.ts": "", "app/__init__.py": "", "app/m.py": "from . import n\nimport os\nimport app.gone\n", "app/n.py": "def f():\n    pass\n", "app/broken.py": "import app\ndef (:\n",
        "go.mod": "module ex.com/m\n", "cmd/main.go": 'package main\nimport "ex.com/m/u"\nimport "fmt"\n', "u/a.go": "package u\n", "u/b.go": "package u\n",
    },
}


def test_two_repositories_end_to_end(spark, tmp_path):
    rows = [(r, p, c) for r, files in FILES.items() for p, c in files.items()]
    a = analysis.analyze(spark.createDataFrame(rows, "repo_id string, path string, content string"))
    assert {(r.repo_id, r.src, r.dst, r.approximate) for r in a.edges.collect()} == {
        ("one", "src/index.ts", "src/b.ts", False), ("one", "src/index.ts", "src/deep/c.ts", False), ("one", "src/b.ts", "src/index.ts", False), ("two", "src/index.ts", "src/only.ts", False),
        ("two", "app/m.py", "app/n.py", False), ("two", "app/m.py", "app/__init__.py", False), ("two", "cmd/main.go", "u/a.go", True),
    }
    assert {(r.repo_id, r.path, r.specifier, r.status) for r in a.imports.where("status <> 'internal'").collect()} == {
        ("one", "src/index.ts", "react", "external"), ("one", "src/index.ts", "./gone", "unresolved"), ("one", "src/index.ts", "./data.json", "asset"), ("two", "app/m.py", "os", "external"), ("two", "cmd/main.go", "fmt", "external"),
    }
    assert {(r.repo_id, r.path, r.severity, r.reason, r.line) for r in a.errors.collect()} == {("one", "src/bad.ts", "fatal", "syntax", 3), ("one", "src/lost.ts", "fatal", "unreadable", None), ("two", "app/broken.py", "partial", "syntax", 2)}
    assert {(r.repo_id, r.path) for r in a.files.collect()} - {(r.repo_id, r.path) for r in a.nodes.collect()} == {("one", "src/bad.ts"), ("one", "src/lost.ts"), ("two", "app/broken.py")}
    assert a.files.where("path like '%node_modules%' or path like '%.md'").count() == 0
    assert {(r.path, r.qualified_name) for r in a.declarations.where("kind = 'method'").collect()} == {("src/deep/c.ts", "C.m")}
    seen = {(r.repo_id, r.path): (r.in_degree, r.is_orphan) for r in analysis.observations(a).collect()}
    assert seen["one", "src/index.ts"] == (1, False) and seen["two", "src/index.ts"] == (0, True)
    store = Store(spark, str(tmp_path))
    key = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    store.save(key, **a.tables())
    assert store.load(key, "edges").count() == 7 and store.load(key, "errors").where(F.col("reason") == "unreadable").count() == 1


def test_operators_keep_repositories_apart(spark):
    """Each repository's rows are those that it gives alone; the three have paths in common."""
    from weftgraph.operators import cluster, graph, reach

    trees = {
        "a": [f"lib/core/f{i}.ts" for i in range(40)] + [f"lib/ui/g{i}.ts" for i in range(5)] + ["x/one.ts", "go/p/a.go", "go/p/b.go", "py/__init__.py", "py/m.py"],
        "b": [f"lib/core/f{i}.ts" for i in range(4)] + ["x/one.ts", "x/two.ts", "x/three.ts", "types.d.ts"],
        "c": [f"lib/core/deep/in/f{i}.ts" for i in range(33)] + [f"lib/core/deep/out/f{i}.ts" for i in range(4)],
    }
    nodes = spark.createDataFrame([(r, p) for r, ps in trees.items() for p in ps], "repo_id string, path string")
    links = [(r, ps[i], ps[i * 7 % len(ps)]) for r, ps in trees.items() for i in range(0, len(ps), 2)]
    edges = spark.createDataFrame(links, "repo_id string, src string, dst string")
    entries = spark.createDataFrame([("a", "lib/core/f2.ts"), ("a", "py/m.py"), ("a", "go/p/a.go"), ("b", "lib/core/f2.ts"), ("c", "nowhere")], "repo_id string, path string")
    runs = {
        "clusters": lambda n, e, x: cluster.adaptive_clusters(n), "tree": lambda n, e, x: cluster.folder_tree(n), "degrees": lambda n, e, x: graph.degrees(n, e), "hubs": lambda n, e, x: graph.hubs(graph.degrees(n, e)),
        "orphans": lambda n, e, x: graph.orphans(n, e), "regions": lambda n, e, x: graph.region_edges(cluster.legacy_clusters(n), e), "reached": reach.reached, "unreachable": reach.unreachable,
    }
    for name, run in runs.items():
        got = sorted(map(str, (tuple(r) for r in run(nodes, edges, entries).collect())))
        want = [(r, *row) for r in trees for row in run(*(df.where(F.col("repo_id") == r).drop("repo_id") for df in (nodes, edges, entries))).collect()]
        assert got == sorted(map(str, want)) and got, name
    with pytest.raises(ValueError):
        graph.degrees(nodes, edges.drop("repo_id"))


def places(base):
    """Where an import of base may lead, one after another."""
    ext = re.search(r"(\.[^./]+)$", base)
    ext = ext[1] if ext else ""
    twins = [base[: -len(ext)] + x for x in resolve.EMITTED.get(ext, ())]
    probes = [] if ext in resolve.SOURCE_EXTENSIONS else [base + x for x in resolve.SOURCE_EXTENSIONS]
    return [base, *twins, *probes, *((base + "/" if base else "") + "index" + x for x in resolve.SOURCE_EXTENSIONS)]


def test_files_know_what_they_are_called(spark):
    """Each import finds the file that trying all its places in turn finds, and travels as one row."""
    stems = ["a", "a.b", "a.js", "a.mts", "d/a", "d/index", "index", "d/a.test", "d/.x", ".hid", "d", "d.d", "index.ts", "d/index.js"]
    listing = [s + x for i, s in enumerate(stems) for k, x in enumerate((*resolve.SOURCE_EXTENSIONS, "", ".json", ".css", ".svg")) if (5 * i + 3 * k) % 7 not in (1, 4)]
    sources = {p for p in listing if re.search(r"\.[cm]?[jt]sx?$", p) and len(p) % 5}
    asked = [f"/{s}{x}" for s in stems for x in ("", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".json", ".css", "/index", "/")] + ["/", "/.", "/..", "react", "./a", "../a", "../../../x", None]
    rows = [(p, s) for p in ("main.ts", "d/in/x.ts", None) for s in asked] + [("main.ts", "/a")]
    t = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    imports = spark.createDataFrame(rows, "path string, specifier string")

    def want(p, s):
        own = s is not None and s[:1] in (".", "/")
        if p is None or not own:
            return p, s, None, "unresolved" if own else "external"
        base = []
        for x in (os.path.dirname(p) + "/" + s if s[0] == "." else s).split("/"):
            if x == ".." and not base:
                return p, s, None, "unresolved"
            base = base[:-1] if x == ".." else base if x in ("", ".") else [*base, x]
        base = "/".join(base)
        for x in places(base):
            if x in sources:
                return p, s, x, "internal"
        asset = any(x in listing and not x.endswith(resolve.SOURCE_EXTENSIONS) for x in (base, base + ".json"))
        return p, s, None, "asset" if asset else "unresolved"

    known = lambda r: tuple((x is not None, x) for x in r)
    expected = sorted((want(*r) for r in rows), key=known)
    assert len({x[3] for x in expected}) == 4 and sum(x[3] == "internal" for x in expected) > 100
    aliases = spark.createDataFrame([("none/*", 0, "none/*", 0)], "alias string, nth int, target string, target_nth int")
    for more in ({}, {"tasks": 7}, {"aliases": aliases}):
        out = resolve.resolve_typescript(imports, t(sources), t([*listing, *listing[:5]]), **more)
        assert sorted((tuple(r) for r in out.collect()), key=known) == expected
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = resolve.resolve_typescript(imports, t(sources), t(listing))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 1  # before: four, two of them of every place of every import


def test_imports_of_parts_are_dealt_out(spark, monkeypatch):
    """With more lines than Spark's partitions would take, parts' edges and their resolution have more tasks, and the same rows."""
    from weftgraph import adapters, queries

    sf = "/root/testdata/sf0.001"
    whole = queries.QUERIES["res1_typescript"](spark, sf).collect()
    monkeypatch.setattr(adapters, "TASK_LINES", 500)
    dealt = queries.QUERIES["res1_typescript"](spark, sf)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, dealt.collect())) and len(whole) > 1000
