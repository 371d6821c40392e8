"""Entry points by rule: what manifests name, what frameworks and conventions load, what runs by itself."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths, texts
from weftgraph.operators.graph import rule_of
from weftgraph.operators.resolve import SOURCE_EXTENSIONS

# File conventions.
SOURCE = r"(?:ts|tsx|js|jsx|mjs|cjs|mts|cts)"
NEXT_NAMES = "page|layout|route|loading|error|global-error|not-found|template|default|opengraph-image|twitter-image|icon|apple-icon|sitemap|robots|manifest"
#: A pattern, the reason, and what the reason has in parentheses at its end: the path, its first folder or nothing.
CONVENTIONS: tuple[tuple[str, str, str], ...] = (
    (rf"^(?:src/)?app/(?:.*/)?(?:{NEXT_NAMES})\.{SOURCE}$|^(?:src/)?pages/.+\.{SOURCE}$", "Next.js route", "path"),
    (rf"^(?:src/)?middleware\.{SOURCE}$", "Next.js middleware", "path"),
    (rf"^(?:src/)?proxy\.{SOURCE}$", "Next.js proxy", "path"),
    (rf"^(?:src/)?instrumentation\.{SOURCE}$", "Next.js instrumentation", "path"),
    (rf"^(?:[^/]+\.(?:config|conf)|gulpfile|Gruntfile|gatsby-(?:browser|config|node|ssr)|jest\.setup|vitest\.setup|setupTests)\.{SOURCE}$", "config file", ""),
    (r"^(?:test|tests|e2e|cypress)/", "test file", ""),
    (r"^(?:examples?|demos?|samples?|sandbox|playground)/", "example or demo", "folder"),
    (r"^(?:benchmarks?|bench)/", "benchmark", "folder"),
    (r"^(?:scripts|bin)/", "script", "folder"),
    (r"^(?:src/)?(?:index|main|server|app|cli|worker|sw)\.[A-Za-z]+$", "conventional root file", ""),
)
ANYWHERE: tuple[tuple[str, str], ...] = (
    (r"\.(?:test|spec)\.[^/]+$|(?:^|/)(?:__tests__|__mocks__)/", "test file"),
    (r"\.stories\.[^/]+$", "Storybook story"),
    (r"(?:^|/)test_[^/]*\.py$|_test\.(?:py|go)$|(?:^|/)conftest\.py$", "test file"),
)
PYTHON_ENTRIES = ("__main__.py", "manage.py", "setup.py", "wsgi.py", "asgi.py")
TWINS = {".js": (".js", ".ts", ".tsx", ".jsx"), ".jsx": (".jsx", ".tsx"), ".mjs": (".mjs", ".mts"), ".cjs": (".cjs", ".cts")}
FRAMEWORKS = (
    (r"^nuxt$", "Nuxt"), (r"^@remix-run/", "Remix"), (r"^@react-router/", "React Router"), (r"^gatsby$", "Gatsby"), (r"^astro$", "Astro"),
    (r"^@sveltejs/kit$", "SvelteKit"), (r"^@angular/core$", "Angular"), (r"^@solidjs/start$", "SolidStart"), (r"^expo-router$", "Expo Router"),
    (r"^@docusaurus/core$", "Docusaurus"), (r"^vitepress$", "VitePress"), (r"^@redwoodjs/", "RedwoodJS"),
)
NON_LIBRARY = ("test file", "Storybook story", "example or demo", "benchmark")


def by_convention(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(path, reason, prio): the first convention of the first package root ("" first) that a file meets; roots(root, nth)."""
    p = F.col("path")
    here = files.select("path", F.lit("").alias("root"), F.lit(0).alias("root_pos"))
    if roots is not None:
        below = files.select("path", F.explode(paths.ancestors(p)).alias("root")).join(roots.where("root <> ''").select("root", F.col("nth").alias("root_pos")), "root")
        here = here.unionByName(below)
    rel = F.expr("CASE WHEN root = '' THEN path ELSE substring(path, length(root) + 2) END")
    said = {"": "", "path": F.concat(F.lit(" ("), p, F.lit(")")), "folder": F.concat(F.lit(" ("), F.split(rel, "/")[0], F.lit("/)"))}
    rule = F.coalesce(*[F.when(rel.rlike(r), F.struct(F.lit(i).alias("rule_pos"), F.concat(F.lit(name), said[end] if end else F.lit("")).alias("reason"))) for i, (r, name, end) in enumerate(CONVENTIONS)])
    return here.withColumn("rule", rule).where("rule is not null").select("path", "rule.reason", F.struct(F.lit(1).alias("phase"), F.lit("").alias("manifest"), F.col("root_pos").alias("a"), F.col("rule.rule_pos").alias("b")).alias("prio"))


def anywhere(files: DataFrame) -> DataFrame:
    p = F.col("path")
    rule = F.coalesce(*[F.when(p.rlike(r), F.struct(F.lit(i).alias("pos"), F.lit(name).alias("reason"))) for i, (r, name) in enumerate(ANYWHERE)])
    return files.withColumn("rule", rule).where("rule is not null").select("path", "rule.reason", F.struct(F.lit(2).alias("phase"), F.lit("").alias("manifest"), F.lit(0).alias("a"), F.col("rule.pos").alias("b")).alias("prio"))


def by_content(contents: DataFrame) -> DataFrame:
    """contents(path, content): Python programs and Go main packages."""
    p, c = F.col("path"), F.col("content")
    name = paths.name_of(p)
    reason = (
        F.when(p.endswith(".py") & name.isin(*PYTHON_ENTRIES), F.concat(F.lit("Python entry module ("), name, F.lit(")")))
        .when(p.endswith(".py") & c.rlike(texts.PY_MAIN_GUARD), F.lit("Python __main__ guard"))
        .when(p.endswith(".go") & ~p.endswith("_test.go") & c.rlike(texts.GO_PACKAGE_MAIN), F.lit("Go package main"))
    )
    return contents.withColumn("reason", reason).where("reason is not null").select("path", "reason", F.struct(F.lit(3).alias("phase"), F.lit("").alias("manifest"), F.lit(0).alias("a"), F.lit(0).alias("b")).alias("prio"))


def strings_in(value) -> Iterator[str]:
    """All strings of a JSON value, in order."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, (list, dict)):
        for v in value if isinstance(value, list) else value.values():
            yield from strings_in(v)


def exported(value, key: str = ".") -> Iterator[tuple[str, str | None]]:
    """(subpath key, target) of a package's exports; a null target excludes the keys that its key, which may have stars, matches."""
    if value is None or isinstance(value, str):
        yield key, value
    elif isinstance(value, list):
        for v in value:
            yield from exported(v, key)
    elif isinstance(value, dict):
        by_subpath = any(k.startswith(".") for k in value)
        for k, v in value.items():
            yield from exported(v, k if by_subpath else key)


def key_pattern(key: str) -> re.Pattern:
    return re.compile(".*".join(map(re.escape, key.split("*"))))


def manifest_targets(manifest: str, content: str) -> list[tuple[int, str, str, str]]:
    """(position, reason, key, target) of what a package.json names, in order: main, module, types, bin, both sides of
    browser, and exports less those that a null excludes. Targets with a star name families of files."""
    try:
        data = json.loads(content)
    except ValueError:
        return []
    if not isinstance(data, dict):
        return []
    out: list[tuple[int, str, str, str]] = []

    def name(reason: str, key: str, target: str):
        out.append((len(out), f"{manifest} {reason}", key, target))

    for field in ("main", "module", "types"):
        if isinstance(data.get(field), str):
            name(f'"{field}"', "", data[field])
    for target in strings_in(data.get("bin")):
        name('"bin"', "", target)
    browser = data.get("browser")
    sides = [browser] if isinstance(browser, str) else [x for pair in browser.items() for x in pair if isinstance(x, str) and x.startswith(".")] if isinstance(browser, dict) else []
    for target in sides:
        name('"browser" map', "", target)
    leaves = list(exported(data["exports"])) if "exports" in data else []
    gone = [key_pattern(k) for k, target in leaves if target is None]
    for key, target in leaves:
        if target is not None and not target.startswith("#") and not any(g.fullmatch(key) for g in gone):
            name(f'"exports" ("{key}")', key, target)
    return out


def named_targets(manifests: DataFrame) -> DataFrame:
    """(manifest, dir, pos, reason, key, target) of manifests(path, content), one row for each target of a package.json."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, p.rpartition("/")[0], *t) for p, c in zip(b["path"], b["content"]) if p.rpartition("/")[2] == "package.json" for t in manifest_targets(p, c or "")]
            yield pd.DataFrame(rows, columns=["manifest", "dir", "pos", "reason", "key", "target"])

    return manifests.select("path", "content").mapInPandas(run, "manifest string, dir string, pos int, reason string, key string, target string")


def target_candidates(target: Column) -> Column:
    """All paths that a built target may stand for: under src/ or without its output folder, by its source extensions, as a module or its index."""
    t = paths.normalised(target)
    rest = F.regexp_replace(t, r"^(?:dist|build)/", "")
    bases = F.when(t.rlike(r"^(?:dist|build)/"), F.array(t, F.concat(F.lit("src/"), rest), rest)).otherwise(F.array(t))

    def spread(b: Column) -> Column:
        ext = F.lower(F.regexp_extract(b, r"(\.[^./]+)$", 1))
        stem = F.regexp_replace(b, r"\.[^./]+$", "")
        out = F.when(ext.isin(*SOURCE_EXTENSIONS), F.array(b)).otherwise(
            F.concat(F.array(b), F.array(*[F.concat(b, F.lit(s)) for s in SOURCE_EXTENSIONS]), F.array(*[F.concat(b, F.lit(f"/index{s}")) for s in SOURCE_EXTENSIONS]))
        )
        for e, sources in TWINS.items():
            out = F.when(ext == e, F.array(*[F.concat(stem, F.lit(s)) for s in sources])).otherwise(out)
        return out

    return F.flatten(F.transform(bases, spread))


def by_manifest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, reason, prio): every file that a manifest's target may stand for; targets with a star and declarations name none."""
    named = named_targets(manifests).where(~F.col("target").contains("*") & ~F.col("target").startswith("#") & ~paths.is_declaration(F.col("target")))
    c = named.select("manifest", "dir", "pos", "reason", F.explode(target_candidates(F.col("target"))).alias("rel"))
    c = c.withColumn("path", F.when(F.col("dir") == "", F.col("rel")).otherwise(F.concat_ws("/", "dir", "rel")))
    hit = c.join(files.select("path"), "path", "left_semi")
    return hit.select("path", "reason", F.struct(F.lit(0).alias("phase"), "manifest", F.lit(0).alias("a"), F.col("pos").alias("b")).alias("prio"))


def wildcard_exports(manifests: DataFrame) -> DataFrame:
    """(manifest, key, target), each once, of exports that name families of files."""
    at = paths.normalised(F.concat_ws("/", "dir", "target"))
    return named_targets(manifests).where(F.col("target").contains("*") & (F.col("key") != "")).select("manifest", "key", at.alias("target")).where("target is not null").distinct()


SCRIPT = re.compile(r"""[\w.-]+\s*=\s*["']([\w.]+)(?::[\w.]+)?["']""")


def script_targets(manifests: DataFrame) -> DataFrame:
    """(path, reason): the modules that pyproject.toml scripts name, in its directory or src/ below it; manifests(path, content).

    Manifests are read by lines, so that damage elsewhere in one loses nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                base, inside = p.rpartition("/")[0], False
                for line in map(str.strip, (c or "").splitlines()):
                    if line.startswith("["):
                        inside = line.startswith(("[project.scripts]", "[tool.poetry.scripts]"))
                    elif inside and (m := SCRIPT.match(line)):
                        stem = m[1].replace(".", "/")
                        for lead in (base, f"{base}/src" if base else "src"):
                            rows += [(f"{lead}/{stem}{tail}" if lead else f"{stem}{tail}", "pyproject.toml script") for tail in (".py", "/__init__.py")]
            yield pd.DataFrame(rows, columns=["path", "reason"])

    own = manifests.where(paths.name_of(F.col("path")) == "pyproject.toml")
    return own.select("path", "content").mapInPandas(run, "path string, reason string")


def entry_points(files: DataFrame, manifests: DataFrame | None = None, contents: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(path, reason): the first rule that each file meets; declaration files are no entries."""
    parts = [by_convention(files, roots), anywhere(files)]
    if manifests is not None:
        parts.append(by_manifest(files, manifests))
        scripts = script_targets(manifests).join(files.select("path"), "path", "left_semi")
        parts.append(scripts.select("path", "reason", F.struct(F.lit(0).alias("phase"), F.lit("\U0010ffff").alias("manifest"), F.lit(0).alias("a"), F.lit(0).alias("b")).alias("prio")))
    if contents is not None:
        parts.append(by_content(contents))
    every = reduce(DataFrame.unionByName, parts).where(~paths.is_declaration(F.col("path")))
    return every.groupBy("path").agg(F.min_by("reason", "prio").alias("reason"))


def dynamic_import_files(contents: DataFrame, entries: DataFrame) -> DataFrame:
    """(path) of library files that compute the target of an import."""
    c, p = F.col("content"), F.col("path")
    hit = (p.endswith(".py") & c.rlike(texts.DYNAMIC_PY)) | (p.rlike(rf"\.{SOURCE}$") & c.rlike(texts.DYNAMIC_JS))
    runnable = entries.where(rule_of(F.col("reason")).isin(*NON_LIBRARY)).select("path")
    return contents.where(hit & ~paths.is_declaration(p)).select("path").join(runnable, "path", "left_anti")


def unknown_frameworks(dependencies: DataFrame) -> DataFrame:
    """(root, framework) of dependencies(root, name) whose file conventions no rule knows."""
    name = F.coalesce(*[F.when(F.col("name").rlike(r), F.lit(f)) for r, f in FRAMEWORKS])
    return dependencies.select("root", name.alias("framework")).where("framework is not null").distinct()
