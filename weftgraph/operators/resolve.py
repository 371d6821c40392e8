"""Import resolution as joins of candidate paths with the file listing; with repo_id, within each repository."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators.scoped import scope

# Source extensions in the order they are tried, and what emitted files were made from.
SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
EMITTED = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
# Directories in which no Python package is looked for.
NO_PACKAGES = ("__pycache__", ".venv", "venv", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", ".git", "dist", "build")
SUFFIX = r"(\.[^./]+)$"


def named_by(path: Column) -> Column:
    """(prio, base) of every ``base`` by which an import may mean the file at ``path``, an array.

    A base means, in this order, itself, what an emitted name was made from, itself with a source extension (unless it
    has one), an index file in it. Files are told what they may be called, and imports what they ask for, so an import
    is one row of a join, not one for each place to look at.
    """
    ext = F.regexp_extract(path, SUFFIX, 1)
    stem = F.regexp_replace(path, SUFFIX, "")
    call = lambda prio, base: F.struct(F.lit(prio).alias("prio"), base.alias("base"))
    none = F.lit(None).cast("struct<prio: int, base: string>")
    calls = [call(0, path)]
    for e, sources in EMITTED.items():
        calls += [F.when(ext == x, call(10 + i, F.concat(stem, F.lit(e)))).otherwise(none) for i, x in enumerate(sources)]
    more, folder = F.regexp_extract(stem, SUFFIX, 1), F.regexp_extract(stem, r"^([\s\S]+)/index\z", 1)
    for i, x in enumerate(SOURCE_EXTENSIONS):
        calls.append(F.when((ext == x) & ~more.isin(*SOURCE_EXTENSIONS), call(20 + i, stem)).otherwise(none))
        calls.append(F.when((ext == x) & ((stem == "index") | (folder != "")), call(40 + i, folder)).otherwise(none))
    return F.filter(F.array(*calls), lambda c: c.isNotNull())


#: A JSON string; possessive, as strings may be long.
JSON_TEXT = r'("(?:\\.|[^"\\]++)*+")'
def bare_json(text: Column) -> Column:
    """JSON text without comments and without commas before a closing bracket."""
    plain = F.regexp_replace(text, JSON_TEXT + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(plain, JSON_TEXT + r"|,(?=\s*[}\]])", "$1")


OPTIONS = "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"


def aliases(configs: DataFrame) -> DataFrame:
    """(alias, nth, target, target_nth) of configs(path, content): the paths of the top folder's tsconfig.json, else of its jsconfig.json.

    Comments and commas before a closing bracket are taken out; a file that is no JSON then has no aliases. Targets
    are joined to baseUrl, and null where they leave the project.
    """
    g = scope(configs)
    own = configs.where(F.col("path").isin("tsconfig.json", "jsconfig.json"))
    one = own.groupBy(*g).agg(F.max_by("content", "path").alias("content"))
    options = F.from_json(bare_json(F.col("content")), OPTIONS)["compilerOptions"]
    each = one.select(*g, F.coalesce(options["baseUrl"], F.lit(".")).alias("base"), F.posexplode(F.map_entries(options["paths"])).alias("nth", "entry"))
    each = each.select(*g, "base", "nth", F.col("entry.key").alias("alias"), F.posexplode("entry.value").alias("target_nth", "target"))
    joined = F.when(~F.col("target").startswith("/") & ~F.col("base").startswith("/"), F.concat_ws("/", "base", "target"))
    return each.select(*g, "alias", "nth", joined.alias("target"), "target_nth")


def resolve_typescript(imports: DataFrame, sources: DataFrame, listing: DataFrame, aliases: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(path, specifier, target, status) of imports(path, specifier): internal, asset (a file that is no source), unresolved or external.

    sources(path) are the files that were analysed, listing(path) all files. A specifier that begins with a dot or a
    slash is never external; it is an asset if a file of its name, or of its name and .json, is there and has no source
    extension. Of aliases(alias, nth, target, target_nth) the longest that fits goes first; one without a star fits
    its own name only. Imports travel once, as they are; tasks: to how many tasks (without it, as many as Spark takes).
    """
    g = scope(imports, sources, listing, aliases)
    keys = [*g, "path", "specifier"]
    p, s = F.col("path"), F.col("specifier")
    own = s.startswith(".") | s.startswith("/")
    base = F.when(s.startswith("."), paths.normalised(F.concat_ws("/", paths.directory(p), s))).when(s.startswith("/"), paths.normalised(s))
    is_, no = lambda base: F.concat(F.lit("="), base), lambda name: F.concat(F.lit("~"), name)
    files = sources.select(*g, "path", F.explode(named_by(p)).alias("call")).select(*g, is_(F.col("call.base")).alias("key"), F.col("path").alias("candidate"), F.col("call.prio").alias("prio"), F.lit(False).alias("asset"))
    plain = listing.where(~F.regexp_extract("path", SUFFIX, 1).isin(*SOURCE_EXTENSIONS))
    names = F.array(p, F.when(p.endswith(".json"), F.regexp_replace("path", r"\.json$", "")))
    assets = plain.select(*g, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("base")).select(*g, is_(F.col("base")).alias("key"), F.lit(None).cast("string").alias("candidate"), F.lit(1000).alias("prio"), F.lit(True).alias("asset"))
    every = files.unionByName(assets)
    # what is neither a file's name nor an alias is met by nothing; it goes where its own name sends it, not all to one task
    other = no(s) if aliases is not None else no(F.concat_ws("/", p, s))
    if aliases is not None:
        part = F.split("alias", r"\*")
        fits = F.when(F.col("alias").contains("*"), s.startswith(part[0]) & s.endswith(part[1])).otherwise(s == F.col("alias"))
        asked = imports.where(~own).select(*g, "specifier").distinct()
        hit = (asked.join(aliases, g) if g else asked.crossJoin(aliases)).where(fits)  # a configuration's few aliases
        star = F.when(F.col("alias").contains("*"), F.substring(s, F.length(part[0]) + 1, F.greatest(F.length(s) - F.length(part[0]) - F.length(part[1]), F.lit(0)))).otherwise("")
        at = F.locate("*", F.col("target"))
        filled = F.when(at > 0, F.concat(F.substring(F.col("target"), F.lit(1), at - 1), star, F.substring(F.col("target"), at + 1, F.length("target")))).otherwise(F.col("target"))
        rank = F.struct((-F.length("alias")).alias("a"), F.col("nth").alias("b"), F.col("target_nth").alias("c"))
        hit = hit.select(*g, "specifier", rank.alias("round"), is_(paths.normalised(filled)).alias("key"))
        led = hit.join(files, [*g, "key"]).groupBy(*g, "specifier").agg(F.min_by("candidate", F.struct("round", "prio")).alias("candidate"))
        every = every.unionByName(led.select(*g, no(s).alias("key"), "candidate", F.lit(0).alias("prio"), F.lit(False).alias("asset")))
    dealt = lambda rows: rows.repartition(tasks, *g, "key") if tasks else rows
    meant = dealt(every).groupBy(*g, "key").agg(F.min_by("candidate", "prio").alias("target"), F.max("asset").alias("asset"))
    out = imports.select(*keys, F.when(p.isNotNull(), F.coalesce(is_(base), other)).alias("key"))
    out = dealt(out).join(meant, [*g, "key"], "left")
    status = F.when(F.col("target").isNotNull(), "internal").when(F.col("asset"), "asset").when(own, "unresolved").otherwise("external")
    return out.select(*keys, "target", status.alias("status"))


# --- Python -------------------------------------------------------------------------------------------------


def setup_cfg(text: str) -> tuple[str | None, str | None]:
    """(where of [options.packages.find], package_dir of [options]); an indented line goes on with the one before."""
    section, found, lines = "", {}, []
    for line in text.splitlines():
        if line[:1] in (" ", "\t") and lines:
            lines[-1] = f"{lines[-1]} {line.strip()}"
        else:
            lines.append(line)
    for line in map(str.strip, lines):
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip().lower()
        elif line[:1] not in ("", "#", ";") and "=" in line:
            key, _, value = line.partition("=")
            found[section, key.strip().lower()] = value.strip()
    folder = found.get(("options", "package_dir")) or None
    if folder and "=" in folder:  # a mapping: what the empty package is at
        folder = folder.partition("=")[2].strip() or folder
    return found.get(("options.packages.find", "where")) or None, folder


def declared_roots(name: str, text: str) -> tuple[list[str], str | None]:
    """Folders that a manifest names as the import root, first choice first, and the project's name."""
    import tomllib

    if name == "setup.cfg":
        return [x for x in setup_cfg(text) if x], None
    try:
        data = tomllib.loads(text)
    except (ValueError, RecursionError):
        return [], None

    def at(*keys):
        here = data
        for k in keys:
            here = here.get(k) if isinstance(here, dict) else None
        return here

    def strings(x) -> list[str]:
        return [y for y in x if isinstance(y, str)] if isinstance(x, list) else []

    out = strings(at("tool", "setuptools", "packages", "find", "where"))
    out += strings([at("tool", "setuptools", "package-dir", "")])
    wheel = at("tool", "hatch", "build", "targets", "wheel", "packages")
    out += [x.rstrip("/").rpartition("/")[0] or "." for x in strings(wheel[:1] if isinstance(wheel, list) else None)]
    poetry = at("tool", "poetry", "packages")
    out += strings([x.get("from") for x in poetry[:1] if isinstance(x, dict)] if isinstance(poetry, list) else None)
    out += ["."] if isinstance(at("tool", "flit", "module", "name"), str) else []
    project = at("project", "name")
    return out, project if isinstance(project, str) else None


def import_roots(listing: DataFrame, manifests: DataFrame) -> DataFrame:
    """(root, confidence, package_name), a row for each repository (one without repo_id): where its Python imports begin.

    The first folder that is there of those that pyproject.toml declares, then of those of setup.cfg (manifests at the
    top of listing); else, as a guess by structure, ``src`` if some .py file lies below it, else the top.
    """
    g = scope(listing, manifests)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                folders, project = declared_roots(r.path, r.content or "")
                rows += [(*r[: len(g)], r.path, i, f, project) for i, f in enumerate([*folders, None])]
            yield pd.DataFrame(rows, columns=[*g, "path", "nth", "folder", "project"])

    own = manifests.where(F.col("path").isin("pyproject.toml", "setup.cfg")).select(*g, "path", "content")
    kinds = "".join(f"{c} {listing.schema[c].dataType.simpleString()}, " for c in g)
    said = own.mapInPandas(run, kinds + "path string, nth int, folder string, project string")
    said = said.withColumn("root", F.when(~F.col("folder").startswith("/"), paths.normalised(F.col("folder"))))
    dirs = listing.select(*g, F.explode(paths.ancestors(F.col("path"))).alias("root")).unionByName(listing.select(*g, F.lit("").alias("root"))).distinct()
    declared = said.join(dirs, [*g, "root"], "left_semi").groupBy(*g).agg(F.min_by("root", F.struct("path", "nth")).alias("declared"))
    project = said.groupBy(*g).agg(F.max("project").alias("package_name"))
    below = F.col("path").rlike(r"^src/(?:[^./][^/]*/)*[^/]*\.py$")
    shape = listing.groupBy(*g).agg(F.coalesce(F.bool_or(below), F.lit(False)).alias("src"))
    both = shape.join(declared, g, "left").join(project, g, "left") if g else shape.crossJoin(declared).crossJoin(project)  # one row each
    root = F.coalesce("declared", F.when(F.col("src"), "src").otherwise(""))
    return both.select(*g, root.alias("root"), F.when(F.col("declared").isNotNull(), "declared").otherwise("structural-heuristic").alias("confidence"), "package_name")


def under_root(listing: DataFrame, roots: DataFrame | None) -> DataFrame:
    """listing's paths below their import root, as (path, rel)."""
    g = scope(listing, roots)
    if roots is None:
        return listing.select(*g, "path", F.col("path").alias("rel"))
    both = listing.select(*g, "path").join(roots.select(*g, "root"), g) if g else listing.select("path").crossJoin(F.broadcast(roots.select("root")))  # one row
    inside = (F.col("root") == "") | F.startswith("path", F.concat("root", F.lit("/")))
    return both.where(inside).select(*g, "path", F.when(F.col("root") == "", F.col("path")).otherwise(F.substring("path", F.length("root") + 2, F.length("path"))).alias("rel"))


def dotted(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("."))


def python_modules(listing: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(module, path, is_package): dotted names of modules and packages under the import roots(root); listing has all files.

    A folder with Python files of its own is a package: a regular one by its __init__.py, else a namespace package,
    which has no path. A folder hides a module of its name beside it.
    """
    g = scope(listing, roots)
    here = under_root(listing, roots)
    dirs = F.slice(paths.segments(F.col("rel")), 1, F.size(paths.segments(F.col("rel"))) - 1)
    seen = here.where(~F.exists(dirs, lambda d: d.isin(*NO_PACKAGES) | d.startswith(".") | d.endswith(".egg-info")))
    folders = seen.select(*g, F.explode(paths.ancestors(F.col("rel"))).alias("stem")).distinct()
    py = seen.where(F.col("rel").endswith(".py")).select(*g, "path", F.regexp_replace("rel", r"\.py$", "").alias("stem"), paths.directory(F.col("rel")).alias("dir"))
    init = paths.name_of(F.col("path")) == "__init__.py"
    modules = py.where(~init).join(folders, [*g, "stem"], "left_anti").select(*g, dotted(F.col("stem")).alias("module"), "path", F.lit(False).alias("is_package"))
    packages = py.where("dir <> ''").groupBy(*g, "dir").agg(F.max(F.when(init, F.col("path"))).alias("path"))
    return modules.unionByName(packages.select(*g, dotted(F.col("dir")).alias("module"), "path", F.lit(True).alias("is_package")))


def resolve_python(imports: DataFrame, modules: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(path, specifier, target, status) of imports(path, specifier): dotted names, relative ones with leading dots.

    The longest prefix of the name that has a file wins, so names of symbols fall back to the module they are in. A
    name that isn't found is unresolved if it is relative or its first part is a package or module, else external.
    """
    g = scope(imports, modules, roots)
    keys = [*g, "path", "specifier"]
    where = under_root(imports.select(*g, "path").distinct(), roots).select(*g, "path", paths.directory(F.col("rel")).alias("package"))
    i = imports.select(*keys).distinct().join(where, [*g, "path"], "left").withColumn("dots", F.length(F.regexp_extract("specifier", r"^(\.*)", 1)))
    rest = F.regexp_replace("specifier", r"^\.+", "")
    parts = F.when(F.col("package") == "", F.array().cast("array<string>")).otherwise(F.split("package", "/"))
    up = F.size(parts) - F.col("dots") + 1
    anchored = F.concat_ws(".", F.slice(parts, 1, F.greatest(up, F.lit(0))), F.when(rest != "", rest))
    full = F.when(F.col("dots") == 0, F.col("specifier")).when(F.col("package").isNotNull() & (up >= 0), anchored)
    i = i.select(*keys, "dots", F.nullif(full, F.lit("")).alias("full"))
    split = F.split("full", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(split)), lambda n: F.array_join(F.slice(split, 1, n), "."))
    wide = i.where("full is not null").select(*keys, F.posexplode(prefixes).alias("pos", "module"))
    hit = wide.join(modules.where("path is not null").select(*g, "module", F.col("path").alias("candidate")), [*g, "module"])
    best = hit.groupBy(*keys).agg(F.max_by("candidate", "pos").alias("target"))
    tops = modules.where(~F.col("module").contains(".")).select(*g, F.col("module").alias("top")).distinct().withColumn("own", F.lit(True))
    out = i.withColumn("top", F.coalesce(split[0], F.lit(""))).join(best, keys, "left").join(tops, [*g, "top"], "left")
    status = F.when(F.col("target").isNotNull(), "internal").when((F.col("dots") > 0) | F.col("own"), "unresolved").otherwise("external")
    return imports.join(out.select(*keys, "target", status.alias("status")), keys).select(*keys, "target", "status")


# --- Go -----------------------------------------------------------------------------------------------------


def go_module(manifests: DataFrame) -> DataFrame:
    """(path, module) of go.mod files(path, content)."""
    g = scope(manifests)
    return manifests.where(paths.name_of(F.col("path")) == "go.mod").select(*g, "path", F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("module")).where("module <> ''")


def go_packages(files: DataFrame, module: str | DataFrame) -> DataFrame:
    """(import_path, target, n_files): a package is a directory; its first file stands for it. module: a name, or (repo_id, module)."""
    g = scope(files, module if isinstance(module, DataFrame) else None)
    p = F.col("path")
    dirs = paths.segments(paths.directory(p))
    fine = p.endswith(".go") & ~p.endswith("_test.go") & ~F.exists(dirs, lambda d: d.isin("vendor", "testdata") | d.startswith("."))
    own = files.where(fine).join(module, g) if g else files.where(fine).withColumn("module", F.lit(module))
    name = F.concat_ws("/", "module", F.nullif(paths.directory(p), F.lit("")))
    return own.groupBy(*g, name.alias("import_path")).agg(F.min("path").alias("target"), F.count("*").alias("n_files"))


def resolve_go(imports: DataFrame, packages: DataFrame, module: str | DataFrame) -> DataFrame:
    """(path, specifier, target, approximate, status); a target is approximate if its package has several files."""
    g = scope(imports, packages)
    j = imports.join(packages.withColumnRenamed("import_path", "specifier"), [*g, "specifier"], "left")
    j = j.join(module, g, "left") if g else j.withColumn("module", F.lit(module))
    own = F.coalesce((F.col("specifier") == F.col("module")) | F.startswith("specifier", F.concat("module", F.lit("/"))), F.lit(False))
    status = F.when(F.col("target").isNotNull(), "internal").when(own, "unresolved").otherwise("external")
    return j.select(*g, "path", "specifier", "target", F.coalesce(F.col("n_files") > 1, F.lit(False)).alias("approximate"), status.alias("status"))
