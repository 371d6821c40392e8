"""Scanning source trees: listing, exclusions, limits, content checks, archives."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import paths
from weftgraph.operators import resolve
from weftgraph.operators.scoped import scope

# Folders that hold no sources of the project, marks of a package root, and limits.
EXCLUDED = ("node_modules", ".git", ".next", ".venv", "__pycache__", ".pytest_cache", ".tox", ".mypy_cache", ".ruff_cache", "site-packages", "conda-meta")
ROOT_MARKERS = ("package.json", "tsconfig.json", "pyproject.toml", "setup.py", "go.mod")
TOP_SIGNALS = ("package.json", "tsconfig.json", "jsconfig.json", "pyproject.toml", "setup.cfg", "go.mod")
BUILD_NAMES = ("dist", "build")
SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".go")
MAX_FILES, MAX_BYTES, SAMPLE_BYTES = 800, 250 * 1024 * 1024, 8192
CONTROL_RATIO, REPLACED_RATIO, REPLACED_LEAST = 0.10, 0.05, 4


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> DataFrame:
    """(path, content) of a tree on any store that Spark reads; path is relative to root. The glob is applied by the source."""
    glob = "*{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = raw.select(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("full"), "content", "length")
    return base.select(F.regexp_replace("full", "^.*?" + "".join("\\" + c if c in r".[](){}*+?^$|\\" else c for c in "/" + root.split(":")[-1].strip("/") + "/"), "").alias("path"), "content", "length")


def project_root(listing: DataFrame) -> DataFrame:
    """listing(path) with the one top folder taken off, if nothing at the top says that the project starts there.

    Entries at the top whose names begin with a dot, and ``__MACOSX``, don't count.
    """
    top = F.element_at(F.split("path", "/"), 1)
    at_top = ~F.col("path").contains("/")
    visible = ~top.startswith(".") & (top != "__MACOSX")
    signal = at_top & visible & (F.col("path").isin(*TOP_SIGNALS) | paths.extension(F.col("path")).isin(*SOURCE_EXTENSIONS))
    folder = F.when(~at_top & visible, top)
    one = listing.agg((F.countDistinct(folder) == 1).alias("single"), F.max(folder).alias("folder"), F.bool_or(signal).alias("signal"))
    strip = F.col("single") & ~F.coalesce("signal", F.lit(False))
    kept = listing.crossJoin(F.broadcast(one)).where(~strip | (~at_top & (top == F.col("folder"))))  # one row
    return kept.select(F.when(strip, F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path")).alias("path"))


def output_directories(configs: DataFrame) -> DataFrame:
    """(dir) that the tsconfig.json files of configs(path, content) name as their outDir; comments and trailing commas are allowed."""
    g = scope(configs)
    out = F.get_json_object(resolve.bare_json(F.col("content")), "$.compilerOptions.outDir")
    own = paths.directory(F.col("path"))
    named = configs.where(paths.name_of(F.col("path")) == "tsconfig.json").select(*g, own.alias("own"), paths.normalised(F.concat_ws("/", own, out)).alias("dir"), out.alias("out"))
    return named.where("out is not null and dir <> own and dir <> ''").select(*g, "dir")


def excluded_directories(listing: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """(dir): virtual environments by what they hold, build output beside a package root (the project's root is one), and outDirs of configs."""
    g = scope(listing, configs)
    p = F.col("path")
    up = listing.select(*g, "path", paths.directory(p).alias("dir"), paths.name_of(p).alias("name"))
    env = up.where(F.col("name") == "pyvenv.cfg").select(*g, "dir").distinct()
    activate = up.where(F.col("name").isin("activate", "activate.bat") & F.col("dir").rlike(r"(^|/)(bin|Scripts)$")).select(*g, F.regexp_replace("dir", r"/?(bin|Scripts)$", "").alias("dir"))
    packages = listing.where(p.rlike(r"(^|/)(?:lib(?:/python[^/]*)?|Lib)/site-packages/")).select(*g, F.regexp_replace(F.regexp_extract("path", r"^(.*?)/?(?:lib(?:/python[^/]*)?|Lib)/site-packages/", 1), "/$", "").alias("dir")).distinct()
    env = env.unionByName(activate.join(packages, [*g, "dir"], "left_semi"))
    tops = listing.select(*g, F.lit("").alias("dir")) if g else listing.sparkSession.createDataFrame([("",)], "dir string")
    roots = up.where(F.col("name").isin(*ROOT_MARKERS)).select(*g, "dir").unionByName(tops).distinct()
    build = roots.select(*g, F.explode(F.array(*[F.when(F.col("dir") == "", n).otherwise(F.concat("dir", F.lit(f"/{n}"))) for n in BUILD_NAMES])).alias("dir"))
    every = env.where("dir <> ''").unionByName(build)
    return (every if configs is None else every.unionByName(output_directories(configs))).distinct()


def sources(listing: DataFrame, extensions: tuple[str, ...] = SOURCE_EXTENSIONS, configs: DataFrame | None = None) -> DataFrame:
    """listing without excluded folders and other files, in order of path; configs(path, content) has the tsconfig.json files."""
    g = scope(listing, configs)
    p = F.col("path")
    dirs = F.slice(paths.segments(p), 1, F.size(paths.segments(p)) - 1)
    named = F.exists(dirs, lambda d: d.isin(*EXCLUDED) | d.startswith(".") | d.endswith(".egg-info"))
    kept = listing.where(~named & paths.extension(p).isin(*extensions))
    inside = kept.select(*g, "path", F.explode(paths.ancestors(p)).alias("dir")).join(excluded_directories(listing, configs), [*g, "dir"], "left_semi").select(*g, "path").distinct()
    return kept.join(inside, [*g, "path"], "left_anti").orderBy(*g, "path")


class ScanLimit(ValueError):
    """No source file, or more than the limit."""


def within_limits(files: DataFrame, most: int | None = MAX_FILES) -> DataFrame:
    n = files.limit((most or 0) + 1).count()
    if n == 0 or (most is not None and n > most):
        raise ScanLimit("no source file" if n == 0 else f"more than {most} source files")
    return files


def manifests(listing: DataFrame, depth: int = 6) -> DataFrame:
    p = F.col("path")
    dirs = F.slice(paths.segments(p), 1, F.size(paths.segments(p)) - 1)
    skip = F.exists(dirs, lambda d: d.isin("node_modules", "__pycache__", "site-packages", "dist", "build") | d.startswith("."))
    return listing.where(paths.name_of(p).isin("package.json", "pyproject.toml") & ~skip & (F.size(dirs) <= depth)).orderBy("path")


def sniff_one(data: bytes | None) -> str:
    """text, empty, binary or invalid-encoding, by the first 8192 bytes."""
    head = (data or b"")[:SAMPLE_BYTES]
    if not head:
        return "empty"
    if 0 in head:
        return "binary"
    control = sum(b < 32 and b not in (9, 10, 13) for b in head) + head.count(127)
    if control > CONTROL_RATIO * len(head):
        return "binary"
    text = head.decode("utf-8", "replace")
    lost = text.count("�")
    return "invalid-encoding" if lost >= REPLACED_LEAST and lost > REPLACED_RATIO * len(text) else "text"


def sniff(content: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(sniff_one), T.StringType())(content)


def unsafe(path: str) -> bool:
    """Whether an entry's path is absolute or leads out of its folder; what else may be wrong with a path is judged by its column."""
    depth = 0
    for part in path.replace("\\", "/").split("/"):
        depth += -1 if part == ".." else part not in ("", ".")
        if depth < 0:
            return True
    return path[:1] in ("/", "\\")


def archive_entries(archives: DataFrame, cap: int = MAX_BYTES) -> DataFrame:
    """(archive, path, content, status) of archives(path, content): every entry of a zip file; status is null for those that may be read.

    Paths and links are judged before anything is inflated; entries that are damaged, encrypted or packed in an unknown
    way are unreadable, and the others of their archive are read all the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows, total = [], 0
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data))
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(name, "", None, "not-an-archive", 0)], columns=["archive", "path", "content", "status", "attr"])
                    continue
                for e in archive.infolist():
                    if e.is_dir():
                        continue
                    total += e.file_size
                    mode = e.external_attr >> 16 & 0xF000
                    if mode == 0xA000 or unsafe(e.filename):
                        rows.append((name, e.filename, None, None, e.external_attr))
                        continue
                    if total > cap:
                        rows.append((name, e.filename, None, "too-large", e.external_attr))
                        continue
                    try:
                        body = archive.read(e)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error):
                        rows.append((name, e.filename, None, "unreadable", e.external_attr))
                        continue
                    rows.append((name, e.filename, body, None if len(body) == e.file_size else "size-mismatch", e.external_attr))
                yield pd.DataFrame(rows, columns=["archive", "path", "content", "status", "attr"])

    raw = archives.select("path", "content").mapInPandas(run, "archive string, path string, content binary, status string, attr long")
    reason = F.coalesce("status", F.when(paths.is_symlink(F.col("attr")), "symlink"), paths.valid_path(F.col("path")))
    return raw.select("archive", "path", F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("status"))


REFERENCE = r"^(?:https?://)?(?:www\.)?[^/]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?(?:/tree/([^?#]+))?/?(?:[?#].*)?$"


def repository_reference(url: Column) -> Column:
    """(owner, repo, ref) of a hosting address; nulls if it is none."""
    parts = [F.nullif(F.regexp_extract(url, REFERENCE, i), F.lit("")) for i in (1, 2, 3)]
    return F.struct(parts[0].alias("owner"), parts[1].alias("repo"), parts[2].alias("ref"))
