"""Column functions over source paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|specs?|e2e)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|_test\.(go|py)$"
TOUR_TEST_PATH = r"(?:\.(?:test|spec)\.[^/]+$|(?:^|/)(?:__tests__|__mocks__|tests?|e2e)/|(?:^|/)test_[^/]*\.py$|_test\.(?:py|go)$)"
SUPPORT_PATH = r"(?:^|/)(?:examples?|demos?|benchmarks?|docs?|website|scripts?|sandbox|fixtures?|playground|stories)/"
DECLARATION_FILE = r"\.d\.[cm]?ts$"
LAYER_WORDS = (
    "api", "app", "application", "components", "config", "core", "data", "domain", "infrastructure", "infra", "lib", "middleware",
    "model", "persistence", "presentation", "routes", "services", "shared", "ui", "utils", "views", "web",
)
PYTHON_STDLIB = (
    "abc", "argparse", "asyncio", "base64", "collections", "contextlib", "copy", "csv", "dataclasses", "datetime", "enum", "functools",
    "glob", "hashlib", "heapq", "importlib", "inspect", "io", "itertools", "json", "logging", "math", "multiprocessing", "os", "pathlib",
    "pickle", "random", "re", "shutil", "signal", "socket", "sqlite3", "statistics", "string", "subprocess", "sys", "tempfile",
    "threading", "time", "traceback", "typing", "unittest", "urllib", "uuid", "warnings", "weakref", "__future__",
)
#: Modules that come with the JavaScript run time (public names of its standard library).
NODE_BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns",
    "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode",
    "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm",
    "wasi", "worker_threads", "zlib",
)

Path = Column


def segments(path: Path) -> Column:
    return F.split(path, "/")


def directory(path: Path) -> Column:
    """Everything before the last slash; "" at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def name_of(path: Path) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Path) -> Column:
    """With its dot, in lower case; "" if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^/.]+)$", 1))


def language(path: Path) -> Column:
    e = extension(path)
    return F.when(e.isin(".ts", ".tsx", ".mts", ".cts"), "typescript").when(e == ".py", "python").when(e == ".go", "go").otherwise("javascript")


def ancestors(path: Path) -> Column:
    """All directories that a path lies in, outermost first."""
    parts = segments(path)
    return F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ).otherwise(F.array().cast("array<string>"))


def proposed_folder(path: Path) -> Column:
    parts = segments(path)
    return (
        F.when(F.size(parts) == 1, "root")
        .when((parts[0] == "src") & (F.size(parts) > 2), F.concat(F.lit("src/"), F.try_element_at(parts, F.lit(2))))
        .otherwise(parts[0])
    )


def is_test(path: Path) -> Column:
    return path.rlike(TEST_PATH)


def is_declaration(path: Path) -> Column:
    return path.rlike(DECLARATION_FILE)


def layer(path: Path) -> Column:
    """The innermost directory that is a layer word, in lower case, else the top directory; null for files at the top."""
    dirs = F.slice(segments(path), 1, F.size(segments(path)) - 1)
    words = F.filter(F.transform(F.reverse(dirs), F.lower), lambda d: d.isin(*LAYER_WORDS))
    return F.when(F.size(segments(path)) > 1, F.coalesce(F.try_element_at(words, F.lit(1)), dirs[0]))


def domain(path: Path) -> Column:
    """The top directory, or the one below ``src``, of paths at least two directories deep; null if it is a layer word."""
    parts = segments(path)
    pick = F.when(F.lower(parts[0]) == "src", F.try_element_at(parts, F.lit(2))).otherwise(parts[0])
    return F.when((F.size(parts) > 2) & ~F.lower(pick).isin(*LAYER_WORDS), pick)


def package_name(specifier: Column, lang: Column) -> Column:
    """The package that an external specifier belongs to; null for standard libraries."""
    slash, dot = F.split(specifier, "/"), F.split(specifier, r"\.")
    go = F.when(slash[0].contains("."), F.array_join(F.slice(slash, 1, 3), "/"))
    python = F.when((dot[0] != "") & ~dot[0].isin(*PYTHON_STDLIB), dot[0])
    scoped = F.when(specifier.startswith("@"), F.array_join(F.slice(slash, 1, 2), "/")).otherwise(slash[0])
    js = F.when(~specifier.startswith("node:") & ~scoped.isin(*NODE_BUILTINS), scoped)
    return F.when(specifier != "", F.when(lang == "Go", go).when(lang == "Python", python).otherwise(js))


def valid_path(path: Path) -> Column:
    """Null for a path that may be extracted, else why not."""
    depth = F.aggregate(
        segments(F.regexp_replace(path, r"\\", "/")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, p: F.struct(
            (s["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(s["low"], s["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low"),
        ),
        lambda s: F.least(s["low"], s["at"] - 1),  # a path that ends at the root names no file in it
    )
    return (
        F.when(path.isNull() | (path == "") | path.contains("\x00"), "traversal")
        .when(F.length(path) > 4096, "path-too-long")
        .when(path.rlike(r"^[/\\]|^[A-Za-z]:[/\\]"), "absolute-path")
        .when(depth < 0, "traversal")
    )


def is_symlink(external_attributes: Column) -> Column:
    """By the Unix mode in a zip entry's external attributes."""
    return F.shiftrightunsigned(external_attributes, 16).bitwiseAND(F.lit(0xF000)) == 0xA000


def normalised(path: Path) -> Column:
    """Without ".", and with ".." taking its parent away; null where that would leave the top."""
    kept = F.aggregate(
        segments(path),
        F.array().cast("array<string>"),
        lambda out, p: F.when(p.isin("", "."), out)
        .when(p == "..", F.when(F.size(out) > 0, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))))
        .when(out.isNotNull(), F.concat(out, F.array(p))),
    )
    return F.array_join(kept, "/")
