"""Registries of language parsers and of analyzers, with capability coverage and degradation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RegistryError(ValueError):
    """Two entries claim the same id or extension, or an analyzer depends on what doesn't come before it."""


@dataclass(frozen=True)
class Parser:
    """parse takes contents(path, content) of the parser's files and returns their raw imports."""

    id: str
    extensions: tuple[str, ...]
    capabilities: tuple[str, ...]
    parse: Callable[[DataFrame], DataFrame]


class ParserRegistry:
    def __init__(self):
        self.parsers: dict[str, Parser] = {}
        self.by_extension: dict[str, Parser] = {}

    def register(self, parser: Parser) -> None:
        if parser.id in self.parsers:
            raise RegistryError(f"parser {parser.id} is there already")
        taken = [e for e in parser.extensions if e in self.by_extension]
        if taken:
            raise RegistryError(f"{', '.join(taken)}: {self.by_extension[taken[0]].id} reads these")
        self.parsers[parser.id] = parser
        self.by_extension |= dict.fromkeys(parser.extensions, parser)

    def extract(self, contents: DataFrame) -> DataFrame:
        """What each parser finds in its own files, together."""
        ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
        parts = [p.parse(contents.where(ext.isin(*p.extensions))) for p in self.parsers.values()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


@dataclass(frozen=True)
class Analyzer:
    """run takes the results so far by id; requires maps a capability to what happens without it: skip or degrade."""

    id: str
    tier: int
    run: Callable[[dict[str, DataFrame]], DataFrame]
    depends_on: tuple[str, ...] = ()
    requires: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Run:
    id: str
    status: str  # ok, degraded or skipped
    reason: str
    result: DataFrame | None


def coverage(files: DataFrame, capability: str) -> DataFrame:
    """One row (capability, supported, missing, complete) of files(path, capabilities)."""
    has = F.array_contains("capabilities", capability)
    return files.agg(F.count_if(has).alias("supported"), F.count_if(~has).alias("missing")).select(F.lit(capability).alias("capability"), "supported", "missing", (F.col("missing") == 0).alias("complete"))


class AnalyzerRegistry:
    def __init__(self):
        self.analyzers: list[Analyzer] = []

    def register(self, a: Analyzer) -> None:
        known = {x.id: x.tier for x in self.analyzers}
        if a.id in known:
            raise RegistryError(f"analyzer {a.id} is there already")
        if bad := [d for d in a.depends_on if known.get(d, a.tier) >= a.tier]:
            raise RegistryError(f"{a.id} depends on {', '.join(bad)}, which no earlier tier has")
        self.analyzers.append(a)

    def run(self, inputs: dict[str, DataFrame], missing: dict[str, int]) -> list[Run]:
        """Runs by tier; missing counts the files without each capability. A skipped dependency skips, a degraded one degrades."""
        done: dict[str, Run] = {}
        results = dict(inputs)
        for a in sorted(self.analyzers, key=lambda x: x.tier):
            lost = [c for c in a.requires if missing.get(c, 0)]
            skipped = [d for d in a.depends_on if done[d].status == "skipped"] + [c for c in lost if a.requires[c] == "skip"]
            weak = [d for d in a.depends_on if done[d].status == "degraded"] + [c for c in lost if a.requires[c] == "degrade"]
            status = "skipped" if skipped else "degraded" if weak else "ok"
            out = None if skipped else a.run(results)
            if out is not None:
                results[a.id] = out
            done[a.id] = Run(a.id, status, "; ".join(skipped or weak), out)
        return list(done.values())
