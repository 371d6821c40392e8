"""A reading order measured from the graph: where to start, what is central, what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.plans.fixpoint import written
from weftgraph.operators.graph import rule_of

MOST, STARTS, HUBS, REGION_FILES = 7, 2, 4, 3
#: Entries that are no sensible place to start (fixed values).
NOT_A_START = ("test file", "config file", "Storybook story", "example or demo", "benchmark")


#: Material that isn't the repository's own code, besides tests and support; files that only declare (fixed values).
CONFIG_PATH = r"(?:^|/)[^/]*\.config\.[cm]?[jt]sx?$|(?:^|/)\.[^/]*rc\.[cm]?[jt]s$"
DECLARATIONS = r"(?:^|/)(?:types?|interfaces?|constants?)\.[jt]sx?$|\.d\.ts$"
#: What is read first: (pattern of the path, pattern of the rule, tier, kind; the kind is the rule where it is null). The first that fits counts.
TIERS: tuple[tuple[str, str, float, str | None], ...] = (
    (r"(?:^|/)(?:website|docs?)/", "", 5.0, "docs"),
    ("", r"^script$", 6.0, "script"),
    ("", r'^package\.json "(?:exports|browser)', 4.0, None),
    (r"(?:^|/)route\.[jt]sx?$", r"^Next\.js route$", 3.0, "api"),
    (r"^(?:src/)?app/layout\.[jt]sx?$", r"^Next\.js route$", 0.0, "layout"),
    (r"^(?:src/)?app/page\.[jt]sx?$", r"^Next\.js route$", 0.5, "page"),
    (r"(?:^|/)layout\.[jt]sx?$", r"^Next\.js route$", 1.0, "layout"),
    (r"(?:^|/)page\.[jt]sx?$", r"^Next\.js route$", 1.0, "page"),
    ("", r"^Next\.js route$", 1.0, "route"),
    ("", r'^package\.json "bin"', 0.2, None),
    ("", r'^package\.json "(?:main|module)"', 0.0, None),
    ("", r"^conventional root file$", 0.0, "root"),
    ("", "", 2.0, None),
)
PRIMARY = 2.0  # tiers below are starts of the repository's own


def entry_tier(path: Column, reason: Column) -> Column:
    """(tier, kind): how early an entry comes, and which kind of entry it is."""
    rule = rule_of(reason)
    fits = [F.when(path.rlike(p) & rule.rlike(r), F.struct(F.lit(t).alias("tier"), F.coalesce(F.lit(k), rule).alias("kind"))) for p, r, t, k in TIERS]
    return F.coalesce(*fits)


def is_noise(path: Column) -> Column:
    return path.rlike(paths.TOUR_TEST_PATH) | path.rlike(paths.SUPPORT_PATH) | path.rlike(CONFIG_PATH)


def measured_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, importers, imports, users): distinct, without self-loops; importers that are tests, support or configuration don't count, users are all but tests."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    src = F.col("src")
    into = e.groupBy(F.col("dst").alias("path")).agg(F.count_if(~is_noise(src)).alias("importers"), F.count_if(~src.rlike(paths.TOUR_TEST_PATH)).alias("users"))
    out = e.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("imports"))
    zero = F.lit(0).cast("long")
    return nodes.select("path").join(into, "path", "left").join(out, "path", "left").select("path", *(F.coalesce(c, zero).alias(c) for c in ("importers", "imports", "users")))


def only_declares() -> Column:
    return F.col("path").rlike(DECLARATIONS) | (F.col("imports") == 0)


#: Files in order of how much leans on them.
BY_IMPORTERS = (F.desc, "importers"), (F.desc, "imports"), (F.asc, "path")


def by_importers() -> list[Column]:
    return [f(c) for f, c in BY_IMPORTERS]


def starts(entries: DataFrame, degree: DataFrame) -> DataFrame:
    """(path, phase, place): at most two entries that import something, by tier, depth, imports and path; without any the file with the most imports that only tests import.

    The second is the next one of a primary tier and another tier or kind, if the first is primary too.
    """
    c = entries.join(degree, "path").where((F.col("imports") > 0) & ~rule_of(F.col("reason")).isin(*NOT_A_START))
    c = c.withColumn("at", entry_tier(F.col("path"), F.col("reason"))).withColumn("depth", F.size(paths.segments(F.col("path"))))
    order = F.struct("at.tier", "depth", (-F.col("imports")).alias("less"), "path")
    first = c.agg(F.min_by(F.struct("path", "at"), order).alias("first"), F.count("*").alias("n"))  # one row
    others = c.crossJoin(F.broadcast(first)).where((F.col("path") != F.col("first.path")) & (F.col("at.tier") < PRIMARY) & (F.col("first.at.tier") < PRIMARY) & (F.col("at") != F.col("first.at")))
    second = others.agg(F.min_by("path", order).alias("path")).where("path is not null")
    loose = degree.where((F.col("imports") > 0) & (F.col("users") == 0) & ~is_noise(F.col("path"))).crossJoin(F.broadcast(first.where("n = 0").select("n")))
    root = loose.agg(F.min_by("path", F.struct((-F.col("imports")).alias("less"), "path")).alias("path")).where("path is not null")
    named = [first.where("n > 0").select("first.path", F.lit(1).alias("place")), second.select("path", F.lit(2).alias("place")), root.select("path", F.lit(1).alias("place"))]
    return named[0].unionByName(named[1]).unionByName(named[2]).select("path", F.lit(1).alias("phase"), "place")


def central(degree: DataFrame, clusters: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, phase, place): at most four files that others lean on, in that order: the best of each region without a start first.

    Files that only declare or import nothing don't count, unless most files of all lean on one.
    """
    seen = taken.join(clusters, "path").select("folder").distinct().withColumn("seen", F.lit(True))
    c = degree.where((F.col("importers") > 0) & ~is_noise(F.col("path"))).join(taken, "path", "left_anti").join(clusters, "path").join(seen, "folder", "left")
    top = c.agg(F.min_by("path", F.struct((-F.col("importers")).alias("i"), (-F.col("imports")).alias("o"), "path")).alias("top"))  # one row
    c = c.crossJoin(F.broadcast(top)).where(~only_declares() | (F.col("path") == F.col("top")))
    c = c.withColumn("in_region", F.row_number().over(Window.partitionBy("folder").orderBy(*by_importers())))
    # what is first in a new region comes before all others; at most HUBS rows per region matter
    late = (F.col("in_region") > 1) | F.coalesce("seen", F.lit(False))
    c = c.where(F.col("in_region") <= HUBS).withColumn("chosen", F.row_number().over(Window.orderBy(late, *by_importers()))).where(F.col("chosen") <= HUBS)
    return c.select("path", F.lit(2).alias("phase"), F.row_number().over(Window.orderBy(*by_importers())).alias("place"))


def left_regions(degree: DataFrame, clusters: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, phase, place): of each region of three files or more that nothing was chosen from, the file that most lean on; regions with well connected files first."""
    seen = taken.join(clusters, "path").select("folder").distinct()
    c = degree.where(~is_noise(F.col("path"))).join(clusters, "path").join(seen, "folder", "left_anti")
    fit = ~only_declares() & (F.col("importers") + F.col("imports") > 0)
    g = c.groupBy("folder").agg(
        F.count("*").alias("files"), F.max(F.when(fit, F.col("importers") + F.col("imports"))).alias("weight"),
        F.min_by("path", F.when(fit, F.struct((-F.col("importers")).alias("i"), (-F.col("imports")).alias("o"), "path"))).alias("path"),
    ).where(F.col("files") >= REGION_FILES)
    return g.where("weight is not null").select("path", F.lit(3).alias("phase"), F.row_number().over(Window.orderBy(F.desc("weight"), F.desc("files"), "folder")).alias("place"))


def tour(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, entries: DataFrame) -> DataFrame:
    """(step, path, phase): at most seven files in reading order; a repository that gives none still has its first file."""
    d = written(measured_degrees(nodes, edges))  # read by every phase
    one = starts(entries, d)
    two = central(d, clusters, one.select("path"))
    three = left_regions(d, clusters, one.select("path").unionByName(two.select("path")))
    any_ = nodes.agg(F.min("path").alias("path")).where("path is not null").select("path", F.lit(4).alias("phase"), F.lit(1).alias("place"))
    every = one.unionByName(two).unionByName(three).unionByName(any_)
    step = F.row_number().over(Window.orderBy("phase", "place"))
    every = every.withColumn("step", step.cast("long")).where((F.col("step") <= MOST) & ((F.col("phase") < 4) | (F.col("step") == 1)))
    return every.select("step", "path", F.when(F.col("phase") == 4, 1).otherwise(F.col("phase")).cast("long").alias("phase"))


def chosen_tour(steps: DataFrame, nodes: DataFrame, most: int = 10, least: int = 2) -> DataFrame:
    """(step, path) of a proposed tour(nth, path): known files, each once, at most ten; nothing if fewer than two remain."""
    known = steps.join(nodes.select("path"), "path", "left_semi").groupBy("path").agg(F.min("nth").alias("nth"))
    r = known.select(F.row_number().over(Window.orderBy("nth")).cast("long").alias("step"), "path", F.count("*").over(Window.partitionBy()).alias("n"))
    return r.where((F.col("step") <= most) & (F.col("n") >= least)).select("step", "path")
