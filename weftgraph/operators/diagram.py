"""Budgeted summaries: units, their edges, findings, and Mermaid text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.plans.fixpoint import components, strong_components, written

#: (units, files, edges, notes) that a figure may hold, by preset (fixed values).
BUDGETS = {"document": (24, 32, 28, 6), "slide": (16, 20, 18, 3)}
#: Findings in the order they are reported.
FINDINGS = ("cycle", "test-leak", "hub", "isolated", "misplaced", "unresolved-heavy", "oversized")
OVERSIZED = 60


def top_units(files: DataFrame) -> DataFrame:
    """(path, unit): the top folder of each file, ``src`` opened by one level, files at the top together."""
    parts = paths.segments(F.col("path"))
    unit = F.when(F.size(parts) == 1, "(root files)").when((parts[0] == "src") & (F.size(parts) > 2), F.concat(F.lit("src/"), parts[1])).otherwise(parts[0])
    return files.withColumn("unit", unit)


def merge_smallest(units: DataFrame, budget: int) -> DataFrame:
    """units(path, unit) with the smallest ones, by size and name, together as ``<n> small folders`` where there are more than the budget."""
    size = units.groupBy("unit").agg(F.count("*").alias("n"))
    ranked = size.select("unit", F.row_number().over(Window.orderBy("n", "unit")).alias("rk"), F.count("*").over(Window.partitionBy()).alias("k"))  # one row per unit
    merged = ranked.select("unit", F.when((F.col("k") > budget) & (F.col("rk") <= F.col("k") - budget + 1), F.concat((F.col("k") - budget + 1).cast("string"), F.lit(" small folders"))).otherwise(F.col("unit")).alias("shown"))
    return units.join(merged, "unit").drop("unit").withColumnRenamed("shown", "unit")


def expand(sizes: dict[str, dict[str, int]], loose: dict[str, int], budget: int, max_depth: int = 2, least: int = 3) -> list[str]:
    """Greedy expansion over at most ``budget`` units, on the driver: sizes has the sub-folders of each folder with their files, loose the files directly in it.

    Time after time the largest unit is opened into its sub-folders of at least three files, of which it must have two,
    and one unit for the rest, if the figure still fits.
    """
    total = {u: sum(c.values()) + loose.get(u, 0) for u, c in sizes.items()}
    units = {u: (total[u], 0) for u in sizes if ("/" not in u and not (u == "src" and sizes[u])) or u.rpartition("/")[0] == "src"}
    while True:
        best = None
        for u, (n, depth) in sorted(units.items()):
            kids = {k: m for k, m in sizes.get(u, {}).items() if m >= least}
            rest = n - sum(kids.values())
            parts = len(kids) + (rest > 0)
            if depth < max_depth and len(kids) >= 2 and len(units) - 1 + parts <= budget and (best is None or n > units[best][0]):
                best = u
        if best is None:
            return sorted(units)
        n, depth = units.pop(best)
        kids = {k: m for k, m in sizes[best].items() if m >= least}
        units |= {k: (m, depth + 1) for k, m in kids.items()}
        if n > sum(kids.values()):
            units[f"{best}/*"] = (n - sum(kids.values()), max_depth)


SAMPLE_PARTS = 64


def unit_edges(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, n, samples): imports between units with the five least of their ids, and those inside a unit where both are the same."""
    a, b = units.select(F.col("path").alias("src"), F.col("unit").alias("source")), units.select(F.col("path").alias("dst"), F.col("unit").alias("target"))
    joined = edges.join(a, "src").join(b, "dst").withColumn("id", F.concat("src", F.lit("->"), "dst"))
    # two units can have most of the edges between them: the least ids are found in parts of theirs first
    part = F.pmod(F.xxhash64("id"), F.lit(SAMPLE_PARTS))
    rank = F.row_number().over(Window.partitionBy("source", "target", "part").orderBy("id"))
    ranked = joined.withColumn("part", part).withColumn("rk", rank)
    few = F.sort_array(F.collect_list(F.when(F.col("rk") <= 5, F.col("id"))))
    return ranked.groupBy("source", "target").agg(F.count("*").alias("n"), F.slice(few, 1, 5).alias("samples"))


def flagged(between: DataFrame) -> DataFrame:
    """Edges between different units with ``mutual`` (the reverse edge exists) and ``in_cycle`` (both ends in one strongly connected component)."""
    e = written(between.where("source <> target"))  # read by every step below
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("back"))
    ends = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct()
    scc = strong_components(ends, e.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    a, b = scc.select(F.col("node").alias("source"), F.col("component").alias("c1")), scc.select(F.col("node").alias("target"), F.col("component").alias("c2"))
    j = e.join(back, ["source", "target"], "left").join(a, "source").join(b, "target")
    return written(j.select("source", "target", "n", "samples", F.coalesce("back", F.lit(False)).alias("mutual"), (F.col("c1") == F.col("c2")).alias("in_cycle")))


def shared_parts(units: DataFrame, between: DataFrame) -> DataFrame:
    """(unit, importers): of four parts or more, those that at least three and at least 60 % of the others import."""
    n = units.select("unit").distinct().agg(F.count("*").alias("k"))
    g = between.where("source <> target").groupBy(F.col("target").alias("unit")).agg(F.countDistinct("source").alias("importers"))
    return g.crossJoin(F.broadcast(n)).where("k >= 4 and importers >= 3 and importers >= 0.6 * (k - 1)").select("unit", "importers")  # n is one row


def select_edges(edges: DataFrame, shared: DataFrame, budget: int) -> DataFrame:
    """edges with ``fate``: set-aside (into shared parts, or mutual and out of them), kept (mutual always, the rest by size up to the budget) or dropped."""
    s = shared.select("unit").withColumn("is_shared", F.lit(True))
    into, outof = s.select(F.col("unit").alias("target"), F.col("is_shared").alias("to_shared")), s.select(F.col("unit").alias("source"), F.col("is_shared").alias("from_shared"))
    e = edges.join(into, "target", "left").join(outof, "source", "left")
    e = e.withColumn("aside", F.coalesce("to_shared", F.lit(False)) | (F.coalesce("from_shared", F.lit(False)) & F.col("mutual"))).drop("to_shared", "from_shared")
    free = ~F.col("aside") & ~F.col("mutual")
    many = F.count_if(~F.col("aside") & F.col("mutual")).over(Window.partitionBy())  # a row per pair of units, not per file
    rk = F.row_number().over(Window.partitionBy(free).orderBy(F.desc("n"), F.concat("source", F.lit("->"), "target")))
    e = e.withColumn("many", many).withColumn("rk", rk)
    fate = F.when(F.col("aside"), "set-aside").when(F.col("mutual") | (F.col("rk") <= F.greatest(F.lit(budget) - F.col("many"), F.lit(0))), "kept").otherwise("dropped")
    return e.withColumn("fate", fate).drop("many", "rk", "aside")


def unit_measures(units: DataFrame, edges: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """(unit, files, lines, tests, reduced, internal): units(path, unit, line_count)."""
    u = units if confidence is None else units.join(confidence, "path", "left")
    reduced = F.count_if(F.col("confidence") != "verified") if confidence is not None else F.lit(0).cast("long")
    g = u.groupBy("unit").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.count_if(paths.is_test(F.col("path"))).alias("tests"), reduced.alias("reduced"))
    inside = unit_edges(units, edges).where("source = target").select(F.col("source").alias("unit"), F.col("n").alias("internal"))
    return g.join(inside, "unit", "left").withColumn("internal", F.coalesce("internal", F.lit(0).cast("long")))


def external_packages(externals: DataFrame, language: str | None, n: int = 8) -> DataFrame:
    """(package, files): the n packages that most files use; externals(path, specifier). A top-k report."""
    p = externals.select("path", paths.package_name(F.col("specifier"), F.lit(language)).alias("package")).where("package is not null")
    return p.groupBy("package").agg(F.countDistinct("path").alias("files")).orderBy(F.desc("files"), "package").limit(n)


def cycle_findings(edges: DataFrame) -> DataFrame:
    """(subject, figure): units that import each other in a circle, with their number, under the least of them."""
    c = edges.where("in_cycle")
    ends = c.select(F.col("source").alias("node")).unionByName(c.select(F.col("target").alias("node"))).distinct()
    comp = components(ends, c.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return comp.groupBy("component").agg(F.count("*").alias("figure")).select(F.col("component").alias("subject"), "figure")


def misplaced(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, unit, other, total, most): files with three connections or more, none in their own unit and at least 80 % with one other; the first three."""
    m = units.select("path", "unit")
    e = edges.where("src <> dst")
    both = e.select(F.col("src").alias("path"), F.col("dst").alias("far")).unionByName(e.select(F.col("dst").alias("path"), F.col("src").alias("far")))
    j = both.join(m, "path").join(m.select(F.col("path").alias("far"), F.col("unit").alias("other")), "far")
    per = j.groupBy("path", "unit", "other").agg(F.count("*").alias("n"))
    g = per.groupBy("path", "unit").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("other") == F.col("unit"), F.col("n")).otherwise(0)).alias("own"), F.max(F.struct("n", F.col("other"))).alias("top"))
    f = g.where("total >= 3 and own = 0 and top.n >= 0.8 * total")
    return f.orderBy(F.desc("total"), "path").limit(3).select("path", "unit", F.col("top.other").alias("other"), "total", F.col("top.n").alias("most"))


def findings(units: DataFrame, edges: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """(kind, subject, figure) in their order, of all edges: units(path, unit, line_count), edges(src, dst), unresolved(path, specifier)."""
    between = flagged(unit_edges(units, edges))
    measures = unit_measures(units, edges)
    names = units.select("unit").distinct()
    test = paths.is_test
    # one finding for all: the units that import tests, and how often; the tests needn't be on the figure
    leak = edges.join(units.select(F.col("path").alias("src"), F.col("unit").alias("source")), "src")
    leak = leak.where(~test(F.col("src")) & test(F.col("dst"))).groupBy("source").agg(F.count("*").alias("n"))
    leak = leak.agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("subject"), F.sum("n").alias("figure")).where("figure > 0")  # a figure's units
    touched = between.select(F.col("source").alias("unit")).unionByName(between.select(F.col("target").alias("unit")))
    alone = measures.join(touched, "unit", "left_anti").where("tests < files").join(names.agg(F.count("*").alias("k")).where("k > 1").select(F.lit(True).alias("several")), F.lit(True), "left_semi")
    parts = {
        "cycle": cycle_findings(between), "test-leak": leak, "hub": shared_parts(units, between).select(F.col("unit").alias("subject"), F.col("importers").alias("figure")),
        "isolated": alone.select(F.col("unit").alias("subject"), F.col("files").alias("figure")),
        "misplaced": misplaced(units, edges).select(F.col("path").alias("subject"), F.col("total").alias("figure")),
        "oversized": measures.where(F.col("files") > OVERSIZED).join(splittable(units), "unit", "left_anti").join(folders_of(units), "unit", "left_semi").select(F.col("unit").alias("subject"), F.col("files").alias("figure")),
    }
    if unresolved is not None:
        parts["unresolved-heavy"] = unresolved_heavy(units, edges, unresolved)
    out = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "subject", F.col("figure").cast("long").alias("figure")) for k, df in parts.items()])
    return out.orderBy(finding_order(F.col("kind")), "subject")


def unresolved_heavy(units: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(subject, figure): units with at least three unresolved imports that are over a tenth of these and the resolved."""
    u = unresolved.join(units, "path").groupBy("unit").agg(F.count("*").alias("bad"))
    ok = edges.join(units.select(F.col("path").alias("src"), "unit"), "src").groupBy("unit").agg(F.count("*").alias("good"))
    j = u.join(ok, "unit", "left").withColumn("good", F.coalesce("good", F.lit(0)))
    return j.where("bad >= 3 and bad > 0.1 * (bad + good)").select(F.col("unit").alias("subject"), F.col("bad").alias("figure"))


def folders_of(units: DataFrame) -> DataFrame:
    """(unit) of the units that are folders: all their files lie under their name."""
    return units.groupBy("unit").agg(F.bool_and(F.col("path").startswith(F.concat("unit", F.lit("/")))).alias("under")).where("under").select("unit")


def splittable(units: DataFrame, least: int = 3) -> DataFrame:
    """(unit) of the units whose files' innermost common folder has two sub-folders or more of at least three files."""
    dirs = F.slice(paths.segments(F.col("path")), 1, F.size(paths.segments(F.col("path"))) - 1)
    ends = units.groupBy("unit").agg(F.min(dirs).alias("a"), F.max(dirs).alias("b"))
    same = F.expr("size(filter(sequence(0, least(size(a), size(b))), n -> slice(a, 1, n) = slice(b, 1, n))) - 1")
    below = units.withColumn("dirs", dirs).join(ends.select("unit", same.alias("common")), "unit").where("size(dirs) > common")
    sizes = below.groupBy("unit", F.expr("dirs[common]").alias("child")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sizes.groupBy("unit").agg(F.count("*").alias("k")).where("k >= 2").select("unit")


def finding_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, FINDINGS)), kind)


def key_files(files: DataFrame, units: DataFrame, n: int = 3) -> DataFrame:
    """(unit, path, rank): each file belongs to the unit with the longest path that it lies under; the n with the most importers. files(path, in_degree), units(unit)."""
    under = files.select("path", "in_degree", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("unit")).join(units, "unit")
    own = under.groupBy("path", "in_degree").agg(F.max_by("unit", F.length("unit")).alias("unit"))
    rk = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("in_degree"), "path"))
    return own.withColumn("rank", rk).where(F.col("rank") <= n).select("unit", "path", F.col("rank").cast("long").alias("rank"))


# --- one region -------------------------------------------------------------------------------------------


def region_figure(files: DataFrame, edges: DataFrame, region: str, unresolved: DataFrame | None = None, preset: str = "document", include_tests: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, units, links) of the figure of one region: files(path, folder), edges(src, dst), unresolved(path, specifier).

    Tests are left out if other files are there. The files with the most connections are units of their own, up to the
    preset's budget; beyond it the rest are one overflow unit. Other regions are boundary units, one for what is
    imported from here (in) and one for what is imported there (out); unresolved imports lead to a unit of their own.
    members(path, unit) are the files shown; units(id, kind, label, files); links(source, target, n) are what the
    edges come to, with those inside one unit.
    """
    budget = BUDGETS[preset][1]
    own = files.where(F.col("folder") == region).select("path", paths.is_test(F.col("path")).alias("test"))
    only = own.agg(F.coalesce(F.bool_and("test"), F.lit(True)).alias("only_tests"))
    shown = own.crossJoin(F.broadcast(only)).where(F.lit(include_tests) | ~F.col("test") | F.col("only_tests")).select("path")  # one row
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path")).join(shown, "path", "left_semi").groupBy("path").agg(F.count("*").alias("degree"))
    scored = shown.join(ends, "path", "left").select("path", F.coalesce("degree", F.lit(0)).alias("degree"))
    total = scored.agg(F.count("*").alias("total"))
    chosen = scored.orderBy(F.desc("degree"), "path").limit(budget)
    rank = F.row_number().over(Window.orderBy(F.desc("degree"), "path"))  # of as many rows as the budget
    cut = chosen.select("path", rank.alias("rank")).crossJoin(F.broadcast(total)).where(F.col("rank") <= F.when(F.col("total") > budget, budget - 1).otherwise(budget)).select("path", F.concat(F.lit("f:"), "path").alias("unit"))
    members = written(shown.join(cut, "path", "left").select("path", F.coalesce("unit", F.lit("u:#overflow")).alias("unit")))
    near = files.select("path", "folder")
    a, b = near.select(F.col("path").alias("src"), F.col("folder").alias("from_folder")), near.select(F.col("path").alias("dst"), F.col("folder").alias("to_folder"))
    touching = edges.join(a, "src").join(b, "dst").where((F.col("from_folder") == region) | (F.col("to_folder") == region))
    u, v = members.select(F.col("path").alias("src"), F.col("unit").alias("from_unit")), members.select(F.col("path").alias("dst"), F.col("unit").alias("to_unit"))
    placed = touching.join(u, "src", "left").join(v, "dst", "left")
    inside = (F.col("from_folder") == region) & (F.col("to_folder") == region)
    source = F.when(F.col("from_folder") == region, F.col("from_unit")).otherwise(F.concat(F.lit("b:in:"), "from_folder"))
    target = F.when(F.col("to_folder") == region, F.col("to_unit")).otherwise(F.concat(F.lit("b:out:"), "to_folder"))
    links = placed.select(source.alias("source"), target.alias("target"), inside.alias("inside")).where("source is not null and target is not null").groupBy("source", "target").agg(F.count("*").alias("n"))
    if unresolved is not None:
        lost = unresolved.join(members, "path").groupBy(F.col("unit").alias("source")).agg(F.count("*").alias("n"))
        links = links.unionByName(lost.select("source", F.lit("u:#unresolved").alias("target"), "n"))
    links = written(links)
    size = files.groupBy(F.col("folder").alias("label")).agg(F.count("*").alias("files"))
    far = links.select(F.explode(F.array("source", "target")).alias("id")).where("id like 'b:%'").distinct().withColumn("label", F.regexp_replace("id", "^b:(in|out):", ""))
    mine = members.groupBy(F.col("unit").alias("id")).agg(F.count("*").alias("files"))
    over = F.col("id") == "u:#overflow"
    shown_units = mine.select("id", F.when(over, "overflow").otherwise("file").alias("kind"), F.when(over, F.concat(F.lit("+ "), F.col("files").cast("string"), F.lit(" more files"))).otherwise(paths.name_of(F.col("id"))).alias("label"), "files")
    lost = links.where("target = 'u:#unresolved'").groupBy(F.col("target").alias("id")).agg(F.sum("n").alias("n"))
    units = shown_units.unionByName(far.join(size, "label", "left").select("id", F.lit("boundary").alias("kind"), "label", F.coalesce("files", F.lit(0)).alias("files")))
    units = units.unionByName(lost.select("id", F.lit("unresolved").alias("kind"), F.concat(F.col("n").cast("string"), F.lit(" unresolved imports")).alias("label"), F.lit(0).cast("long").alias("files")))
    return members, units, links


# --- Mermaid ----------------------------------------------------------------------------------------------


def mermaid_label(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), "[<>`]", ""), F.lit('"'), F.lit("#quot;"))


def mermaid_ids(ids: DataFrame) -> DataFrame:
    """(id, name): other characters become underscores; of ids that become equal the later ones, in code-unit order, get _2, _3 ... .

    A number that makes a name some other id already has is passed over, which needs the names in order: this runs
    on one figure's units, of which a budget allows a few dozen.
    """
    names: dict[str, str] = {}
    used: set[str] = set()
    for (i,) in sorted(map(tuple, ids.select("id").collect())):
        plain = "".join(c if c.isascii() and c.isalnum() else "_" for c in i)
        name = plain
        k = 1
        while name in used:
            k += 1
            name = f"{plain}_{k}"
        used.add(name)
        names[i] = name
    return ids.sparkSession.createDataFrame(list(names.items()) or [], "id string, name string")


def plural(n: Column, word: str) -> Column:
    return F.concat(F.format_number(n, 0), F.when(n == 1, f" {word}").otherwise(f" {word}s"))


def mermaid(units: DataFrame, edges: DataFrame, header: str = "") -> DataFrame:
    """One row (text) of a flowchart: units(id, label, files, lines), edges(source, target, n, mutual)."""
    ids = mermaid_ids(units.select("id"))
    u = units.join(ids, "id").select("id", "name", F.concat(F.lit("  "), "name", F.lit('["'), mermaid_label(F.col("label")), F.lit("<br/>"), plural(F.col("files"), "file"), F.lit(" · "), plural(F.col("lines"), "line"), F.lit('"]')).alias("line"))
    a, b = ids.select(F.col("id").alias("source"), F.col("name").alias("from_name")), ids.select(F.col("id").alias("target"), F.col("name").alias("to_name"))
    arrow = F.when(F.col("n") >= 2, F.concat(F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "))).otherwise(" --> ")
    e = edges.join(a, "source").join(b, "target").select(F.concat(F.lit("  "), "from_name", arrow, "to_name").alias("line"), "source", "target")
    cyc = edges.where("mutual").select(F.col("source").alias("id")).unionByName(edges.where("mutual").select(F.col("target").alias("id"))).distinct().join(ids, "id")
    rows = lambda df, *key: df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*key, "line"))), lambda s: s["line"]), "\n").alias("t"))
    mark = cyc.agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("m"))
    parts = rows(u, "id").select(F.col("t").alias("ut")).crossJoin(rows(e, "source", "target").select(F.col("t").alias("et"))).crossJoin(mark)  # one row each
    text = F.concat_ws(
        "\n", *([F.lit(header)] if header else []), F.lit("flowchart LR"), F.when(F.col("ut") != "", F.col("ut")), F.when(F.col("et") != "", F.col("et")),
        F.lit("  classDef cycle stroke:#7A5312,stroke-width:2px"), F.when(F.col("m") != "", F.concat(F.lit("  class "), F.col("m"), F.lit(" cycle"))),
    )
    return parts.select(text.alias("text"))
