"""Bounded evidence about a graph, and claims held against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths, texts
from weftgraph.operators.confidence import with_folders
from weftgraph.operators.graph import degrees, impact


def likely_entries(degree: DataFrame, n: int = 8) -> DataFrame:
    """Files that nothing imports and that import something. A top-k report."""
    return degree.where("in_degree = 0 and out_degree > 0").orderBy(F.desc("out_degree"), "path").limit(n)


def region_table(clusters: DataFrame, edges: DataFrame, top: int = 4) -> DataFrame:
    """(folder, n_files, direction, other, n_edges, rank): each region's first neighbours by crossing edges, out of it and into it."""
    e = with_folders(edges, clusters).where("src_folder <> dst_folder").groupBy("src_folder", "dst_folder").agg(F.count("*").alias("n_edges"))
    out = e.select(F.col("src_folder").alias("folder"), F.lit("out").alias("direction"), F.col("dst_folder").alias("other"), "n_edges")
    into = e.select(F.col("dst_folder").alias("folder"), F.lit("in").alias("direction"), F.col("src_folder").alias("other"), "n_edges")
    rk = F.row_number().over(Window.partitionBy("folder", "direction").orderBy(F.desc("n_edges"), "other"))
    size = clusters.groupBy("folder").agg(F.count("*").alias("n_files"))
    return out.unionByName(into).withColumn("rank", rk.cast("long")).where(F.col("rank") <= top).join(size, "folder").select("folder", "n_files", "direction", "other", "n_edges", "rank")


def region_key_files(clusters: DataFrame, degree: DataFrame, lines: DataFrame, n: int = 6) -> DataFrame:
    """(folder, path, weight, rank): of each region the first n by importers, then lines."""
    j = clusters.join(degree, "path").join(lines.select("path", "line_count"), "path").withColumn("weight", F.col("in_degree") * 1000 + F.col("line_count"))
    rk = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("weight"), "path"))
    return j.withColumn("rank", rk.cast("long")).where(F.col("rank") <= n).select("folder", "path", "weight", "rank")


def import_rank(degree: DataFrame) -> DataFrame:
    """(path, rank): one more than the number of files with more importers. Counted by value, so ties share a row of work."""
    by = degree.groupBy("in_degree").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("in_degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # distinct degrees only
    return degree.join(by.select("in_degree", (above + 1).alias("rank")), "in_degree").select("path", "rank")


def supported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id) whose citations all exist: claims(claim_id, kind, id) one row a citation, evidence(kind, id). Claims without a citation have none."""
    known = evidence.select("kind", "id").distinct().withColumn("known", F.lit(True))
    return claims.join(known, ["kind", "id"], "left").groupBy("claim_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("ok")).where("ok").select("claim_id")


def unsupported_figures(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, figure): figures of claims(claim_id, text) that no text of evidence(text) has."""
    said = claims.select("claim_id", F.explode(texts.figures(F.col("text"))).alias("figure")).distinct()
    known = evidence.select(F.explode(texts.figures(F.col("text"))).alias("figure")).distinct()
    return said.join(known, "figure", "left_anti").select("claim_id", "figure")


def final_notes(claims: DataFrame, figures: DataFrame, caption: int = 48, note: int = 240, most: int = 6) -> DataFrame:
    """(unit, text, kind) of grounded claims(nth, section, text, citations): the captions and notes that a figure takes.

    A caption cites one region and nothing else, and has 1 to 48 characters, no digit, no spaces around it and no dots
    at its end; the first for each region stays. Notes have at most 240 characters and only figures of figures(figure);
    the first six stay. citations: array of (kind, id).
    """
    text = F.regexp_replace(F.trim("text"), r"\.+$", "")
    one = (F.size("citations") == 1) & (F.col("citations")[0]["kind"] == "region")
    c = claims.where((F.col("section") == "caption") & one).select("nth", F.col("citations")[0]["id"].alias("unit"), text.alias("text"))
    c = c.where(F.length("text").between(1, caption) & ~F.col("text").rlike(r"\d"))
    c = c.groupBy("unit").agg(F.min_by("text", "nth").alias("text")).select("unit", "text", F.lit("caption").alias("kind"))
    n = claims.where((F.col("section") == "note") & (F.size("citations") > 0) & F.length("text").between(1, note)).select("nth", "text")
    said = n.select("nth", F.explode(texts.figures(F.col("text"))).alias("figure"))
    n = n.join(said.join(figures.select("figure"), "figure", "left_anti").select("nth"), "nth", "left_anti").orderBy("nth").limit(most)
    return c.unionByName(n.select(F.lit(None).cast("string").alias("unit"), "text", F.lit("note").alias("kind")))


def cache_key(*parts: str):
    return F.sha2(F.concat_ws("\n", *(F.col(p) for p in parts)), 256)


def top_folders(files: DataFrame, n: int = 12) -> DataFrame:
    """(folder, n_files) two levels deep. A top-k report."""
    two = F.array_join(F.slice(paths.segments(paths.directory(F.col("path"))), 1, 2), "/")
    return files.groupBy(two.alias("folder")).agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "folder").limit(n)


def answered(tool: str, asked: DataFrame, found: DataFrame) -> DataFrame:
    """(subject, value, claim, citations, uncertain) for each of asked(subject): found(subject, id) are what a query over the graph gave it.

    tool is neighbors-outgoing, neighbors-incoming, neighbors-both or impact. Nothing found is no claim but an uncertainty.
    """
    values = found.groupBy("subject").agg(F.sort_array(F.collect_set("id")).alias("value"))
    out = asked.select("subject").distinct().join(values, "subject", "left").withColumn("value", F.coalesce("value", F.array().cast("array<string>")))
    n = F.size("value").cast("string")
    said = F.concat(F.lit("Changing '"), "subject", F.lit("' may affect "), n, F.lit(" transitive importer(s).")) if tool == "impact" else F.concat(F.lit("Node '"), "subject", F.lit("' has "), n, F.lit(f" {tool.partition('-')[2]} neighbor(s)."))
    some = F.size("value") > 0
    return out.select("subject", "value", F.when(some, said).alias("claim"), F.when(some, F.concat(F.array("subject"), F.col("value"))).alias("citations"), (~some).alias("uncertain"))


def file_facts(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """One row about a file: numbers of files it imports, that import it, and that a change also reaches; its rank by importers, of how many."""
    direct = edges.where((F.col("dst") == path) & (F.col("src") != path)).select(F.col("src").alias("path")).distinct()
    out = edges.where(F.col("src") == path).select("dst").distinct().agg(F.count("*").alias("imports"))
    into = edges.where(F.col("dst") == path).select("src").distinct().agg(F.count("*").alias("imported_by"))
    far = impact(nodes, edges, path).select("path").join(direct, "path", "left_anti").agg(F.count("*").alias("indirect"))
    rank = import_rank(degrees(nodes, edges).select("path", "in_degree")).where(F.col("path") == path).select("rank")
    every = nodes.agg(F.count("*").alias("of"))
    return out.crossJoin(into).crossJoin(far).crossJoin(rank).crossJoin(every).select(F.lit(path).alias("path"), "imports", "imported_by", "indirect", "rank", "of")  # one row each


# --- answers of language models ---------------------------------------------------------------------------

# Kinds of citations, characters that fonts don't show, and the most characters of each part.
CITATION_KINDS = ("node", "edge", "region", "analyzer-result")
SPACES, UNSHOWN, HYPHEN = "\u2007\u202f\u2009\u200a\u00a0\u3000", "\u200b\u2060\ufeff", "\u2011"
TEXT, SECTION, REFERENCE, REASON = 2000, 60, 500, 300


def said(value: Column, at: str, limit: int) -> Column:
    """The text at a path of a variant, shown spaces plain, cut; "" for anything but text."""
    here = F.try_variant_get(value, at, "variant")
    plain = F.translate(F.try_variant_get(value, at, "string"), SPACES + HYPHEN + UNSHOWN, " " * len(SPACES) + "-")
    return F.when(F.coalesce(F.schema_of_variant(here) == "STRING", F.lit(False)), F.substring(F.trim(plain), 1, limit)).otherwise("")


def objects(value: Column, at: str) -> Column:
    """The objects in the list at a path of a variant; none for anything else."""
    items = F.try_variant_get(value, at, "array<variant>")
    return F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))


def parsed_answers(answers: DataFrame) -> DataFrame:
    """(id, answer, claims, reading_order, uncertainty, ok) of answers(id, text), JSON as models write it.

    Fences are taken off, and text around the outermost braces; ok is false where no object is left, and all else null
    then. Parts of a wrong kind are dropped one by one: claims that are no objects, citations of unknown kinds, steps
    without an id or a reason.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("text"), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))
    v = F.col("v")
    body = answers.select("id", whole.alias("v")).withColumn("ok", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    cited = lambda c: F.transform(F.filter(objects(c, "$.citations"), lambda x: said(x, "$.kind", SECTION).isin(*CITATION_KINDS)), lambda x: F.struct(said(x, "$.kind", SECTION).alias("kind"), said(x, "$.id", REFERENCE).alias("id")))
    claims = F.transform(objects(v, "$.claims"), lambda c: F.struct(said(c, "$.text", TEXT).alias("text"), F.nullif(said(c, "$.section", SECTION), F.lit("")).alias("section"), cited(c).alias("citations")))
    steps = F.filter(F.transform(objects(v, "$.readingOrder"), lambda x: F.struct(said(x, "$.id", REFERENCE).alias("id"), said(x, "$.reason", REASON).alias("reason"))), lambda x: (x["id"] != "") & (x["reason"] != ""))
    answer = F.coalesce(F.nullif(said(v, "$.summary", TEXT), F.lit("")), said(v, "$.answer", TEXT))
    only = lambda c: F.when(F.col("ok"), c)
    return body.select("id", only(answer).alias("answer"), only(claims).alias("claims"), only(steps).alias("reading_order"), only(F.nullif(said(v, "$.uncertainty", TEXT), F.lit(""))).alias("uncertainty"), "ok")
