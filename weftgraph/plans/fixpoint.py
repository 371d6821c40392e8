"""Fixpoints over edge tables (src, dst): reachability, components, strongly connected components.

Every round is written to the checkpoint folder, so lineage stays short and a
lost executor costs a re-read. Frontiers are joined semi-naively: only what was
new in the last round meets the edges again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = f"{tempfile.gettempdir()}/weftgraph-checkpoints"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*parts: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for df in parts:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tables(parts: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one scan."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(p.stored_at for p in parts))


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(seed, node): all nodes that a seed reaches over (src, dst), the seed itself included; seeds has a column node.

    Shallow graphs end after as many rounds as they are deep; on deep ones the frontier is one row a round, and
    closure() takes a logarithm of rounds instead.
    """
    edges = written(edges.select("src", "dst").distinct())
    # every round writes its frontier only
    frontiers = [written(seeds.select(F.col("node").alias("seed"), "node").distinct())]
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        last = frontiers[-1]
        step = last.join(edges, last["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        found = written(step.join(tables(frontiers), ["seed", "node"], "left_anti"))
        if found.isEmpty():
            forget(found)
            break
        frontiers.append(found)
        rounds += 1
    out = written(tables(frontiers))
    forget(edges, *frontiers)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of one edge or more, by squaring: log2(depth) rounds, for small or shallow graphs."""
    paths = written(edges.select("src", "dst").distinct())
    n = paths.count()
    while True:
        more = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        longer = written(paths.unionByName(more).distinct())
        forget(paths)
        paths = longer
        now = paths.count()
        if now == n:
            return paths
        n = now


def numbered(names: DataFrame) -> DataFrame:
    """(node, id): a written table with a number for each distinct node."""
    return written(names.select("node").where("node is not null").distinct().withColumn("id", F.monotonically_increasing_id()))


def by_number(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges(src, dst) with the numbers of their ends; edges of other nodes are left out."""
    a, b = names.select(F.col("node").alias("src"), F.col("id").alias("s")), names.select(F.col("node").alias("dst"), F.col("id").alias("t"))
    return edges.select("src", "dst").join(a, "src").select("s", "dst").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))


def stars(edges: DataFrame) -> DataFrame:
    """(node, component): each end of an edge (src, dst) of numbers and the least number that it hangs together with, written.

    Every node hooks its larger neighbours onto the least node it sees, then what lies below onto the least there, so
    that edges become stars in a logarithm of rounds, and a dense graph is sparse after the first.
    """
    held = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined: the join has a shuffle of its own then, which deals out a hub
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        below = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        grown = written(below.where("u <> v").distinct())
        forget(least, large, low, held)
        held = grown
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    out = written(held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    forget(held)
    return out


def named_by_least(names: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) of all names: the least name of a component of found(node, component), in numbers; others stand for themselves."""
    least = written(found.join(names.select(F.col("id").alias("node"), F.col("node").alias("name")), "node").groupBy("component").agg(F.min("name").alias("least")))
    moved = found.join(least, "component").select(F.col("node").alias("id"), "least")
    return names.join(moved, "id", "left").select("node", F.coalesce("least", "node").alias("component"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges in either direction; edges of unknown nodes count for nothing.

    Nodes that are no numbers are numbered first, so that rounds move numbers and not names.
    """
    if nodes.schema["node"].dataType.typeName() == "long":
        known = nodes.select("node").distinct()
        inner = edges.select("src", "dst").join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
        return known.join(stars(inner.select("src", "dst")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    names = numbered(nodes)
    return named_by_least(names, stars(by_number(edges, names)))


def hashed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """names(node, id) and raw edges(src, dst) in numbers, which are hashes: no join is needed. None if two names share one."""
    both = lambda c: [F.xxhash64(c), F.xxhash64(F.lit(1), c)]
    x, y = both("node")
    names = written(nodes.select("node").where("node is not null").distinct().select("node", x.alias("id"), y.alias("check")))
    a, b = both("src"), both("dst")
    ends = written(edges.where("src is not null and dst is not null").select(a[0].alias("src"), b[0].alias("dst"), a[1].alias("x"), b[1].alias("y")))
    told = ends.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("x").alias("check")), F.struct(F.col("dst").alias("id"), F.col("y").alias("check")))).alias("e")).select("e.*")
    clash = told.unionByName(names.select("id", "check")).groupBy("id").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b")
    if clash.isEmpty():
        return names, ends
    forget(names, ends)
    return None


def in_numbers(nodes: DataFrame, edges: DataFrame, known: bool = True) -> tuple[DataFrame, DataFrame]:
    """names(node, id) and the edges as distinct pairs of numbers without loops, both written; unless known is false, only those between nodes."""
    if nodes.schema["node"].dataType.typeName() == "long":
        got = written(nodes.select("node").where("node is not null").distinct().withColumn("id", F.col("node"))), written(edges.select("src", "dst"))
    else:
        got = hashed(nodes, edges)
    if got is None:
        every = nodes.select("node") if known else nodes.select("node").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node")))
        names = numbered(every)
        got = names, written(by_number(edges, names))
    names, ends = got
    inner = ends.select("src", "dst").where("src <> dst").distinct()
    for end in ("src", "dst") if known else ():
        inner = inner.join(names.select(F.col("id").alias(end)), end, "left_semi")
    inner = written(inner.select("src", "dst"))
    forget(ends)
    return names, inner


def pull_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains of distinct edges(src, dst) of numbers, without loops, drawn together; written tables.

    An edge is a link if its source has no other edge out and its target no other edge into it: links are disjoint
    paths and rings. paths(node, end, steps) has the nodes of paths but for their ends; rings(node, component) those of
    rings; rest(src, dst) the other edges, from the end of a path to the end of a path (a loop where a path closes):
    they leave paths at their ends and enter them at their heads only. Steps double, so a path of n nodes takes log2(n) rounds.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    marked = written(edges.join(out, "src").join(into, "dst").select("src", "dst", F.expr("n_out = 1 and n_in = 1").alias("link")))
    link = F.col("link")
    parts = [written(marked.where(link).select(F.col("src").alias("node"), F.col("dst").alias("end"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")))]
    before = None
    while True:
        active, done = parts[-1].where("open"), tables(parts).where("not open")
        now = active.count()
        if now == before or now == 0:
            break
        before = now
        # where the end of a piece begins another one, the two are one
        every = active.unionByName(done).select(F.col("node").alias("at"), F.col("end").alias("far"), F.col("steps").alias("more"))
        parts.append(written(active.join(every, F.col("end") == F.col("at"), "left").select("node", F.coalesce("far", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("at").isNotNull().alias("open"))))
    # were any of the open ones on a path, those next to its end would have met it
    rings = stars(marked.where(link).join(active.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")) if now else written(active.select("node", F.col("end").alias("component")))
    paths = written(done.drop("open"))
    forget(*parts)
    head = paths.select(F.col("node").alias("dst"), "end")
    rest = written(marked.where(~link).select("src", "dst").join(head, "dst", "left").select("src", F.coalesce("end", "dst").alias("dst")).distinct())
    forget(marked)
    return paths, rings, rest


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have edges into them and out of them, round by round; edges is a written table and goes."""
    n = edges.count()
    while n:
        out, into = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        left = written(edges.join(out, "dst", "left_semi").join(into, "src", "left_semi").select("src", "dst"))
        forget(edges)
        edges, before, n = left, n, left.count()
        if n == before:
            break
    return edges


def strong_core(edges: DataFrame) -> DataFrame | None:
    """(node, component) of the strongly connected components of two nodes or more, written; None if there are none.

    What lies on no cycle is trimmed, nodes with edges both ways become one, and so on; a round of colours is for
    graphs with neither.
    """
    edges = trimmed(written(edges.where("src <> dst").distinct()))
    if edges.isEmpty():
        forget(edges)
        return None
    mutual = edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    found = stars(mutual)
    if found.isEmpty():
        forget(found)
        found = one_colour(edges)
        gone = found.select("node")
        left = edges.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
        deeper = strong_core(left)
        several = found.where("node <> component")
        out = several.unionByName(several.select(F.col("component").alias("node"), "component").distinct())
        out = written(out if deeper is None else out.unionByName(deeper))
        forget(found, edges, *([deeper] if deeper is not None else []))
        return out if not out.isEmpty() else None
    of, to = found.select(F.col("node").alias("src"), F.col("component").alias("s")), found.select(F.col("node").alias("dst"), F.col("component").alias("d"))
    merged = edges.join(to, "dst", "left").join(of, "src", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"))
    deeper = strong_core(merged)
    forget(edges)
    if deeper is None:
        return found
    whole = deeper.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    below = found.join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    out = written(below.unionByName(deeper.join(found, "node", "left_anti").select("node", "component")))
    forget(found, deeper)
    return out


def one_colour(edges: DataFrame) -> DataFrame:
    """(node, component) of some of the strongly connected components, those of one node too; written.

    The greatest node spreads forward until colours are stable; what reaches its colour's root backward within the
    colour is a component.
    """
    colour = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")))
    while not colour.where("moved").isEmpty():
        sent = edges.join(colour.where("moved"), edges["src"] == colour["node"]).groupBy("dst").agg(F.max("colour").alias("high"))
        nxt = written(colour.join(sent, colour["node"] == sent["dst"], "left").select("node", F.greatest("colour", "high").alias("colour"), F.coalesce(F.col("high") > F.col("colour"), F.lit(False)).alias("moved")))
        forget(colour)
        colour = nxt
    a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2"))
    inside = edges.join(a, "src").join(b, "dst").where("c1 = c2")
    back = reachable(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour").select("node"))
    least = written(back.groupBy("seed").agg(F.min("node").alias("component")))
    out = written(back.join(least, "seed").select("node", "component"))
    forget(back, least, colour)
    return out


def strong_numbers(paths: DataFrame, rings: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pull_chains(): (end, component) of the paths' ends that lie in components of two nodes or more, and (node, component) of all such nodes; written."""
    loops = rest.where("src = dst").select(F.col("src").alias("end")).distinct()
    core = strong_core(rest)
    if core is None:
        ends = written(loops.select("end", F.col("end").alias("component")))
    else:
        ends = written(core.select(F.col("node").alias("end"), "component").unionByName(loops.join(core.select(F.col("node").alias("end")), "end", "left_anti").select("end", F.col("end").alias("component"))))
    inner = paths.join(ends, "end").select("node", "component")
    return ends, written(inner.unionByName(ends.select(F.col("end").alias("node"), "component")).unionByName(rings.select("node", "component")))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of its strongly connected component; edges of unknown nodes count for nothing.

    Names are numbered and chains drawn together first, so rounds move few rows and no names; see pull_chains(), strong_core().
    """
    names, inner = in_numbers(nodes, edges)
    paths, rings, rest = pull_chains(inner)
    ends, found = strong_numbers(paths, rings, rest)
    forget(inner, paths, rest, ends)
    return named_by_least(names, found)


def forest_sums(weights: DataFrame, up: DataFrame) -> DataFrame:
    """(node, total) of weights(node, weight): the weight of the node and of all that lead to it over up(node, to), a forest; written.

    The distance that is summed doubles in each round.
    """
    total, jump = written(weights.select("node", F.col("weight").alias("total"))), written(up)
    while not jump.isEmpty():
        sent = jump.join(total, "node").groupBy(F.col("to").alias("node")).agg(F.sum("total").alias("more"))
        grown = written(total.join(sent, "node", "left").select("node", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
        further = written(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.to").alias("to")))
        forget(total, jump)
        total, jump = grown, further
    forget(jump)
    return total


def ancestor_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n): how many others reach each node over edges(src, dst); ends of edges that aren't in nodes count as well.

    Strongly connected components become one node, and so do chains. Of the acyclic graph that is left, a node with one
    edge out reaches what that edge's target reaches, so it counts with the next node on its way that has several
    (or none): pairs are kept only for nodes with several edges out and what they reach. These remain quadratic in
    graphs where most nodes have several.
    """
    names, inner = in_numbers(nodes, edges, known=False)
    paths, rings, rest = pull_chains(inner)
    ends, found = strong_numbers(paths, rings, rest)
    forget(found)
    # place(id, c, less): the node of the acyclic graph that holds it, and how many nodes on its path come after it
    own = paths.select("node", "end", "steps").unionByName(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("end"), F.lit(0).cast("long").alias("steps")))
    own = own.unionByName(paths.select(F.col("end").alias("node"), "end", F.lit(0).cast("long").alias("steps"))).distinct()
    placed = own.join(ends, "end", "left").select("node", F.coalesce("component", "end").alias("c"), F.when(F.col("component").isNull(), F.col("steps")).otherwise(0).alias("less"))
    place = written(placed.unionByName(rings.select("node", F.col("component").alias("c"), F.lit(0).cast("long").alias("less"))))
    weights = written(place.groupBy(F.col("c").alias("node")).agg(F.count("*").alias("weight")))
    to = ends.select(F.col("end").alias("dst"), F.col("component").alias("d"))
    of = ends.select(F.col("end").alias("src"), F.col("component").alias("s"))
    dag = rest.join(to, "dst", "left").join(of, "src", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"))
    dag = written(dag.where("src <> dst").distinct())
    degree = written(dag.groupBy("src").agg(F.count("*").alias("n"), F.max("dst").alias("to")))
    total = forest_sums(weights, degree.where("n = 1").select(F.col("src").alias("node"), "to"))
    seen = reachable(dag, degree.where("n > 1").select(F.col("src").alias("node")))
    far = seen.where("seed <> node").join(total.select(F.col("node").alias("seed"), "total"), "seed").groupBy("node").agg(F.sum("total").alias("far"))
    counts = written(total.join(far, "node", "left").select(F.col("node").alias("c"), (F.col("total") + F.coalesce("far", F.lit(0)) - 1).alias("n")))
    n = written(place.join(counts, "c").select(F.col("node").alias("id"), (F.col("n") - F.col("less")).alias("n")))
    forget(inner, paths, rest, ends, place, weights, dag, degree, total, seen, counts)
    return names.join(n, "id", "left").select("node", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
