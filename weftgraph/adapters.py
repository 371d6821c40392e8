"""Graphs derived from the driver's tables, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, path): region/nation."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("key"), F.concat("r_name", F.lit("/"), "n_name").alias("path"))


def trade_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): lines from a supplier's nation to a customer's."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    names = nation_paths(spark, sf_dir)
    flow = (
        line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(supp, line["l_suppkey"] == supp["s_suppkey"])
        .join(cust, orders["o_custkey"] == cust["c_custkey"]).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    )
    a, b = names.select(F.col("key").alias("s_nationkey"), F.col("path").alias("src")), names.select(F.col("key").alias("c_nationkey"), F.col("path").alias("dst"))
    return flow.join(a, "s_nationkey").join(b, "c_nationkey").select("src", "dst", "n")


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_paths(spark, sf_dir).select("path", (F.col("key") + 10).cast("long").alias("line_count"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for every flow."""
    return trade_flow(spark, sf_dir).select(F.concat("src", F.lit("->"), "dst").alias("id"), "src", "dst")


TRADE = """names AS (SELECT n_nationkey AS key, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
flow AS (SELECT a.path AS src, b.path AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN customer ON o_custkey = c_custkey JOIN names a ON s_nationkey = a.key JOIN names b ON c_nationkey = b.key GROUP BY 1, 2),
edges AS (SELECT src || '->' || dst AS id, src, dst FROM flow),
nodes AS (SELECT path, CAST(key + 10 AS BIGINT) AS line_count FROM names)"""


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_count): src/region/nation/segment/customer; every third customer lies in tests/."""
    c = table(spark, sf_dir, "customer")
    names = nation_paths(spark, sf_dir)
    top = F.when(F.col("c_custkey") % 3 == 0, "tests").otherwise("src")
    path = F.concat_ws("/", top, "path", "c_mktsegment", "c_name")
    return c.join(F.broadcast(names), c["c_nationkey"] == names["key"]).select(path.alias("path"), (F.col("c_custkey") % 200 + 1).cast("long").alias("line_count"), "c_custkey")


FILES = """names AS (SELECT n_nationkey AS key, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
files AS (SELECT (CASE WHEN c_custkey % 3 = 0 THEN 'tests' ELSE 'src' END) || '/' || path || '/' || c_mktsegment || '/' || c_name AS path,
  CAST(c_custkey % 200 + 1 AS BIGINT) AS line_count, c_custkey FROM customer JOIN names ON c_nationkey = key)"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): brand/type/part-key.ts, with the spaces of types as folders."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws("/", F.lower("p_brand"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.concat(F.lit("part"), F.col("p_partkey").cast("string"), F.lit(".ts"))).alias("path"), "p_partkey")


PARTS = """parts AS (SELECT lower(p_brand) || '/' || replace(lower(p_type), ' ', '/') || '/part' || CAST(p_partkey AS VARCHAR) || '.ts' AS path, p_partkey FROM part)"""


#: Lines that one task sorts, where the table has more of them than Spark's partitions would take.
TASK_LINES = 200_000


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks the lines are dealt out to, so that none has to spill; none where Spark's own number is enough."""
    tasks = -(-table(spark, sf_dir, "lineitem").count() // TASK_LINES)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a part imports the part whose key is its supplier's in each of its lines (distinct)."""
    p = part_files(spark, sf_dir)
    tasks = line_tasks(spark, sf_dir)
    dealt = lambda rows, key: rows.repartition(tasks, key) if tasks else rows
    # dealt out by part, lines are made distinct and met by their parts where they are
    line = dealt(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey").distinct()
    a, b = p.select(F.col("p_partkey").alias("l_partkey"), F.col("path").alias("src")), p.select(F.col("p_partkey").alias("l_suppkey"), F.col("path").alias("dst"))
    return dealt(line.join(a, "l_partkey"), "l_suppkey").join(b, "l_suppkey").select("src", "dst")


PART_EDGES = PARTS + """, pedges AS (SELECT a.path AS src, b.path AS dst FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN parts a ON a.p_partkey = l_partkey JOIN parts b ON b.p_partkey = l_suppkey)"""


#: Rows of orders that one task sorts; the graph of orders has more tasks where there are more of them.
TASK_ORDERS = 200_000


def order_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the graph of orders is dealt out to, so that a task's memory doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "orders").count() // TASK_ORDERS))


def order_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = nation_paths(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    return c.join(F.broadcast(names), c["c_nationkey"] == names["key"]).select("c_custkey", "c_mktsegment", "path")


def order_rows(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """(path, line_count, k, region, c_mktsegment, nth, m, before, last): each order with its customer's order before it and last order, from one sort."""
    own = order_customers(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(tasks, "o_custkey")
    w = Window.partitionBy("k").orderBy("o_orderdate", "o_orderkey")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = o.join(own, o["o_custkey"] == own["c_custkey"]).select(
        F.concat("path", F.lit("/c"), F.col("c_custkey").cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path"),
        (F.col("o_orderkey") % 200 + 1).cast("long").alias("line_count"), F.col("o_custkey").alias("k"), F.split("path", "/")[0].alias("region"), "c_mktsegment", "o_orderdate", "o_orderkey",
    )
    rows = rows.withColumns({"nth": F.row_number().over(w), "m": F.count("*").over(every), "before": F.lag("path").over(w), "last": F.last("path").over(every)})
    return rows.drop("o_orderdate", "o_orderkey")


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_count, k, region, nth, m): region/nation/customer/order, and a library for each market segment.

    nth of m is an order's place among its customer's, by date; they are null for libraries.
    """
    rows = order_rows(spark, sf_dir, order_tasks(spark, sf_dir)).drop("before", "last")
    none = F.lit(None)
    lib = order_customers(spark, sf_dir).select(F.concat(F.lit("lib/"), "c_mktsegment", F.lit(".ts")).alias("path")).distinct()
    lib = lib.select("path", F.lit(50).cast("long").alias("line_count"), none.cast("long").alias("k"), none.cast("string").alias("region"), none.cast("string").alias("c_mktsegment"), none.cast("int").alias("nth"), none.cast("long").alias("m"))
    return rows.unionByName(lib)


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse directed graph over order_nodes, with chains, cycles, loops and hubs.

    An order imports its customer's order before it, the first one the library of the segment; the last order of
    customer k that of customer k / 2, if its region comes no later; with every tenth customer the first imports the
    last too, with every twenty-fifth the last itself; and the least library imports the least order.
    """
    tasks = order_tasks(spark, sf_dir)
    o = order_rows(spark, sf_dir, tasks)
    # what lies within a customer comes from its rows at once
    chain = F.when(F.col("nth") == 1, F.concat(F.lit("lib/"), "c_mktsegment", F.lit(".ts"))).otherwise(F.col("before"))
    first = F.when(F.expr("nth = 1 and m > 1 and k % 10 = 0"), F.col("last"))
    loop = F.when(F.expr("nth = m and k % 25 = 1"), F.col("path"))
    within = o.select("path", F.explode(F.filter(F.array(chain, first, loop), lambda x: x.isNotNull())).alias("dst"))
    last = o.where("nth = m").select("k", "path", "region")
    half = last.select(F.col("k").alias("h"), F.col("path").alias("dst"), F.col("region").alias("other"))
    up = last.where("k > 1").join(half, F.floor(F.col("k") / 2) == F.col("h")).where("region >= other").select("path", "dst")
    n = order_nodes(spark, sf_dir)
    least = n.agg(F.min(F.when(F.col("k").isNull(), F.col("path"))).alias("path"), F.min("path").alias("dst")).where("path is not null")
    every = within.unionByName(up).unionByName(least)
    return every.select(F.concat("path", F.lit("->"), "dst").alias("id"), F.col("path").alias("src"), "dst")


ORDERS = """cust AS (SELECT c_custkey AS k, c_mktsegment AS seg, r_name AS region, r_name || '/' || n_name || '/c' || c_custkey AS dir FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ords AS MATERIALIZED (SELECT k, seg, region, dir || '/o' || o_orderkey || '.ts' AS path, CAST(o_orderkey % 200 + 1 AS BIGINT) AS line_count, row_number() OVER (PARTITION BY k ORDER BY o_orderdate, o_orderkey) AS nth, count(*) OVER (PARTITION BY k) AS m FROM orders JOIN cust ON o_custkey = k),
lasts AS (SELECT k, region, path FROM ords WHERE nth = m),
nodes AS MATERIALIZED (SELECT path, line_count FROM ords UNION ALL SELECT DISTINCT 'lib/' || seg || '.ts', CAST(50 AS BIGINT) FROM cust),
pairs AS MATERIALIZED (SELECT a.path AS src, b.path AS dst FROM ords a JOIN ords b ON a.k = b.k AND a.nth = b.nth + 1 UNION ALL SELECT path, 'lib/' || seg || '.ts' FROM ords WHERE nth = 1
  UNION ALL SELECT a.path, b.path FROM lasts a JOIN lasts b ON a.k // 2 = b.k AND a.k > 1 AND a.region >= b.region UNION ALL SELECT a.path, b.path FROM ords a JOIN lasts b ON a.k = b.k WHERE nth = 1 AND m > 1 AND a.k % 10 = 0
  UNION ALL SELECT path, path FROM lasts WHERE k % 25 = 1 UNION ALL SELECT min(path) FILTER (WHERE path LIKE 'lib/%'), min(path) FROM nodes),
edges AS MATERIALIZED (SELECT src || '->' || dst AS id, src, dst FROM pairs)"""
