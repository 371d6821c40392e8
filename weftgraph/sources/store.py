"""Where analyses are kept: tables partitioned by analysis, cached explanations by key, and an index of owners by expiry day."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an analysis is named (a fixed value).
ANALYSIS_ID = re.compile(r"[a-fA-F0-9-]{36}")
EXPLANATION_KEY = re.compile(r"[a-f0-9]{64}")


Result = TypeVar("Result")


class BudgetSpent(RuntimeError):
    """The work took longer than it was given."""


def within_budget(spark: SparkSession, seconds: float, work: Callable[[Callable[[], None]], Result]) -> Result:
    """work(check), whose Spark jobs are cancelled when the time is up; check() raises then, for the steps between jobs."""
    sc, group, spent = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        spent.set()
        sc.cancelJobGroup(group)

    def check() -> None:
        if spent.is_set():
            raise BudgetSpent(f"over {seconds} s")

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "work within a budget", True)
    timer.start()
    try:
        out = work(check)
        check()
        return out
    except Exception as e:
        if spent.is_set() and not isinstance(e, BudgetSpent):
            raise BudgetSpent(f"over {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.interruptOnCancel", None)


def owner_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def owns(token: Column, expected: Column) -> Column:
    """Whether a token is the one whose hash was kept; never for an empty token or anything but 64 lower-case hex digits."""
    return F.coalesce((token != "") & expected.rlike("^[a-f0-9]{64}$") & (owner_hash(token) == expected), F.lit(False))


class Store:
    """Tables below ``root`` on any file system that Spark writes to. One partition an analysis: loading one reads no other."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, kind: str, analysis: str) -> str:
        if not ANALYSIS_ID.fullmatch(analysis):
            raise ValueError(f"{analysis!r} names no analysis")
        return f"{self.root}/{kind}/analysis_id={analysis}"

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def save(self, analysis: str, **tables: DataFrame) -> None:
        """All tables of an analysis; those that it had before under these names are replaced."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self._folder(f"analyses/{name}", analysis))

    def save_within(self, analysis: str, seconds: float, build: Callable[[Callable[[], None]], dict[str, DataFrame]]) -> None:
        """Save the tables that build(check) gives, if all is done in time; else nothing of the analysis stays, and BudgetSpent is raised."""

        def work(check: Callable[[], None]) -> None:
            tables = build(check)
            for name, df in tables.items():
                check()
                self.save(analysis, **{name: df})

        try:
            within_budget(self.spark, seconds, work)
        except BaseException:
            self.delete(analysis)
            raise

    def load(self, analysis: str, name: str) -> DataFrame | None:
        """One table of an analysis, or None."""
        path = self._folder(f"analyses/{name}", analysis)
        return self.spark.read.parquet(path) if self._there(path) else None

    def load_all(self, name: str) -> DataFrame:
        """One table of every analysis, with analysis_id."""
        return self.spark.read.option("basePath", f"{self.root}/analyses/{name}").parquet(f"{self.root}/analyses/{name}")

    def save_explanation(self, analysis: str, key: str, value: str) -> None:
        if EXPLANATION_KEY.fullmatch(key):
            row = self.spark.createDataFrame([(value,)], "value string")
            row.write.mode("overwrite").parquet(f"{self._folder('explanations', analysis)}/key={key}")

    def load_explanation(self, analysis: str, key: str) -> str | None:
        path = f"{self._folder('explanations', analysis)}/key={key}"
        row = self.spark.read.parquet(path).first() if EXPLANATION_KEY.fullmatch(key) and self._there(path) else None
        return row["value"] if row else None

    def register(self, owners: DataFrame) -> None:
        """Append owners(id, token_hash, expires_at) to the index: a folder for each day on which something expires, and one for what never does."""
        day = F.coalesce(F.date_format("expires_at", "yyyy-MM-dd"), F.lit("never"))
        owners.select("id", "token_hash", "expires_at", day.alias("expiry_day")).write.partitionBy("expiry_day").mode("append").parquet(f"{self.root}/owners")

    def expiring(self, day: str) -> DataFrame:
        """(id, token_hash, expires_at, expiry_day) of what expires up to a day; later days are not read."""
        index = self.spark.read.option("basePath", f"{self.root}/owners").schema("id string, token_hash string, expires_at timestamp, expiry_day string").parquet(f"{self.root}/owners")
        return index.where((F.col("expiry_day") <= day) & (F.col("expiry_day") != "never"))

    def delete(self, analysis: str) -> None:
        """All that is kept of an analysis, for its table names as found."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/analyses")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        for path in [*(self._folder(f"analyses/{n}", analysis) for n in names), self._folder("explanations", analysis)]:
            self._drop(path)

    def save_adjacency(self, name: str, edges: DataFrame, buckets: int) -> None:
        """Keep edges(src, dst, ...) twice as tables of the catalog, bucketed by either end: joins on it deal out the other side only."""
        for end in ("src", "dst"):
            edges.write.mode("overwrite").bucketBy(buckets, end).sortBy(end).format("parquet").saveAsTable(f"{name}_by_{end}")

    def step(self, name: str, frontier: DataFrame, backward: bool = False) -> DataFrame:
        """(path): what frontier(path) imports, or what imports it."""
        here, there = ("dst", "src") if backward else ("src", "dst")
        edges = self.spark.table(f"{name}_by_{here}")
        return edges.join(frontier.select(F.col("path").alias(here)), here).select(F.col(there).alias("path")).distinct()
