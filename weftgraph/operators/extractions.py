"""What extraction gave, as files that a path graph is built from and as errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def path_files(extractions: DataFrame) -> DataFrame:
    """(path, line_count, imports, external_imports) of the files without any parse error; extractions also has errors, an array of (message)."""
    return extractions.where(F.size("errors") == 0).select("path", "line_count", "imports", "external_imports")


def parse_errors(extractions: DataFrame) -> DataFrame:
    """(path, message) of the others, messages joined in their order."""
    return extractions.where(F.size("errors") > 0).select("path", F.array_join(F.transform("errors", lambda e: e["message"]), "; ").alias("message"))


def with_events(errors: DataFrame, events: DataFrame) -> DataFrame:
    """errors(path, message) and what safety events(path, detail) say about entries that were refused."""
    return errors.select("path", "message").unionByName(events.select("path", F.col("detail").alias("message")))
