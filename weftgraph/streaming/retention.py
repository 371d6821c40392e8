"""Retention: when documents expire, what a sweep removes, and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Days that each choice keeps a document; manual ones stay (fixed values).
DAYS = {"7d": 7, "30d": 30, "manual": None}


def expires_at(created: Column, choice: Column) -> Column:
    out = F.lit(None).cast("timestamp")
    for name, days in DAYS.items():
        if days is not None:
            out = F.when(choice == name, created + F.expr(f"INTERVAL {days} DAYS")).otherwise(out)
    return out


def is_expired(expiry: Column, now: Column) -> Column:
    """Never without an expiry; at its very moment already."""
    return F.coalesce(expiry <= now, F.lit(False))


def live(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(~is_expired(F.col("expires_at"), now))


def sweep(rows: DataFrame, today: Column, budget: int | None = None) -> DataFrame:
    """Rows of days up to today, oldest first; the table is partitioned by expiry_day, so later days aren't read. ``budget`` bounds one sweep."""
    due = rows.where(F.col("expiry_day") <= today).orderBy("expiry_day", "id")
    return due if budget is None else due.limit(budget)


def save_by_day(rows: DataFrame, path: str) -> None:
    rows.withColumn("expiry_day", F.to_date("expires_at")).write.partitionBy("expiry_day").mode("append").parquet(path)


#: What kind of event becomes what kind of parse error.
REASONS = {"path": "unreadable", "content": "unreadable", "resource": "timeout"}


def as_parse_errors(events: DataFrame) -> DataFrame:
    """(path, severity, reason, message) of events(type, path, detail)."""
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("type")]
    return events.select("path", F.lit("fatal").alias("severity"), reason.alias("reason"), F.col("detail").alias("message")).where("reason is not null")


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to a table, each once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, end, by, n) in tumbling or sliding windows; on streams late rows are dropped beyond the watermark. An extra: the reference has no windows."""
    e = events.withWatermark(time, late) if late else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return e.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def trail(visits: DataFrame, most: int = 12) -> DataFrame:
    """(owner, step, kind, id): what each owner looked at last, each thing once at its last visit, the latest ``most``; visits(owner, kind, id, nth)."""
    from pyspark.sql import Window

    last = visits.groupBy("owner", "kind", "id").agg(F.max("nth").alias("nth"))
    mine = Window.partitionBy("owner")
    kept = last.withColumn("back", F.row_number().over(mine.orderBy(F.desc("nth")))).where(F.col("back") <= most)
    return kept.select("owner", F.row_number().over(mine.orderBy("nth")).cast("long").alias("step"), "kind", "id")
