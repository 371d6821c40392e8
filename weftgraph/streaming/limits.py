"""Sliding-log admission: a hit is admitted if every rule has room, and only admitted hits count.

As a stream it is a stateful processor keyed by client; as a batch the same
decisions are made over each client's hits in order. A client's hits are
decided one after another by definition; state is bounded by the rules' limits,
and a client's goes when the watermark has passed all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Rule:
    name: str
    window_ms: int
    most: int


MINUTE = 60_000
#: Budgets by route (fixed values).
RULES = {
    "aiPerClient": (Rule("ai-client-minute", MINUTE, 6), Rule("ai-client-hour", 60 * MINUTE, 40)),
    "aiGlobal": (Rule("ai-global-minute", MINUTE, 20),),
    "analyze": (Rule("analyze-10min", 10 * MINUTE, 6), Rule("analyze-day", 24 * 60 * MINUTE, 40)),
    "delete": (Rule("delete-10min", 10 * MINUTE, 10),),
    "diagram": (Rule("diagram-minute", MINUTE, 30), Rule("diagram-day", 24 * 60 * MINUTE, 300)),
    "og": (Rule("og-minute", MINUTE, 120), Rule("og-day", 24 * 60 * MINUTE, 1000)),
    "upload": (Rule("upload-10min", 10 * MINUTE, 10),),
}
DECISIONS = "client string, t_ms long, admitted boolean, rule string, retry_after_s long"


def decide(log: dict[str, list[int]], now: int, rules: tuple[Rule, ...]) -> tuple[bool, str | None, int | None]:
    """(admitted, failed rule, seconds to wait); log holds admitted times by rule and is changed only if the hit is admitted."""
    for r in rules:
        log[r.name] = [t for t in log.get(r.name, ()) if now - t < r.window_ms]
    for r in rules:
        if len(log[r.name]) >= r.most:
            wait = min(log[r.name]) + r.window_ms - now
            return False, r.name, max(1, -(-wait // 1000))
    for r in rules:
        log[r.name].append(now)
    return True, None, None


STREAMED = DECISIONS + ", late boolean"


class Limiter(StatefulProcessor):
    """State of a client: the admitted times of each rule, at most a rule's limit of them, and the latest time decided.

    With event time a timer is set to when the last admitted hit leaves the widest window. No hit that the watermark
    lets through then can meet a kept time, so the state goes without changing a decision. A hit before the latest one
    decided in an earlier batch is decided all the same, and marked late.
    """

    def __init__(self, rules: tuple[Rule, ...], evict: bool):
        self.rules, self.evict = rules, evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getMapState("log", "rule string", "times array<long>")
        self.last = handle.getValueState("last", "t_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = {r.name: list(self.log.getValue((r.name,))[0]) if self.log.containsKey((r.name,)) else [] for r in self.rules}
        before = self.last.get()[0] if self.last.exists() else None
        out, t = [], before
        for t in sorted(x for b in rows for x in b["t_ms"].tolist()):
            out.append((key[0], t, *decide(log, t, self.rules), before is not None and t < before))
        for name, times in log.items():
            self.log.updateValue((name,), (times,))
        self.last.update((max(t, before or t),))
        if self.evict:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(x for times in [*log.values(), [t]] for x in times) + max(r.window_ms for r in self.rules))
        yield frame(out, "late")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def frame(rows: list[tuple], *more: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["client", "t_ms", "admitted", "rule", "retry_after_s", *more]).astype({"retry_after_s": "Int64"})


def limited_stream(hits: DataFrame, rules: tuple[Rule, ...], event_time: str | None = None) -> DataFrame:
    """Decisions over a stream of hits(client, t_ms), with late; needs a RocksDB state store.

    event_time names a column with a watermark that holds the time of t_ms: the state of idle clients then goes. Without
    it a client once seen is kept.
    """
    own = hits.select("client", "t_ms", *([event_time] if event_time else []))
    return own.groupBy("client").transformWithStateInPandas(statefulProcessor=Limiter(rules, event_time is not None), outputStructType=STREAMED, outputMode="append", timeMode="EventTime" if event_time else "None")


def limited_batch(hits: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The same decisions over a table: each client's hits stream through a sorted partition, with the log as the only state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, log = object(), {}
        for b in batches:
            out = []
            for c, t in zip(b["client"], b["t_ms"]):
                if c != client:
                    client, log = c, {}
                out.append((c, t, *decide(log, int(t), rules)))
            if out:
                yield frame(out)

    return hits.select("client", "t_ms").repartition("client").sortWithinPartitions("client", "t_ms").mapInPandas(run, DECISIONS)


def client_key(forwarded: Column, real_ip: Column) -> Column:
    """The first forwarded address, else the connection's, else one key for all."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(real_ip), F.lit("")), F.lit("unknown-client"))
