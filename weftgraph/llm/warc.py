"""WARC segments and a Merkle audit of their fixity.

Pages are written as WARC/1.1 records into segments of a few megabytes, with
each record's offset range. Fixity of a replica is a tree of SHA-256 digests:
a leaf for every offset range of a segment in order (the records, and what
follows the last one), inner nodes over sixteen children each up to the
segment's root, over the segments' roots of a part of the table, sixteen at a
time, and over the parts up to one root for the collection. Two replicas' trees
are raised to the height that the larger one needs, so that one which has more
segments or parts differs at the root. Nodes hash their own offset range with their children's digests, so
moved content shows as well as changed content. An audit compares two replicas'
roots and, only where they differ, their children, level by level, down to the
damaged ranges: the nodes of a level are a folder of their own, and of these
only the children of mismatching parents meet.

Defined cases: a null html is an empty body, a null or empty url the URI
``urn:page:<id>``; control characters and spaces in a url are percent-encoded.
Repeated rows and null page_ids get a record each. A segment that a replica
lacks has every range "missing"; one that only the replica has is "extra". An
empty table has no segments, and auditing it finds nothing. Only page_id, url
and html are read. A very long page is one record, and its segment as long as
it; a segment is hashed in one task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, materialize

SEGMENT_BYTES = 4 << 20
FAN = 16
CRLF = b"\r\n"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, html: str | None, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """One resource record; the same page always gives the same bytes."""
    body = (html or "").encode()
    uri = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {uri}")
    head = [
        "WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + 2 * CRLF + body + 2 * CRLF


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, body) of each record; ValueError where the bytes are no record."""
    at = 0
    while at < len(data):
        end = data.find(2 * CRLF, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        stop = end + 4 + int(fields["Content-Length"])
        if data[stop : stop + 4] != 2 * CRLF:
            raise ValueError(f"the record at byte {at} has another length than it says")
        yield at, stop + 4 - at, fields, data[end + 4 : stop]
        at = stop + 4


ENTRY = "array<struct<page_id: long, offset: long, length: long>>"
SEGMENTS = f"chunk int, seq int, warc binary, entries {ENTRY}"
ENTRY_TYPE = pa.list_(pa.struct([("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))


def write_segments(pages: DataFrame, most: int = SEGMENT_BYTES) -> DataFrame:
    """(chunk, seq, warc, entries): the seq-th segment of the chunk-th part of the table."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        chunk, seq, held, size, entries = TaskContext.get().partitionId(), 0, [], 0, []

        def segment():
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([seq], pa.int32()), pa.array([b"".join(held)], pa.binary()), pa.array([entries], ENTRY_TYPE)],
                names=["chunk", "seq", "warc", "entries"],
            )

        for b in batches:
            for page, url, html in zip(*(c.to_pylist() for c in b.columns)):
                r = record(page, url, html)
                entries.append({"page_id": page, "offset": size, "length": len(r)})
                held.append(r)
                size += len(r)
                if size >= most:
                    yield segment()
                    seq, held, size, entries = seq + 1, [], 0, []
        if held:
            yield segment()

    return pages.select(pages["page_id"].cast("long"), "url", "html").mapInArrow(run, SEGMENTS)


def node(begin: int, end: int, children: bytes) -> bytes:
    return hashlib.sha256(f"{begin}-{end}:".encode() + children).digest()


def segment_tree(data: bytes, ranges: list[tuple[int, int]]) -> list[list[tuple[int, int, bytes]]]:
    """Levels of (begin, end, digest) from the leaves up to one root; the last leaf is what lies after the ranges."""
    after = ranges[-1][1] if ranges else 0
    spans = [*ranges, (after, max(len(data), after))]
    mem = memoryview(data)
    levels = [[(a, b, node(a, b, hashlib.sha256(mem[a:b]).digest())) for a, b in spans]]
    while len(levels[-1]) > 1:
        low = levels[-1]
        groups = [low[i : i + FAN] for i in range(0, len(low), FAN)]
        levels.append([(g[0][0], g[-1][1], node(g[0][0], g[-1][1], b"".join(x[2] for x in g))) for g in groups])
    return levels


#: Nodes of a replica: level counts from the leaves of a segment (kind 0) and from the segments (kind 1).
NODES = pa.schema(
    [("kind", pa.int32()), ("chunk", pa.int32()), ("seq", pa.int32()), ("level", pa.int32()), ("idx", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("digest", pa.string()), ("top", pa.bool_())]
)
NODES_DDL = "kind int, chunk int, seq int, level int, idx long, begin long, end long, digest string, top boolean"


def segment_nodes(replica: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """All nodes below segments, hashed by the entries of the segment (of ``ranges``, if the replica brings none it can be trusted with)."""
    if ranges is not None:
        replica = replica.select("chunk", "seq", "warc").join(ranges.select("chunk", "seq", "entries"), ["chunk", "seq"], "left")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, seq = b.column("chunk")[i].as_py(), b.column("seq")[i].as_py()
                data = b.column("warc")[i].as_buffer() if b.column("warc")[i].is_valid else b""
                entries = b.column("entries")[i]
                ranges = []
                if entries.is_valid:
                    flat = entries.values
                    begin, size = flat.field("offset").to_numpy(), flat.field("length").to_numpy()
                    ranges = list(zip(begin.tolist(), (begin + size).tolist()))
                levels = segment_tree(data, ranges)
                rows = [(level, k, a, e, d.hex()) for level, own in enumerate(levels) for k, (a, e, d) in enumerate(own)]
                n = len(rows)
                level, k, a, e, d = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * n, pa.int32()) for v in (0, chunk, seq)]
                    + [pa.array(level, pa.int32()), pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(e, pa.int64()), pa.array(d), pa.array([x == len(levels) - 1 for x in level])],
                    schema=NODES,
                )

    return replica.select("chunk", "seq", "warc", "entries").mapInArrow(run, NODES_DDL)


def inner(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """A digest for each group of nodes: of its range and its children's digests in order."""
    children = F.sort_array(F.collect_list(F.struct(order, "digest")))
    text = F.concat(F.min(order).cast("string"), F.lit("-"), F.max(order).cast("string"), F.lit(":"), F.array_join(F.transform(children, lambda c: c["digest"]), ""))
    return rows.groupBy(*by).agg(F.sha2(text, 256).alias("digest"))


def levels_over(last: int | None) -> int:
    """How often numbers up to ``last`` are divided by sixteen until one is left."""
    levels = 0
    while last is not None and last >= FAN**levels:
        levels += 1
    return levels


class ReplicaTree:
    """Nodes below segments, and the segments' own; heights: the levels that seq and chunk need above them.

    Above segments ids at one level are the lower ones divided by sixteen, so a child names its parent and no numbers
    need to be dealt out over the whole table.
    """

    def __init__(self, segments: DataFrame, label: str, ranges: DataFrame | None = None):
        self.label = f"warc-{label}"
        self.below = materialize(segment_nodes(segments, ranges), self.label, by="level")
        self.roots = self.below.where("top").select("chunk", F.col("seq").cast("long").alias("id"), "digest")
        self.heights = tuple(map(levels_over, self.roots.agg(F.max("id"), F.max("chunk")).first()))

    def raised(self, heights: tuple[int, int]) -> tuple[list[DataFrame], list[DataFrame]]:
        """Levels from the segments up to one node a chunk, (chunk, id, digest), and from the chunks up to the root, (id, digest); the first that aren't nodes below segments are written."""
        inside = [self.roots]
        for _ in range(heights[0]):
            up = inner(inside[-1].withColumn("up", F.floor(F.col("id") / FAN).cast("long")), ["chunk", "up"], "id").withColumnRenamed("up", "id")
            inside.append(materialize(up, f"{self.label}-segments") if len(inside) == 1 else up)
        over = [materialize(inside[-1].select(F.col("chunk").cast("long").alias("id"), "digest"), f"{self.label}-chunks")]
        for _ in range(heights[1]):
            over.append(inner(over[-1].withColumn("up", F.floor(F.col("id") / FAN).cast("long")), ["up"], "id").withColumnRenamed("up", "id"))
        return inside, over


def differ(a: DataFrame, b: DataFrame, by: list[str], within: DataFrame | None) -> DataFrame:
    """Keys of nodes whose digests differ or that one side lacks, among the children of ``within``."""
    if within is not None:
        up = within.withColumnRenamed("id", "up")
        keys = [*by[:-1], "up"]
        a, b = (x.withColumn("up", F.floor(F.col("id") / FAN).cast("long")).join(up, keys, "left_semi") for x in (a, b))
    b = b.select(*by, F.col("digest").alias("other"))
    return a.join(b, by, "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select(*by)


def audit(ours: ReplicaTree, theirs: ReplicaTree, label: str = "warc") -> DataFrame:
    """(chunk, seq, idx, begin, end, status) of the ranges in which theirs is damaged, missing or extra."""
    spark = ours.below.sparkSession
    empty = spark.createDataFrame([], "chunk int, seq int, idx long, begin long, end long, status string")
    heights = tuple(map(max, zip(ours.heights, theirs.heights)))
    (a_in, a_over), (b_in, b_over) = ours.raised(heights), theirs.raised(heights)
    written = [x for x in (*a_in, *a_over, *b_in, *b_over) if hasattr(x, "stored_at")]
    if a_over[-1].collect() == b_over[-1].collect():  # the roots: a row each, or none
        for x in written:
            discard(x)
        return empty
    within = None
    for a, b in zip(reversed(a_over), reversed(b_over)):
        within = differ(a, b, ["id"], within)
    within = within.select(F.col("id").cast("int").alias("chunk"), F.lit(0).cast("long").alias("id"))
    for a, b in zip(reversed(a_in), reversed(b_in)):
        within = differ(a, b, ["chunk", "id"], within)
    bad = within.select("chunk", F.col("id").cast("int").alias("seq"))
    bad = materialize(bad, f"{label}-segments")
    # within segments: each is entered at the higher of its two trees' tops, and children are those with idx div 16 of a mismatch
    tops = ours.below.where("top").select("chunk", "seq", "level").unionByName(theirs.below.where("top").select("chunk", "seq", "level"))
    entered = tops.join(bad, ["chunk", "seq"]).groupBy("chunk", "seq").agg(F.max("level").alias("level"))
    entered = materialize(entered, f"{label}-entered")
    highest = entered.agg(F.max("level")).first()[0]
    status = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("damaged")
    here = None
    for level in range(-1 if highest is None else highest, -1, -1):
        parents = entered.where(F.col("level") == level).select("chunk", "seq", F.lit(0).cast("long").alias("up"))
        if here is not None:
            parents = parents.unionByName(here.select("chunk", "seq", F.col("idx").alias("up")))
        a, b = (
            t.below.where(F.col("level") == level).withColumn("up", F.floor(F.col("idx") / FAN)).join(parents, ["chunk", "seq", "up"], "left_semi").select("chunk", "seq", "idx", "begin", "end", "digest")
            for t in (ours, theirs)
        )
        b = b.select("chunk", "seq", "idx", F.col("begin").alias("b2"), F.col("end").alias("e2"), F.col("digest").alias("other"))
        both = a.join(b, ["chunk", "seq", "idx"], "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        here = materialize(both.select("chunk", "seq", "idx", F.coalesce("begin", "b2").alias("begin"), F.coalesce("end", "e2").alias("end"), status.alias("status")), f"{label}-level")
    for x in (bad, entered, *written):
        discard(x)
    return empty if here is None else here


def damaged_copy(segments: DataFrame, hit: Callable[[int | None, bytes], bool], lost: Callable[[int | None], str | None] = lambda _: None) -> DataFrame:
    """A replica in which one byte is flipped in the middle of each record for which hit(page_id, record) holds.

    lost(page_id of a segment's first record) says "removed" or "truncated" for segments that are left out, or end in
    the middle of their last record.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = np.frombuffer(b.column("warc")[i].as_buffer(), dtype=np.uint8).copy()
                entries = b.column("entries")[i].as_py() or []
                fate = lost(entries[0]["page_id"]) if entries else None
                if fate == "removed":
                    continue
                for e in entries:
                    a, n = e["offset"], e["length"]
                    if hit(e["page_id"], data[a : a + n].tobytes()):
                        data[a + n // 2] ^= 0x20
                if fate == "truncated":
                    data = data[: entries[-1]["offset"] + entries[-1]["length"] // 2]
                yield pa.RecordBatch.from_arrays([b.column("chunk").slice(i, 1), b.column("seq").slice(i, 1), pa.array([data.tobytes()], pa.binary()), b.column("entries").slice(i, 1)], names=["chunk", "seq", "warc", "entries"])

    return segments.select("chunk", "seq", "warc", "entries").mapInArrow(run, SEGMENTS)


def planted(page_id: int | None, _: bytes) -> bool:
    """The records that the fixity drill damages: about one in a hundred, by the CRC-32 of the id."""
    return zlib.crc32(str(page_id).encode()) % 101 == 7


def planted_loss(page_id: int | None) -> str | None:
    """Which segments the drill removes or truncates, by the id of their first record: about one in twenty each."""
    return {3: "removed", 11: "truncated"}.get(zlib.crc32(f"segment {page_id}".encode()) % 20)


def fixity_drill(pages: DataFrame, hit: Callable[[int | None, bytes], bool] = planted, lost: Callable[[int | None], str | None] = planted_loss) -> DataFrame:
    """Write pages as segments, damage a copy, audit it: a row for every range of every segment with its digest and what the audit says.

    Ranges are the records and, with a null page_id and is_record false, what follows a segment's last record.
    """
    segments = materialize(write_segments(pages), "warc-written")
    ours = ReplicaTree(segments, "ours")
    theirs = ReplicaTree(damaged_copy(segments, hit, lost), "theirs")
    found = audit(ours, theirs).select("chunk", "seq", "idx", "begin", "end", "status")
    records = segments.select("chunk", "seq", F.posexplode("entries").alias("pos", "entry")).select("chunk", "seq", F.col("pos").cast("long").alias("idx"), F.col("entry.page_id").alias("page_id"), F.lit(True).alias("is_record"))
    leaves = ours.below.where("level = 0").select("chunk", "seq", "idx", F.col("begin").alias("b1"), F.col("end").alias("e1"), F.col("digest").alias("leaf_sha256"))
    out = leaves.join(records, ["chunk", "seq", "idx"], "left").join(found, ["chunk", "seq", "idx"], "full")
    begin, end = F.coalesce("b1", "begin"), F.coalesce("e1", "end")
    out = out.select(
        "page_id", F.coalesce("is_record", F.lit(False)).alias("is_record"), F.format_string("%05d-%05d", "chunk", "seq").alias("segment"), begin.alias("offset"), (end - begin).alias("length"),
        "leaf_sha256", F.coalesce("status", F.lit("intact")).alias("status"),
    )
    out = materialize(out, "warc-drill")
    for x in (segments, ours.below, theirs.below):
        discard(x)
    return out
