"""WARC segments and the Merkle audit."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import warc

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    odd = [(None, None, None, 1), (7, "", "", 1), (7, "http://x/a b\n", "<p>é\r\n\r\nWARC/1.1", 1), (7, "http://x/a b\n", "<p>é\r\n\r\nWARC/1.1", 1), (8, "u", "x" * 300_000, 1)]
    real = spark.read.parquet(f"{DATA}/pages.parquet").selectExpr("page_id + 100 as page_id", "url", "html", "1 as level")
    return real.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string, level int")).repartition(5).cache()


def test_records_can_be_read_back(pages):
    got = []
    for s in warc.write_segments(pages, 10_000).collect():
        read = list(warc.read_records(bytes(s.warc)))
        assert [(a, n) for a, n, _, _ in read] == [(e.offset, e.length) for e in s.entries]
        got += [(e.page_id, body.decode()) for e, (_, _, _, body) in zip(s.entries, read)]
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=key) == sorted(((r.page_id, r.html or "") for r in pages.collect()), key=key)


def damaged(warc_bytes, at):
    data = bytearray(warc_bytes)
    data[at] ^= 1
    return bytes(data)


def test_audit_finds_what_was_changed(spark, pages):
    segments = warc.write_segments(pages, 4_000).collect()
    kind = warc.SEGMENTS
    hurt, want = [], set()
    for i, s in enumerate(segments):
        data = bytes(s.warc)
        for k, e in enumerate(s.entries):
            if (i + k) % 7 == 3:
                data = damaged(data, e.offset + e.length - 1)
                want.add((s.chunk, s.seq, k, "damaged"))
        if i == 2:
            want = {w for w in want if w[:2] != (s.chunk, s.seq)} | {(s.chunk, s.seq, k, "missing") for k in range(len(s.entries) + 1)}
            continue
        if i == 4:
            data += b"tail"
            want.add((s.chunk, s.seq, len(s.entries), "damaged"))
        hurt.append((s.chunk, s.seq, data, s.entries))
    a = warc.ReplicaTree(spark.createDataFrame(segments, kind), "a")
    b = warc.ReplicaTree(spark.createDataFrame(hurt, kind), "b")
    assert {(r.chunk, r.seq, r.idx, r.status) for r in warc.audit(a, b).collect()} == want
    assert warc.audit(a, warc.ReplicaTree(spark.createDataFrame(segments, kind), "c")).count() == 0


def test_drill(pages):
    none = lambda _: None
    got = warc.fixity_drill(pages, lost=none).collect()
    assert sum(r.is_record for r in got) == pages.count() and sum(not r.is_record for r in got) == len({r.segment for r in got})
    assert all((r.status == "damaged") == (r.is_record and zlib.crc32(str(r.page_id).encode()) % 101 == 7) for r in got)
    assert any(warc.planted(i, b"") for i in range(200))
    # segments that are gone or end early
    first = {}
    for r in got:
        if r.is_record:
            first[r.segment] = min(first.get(r.segment, (r.offset, r.page_id)), (r.offset, r.page_id))
    last = {s: max(r.offset for r in got if r.segment == s and r.is_record) for s in first}
    by = {p: ("removed", "truncated", None)[i % 3] for i, (_, p) in enumerate(sorted(first.values(), key=str))}
    fate = {s: by[p] for s, (_, p) in first.items()}
    again = warc.fixity_drill(pages, lambda *_: False, by.get).collect()
    assert len(again) == len(got)
    for r in again:
        damaged = fate[r.segment] == "truncated" and r.is_record and r.offset == last[r.segment]
        assert r.status == ("missing" if fate[r.segment] == "removed" else "damaged" if damaged else "intact"), r


def test_the_audit_descends_into_mismatching_branches_only(spark):
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")).repartition(1)
    segments = warc.materialize(warc.write_segments(many), "t")
    a, b = warc.ReplicaTree(segments, "a"), warc.ReplicaTree(warc.damaged_copy(segments, lambda p, _: p == 1234), "b")
    assert [r.count() for r in (a.below.where(f"level = {n}") for n in range(4))] == [3001, 188, 12, 1]
    got = warc.audit(a, b).collect()
    assert len(got) == 1 and got[0].status == "damaged"
    # a branch that only a change below an equal parent would show isn't looked at
    blind = warc.ReplicaTree.__new__(warc.ReplicaTree)
    blind.__dict__ |= b.__dict__ | {"below": b.below.withColumn("digest", F.when((F.col("level") == 0) & (F.floor(F.col("idx") / 16) != F.floor(F.lit(got[0].idx) / 16)), "x").otherwise(F.col("digest")))}
    assert [tuple(r) for r in warc.audit(a, blind).collect()] == [tuple(got[0])]


def test_many_chunks_and_empty(spark, pages):
    many = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html")).repartition(40)
    got = {r.page_id: r.status for r in warc.fixity_drill(many, lambda p, _: p in (5, 59), lambda _: None).collect() if r.is_record}
    assert {k for k, v in got.items() if v == "damaged"} == {5, 59} and len(got) == 60
    assert warc.fixity_drill(pages.limit(0)).count() == 0


def leaves(segments):
    """(chunk, seq, idx) -> digest, begin and end of every range."""
    out = {}
    for s in segments:
        low = warc.segment_tree(bytes(s[2]), [(e["offset"], e["offset"] + e["length"]) for e in s[3]])[0]
        out |= {(s[0], s[1], i): x for i, x in enumerate(low)}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_replicas_against_all_leaves(spark, seed):
    """Extra and missing chunks and segments, beyond sixteen too, and damage: the audit finds what comparing all leaves finds."""
    rng = random.Random(seed)

    def segment(chunk, seq, n):
        body = [rng.randbytes(rng.randrange(1, 40)) for _ in range(n)]
        at, entries = 0, []
        for b in body:
            entries.append({"page_id": len(entries), "offset": at, "length": len(b)})
            at += len(b)
        return (chunk, seq, b"".join(body), entries)

    ours = [segment(c, q, rng.randrange(1, 40)) for c in range(rng.choice((1, 3, 20))) for q in range(rng.choice((1, 2, 18)))]
    theirs = []
    for s in ours:
        kind = rng.random()
        if kind < 0.1 and len(ours) > 1:
            continue
        if kind < 0.2:
            s = (*s[:2], damaged(s[2], rng.randrange(len(s[2]))), s[3])
        theirs.append(s)
    extra = {0: [(max(s[0] for s in ours) + 1, 0)], 1: [(0, 40)], 2: [(300, 5)], 3: [(c, 0) for c in range(50, 70)], 4: [], 5: [(0, 19), (17, 300)]}[seed]
    twin = ours[0]
    theirs += [(c, q, twin[2], twin[3]) for c, q in extra]
    if seed == 4:
        ours = ours[:1]
        theirs = [ours[0], (1, 0, *ours[0][2:])]  # the same segment again, as another chunk
    pairs = [(ours, theirs), (theirs, ours)] if seed else [(ours, theirs), (ours, []), ([], ours), (ours, ours)]
    for x, y in pairs:
        a, b = (leaves(z) for z in (x, y))
        want = {(*k, "extra" if k not in a else "missing" if k not in b else "damaged") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
        trees = [warc.ReplicaTree(spark.createDataFrame(z, warc.SEGMENTS), n) for z, n in ((x, "x"), (y, "y"))]
        assert {(r.chunk, r.seq, r.idx, r.status) for r in warc.audit(*trees).collect()} == want
