"""Shared spans against brute force, and suffix orders against sorting."""

import hashlib

import numpy as np
import pytest

from weftgraph.llm import repeats
from weftgraph.llm.suffixes import suffix_order

DATA = "/root/testdata/sf0.001"


def test_suffix_orders():
    rng = np.random.default_rng(0)
    for _ in range(150):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(0, 60))
        assert suffix_order(s, 50).tolist() == sorted(range(len(s)), key=lambda i: list(s[i:]))
    for _ in range(100):
        p = rng.integers(1, 4, rng.integers(1, 8))
        s = np.concatenate((np.tile(p, rng.integers(1, 40)), rng.integers(1, 4, 5), np.tile(p, rng.integers(1, 40))))
        for levels in (0, 1, 2):
            got = suffix_order(s, levels)
            prefixes = [tuple(s[i : i + 3 ** (levels + 1)]) for i in got]
            assert sorted(got) == list(range(len(s))) and prefixes == sorted(prefixes)


def brute(rows):
    least = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                if d < least.get(w, 1 << 62):
                    least[w] = d
    out = []
    for d, b in data:
        cover = np.zeros(len(b) + 1, bool)
        if d is not None:
            for i in range(len(b) - 49):
                if least[b[i : i + 50]] < d:
                    cover[i : i + 50] = True
        c = cover[:-1]
        n_spans = int((cover[:-1] & ~np.concatenate(([False], cover[:-2]))).sum()) if len(b) else 0
        out.append((d, len(b), int(c.sum()), n_spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c])).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "be", "gamma", "dé", "日本", "x", "lorem", "ipsum\n", "to"]

    def prose(n):
        return " ".join(rng.choice(words, n))

    passages = [prose(n) for n in (9, 12, 14, 30, 80)]
    out = [(i, prose(rng.integers(0, 40)) + "".join(passages[j] + prose(rng.integers(0, 6)) for j in rng.integers(0, 5, rng.integers(0, 4)))) for i in range(150)]
    out += [(500 + i, f"{i} subscribe to our newsletter now {i * 7919} {prose(8)}") for i in range(80)]
    out += [(700, "a" * 400), (701, "a" * 49), (702, "b" + "a" * 60), (703, "ab" * 300), (704, ""), (705, None), (None, "a" * 400), (700, "a" * 400), (706, passages[4]), (706, passages[4])]
    out += [(800, "\x00" * 120), (801, "z" + "\x00" * 70)]
    real = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    return out + [(1000 + r.doc_id, r.text) for r in real]


@pytest.mark.parametrize("spread", [repeats.Spread(), repeats.Spread(hot_in_block=3, hot=5), repeats.Spread(hot_in_block=1000, hot=5)])
def test_spans(spark, rows, spread):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, n int").repartition(3)
    assert sorted(map(tuple, repeats.spans(df, spread).collect()), key=str) == brute(rows)


def test_remaining_documents(spark, rows):
    df = spark.createDataFrame([(*r, "x", len(r[1] or "")) for r in rows], "doc_id long, text string, block string, n_chars int").repartition(2)
    got = repeats.without_repeats(df)
    assert got.schema == df.schema
    # where only whole characters go, the text left is that of the digest
    plain = {d for d, t in rows if (t or "").isascii()}
    want = sorted(((w[0], w[4]) for w in brute(rows) if w[0] in plain), key=str)
    kept = got.collect()
    assert sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept if r.doc_id in plain), key=str) == want
    assert all(r.n_chars == len(r.text) for r in kept) and len(kept) == len(rows)
    assert sum(w[2] > 0 for w in brute(rows) if w[0] in plain) > 20


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.spans(none).count() == 0 and repeats.without_repeats(none).count() == 0
