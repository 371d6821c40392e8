"""Ranked search against plain scoring of every document, packing round trips, and skipping."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(d, Counter(words(t))) for d, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, ts in asked.items():
        found = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if t in b)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "ÄÖ", "x1", "日本"]
    share = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i * 3 % 1009, " ".join(rng.choices(vocabulary, share, k=rng.randrange(0, 60))) + rng.choice(["", ".", "-W1", "\nw2"])) for i in range(n)]
    docs += [docs[5], docs[5], (None, docs[7][1]), (None, None), (-4, ""), (2000, "w1 " * 300_000 + "rare"), (2001, None), (2002, "W3 w3,w3;W3")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(25)] + [(30, None), (31, "..."), (32, "unknown"), (33, "Rare w1"), (33, "w250"), (34, "w0")]
    return docs, items


@pytest.mark.parametrize("most, waves", [(1 << 24, 1 << 24), (20_000, 500)])
def test_against_scoring_all(spark, most, waves):
    docs, items = corpus(1, 900)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = sorted((tuple(r) for r in lexical.ranked(d, q, most=most, wave_bytes=waves).collect()), key=str)
    assert got == brute(docs, items) and len(got) > 150


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(d.limit(0), q).count() == lexical.ranked(d, q.limit(0)).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    width = rng.integers(0, 25, 200)
    values = np.concatenate([rng.integers(0, 1 << w, 8) if w else np.zeros(8, np.int64) for w in width])
    data = lexical.pack(values, width)
    assert len(data) == width.sum() and (lexical.unpack(data, np.cumsum(width) - width, width) == values).all()


def test_blocks_below_the_threshold_stay_packed():
    """A rare term in a few early documents, a common one in all: later blocks of the common one can't reach the tenth score."""
    build = lexical.ShardBuilder()
    texts = [("rare common" if i < 40 else "common") + " filler" for i in range(20_000)]
    import pyarrow as pa

    coded = [t.encode() for t in texts]
    build.add(pa.array(range(len(texts))), np.frombuffer(b"".join(coded), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in coded]))).astype(np.int64))
    rows = [r for b in build.rows(0, len(texts), 2 * len(texts) + 40) for r in b.to_pylist()]
    m = np.frombuffer(rows[0]["gaps"], dtype=np.int64)
    lists = {r["term"]: lexical.Postings(r["heads"], r["gaps"], r["tfs"], m) for r in rows[1:]}
    docs, scores = lexical.best([(lists[b"rare"], 9000), (lists[b"common"], 10)], len(texts), 10)
    assert docs.tolist() == list(range(10)) and (scores > 0).all()
    assert lists[b"common"].read.sum() < 5 and len(lists[b"common"].read) == -(-20_000 // lexical.BLOCK)
