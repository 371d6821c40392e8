"""The manifest against plain recursion over whole lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import merkle_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(top, proofs, levels): for each leaf the list of (left, right) siblings by level."""
    levels, place = [leaves], list(range(len(leaves)))
    proofs = [[] for _ in leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        for i, p in enumerate(place):
            a = p // 3 * 3
            proofs[i].append((low[a:p], low[p + 1 : a + 3]))
        place = [p // 3 for p in place]
        levels.append([H(*low[i : i + 3]) for i in range(0, len(low), 3)])
    return levels[-1][0], proofs


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    root, up = tree([trees[s][0] for s in sources])
    out = []
    for s, over in zip(sources, up):
        for r, proof in zip(own[s], trees[s][1]):
            steps = proof + over
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            here = leaf((*r[:4], r[4].replace("\n", ""))) if hit else leaf(r)
            for a, b in steps:
                here = H(*a, here, *b)
            out.append((r[0], leaf(r), trees[s][0], root, H(*(x for a, b in steps for x in (*a, *b))), here, here == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_against_recursion(spark, levels):
    sizes = {None: 4, "a": 1, "b": 2, "hot": 95, "ä": 3, "Z": 27, "": 28, "a b": 10}
    rows, n = [], 0
    for s, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 1009, s, None if n % 5 == 0 else "en", None if n % 7 == 0 else n, None if n % 11 == 0 else f"text {n}" + "\nline é" * (n % 3)))
    rows += [rows[3], rows[3], (None, "hot", None, None, None), (None, None, "x", 1, "a\nb"), (5000, "long", "en", 9, "x\n" * 300_000)]
    got = merkle_manifest.tamper_drill(table(spark, rows).withColumn("leaf", F.lit(1)).withColumn("grp", F.lit("x")), levels).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r.verified for r in got} == {True, False}


def test_many_sources(spark):
    rows = [(i, f"site {i % 97}", "en", 1, f"{i}\n") for i in range(150)]
    assert sorted(map(tuple, merkle_manifest.tamper_drill(table(spark, rows), 2).collect()), key=str) == brute(rows)


def test_one_and_none(spark):
    rows = [(1, "s", "en", 3, "a\nb")]
    assert list(map(tuple, merkle_manifest.tamper_drill(table(spark, rows)).collect())) == brute(rows)
    assert merkle_manifest.tamper_drill(table(spark, rows).limit(0)).count() == 0
