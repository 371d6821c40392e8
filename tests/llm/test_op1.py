"""Lattice hashing against brute force."""

import numpy as np
import pytest

from weftgraph.llm import lattice

DATA = "/root/testdata/sf0.001"


def test_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    point = lattice.nearest_e8(x)
    assert len(lattice.minimal_vectors()) == 240
    around = point[:, None, :] + lattice.minimal_vectors()[None]
    assert (((x[:, None] - around) ** 2).sum(-1).min(axis=1) >= ((x - point) ** 2).sum(-1) - 1e-12).all()
    assert (point.sum(axis=1) % 2 == 0).all()


def brute(rows):
    ids, vecs = [r[0] for r in rows], [r[1] for r in rows]
    fine = [i for i, v in enumerate(vecs) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for d in {len(vecs[i]) for i in fine}:
        own = [i for i in fine if len(vecs[i]) == d]
        x = np.array([vecs[i] for i in own], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95 - 1e-12, 1))):
            links[own[a]] = links.get(own[a], 0) + 1
            links[own[b]] = links.get(own[b], 0) + 1
            root[find(own[a])] = find(own[b])
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, links.get(i, 0), least.get(find(i), d), d is not None and d == least.get(find(i), d)) for i, d in enumerate(ids)], key=str)


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    real = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").limit(150).collect()]
    rows = list(real)
    centre = np.array(real[0][1])
    for k in range(120):  # a group of near copies, some of them repeated
        v = (centre + rng.normal(size=64) * 0.008).tolist()
        rows.append((1000 + k, v))
        if k % 10 == 0:
            rows.append((2000 + k, v))
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] * 64), (3004, [None] + [1.0] * 63), (None, real[1][1]), (None, None), (3005, [float("inf")] + [1.0] * 63)]
    rows += [(3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [3.0]), (3009, (2 * centre).tolist()), (3009, (2 * centre).tolist())]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, uid string, part int")
    got = sorted(map(tuple, lattice.near_duplicates(df, lattice.Lattice(block=block)).collect()), key=str)
    assert got == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(size=(400, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(400, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.951 * u + np.sqrt(1 - 0.951**2) * w
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate((u, v)))], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in lattice.near_duplicates(df).collect()}
    assert sum(got[400 + i] == i for i in range(400)) >= 0.93 * 400


def test_empty(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
