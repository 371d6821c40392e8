"""Embedding near-dedup by lattice hashing.

A vector is projected at random in several tables; in each, consecutive blocks
of eight coordinates are decoded to the nearest point of the E8 lattice, and
the points together are the vector's cell. A vector also probes the cells that
it is next nearest to: those one minimal vector of E8 away in one block, best
first. Two vectors meet if one's cell is among the cells of the other, and
cosines are verified in double precision, so no link below the threshold is
returned.

Cells with one vector, or without a home vector, are dropped before vectors
travel. A cell with many rows is dealt into square blocks, so no task gathers
it. Links are counted, not listed: a pair that meets in several cells counts in
the first of them only, which both vectors' cells tell, and each block returns
a count and one link toward its component for each vector.

Defined cases: null, empty and zero vectors, and those with null or non-finite
components, link with nothing: n_links 0, their own component. Vectors of
different lengths don't link. Equal vectors are indexed once and linked with
each other. A null vec_id names no component. An empty table gives no rows.
Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, materialize, mix, sorted_groups
from weftgraph.llm.components import connected_components, forest


@dataclass(frozen=True)
class Lattice:
    """scale: the lattice's unit in the projections of unit vectors; block: rows that a cell may have before it is dealt out."""

    threshold: float = 0.95
    tables: int = 6
    blocks: int = 3
    probes: int = 8
    scale: float = 0.32
    block: int = 1024
    seed: int = 7


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and where the sum is odd round the worst coordinate the other way."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=-1) % 2 != 0)
    rest = x[odd] - f[odd]
    worst = np.abs(rest).argmax(axis=-1)
    f[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by a half in every coordinate."""
    flat = x.reshape(-1, 8)
    whole, half = nearest_d8(flat), nearest_d8(flat - 0.5) + 0.5
    near = ((flat - whole) ** 2).sum(axis=1) <= ((flat - half) ** 2).sum(axis=1)
    return np.where(near[:, None], whole, half).reshape(x.shape)


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


@lru_cache(maxsize=8)
def projections(dim: int, spec: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tables, dim, 8 blocks) orthonormal columns, hash multipliers of coordinates, and the hash step of each minimal vector in each block."""
    rng = np.random.default_rng([spec.seed, dim])
    wide = 8 * spec.blocks
    turns = []
    for _ in range(spec.tables):
        q, _ = np.linalg.qr(rng.normal(size=(max(dim, wide),) * 2))
        turns.append(q[:dim, :wide] * np.sqrt(max(dim, wide) / 64))
    by = rng.integers(1 << 62, size=wide, dtype=np.int64) | 1
    step = np.stack([(2 * minimal_vectors()).astype(np.int64) @ by[8 * k : 8 * k + 8] for k in range(spec.blocks)]).ravel()
    return np.stack(turns), by, step


def cells(unit: np.ndarray, spec: Lattice) -> np.ndarray:
    """(vectors, tables, 1 + probes) cells, the home cell first."""
    dim = unit.shape[1]
    turns, by, step = projections(dim, spec)
    out = np.empty((len(unit), spec.tables, 1 + spec.probes), dtype=np.int64)
    for t in range(spec.tables):
        y = (unit @ turns[t] / spec.scale).reshape(len(unit), spec.blocks, 8)
        point = nearest_e8(y)
        home = (2 * point).astype(np.int64).reshape(len(unit), -1) @ by
        # the smaller 2 - 2 r.v, the nearer the lattice point one minimal vector v from here
        gain = ((y - point) @ minimal_vectors().T).reshape(len(unit), -1)
        best = np.argpartition(-gain, spec.probes - 1, axis=1)[:, : spec.probes] if spec.probes else np.zeros((len(unit), 0), int)
        out[:, t] = np.concatenate((home[:, None], home[:, None] + step[best]), axis=1)
        out[:, t] = mix((out[:, t] + (t << 8) + dim * 1_000_003).view(np.uint64)).view(np.int64)
    return out


def unit_rows(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(rows: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, vec): vec holds the components' bytes, null for vectors that link with nothing."""
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            off = np.asarray(col.offsets)
            flat = col.values
            missing = np.asarray(flat.is_null())[off[0] : off[-1]] if flat.null_count else None
            x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            null = np.asarray(col.is_null())
            out = []
            for i in range(len(col)):
                v = x[off[i] : off[i + 1]]
                fine = not null[i] and len(v) and np.isfinite(v).all() and v.any() and (missing is None or not missing[off[i] - off[0] : off[i + 1] - off[0]].any())
                out.append(v.tobytes() if fine else None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return rows.select(rows["vec_id"].cast("long"), rows["embedding"]).mapInArrow(run, "vec_id long, vec binary"), kind


def vectors_of(col: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of a binary column by length of vector."""
    size = np.array([len(v) for v in col.to_pylist()])
    rows = col.to_pylist()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, unit_rows(np.frombuffer(b"".join(rows[i] for i in at), dtype=kind).reshape(len(at), -1))


def entries(distinct: DataFrame, kind: str, spec: Lattice) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                uid = part.column(0).to_numpy()
                for at, unit in vectors_of(part.column(1), kind):
                    c = cells(unit, spec)
                    home = np.zeros(c.shape, dtype=bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(np.repeat(uid[at], c[0].size)), pa.array(home.ravel())], names=["cell", "uid", "home"])

    return distinct.select("uid", "vec").mapInArrow(run, "cell long, uid long, home boolean")


def first_meeting(ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """For pairs of vectors with the given cells: the first cell in which they meet; in a table with two, the lesser."""
    out = np.zeros(len(ca), dtype=np.int64)
    todo = np.arange(len(ca))
    for t in range(ca.shape[1]):
        ha, hb = ca[todo, t, 0], cb[todo, t, 0]
        in_b, in_a = (cb[todo, t] == ha[:, None]).any(axis=1), (ca[todo, t] == hb[:, None]).any(axis=1)
        big = np.iinfo(np.int64).max
        cell = np.minimum(np.where(in_b, ha, big), np.where(in_a, hb, big))
        out[todo] = cell
        todo = todo[~(in_a | in_b)]
    return out


def verify(rows: DataFrame, kind: str, spec: Lattice) -> DataFrame:
    """(uid, links, toward) from rows (cell, lo, hi, part, home, uid, mult, vec) of blocks: verified links that count here, and one link toward the component."""

    def block(cell, same, left, home, uid, mult, unit):
        """Members of a block; left: on the first side (all, if both sides are the same)."""
        a, b = (np.arange(len(uid)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        close = unit[a] @ unit[b].T >= spec.threshold
        close &= home[a][:, None] | home[b][None, :]
        if same:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        if not len(i):
            return None
        i, j = a[i], b[j]
        inside, at = np.unique(np.concatenate((i, j)), return_inverse=True)
        ci = cells(unit[inside], spec)
        i2, j2 = at[: len(i)], at[len(i) :]
        mine = np.empty(len(i), dtype=bool)
        for s in range(0, len(i), 100_000):
            mine[s : s + 100_000] = first_meeting(ci[i2[s : s + 100_000]], ci[j2[s : s + 100_000]]) == cell
        count = np.bincount(i2[mine], mult[inside][j2[mine]], len(inside)) + np.bincount(j2[mine], mult[inside][i2[mine]], len(inside))
        return uid[inside], count.astype(np.int64), uid[inside][forest(i2, j2, len(inside))]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for t, at in sorted_groups(batches, ["cell", "lo", "hi"]):
            cell, lo, hi, part, home, uid, mult = (t.column(c).to_numpy() for c in ("cell", "lo", "hi", "part", "home", "uid", "mult"))
            vec = t.column("vec").combine_chunks()
            vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
            vec = vec.cast(pa.large_binary())
            off = np.frombuffer(vec.buffers()[1], dtype=np.int64)[vec.offset : vec.offset + len(vec) + 1]
            body = np.frombuffer(vec.buffers()[2], dtype=np.uint8)
            out = []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                if y - x > 1:
                    unit = unit_rows(body[off[x] : off[y]].view(kind).reshape(y - x, -1))
                    got = block(cell[x], lo[x] == hi[x], part[x:y] == lo[x], home[x:y], uid[x:y], mult[x:y], unit)
                    if got:
                        out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["uid", "links", "toward"])

    return rows.mapInArrow(run, "uid long, links long, toward long")


def near_duplicates(vectors: DataFrame, spec: Lattice = Lattice()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    rows, kind = usable(vectors)
    rows = materialize(rows, "lattice-rows")
    distinct = rows.where("vec is not null").groupBy("vec").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"))
    distinct = materialize(distinct.withColumn("uid", F.monotonically_increasing_id()), "lattice-distinct")
    placed = materialize(entries(distinct, kind, spec), "lattice-entries")
    active = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    split = F.ceil(F.col("n") / F.lit(spec.block)).cast("long")
    dealt = placed.join(active, "cell").select("cell", "uid", "home", F.pmod(F.xxhash64("uid"), split).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), split - 1)).alias("other"))
    dealt = dealt.select("cell", "uid", "home", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    full = dealt.join(distinct.select("uid", "mult", "vec"), "uid").repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    found = materialize(verify(full, kind, spec), "lattice-links")
    discard(placed)
    comps = connected_components(found.select(F.col("uid").alias("u"), F.col("toward").alias("v")), spark)
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    named = distinct.join(links, "uid", "left").join(comps, distinct["uid"] == comps["v"], "left")
    named = named.select("vec", "mult", "least", "links", F.coalesce("label", "uid").alias("label"))
    named = materialize(named, "lattice-named")
    # written first: a join of its own then deals one large component out, where one plan would keep it on the aggregate's partition
    comp = materialize(named.groupBy("label").agg(F.min("least").alias("component")), "lattice-least")
    done = named.join(comp, "label").select("vec", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component")
    out = rows.join(done, "vec", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    out = materialize(out, "lattice-result")
    for x in (rows, distinct, found, named, comp):
        discard(x)
    return out
