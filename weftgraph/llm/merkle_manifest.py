"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources.

Every three consecutive nodes become one; what remains of a source is its
subroot, and the subroots become the root. A row's proof are its siblings on the
way up; folding a leaf with its siblings must give the root again.

Rows get their number within their source from a range-partitioned sort: a part
numbers its own rows, and adds the rows of the source in earlier parts. Aligned
blocks of 3^LEVELS numbers are whole subtrees, so a source of any size is dealt
out over blocks. A block is one row that holds its digests as contiguous bytes;
a task reshapes them to a matrix of hexadecimal digests, three to a row, hashes
the rows level by level, and finds every sibling by index arithmetic. The
blocks' own digests are the leaves of the next trees, until all sources fit in a
block; the subroots are numbered and climbed in the same way. Going down again,
each block gets the siblings above it, and with them proves its rows.

Defined cases: null fields count as "-". Rows without a source are a source of
their own, the first; rows without a doc_id come first in it, and aren't
tampered with. Rows with the same source and doc_id follow by their leaves, so
repeated rows have leaves of their own, equal ones. Very long texts are hashed
whole, in Spark. An empty table has no rows and no root. Columns not named are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, give_back, materialize, partitions

#: A block is a whole subtree of LEVELS levels.
FAN, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(x: Column) -> Column:
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def group_key(source: Column) -> Column:
    """Keys that are never null and sort as sources do: null first, then by bytes."""
    return F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source))


def whole_groups(batches, starts: Callable[[pa.Table], np.ndarray]) -> Iterator[pa.Table]:
    """Tables of one group each, of rows in order; starts says which rows begin one."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        at = np.flatnonzero(starts(t))
        for a, e in zip([0, *at], [*at, t.num_rows]):
            if a in at and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            if e > a:
                held.append(t.slice(a, e - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


NODE = "grp string, id long, leaf binary, other binary"


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """rows(grp, id, leaf, other), written, with idx, their number within grp by id and leaf, and n, the rows of grp."""
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("nth", F.monotonically_increasing_id()), f"{label}-rows")
    order = [F.col("grp"), F.asc_nulls_first("id"), F.col("leaf"), F.col("nth")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            code = coded.indices.to_numpy()
            begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(np.append(begin, b.num_rows))
            base = np.zeros(len(begin), dtype=np.int64)
            base[0] = count if coded.dictionary[code[0]].as_py() == last else 0
            pos = np.arange(b.num_rows) - np.repeat(begin - base, size)
            last, count = coded.dictionary[code[-1]].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(b.num_rows, part, np.int32)), pa.array(pos)], names=["grp", "id", "leaf", "other", "part", "pos"])

    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialize(dealt.mapInArrow(run, NODE + ", part int, pos long"), f"{label}-placed")
    discard(rows)
    mine = placed.groupBy("grp", "part").agg((F.max("pos") + 1).alias("size"))
    w = Window.partitionBy("grp")  # a row for each part that the group reaches into
    before = F.coalesce(F.sum("size").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = mine.select("grp", "part", before.alias("before"), F.sum("size").over(w).alias("n"))
    out = placed.join(offsets, ["grp", "part"]).select("grp", "id", "leaf", "other", (F.col("pos") + F.col("before")).alias("idx"), "n")
    out.stored_at = placed.stored_at
    return out


def hex_rows(digests: np.ndarray) -> np.ndarray:
    """32-byte digests, one after another, as rows of 64 hexadecimal characters."""
    return np.frombuffer(digests.tobytes().hex().encode(), dtype=np.uint8).reshape(-1, 64)


def hash_runs(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """Rows of 64 characters: the digests of successive runs of data."""
    view, end = memoryview(data), np.cumsum(sizes)
    sha = hashlib.sha256
    return hex_rows(np.frombuffer(b"".join(sha(view[a:b]).digest() for a, b in zip((end - sizes).tolist(), end.tolist())), dtype=np.uint8))


def height(n: int, most: int) -> int:
    """Levels above n nodes, up to ``most``."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtree:
    """The levels of a block of leaves, of a tree with n leaves in all: matrices of hexadecimal digests."""

    def __init__(self, leaves: bytes, n: int, most: int):
        self.levels = [hex_rows(np.frombuffer(leaves, dtype=np.uint8))]
        for _ in range(height(n, most)):
            low = self.levels[-1]
            sizes = np.full(-(-len(low) // FAN), FAN * 64)
            sizes[-1] = 64 * (len(low) - FAN * (len(sizes) - 1))
            self.levels.append(hash_runs(low.tobytes(), sizes))

    @property
    def root(self) -> bytes:
        return bytes.fromhex(self.levels[-1].tobytes().decode())

    def siblings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each leaf and level the places in the run of three (leaf, level, 3, 64), which of them exist, and which is the leaf's own."""
        m, top = len(self.levels[0]), len(self.levels) - 1
        shown = np.zeros((m, top, FAN, 64), dtype=np.uint8)
        there = np.zeros((m, top, FAN), dtype=bool)
        own = np.zeros((m, top), dtype=np.int64)
        for k in range(top):
            node = np.arange(m) // FAN**k
            place = (node // FAN * FAN)[:, None] + np.arange(FAN)
            there[:, k] = place < len(self.levels[k])
            shown[:, k] = self.levels[k][np.minimum(place, len(self.levels[k]) - 1)]
            own[:, k] = node % FAN
        return shown, there, own


BLOCKS = "grp string, block long, n long, ids binary, known binary, leaves binary, others binary, tampered binary, root binary"


def blocks_of(nodes: DataFrame, label: str, most: int) -> DataFrame:
    """nodes(grp, id, leaf, other, idx, n) as blocks, written, each with the digest of its subtree."""

    size = FAN**most

    def run(batches) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, lambda t: t.column("idx").to_numpy() % size == 0):
            row = lambda name: t.column(name)[0].as_py()
            ids, other = t.column("id").combine_chunks(), t.column("other").combine_chunks()
            leaves = b"".join(t.column("leaf").to_pylist())
            others = b"".join(x or b"" for x in other.to_pylist())
            root = Subtree(leaves, row("n"), most).root
            cells = [row("grp"), row("idx") // size, row("n"), ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), np.asarray(ids.is_valid()).tobytes(), leaves, others, np.asarray(other.is_valid()).tobytes(), root]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, (pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 6))], names=[x.split()[0] for x in BLOCKS.split(", ")])
        give_back()

    # a key of its own for each block: a source's blocks go to many tasks
    dealt = nodes.withColumn("block", F.floor(F.col("idx") / size).cast("long")).repartition(partitions(nodes.sparkSession), "grp", "block").sortWithinPartitions("grp", "idx")
    return materialize(dealt.select("grp", "id", "leaf", "other", "idx", "n").mapInArrow(run, BLOCKS), f"{label}-blocks")


def climb(nodes: DataFrame, label: str, most: int) -> list[DataFrame]:
    """Blocks of nodes, blocks of their digests and so on, until each group is one block."""
    levels, size = [blocks_of(nodes, label, most)], FAN**most
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > size:
        none = F.lit(None)
        up = levels[-1].where(F.col("n") > size).select("grp", none.cast("long").alias("id"), F.col("root").alias("leaf"), none.cast("binary").alias("other"), F.col("block").alias("idx"), F.ceil(F.col("n") / size).alias("n"))
        levels.append(blocks_of(up, label, most))
    return levels


def tops(levels: list[DataFrame], most: int) -> DataFrame:
    """(grp, root): the digest that remains of each group."""
    parts = [x.where(F.col("n") <= FAN**most).select("grp", "root") for x in levels]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: A path: for each level the number of siblings to the left and to the right, a byte each, and their digests.
PATH = "grp string, block long, path binary, subroot binary"


def descend(levels: list[DataFrame], above: DataFrame, most: int) -> DataFrame:
    """(grp, block, path, subroot) of the blocks of the first level; above(grp, path, subroot) is what lies over each group."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = [p + row["path"] for p in paths(Subtree(row["leaves"], row["n"], most))]
                m = len(found)
                first = row["block"] * FAN**most
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * m), pa.array(np.arange(first, first + m)), pa.array(found, pa.binary()), pa.array([row["subroot"]] * m, pa.binary())], names=["grp", "block", "path", "subroot"]
                )

    below = None
    for x in reversed(levels):
        # a group that fits in a block has one: no group is a hot key here
        own = x.where(F.col("n") <= FAN**most).select("grp", "block").join(above, "grp").select("grp", "block", "path", "subroot")
        if below is not None:
            own = own.unionByName(below)
        if x is not levels[0]:
            below = x.select("grp", "block", "n", "leaves").join(own, ["grp", "block"]).mapInArrow(run, PATH)
    return own


def paths(tree: Subtree) -> list[bytes]:
    """The siblings of each leaf within its block."""
    shown, there, own = tree.siblings()
    out = []
    for i in range(len(shown)):
        steps = []
        for k in range(shown.shape[1]):
            left, right = shown[i, k, : own[i, k]], shown[i, k, own[i, k] + 1 :][there[i, k, own[i, k] + 1 :]]
            steps.append(bytes((len(left), len(right))) + bytes.fromhex((left.tobytes() + right.tobytes()).decode()))
        out.append(b"".join(steps))
    return out


def steps(path: bytes) -> list[tuple[bytes, bytes]]:
    """A path's levels as hexadecimal text to the left and to the right."""
    out, at = [], 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        cut, end = at + 2 + 32 * left, at + 2 + 32 * (left + right)
        out.append((path[at + 2 : cut].hex().encode(), path[cut:end].hex().encode()))
        at = end
    return out


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proved(row: dict, root: bytes, most: int) -> pa.RecordBatch:
    """The rows of a block: each leaf's proof as a digest, and the root that folding gives."""
    tree = Subtree(row["leaves"], row["n"], most)
    shown, there, own = tree.siblings()
    m, top = own.shape
    others = there.copy()
    np.put_along_axis(others, own[:, :, None], False, axis=2)
    sizes = 64 * others.reshape(m, -1).sum(1)
    flat = memoryview(shown[others].tobytes())
    above = steps(row["path"])
    tail = b"".join(a + b for a, b in above)
    end = np.cumsum(sizes)
    proofs = [hashlib.sha256(bytes(flat[a:b]) + tail).hexdigest() for a, b in zip((end - sizes).tolist(), end.tolist())]
    # fold: what was tampered with from its own digest
    here = tree.levels[0].copy()
    changed = np.frombuffer(row["tampered"], dtype=bool)
    if changed.any():
        here[changed] = hex_rows(np.frombuffer(row["others"], dtype=np.uint8))
    for k in range(top):
        run = shown[:, k].copy()
        np.put_along_axis(run, own[:, k, None, None], here[:, None], axis=1)
        here = hash_runs(run[there[:, k]].tobytes(), 64 * there[:, k].sum(1))
    folded = [bytes(x) for x in here]
    for left, right in above:
        folded = [hashlib.sha256(left + x + right).hexdigest().encode() for x in folded]
    root_hex = root.hex()
    final = [x.decode() for x in folded]
    ids = pa.array(np.frombuffer(row["ids"], dtype=np.int64), mask=~np.frombuffer(row["known"], dtype=bool))
    shown_leaves = [bytes(x).decode() for x in tree.levels[0]]
    columns = [ids, shown_leaves, [row["subroot"].hex()] * m, [root_hex] * m, proofs, final, [x == root_hex for x in final]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in PROOFS.split(", ")])


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, when: Column | None = None, label: str = "manifest", most: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs(doc_id, source, lang, n_chars, text).

    ``tampered`` has columns in place of fields of the same name, for the rows where ``when`` holds: these rows fold from
    the leaf that they would have with them.
    """
    fields = {c: docs[c] for c in FIELDS}
    other = F.lit(None).cast("binary") if tampered is None else F.when(when, leaf(list((fields | tampered).values())))
    rows = docs.select(group_key(docs["source"]).alias("grp"), docs["doc_id"].cast("long").alias("id"), leaf(list(fields.values())).alias("leaf"), other.alias("other"))
    nodes = numbered(rows, label)
    levels = climb(nodes, label, most)
    discard(nodes)
    none = F.lit(None)
    roots = tops(levels, most)
    sources = numbered(roots.select(F.lit("").alias("grp"), none.cast("long").alias("id"), F.encode("grp", "utf-8").alias("leaf"), F.col("root").alias("other")), f"{label}-sources")
    # sources are in the order of their keys; their digests are the leaves now, and the keys go along
    above = climb(sources.select("grp", "id", F.col("other").alias("leaf"), F.lit(None).cast("binary").alias("other"), "idx", "n"), f"{label}-sources", most)
    top = tops(above, most).first()
    root = top["root"] if top else b""
    over = descend(above, above[0].select("grp").distinct().select("grp", F.lit(b"").alias("path"), F.lit(b"").alias("subroot")), most)
    over = materialize(over, f"{label}-over")  # the siblings above each block of sources
    each = materialize(above[0].select("grp", "block", "n", "leaves").join(over.select("grp", "block", "path"), ["grp", "block"]).mapInArrow(places(most), "idx long, path binary, subroot binary"), f"{label}-each")
    named = sources.select("idx", F.decode("leaf", "utf-8").alias("grp")).join(each, "idx").select("grp", "path", "subroot")
    proofs = materialize(descend(levels, named, most), f"{label}-paths")
    for x in (over, each, sources, *above, *levels[1:]):
        discard(x)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield proved(row, root, most)
            give_back()

    return levels[0].drop("root").join(proofs, ["grp", "block"]).mapInArrow(run, PROOFS)


def places(most: int):
    """Makes (idx, path, subroot) of every leaf of blocks(block, n, leaves, path)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found = [p + row["path"] for p in paths(Subtree(row["leaves"], row["n"], most))]
                digests = [row["leaves"][i : i + 32] for i in range(0, len(row["leaves"]), 32)]
                first = row["block"] * FAN**most
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(found))), pa.array(found, pa.binary()), pa.array(digests, pa.binary())], names=["idx", "path", "subroot"])

    return run


def tamper_drill(docs: DataFrame, most: int = LEVELS) -> DataFrame:
    """The manifest, with the newlines deleted from the texts of rows whose CRC-32 of the decimal doc_id is even."""
    return manifest(docs, {"text": F.replace(docs["text"], F.lit("\n"), F.lit(""))}, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, most=most)
