"""SimHash near-dedup by multi-index hashing.

A text's fingerprint has 64 bits, each the majority over the XXH64 hashes of
its word shingles. Distinct fingerprints enter one table per segment; each
fingerprint then enumerates the Hamming ball of radius floor(k / segments)
around each of its segments, fetches the table's matches and verifies the
complete distance. Two fingerprints within k bits share a segment within that
radius (pigeonhole), so no link is lost. Links are between distinct
fingerprints; equal texts never become pairs.

Defined cases: texts without words (null, empty, white space) have fingerprint
zero and are linked like any other; fewer words than a shingle make one
shingle of all words. Repeated rows and ids each give a row; a null doc_id
gives a row and never names a component unless no other id is in it. An empty
table gives no rows. Only doc_id and text are read. Very long texts are read
whole: a text over ``SLICE_BYTES`` is a slice by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Words, discard, materialize, text_slices
from weftgraph.llm.components import connected_components

SEED = 42


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle as big-endian bytes, and for each text its first shingle (with the end)."""
    length = w.end - w.start
    begin = np.concatenate(([0], np.cumsum(length + 1)))  # words with one space after each
    take = w.inside.copy()
    take[w.end] = True
    body = w.buf[take]
    body[begin[1:] - 1] = 32
    n = np.diff(w.first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(w.first[:-1], count)
    last = np.minimum(at + size, np.repeat(w.first[1:], count))
    mem, digest = memoryview(body.tobytes()), xxhash.xxh64_digest
    joined = b"".join([digest(mem[a:b], SEED) for a, b in zip(begin[at].tolist(), (begin[last] - 1).tolist())])
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, 8), first


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the 64 bits set in over half of its hashes, as an unsigned number."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    n = np.diff(first)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # sums of at most 255 rows in bytes, then of these sums by text
    parts = -(-n[some] // 255)
    cut = np.repeat(first[some], parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.concatenate(([0], np.cumsum(parts)[:-1])), parts))
    bits = np.unpackbits(hashes, axis=1)
    small = np.add.reduceat(bits, cut, axis=0, dtype=np.uint8).astype(np.int64)
    ones = np.add.reduceat(small, np.concatenate(([0], np.cumsum(parts)[:-1])), axis=0)
    out[some] = np.packbits(2 * ones > n[some][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long with the fingerprint's 64 bits)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, buf, off in text_slices(batches, 1 << 20):
            fp = majority(*shingle_hashes(Words(buf, off, lower=True), shingle))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most radius set bits."""
    masks = [0]
    grown = [(0, -1)]
    for _ in range(radius):
        grown = [(m | 1 << b, b) for m, last in grown for b in range(last + 1, bits)]
        masks += [m for m, _ in grown]
    return masks


def close_pairs(fps: DataFrame, bits: int = 2, segments: int = 2, hot: int = 256) -> DataFrame:
    """(fp, other, distance) with fp < other for all distinct fingerprints within ``bits`` of each other; may repeat.

    A fingerprint has at most sum(C(64, i), i = 1..bits) others that near, so the result is bounded by a constant for
    each. The join isn't by itself: a segment that more than ``hot`` fingerprints share would meet with all its probes
    in one task. Its entries and probes are dealt out once more, by the other segments cut into bits + 1 parts, of
    which any two fingerprints within ``bits`` have one in common. Spark takes rows that are exploded for as few as they
    were, and would send 33 probes a segment to the driver as a small table: the joins name their kind.
    """
    width = 64 // segments
    radius = bits // segments
    seg = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(segments)]
    entries = fps.select("fp", F.posexplode(F.array(*seg)).alias("seg", "key"))
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
    probes = entries.select(F.col("fp").alias("other"), "seg", F.explode(F.transform(masks, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.where((F.col("fp") < F.col("other")) & (away <= bits)).select("fp", "other", away.alias("distance"))

    crowded = materialize(entries.groupBy("seg", "key").count().where(F.col("count") > hot).select("seg", "key"), "simhash-crowded")
    if not crowded.take(1):
        discard(crowded)
        return verified(entries.join(probes.hint("merge"), ["seg", "key"]))
    rest = verified(entries.join(crowded, ["seg", "key"], "left_anti").join(probes.hint("merge"), ["seg", "key"]))

    def others(fp: str, i: int):
        """The bits of fp outside segment i, closed up."""
        low = F.col(fp).bitwiseAND(F.lit((1 << width * i) - 1))
        return low if i == segments - 1 else F.shiftleft(F.shiftrightunsigned(fp, width * (i + 1)), width * i).bitwiseOR(low)

    def dealt(rows: DataFrame, fp: str) -> DataFrame:
        size = -(-(64 - width) // (bits + 1))
        rest_of = F.element_at(F.array(*[others(fp, i) for i in range(segments)]), F.col("seg") + 1)
        parts = [F.shiftrightunsigned("others", size * i).bitwiseAND(F.lit((1 << size) - 1)) for i in range(bits + 1)]
        return rows.join(crowded, ["seg", "key"]).withColumn("others", rest_of).select(fp, "seg", "key", F.posexplode(F.array(*parts)).alias("part", "value"))

    return rest.unionByName(verified(dealt(entries, "fp").join(dealt(probes, "other").hint("merge"), ["seg", "key", "part", "value"])))


def components(printed: DataFrame, bits: int = 2, segments: int = 2) -> DataFrame:
    """printed (doc_id, fp) with component_id, the smallest doc_id reachable over links of fingerprints."""
    spark = printed.sparkSession
    distinct = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    pairs = close_pairs(distinct.select("fp"), bits, segments)
    # a fingerprint stands for itself until the components are known; rep only names them
    comps = connected_components(pairs.select(F.col("fp").alias("u"), F.col("other").alias("v")), spark)
    named = distinct.join(comps, distinct["fp"] == comps["v"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    named = materialize(named, "simhash-named")
    # of components of two or more; written first, so that the join deals one large component out by itself
    groups = named.groupBy("label").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
    grouped = materialize(groups.select("label", "least"), "simhash-least")
    moved = named.join(grouped, "label").select("fp", F.col("least").alias("component_id"))
    out = materialize(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "simhash-components")
    for old in (distinct, comps, named, grouped):
        discard(old)
    return printed.join(out, "fp")


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    printed = materialize(fingerprints(docs, shingle), "simhash-fingerprints")
    out = components(printed, bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_groups(printed: DataFrame, bits: int = 2) -> DataFrame:
    """(key, label) of printed(key, fp) for keys that hang together over fingerprints within ``bits``, with others; written. label is a fingerprint."""
    spark = printed.sparkSession
    distinct = materialize(printed.select("fp").distinct(), "simhash-distinct")
    pairs = close_pairs(distinct, bits)
    comps = connected_components(pairs.select(F.col("fp").alias("u"), F.col("other").alias("v")), spark)
    labelled = printed.join(comps.select(F.col("v").alias("fp"), "label"), "fp", "left").select("key", F.coalesce("label", "fp").alias("label"))
    labelled = materialize(labelled, "simhash-labelled")
    # written first, so that the join deals one large group out by itself
    several = materialize(labelled.groupBy("label").count().where("count > 1").select("label"), "simhash-several")
    out = materialize(labelled.join(several, "label").select("key", "label"), "simhash-groups")
    for old in (distinct, comps, labelled, several):
        discard(old)
    return out


def keep_one(docs: DataFrame, similarity: float = 0.8, block: int = 512) -> DataFrame:
    """docs with one row of each group of similar texts; see similar.py, which verifies what fingerprints bring together and finds the rest."""
    from weftgraph.llm.similar import one_of_each  # it takes fingerprints from here

    return one_of_each(docs, similarity, block)
