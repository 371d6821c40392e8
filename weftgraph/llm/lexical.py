"""Ranked lexical search with Block-Max WAND.

The index is dealt into shards of some megabytes of text. In a shard documents
are numbered by doc_id, and each term has one row: its postings in blocks of
``BLOCK``, compressed (gaps and occurrences, bit-packed at the widths that the
block needs), and for each block its first and last document and its maximum
impact, i.e. the greatest score that one of its documents can take from a term
of weight one. A row of the empty term holds the shard's documents.

A search deals the rows of the asked terms out by shard. There all pointers of
an item move together: the ends of its terms' blocks divide the documents into
intervals, in each of which a term's block, and so its maximum, stays the same.
These shallow moves read no posting. The sum of weight times maximum bounds the
score of any document of the interval, and intervals whose bound doesn't exceed
the tenth best score so far are skipped; only blocks that reach into the others
are decompressed, once for all items of the shard. Intervals are taken in the
order of documents, so of equal scores the earlier document has its place
already. The shards' ten best are ranked together.

Statistics, terms, document frequencies and lengths cover the whole texts of all
documents. The items are the query set: their terms are broadcast in waves of at
most ``WAVE_BYTES``, each of which reads the asked terms of the index once.

Defined cases: null and empty texts have no terms; such documents are never
found, and such items find nothing. Repeated rows are documents of their own;
documents without a doc_id are found, after others of the same score. Rows with
the same item_id are one item, with the terms of all. Empty tables give no rows.
Very long texts are indexed whole; a longer text than a shard is one by itself.
Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Words, discard, give_back, materialize, partitions, text_slices

BLOCK = 128
SHARD_BYTES = 16 << 20
WAVE_BYTES = 32 << 20
#: Bytes outside of terms: ASCII other than letters and digits.
NO_TERM = np.zeros(256, dtype=bool)
NO_TERM[[c for c in range(128) if not chr(c).isalnum()]] = True


def terms(buf: np.ndarray, off: np.ndarray) -> Words:
    return Words(buf, off, lower=True, space=NO_TERM)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight one gives a document of length measure m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- packed numbers: eight to a group, each group at its own width ------------------------------------------


def pack(values: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bytes of values (groups of eight) at the widths of the groups."""
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), dtype=np.uint8)
    groups = values.reshape(-1, 8)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = (groups[own][:, :, None] >> np.arange(w)) & 1
        out[at[own][:, None] + np.arange(w)] = np.packbits(bits.astype(np.uint8).reshape(len(own), 8 * w), axis=1)
    return out


def unpack(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The groups' values, given where each begins."""
    out = np.zeros((len(width), 8), dtype=np.int64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(data[at[own][:, None] + np.arange(w)], axis=1).reshape(len(own), 8, w)
        out[own] = bits.astype(np.int64) @ (1 << np.arange(w))
    return out.reshape(-1)


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


# --- building -----------------------------------------------------------------------------------------------

INDEX = "shard long, term binary, df long, heads binary, gaps binary, tfs binary"
HEAD = np.dtype([("first", "<i4"), ("last", "<i4"), ("impact", "<i4"), ("n", "u1"), ("gap_width", "u1"), ("tf_width", "u1")])


class ShardBuilder:
    """Postings of one shard, gathered by slices of texts."""

    def __init__(self):
        self.ids, self.known, self.lengths, self.parts, self.words = [], [], [], [], []
        self.n_docs = self.size = 0

    def add(self, ids: pa.Array, buf: np.ndarray, off: np.ndarray) -> None:
        w = terms(buf, off)
        code, distinct = w.codes()
        pair, tf = np.unique(w.doc * max(1, len(distinct)) + code, return_counts=True)
        self.parts.append((self.n_docs + pair // max(1, len(distinct)), pair % max(1, len(distinct)), tf))
        self.words.append(distinct)
        self.ids.append(ids.fill_null(0).to_numpy())
        self.known.append(np.asarray(ids.is_valid()))
        self.lengths.append(np.diff(w.first))
        self.n_docs, self.size = self.n_docs + len(ids), self.size + len(buf)

    def rows(self, shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        """The shard's rows; n_docs and n_terms are those of the whole corpus."""
        ids, known, lengths = (np.concatenate(x) for x in (self.ids, self.known, self.lengths))
        order = np.lexsort((ids, ~known))  # by id, those without one last
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        m = 10 + (90 * lengths[order].astype(np.int64) * n_docs) // max(1, n_terms)
        head = [pa.array([x], k) for x, k in zip((shard, b"", len(ids), ids[order].tobytes(), m.tobytes(), known[order].tobytes()), (pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 3))]
        names = [x.split()[0] for x in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays(head, names=names)
        base = np.cumsum([0, *(len(x) for x in self.words)])
        coded = pa.chunked_array(self.words, pa.large_binary()).combine_chunks().dictionary_encode()
        if not len(coded):
            return
        by_bytes = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(by_bytes), dtype=np.int64)
        place[by_bytes] = np.arange(len(by_bytes))
        number = place[coded.indices.to_numpy()]
        term = np.concatenate([number[b + c] for b, (_, c, _) in zip(base, self.parts)])
        doc = rank[np.concatenate([d for d, _, _ in self.parts])]
        tf = np.concatenate([n for _, _, n in self.parts]).astype(np.int64)
        self.parts, self.words = [], []
        order = np.argsort(term * len(ids) + doc)
        term, doc, tf = term[order], doc[order], tf[order]
        df = np.bincount(term, minlength=len(by_bytes))
        blocks = -(-df // BLOCK)  # of each term
        row_end = np.cumsum(blocks)
        own = np.repeat(np.arange(len(df)), blocks)  # the term of each block
        nth = np.arange(len(own)) - (row_end - blocks)[own]
        size = np.minimum(BLOCK, df[own] - BLOCK * nth)
        begin = np.cumsum(size) - size
        heads = np.zeros(len(own), dtype=HEAD)
        heads["first"], heads["last"], heads["n"] = doc[begin], doc[begin + size - 1], size
        heads["impact"] = np.maximum.reduceat(impact(tf, m[doc]), begin)
        gap = np.diff(doc, prepend=0) - 1
        gap[begin] = 0
        out = []
        for name, values in (("gap_width", gap), ("tf_width", tf - 1)):
            width = bit_length(np.maximum.reduceat(values, begin))
            heads[name] = width
            groups = -(-size // 8)
            slots = np.zeros(8 * int(groups.sum()), dtype=np.int64)
            slots[np.repeat(8 * (np.cumsum(groups) - groups) - begin, size) + np.arange(len(values))] = values
            per_row = np.bincount(own, weights=groups * width, minlength=len(df)).astype(np.int64)
            out.append((np.concatenate(([0], np.cumsum(per_row))), pack(slots, np.repeat(width, groups))))
        cells = [(np.concatenate(([0], row_end)) * HEAD.itemsize, heads.view(np.uint8)), *out]
        columns = [pa.Array.from_buffers(pa.large_binary(), len(df), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary()) for off, data in cells]
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(df), shard)), coded.dictionary.take(pa.array(by_bytes)).cast(pa.binary()), pa.array(df), *columns], names=names)
        for i in range(0, len(df), 20_000):
            yield whole.slice(i, 20_000)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all terms)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for _, buf, off in text_slices(batches):
            n = np.diff(terms(buf, off).first)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    row = docs.select(F.lit(0).alias("id"), docs["text"]).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame, n_docs: int, n_terms: int, most: int = SHARD_BYTES, label: str = "lexical") -> DataFrame:
    """The index of docs(doc_id, text), written: rows of INDEX by shard and term."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, ShardBuilder()
        for ids, buf, off in text_slices(batches):
            held.add(ids, buf, off)
            if held.size >= most:
                yield from held.rows((part << 32) | seq, n_docs, n_terms)
                seq, held = seq + 1, ShardBuilder()
                give_back()
        if held.n_docs:
            yield from held.rows((part << 32) | seq, n_docs, n_terms)
        give_back()

    return materialize(docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"]).mapInArrow(run, INDEX), f"{label}-index")


# --- searching ----------------------------------------------------------------------------------------------


class Postings:
    """One term in one shard: heads of blocks at hand, blocks decompressed when asked for and kept."""

    def __init__(self, heads: bytes, gaps: bytes, tfs: bytes, m: np.ndarray):
        h = np.frombuffer(heads, dtype=HEAD)
        self.first, self.last, self.bound, self.n = (h[k].astype(np.int64) for k in ("first", "last", "impact", "n"))
        self.widths = [h[k].astype(np.int64) for k in ("gap_width", "tf_width")]
        self.groups = -(-self.n // 8)
        self.data = [np.frombuffer(x, dtype=np.uint8) for x in (gaps, tfs)]
        self.starts = [np.cumsum(self.groups * w) - self.groups * w for w in self.widths]
        self.m = m
        self.read = np.zeros(len(h), dtype=bool)
        self.end = np.cumsum(self.n)
        self.docs, self.impacts = (np.zeros(int(self.end[-1]), dtype=np.int64) for _ in range(2))

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        """Where the postings of blocks lie in docs and impacts."""
        n = self.n[blocks]
        return np.repeat(self.end[blocks] - n - np.cumsum(n) + n, n) + np.arange(n.sum())

    def decompress(self, blocks: np.ndarray) -> None:
        groups, n = self.groups[blocks], self.n[blocks]
        within = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
        taken = np.repeat(8 * (np.cumsum(groups) - groups) - np.cumsum(n) + n, n) + np.arange(n.sum())
        gap, tf = (
            unpack(data, np.repeat(start[blocks], groups) + within * np.repeat(width[blocks], groups), np.repeat(width[blocks], groups))[taken] + 1
            for data, start, width in zip(self.data, self.starts, self.widths)
        )
        total = np.cumsum(gap)
        begin = np.cumsum(n) - n
        docs = total + np.repeat(self.first[blocks] - total[begin], n)
        at = self.slots(blocks)
        self.docs[at], self.impacts[at] = docs, impact(tf, self.m[docs])
        self.read[blocks] = True

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = blocks[~self.read[blocks]]
        if len(new):
            self.decompress(new)
        at = self.slots(blocks)
        return self.docs[at], self.impacts[at]


def best(lists: list[tuple[Postings, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best documents with a score above 0 for weighted terms, in order."""
    edges = np.unique(np.concatenate([p.last for p, _ in lists]))  # intervals are (edge before, edge]
    bound = np.zeros(len(edges), dtype=np.int64)
    reach = []
    for p, w in lists:
        block = np.searchsorted(p.last, edges)
        there = block < len(p.last)
        there[there] = p.first[block[there]] <= edges[there]
        block = np.where(there, block, -1)
        bound += np.where(there, w * p.bound[np.maximum(block, 0)], 0)
        reach.append(block)
    docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, wide = 0, 2
    while at < len(edges):
        least = scores[-1] if len(scores) == k else 0
        pivots = at + np.flatnonzero(bound[at:] > least)[:wide]
        if not len(pivots):
            break
        total = np.zeros(n_docs, dtype=np.int64)
        for (p, w), block in zip(lists, reach):
            own = np.unique(block[pivots])
            own = own[own >= 0]
            if len(own):
                d, q = p.postings(own)
                total[d] += w * q
        low = np.where(pivots > 0, edges[np.maximum(pivots - 1, 0)] + 1, 0)
        size = edges[pivots] - low + 1
        inside = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        fine = inside[total[inside] > least]
        docs, scores = np.concatenate((docs, fine)), np.concatenate((scores, total[fine]))
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        at, wide = int(pivots[-1]) + 1, 2 * wide
    return docs, scores


FOUND = "item_id long, doc_id long, score long"


def search_shard(t: pa.Table, k: int) -> pa.RecordBatch:
    """The k best documents of one shard for each item; t has its documents' row and those of the asked terms."""
    rows = t.to_pylist()
    own = next(r for r in rows if r["term"] == b"")
    ids, m, known = np.frombuffer(own["heads"], dtype=np.int64), np.frombuffer(own["gaps"], dtype=np.int64), np.frombuffer(own["tfs"], dtype=bool)
    asked: dict[int | None, list[tuple[Postings, int]]] = {}
    for r in rows:
        if r["term"]:
            p = Postings(r["heads"], r["gaps"], r["tfs"], m)
            for ask in r["asks"]:
                asked.setdefault(ask["item_id"], []).append((p, ask["w"]))
    items, docs, scores = [], [], []
    for item, lists in asked.items():
        d, s = best(lists, len(ids), k)
        items += [item] * len(d)
        docs.append(d)
        scores.append(s)
    d = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
    s = np.concatenate(scores) if scores else d
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids[d], mask=~known[d]), pa.array(s)], names=["item_id", "doc_id", "score"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, buf, off in text_slices(batches):
            w = terms(buf, off)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(w.doc)), w.strings().cast(pa.binary())], names=["item_id", "term"])

    return items.select(items["item_id"].cast("long"), items["text"]).mapInArrow(run, "item_id long, term binary").distinct()


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = 10, wave_bytes: int = WAVE_BYTES, label: str = "lexical") -> DataFrame:
    """(item_id, rank, doc_id, score), written: the k best documents of an index for each of items(item_id, text)."""
    spark = index.sparkSession
    asked = materialize(item_terms(items), f"{label}-asked")
    size = asked.agg(F.sum(F.length("term") + 64)).first()[0] or 0
    waves = -(-size // wave_bytes) or 1
    found, made = None, [asked]
    for wave in range(waves):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(waves)) == wave) if waves > 1 else asked
        # each broadcast is a wave of at most wave_bytes, but for one item of more terms than that
        df = index.select("term", "df").join(F.broadcast(own.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        asks = own.join(df.select("term", weight.alias("w")), "term").groupBy("term").agg(F.collect_list(F.struct("item_id", "w")).alias("asks"))
        none = spark.range(1).select(F.lit(b"").alias("term"), F.array().cast("array<struct<item_id:bigint,w:bigint>>").alias("asks"))
        asks = materialize(asks.unionByName(none), f"{label}-asks")
        made.append(asks)
        rows = index.join(F.broadcast(asks), "term").select("shard", "term", "asks", "heads", "gaps", "tfs")

        def run(batches) -> Iterator[pa.RecordBatch]:
            for t in by_shard(batches):
                yield search_shard(t, k)
                give_back()

        near = rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(run, FOUND)
        found = near if found is None else found.unionByName(near)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), f"{label}-ranked")
    for x in made:
        discard(x)
    return out


def by_shard(batches) -> Iterator[pa.Table]:
    """The rows of one shard at a time, of rows sorted by shard."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        shard = t.column("shard").to_numpy()
        edge = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
        for a, e in zip(edge, edge[1:]):
            if e > a:
                if held and held[-1].column("shard")[0] != t.column("shard")[int(a)]:
                    yield pa.concat_tables(held)
                    held = []
                held.append(t.slice(a, e - a))
    if held:
        yield pa.concat_tables(held)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, most: int = SHARD_BYTES, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Index docs(doc_id, text) and search it for items(item_id, text)."""
    n_docs, n_terms = corpus_size(docs)
    index = build_index(docs, n_docs, n_terms, most)
    out = search(index, items, n_docs, k, wave_bytes)
    discard(index)
    return out
