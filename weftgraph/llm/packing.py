"""Best-fit packing by a linear grouping scheme.

Documents are tokenised, documents over the limit are cut into full pieces with
the shorter piece first, and all pieces are packed into sequences of at most
``limit`` tokens. The plan needs only how many pieces have each length, a table
of at most ``limit`` rows whatever the corpus: large lengths are dealt into
groups of equal cardinality and rounded up to the largest of their group, the
few sizes left are packed by the configuration linear program (column
generation, where at most two large pieces share a sequence), the actual lengths take the places
of the rounded ones, and small lengths (and what the rounding of the program
leaves) go to the sequence with the least room that holds them. The plan then
says for the r-th piece of each length where it goes; ranks are counted within
the written parts of the piece table and shifted by the counts of the parts
before, so no length, however common, is gathered in one task. A part's shifts
are one row of numbers, sent to the pieces; the pieces' ids stay where they are.

Where sequences are filled, a piece of ``limit`` tokens is one by itself and
never sent to another task; only shorter pieces are dealt out by their sequence.

Defined cases: a null or empty text has only the end id. Repeated rows are
packed each; a null doc_id is kept. An empty table gives no rows. Only doc_id
and text are read. Very long texts are encoded whole and cut into pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.byte_bpe import byte_bpe
from weftgraph.llm.common import materialize, sorted_groups, text_slices

LIMIT, END_ID = 1024, 2
#: Sizes that large lengths are rounded to: with 128 the plan is within about 0.1 % of the token bound (README).
GROUPS = 128


def cut_lengths(n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents of n tokens each: (document, piece, start, length) of every piece."""
    parts = np.maximum(1, -(-n // limit))
    doc = np.repeat(np.arange(len(n)), parts)
    piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    head = n - limit * (parts - 1)
    start = np.where(piece == 0, 0, head[doc] + limit * (piece - 1))
    return doc, piece, start, np.where(piece == 0, head[doc], limit)


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID, carry_ids: bool = False, as_bytes: bool = False) -> DataFrame:
    """One row per piece; (chunk, length, nth) numbers the pieces of a length within a part of the table.

    With carry_ids it has its ids too, with as_bytes as little-endian numbers of two bytes, or four if the vocabulary needs them.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe, chunk = byte_bpe(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, dtype=np.int64)
        for ids, buf, off in text_slices(batches, 1 << 20):
            flat, bounds = bpe.encode_texts(buf, off)
            n = np.diff(bounds) + 1
            ends = np.cumsum(n) - 1
            full = np.empty(n.sum(), dtype="<u4")
            free = np.ones(len(full), dtype=bool)
            free[ends] = False
            full[free], full[ends] = flat, end_id
            doc, piece, start, length = cut_lengths(n, limit)
            begin = (ends + 1 - n)[doc] + start
            mem = memoryview(full).cast("B")
            crc = [zlib.crc32(mem[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            order = np.argsort(length, kind="stable")
            run_first = np.searchsorted(length[order], length[order])
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = np.arange(len(length)) - run_first
            nth += seen[length]
            seen += np.bincount(length, minlength=limit + 1)
            cols = [ids.cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), chunk, np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"]
            if carry_ids:
                # pieces follow one another as their ids do
                bounds = np.concatenate(([0], np.cumsum(length)))
                if as_bytes:
                    width = 2 if max(len(bpe.length) - 1, end_id) < 1 << 16 else 4
                    cols.append(pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((width * bounds).astype(np.int32)), pa.py_buffer(full.astype(f"<u{width}"))]))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(full.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long" + carry_ids * (", ids binary" if as_bytes else ", ids array<int>")
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


def group_lengths(count: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """The lengths with their counts, largest first, in groups of equal cardinality (a length may be in two)."""
    total = sum(count.values())
    most = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = most
    for length in sorted(count, reverse=True):
        left = count[length]
        while left:
            if not room:
                out.append([])
                room = most
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return [g for g in out if g]


def configurations(sizes: np.ndarray, need: np.ndarray, limit: int, rounds: int = 1_000_000) -> list[tuple[np.ndarray, int]]:
    """Configurations of sizes (each over a third of the limit, so one or two in a sequence) with how often the optimum uses each in full.

    The linear program covers ``need`` at the least cost by column generation:
    the revised simplex takes in the pair that saves most at the current
    prices. A sequence costs 1, and slightly less if a pair nearly fills it:
    among plans with equally many sequences those with tight pairs leave the
    wide rooms whole for the small pieces. The program is few sizes wide, so the
    simplex ends at its optimum; one that doesn't is an error, not a worse plan.
    """
    k = len(sizes)
    room = limit - sizes[:, None] - sizes[None, :]
    cost = np.where(room >= 0, 1 - 0.05 * np.maximum(0, 1 - room / 12), np.inf)
    columns, inverse, prices, x = np.eye(k), np.eye(k), np.ones(k), need.astype(float)
    for _ in range(rounds):
        dual = prices @ inverse
        gain = dual[:, None] + dual[None, :] - cost
        i, j = divmod(int(gain.argmax()), k)
        if gain[i, j] <= 1e-9:
            break
        take = np.zeros(k)
        take[i] += 1
        take[j] += 1
        step = inverse @ take
        ratio = np.where(step > 1e-11, x / np.where(step > 1e-11, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = ratio[out]
        x = np.maximum(x - amount * step, 0)
        x[out] = amount
        columns[:, out], prices[out] = take, cost[i, j]
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    else:
        raise RuntimeError(f"the configuration program has no optimum after {rounds} steps")
    tight_first = np.argsort(prices, kind="stable")
    return [(columns[:, j].astype(np.int64), int(np.floor(x[j] + 1e-9))) for j in tight_first if x[j] >= 1 - 1e-9]


class Bins:
    """Classes of sequences with the same contents: [contents, how many], found by the room they have left."""

    def __init__(self, limit: int):
        self.limit, self.classes, self.by_room, self.rooms = limit, [], {}, []

    def add(self, contents: tuple[int, ...], n: int) -> None:
        if n <= 0:
            return
        self.classes.append([contents, n])
        room = self.limit - sum(contents)
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append(len(self.classes) - 1)

    def place(self, length: int, n: int) -> None:
        """Each of n pieces into the sequence with the least room that holds it, or a new one."""
        while n:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                per = self.limit // length
                self.add((length,) * per, n // per)
                self.add((length,) * (n % per), 1 if n % per else 0)
                return
            room = self.rooms[at]
            mine = self.classes[self.by_room[room][-1]]
            m = min(n, mine[1])
            mine[1] -= m
            contents = mine[0]
            if not mine[1]:
                self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room]
                    self.rooms.pop(at)
            self.add((*contents, length), m)
            n -= m


def plan(count: dict[int, int], limit: int = LIMIT, groups: int = GROUPS) -> np.ndarray:
    """Runs (length, first rank, first sequence, offset, pieces): rank first + i goes to sequence first + i at the offset."""
    large = limit // 3
    bins = Bins(limit)
    bins.add((limit,), count.get(limit, 0))
    big = {x: n for x, n in count.items() if large < x < limit}
    left: dict[int, int] = {x: n for x, n in count.items() if x <= large}
    if big:
        grouped = group_lengths(big, groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for g in grouped:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(sorted(merged, reverse=True))
        stock = [[list(x) for x in merged[s]] for s in sizes.tolist()]
        need = np.array([sum(n for _, n in s) for s in stock], dtype=float)
        for take, n in configurations(sizes, need, limit):
            slots = [i for i in np.flatnonzero(take) for _ in range(take[i])]
            while n > 0:  # actual lengths in the places of the rounded ones, as long as each slot has one length
                own: list[int] = []
                used: dict[int, int] = {}
                for i in slots:
                    while stock[i] and not stock[i][0][1]:
                        stock[i].pop(0)
                    if stock[i]:
                        own.append(i)
                        used[i] = used.get(i, 0) + 1
                if not own:
                    break
                m = n
                for i, times in used.items():
                    m = min(m, stock[i][0][1] // times) if stock[i][0][1] >= times else 0
                if m == 0:  # the slots of one sequence take more than one length
                    m, contents = 1, []
                    for i in own:
                        while stock[i] and not stock[i][0][1]:
                            stock[i].pop(0)
                        if stock[i]:
                            contents.append(stock[i][0][0])
                            stock[i][0][1] -= 1
                else:
                    contents = [stock[i][0][0] for i in own]
                    for i, times in used.items():
                        stock[i][0][1] -= m * times
                bins.add(tuple(contents), m)
                n -= m
        for s in stock:
            for x, n in s:
                if n:
                    left[x] = left.get(x, 0) + n
    for x in sorted(left, reverse=True):
        bins.place(x, left[x])
    runs, rank, sequence = [], {}, 0
    for contents, n in bins.classes:
        if not n:
            continue
        offset = 0
        for x in contents:
            runs.append((x, rank.get(x, 0), sequence, offset, n))
            rank[x] = rank.get(x, 0) + n
            offset += x
        sequence += n
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


#: The largest plan that is sent to all tasks. Its runs grow with the distinct lengths, not with the corpus (README has counts).
RUNS_BYTES = 64 << 20
#: Up to so many bytes of shifts (8 kB for a part of the piece table) are sent to all tasks; beyond, Spark chooses how they meet the pieces.
SHIFT_BYTES = 64 << 20


def shifts(per_chunk: DataFrame, limit: int) -> DataFrame:
    """(chunk, shift): for each length how many pieces the parts before have, from rows (chunk, length, n)."""
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    each = per_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))

    def in_line(t: pa.Table) -> pa.Table:
        row = np.zeros(limit + 1, dtype=np.int64)
        row[t.column("length").to_numpy()] = t.column("base").to_numpy()
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "shift": pa.array([row], pa.list_(pa.int64()))})

    return each.groupBy("chunk").applyInArrow(in_line, "chunk int, shift array<long>")


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """cut (of pieces(), written) with sequence_id and offset."""
    spark = cut.sparkSession
    per_chunk = cut.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    per_chunk = materialize(per_chunk, "packing-counts")
    count = {r["length"]: r["n"] for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    runs = plan(count, limit)
    if runs.nbytes > RUNS_BYTES:
        raise RuntimeError(f"a plan of {len(runs)} runs is too large to send")
    shared = spark.sparkContext.broadcast(runs)
    shift = materialize(shifts(per_chunk, limit), "packing-shifts")
    if shift.count() * (limit + 1) * 8 <= SHIFT_BYTES:
        shift = F.broadcast(shift)

    rank = F.col("nth") + F.get("shift", F.col("length").cast("int"))
    keep = [c for c in cut.columns if c not in ("chunk", "nth")]
    ranked = cut.join(shift, "chunk").select(*keep, rank.alias("rank"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table[:, 0] << 44) | table[:, 1] if len(table) else np.zeros(0, np.int64)
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            seq = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(table[at, 3])], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID, carry_ids: bool = False, as_bytes: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all documents; with carry_ids the ids too, as pieces() has them."""
    return pack(materialize(pieces(docs, vocabulary, limit, end_id, carry_ids, as_bytes), "packing-pieces"), limit)


def sequences(packed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces) of what pack_documents(carry_ids=True) gives: each filled sequence, and what lies in it where."""
    inside = ("doc_id", "piece", "start", "length", "offset")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for t, at in sorted_groups(batches, ["sequence_id"]):
            length = t.column("length").to_numpy()
            bounds = np.concatenate(([0], np.cumsum(length)))
            ids = t.column("ids").combine_chunks()
            if pa.types.is_binary(ids.type) or pa.types.is_large_binary(ids.type):
                raw = b"".join(ids.to_pylist())
                ids = pa.array(np.frombuffer(raw, f"<u{len(raw) // bounds[-1]}").astype(np.int32))
            else:
                ids = ids.flatten().cast(pa.int32())
            own = pa.StructArray.from_arrays([t.column(c).combine_chunks() for c in inside], names=list(inside))
            cols = [t.column("sequence_id").take(pa.array(at[:-1])).combine_chunks(), pa.array(np.diff(bounds[at])), pa.ListArray.from_arrays(pa.array(bounds[at].astype(np.int32)), ids), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), own)]
            yield pa.RecordBatch.from_arrays(cols, names=["sequence_id", "n_tokens", "ids", "pieces"])

    rows = packed.select("sequence_id", "ids", *inside)
    schema = "sequence_id long, n_tokens long, ids array<int>, pieces array<struct<doc_id: long, piece: int, start: long, length: long, offset: long>>"
    shared = rows.where(F.col("length") < limit).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    # a piece that fills its sequence needs no other
    return rows.where(F.col("length") == limit).mapInArrow(run, schema).unionByName(shared.mapInArrow(run, schema))
