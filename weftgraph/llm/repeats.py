"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Suffixes are sorted in shards, and what can't match is never sorted:

1. Documents lie in blocks. The least hash of the k-byte strings of every
   window of ``WINDOW`` bytes marks an anchor; equal windows have the same
   anchor at the same place, so two documents can share a window only around an
   anchor that both have. An anchor's context is all that its windows reach:
   ``WINDOW - k`` bytes before it and ``WINDOW`` from it on. Per block, equal
   contexts are one row with the least document id.
2. By anchor: contexts that also occur with a smaller id are covered whole; an
   anchor with one context has nothing to sort; of the others each context is
   asked for once, from the block with the least id.
3. The contexts asked for come to their anchor's shard, which orders their
   suffixes by the difference-cover algorithm (suffixes.py), compares the first
   ``WINDOW`` bytes of neighbours, and tells each context which of its windows
   start in a smaller document.
4. Blocks mark the covered bytes and return what is left.

Anchors with very many contexts in a block (a common phrase in changing
surroundings) don't go to one shard: their windows are dealt out by the
windows' own 128-bit hashes, which finds the same matches. A block sends each of
its distinct windows once, with the least document id it has for it, so a phrase
in every document is one row a block and window.

Equality of contexts in step 2 rests on 63 + 48 bits of hash within a bucket,
of windows of very common anchors on 128; all others are compared byte by byte.

Defined cases: a null or empty text has no bytes; texts shorter than the window
keep all theirs. Rows with the same doc_id don't cover each other; a row with a
null doc_id loses nothing and covers nothing. A text longer than a block is a
block by itself and is held whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.blocks import Block, each_block, make_blocks
from weftgraph.llm.common import give_back, materialize, mix, partitions
from weftgraph.llm.suffixes import suffix_order

WINDOW, K = 50, 16
BEFORE, REACH = WINDOW - K, 2 * WINDOW - K  # bytes of a context before its anchor, and at most
W = WINDOW - K + 1  # k-byte strings in a window
NOTHING, COVERED, ASKED, DEALT = 0, 1, 2, 3
#: Of text, for each bucket: what a worker holds of one is some eight times as much.
BUCKET_BYTES = 12 << 20


@dataclass(frozen=True)
class Spread:
    """hot_in_block: contexts of an anchor in one block, and hot: in all, from which its windows are dealt out by themselves."""

    hot_in_block: int = 48
    hot: int = 4096


def _byte_codes() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(977))


CODES = _byte_codes()
ODD = 0x9E3779B97F4A7C15


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the K = 16 bytes from each place on, by doubling."""
    h = CODES[b]
    for n in (1, 2, 4, 8):
        h = h[:-n] * np.uint64(pow(ODD, n, 1 << 64)) + h[n:]
    return mix(h)


def slide(a: np.ndarray, width: int, best) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a, n = best(a[:-n], a[n:]), 2 * n
    return best(a[: len(a) - (width - n)], a[width - n :]) if n < width else a


class Anchors:
    """Of a block: texts apart by REACH zero bytes (text), their places (begin, end), and distinct (anchor, context) pairs.

    For every occurrence: place, doc (index in the block), left and right (bytes of its context before and from the
    anchor on), pair. For every pair: anchor, context hash, first occurrence and least known document. Pairs are
    ordered by anchor and context, the same each time a block is looked at.
    """

    def __init__(self, block: Block, chunk: int = 1 << 15):
        size = np.diff(block.off)
        n = len(size)
        self.block = block
        self.begin = block.off[:-1] + REACH * (np.arange(n) + 1)
        self.end = self.begin + size
        self.text = np.zeros(int(block.off[-1]) + REACH * (n + 1), dtype=np.uint8)
        inside = np.repeat(REACH * (np.arange(n) + 1), size) + np.arange(len(block.buf))
        self.text[inside] = block.buf
        step = np.zeros(len(self.text) + 1, dtype=np.int8)
        long = size >= WINDOW
        long &= block.known
        np.add.at(step, self.begin[long], 1)
        np.add.at(step, self.end[long] - WINDOW + 1, -1)
        starts = np.cumsum(step[:-1], dtype=np.int8).astype(bool)  # where a window starts
        found, hashes = [], []
        for c in range(W, len(self.text) - REACH, chunk):
            stop = min(c + chunk, len(self.text) - REACH)
            # windows that start in [c - W + 1, stop) hold the anchors in [c, stop)
            h = gram_hashes(self.text[c - W + 1 : stop + W - 1 + K - 1])
            least = slide(h, W, np.minimum)
            least *= starts[c - W + 1 : stop]
            most = slide(least, W, np.maximum)
            own = h[W - 1 : W - 1 + stop - c]
            at = np.flatnonzero((most == own) & (own > 0))
            found.append(at + c)
            hashes.append(own[at])
        place = np.concatenate(found) if found else np.zeros(0, np.int64)
        anchor = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        doc = np.searchsorted(self.begin, place, side="right") - 1
        left = np.minimum(place - self.begin[doc], BEFORE)
        right = np.minimum(self.end[doc] - place, WINDOW)
        context = self._context_hash(place, left, right)
        order = np.lexsort((context, anchor))
        self.place, self.doc, self.left, self.right = place[order], doc[order], left[order], right[order]
        a, c = anchor[order], context[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.pair = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.anchor, self.context = a[new], c[new]
        self.least = block.ids[self.doc[self.first]]

    def _context_hash(self, place, left, right) -> np.ndarray:
        out = np.zeros(len(place), dtype=np.uint64)
        view = np.lib.stride_tricks.sliding_window_view(self.text, REACH)
        for s in range(0, len(place), 20_000):
            part = slice(s, s + 20_000)
            rows = view[place[part] - BEFORE].copy()
            # bytes beyond the document are zero and how many are its own is hashed too
            words = np.zeros((len(rows), -(-REACH // 8) * 8), dtype=np.uint8)
            words[:, :REACH] = rows
            h = mix((left[part] * 256 + right[part]).astype(np.uint64))
            for word in words.view("<u8").T:
                h = mix(h ^ word)
            out[part] = h
        return out

    def contexts(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, left, right) of the pairs' contexts."""
        at = self.first[pairs]
        view = np.lib.stride_tricks.sliding_window_view(self.text, REACH)
        return view[self.place[at] - BEFORE].copy(), self.left[at], self.right[at]

    def crowded(self, spread: Spread) -> np.ndarray:
        """For each pair whether its anchor has very many contexts in this block."""
        new = np.ones(len(self.anchor), dtype=bool)
        new[1:] = self.anchor[1:] != self.anchor[:-1]
        group = np.cumsum(new) - 1
        return np.bincount(group)[group] > spread.hot_in_block if len(group) else np.zeros(0, bool)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def narrow(h: np.ndarray, n: int) -> bytes:
    """The low n bytes of each number."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def ids_bytes(ids: np.ndarray) -> tuple[int, bytes]:
    """Ids relative to the least one, in four bytes each where that does."""
    base = int(ids.min()) if len(ids) else 0
    if len(ids) and int(ids.max()) - base < 1 << 32:
        return base, (ids - base).astype("<u4").tobytes()
    return base, ids.astype("<i8").tobytes()


def ids_back(base: int, raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64) + base if len(raw) == 4 * n else np.frombuffer(raw, "<i8")


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    s = bucket[order]
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    for a, b in zip(at, np.append(at[1:], len(s))):
        yield int(s[a]), order[a:b]


class Bucketed:
    """Where the pairs of a block go in the first round: one row an anchor's context, one an anchor that is crowded here."""

    def __init__(self, anchors: Anchors, spread: Spread, buckets: int):
        self.crowded = anchors.crowded(spread)
        send = ~self.crowded
        lead = np.ones(len(send), dtype=bool)
        lead[1:] = anchors.anchor[1:] != anchors.anchor[:-1]
        self.sent = np.flatnonzero(send | (lead & self.crowded))
        self.lists = list(by_bucket(bucket_of(anchors.anchor[self.sent], buckets)))


FIRST = "bucket int, block long, n int, anchor binary, context binary, base long, ids binary, crowded binary"


def first_round(blocks: DataFrame, spread: Spread, buckets: int) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for block, _ in each_block(batches):
            a = Anchors(block)
            b = Bucketed(a, spread, buckets)
            rows = []
            for k, at in b.lists:
                p = b.sent[at]
                rows.append((k, block.block, len(p), narrow(a.anchor[p], 8), narrow(a.context[p], 6), *ids_bytes(a.least[p]), np.packbits(b.crowded[p]).tobytes()))
            if rows:
                yield batch_of(rows, FIRST_SCHEMA)

    return blocks.select(*BLOCK_COLUMNS).mapInArrow(run, FIRST)


BLOCK_COLUMNS = ("block", "ids", "known", "lens", "body")
FIRST_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("anchor", pa.binary()), ("context", pa.binary()), ("base", pa.int64()), ("ids", pa.binary()), ("crowded", pa.binary())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def group_start(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), dtype=bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def judge(t: pa.Table, spread: Spread) -> pa.Table:
    """The answer to each block's list of one bucket: a code for each of its pairs."""
    n = t.column("n").to_numpy()
    anchor = wide(b"".join(t.column("anchor").to_pylist()), 8)
    context = wide(b"".join(t.column("context").to_pylist()), 6)
    ids = np.concatenate([ids_back(b, r, k) for b, r, k in zip(t.column("base").to_pylist(), t.column("ids").to_pylist(), n.tolist())])
    crowded = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=k).astype(bool) for r, k in zip(t.column("crowded").to_pylist(), n.tolist())])
    order = np.lexsort((ids, context, anchor))
    a, c, d = anchor[order], context[order], ids[order]
    pair_new = group_start(a, c)
    pair_at = np.flatnonzero(pair_new)
    least = d[pair_at][np.cumsum(pair_new) - 1]
    new = group_start(a)
    group = np.cumsum(new) - 1
    contexts = np.bincount(group, pair_new).astype(np.int64)[group]
    hot = (np.bincount(group, crowded[order])[group] > 0) | (contexts > spread.hot)
    code = np.where(d > least, COVERED, np.where(contexts > 1, ASKED, NOTHING))
    code[hot] = DEALT
    out = np.empty(len(code), dtype=np.uint8)
    out[order] = code
    bounds = np.concatenate(([0], np.cumsum(n)))
    packer = zstandard.ZstdCompressor(level=1)
    codes = [packer.compress(out[x:y].tobytes()) for x, y in zip(bounds[:-1], bounds[1:])]
    return pa.table({"bucket": t.column("bucket"), "block": t.column("block"), "codes": pa.array(codes, pa.binary())})


def codes_of(a: Anchors, spread: Spread, buckets: int, answers: list[dict]) -> np.ndarray:
    """A code for every pair of the block."""
    code = np.zeros(len(a.anchor), dtype=np.uint8)
    b = Bucketed(a, spread, buckets)
    told = {x["bucket"]: x["codes"] for x in answers or []}
    for k, at in b.lists:
        code[b.sent[at]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(told[k]), dtype=np.uint8)
    code[b.crowded] = DEALT
    return code


SECOND_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("key", pa.binary()), ("base", pa.int64()), ("ids", pa.binary()), ("pair", pa.binary()), ("extent", pa.binary()), ("body", pa.binary())])
SECOND = "bucket int, block long, kind int, n int, key binary, base long, ids binary, pair binary, extent binary, body binary"


def windows_of(bodies: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of every window that lies within its context's bytes; starts count from BEFORE bytes before the anchor."""
    row = np.repeat(np.arange(len(left)), W)
    start = np.tile(np.arange(W), len(left))
    fine = (start >= BEFORE - left[row]) & (start + WINDOW <= BEFORE + right[row])
    return row[fine], start[fine]


def second_round(blocks: DataFrame, answers: DataFrame, spread: Spread, buckets: int) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for block, row in each_block(batches):
            a = Anchors(block)
            code = codes_of(a, spread, buckets, row["answers"])
            rows = []
            asked = np.flatnonzero(code == ASKED)
            if len(asked):
                bodies, left, right = a.contexts(asked)
                extent = np.stack((left, right), axis=1).astype(np.uint8)
                for k, at in by_bucket(bucket_of(a.anchor[asked], buckets)):
                    p = asked[at]
                    rows.append((k, block.block, 0, len(p), narrow(a.anchor[p], 8), *ids_bytes(a.least[p]), p.astype("<u4").tobytes(), extent[at].tobytes(), packer.compress(bodies[at].tobytes())))
            dealt = np.flatnonzero(code == DEALT)
            if len(dealt):
                own = DealtWindows(a, dealt)
                for k, w in by_bucket(bucket_of(own.h1, buckets)):
                    key = np.stack((own.h1[w], own.h2[w]), axis=1).tobytes()
                    rows.append((k, block.block, 1, len(w), key, *ids_bytes(own.least[w]), w.astype("<u4").tobytes(), b"", b""))
            if rows:
                yield batch_of(rows, SECOND_SCHEMA)

    return blocks.select(*BLOCK_COLUMNS).join(answers, "block").mapInArrow(run, SECOND)


def window_hashes(bodies: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    view = np.lib.stride_tricks.sliding_window_view(bodies, WINDOW, axis=1)
    one, two = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
    for s in range(0, len(row), 50_000):
        part = slice(s, s + 50_000)
        words = np.zeros((len(row[part]), 56), dtype=np.uint8)
        words[:, :WINDOW] = view[row[part], start[part]]
        h, g = mix(np.full(len(words), 1, np.uint64)), mix(np.full(len(words), 2, np.uint64))
        for word in words.view("<u8").T:
            h, g = mix(h ^ word), mix(g + word)
        one[part], two[part] = h, g
    return one, two


class DealtWindows:
    """The windows of a block's pairs that are dealt out: pair, start and number of each, and of each distinct one h1, h2 and its least document."""

    def __init__(self, a: Anchors, pairs: np.ndarray):
        bodies, left, right = a.contexts(pairs)
        at, self.start = windows_of(bodies, left, right)
        self.pair = pairs[at]
        h1, h2 = window_hashes(bodies, at, self.start)
        order = np.lexsort((h2, h1))
        new = group_start(h1[order], h2[order])
        first = np.flatnonzero(new)
        self.number = np.empty(len(order), dtype=np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.h1, self.h2 = h1[order][first], h2[order][first]
        self.least = np.minimum.reduceat(a.least[self.pair[order]], first) if len(first) else np.zeros(0, np.int64)

    def hits(self, a: Anchors, elsewhere: np.ndarray) -> np.ndarray:
        """Which windows also start in a smaller document, if ``elsewhere`` has the numbers of those that do in another block."""
        out = self.least[self.number] < a.least[self.pair]
        flag = np.zeros(len(self.least), dtype=bool)
        flag[elsewhere] = True
        return out | flag[self.number]


def match_contexts(anchor: np.ndarray, ids: np.ndarray, extent: np.ndarray, bodies: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """For each context a mask: bit s is set if its window from s on also starts in a document with a smaller id.

    Contexts of one anchor stay together; as many anchors as ``most`` bytes hold are sorted at a time.
    """
    mask = np.zeros(len(anchor), dtype=np.uint64)
    order = np.argsort(anchor, kind="stable")
    cut = np.append(np.flatnonzero(group_start(anchor[order])), len(order))
    i = 0
    while i < len(cut) - 1:
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + most // REACH, side="right")) - 1)
        at = order[cut[i] : cut[j]]
        mask[at] = sorted_matches(ids[at], extent[at], bodies[at])
        i = j
    return mask


def sorted_matches(ids: np.ndarray, extent: np.ndarray, bodies: np.ndarray) -> np.ndarray:
    n = len(ids)
    text = np.zeros((n, REACH + 1), dtype=np.int64)
    text[:, :REACH] = bodies.astype(np.int64) + 2
    text[:, REACH] = 1  # below all bytes: ends a context
    order = suffix_order(text.ravel(), 3)
    row, start = order // (REACH + 1), order % (REACH + 1)
    left, right = extent[:, 0].astype(np.int64), extent[:, 1].astype(np.int64)
    fine = (start >= BEFORE - left[row]) & (start + WINDOW <= BEFORE + right[row])
    row, start = row[fine], start[fine]
    if not len(row):
        return np.zeros(n, np.uint64)
    # the first WINDOW bytes of neighbours, eight at a time
    raw = np.concatenate((np.ascontiguousarray(bodies).ravel(), np.zeros(8, np.uint8)))
    words = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    place = row * REACH + start
    same = np.ones(len(place) - 1, dtype=bool)
    for o in (0, 8, 16, 24, 32, 40, WINDOW - 8):
        w = words[place + o]
        same &= w[1:] == w[:-1]
    new = np.concatenate(([True], ~same))
    least = np.minimum.reduceat(ids[row], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = least < ids[row]
    out = np.zeros(n, dtype=np.uint64)
    np.bitwise_or.at(out, row[hit], np.uint64(1) << start[hit].astype(np.uint64))
    return out


def match(t: pa.Table) -> pa.Table:
    """(block, kind, masks) of one bucket: of contexts (0) their numbers and masks, of dealt windows (1) the numbers of those found in smaller documents."""
    found: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def tell(kind: int, blocks: np.ndarray, pair: np.ndarray, mask: np.ndarray):
        some = np.flatnonzero(mask)
        for b, at in by_bucket(blocks[some]):
            found.setdefault((b, kind), []).append((pair[some[at]], mask[some[at]]))

    def joined(column, kind) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind)

    for kind in (0, 1):
        own = t.filter(pa.compute.equal(t.column("kind"), kind))
        if not own.num_rows:
            continue
        n = own.column("n").to_numpy()
        blocks = np.repeat(own.column("block").to_numpy(), n)
        ids = np.concatenate([ids_back(b, r, k) for b, r, k in zip(own.column("base").to_pylist(), own.column("ids").to_pylist(), n.tolist())])
        pair = joined(own.column("pair"), "<u4").astype(np.int64)
        if kind == 0:
            unpack = zstandard.ZstdDecompressor()
            bodies = np.empty((int(n.sum()), REACH), dtype=np.uint8)
            at = 0
            for x, k in zip(own.column("body"), n.tolist()):
                bodies[at : at + k] = np.frombuffer(unpack.decompress(x.as_py()), np.uint8).reshape(-1, REACH)
                at += k
            tell(0, blocks, pair, match_contexts(wide(joined(own.column("key"), np.uint8).tobytes(), 8), ids, joined(own.column("extent"), np.uint8).reshape(-1, 2), bodies))
            del bodies
        else:
            h = joined(own.column("key"), np.uint64).reshape(-1, 2)
            order = np.lexsort((ids, h[:, 1], h[:, 0]))
            new = group_start(h[order, 0], h[order, 1])
            least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            hit = np.zeros(len(ids), dtype=np.uint64)
            hit[order] = least < ids[order]
            tell(1, blocks, pair, hit)
    packer = zstandard.ZstdCompressor(level=1)
    rows = []
    for (b, kind), parts in found.items():
        pair, mask = np.concatenate([p for p, _ in parts]), np.concatenate([m for _, m in parts])
        rows.append((b, kind, packer.compress(pair.astype("<u4").tobytes() + mask.astype("<u8").tobytes())))
    give_back()
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "masks": pa.array([r[2] for r in rows], pa.binary())})


def covered_bytes(a: Anchors, code: np.ndarray, masks: list[dict] | None) -> np.ndarray:
    """Which bytes of the block's text are covered by a window that starts in a smaller document."""
    mask = np.zeros(len(code), dtype=np.uint64)
    elsewhere = []
    for x in masks or []:
        raw = zstandard.ZstdDecompressor().decompress(x["masks"])
        n = len(raw) // 12
        numbers = np.frombuffer(raw, "<u4", n).astype(np.int64)
        if x["kind"] == 0:
            np.bitwise_or.at(mask, numbers, np.frombuffer(raw, "<u8", n, 4 * n))
        else:
            elsewhere.append(numbers)
    dealt = np.flatnonzero(code == DEALT)
    if len(dealt):
        own = DealtWindows(a, dealt)
        hit = own.hits(a, np.concatenate(elsewhere) if elsewhere else np.zeros(0, np.int64))
        np.bitwise_or.at(mask, own.pair[hit], np.uint64(1) << own.start[hit].astype(np.uint64))
    step = np.zeros(len(a.text) + 1, dtype=np.int32)
    ids = a.block.ids[a.doc]
    whole = (ids > a.least[a.pair]) | (code[a.pair] == COVERED)
    whole &= a.left + a.right >= WINDOW
    np.add.at(step, a.place[whole] - a.left[whole], 1)
    np.add.at(step, a.place[whole] + a.right[whole], -1)
    some = np.flatnonzero(~whole & (mask[a.pair] > 0))
    for s in range(W):
        at = some[(mask[a.pair[some]] >> np.uint64(s)) & np.uint64(1) > 0]
        np.add.at(step, a.place[at] - BEFORE + s, 1)
        np.add.at(step, a.place[at] - BEFORE + s + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def found_repeats(docs: DataFrame, spread: Spread, carry: bool = False) -> tuple[DataFrame, int]:
    """Blocks joined with what is known of them: (block columns, answers, masks); the number of buckets."""
    spark = docs.sparkSession
    blocks = make_blocks(docs, carry)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(2 * partitions(spark), -(-total // BUCKET_BYTES))
    judged = first_round(blocks, spread, buckets).groupBy("bucket").applyInArrow(lambda t: judge(t, spread), "bucket int, block long, codes binary")
    answers = materialize(judged.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes")).alias("answers")), "repeats-answers")
    matched = second_round(blocks, answers, spread, buckets).groupBy("bucket").applyInArrow(match, "block long, kind int, masks binary")
    masks = materialize(matched.groupBy("block").agg(F.collect_list(F.struct("kind", "masks")).alias("masks")), "repeats-masks")
    told = answers.join(masks, "block", "left")
    return blocks.join(told, "block", "left"), buckets


def spans(docs: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    joined, buckets = found_repeats(docs, spread)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block, row in each_block(batches):
            a = Anchors(block)
            covered = covered_bytes(a, codes_of(a, spread, buckets, row["answers"]), row["masks"])
            rise = np.concatenate(([0], np.cumsum(covered[1:] & ~covered[:-1])))
            total = np.concatenate(([0], np.cumsum(covered)))
            removed = total[a.end] - total[a.begin]
            n_spans = np.where(a.end > a.begin, rise[np.maximum(a.end - 1, 0)] - rise[a.begin - 1], 0)
            keep = ~covered
            digests = [hashlib.sha256(a.text[x:y][keep[x:y]].tobytes() if r else a.text[x:y].tobytes()).hexdigest() for x, y, r in zip(a.begin.tolist(), a.end.tolist(), removed.tolist())]
            ids = pa.array(block.ids, pa.int64(), mask=~block.known)
            yield pa.RecordBatch.from_arrays([ids, pa.array(a.end - a.begin), pa.array(removed), pa.array(n_spans), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select(*BLOCK_COLUMNS, "answers", "masks").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """docs with what remains of each text; a character that is cut goes whole, n_chars follows if there is such a column."""
    joined, buckets = found_repeats(docs, spread, carry=True)
    columns, schema = docs.columns, docs.schema
    others = [c for c in columns if c != "text"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block, row in each_block(batches):
            a = Anchors(block)
            keep = ~covered_bytes(a, codes_of(a, spread, buckets, row["answers"]), row["masks"])
            left = [a.text[x:y][keep[x:y]].tobytes().decode("utf-8", "ignore") for x, y in zip(a.begin.tolist(), a.end.tolist())]
            out = {"text": pa.array(left, pa.string())}
            for i, c in enumerate(others):
                out[c] = block.rest.column(f"r{i}").combine_chunks()
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) for t in left], pa.int64()).cast(out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([out[c].chunk(0) if isinstance(out[c], pa.ChunkedArray) else out[c] for c in columns], names=columns)

    return joined.select(*BLOCK_COLUMNS, "rest", "answers", "masks").mapInArrow(run, schema)
