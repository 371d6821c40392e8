"""Token counts from a tokenizer compiled to a transducer.

A merge-type encoding has one last token for each prefix of a text, and it is
found from left to right: a token that ends here is the last one exactly if it
is compatible with the last token of the prefix before it. What the rest of the
text can still ask of a prefix are the places from which some token is under
way: for each the node of the trie of tokens that has been reached, the last
token before the place, and how many tokens that prefix has, relative to now.
This list is the state of a deterministic transducer over characters. Reading a
character moves every place on in the trie, drops those from which no token
goes on, and adds the new place; the transition is annotated with the tokens
that it emits, the new count less the old one (below zero where a longer token
replaces several). Lists are bounded by the longest token, so states are
finitely many, but far more than any text meets: transitions are compiled when
they are first asked for, all that a step lacks at once, and kept.

Texts are read in chunks. Where two characters meet in no token, the state is
the one after the start whatever came before, so a chunk that begins there has
a constant map, and equal ones are read once. Longer stretches are dealt into
chunks of ``CHUNK`` characters, read side by side: a chunk's map holds a row
(entry state, exit state, count) for the entry that reading the ``WARM``
characters before it suggests, and one for each exit of a chunk before it that
has no row yet, until every exit has one. Then all maps are composed by a
parallel prefix scan: pointers over rows are doubled until each row knows its
count up to the end.

Defined cases: null and empty texts have no tokens. Characters in no piece
count a token for each of their bytes. The character for a space counts as a
space; strings of control pieces are ordinary text. Repeated rows and null
doc_ids give a row each; an empty table gives no rows. Only doc_id and text are
read. Texts of any length are read whole: a slice of texts or one longer text is
held at a time, ``BATCH`` characters of it in chunks, and kept states are
forgotten between batches when there are more than ``MOST_STATES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import IS_POINT, text_slices
from weftgraph.llm.piece_codec import PairTable, PieceCodec, codec

CHUNK, WARM = 64, 24
#: Stretches of up to so many characters are one chunk.
WHOLE = 96
BATCH, MOST_STATES = 1 << 17, 1 << 17
FREE = -1  # no token before: nothing is incompatible with what follows


class Transducer:
    """The compiled tokenizer. A state is a run of rows (node, token before, count relative to now) in ``rows``."""

    def __init__(self, pieces: PieceCodec):
        self.pieces = pieces
        chars = sorted(pieces.known - {"▁"} | {" "})
        self.n_chars = len(chars)
        number = {c: i for i, c in enumerate(chars)}
        # characters in no piece are four more classes, by their bytes
        self.class_of = np.empty(0x110000, dtype=np.int16)
        for size, (a, b) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000))):
            self.class_of[a:b] = self.n_chars + size
        self.class_of[[ord(c) for c in chars]] = np.arange(self.n_chars)
        self.width = self.n_chars + 4
        child: dict[tuple[int, int], int] = {}
        ends, self.last_char, joined = {}, np.full(pieces.size, -1, dtype=np.int64), set()
        for text, i in pieces.tokens.items():
            codes = [number[c] for c in text]
            node = 0
            for c in codes:
                node = child.setdefault((node, c), len(child) + 1)
            ends[node] = i
            self.last_char[i] = codes[-1]
            joined.update(zip(codes, codes[1:]))
        keys = np.array([(a, c, b) for (a, c), b in child.items()], dtype=np.int64)
        self.child = PairTable(keys[:, 0], keys[:, 1], keys[:, 2])
        self.token = np.full(len(child) + 1, -1, dtype=np.int64)
        self.token[list(ends)] = list(ends.values())
        self.goes_on = np.zeros(len(child) + 1, dtype=bool)
        self.goes_on[keys[:, 0]] = True
        pairs = np.array(sorted(joined), dtype=np.int64).reshape(-1, 2)
        self.joined = PairTable(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)))
        self.forget()

    def forget(self) -> None:
        """Drop all states but the one at the start of a segment, which is number 0."""
        self.numbers: dict[bytes, int] = {}
        self.off, self.rows, self.n_states, self.n_rows = np.zeros(1024, np.int64), np.zeros((4096, 3), np.int32), 0, 0
        self.key, self.to, self.emit = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int16)
        self.intern(np.array([[0, FREE, 0]], dtype=np.int32), np.array([0, 1]))

    def intern(self, rows: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Numbers of states given as runs of rows; new ones are added."""
        raw, step = rows.astype(np.int32).tobytes(), 12
        out = np.empty(len(off) - 1, dtype=np.int32)
        fresh = []
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            key = raw[a * step : b * step]
            number = self.numbers.get(key)
            if number is None:
                number = self.numbers[key] = len(self.numbers)
                fresh.append(i)
            out[i] = number
        if fresh:
            fresh = np.array(fresh)
            size = off[fresh + 1] - off[fresh]
            taken = np.repeat(off[fresh] - np.cumsum(size) + size, size) + np.arange(size.sum())
            need, states = self.n_rows + len(taken), self.n_states + len(fresh)
            if need > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((need, 3), np.int32)))
            if states + 1 > len(self.off):
                self.off = np.concatenate((self.off, np.zeros(states + 1, np.int64)))
            self.rows[self.n_rows : need] = rows[taken]
            self.off[self.n_states + 1 : states + 1] = self.n_rows + np.cumsum(size)
            self.n_rows, self.n_states = need, states
        return out

    def compile(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, emitted tokens) of transitions."""
        size = self.off[state + 1] - self.off[state]
        who = np.repeat(np.arange(len(state)), size)
        node, before, count = self.rows[np.repeat(self.off[state] - np.cumsum(size) + size, size) + np.arange(size.sum())].T.astype(np.int64)
        to = self.child.get(node, cls[who]).astype(np.int64)
        on = to >= 0
        who, node, before, count, to = who[on], node[on], before[on], count[on], to[on]
        held = np.flatnonzero((node == 0) & (before >= 0))
        apart = self.joined.get(self.last_char[before[held]], cls[who[held]]) < 0
        before[held[apart]] = FREE
        token = self.token[to]
        ends = token >= 0
        check = np.flatnonzero(ends & (before >= 0))
        ends[check] = self.pieces.compatible(before[check], token[check])
        # of the tokens that end here one is compatible; a character in no piece is its bytes
        emit = np.maximum(cls - self.n_chars + 1, 0)
        last = np.full(len(state), FREE, dtype=np.int64)
        emit[who[ends]], last[who[ends]] = count[ends] + 1, token[ends]
        live = self.goes_on[to]
        who = np.concatenate((who[live], np.arange(len(state))))
        zero = np.zeros(len(state), dtype=np.int64)
        rows = np.stack((np.concatenate((to[live], zero)), np.concatenate((before[live], last)), np.concatenate((count[live], emit))), axis=1)
        rows[:, 2] -= emit[who]
        order = np.argsort(who, kind="stable")
        off = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(state)))))
        return self.intern(rows[order], off), emit

    def step(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) * self.width + cls
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), dtype=bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == key[inside]
        if not known.all():
            new = np.unique(key[~known])
            to, emit = self.compile(new // self.width, new % self.width)
            where = np.searchsorted(self.key, new)
            self.key, self.to, self.emit = np.insert(self.key, where, new), np.insert(self.to, where, to), np.insert(self.emit, where, emit.astype(np.int16))
            at = np.searchsorted(self.key, key)
        return self.to[at], self.emit[at]

    def read(self, cls: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, counts) of stretches of cls, read side by side."""
        order = np.argsort(-size, kind="stable")
        at, left, here, count = start[order], size[order], state[order].astype(np.int32), np.zeros(len(order), dtype=np.int64)
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k, side="left"))
            here[:n], emit = self.step(here[:n], cls[at[:n] + k])
            count[:n] += emit
        out = np.empty_like(here), np.empty_like(count)
        out[0][order], out[1][order] = here, count
        return out

    def bounded(self, cls: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Counts of stretches that begin where the state is the one at the start."""
        out = np.zeros(len(start), dtype=np.int64)
        edges = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + BATCH, BATCH))
        for a, b in zip(edges, edges[1:]):
            if self.n_states > MOST_STATES:
                self.forget()
            if b > a:
                out[a:b] = self.read(cls, start[a:b], size[a:b], np.zeros(b - a, np.int32))[1]
        return out

    def scan(self, cls: np.ndarray, begin: int, end: int) -> int:
        """The count of one long stretch: chunk maps, composed."""
        total, entry = 0, self.rows[0:1].copy()
        for a in range(begin, end, BATCH):
            if self.n_states > MOST_STATES:
                self.forget()
            b = min(a + BATCH, end)
            first = int(self.intern(entry, np.array([0, len(entry)]))[0])
            count, leaves = self.compose(cls, np.arange(a, b, CHUNK), b, first, begin)
            total += count
            entry = self.rows[self.off[leaves] : self.off[leaves + 1]].copy()
        return total

    def compose(self, cls: np.ndarray, start: np.ndarray, end: int, first: int, begin: int) -> tuple[int, int]:
        """(count, exit state) of successive chunks that are entered in the state ``first``."""
        n, size = len(start), np.diff(np.append(start, end))
        warm = np.maximum(start - WARM, begin)
        guess = self.read(cls, warm, start - warm, np.zeros(n, np.int32))[0].astype(np.int64)
        guess[0] = first
        # equal chunks share a map, so text that repeats itself has few
        padded = np.full((n, CHUNK), -1, dtype=np.int64)
        padded[np.arange(CHUNK) < size[:, None]] = cls[start[0] : end]
        _, sample, own = np.unique(padded, axis=0, return_index=True, return_inverse=True)
        own = own.reshape(-1)
        follows = np.unique((own[:-1] << 32) | own[1:])
        before, after = follows >> 32, follows & 0xFFFFFFFF
        todo = np.unique((own << 32) | guess)
        key, leaves, count = (np.zeros(0, dtype=np.int64) for _ in range(3))
        while len(todo):
            chunk, state = todo >> 32, todo & 0xFFFFFFFF
            got = self.read(cls, start[sample[chunk]], size[sample[chunk]], state)
            where = np.searchsorted(key, todo)
            key, leaves, count = np.insert(key, where, todo), np.insert(leaves, where, got[0]), np.insert(count, where, got[1])
            # every exit of the new rows is an entry of whatever comes next
            lo, hi = np.searchsorted(before, chunk), np.searchsorted(before, chunk, side="right")
            many = hi - lo
            nxt = after[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
            todo = np.setdiff1d((nxt << 32) | np.repeat(got[0].astype(np.int64), many), key)
        # rows of chunks: each points to the row of the next chunk that its exit enters, those of the last to an end
        lo, hi = np.searchsorted(key, own << 32), np.searchsorted(key, (own + 1) << 32)
        many = hi - lo
        base = np.cumsum(many) - many
        row = np.repeat(lo - base, many) + np.arange(many.sum())
        chunk = np.repeat(np.arange(n), many)
        m, final = len(row), np.append(leaves[row], -1)
        inner = chunk + 1 < n
        to = np.full(m + 1, m)
        up = chunk[inner] + 1
        to[:-1][inner] = base[up] - lo[up] + np.searchsorted(key, (own[up] << 32) | leaves[row[inner]])
        count = np.append(count[row], 0)
        reach = 1
        while reach < n:
            count = count + count[to]
            final = np.where(final[to] >= 0, final[to], final)
            to, reach = to[to], 2 * reach
        at = int(np.searchsorted(key, (own[0] << 32) | first) - lo[0])
        return int(count[at]), int(final[at])

    def count_texts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        apart, bounds = self.pieces.marked(buf, off)
        if not len(apart):
            return np.zeros(len(off) - 1, np.int64)
        cuts, code, d_buf, d_off = self.pieces.segments(apart, bounds)
        cls = self.class_of[np.frombuffer(d_buf.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)
        at = np.concatenate(([0], np.cumsum(IS_POINT[d_buf])))[d_off]
        size = np.diff(at)
        counts = np.zeros(len(size), dtype=np.int64)
        short = np.flatnonzero(size <= WHOLE)
        counts[short] = self.bounded(cls, at[short], size[short])
        for i in np.flatnonzero(size > WHOLE).tolist():
            counts[i] = self.scan(cls, int(at[i]), int(at[i + 1]))
        total = np.concatenate(([0], np.cumsum(counts[code])))
        return np.diff(total[np.searchsorted(cuts, bounds)])


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(codec(path))


OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, without begin and end ids; over_limit: more tokens than limit."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for ids, buf, off in text_slices(batches):
            n = t.count_texts(buf, off)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, OUT)
