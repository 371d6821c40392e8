"""SentencePiece BPE encoding by backtracking, and decoding.

A merge-type encoding is the only sequence of pieces in which every two
neighbours are compatible, i.e. encoding their joined text again gives these
two. So a text can be encoded from left to right: take the longest piece that
starts here (an Aho-Corasick automaton over the reversed pieces gives it for
every place in one backward pass), check it against the piece before, go on to
shorter pieces when it doesn't fit, and step back when none fits; places from
which no encoding goes on are marked in a bitfield and never tried again. All
distinct segments of a slice advance together in numpy.

The compatibility check re-merges: it walks down the seam of the two pieces'
merge trees in the order in which merges would undo, and looks whether some
pair across the seam would have merged earlier.

Segments are cut where no piece can cross (before a run of spaces, around
characters that are in no piece, between characters that meet in no piece), so
equal segments are encoded once a slice. A segment longer than ``LONG`` bytes,
as base64 or a language without spaces gives, is encoded by itself in one loop
of the same steps, since numpy would take a step a token for it alone.

Defined cases: null and empty texts give only the end id and an empty decoded
text. Characters in no piece fall back to byte pieces. Repeated rows and null
doc_ids give a row each; an empty table gives no rows. Only doc_id and text
are read. Texts of any length are encoded whole; a slice of ``SLICE_BYTES`` or
one longer text is held at a time. A model that isn't a merge model of this
form (another normaliser, no space put first, user-defined pieces) is refused.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import set_apart, text_slices

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MARK = "▁"
#: Bytes from which a segment is encoded by itself.
LONG = 1 << 10


def read_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """(text, score, type) of each piece of a serialised model: field 1 of the message, its fields 1 to 3.

    ValueError if the trainer's part (2) names another kind of model than merges (its field 3), or the normaliser's (3)
    has rules (2), puts no space first (3), or takes spaces away (4).
    """

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    def fields(at: int, end: int):
        while at < end:
            key, at = varint(at)
            kind = key & 7
            if kind == 0:
                value, at = varint(at)
            elif kind == 5:
                value, at = struct.unpack_from("<f", data, at)[0], at + 4
            elif kind == 1:
                value, at = None, at + 8
            else:
                n, at = varint(at)
                value, at = (at, at + n), at + n
            yield key >> 3, value

    pieces, trainer, normaliser = [], {}, {}
    for number, span in fields(0, len(data)):
        if number == 1:
            f = dict(fields(*span))
            pieces.append((data[f[1][0] : f[1][1]].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(*span))
        elif number == 3:
            normaliser = dict(fields(*span))
    rules = normaliser.get(2, (0, 0))
    if trainer.get(3, 1) != 2 or rules[1] > rules[0] or not normaliser.get(3, 1) or normaliser.get(4, 1):
        raise ValueError("only merge models that leave texts as they are and put a space first are read")
    if odd := {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"pieces of the kinds {sorted(odd)}")
    return pieces


def merge_naively(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Symbols after all merges, best rank first and leftmost among equals, and the last pair merged."""
    last = None
    while len(symbols) > 1:
        best = min(((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))))
        if best[0] == 1 << 60:
            break
        i = best[1]
        last = (symbols[i], symbols[i + 1])
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
    return symbols, last


class PairTable:
    """Numbers for pairs of numbers below 2^31, by open addressing."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(a) * 3).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, -1, dtype=np.int64)
        self.value = np.full(size, -1, dtype=np.int32)
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        slot, todo = self.slot(key), np.arange(len(key))
        while len(todo):
            free = self.key[slot[todo]] < 0
            self.key[slot[todo[free]]] = key[todo[free]]  # of those that want one slot, the last stays
            lost = self.key[slot[todo]] != key[todo]
            won = todo[~lost]
            self.value[slot[won]] = value[won]
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Values, or -1."""
        key = (a.astype(np.int64) << 32) | b
        slot = self.slot(key)
        out = np.full(len(key), -1, dtype=np.int32)
        todo = np.arange(len(key))
        while len(todo):
            at = self.key[slot[todo]]
            hit = at == key[todo]
            out[todo[hit]] = self.value[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
        return out


class PieceCodec:
    """Tables of one model. Tokens are its normal pieces; four more stand for characters in no piece, by length in bytes."""

    def __init__(self, data: bytes):
        pieces = read_pieces(data)
        self.size = len(pieces)
        self.end = next(i for i, p in enumerate(pieces) if p[2] == CONTROL and p[0] == "</s>")
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.shown: list[bytes] = []
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(text[1:-1], 16)] = i
            self.shown.append(bytes([int(text[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else text.replace(MARK, " ").encode())
        normal = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        order = sorted(normal, key=lambda t: (-pieces[normal[t]][1], normal[t]))
        rank = {text: r for r, text in enumerate(order)}
        self.known = {c for text in normal for c in text}
        if loose := [c for c in self.known if c not in normal]:
            raise ValueError(f"characters that occur only within longer pieces: {loose[:5]}")
        # a piece is a token if merging its own characters gives it
        n = self.size
        self.rank = np.full(n + 5, -1, dtype=np.int64)
        self.left = np.full(n + 5, -1, dtype=np.int64)
        self.right = np.full(n + 5, -1, dtype=np.int64)
        self.length = np.zeros(n + 5, dtype=np.int64)
        tokens = {}
        for text in sorted(normal, key=len):
            i = normal[text]
            if len(text) > 1:
                got, last = merge_naively(list(text), rank)
                if len(got) > 1:
                    continue
                self.left[i], self.right[i], self.rank[i] = normal[last[0]], normal[last[1]], rank[text]
            tokens[text.replace(MARK, " ").encode()] = i
            self.length[i] = len(text.replace(MARK, " ").encode())
        self.length[n + 1 : n + 5] = (1, 2, 3, 4)
        pairs = [(normal[t[:k]], normal[t[k:]], rank[t]) for t in normal for k in range(1, len(t)) if t[:k] in normal and t[k:] in normal]
        self.pairs = PairTable(*(np.array(x, dtype=np.int64) for x in zip(*pairs)))
        # the next shorter token with which a token begins
        self.shorter = np.full(n + 5, -1, dtype=np.int64)
        for text, i in tokens.items():
            self.shorter[i] = next((tokens[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in tokens), -1)
        self._automaton(tokens)
        self.tokens = {t.decode(): i for t, i in tokens.items()}
        # last byte of a character and first byte of the next one, as some token has them
        self.meets = np.zeros((256, 256), dtype=bool)
        for text in self.tokens:
            for a, b in zip(text, text[1:]):
                self.meets[a.encode()[-1], b.encode()[0]] = True
        self._seams: dict[tuple[int, int], bool] = {}

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """goto[state, class of byte] over the reversed tokens, and for each state the longest token that it ends on."""
        used = sorted({b for t in tokens for b in t})
        self.byte_class = np.full(256, len(used), dtype=np.int64)
        self.byte_class[used] = np.arange(len(used))
        children: list[dict[int, int]] = [{}]
        longest = [-1]
        for text, i in tokens.items():
            s = 0
            for b in self.byte_class[list(reversed(text))].tolist():
                if b not in children[s]:
                    children[s][b] = len(children)
                    children.append({})
                    longest.append(-1)
                s = children[s][b]
            longest[s] = i
        goto = np.zeros((len(children), len(used) + 1), dtype=np.int32)
        self.longest = np.array(longest, dtype=np.int32)
        level = []
        for b, s in children[0].items():
            goto[0, b] = s
            level.append((s, 0))
        while level:  # in order of depth: a state's failure state is done before it
            below = []
            for s, fail in level:
                row = goto[fail].copy()
                if self.longest[s] < 0:
                    self.longest[s] = self.longest[fail]
                for b, child in children[s].items():
                    below.append((child, int(row[b])))
                    row[b] = child
                goto[s] = row
            level = below
        self.goto = goto

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding text(a) + text(b) gives the tokens a and b."""
        out = np.ones(len(a), dtype=bool)
        todo = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)  # merges across the seam of a lower rank come first
        while len(todo):
            across = self.pairs.get(a, b)
            wrong = (across >= 0) & (across < limit)
            out[todo[wrong]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~wrong & ((ra >= 0) | (rb >= 0))
            todo, a, b, ra, rb = todo[on], a[on], b[on], ra[on], rb[on]
            undo_a = ra > rb  # the later merge is undone first; of equal ones the right one, which came second
            # an equal rank within a lies left of the seam and goes first, within b it goes after
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def longest_from(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each byte of the segments the longest token that starts there; characters in no piece by their length."""
        out = np.full(len(buf), -1, dtype=np.int32)
        cls = self.byte_class[buf]
        for a, b in zip(start[end - start > LONG].tolist(), end[end - start > LONG].tolist()):
            state, step, found = 0, self.goto.item, []
            for c in reversed(cls[a:b].tolist()):
                state = step(state, c)
                found.append(state)
            out[a:b] = self.longest[np.array(found[::-1])]
        short = end - start <= LONG
        start, end = start[short], end[short]
        by_size = np.argsort(start - end, kind="stable")  # longest first: those still open are a prefix
        start, at = start[by_size], end[by_size] - 1
        state = np.zeros(len(at), dtype=np.int32)
        open_ = len(at)
        while open_:
            state[:open_] = self.goto[state[:open_], cls[at[:open_]]]
            out[at[:open_]] = self.longest[state[:open_]]
            at[:open_] -= 1
            open_ = int(np.searchsorted(-(at[:open_] - start[:open_] + 1), 0, side="left"))
        lost = np.flatnonzero((out < 0) & ((buf & 0xC0) != 0x80))
        lead = buf[lost]
        out[lost] = self.size + 1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
        return out

    def seam(self, a: int, b: int) -> bool:
        """compatible() for one pair, kept."""
        got = self._seams.get((a, b))
        if got is None:
            if len(self._seams) > 1 << 20:
                self._seams.clear()
            got = self._seams[a, b] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return got

    def encode_long(self, best: np.ndarray, came: np.ndarray, begin: int, end: int) -> None:
        """Fill came[begin + 1 : end + 1] for one long segment: the steps of encode_segments, one place at a time."""
        longest, length, shorter = best[begin:end].tolist(), self.length.tolist(), self.shorter.tolist()
        path, failed = [-1] * (end - begin + 1), bytearray(end - begin + 1)
        pos, token = 0, longest[0]
        while pos < end - begin:
            nxt = pos + length[token]
            if not failed[nxt] and (not pos or self.seam(path[pos], token)):
                path[nxt], pos = token, nxt
                token = longest[min(pos, end - begin - 1)]
                continue
            token = shorter[token]
            if token < 0:
                failed[pos] = 1
                token = path[pos]
                pos -= length[token]
        came[begin + 1 : end + 1] = path[1:]

    def encode_segments(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the segments that lie one after another in buf, and their bounds."""
        start, end = off[:-1], off[1:]
        best = self.longest_from(buf, start, end)
        failed = np.zeros(len(buf) + 1, dtype=bool)  # the bitfield
        # each place holds the token that ends there on the path so far
        came = np.full(len(buf) + 1, -1, dtype=np.int32)
        some = np.flatnonzero(end > start)
        seg = some[end[some] - start[some] <= LONG]
        pos = start[seg].copy()
        token = best[pos].astype(np.int64)
        while len(pos):
            nxt = pos + self.length[token]
            first = pos == start[seg]
            ok = ~failed[nxt]
            check = np.flatnonzero(ok & ~first)
            ok[check] = self.compatible(came[pos[check]].astype(np.int64), token[check])
            go = np.flatnonzero(ok)
            came[nxt[go]] = token[go]
            pos[go] = nxt[go]
            token[go] = best[np.minimum(nxt[go], len(buf) - 1)]
            back = np.flatnonzero(~ok)
            short = self.shorter[token[back]]
            token[back] = short
            none = back[short < 0]
            if len(none):
                failed[pos[none]] = True
                token[none] = came[pos[none]]
                pos[none] -= self.length[token[none]]
            live = pos < end[seg]
            pos, seg, token = pos[live], seg[live], token[live]
        # walk back from each end
        tokens = np.full(len(buf), -1, dtype=np.int32)
        at, begin = end[some], start[some]
        long = at - begin > LONG
        for a, b in zip(begin[long].tolist(), at[long].tolist()):
            self.encode_long(best, came, a, b)
            length, path = self.length.tolist(), came[a : b + 1].tolist()
            at_end, places, found = b, [], []
            while at_end > a:
                found.append(path[at_end - a])
                at_end -= length[found[-1]]
                places.append(at_end)
            tokens[places] = found
        at, begin = at[~long], begin[~long]
        while len(at):
            t = came[at]
            at = at - self.length[t]
            tokens[at] = t
            live = at > begin
            at, begin = at[live], begin[live]
        places = np.flatnonzero(tokens >= 0)
        return self._with_bytes(buf, places, tokens[places], off)

    def _with_bytes(self, buf, places, tokens, off) -> tuple[np.ndarray, np.ndarray]:
        many = np.where(tokens > self.size, tokens - self.size, 1)
        at = np.repeat(places, many) + np.arange(many.sum()) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
        ids = np.repeat(tokens, many)
        loose = ids > self.size
        ids[loose] = self.byte_id[buf[at[loose]]]
        return ids, np.searchsorted(at, off)

    def cut(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Offsets of segments: at text bounds, and between characters that no token has next to each other."""
        here = np.zeros(len(buf) + 1, dtype=bool)
        here[1:-1] = ~self.meets[buf[:-1], buf[1:]] & ((buf[1:] & 0xC0) != 0x80)
        here[bounds] = True
        return np.flatnonzero(here)

    def marked(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with the space that the encoder puts before each that isn't empty, and their bounds."""
        raw = buf.tobytes()
        if MARK.encode() in raw:  # it means the same as a space
            parts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(off[:-1], off[1:])]
            buf, off = np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        full = np.flatnonzero(np.diff(off))
        apart, marks = set_apart(buf[::-1], (off[-1] - off[::-1]), 32)
        apart = apart[::-1]
        begin = len(apart) - 1 - marks[::-1]
        keep = np.ones(len(apart), dtype=bool)
        keep[np.delete(begin, full)] = False  # not before an empty one
        return np.ascontiguousarray(apart[keep]), off + np.concatenate(([0], np.cumsum(np.diff(off) > 0)))

    def segments(self, apart: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where texts are cut, the number of each segment, and the distinct segments: bytes and offsets."""
        cuts = self.cut(apart, bounds)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(apart)])
        coded = parts.dictionary_encode()
        distinct = coded.dictionary
        off = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[: len(distinct) + 1]
        return cuts, coded.indices.to_numpy(zero_copy_only=False), np.frombuffer(distinct.buffers()[2], dtype=np.uint8)[: off[-1]], off

    def encode_texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another without end ids, and their bounds."""
        apart, bounds = self.marked(buf, off)
        if not len(apart):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        cuts, code, d_buf, d_off = self.segments(apart, bounds)
        ids, at = self.encode_segments(d_buf, d_off)
        n = np.diff(at)[code]
        total = np.concatenate(([0], np.cumsum(n)))
        flat = ids[np.repeat(at[:-1][code] - total[:-1], n) + np.arange(total[-1])]
        return flat, total[np.searchsorted(cuts, bounds)]

    @property
    def shown_array(self) -> pa.Array:
        return pa.array(self.shown, pa.large_binary())

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts of runs of ids: the pieces' texts without the space that the encoder put first."""
        flat = self._shown.take(pa.array(ids))
        off = np.frombuffer(flat.buffers()[1], dtype=np.int64)[: len(ids) + 1]
        body = flat.buffers()[2].to_pybytes() if len(ids) and flat.buffers()[2] else b""
        at = off[bounds].tolist()
        out = [body[a:b] for a, b in zip(at, at[1:])]
        return [t[1:] if t[:1] == b" " else t for t in out]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    with open(path, "rb") as f:
        c = PieceCodec(f.read())
    c._shown = c.shown_array
    c._numbers = pa.array([f" {i}" for i in range(c.size)], pa.large_string()).cast(pa.large_binary())
    return c


def roundtrip(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids of every text with the end id, and the text decoded from them, as digests."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for ids, buf, off in text_slices(batches):
            flat, bounds = c.encode_texts(buf, off)
            shown = c._numbers.take(pa.array(flat))
            n_off = np.frombuffer(shown.buffers()[1], dtype=np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
            body = memoryview(shown.buffers()[2]) if len(flat) else memoryview(b"")
            at, tail = n_off[bounds].tolist(), f" {c.end}".encode()
            listed = [hashlib.sha256((bytes(body[a:b]) + tail)[1:]).hexdigest() for a, b in zip(at, at[1:])]
            texts = [hashlib.sha256(t).hexdigest() for t in c.decode(flat, bounds)]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(np.diff(bounds) + 1), pa.array(listed, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
