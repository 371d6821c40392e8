"""Byte-level BPE ids of whole texts, with equal segments encoded once a slice."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

from weftgraph.llm.common import IS_SPACE

#: The pre-tokeniser's pattern of byte-level BPE vocabularies of this kind (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Between an ASCII letter and one of these ASCII characters a pre-token always ends (an apostrophe may begin one with letters).
IS_LETTER, IS_MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
IS_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in such vocabularies: printable Latin-1 for itself, others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, vocabulary: dict[str, int]):
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocabulary.items() if all(c in symbols for c in t) and not t.startswith("<|")}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for t, i in ranks.items():
            self.length[i] = len(t)
        # after these bytes a pre-token ends if white space follows: printable ASCII, and the last byte of U+00C0 to U+07FF
        self.solid = np.zeros(256, dtype=bool)
        self.solid[0x21:0x7F] = True

    def closes(self, buf: np.ndarray) -> np.ndarray:
        """For each byte whether a character that surely isn't white space ends with it."""
        out = self.solid[buf]
        out[1:] |= (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[:-1] >= 0xC3) & (buf[:-1] < 0xE0)
        return out

    def encode_texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts one after another, and their bounds."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        closes, space = self.closes(buf), IS_SPACE[buf]
        here = np.zeros(len(buf) + 1, dtype=bool)
        here[1:-1] = closes[:-1] & space[1:]
        here[1:-1] |= IS_LETTER[buf[:-1]] & IS_MARK[buf[1:]]  # words and the marks after them are few, both together many
        here[off] = True
        cuts = np.flatnonzero(here)
        segments = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = segments.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        ids, at = self._encode_distinct(coded.dictionary)
        n = np.diff(at)[code]
        total = np.concatenate(([0], np.cumsum(n)))
        flat = ids[np.repeat(at[:-1][code] - total[:-1], n) + np.arange(total[-1])]
        return flat, total[np.searchsorted(cuts, off)]

    def _encode_distinct(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Segments that begin with white space and end solidly are encoded in one go, one after another; the rest one by one."""
        off = np.frombuffer(segments.buffers()[1], dtype=np.int64)[: len(segments) + 1]
        buf = np.frombuffer(segments.buffers()[2], dtype=np.uint8)[: off[-1]]
        joined = IS_SPACE[buf[off[:-1]]] & self.closes(buf)[off[1:] - 1]
        encode = self.encoding.encode_ordinary
        raw = buf.tobytes()
        size = np.diff(off)
        alone = np.flatnonzero(~joined)
        single = [encode(raw[a:b].decode()) for a, b in zip(off[alone].tolist(), off[alone + 1].tolist())]
        take = np.repeat(joined, size)
        run = np.array(encode(buf[take].tobytes().decode()), dtype=np.uint32)
        ends = np.cumsum(self.length[run])  # bytes of the run after each id
        count = np.zeros(len(segments), dtype=np.int64)
        count[joined] = np.diff(np.concatenate(([0], np.searchsorted(ends, np.cumsum(size[joined])) + 1))) if joined.any() else 0
        count[alone] = [len(s) for s in single]
        at = np.concatenate(([0], np.cumsum(count)))
        ids = np.empty(at[-1], dtype=np.uint32)
        of_run = np.repeat(joined, count)
        ids[of_run] = run
        ids[~of_run] = np.array([i for s in single for i in s], dtype=np.uint32)
        return ids, at


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    with open(path, encoding="utf-8") as f:
        return ByteBpe(json.load(f)["model"]["vocab"])
