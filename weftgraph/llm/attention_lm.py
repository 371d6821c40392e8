"""Language model scoring: a unigram baseline and a causal self-attention model on subword ids.

Baseline. Documents lie in blocks; each block sends its distinct words with
their counts in training documents to the words' buckets, buckets add them up
and answer, so a word in every document is one row a block.

Model. Texts are byte-level BPE ids. Ids are embedded by what surrounds them in
training text and clustered into classes; one head of causal self-attention
over the embeddings predicts the class of the next id, and the id follows its
class by smoothed counts of all training text. So P(id | before) =
P(class | before) P(id | class), which sums to one over all ids, and a text's
probability includes its end. The attention is trained in numpy: every part of
the table takes gradient steps on its own windows, and the parts' weights are
averaged, round by round. All windows of all training documents are trained on:
they are dealt to ``train_every`` parts, from a place that depends on the
document, and the parts to the rounds, so each window has its turn once (where
there are fewer parts than rounds, more often). Embeddings and classes come from
all neighbours in training text.

Scoring. Windows of 2 * ``stride`` ids overlap by half and score the ids after
their later half, each id once, in masked batches.

Defined cases: null and empty texts are scored by their end alone. A row with a
null doc_id is a training document. Repeated rows count and are scored each. If
no document is for training, all counts are zero and the model is uniform over
its ids. An empty table gives no rows. Only doc_id and text are read. Very long
texts are learned from and scored whole, in windows; a block holds one at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import prod

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.blocks import Block, each_block, make_blocks
from weftgraph.llm.byte_bpe import byte_bpe
from weftgraph.llm.common import LOWER, Words, discard, give_back, materialize, mix, partitions
from weftgraph.llm.repeats import batch_of, bucket_of, by_bucket


@dataclass(frozen=True)
class ModelSpec:
    ids: int = 50_257  # of the vocabulary; the last stands for the end of a text
    dim: int = 8
    classes: int = 48
    stride: int = 8
    train_every: int = 16
    rounds: int = 3
    rate: float = 0.02
    batch: int = 256
    seed: int = 11

    @property
    def end(self) -> int:
        return self.ids - 1

    @property
    def begin(self) -> int:
        return self.ids


def held_out(block: Block) -> np.ndarray:
    return np.array([bool(k) and zlib.crc32(str(i).encode()) % 5 == 1 for i, k in zip(block.ids.tolist(), block.known.tolist())], dtype=bool)


def pack(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


# --- tokens -----------------------------------------------------------------------------------------------


def sequences(flat: np.ndarray, bounds: np.ndarray, spec: ModelSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents in one row of places: each begins with ``begin`` at a multiple of the stride, after a stride of
    padding (-1), and ends with ``end``. (places, first place of each document, its ids with the end)."""
    n = np.diff(bounds) + 1
    room = spec.stride * (1 + -(-(n + 1) // spec.stride))
    first = np.cumsum(room) - room + spec.stride
    out = np.full(int(room.sum()) + spec.stride, -1, dtype=np.int32)
    out[first] = spec.begin
    at = np.repeat(first + 1 - bounds[:-1], n - 1) + np.arange(len(flat))
    out[at] = flat
    out[first + n] = spec.end
    return out, first, n


def encode_in_slices(bpe, block: Block, most: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's lower-cased texts, four megabytes at a time."""
    flats, bounds, i = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    while i < len(block.off) - 1:
        j = max(i + 1, int(np.searchsorted(block.off, block.off[i] + most, side="right")) - 1)
        a, b = block.off[i], block.off[j]
        flat, at = bpe.encode_texts(LOWER[block.buf[a:b]], block.off[i : j + 1] - a)
        bounds.append(at[1:] + bounds[-1][-1])
        flats.append(flat)
        i = j
    return np.concatenate(flats), np.concatenate(bounds)


def token_blocks(blocks: DataFrame, vocabulary: str, spec: ModelSpec) -> DataFrame:
    """(block, ids, known, bounds, flat): each block's subword ids, written."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for block, row in each_block(batches):
            flat, bounds = encode_in_slices(bpe, block)
            cells = [(row["block"], row["ids"], row["known"], pack(bounds, "<i8"), pack(flat, "<u2"))]
            yield batch_of(cells, TOKENS)

    return materialize(blocks.select("block", "ids", "known", "lens", "body").mapInArrow(run, TOKENS_DDL), "lm-tokens")


TOKENS = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "bounds", "flat"))])
TOKENS_DDL = "block long, ids binary, known binary, bounds binary, flat binary"


class Tokens:
    def __init__(self, row: dict):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.bounds, self.flat = unpack(row["bounds"], "<i8"), unpack(row["flat"], "<u2").astype(np.int32)
        self.held_out = held_out(self)


def each_tokens(batches) -> Iterator[tuple[Tokens, dict]]:
    for b in batches:
        for i in range(b.num_rows):
            row = {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}
            yield Tokens(row), row
            give_back()


def summed(tokens: DataFrame, width: int, make) -> np.ndarray:
    """The sum over all parts of make(rows of a part), a (k, width) table: by rows of a thousand numbers, so the driver gets k * width numbers."""
    size = 1000

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = make(batches)
        if total is not None:
            flat = np.ascontiguousarray(total, dtype=np.float64).ravel()
            at = range(0, len(flat), size)
            yield pa.RecordBatch.from_arrays([pa.array([k // size for k in at], pa.int32()), pa.array([flat[k : k + size].tobytes() for k in at], pa.binary())], names=["k", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in t.column("part").to_pylist())
        return pa.table({"k": t.column("k").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    rows = tokens.mapInArrow(run, "k int, part binary").groupBy("k").applyInArrow(add, "k int, part binary").collect()
    flat = np.concatenate([np.frombuffer(bytes(r["part"]), np.float64) for r in sorted(rows, key=lambda r: r["k"])]) if rows else np.zeros(0)
    return flat.reshape(-1, width)


def training_text(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of texts, bounds, document ids) of the training documents."""
    n = np.diff(t.bounds)
    return t.flat[np.repeat(~t.held_out, n)], np.concatenate(([0], np.cumsum(n[~t.held_out]))), t.ids[~t.held_out]


def training_windows(t: Tokens, spec: ModelSpec, turn: int = 0) -> np.ndarray | None:
    """Windows of 2 * stride + 1 places of the training documents, those of one round: all rounds together have every window."""
    flat, bounds, ids = training_text(t)
    places, first, n = sequences(flat, bounds, spec)
    many = -(-n // spec.stride)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    shift = (mix(ids.astype(np.uint64)) % np.uint64(spec.train_every)).astype(np.int64)
    rounds = min(spec.rounds, spec.train_every)
    take = (k + shift[doc]) % spec.train_every % rounds == turn % rounds
    begin = first[doc[take]] + k[take] * spec.stride - spec.stride
    return np.lib.stride_tricks.sliding_window_view(places, 2 * spec.stride + 1)[begin] if len(begin) else None


# --- embeddings and classes -----------------------------------------------------------------------------


#: Factor of the second of two sums in one double, and how many places are added up at once.
HIGH, PIECE = 2.0**26, 1 << 24


def surroundings(tokens: DataFrame, spec: ModelSpec) -> tuple[np.ndarray, np.ndarray]:
    """(counts of ids in all training text, sums of random signs of their neighbours in all training text)."""
    rng = np.random.default_rng(spec.seed)
    drawn = rng.choice([-1.0, 1.0], size=(spec.ids + 2, 2 * spec.dim)).T
    signs, high = np.ascontiguousarray(drawn[: spec.dim]), drawn[spec.dim :] * HIGH

    def make(batches):
        out = None
        for t, _ in each_tokens(batches):
            if out is None:
                out = np.zeros((spec.ids + 1, 1 + 2 * spec.dim))
            flat, bounds, ids = training_text(t)
            out[: spec.ids, 0] += np.bincount(flat, minlength=spec.ids)
            out[spec.end, 0] += len(ids)
            places, _, _ = sequences(flat, bounds, spec)
            mid, before, after = places[1:-1], places[:-2], places[2:]
            fine = (mid >= 0) & (before >= 0) & (after >= 0)
            mid, before, after = mid[fine], before[fine], after[fine]
            # a sign before and one after in each number, exactly: sums stay below 2^25 over pieces of a block
            for i in range(0, len(mid), PIECE):
                m, b, a = mid[i : i + PIECE], before[i : i + PIECE], after[i : i + PIECE]
                for j in range(spec.dim):
                    both = np.bincount(m, signs[j].take(b) + high[j].take(a), spec.ids + 1)
                    top = np.round(both / HIGH)
                    out[:, 1 + j] += both - top * HIGH
                    out[:, 1 + spec.dim + j] += top
        return out

    got = summed(tokens, 1 + 2 * spec.dim, make)
    if not len(got):
        got = np.zeros((spec.ids + 1, 1 + 2 * spec.dim))
    return got[:, 0], got[:, 1:]


def embed_and_cluster(count: np.ndarray, around: np.ndarray, spec: ModelSpec, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(embedding of each id and of begin, class of each id): directions of the surroundings, shrunk for rare ids, and k-means weighted by counts."""
    x = around / (count[:, None] / spec.train_every + 20.0)
    x = x - (x * count[:, None]).sum(axis=0) / max(count.sum(), 1)
    cov = (x * count[:, None]).T @ x / max(count.sum(), 1)
    value, vector = np.linalg.eigh(cov + 1e-9 * np.eye(len(cov)))
    z = x @ vector[:, ::-1] / np.sqrt(value[::-1])  # whitened, the strongest directions first
    z = np.clip(z, -4, 4)
    rng = np.random.default_rng(spec.seed)
    p = count[: spec.ids] + 1e-3
    centre = z[rng.choice(spec.ids, spec.classes, replace=False, p=p / p.sum())]
    for _ in range(rounds):
        label = ((centre**2).sum(axis=1)[None] - 2 * z[: spec.ids] @ centre.T).argmin(axis=1)
        weight = np.bincount(label, p, spec.classes)
        for j in range(z.shape[1]):
            total = np.bincount(label, p * z[: spec.ids, j], spec.classes)
            centre[:, j] = np.where(weight > 0, total / np.maximum(weight, 1e-12), centre[:, j])
    emb = np.concatenate((z[:, : spec.dim], np.zeros((1, spec.dim)))).astype(np.float32)  # the last row is for padding
    return emb, label.astype(np.int64)


# --- attention ------------------------------------------------------------------------------------------


SHAPES = {"q": ("dim", "dim"), "k": ("dim", "dim"), "v": ("dim", "dim"), "r": ("dim", "dim"), "out": ("dim", "classes"), "bias": ("classes",), "near": ("reach",)}


@lru_cache(maxsize=8)
def shapes(spec: ModelSpec) -> dict[str, tuple[int, ...]]:
    size = {"dim": spec.dim, "classes": spec.classes, "reach": 2 * spec.stride}
    return {k: tuple(size[x] for x in v) for k, v in SHAPES.items()}


def fresh_weights(spec: ModelSpec, label: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(spec.seed + 1)
    w = {k: rng.normal(size=s) * 0.3 if len(s) == 2 else np.zeros(s) for k, s in shapes(spec).items()}
    share = np.bincount(label, count[: spec.ids] + 0.1, spec.classes)
    w["bias"] = np.log(np.maximum(share, 1e-9) / share.sum())
    return w


@lru_cache(maxsize=8)
def seam(spec: ModelSpec) -> tuple[np.ndarray, np.ndarray]:
    """For queries in the later half of a window and keys in all of it: how far back, and which the query may see."""
    back = (np.arange(spec.stride)[:, None] + spec.stride) - np.arange(2 * spec.stride)[None]
    return np.clip(back, 0, 2 * spec.stride - 1), back >= 0


def times(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x @ m over the last axis, as one product of two matrices."""
    return (x.reshape(-1, x.shape[-1]) @ m).reshape(*x.shape[:-1], m.shape[1])


def softmax(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sums) over the last axis; rows are shifted by their maxima only where numbers are large or small."""
    ones = np.ones(s.shape[-1], dtype=s.dtype)
    rows = s.reshape(-1, s.shape[-1])
    with np.errstate(over="ignore"):
        held = np.exp(rows)
        total = held @ ones
    odd = np.flatnonzero(~((total > 1e-2) & (total < 1e17)))
    if len(odd):
        held[odd] = np.exp(rows[odd] - rows[odd].max(axis=1, keepdims=True))
        total[odd] = held[odd] @ ones
    return held.reshape(s.shape), total.reshape(s.shape[:-1])


def attend(w: dict, emb: np.ndarray, windows: np.ndarray, spec: ModelSpec):
    """Logits of the next id's class after each place in the later halves, and what the backward pass needs.

    Queries times keys is late (q k') x', and attention times values (a x) v: only products with the embeddings
    themselves are made window by window, the others are products of one row (late, a x, 1) a place.
    """
    back, seen = seam(spec)
    x = emb.take(windows, axis=0)  # padding is -1, the last row: zero
    turned = np.ascontiguousarray(x.transpose(0, 2, 1))  # products of views are several times slower
    row = np.empty((len(x), spec.stride, 2 * spec.dim + 1), dtype=np.result_type(x, w["r"]))
    late, mixed = row[:, :, : spec.dim], row[:, :, spec.dim : -1]
    late[...], row[:, :, -1] = x[:, spec.stride :], 1
    s = np.matmul(times(late, w["q"] @ w["k"].T * spec.dim**-0.5), turned)
    s += np.where(seen, w["near"][back], -1e9).astype(s.dtype)
    edge = np.flatnonzero((windows[:, 0] < 0) | (windows[:, -1] < 0))  # only a document's first and last windows are padded
    if len(edge):
        s[edge] += np.where(windows[edge] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
    a, total = softmax(s)
    a /= total[:, :, None]
    np.matmul(a, x, out=mixed)
    logits = times(row, np.concatenate((w["r"] @ w["out"], w["v"] @ w["out"], w["bias"][None])))
    return logits, (x, turned, late, a, row)


def pick(table: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Places in the flat table of the target in each of its rows."""
    return np.arange(target.size) * table.shape[-1] + target.ravel()


def log_share(p: np.ndarray, at: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Logarithms of the targets' shares of the sums, 1e-37 at least."""
    return np.log(np.maximum(p.ravel()[at].reshape(total.shape) / total, 1e-37))


def gradients(w: dict, emb: np.ndarray, windows: np.ndarray, target: np.ndarray, weight: np.ndarray, spec: ModelSpec) -> tuple[dict, float]:
    """Of the mean loss over the places with weight 1, and that loss."""
    back, seen = seam(spec)
    logits, (x, turned, late, a, row) = attend(w, emb, windows, spec)
    at = pick(logits, target)
    n = max(weight.sum(), 1)
    p, total = softmax(logits)
    loss = -(log_share(p, at, total) * weight).sum() / n
    # the loss by the logits is (p - total * target) * share: the share goes to the narrower factor
    p.ravel()[at] -= total.ravel()
    share = (weight / n / total)[:, :, None]
    flat = lambda y: y.reshape(-1, y.shape[-1])
    top = flat(row * share).T @ flat(p)
    late_top, mixed_top = top[: spec.dim], top[spec.dim : -1]
    g = {"r": late_top @ w["out"].T, "v": mixed_top @ w["out"].T, "out": w["r"].T @ late_top + w["v"].T @ mixed_top, "bias": top[-1]}
    ds = np.matmul(times(p, np.ascontiguousarray((w["v"] @ w["out"]).T)) * share, turned)
    ds *= a
    ds -= a * (flat(ds) @ np.ones(ds.shape[-1], dtype=ds.dtype)).reshape(share.shape)
    g["near"] = np.bincount(back[seen], ds.sum(axis=0)[seen], 2 * spec.stride)
    both = flat(late).T @ flat(np.matmul(ds, x)) * spec.dim**-0.5  # of q k'
    g["q"], g["k"] = both @ w["k"], both.T @ w["q"]
    return g, float(loss)


def examples(windows: np.ndarray, label: np.ndarray, spec: ModelSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, classes to predict, which places count): those before an id or an end, as padding follows each end and begin follows padding."""
    after = windows[:, spec.stride + 1 :]
    fine = (after >= 0) & (after < spec.ids)
    return windows[:, :-1], label.take(after * fine), fine.astype(np.float64)


def descend(w: dict, emb: np.ndarray, label: np.ndarray, batches, spec: ModelSpec, turn: int) -> tuple[dict, float] | None:
    """Adam steps over the windows of one part, and how many places they had."""
    flat = join_weights(w)  # one vector, so that a step is few operations
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    emb = emb.astype(np.float32)
    step, seen = 0, 0.0
    for t, _ in each_tokens(batches):
        windows = training_windows(t, spec, turn)
        if windows is None:
            continue
        windows = windows[np.random.default_rng(turn).permutation(len(windows))]
        for i in range(0, len(windows), spec.batch):
            inputs, target, weight = examples(windows[i : i + spec.batch], label, spec)
            g = join_weights(gradients(split_weights(flat.astype(np.float32), spec), emb, inputs, target, weight.astype(np.float32), spec)[0])
            step, seen = step + 1, seen + weight.sum()
            rate = spec.rate / (1 + turn) / (1 + step / 500)
            m = 0.9 * m + 0.1 * g
            s = 0.99 * s + 0.01 * g**2
            flat -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return (split_weights(flat, spec), seen) if seen else None


def join_weights(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def split_weights(flat: np.ndarray, spec: ModelSpec) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(spec).items():
        n = prod(s)
        out[k], at = flat[at : at + n].reshape(s), at + n
    return out


@dataclass
class Model:
    emb: np.ndarray
    label: np.ndarray
    weights: dict[str, np.ndarray]
    given_class: np.ndarray  # log10 P(id | class)
    spec: ModelSpec

    def log10(self, flat: np.ndarray, bounds: np.ndarray, batch: int = 512) -> np.ndarray:
        """log10 P of each text."""
        spec = self.spec
        places, first, n = sequences(flat, bounds, spec)
        many = -(-n // spec.stride)  # windows whose later halves hold begin and all ids
        doc = np.repeat(np.arange(len(n)), many)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = first[doc] + k * spec.stride - spec.stride
        w = {name: v.astype(np.float32) for name, v in self.weights.items()}
        out = np.zeros(len(n))
        every = np.lib.stride_tricks.sliding_window_view(places, 2 * spec.stride + 1)
        for i in range(0, len(begin), batch):
            windows = every[begin[i : i + batch]]
            inputs, target, fine = examples(windows, self.label, spec)
            logits, _ = attend(w, self.emb, inputs, spec)
            at = pick(logits, target)
            p, total = softmax(logits)
            picked = log_share(p, at, total)
            after = windows[:, spec.stride + 1 :] * (fine > 0)
            own = (picked / np.log(10) + self.given_class.take(after)) * fine
            out += np.bincount(doc[i : i + batch], own.sum(axis=1), len(n))
        return out


def train(tokens: DataFrame, spec: ModelSpec = ModelSpec()) -> Model:
    count, around = surroundings(tokens, spec)
    emb, label = embed_and_cluster(count, around, spec)
    weights = fresh_weights(spec, label, count)
    spark = tokens.sparkSession
    for turn in range(spec.rounds):
        shared = spark.sparkContext.broadcast((weights, emb, label))  # bounded by the vocabulary

        def part(batches, shared=shared, turn=turn):
            w, e, c = shared.value
            got = descend(w, e, c, batches, spec, turn)
            return None if got is None else np.concatenate((join_weights(got[0]) * got[1], [got[1]]))[None]

        total = summed(tokens, 1, part).ravel()
        if len(total):
            weights = split_weights(total[:-1] / total[-1], spec)
    c = count[: spec.ids] + 0.1
    given = np.log10(c / np.bincount(label, c, spec.classes)[label])
    return Model(emb, label, weights, given, spec)


# --- baseline -------------------------------------------------------------------------------------------


COUNTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("lens", pa.binary()), ("body", pa.binary()), ("n", pa.binary()), ("total", pa.int64())])
COUNTS_DDL = "bucket int, block long, lens binary, body binary, n binary, total long"


def block_words(block: Block) -> tuple[Words, np.ndarray, pa.Array]:
    w = Words(block.buf, block.off, lower=True)
    code, words = w.codes()
    return w, code, words


def word_keys(words: pa.Array) -> np.ndarray:
    """A hash of each word that depends on its bytes only: what bucket it belongs to."""
    off = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    body = np.frombuffer(words.buffers()[2], np.uint8)[: off[-1]]
    place = np.arange(len(body)) - np.repeat(off[:-1], np.diff(off))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(place.astype(np.uint64) * np.uint64(256) + body))))
    return total[off[1:]] - total[off[:-1]]


def count_words(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for block, _ in each_block(batches):
            w, code, words = block_words(block)
            train = ~held_out(block)
            n = np.bincount(code, train[w.doc], len(words)).astype(np.int64) if len(code) else np.zeros(0, np.int64)
            rows = []
            for k, at in by_bucket(bucket_of(word_keys(words), buckets)) if len(words) else ():
                own = words.take(pa.array(at))
                off = np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1]
                rows.append((k, block.block, pack(np.diff(off), "<u4"), packer.compress(own.buffers()[2].to_pybytes()[: off[-1]]), pack(n[at], "<u4"), 0))
            rows.append((0, block.block, pack(np.zeros(0), "<u4"), packer.compress(b""), pack(np.zeros(0), "<u4"), int(train.sum())))
            yield batch_of(rows, COUNTS)

    return blocks.select("block", "ids", "known", "lens", "body").mapInArrow(run, COUNTS_DDL)


def add_up(t: pa.Table) -> pa.Table:
    """For each block of a bucket the totals of its words in the order it sent them; the bucket's distinct words and tokens in the first row."""
    lens = [unpack(x, "<u4") for x in t.column("lens").to_pylist()]
    body = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in t.column("body").to_pylist())
    n = np.concatenate([unpack(x, "<u4") for x in t.column("n").to_pylist()]).astype(np.int64)
    off = np.concatenate(([0], np.cumsum(np.concatenate(lens), dtype=np.int64)))
    words = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(body)])
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    total = np.bincount(code, n).astype(np.int64) if len(code) else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum([len(x) for x in lens])))
    counts = [pack(total[code[a:b]], "<u8") for a, b in zip(at[:-1], at[1:])]
    rest = [0] * (t.num_rows - 1)
    return pa.table(
        {
            "block": t.column("block"), "bucket": t.column("bucket"), "counts": pa.array(counts, pa.binary()), "ends": t.column("total"),
            "distinct": pa.array([int((total > 0).sum()), *rest], pa.int64()), "tokens": pa.array([int(n.sum()), *rest], pa.int64()),
        }
    )


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, vocabulary: str, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    spark = docs.sparkSession
    blocks = make_blocks(docs)
    tokens = token_blocks(blocks, vocabulary, spec)
    model = train(tokens, spec)
    shared = spark.sparkContext.broadcast(model)

    def score(batches) -> Iterator[pa.RecordBatch]:
        for t, row in each_tokens(batches):
            got = shared.value.log10(t.flat, t.bounds)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([got.tobytes()], pa.binary())], names=["block", "scores"])

    scores = materialize(tokens.mapInArrow(score, "block long, scores binary"), "lm-scores")
    discard(tokens)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(2 * partitions(spark), -(-total // (64 << 20)))
    told = count_words(blocks, buckets).groupBy("bucket").applyInArrow(add_up, "block long, bucket int, counts binary, ends long, distinct long, tokens long")
    told = materialize(told, "lm-counts")
    sums = told.agg(F.sum("distinct"), F.sum("tokens"), F.sum("ends")).first()
    distinct, words, ends = (int(x or 0) for x in sums)
    n, v = words + ends, distinct + (ends > 0)
    answers = told.where("length(counts) > 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block, row in each_block(batches):
            w, code, names = block_words(block)
            count = np.zeros(len(names), dtype=np.int64)
            told = {}
            for x in row["answers"] or []:
                got = unpack(x["counts"], "<u8")
                if len(got):
                    told[x["bucket"]] = got
            for k, at in by_bucket(bucket_of(word_keys(names), buckets)) if len(names) else ():
                count[at] = told[k]
            below = np.log10(n + 0.5 * (v + 1))
            each = np.log10(count + 0.5) - below
            many = np.diff(w.first)
            base = np.bincount(w.doc, each[code], len(many)) if len(code) else np.zeros(len(many))
            known = np.bincount(w.doc, count[code] > 0, len(many)).astype(np.int64) if len(code) else np.zeros(len(many), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids, pa.int64(), mask=~block.known), pa.array(held_out(block)), pa.array(many + 1), pa.array(known + (ends > 0)),
                    pa.array(np.full(len(many), n)), pa.array(base + np.log10(ends + 0.5) - below), pa.array(np.frombuffer(row["scores"], np.float64)),
                ],
                schema=OUT,
            )

    joined = blocks.select("block", "ids", "known", "lens", "body").join(answers, "block", "left").join(scores, "block")
    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
