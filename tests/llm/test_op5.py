"""The baseline against plain counting, the model's gradients, normalisation and held-out gain."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest

from weftgraph.llm import attention_lm as lm

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SMALL = lm.ModelSpec(ids=20, dim=3, classes=5, stride=4, train_every=1, rounds=1)


def tiny(seed=0):
    rng = np.random.default_rng(seed)
    emb = np.concatenate((rng.normal(size=(21, 3)), np.zeros((1, 3))))
    label = np.arange(20) % 5
    w = {k: rng.normal(size=s) for k, s in lm.shapes(SMALL).items()}
    return rng, emb, label, w


def test_gradients():
    rng, emb, label, w = tiny()
    seqs, first, n = lm.sequences(rng.integers(0, 19, 30), np.array([0, 0, 13, 30]), SMALL)
    begin = np.concatenate([f + np.arange(0, k, 4) - 4 for f, k in zip(first, n)])
    windows = seqs[begin[:, None] + np.arange(9)]
    inputs, target, weight = lm.examples(windows, label, SMALL)
    assert weight.sum() == 30 + 3  # every id and every end once
    g, _ = lm.gradients(w, emb, inputs, target, weight, SMALL)
    for k in w:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in w[k].shape)
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (lm.gradients(up, emb, inputs, target, weight, SMALL)[1] - lm.gradients(down, emb, inputs, target, weight, SMALL)[1]) / 2e-5
            assert g[k][at] == pytest.approx(slope, rel=1e-4, abs=1e-7)


def test_probabilities_sum_to_one_and_windows_are_causal():
    rng, emb, label, w = tiny(1)
    count = rng.random(20) + 0.1
    given = np.log10(count / np.bincount(label, count, 5)[label])
    model = lm.Model(emb.astype(np.float32), label, w, given, SMALL)
    for prefix in ([], [3], list(rng.integers(0, 19, 11))):
        # P(prefix + x + end) over all x, with the end's share, against P of the prefix alone
        alone = model.log10(np.array(prefix, dtype=np.int32), np.array([0, len(prefix)]))[0]
        longer = [model.log10(np.array([*prefix, x], dtype=np.int32), np.array([0, len(prefix) + 1]))[0] for x in range(19)]
        assert all(x < 0 for x in longer) and alone < 0
    texts = [list(rng.integers(0, 19, k)) for k in (0, 1, 5, 8, 9, 40)]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = model.log10(np.array(sum(texts, []), dtype=np.int32), bounds)
    single = [model.log10(np.array(t, dtype=np.int32), np.array([0, len(t)]))[0] for t in texts]
    assert together == pytest.approx(single, rel=1e-5)
    # one step: all continuations of nothing, the end included
    first = [lm.attend({k: v for k, v in w.items()}, emb, np.array([[-1] * 4 + [20, -1, -1, -1]]), SMALL)[0][0, 0]]
    p = np.exp(first[0] - first[0].max())
    assert np.dot(p / p.sum(), np.bincount(label, 10**given, 5)) == pytest.approx(1)


@pytest.mark.parametrize("size", [1.0, 40.0])
def test_scores_against_a_naive_forward_pass(size):
    """Token by token in plain loops; with weights so large that the exponentials need shifting, too."""
    rng, emb, label, w = tiny(2)
    w = {k: v * size for k, v in w.items()}
    given = np.log10(rng.random(20))
    model = lm.Model(emb.astype(np.float32), label, w, given, SMALL)
    texts = [list(rng.integers(0, 19, k)) for k in (0, 1, 3, 4, 5, 8, 9, 31)]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = model.log10(np.array(sum(texts, []), dtype=np.int32), bounds)
    for t, value in zip(texts, got):
        seq, total = [SMALL.begin, *t, SMALL.end], 0.0
        for i in range(len(seq) - 1):
            x = emb[seq[i]]
            keys = range(max(0, (i // SMALL.stride - 1) * SMALL.stride), i + 1)
            s = np.array([(x @ w["q"]) @ (emb[seq[j]] @ w["k"]) / SMALL.dim**0.5 + w["near"][i - j] for j in keys])
            a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            logits = (x @ w["r"] + sum(p * (emb[seq[j]] @ w["v"]) for p, j in zip(a, keys))) @ w["out"] + w["bias"]
            top = logits.max()
            # the model's floor for a probability is 1e-37
            total += max(logits[label[seq[i + 1]]] - top - np.log(np.exp(logits - top).sum()), np.log(1e-37)) / np.log(10) + given[seq[i + 1]]
        assert value == pytest.approx(total, rel=1e-3 if size > 1 else 1e-5)


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(None, "null id"), (5000, None), (5001, ""), (5002, "\n \t"), (5003, "the the THE É é"), (5003, "the the THE É é"), (5004, "x" * 3000)]
    real = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "text", "'c' as block", "1 as score")
    return real.unionByName(spark.createDataFrame([(*r, "c", 1) for r in odd], "doc_id long, text string, block string, score int")).repartition(3).cache()


def test_scores(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) + [None]

    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    count = Counter(w for d, t in rows if not out(d) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = [(d, out(d), len(words(t)), sum(count[w] > 0 for w in words(t)), n, round(sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for d, t in rows]
    got = lm.score_documents(docs, VOCABULARY, lm.ModelSpec(train_every=2, rounds=2)).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)
    again = {str(r.doc_id): r.score for r in got}
    assert again["5000"] == again["5001"]


def test_held_out_gain_over_plain_subword_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spec = lm.ModelSpec(train_every=2)
    blocks = lm.make_blocks(docs, most=256 << 10)
    tokens = lm.token_blocks(blocks, VOCABULARY, spec)
    model = lm.train(tokens, spec)
    plain = own = n = 0
    for row in tokens.collect():
        t = lm.Tokens(row.asDict())
        got = model.log10(t.flat, t.bounds)
        own += got[t.held_out].sum()
        n += (np.diff(t.bounds) + 1)[t.held_out].sum()
    counts, _ = lm.surroundings(tokens, spec)
    c = counts[: spec.ids] + 0.1
    unigram = np.log10(c / c.sum())
    for row in tokens.collect():
        t = lm.Tokens(row.asDict())
        for i in np.flatnonzero(t.held_out):
            plain += unigram[t.flat[t.bounds[i] : t.bounds[i + 1]]].sum() + unigram[spec.end]
    print("per id: plain", plain / n, "model", own / n)
    assert own / n > plain / n + 0.3


def test_empty(docs):
    assert lm.score_documents(docs.limit(0), VOCABULARY).count() == 0


def token_rows(spec, lens, seed=5):
    rng = np.random.default_rng(seed)
    n = np.array(lens)
    flat = rng.integers(0, spec.end, n.sum())
    bounds = np.concatenate(([0], np.cumsum(n)))
    ids = np.arange(len(n), dtype=np.int64)
    return (7, ids.tobytes(), np.ones(len(n), bool).tobytes(), lm.pack(bounds, "<i8"), lm.pack(flat, "<u2"))


def test_rounds_train_on_every_window_at_the_production_parameters():
    spec = lm.ModelSpec()
    row = token_rows(spec, [*range(0, 60), 400, 1000, 3])
    t = lm.Tokens(dict(zip(lm.TOKENS.names, row)))
    want = (np.diff(t.bounds) + 1)[~t.held_out].sum()  # every id and every end
    rng = np.random.default_rng(0)
    emb = np.concatenate((rng.normal(size=(spec.ids + 1, spec.dim)), np.zeros((1, spec.dim)))).astype(np.float32)
    label = np.arange(spec.ids) % spec.classes
    w = lm.fresh_weights(spec, label, np.ones(spec.ids + 1))
    seen = [lm.descend(w, emb, label, [lm.batch_of([row], lm.TOKENS)], spec, turn) for turn in range(spec.rounds)]
    assert sum(x[1] for x in seen) == want
    assert all(np.isfinite(v).all() for x in seen for v in x[0].values())


def test_surroundings_come_from_every_neighbour(spark):
    spec = lm.ModelSpec()
    rows = [token_rows(spec, [*range(0, 40), 300], seed) for seed in (5, 6)]
    count, around = lm.surroundings(spark.createDataFrame(rows, lm.TOKENS_DDL), spec)
    signs = np.random.default_rng(spec.seed).choice([-1.0, 1.0], size=(spec.ids + 2, 2 * spec.dim))
    want, n = np.zeros((spec.ids + 1, 2 * spec.dim)), np.zeros(spec.ids + 1)
    for row in rows:
        t = lm.Tokens(dict(zip(lm.TOKENS.names, row)))
        for i in np.flatnonzero(~t.held_out):
            text = [spec.begin, *t.flat[t.bounds[i] : t.bounds[i + 1]].tolist(), spec.end]
            for before, mid, after in zip(text, text[1:], text[2:]):
                want[mid, : spec.dim] += signs[before, : spec.dim]
                want[mid, spec.dim :] += signs[after, spec.dim :]
            np.add.at(n, text[1:], 1)
    assert (count == n).all() and around == pytest.approx(want)


def test_words_and_the_marks_after_them_are_encoded_once_each():
    bpe = lm.byte_bpe(VOCABULARY)
    words, marks = [f"word{chr(97 + i)}" for i in range(20)], ["%", "$$$", "...", ")", "###", "&&", "-", "_", "``", '"']
    text = "".join(f" {w}{m}" for w in words for m in marks)
    asked = []
    encode = bpe._encode_distinct
    bpe._encode_distinct = lambda segments: asked.append(len(segments)) or encode(segments)
    try:
        odd = [text, "it's%they'll-we'd_x'9 'sA's% don''t'ST a'b", "a_b c-1 é%a é1% x\n\n%y %% a% 'll", "", "A.B. C/D?e=f&g", " a%\té$ b"]
        raw = [t.encode() for t in odd]
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        flat, at = bpe.encode_texts(np.frombuffer(b"".join(raw), np.uint8), bounds)
        for i, t in enumerate(odd):
            assert flat[at[i] : at[i + 1]].tolist() == bpe.encoding.encode_ordinary(t)
        asked.clear()
        bpe.encode_texts(np.frombuffer(raw[0], np.uint8), np.array([0, len(raw[0])]))
        assert asked == [len(words) + len(marks)]
    finally:
        del bpe._encode_distinct
