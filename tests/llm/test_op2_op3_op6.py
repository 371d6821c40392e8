"""Repetition rules, SimHash and the piece codec against plain Python."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import xxhash

from weftgraph.llm import piece_codec, quality_rules, simhash

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " \n\t ", "one", "two words", "a b c a b c a b c", "Same LINE\nSame LINE\n\nsame line\n  \n  \n", "x" * 5000,
    "é ñ   日本 🎉 # * $ | <>&%", "\x0b\x0c\r\n a\x1cb ", "word " * 400, "▁a ▁▁b\x00", "Same LINE\nSame LINE\n\nsame line\n  \n  \n",
    " ".join(f"w{i * i % 7919}" for i in range(450_000)),  # longer than a slice
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(ODD)] + [(5, "a b c", "c", 2), (5, "a b c", "c", 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, fp string, seg int")
    real = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "'x' as fp", "1 as seg")
    return odd.unionByName(real).cache()


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed)


def coverage(text, n):
    words = WORD.findall(text or "")
    seen, hit = set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            hit.update(range(i, i + n))
        seen.add(g)
    return sum(len(words[i]) for i in hit) / max(1, sum(map(len, words)))


def test_measures(docs):
    text = [(r.doc_id, r.text) for r in docs.collect()]
    got = quality_rules.repetition_rules(docs).collect()
    rules = quality_rules.RepetitionRules()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((d, *base(t), round(max(coverage(t, n) for n, _ in rules.gram_limits), 9)) for d, t in text), key=key)
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.dup_gram_fraction, 9)) for r in got), key=key)
    assert have == want
    assert all(not r.kept for r in got if r.base_failed)


def fingerprint(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for d, f in zip(ids, fps):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for f in fps]


@pytest.mark.parametrize("bits", [2, 6])
def test_simhash(docs, bits):
    rows = docs.collect()
    fps = [fingerprint(r.text, 3) for r in rows]
    comp = groups([r.doc_id for r in rows], fps, bits)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, comp)), key=key)
    have = sorted(map(tuple, simhash.simhash_groups(docs, 3, bits).collect()), key=key)
    assert have == want


@pytest.mark.parametrize("bits, segments", [(2, 2), (3, 3), (4, 2)])
def test_crowded_segments_lose_no_link(spark, bits, segments):
    import random

    rng = random.Random(5)
    # families that share a segment in full or up to a bit, and what differs by a few bits elsewhere
    fps = set()
    for base in (0, 0x123456789ABCDEF0, 1 << 63):
        for _ in range(120):
            f = base
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
            fps.add(base ^ (rng.randrange(1 << 31) << 32))
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= bits}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for hot in (4, 10_000):
        got = simhash.close_pairs(df, bits, segments, hot).select("fp", "other").distinct().collect()
        assert {tuple(r) for r in got} == want and len(want) > 200


def test_pieces_agree_with_the_library(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = []
    for r in docs.collect():
        ids = [*sp.encode(r.text or ""), 2]
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(sp.decode(ids))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, piece_codec.roundtrip(docs, path).collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert quality_rules.repetition_rules(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0
    assert piece_codec.roundtrip(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_probes_are_not_broadcast(spark):
    """33 probes a segment look as few as their fingerprints to Spark, which would send them all to the driver."""
    fps = spark.range(2000).selectExpr("xxhash64(id) as fp")
    pairs = simhash.close_pairs(fps)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
