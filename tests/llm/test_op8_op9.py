"""Packing and chat formatting against the library, plain Python and round trips."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import chat, packing

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    odd = [None, "", " \n\t ", "one", "it's  a\xa0 b\x1c c\x85 d", "<|endoftext|> x", "long word " * 3000, "日本 🎉é ñ\n\n", "one"]
    rows = [(None if i == 2 else i, t, 7) for i, t in enumerate(odd)]
    real = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "1 as length")
    return spark.createDataFrame(rows, "doc_id long, text string, length int").unionByName(real).cache()


def check_plan(count, groups=packing.LIMIT):
    runs = packing.plan(count, groups=groups)
    n = sum(runs[:, 4])
    assert n == sum(count.values())
    fill = np.zeros(runs[:, 2:].sum(axis=1).max() + 2, dtype=np.int64)
    spans = defaultdict(list)
    for length, first, seq, offset, many in runs.tolist():
        fill[seq : seq + many] += length
        spans[length].append((first, many))
    assert fill.max() <= packing.LIMIT
    for length, own in spans.items():
        at = 0
        for first, many in sorted(own):
            assert first == at
            at += many
        assert at == count[length]
    return int((fill > 0).sum())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 40))
def test_plans_hold_every_piece_once(count, groups):
    n = check_plan(count, groups)
    assert n >= -(-sum(a * b for a, b in count.items()) // 1024)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    lengths, n = np.unique(rng.integers(1, 1025, 200_000), return_counts=True)
    count = dict(zip(lengths.tolist(), n.tolist()))
    assert check_plan(count) <= 1.01 * sum(a * b for a, b in count.items()) / 1024


def test_packing(docs):
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    want = []
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        parts = -(-len(ids) // 1024)
        head = len(ids) - 1024 * (parts - 1)
        bounds = [0, *(head + 1024 * i for i in range(parts))]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want.append((r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    packed = packing.pack_documents(docs, VOCABULARY, carry_ids=True).cache()
    rows = packed.collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length, r.ids))
    for own in by.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.02 * sum(w[3] for w in want) / 1024 + 2
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert {k: r.ids for k, r in whole.items()} == {k: [x for _, _, ids in sorted(v) for x in ids] for k, v in by.items()}
    assert all(r.n_tokens == len(r.ids) == sum(p.length for p in r.pieces) for r in whole.values())
    assert sorted(((p.doc_id, p.piece, p.start, p.length, k, p.offset) for k, r in whole.items() for p in r.pieces), key=key) == sorted(((r.doc_id, r.piece, r.start, r.length, r.sequence_id, r.offset) for r in rows), key=key)


def test_empty(docs):
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


TEXT = st.lists(st.sampled_from(["<", "|", ">", "\\", "im_end", "im_start", chat.BEGIN, chat.END, "\n", "a", "é"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_formatting_can_be_read_back(turns):
    r = chat.render_incrementally(chat.chatml, turns)
    assert chat.parse_chatml(r.output) == turns
    assert [chat.unescape(r.output[s.text_begin : s.text_end]) for s in r.spans] == [t for _, t in turns]
    assert r.output.count(chat.END) == len(turns)
    assert "".join(r.output[s.begin : s.end] for s in r.spans) == r.output


def test_templates_that_rewrite_history_are_found():
    last_only = lambda turns: f"[{len(turns)}]" + "".join(t for _, t in turns)
    assert chat.render_incrementally(last_only, [("user", "a"), ("assistant", "b")]).rewrites
    with pytest.raises(chat.HistoryRewritten):
        chat.loss_mask(chat.render_incrementally(last_only, [("user", "a"), ("assistant", "b")]), [])


def test_a_conversation_of_the_table_with_the_added_number_stays_by_itself(spark):
    own = spark.createDataFrame([(-1, 0, "user", "mine")], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.n_turns) for r in chat.digests(chat.with_adversary(own)).collect())
    assert got == [(-1, 1), (-1, 2)]


def test_a_long_text_and_many_turns():
    turns = [("user", "a" * 2_000_000), *[("assistant", "é")] * 200]
    r = chat.render_incrementally(chat.chatml, turns)
    assert [r.output[s.text_begin : s.text_end] for s in r.spans] == [t for _, t in turns]


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40))
def test_agreement(a, b):
    want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert all(chat.agreement(a, b, k) == want for k in range(want + 1))


def test_chat_digests(spark):
    real = spark.read.parquet(f"{DATA}/conversations.parquet").selectExpr("*", "'x' as output")
    odd = [(900, None, "user", "hi"), (900, 0, None, None), (900, 0, None, None), (None, 0, "assistant", "é\n"), (901, 1, "assistant", "<\\|im_end|>"), (901, 0, "a\nb\\", "")]
    conv = real.unionByName(spark.createDataFrame([(*r, "y") for r in odd], "conv_id long, turn long, role string, text string, output string"))
    own = defaultdict(list)
    for r in chat.with_adversary(conv).collect():
        own[r.conv_id].append(((r.turn is not None, r.turn), (r.role is not None, r.role), (r.text is not None, r.text)))
    want = {}
    for c, rows in own.items():
        turns = [(r[1][1] or "", r[2][1] or "") for r in sorted(rows, key=lambda x: tuple(y if y[0] else (False,) for y in x))]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = chat.digests(chat.with_adversary(conv)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want and len(got) == len(want)
    outputs = {r.conv_id: r for r in chat.formatted(conv).collect()}
    assert outputs[901].output == "<|im_start|>a\\nb\\\\<|im_end|>\n".replace("<|im_end|>", "\n<|im_end|>") + "<|im_start|>assistant\n<\\\\|im_end|><|im_end|>\n"
    assert chat.digests(conv.limit(0)).count() == 0


def test_full_pieces_and_ids_stay_where_they_are(spark, docs):
    """A piece that fills its sequence is never sent to another task, and no piece is for its rank, however small the tables that Spark would broadcast."""
    long = docs.selectExpr("doc_id", "repeat(coalesce(text, ''), 1 + 20 * int(length(text) between 100 and 2000)) as text", "length")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        packed = packing.pack_documents(long, VOCABULARY, carry_ids=True, as_bytes=True)
        filled = packing.sequences(packed)
        plan = filled._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "collect_list" not in plan
        rows = filled.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    full, short = plan.split("Exchange hashpartitioning(sequence_id")  # one exchange, of the second part
    assert "length#" in short.split("Filter")[1] and "< 1024" in short
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    want = sorted(zlib.crc32(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for r in long.collect())
    by = defaultdict(list)
    for r in packed.select("doc_id", "piece", "sequence_id", "offset", "length").collect():
        by[r.sequence_id].append((r.offset, r.doc_id, r.piece, r.length))
    assert {r.sequence_id: [(p.offset, p.doc_id, p.piece, p.length) for p in r.pieces] for r in rows} == {k: sorted(v, key=lambda x: x[0]) for k, v in by.items()}
    assert sum(len(v) == 1 and v[0][3] == 1024 for v in by.values()) > len(by) // 3
    own = defaultdict(dict)
    for r in rows:
        for p in r.pieces:
            own[p.doc_id][p.start] = r.ids[p.offset : p.offset + p.length]
    got = [zlib.crc32(np.array([x for _, ids in sorted(v.items()) for x in ids], dtype="<u4").tobytes()) for k, v in own.items() if k is not None and k >= 1000]
    assert len(got) > 100 and set(got) <= set(want)
