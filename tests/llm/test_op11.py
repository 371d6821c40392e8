"""Token counts against the library, on short, long, repeating and odd texts."""

import random
import string

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import piece_codec, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
BASE64 = string.ascii_letters + string.digits + "+/"


def as_bytes(texts):
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in coded]))).astype(np.int64)


def counts(texts):
    return token_counts.transducer(PATH).count_texts(*as_bytes(texts)).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdetherin ▁\n\t.,"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_any_text(texts):
    assert counts(texts) == [len(LIBRARY.encode(t)) for t in texts]


def long_texts():
    rng = random.Random(3)
    return {
        "base64": "".join(rng.choice(BASE64) for _ in range(60_000)),
        "letters": "".join(rng.choice("etaoinshr") for _ in range(60_000)),
        "one letter": "a" * 150_001,
        "a pair": "ab" * 5_000 + "thethe" * 3_000,
        "no spaces": "".join(rng.choice("的一是不了人我在有他这中大来上国") for _ in range(20_000)),
        "spaces": " " * 20_000 + "x" + " " * 777,
        "marks": "-=" * 9_000 + "<s></s><unk>" * 200,
    }


@pytest.mark.parametrize("name", long_texts())
def test_long_stretches(name):
    text = long_texts()[name]
    ids = LIBRARY.encode(text)
    assert counts([text, "", text[:70], text[3:]]) == [len(ids), 0, len(LIBRARY.encode(text[:70])), len(LIBRARY.encode(text[3:]))]
    # the encoder's long segments too
    flat, bounds = piece_codec.codec(PATH).encode_texts(*as_bytes([text, "ok"]))
    assert flat[: bounds[1]].tolist() == ids and flat[bounds[1] :].tolist() == LIBRARY.encode("ok")


def test_forgotten_states_change_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH", 640)
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoinshr ") for _ in range(n)) for n in (10, 300, 5_000)] + ["".join(rng.choice("etaoin") for _ in range(6_000)), "the" * 2_000]
    assert counts(texts) == [len(LIBRARY.encode(t)) for t in texts]


def test_rows(spark):
    rows = [(1, "héllo wörld", "x"), (1, "héllo wörld", "x"), (None, None, None), (3, "", "y"), (4, "a" * 40_000, "y"), (5, "word " * 5_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = sorted(((i, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 4096) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, token_counts.token_counts(docs, PATH).collect()), key=str) == want
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def test_other_models_are_refused():
    data = bytearray(open(PATH, "rb").read())
    at = data.rindex(b"\x18\x01\x20\x00")  # the normaliser: a space first, no spaces taken away
    data[at + 1] = 0
    with pytest.raises(ValueError):
        piece_codec.read_pieces(bytes(data))
