"""The pipeline's stages against brute force on small fixtures."""

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm import quality_rules, simhash
from weftgraph.llm.queries import BYTE_VOCABULARY

DATA = "/root/testdata/sf0.001"


def jaccard(a, b, n=5):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / max(1, len(x | y))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_one_of_each_group_stays(spark, docs):
    base = [r for r in docs.collect() if len(r.text.split()) > 150][:40]
    rows = [tuple(r) for r in docs.collect()]
    planted = []
    for i, r in enumerate(base):
        words = r.text.split(" ")
        copies = [r.text, r.text, " ".join([*words[:60], "changed", *words[61:]])]
        planted += [(10_000 + 10 * i + k, t, *tuple(r)[2:]) for k, t in enumerate(copies)]
    odd = [(None, base[0].text, "en", "s", 1), (20_001, None, "en", "s", 0), (20_002, "", "en", "s", 0), (20_003, "twice", "en", "s", 5), (20_003, "twice", "en", "s", 5)]
    df = spark.createDataFrame([*rows, *planted, *odd], docs.schema)
    kept = simhash.keep_one(df)
    assert kept.schema == df.schema
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and not [d for d in got if d is None or 10_000 <= d < 20_000]
    assert 20_001 in got and 20_002 not in got and 20_003 in got
    # what went from the original rows was alike to something that stayed, by and large
    text = {r[0]: r[1] for r in rows}
    for d in set(text) - set(got):
        assert max(jaccard(text[d], text[o]) for o in text if o != d) > 0.6
    alone = [d for d in text if all(o == d or jaccard(text[d], text[o]) < 0.3 for o in text)]
    assert set(alone) <= set(got)


def test_rules_as_a_filter(docs):
    judged = {r.doc_id: r for r in quality_rules.repetition_rules(docs).collect()}
    assert {r.doc_id for r in quality_rules.keep_passing(docs).collect()} == {d for d, r in judged.items() if r.kept}


def test_stages_in_order(spark, docs):
    at = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "repetition_rules", "near_duplicates", "repeated_passages", "best_fit_packing"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, DATA).cache()
        assert out.schema == docs.schema and 0 < out.count() <= at.count()
        at = out
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(bad & {r.doc_id for r in at.collect()}) <= 0.1 * len(bad)
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.columns == ["sequence_id", "n_tokens", "ids", "pieces"]
    rows = packed.collect()
    assert all(len(r.ids) == r.n_tokens <= 1024 for r in rows)
    ids = {}
    for r in rows:
        for p in r.pieces:
            ids[p.doc_id, p.piece] = r.ids[p.offset : p.offset + p.length]
    tok = Tokenizer.from_file(BYTE_VOCABULARY)
    tok.encode_special_tokens = True
    text = {r.doc_id: r.text for r in at.collect()}
    for d, t in text.items():
        own = [x for k in sorted(k for k in ids if k[0] == d) for x in ids[k]]
        assert own == [*tok.encode(t, add_special_tokens=False).ids, 2]
    assert {d for d, _ in ids} == set(text)


def test_empty_tables_and_clashing_names_in_every_stage(spark, docs):
    odd = docs.selectExpr("*", "1 as h", "2 as row", "3 as key", "4 as block", "5 as label", "6 as ids", "7 as uid", "8 as length")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        if name != "best_fit_packing":
            assert stage(spark, odd, DATA).columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, DATA).count() > 0


def test_null_texts_and_long_texts_keep_their_form(spark, docs):
    rows = [(1, None, "en", "s", None), (2, "x " * 3_000_000, "en", "s", 6_000_000), (3, "x " * 3_000_000 + "y", "en", "s", 6_000_001), (4, "é ü", None, None, 3)]
    df = spark.createDataFrame(rows, docs.schema)
    assert sorted(tuple(r) for r in simhash.keep_one(df).collect()) == [rows[0], rows[1], rows[3]]


def passages(rng, n, share, way):
    """Pairs of random texts: one has a passage appended or replaced that is this share of its words."""
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        k = round(300 * share)
        new = [f"v{x}" for x in rng.integers(0, 5000, k)]
        at = int(rng.integers(0, 300 - k))
        yield " ".join(words), " ".join([*words, *new] if way == "appended" else [*words[:at], *new, *words[at + k :]])


def groups(pairs_of, texts):
    label = list(range(len(texts)))
    for i, j in pairs_of:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def kept_ids(spark, docs, texts, **how):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], docs.schema).repartition(3)
    return {r.doc_id for r in simhash.keep_one(df, **how).collect()}


@pytest.mark.parametrize("way", ["appended", "replaced"])
def test_every_contiguous_edit_is_found(spark, docs, way):
    import numpy as np

    rng = np.random.default_rng(3)
    shares = {"appended": (0.245, 0.17, 0.11), "replaced": (0.0933, 0.066, 0.04)}[way]
    pairs = [p for share in shares for p in passages(rng, 60, share, way)]
    alike = [jaccard(a, b) for a, b in pairs]
    assert sum(0.8 <= x < 0.82 for x in alike) >= 50 and all(x >= 0.8 for x in alike)
    assert kept_ids(spark, docs, [t for p in pairs for t in p]) == set(range(0, 2 * len(pairs), 2))


def occurrences(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def similar(a, b):
    x, y = occurrences(a), occurrences(b)
    return jaccard(a, b) >= 0.8 or (x & y).total() >= 0.8 * max(1, (x | y).total())


@pytest.mark.parametrize("block", [512, 4])
def test_only_similar_texts_are_linked(spark, docs, block):
    import numpy as np

    rng = np.random.default_rng(4)
    # a template of which each text has three quarters, chains of growing distance, repeated lines, common passages, short texts
    base = [f"b{x}" for x in rng.integers(0, 900, 200)]
    texts = [" ".join([*base, *(f"t{i}x{k}" for k in range(50 + 5 * (i % 3)))]) for i in range(30)]
    words = [f"c{x}" for x in range(150)]
    for i in range(30):
        words = [*words[:5 * i], *(f"d{i}x{k}" for k in range(4 + i % 9)), *words[5 * i + 4 :]]
        texts.append(" ".join(words))
    texts += [" ".join(f"e{x}" for x in rng.integers(0, 3, 12)) for _ in range(30)]
    texts += [" ".join(["this line is in every text of these"] * (i % 4) + [f"f{i}x{k}" for k in range(i % 7)]) for i in range(30)]
    texts += [" ".join([*base[:120], *(f"g{x}" for x in rng.integers(0, 12, 8))]) for _ in range(20)] + ["one", "ONE", "one two", "", " "]
    label = groups([(i, j) for i in range(len(texts)) for j in range(i) if similar(texts[i], texts[j]) or not (texts[i].split() or texts[j].split())], texts)
    assert 30 < len(set(label)) < len(texts) - 30
    assert kept_ids(spark, docs, texts, **({} if block == 512 else {"block": block})) == set(label)


def test_near_duplicates_go_by_fingerprints_too(spark, docs, monkeypatch):
    """Texts that no prefix cell brings together are found where their fingerprints are near, and verified."""
    from weftgraph.llm import similar

    words = [f"w{i}" for i in range(300)]
    other = [*words[:150], "changed", *words[151:]]
    far = [f"v{i}" for i in range(300)]
    texts = [" ".join(x) for x in (words, other, far)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fp = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(rows).collect()}
    bits = (fp[0] ^ fp[1]).bit_count()
    groups = {r.key: r.label for r in simhash.fingerprint_groups(simhash.fingerprints(rows).withColumnRenamed("doc_id", "key"), max(2, bits)).collect()}
    assert set(groups) == {0, 1} and len(set(groups.values())) == 1
    whole = similar.fingerprint_groups
    monkeypatch.setattr(similar, "fingerprint_groups", lambda printed: whole(printed, max(2, bits)))
    monkeypatch.setattr(similar, "cell_rows", lambda members: members.selectExpr("uid as cell", "uid"))
    assert kept_ids(spark, docs, texts) == {0, 2}
