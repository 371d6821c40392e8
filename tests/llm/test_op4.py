"""The classifier on labelled fixtures, and its posteriors against plain arithmetic."""

import numpy as np
import pytest

from weftgraph.llm import site_quality as sq

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("n_chars", "score")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = {r.doc_id: r.kept for r in sq.classify(docs, train).collect()}
    assert len(got) == docs.count()
    right = [got[r.doc_id] == bool(r.quality) for r in test.collect()]
    assert np.mean(right) > 0.97
    kept = sq.keep_good(docs, train)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())


def test_posteriors(spark):
    rows = [("a", "x", 0.9), ("a", "x", 0.7), ("a", "y", 0.1), ("b", "x", 0.2)] + [("c", "z", 0.5)] * 50
    sites, m, by_path = sq.site_posteriors(spark.createDataFrame(rows, "h string, q string, p double"))
    got = {(r.h, r.q): r for r in sites.collect()}
    assert m == pytest.approx(np.mean([r[2] for r in rows]))
    hosts = {h: [r[2] for r in rows if r[0] == h] for h in "abc"}
    by_host = sq.strength(m, len(rows), sum(map(sum, hosts.values())), sum(len(v) * np.mean(v) ** 2 for v in hosts.values()), 3)
    for (h, _), r in got.items():
        assert r.host_posterior == pytest.approx((by_host * m + sum(hosts[h])) / (by_host + len(hosts[h])))
    assert got["a", "x"].n == 2 and got["a", "x"].s == pytest.approx(1.6)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, "", "http://Ex.com/a/b?c", "en"), (None, " \n", "x", "de"), (2, "word " * 9000, "x", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sq.classify(docs, labels).collect()
    assert len(got) == 4 and {(r.host, r.path) for r in got} == {("", "/"), ("ex.com", "a/en"), ("x", "/de")}
    assert sq.classify(docs, labels.limit(0)).count() == 4
    assert sq.classify(docs.limit(0), labels).count() == 0


def test_scores_by_plain_arithmetic(spark):
    """Every score, posterior and verdict of a small corpus from its measures, with the document's own evidence left out of its path's."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    bodies = [(r.text or "").encode() for r in rows]
    x = sq.measures(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in bodies]))))
    good = {r.doc_id: r.quality for r in labels.collect()}
    known = [i for i, r in enumerate(rows) if good.get(r.doc_id) is not None]
    w = sq.fit(x[known], np.array([float(good[rows[i].doc_id]) for i in known]), sq.FitSpec())
    z = w[0] + x @ w[1:]
    p = 1 / (1 + np.exp(-z))
    got = {r.doc_id: r for r in sq.classify(docs, labels).collect()}
    at = {}
    for i, r in enumerate(rows):
        at.setdefault((got[r.doc_id].host, got[r.doc_id].path), []).append(i)
    hosts = {}
    for (h, _), own in at.items():
        hosts.setdefault(h, []).extend(own)
    m = p.mean()

    def worth(units):
        n = np.array([len(u) for u in units])
        means = np.array([p[u].mean() for u in units])
        return sq.strength(m, n.sum(), (n * means).sum(), (n * means**2).sum(), len(units))

    by_host, by_path = worth(list(hosts.values())), worth(list(at.values()))
    odds = lambda v: np.log(np.clip(v, 1e-6, 1 - 1e-6) / (1 - np.clip(v, 1e-6, 1 - 1e-6)))
    for (h, q), own in at.items():
        host = (by_host * m + p[hosts[h]].sum()) / (by_host + len(hosts[h]))
        for i in own:
            path = np.clip((by_path * host + p[own].sum() - p[i]) / (by_path + len(own) - 1), 0, 1)
            score = 1 / (1 + np.exp(-(z[i] + 0.5 * (odds(path) - odds(m)))))
            r = got[rows[i].doc_id]
            assert (r.doc_probability, r.host_posterior, r.path_posterior, r.score) == pytest.approx((p[i], host, path, score), rel=1e-5, abs=1e-9)
            assert r.kept == (r.score >= 0.5)


def test_empty_and_clashing_columns_as_a_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 as h", "2 as q", "3 as judged", "4 as row", "5 as p", "6 as z")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert sq.keep_good(docs, labels).columns == docs.columns
    assert sq.keep_good(docs.limit(0), labels).count() == 0
