"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over measures of the whole text gives each document a
probability of being good. These are summed by host and by path; a host's
posterior mean shrinks its own sum toward the global mean, a path's toward its
host's posterior, and how strongly is estimated from all hosts and paths by
moments, so sites with few documents say little. A document's score adds to its
own log odds those by which its path differs from the corpus, with its own
evidence left out of the path's.

The regression is fitted on a bounded sample of labelled documents (the bound
is ``FitSpec.sample``), chosen by a hash of the id; sums, posteriors and scores
cover all documents.

Defined cases: a null or empty text has all measures zero; a null source is the
host ""; documents whose id repeats are scored each, and labels that disagree
are averaged; without labels of both classes the regression says 0.5 for all. An
empty table gives no rows. Only doc_id, text, source and lang are read; other
columns stay as they are. Very long texts are measured whole, one batch at a
time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import IS_POINT, SLICE_BYTES, Words, give_back, materialize, mix, per_doc, texts
from weftgraph.llm.quality_rules import SYMBOLS, covered, later, repeated


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


UPPER = _flags(bytes(range(65, 91)))
LOWER = _flags(bytes(range(97, 123)))
DIGIT = _flags(b"0123456789")
LOUD = _flags(b"!?")
STOP = _flags(b".,;:")

MEASURES = (
    "log_words", "word_length", "symbols", "symbol_words", "upper", "lower", "digits", "loud", "stops", "beyond_ascii",
    "distinct_words", "repeated_trigrams", "repeated_lines", "capital_words", "line_words", "lone_words",
)


@dataclass(frozen=True)
class FitSpec:
    sample: int = 20_000
    rounds: int = 25
    ridge: float = 1.0
    threshold: float = 0.5
    #: of the log odds by which a path differs from the corpus, the share that a score takes
    site_weight: float = 0.5


def measures(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    w = Words(buf, off)
    n = np.diff(w.first)
    total = len(w.start)
    bounds = np.concatenate(([0], w.marks + 1))
    words, points = np.maximum(n, 1), np.maximum(per_doc(w.inside & IS_POINT[w.buf], bounds), 1)

    def share(flags):
        return per_doc(flags[w.buf], bounds) / points

    last = w.buf[w.end - 1] if total else np.zeros(0, np.uint8)
    head = w.buf[w.start] if total else last
    size = w.end - w.start
    code, _ = w.codes()
    of_doc = mix(w.doc.astype(np.uint64) + np.uint64(1 << 40))
    single = mix(mix(code.astype(np.uint64)) ^ of_doc)
    again = np.zeros(total, dtype=bool)
    again[later(single, repeated(single))] = True
    c = mix(code.astype(np.uint64))
    tri = (c[:-2] * np.uint64(31) + c[1:-1]) * np.uint64(1_000_003) + c[2:] if total > 2 else c[:0]
    at = np.flatnonzero(np.repeat(w.first[1:], n)[: len(tri)] - np.arange(len(tri)) >= 3)
    key = mix(tri[at] ^ of_doc[at])
    tri_hit = covered(at[later(key, repeated(key))], 3, total) if total else np.zeros(0, bool)
    ends = np.flatnonzero(w.buf == 10) + 1
    line_off = np.concatenate(([0], ends)).astype(np.int64)
    lines = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(line_off), pa.py_buffer(np.ascontiguousarray(w.buf))])
    line_code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_words = np.diff(np.searchsorted(w.start, line_off))
    line_doc = np.searchsorted(w.marks, ends - 1)
    worded = np.flatnonzero(line_words > 0)
    lkey = (line_doc[worded] << 32) | line_code[worded]
    line_again = np.zeros(len(ends), dtype=bool)
    line_again[worded[later(lkey, repeated(lkey))]] = True
    line_bounds = np.concatenate(([0], np.searchsorted(ends - 1, w.marks) + 1))
    n_lines = np.maximum(per_doc(line_words > 0, line_bounds), 1)
    return np.stack(
        [
            np.log1p(n), points / words, share(SYMBOLS), per_doc(SYMBOLS[last], w.first) / words, share(UPPER), share(LOWER), share(DIGIT),
            share(LOUD), share(STOP), per_doc((w.buf >= 0xC0), bounds) / points, 1 - per_doc(again, w.first) / words,
            per_doc(tri_hit, w.first) / words, per_doc(line_again, line_bounds) / n_lines, per_doc(UPPER[head], w.first) / words,
            np.log1p(words / n_lines), per_doc(size == 1, w.first) / words,
        ],
        axis=1,
    )


def measure_batches(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in column:
        buf, off = texts(pa.RecordBatch.from_arrays([col], names=["t"]), 0)
        parts, i, n = [np.zeros((0, len(MEASURES)))], 0, len(col)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
            parts.append(measures(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
            i = j
        flat = np.concatenate(parts)
        del buf, off, parts
        give_back()
        yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(MEASURES)), pa.array(flat.ravel()))


def measures_udf(column: Column | str) -> Column:
    # said to be nondeterministic so that no plan evaluates it again, as for a filter on what is made of it
    return F.arrow_udf(measure_batches, T.ArrayType(T.DoubleType())).asNondeterministic()(column)


def fit(x: np.ndarray, y: np.ndarray, spec: FitSpec) -> np.ndarray:
    """Ridge logistic regression by Newton steps, y between 0 and 1; the intercept first, for measures as they are."""
    if not len(y) or y.min() == y.max():
        return np.zeros(1 + len(MEASURES))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate((np.ones((len(x), 1)), (x - mean) / scale), axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [spec.ridge] * (z.shape[1] - 1))
    for _ in range(spec.rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty @ w
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = np.concatenate(([w[0]], w[1:] / scale))
    out[0] -= (w[1:] / scale * mean).sum()
    return out


def sample_and_fit(docs: DataFrame, labels: DataFrame, spec: FitSpec) -> np.ndarray:
    """Weights from at most spec.sample labelled ids, those with the least hash; where ids repeat, from at most twice as many rows."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.sample)
    # at most ``sample`` rows of two numbers, so it is sent to the texts and not they to it
    held = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(chosen), "doc_id")
    got = held.select(F.xxhash64("doc_id").alias("h"), "y", measures_udf("text").alias("f")).orderBy("h").limit(2 * spec.sample).toPandas()
    if not len(got):
        return np.zeros(1 + len(MEASURES))
    return fit(np.stack(got["f"]), got["y"].to_numpy(), spec)


SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?"


def host_of(source: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(source, F.lit("")), SCHEME + r"([^/?#]*)", 1))


def path_of(source: Column, lang: Column) -> Column:
    """The first segment of the source's path and the language: the part of a site that a document is in."""
    return F.concat_ws("/", F.regexp_extract(F.coalesce(source, F.lit("")), SCHEME + r"[^/?#]*/([^/?#]*)", 1), F.coalesce(lang, F.lit("")))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def strength(m: float, weight: float, means: float, square: float, units: float) -> float:
    """The count that a prior with mean m is worth, by moments: of ``units`` units with n documents each and mean p, weight
    is the sum of n, means that of n p, square that of n p p; what their means vary beyond chance is the prior's variance."""
    if units < 2 or weight <= 0:
        return 1e6
    mean = means / weight
    between = square / weight - mean * mean
    chance = units * m * (1 - m) / weight
    excess = max(between - chance, 1e-6)
    return float(min(max(m * (1 - m) / excess - 1, 1.0), 1e6))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float, float]:
    """(h, q, n, s, host_posterior) for every path q of a host h, from rows (h, q, p); the global mean and the weight of a host's posterior in its paths."""
    paths = materialize(evidence.groupBy("h", "q").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    def moments(t: DataFrame):
        p = F.col("s") / F.col("n")
        r = t.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * p * p).alias("ss"), F.count("*").alias("k")).first()
        return float(r["n"] or 0), float(r["s"] or 0), float(r["ss"] or 0), float(r["k"])

    n, s, ss, k = moments(hosts)
    m = min(max(s / n, 1e-6), 1 - 1e-6) if n else 0.5
    by_host, by_path = strength(m, n, s, ss, k), strength(m, *moments(paths))
    posterior = hosts.select("h", ((F.lit(by_host * m) + F.col("s")) / (F.lit(by_host) + F.col("n"))).alias("host_posterior"))
    # written, so that its size is known where it is joined: small ones are broadcast then, others not
    return materialize(paths.join(posterior, "h"), "quality-sites"), m, by_path


def log_odds(f: Column, w: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(f, F.array(*[F.lit(float(x)) for x in w[1:]]), lambda a, b: a * b), F.lit(float(w[0])), lambda a, b: a + b)


def with_evidence(docs: DataFrame, w: np.ndarray, *carried: Column) -> DataFrame:
    """The carried columns, the host h, the path q, the log odds z that the document is good, and its probability p."""
    lang = docs["lang"] if "lang" in docs.columns else F.lit("")
    measured = docs.select(*carried, host_of(docs["source"]).alias("h"), path_of(docs["source"], lang).alias("q"), measures_udf(docs["text"]).alias("__f"))
    return measured.withColumn("z", log_odds(F.col("__f"), w)).withColumn("p", 1 / (1 + F.exp(-F.col("z")))).drop("__f")


def with_scores(evidence: DataFrame, site: tuple[DataFrame, float, float], spec: FitSpec) -> DataFrame:
    """evidence with a struct column ``judged``: host, path, doc_probability, host_posterior, path_posterior, score, kept."""
    sites, m, by_path = site
    # the document's own evidence is left out of its path's
    others = (F.lit(by_path) * F.col("host_posterior") + F.col("s") - F.col("p")) / (F.lit(by_path) + F.col("n") - 1)
    # both sides have a shuffle of their own if sites is too large to send: a host with very many rows is split there
    joined = evidence.join(sites, ["h", "q"]).withColumn("path_posterior", F.least(F.greatest(others, F.lit(0.0)), F.lit(1.0)))
    score = 1 / (1 + F.exp(-(F.col("z") + F.lit(spec.site_weight) * (logit(F.col("path_posterior")) - logit(F.lit(m))))))
    return joined.withColumn(
        "judged",
        F.struct(
            F.col("h").alias("host"), F.col("q").alias("path"), F.col("p").alias("doc_probability"), "host_posterior", "path_posterior",
            score.alias("score"), (score >= spec.threshold).alias("kept"),
        ),
    )


def classify(docs: DataFrame, labels: DataFrame, spec: FitSpec = FitSpec()) -> DataFrame:
    """One row per document with its evidence, posteriors, score and verdict; texts are measured once, into a narrow table."""
    w = sample_and_fit(docs, labels, spec)
    evidence = materialize(with_evidence(docs, w, docs["doc_id"].cast("long").alias("doc_id")), "quality-evidence")
    return with_scores(evidence, site_posteriors(evidence), spec).select("doc_id", "judged.*")


def keep_good(docs: DataFrame, labels: DataFrame, spec: FitSpec = FitSpec()) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns.

    Documents go on with their texts, so these are measured twice rather than written with their evidence.
    """
    w = sample_and_fit(docs, labels, spec)
    site = site_posteriors(with_evidence(docs, w).select("h", "q", "p"))
    scored = with_scores(with_evidence(docs, w, F.struct(*docs.columns).alias("row")), site, spec)
    return scored.where("judged.kept").select("row.*")
