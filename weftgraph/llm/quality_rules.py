"""Quality rules by repetition coverage.

Every whole text is cut into words; rolling hashes of several n-gram lengths
over exact word numbers find n-grams that occur again in the same text, and the
characters that such later occurrences cover are measured, as are those of
lines that repeat an earlier line. The numbers of words and lines are exact;
two different n-grams of one 2 MB slice agree in their 64-bit hash with a
probability below 1e-7.

Defined cases: a null or empty text, and one of white space only, has no words,
so every measure is 0 and base_failed is true. Rows are judged one by one:
repeated rows and null doc_ids give a row each. Only ``doc_id`` and ``text``
are read, so other columns may have any name. An empty table gives no rows. Very
long texts are measured whole: a text over ``SLICE_BYTES`` is a slice by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import IS_POINT, Words, mix, per_doc, text_slices

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, dup_line_fraction double, dup_gram_fraction double, symbol_ratio double"
)


@dataclass(frozen=True)
class RepetitionRules:
    """Limits as shares of word_chars; n-gram lengths with the most that later occurrences may cover.

    One line said twice in a text of 60 words covers up to a fifth of it, so the
    limits lie above that.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    gram_limits: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.29), (7, 0.28), (8, 0.27), (9, 0.26), (10, 0.25))
    max_dup_line_fraction: float = 0.30
    max_symbols_per_word: float = 0.10


def repeated(keys: np.ndarray) -> np.ndarray:
    """Places whose key occurs at least twice, ascending."""
    if len(keys) < 2:
        return np.zeros(0, np.int64)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return np.flatnonzero(twice[at] == keys)


def later(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of the places, those that are not the first with their key."""
    first = np.unique(keys[places], return_index=True)[1]
    keep = np.ones(len(places), dtype=bool)
    keep[first] = False
    return places[keep]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie inside a window of n words at one of the starts."""
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(buf: np.ndarray, off: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    w = Words(buf, off)
    n_words = np.diff(w.first)
    total = len(w.start)
    bounds = np.concatenate(([0], w.marks + 1))
    points = np.concatenate(([0], np.cumsum(w.inside & IS_POINT[w.buf], dtype=np.int64)))
    chars = points[w.end] - points[w.start]
    word_chars = points[bounds[1:]] - points[bounds[:-1]]
    n_symbols = per_doc(SYMBOLS[w.buf], bounds)

    # lines, each with the newline that ends it, so that equal lines are equal strings
    ends = np.flatnonzero(w.buf == 10) + 1
    line_off = np.concatenate(([0], ends)).astype(np.int64)
    lines = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(line_off), pa.py_buffer(np.ascontiguousarray(w.buf))])
    line_code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = (np.searchsorted(w.start, line_off[1:]) - np.searchsorted(w.start, line_off[:-1])) > 0
    line_doc = np.searchsorted(w.marks, ends - 1)
    some = np.flatnonzero(worded)
    key = (line_doc[some] << 32) | line_code[some]
    again = some[later(key, repeated(key))]
    dup_line = np.zeros(len(ends), dtype=bool)
    dup_line[again] = True
    line_bounds = np.searchsorted(ends - 1, w.marks) + 1
    line_bounds = np.concatenate(([0], line_bounds))
    n_dup_lines = per_doc(dup_line, line_bounds)
    line_chars = (points[line_off[1:]] - points[line_off[:-1]]) * dup_line
    dup_line_chars = per_doc(line_chars, line_bounds)

    code, _ = w.codes()
    code = mix(code.astype(np.uint64))
    of_doc = mix(w.doc.astype(np.uint64) + np.uint64(1 << 40))
    left = np.repeat(w.first[1:], n_words) - np.arange(total)  # words from here to the text's end
    base = np.uint64(0x9E6C63D0876A9A47)
    rolling, worst, worst_over = code.copy(), np.zeros(len(n_words)), np.zeros(len(n_words), dtype=bool)
    n_repeat = np.zeros(len(n_words), dtype=np.int64)
    limits = dict(rules.gram_limits)
    share = np.maximum(word_chars, 1)
    for n in range(2, max([3, *limits]) + 1):
        rolling = rolling[:-1] * base + code[n - 1 :] if len(rolling) > 1 else rolling[:0]
        if n != 3 and n not in limits:
            continue
        at = np.flatnonzero(left[: len(rolling)] >= n)
        key = mix(rolling[at] ^ of_doc[at])
        found = repeated(key)
        if n == 3:
            n_repeat = per_doc(covered(at[found], n, total), w.first)
        if n in limits:
            part = per_doc(chars * covered(at[later(key, found)], n, total), w.first) / share
            worst = np.maximum(worst, part)
            worst_over |= part > limits[n]
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    line_part, symbols = dup_line_chars / share, n_symbols / np.maximum(n_words, 1)
    fine = ~worst_over & (line_part <= rules.max_dup_line_fraction) & (symbols <= rules.max_symbols_per_word)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & fine,
        "dup_line_fraction": line_part, "dup_gram_fraction": worst, "symbol_ratio": symbols,
    }


def repetition_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per document with its measures and the verdict ``kept``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, buf, off in text_slices(batches):
            got = measure(buf, off, rules)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(v) for v in got.values())], names=["doc_id", *got])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)


def keep_passing(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The documents that repetition_rules() keeps, with their own columns."""

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in column:
            parts = [measure(buf, off, rules)["kept"] for _, buf, off in text_slices([pa.RecordBatch.from_arrays([col, col], names=["i", "t"])])]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(F.arrow_udf(run, T.BooleanType())(docs["text"]))
