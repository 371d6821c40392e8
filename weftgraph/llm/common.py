"""What the training-data operators share: tables, durable intermediates, text slices.

Intermediates are Parquet tables in the folder that ``spark.checkpoint.dir``
names, so a lost executor costs a re-read and never a lost block.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: the bytes that separate words in every contract here.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
IS_POINT = (np.arange(256) & 0xC0) != 0x80

#: Text bytes that a Python worker takes on at once; one longer text is a slice by itself.
SLICE_BYTES = 2 << 20


#: Rows and bytes that travel to Python together: texts are wide, and a batch is held on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def narrow_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes to what wide rows need. They are read when a plan runs, so they stay lowered."""
    if int(spark.conf.get(BATCH_CONF)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    if spark.conf.get(BYTES_CONF) != f"{BATCH_BYTES}b":
        spark.conf.set(BYTES_CONF, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, and what one keeps the others lack."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it wants
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in a local session that names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = f"{tempfile.gettempdir()}/weftgraph-checkpoints"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder, a folder for each value of ``by``, and go on from the written table."""
    spark = df.sparkSession
    narrow_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    col = batch.column(column)
    if col.type != pa.large_binary():
        col = col.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def text_slices(batches, most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(first column, bytes, offsets) of runs of rows with about ``most`` bytes of text each."""
    for batch in batches:
        buf, off = texts(batch)
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
            yield batch.column(0).slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        del buf, off
        give_back()


def set_apart(buf: np.ndarray, off: np.ndarray, mark: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one ``mark`` byte after each, and the places of these marks."""
    n = len(off) - 1
    marks = off[1:] + np.arange(n)
    out = np.empty(len(buf) + n, dtype=np.uint8)
    free = np.ones(len(out), dtype=bool)
    free[marks] = False
    out[free] = buf
    out[marks] = mark
    return out, marks


class Words:
    """Words of a slice of texts.

    start, end: byte spans in ``buf`` (texts set apart by newlines); first: for
    each text the index of its first word, with the number of words at the end;
    doc: the text of each word; inside: which bytes belong to words. ``space``
    says which bytes separate words; the newline must be one.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False, space: np.ndarray = IS_SPACE):
        self.buf, self.marks = set_apart(buf, off)
        if lower:
            self.buf = LOWER[self.buf]
        self.inside = ~space[self.buf]
        edge = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        if len(self.buf) and self.inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.concatenate(([0], np.searchsorted(self.start, self.marks)))
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def strings(self) -> pa.Array:
        """The words as one binary array."""
        size = np.concatenate(([0], np.cumsum(self.end - self.start)))
        body = self.buf[self.inside]
        return pa.Array.from_buffers(pa.large_binary(), len(size) - 1, [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(body)])

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Exact numbers for words, equal for equal words of the slice, and the words by number."""
        if not len(self.start):
            return np.zeros(0, np.int64), pa.array([], pa.large_binary())
        coded = self.strings().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between successive bounds."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def sorted_groups(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the bounds of the groups, from rows sorted by non-null numeric keys."""

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ends = tuple(b.column(b.schema.get_field_index(k))[b.num_rows - 1].as_py() for k in keys)
        held.append(b)
        if ends == last and len(held) < 64:  # a long group: look again when more of it has come
            continue
        last = ends
        t = pa.Table.from_batches(held).combine_chunks()
        at = bounds(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]).combine_chunks(), at
            held = t.slice(at[-1]).combine_chunks().to_batches()
        else:
            held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(bounds(t), t.num_rows)
