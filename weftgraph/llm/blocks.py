"""Tables of text blocks: some megabytes of documents in one row, compressed.

Operators that look at the corpus several times write it once in this form;
rounds then join small replies to blocks by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftgraph.llm.common import give_back, materialize, texts

BLOCK_BYTES = 4 << 20
SCHEMA = "block long, ids binary, known binary, lens binary, body binary, rest binary, n_bytes long"


class Block:
    """ids: document ids, ascending, with those that are null last (known is false for them); buf, off: texts; rest: other columns."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=bool)
        lens = np.frombuffer(row["lens"], dtype=np.int64)
        self.off = np.concatenate(([0], np.cumsum(lens)))
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), dtype=np.uint8)
        self.rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all() if row.get("rest") else None


def make_blocks(docs: DataFrame, carry: bool = False, most: int = BLOCK_BYTES) -> DataFrame:
    """docs as blocks, written; with ``carry`` all other columns go along."""
    others = [c for c in docs.columns if c != "text"] if carry else []

    def run(batches) -> Iterator[pa.RecordBatch]:
        packer, chunk, n = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column(0).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            known = np.asarray(ids.is_valid())
            value = ids.fill_null(0).to_numpy()
            order = np.lexsort((value, ~known))
            t, value, known = t.take(pa.array(order)), value[order], known[order]
            b = t.combine_chunks().to_batches()[0]
            buf, off = texts(b)
            rest = None
            if others:
                sink = pa.BufferOutputStream()
                part = b.select([f"r{i}" for i in range(len(others))])
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                rest = packer.compress(sink.getvalue().to_pybytes())
            body = packer.compress(buf[off[0] : off[-1]].tobytes())
            cells = [(chunk << 32) | n, value.astype(np.int64).tobytes(), known.tobytes(), np.diff(off).astype(np.int64).tobytes(), body, rest, int(off[-1] - off[0])]
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["block", "ids", "known", "lens", "body", "rest", "n_bytes"])

        for b in batches:
            _, off = texts(b)
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(off, off[at] + most - size, side="right")) - 1)
                held.append(b.slice(at, end - at))
                size += int(off[end] - off[at])
                at = end
                if size >= most or at < b.num_rows or sum(x.num_rows for x in held) >= 60_000:
                    yield block()
                    held, size, n = [], 0, n + 1
                    give_back()
        if held:
            yield block()

    chosen = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("t"), *(docs[c].alias(f"r{i}") for i, c in enumerate(others)))
    return materialize(chosen.mapInArrow(run, SCHEMA), "blocks")


def each_block(batches) -> Iterator[tuple[Block, dict]]:
    """(block, its row) of rows with the columns of a block table and any others, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            row = {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}
            yield Block(row), row
            give_back()
