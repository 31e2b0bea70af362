"""Blocks of rows, and questions that blocks put to shards of a hash space.

Corpus-wide questions ("does this window occur elsewhere?", "how often is this word used?") would
cost a shuffled row for each window or word. Here they travel packed: ``write_blocks`` stores the
rows as blocks of a few MB (one Arrow message each) in the shared checkpoint folder, so that a
block has the same rows whenever it is read. ``ask`` lets every block send each shard of the hash
space one row with its sorted, distinct hashes; Spark groups those rows by shard, ``answer`` works
on a whole shard, and ``meet`` brings the answers back to their blocks.

A shard holds each hash once for each block at most, however hot it is, and the number of shards
grows with the number of blocks; so does no task. Blocks are cut by size and never inside a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skywatch.llm.common import U64, materialise, shuffle_width, text_bytes

BLOCK_BYTES = 4 << 20
ASK = "shard int, block long, body binary"
ANSWER = "block long, shard int, body binary"


def message(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        for batch in table.combine_chunks().to_batches():
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def rows_in(body) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all().combine_chunks()


def write_blocks(rows: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Store ``rows`` as blocks of about ``block_bytes`` of text: ``block, body``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def full() -> pa.RecordBatch:
            nonlocal block, held, size
            body = message(pa.Table.from_batches(held))
            out = pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "body": pa.array([body], pa.binary())})
            block, held, size = block + 1, [], 0
            return out

        for batch in batches:
            # A row counts some bytes besides its text: many empty texts make a block as well.
            at = text_bytes(batch.column(text_col))[1] + 64 * np.arange(batch.num_rows + 1)
            i = 0
            while i < batch.num_rows:
                j = int(np.searchsorted(at, at[i] + block_bytes - size, "right")) - 1
                j = min(max(j, i + (not held)), batch.num_rows)
                if j > i:
                    held.append(batch.slice(i, j - i))
                    size += int(at[j] - at[i])
                if j < batch.num_rows:
                    yield full()
                i = j
        if held:
            yield full()

    return materialise(rows.mapInArrow(pack, "block long, body binary"), "blocks")


def shard_count(blocks: DataFrame) -> int:
    """Shards of the hash space: grows with the data, so that a shard's size does not."""
    return max(3 * shuffle_width(blocks.sparkSession), -(-blocks.count() // 4))


def bounds(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted hashes (one more than shards)."""
    step = (1 << 64) // shards
    limits = np.array([k * step for k in range(shards)], U64)
    return np.append(np.searchsorted(hashes, limits), len(hashes))


def pieces(block: int, hashes: np.ndarray, shards: int, body: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """The ask rows of one block: ``body(low, high)`` packs the hashes from low to high."""
    cut = bounds(hashes, shards)
    some = np.flatnonzero(cut[1:] > cut[:-1])
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array(some, pa.int32()),
            "block": pa.array(np.full(len(some), block), pa.int64()),
            "body": pa.array([body(int(cut[k]), int(cut[k + 1])) for k in some], pa.binary()),
        }
    )


def ask(blocks: DataFrame, question: Callable[[int, pa.Table], pa.RecordBatch]) -> DataFrame:
    """``question(block, rows)`` gives the block's ask rows."""

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                yield question(block, rows_in(body.as_buffer()))

    return blocks.mapInArrow(run, ASK)


def answer(asked: DataFrame, work: Callable[[list[int], list], list[bytes]]) -> DataFrame:
    """``work(blocks, bodies)`` sees all that was asked of one shard; one answer for each body."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        said = work(group.column("block").to_pylist(), [b.as_buffer() for b in group.column("body")])
        return pa.table({"block": group.column("block"), "shard": group.column("shard"), "body": pa.array(said, pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


def meet(blocks: DataFrame, answers: DataFrame, use: Callable, schema: str) -> DataFrame:
    """``use(block, rows, bodies)``: the block's rows and its answers by shard; yields batches."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return empty
        right = right.sort_by("shard").combine_chunks()
        bodies = [b.as_buffer() for b in right.column("body")]
        left = left.combine_chunks()
        block = left.column("block")[0].as_py()
        made = list(use(block, rows_in(left.column("body")[0].as_buffer()), bodies))
        return pa.Table.from_batches(made) if made else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    empty = to_arrow_schema(kind).empty_table()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, kind)


def short(hashes: np.ndarray) -> bytes:
    """The low 32 bits of each hash; a shard's place holds some high bits already."""
    return (hashes & U64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(bodies: list, sizes: np.ndarray) -> np.ndarray:
    """Flags of all answers in order; ``sizes``: how many flags each has."""
    parts = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(bodies, sizes)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def asked_sizes(hashes: np.ndarray, shards: int) -> np.ndarray:
    size = np.diff(bounds(hashes, shards))
    return size[size > 0]


def found_twice(bodies: list, kind=np.uint32) -> list[bytes]:
    """For each body's values: whether another body has the value as well."""
    parts = [np.frombuffer(b, kind) for b in bodies]
    every = np.concatenate(parts)
    order = np.sort(every)
    again = np.unique(order[1:][order[1:] == order[:-1]]) if len(order) > 1 else order[:0]
    said = []
    for part in parts:
        at = np.minimum(np.searchsorted(again, part), max(len(again) - 1, 0))
        said.append(bits(again[at] == part if len(again) else np.zeros(len(part), bool)))
    return said
