"""Helpers shared by the corpus operators: inputs, folds, scratch tables, word spans, hashes.

Texts are handled as UTF-8 bytes of whole Arrow columns: ``text_bytes`` gives one byte array and
its row offsets, ``find_words`` the word spans in it, ``span_hashes`` a 64-bit hash for each span
from one cumulative sum. Two different spans share a hash with probability about 2**-64.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.session import checkpoint_root, remove_path, scratch_path

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int) -> Column:
    """``crc32(column as text) mod n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new folder of the cluster's shared checkpoint folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_folder = path
    open_steps = _STEPS.get()
    if open_steps is not None:
        open_steps.append(made)
    return made


_STEPS: ContextVar[list[DataFrame] | None] = ContextVar("steps", default=None)


@contextmanager
def passing_steps() -> Iterator[list[DataFrame]]:
    """Removes the folders of all steps materialised inside, at the end, also after a failure.

    What is still in the list goes; a result that other frames read must be taken out of it.
    """
    steps: list[DataFrame] = []
    token = _STEPS.set(steps)
    try:
        yield steps
    finally:
        _STEPS.reset(token)
        for made in steps:
            discard(made)


def discard(made: DataFrame) -> None:
    """Remove the folder of a materialised step; only when no frame in use reads it any more."""
    remove_path(made.sparkSession, made.scratch_folder)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of steps that are done.

    Spark removes a shuffle's files some time after the driver's garbage collector has found that
    no DataFrame refers to it, which can be after the end of a job with a large heap.
    """
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None)
    if jvm is not None:
        for _ in range(2):
            gc.collect()
            jvm.System.gc()
            time.sleep(0.2)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare_name(wanted: str, taken) -> str:
    """``wanted``, with underscores added until no column of ``taken`` has that name."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


# -- bytes of text columns ----------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """One byte array for all rows (null: empty) and the rows' offsets in it (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def ids_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Integer ids and which of them are present (a null id reads as 0, absent)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.int64())
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """256 flags: True outside the given closed byte ranges (bytes of words)."""
    flags = np.ones(256, bool)
    for low, high in spans:
        flags[low : high + 1] = False
    return flags


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased.
LETTERED = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Lower-cases the bytes of A-Z.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def find_words(raw: np.ndarray, offsets: np.ndarray, flags: np.ndarray):
    """Starts and ends of the words, and each row's first word (one more than rows)."""
    word = flags[raw]
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


# -- hashes ---------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BASE = 0x9E3779B97F4A7C15


class _Tables(dict):
    """A cache of each process: it travels empty with the functions that use it."""

    def __reduce__(self):
        return _Tables, ()


_TABLES = _Tables()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_TABLES.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            run = np.full(size, base, U64)
            run[0] = 1
            _TABLES[name] = np.cumprod(run, dtype=U64)
    return _TABLES["up"][:n], _TABLES["down"][:n]


def byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each span (values: 64-bit)."""
    up, down = _powers(len(values) + 1)
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64))


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` values; its high bits are the well mixed ones."""
    up, down = _powers(len(values) + 1)
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = total[length:] - total[:-length]
    h *= down[: len(h)]
    h ^= h >> U64(32)
    h *= U64(0x94D049BB133111EB)
    return h


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words in order, a MB of text at a time (a hash does not depend on the place)."""
    values, out, i = byte_values(), np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(int(np.searchsorted(starts, starts[i] + (1 << 20))), i + 1)
        low = starts[i]
        out[i:j] = span_hashes(values[raw[low : ends[j - 1]]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Indexes of the words at which a window of ``length`` words of one row starts."""
    n = int(first[-1]) if len(first) else 0
    ok = np.zeros(n + 1, np.int32)
    low, high = first[:-1], first[1:] - length + 1
    some = high > low
    np.add.at(ok, low[some], 1)
    np.add.at(ok, high[some], -1)
    return np.flatnonzero(np.cumsum(ok[:n]))


def rows_of(index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The row that each index belongs to, by the rows' bounds."""
    return np.searchsorted(bounds, index, "right") - 1


def sorted_unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Flags of the ``n`` places that lie in some ``[start, start + length)``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0
