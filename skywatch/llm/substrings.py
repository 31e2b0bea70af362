"""Operator 9: removal of word passages that repeat across documents, by level-wise doubling.

A passage can only repeat where its halves repeat. So windows of a few words (``START``) are looked up
over the whole corpus first; only windows repeated at one length are extended to twice that length and
looked up again, until no candidates survive (``_walk``). ``remove_repeats`` ends the walk at ``window``
words, the length that it removes (4, 8 and, clipped, 13), where the candidates also learn the smallest
document id that holds each: every longer repeat is covered by windows of that length, so longer levels
could remove nothing more. ``repeat_levels`` walks on and reports how far each repeat reaches.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words. Rows with a null id neither
remove nor lose anything; rows that share an id do not remove from each other. Other columns pass
through untouched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.llm.blocks import (
    ASK,
    answer,
    ask,
    asked_sizes,
    bits,
    found_twice,
    meet,
    pieces,
    rows_in,  # noqa: F401  (re-exported for tests)
    shard_count,
    short,
    unbits,
    write_blocks,
)
from skywatch.llm.common import (
    SPACED,
    covered,
    discard,
    find_words,
    ids_of,
    materialise,
    release,
    rows_of,
    span_hashes,
    spare_name,
    text_bytes,
    window_starts,
    word_hashes,
)

WINDOW = 13
START = 4
BLOCK_BYTES = 2 << 20
STATE = -1


class _Words:
    """The words of one block's texts."""

    def __init__(self, rows: pa.Table, id_col: str, text_col: str):
        self.raw, self.offsets = text_bytes(rows.column(text_col))
        self.starts, self.ends, self.first = find_words(self.raw, self.offsets, SPACED)
        self.ids, self.present = ids_of(rows.column(id_col))
        self.n = len(self.starts)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.raw, self.starts, self.ends)

    def windows(self, length: int) -> np.ndarray:
        at = window_starts(self.first, length)
        return at[self.present[rows_of(at, self.first)]]

    def groups(self, words: np.ndarray, at: np.ndarray, length: int) -> "_Groups":
        return _Groups(span_hashes(words, at, at + length), self.ids[rows_of(at, self.first)])


class _Groups:
    """Equal windows of a block: distinct hashes in order, smallest and largest id of each."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes)
        h, ids = hashes[order], ids[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(head)
        self.hashes = h[at]
        self.low = np.minimum.reduceat(ids, at) if len(at) else ids
        self.high = np.maximum.reduceat(ids, at) if len(at) else ids
        #: The group of each window, in the order given.
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(head) - 1


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as distances from the smallest, in 4 bytes each where they fit."""
    base = int(ids.min()) if len(ids) else 0
    wide = len(ids) and int(ids.max()) - base >= 1 << 32
    body = ids.astype(np.int64) if wide else (ids - base).astype(np.uint32)
    return np.array([len(ids), base, int(bool(wide))], np.int64).tobytes() + body.tobytes()


def unpack_ids(body: memoryview) -> np.ndarray:
    n, base, wide = np.frombuffer(body[:24], np.int64)
    return np.frombuffer(body[24:], np.int64) if wide else np.frombuffer(body[24:], np.uint32).astype(np.int64) + base


def hashes_and_ids(hashes: np.ndarray, ids: np.ndarray) -> bytes:
    return np.int64(len(hashes)).tobytes() + hashes.tobytes() + pack_ids(ids)


def split_hashes_and_ids(body) -> tuple[np.ndarray, np.ndarray]:
    view = memoryview(body)
    n = int(np.frombuffer(view[:8], np.int64)[0])
    return np.frombuffer(view[8 : 8 + 8 * n], np.uint64), unpack_ids(view[8 + 8 * n :])


def smaller_elsewhere(_, bodies: list) -> list[bytes]:
    """For each hash of each body: whether any body holds it with a smaller id."""
    parts = [split_hashes_and_ids(b) for b in bodies]
    h, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    groups = _Groups(h, ids)
    less = groups.low[groups.of] < ids
    cut = np.cumsum([0] + [len(p[0]) for p in parts])
    return [bits(less[i:j]) for i, j in zip(cut[:-1], cut[1:])]


def _state(block: int, flags: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"shard": pa.array([STATE], pa.int32()), "block": pa.array([block], pa.int64()), "body": pa.array([bits(flags)], pa.binary())}
    )


def _repeated(groups: _Groups, bodies: list, shards: int) -> np.ndarray:
    """For each window of the block: whether another document holds it."""
    elsewhere = unbits(bodies, asked_sizes(groups.hashes, shards))
    return (elsewhere | (groups.low < groups.high))[groups.of]


def _first_level(blocks: DataFrame, length: int, shards: int, id_col: str, text_col: str) -> DataFrame:
    """Answers: which windows of ``length`` words another block holds as well."""

    def question(block, rows):
        words = _Words(rows, id_col, text_col)
        groups = words.groups(words.hashes(), words.windows(length), length)
        return pieces(block, groups.hashes, shards, lambda i, j: short(groups.hashes[i:j]))

    return answer(ask(blocks, question), lambda _, bodies: found_twice(bodies))


def _extended(blocks, answers, candidates, length, longer, shards, id_col, text_col, body):
    """Ask rows for the windows of ``longer`` words both of whose parts of ``length`` repeat."""

    def use(block, rows, bodies):
        words = _Words(rows, id_col, text_col)
        hashes = words.hashes()
        at, bodies = candidates(words, length, bodies)
        flags = np.zeros(words.n + longer, bool)
        if len(at):
            groups = words.groups(hashes, at, length)
            flags[at[_repeated(groups, bodies, shards)]] = True
        longer_at = words.windows(longer)
        longer_at = longer_at[flags[longer_at] & flags[longer_at + longer - length]]
        chosen = np.zeros(words.n, bool)
        chosen[longer_at] = True
        groups = words.groups(hashes, longer_at, longer)
        yield _state(block, chosen)
        yield pieces(block, groups.hashes, shards, lambda i, j: body(groups, i, j))

    return meet(blocks, answers, use, ASK)


def _every(words, length, bodies):
    return words.windows(length), bodies


def _chosen(words, length, bodies):
    flags = np.unpackbits(np.frombuffer(bodies[0], np.uint8))[: words.n].astype(bool)
    return np.flatnonzero(flags), bodies[1:]


def _with_state(asked: DataFrame, answers: DataFrame) -> DataFrame:
    return answers.unionByName(asked.filter(F.col("shard") == STATE).select("block", "shard", "body"))


def _asked(asked: DataFrame) -> DataFrame:
    return asked.filter(F.col("shard") >= 0)


def _doubled(start: int):
    """``start`` doubled again and again."""
    while True:
        yield start
        start *= 2


def _up_to(window: int) -> list[int]:
    """Lengths doubled from ``START``, the last clipped at ``window``; two at least."""
    lengths = [min(START, (window + 1) // 2)]
    while lengths[-1] < window or len(lengths) == 1:
        lengths.append(min(2 * lengths[-1], window))
    return lengths


def _walk(blocks: DataFrame, shards: int, lengths, id_col: str, text_col: str, removal: int | None = None):
    """Level by level: the length, how a block finds its candidates of that length, and the answers.

    Windows that repeat at one length are the only candidates at the next. The walk ends with the
    lengths, or after a level without candidates. At the length ``removal`` the answers tell whether a
    smaller id holds a candidate, elsewhere whether another block does.
    """
    length = next(lengths)
    answers, candidates, before = _first_level(blocks, length, shards, id_col, text_col), _every, None
    while True:
        yield length, candidates, answers
        longer = next(lengths, None)
        if longer is None:
            return
        last = longer == removal  # the lengths end here

        def body(groups, i, j, last=last):
            return hashes_and_ids(groups.hashes[i:j], groups.low[i:j]) if last else short(groups.hashes[i:j])

        work = smaller_elsewhere if last else lambda _, bodies: found_twice(bodies)
        asked = materialise(_extended(blocks, answers, candidates, length, longer, shards, id_col, text_col, body), "windows")
        release(blocks.sparkSession)
        if before is not None:
            discard(before)
        before, answers = asked, _with_state(asked, answer(_asked(asked), work))
        candidates, length = _chosen, longer
        if _asked(asked).isEmpty():
            yield length, candidates, answers
            return


def kept_bytes(raw, offsets, starts, ends, first, keep):
    """The kept words of each row joined by one space: bytes and offsets."""
    out = raw.copy()
    edge = np.zeros(len(raw) + 2, np.int32)
    s, e = starts[keep], ends[keep]
    row = rows_of(np.flatnonzero(keep), first)
    last = np.ones(len(s), bool)
    last[:-1] = row[1:] != row[:-1]
    out[e[~last]] = 0x20
    edge[s] += 1
    np.add.at(edge, e + ~last, -1)
    mask = np.cumsum(edge[: len(raw)]) > 0
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(mask, out=count[1:])
    return out[mask], count[offsets]


def text_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    Returns the columns of ``docs`` with ``text_col`` replaced by the kept words joined by one
    space, followed by ``n_words`` and ``n_removed`` (spare names where ``docs`` has these already).
    """
    blocks = write_blocks(docs, text_col, BLOCK_BYTES)
    shards = shard_count(blocks)
    for length, candidates, answers in _walk(blocks, shards, iter(_up_to(window)), id_col, text_col, window):
        pass  # the last level is what decides

    names = docs.columns
    n_words, n_removed = spare_name("n_words", names), spare_name("n_removed", names)
    schema = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema]
        + [T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())]
    )

    def use(block, rows, bodies):
        words = _Words(rows, id_col, text_col)
        # A walk that ended at a shorter length found nothing to remove.
        at, bodies = candidates(words, window, bodies) if length == window else (np.zeros(0, np.int64), [])
        groups = words.groups(words.hashes(), at, window)
        less = unbits(bodies, asked_sizes(groups.hashes, shards))
        gone = (words.ids[rows_of(at, words.first)] > groups.low[groups.of]) | less[groups.of]
        lost = covered(at[gone], window, words.n)
        raw, offsets = kept_bytes(words.raw, words.offsets, words.starts, words.ends, words.first, ~lost)
        total = np.concatenate([[0], np.cumsum(lost)])[words.first]
        new = [text_array(raw, offsets) if name == text_col else rows.column(name).combine_chunks() for name in names]
        new += [pa.array(np.diff(words.first), pa.int64()), pa.array(np.diff(total), pa.int64())]
        yield pa.RecordBatch.from_arrays([_one(c) for c in new], names=[*names, n_words, n_removed])

    return meet(blocks, answers, use, schema)


def _one(column):
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    return column


def repeat_levels(docs: DataFrame, start: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How far repeats reach: ``(id, length, n_windows)`` for each length ``start * 2**k``.

    Windows repeated at one length alone are extended to twice that length, until no candidates
    survive; ``n_windows`` counts the document's windows that another document holds as well.
    """
    blocks = write_blocks(docs, text_col, BLOCK_BYTES)
    shards = shard_count(blocks)
    kind = T.StructType(
        [T.StructField(id_col, T.LongType()), T.StructField("length", T.LongType()), T.StructField("n_windows", T.LongType())]
    )
    out = None
    for length, candidates, answers in _walk(blocks, shards, _doubled(start), id_col, text_col):

        def count(block, rows, bodies, length=length, candidates=candidates):
            words = _Words(rows, id_col, text_col)
            at, bodies = candidates(words, length, bodies)
            if not len(at):
                return
            at = at[_repeated(words.groups(words.hashes(), at, length), bodies, shards)]
            row, n = np.unique(rows_of(at, words.first), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.ids[row], pa.int64()), pa.array(np.full(len(row), length), pa.int64()), pa.array(n, pa.int64())],
                names=kind.names,
            )

        found = materialise(meet(blocks, answers, count, kind), "levels")
        out = found if out is None else out.unionByName(found)
    return out
