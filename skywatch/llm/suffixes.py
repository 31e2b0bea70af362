"""Operator 4: removal of byte strings that repeat across documents, by suffix arrays.

Two steps bring equal strings together without moving every suffix:

* Each ``length``-byte window names its *anchor*, the smallest hash among the ``gram``-byte strings
  in it (the last one of equals). Equal windows have equal anchors, so a window can only repeat
  where its anchor does; all anchors are looked up over the whole corpus first.
* The windows of one anchor occurrence are one run of bytes, the *fragment*. Fragments of repeated
  anchors go to the shard of their anchor. There a suffix array over the shard's distinct fragments
  puts equal windows side by side: by two-stage sorting only suffixes smaller than their successors
  are sorted directly, the others are induced by scanning the buckets in order; common prefixes of
  adjacent suffixes of at least ``length`` bytes then make the classes of equal windows, and each
  class has its smallest document id.

An anchor in more than ``HOT`` fragments (a frequent line, the edges of a shared passage) would bring
all its neighbourhoods to one shard. Its windows go by themselves instead, each to the shard of the
window's own hash: a window is a fragment of its own there, whose copies have equal hashes, so every
window is still looked up and no key has more than one entry a block.

A null text counts as empty. Matches never cross rows. Rows with a null id neither remove nor lose
anything; rows that share an id do not remove from each other. Other columns pass through
untouched; an empty table gives an empty result. Comparison is exact but for the hashes of anchors,
which only group, and of whole fragments and windows (64 bits), which only recognise copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skywatch.llm.blocks import (
    ASK,
    answer,
    ask,
    asked_sizes,
    bits,
    bounds,
    meet,
    pieces,
    shard_count,
    short,
    unbits,
    write_blocks,
)
from skywatch.llm.common import (
    U64,
    byte_values,
    covered,
    ids_of,
    materialise,
    mix,
    release,
    rows_of,
    run_hashes,
    span_hashes,
    spare_name,
    text_bytes,
)
from skywatch.llm.substrings import (
    STATE,
    _asked,
    _Groups,
    _one,
    _with_state,
    hashes_and_ids,
    pack_ids,
    smaller_elsewhere,
    unpack_ids,
)

LENGTH = 50
BLOCK_BYTES = 1 << 20
GRAM = 20
#: Anchors in more fragments than this are split into windows.
HOT = 4096
#: Marks the body of an anchor's windows, where that of fragments has their number.
WINDOWS = -1
LOW32 = U64(0xFFFFFFFF)


# -- the suffix array -----------------------------------------------------------------------


def _words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number (zeros past the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = padded[: len(text)].astype(U64)
    for k in range(1, 8):
        out = (out << U64(8)) | padded[k : k + len(text)].astype(U64)
    return out


def _direct_order(words: np.ndarray, direct: np.ndarray, depth: int) -> np.ndarray:
    """The places ``direct`` by the first ``depth`` bytes there: eight at a time, ties alone go on."""
    n = len(words)
    direct = direct[np.argsort(words[direct], kind="stable")]
    key = words[direct]
    tied = np.zeros(len(direct), bool)
    tied[1:] = key[1:] == key[:-1]
    for k in range(8, depth, 8):
        member = tied.copy()
        member[:-1] |= tied[1:]
        i = np.flatnonzero(member)
        if not len(i):
            break
        place = direct[i]
        key = words[np.minimum(place + k, n - 1)]
        key[place + k >= n] = 0
        group = np.cumsum(~tied[i])
        by = np.lexsort((key, group))
        direct[i] = place[by]
        key, group = key[by], group[by]
        tied[i[1:]] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
    return direct


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes' first ``depth`` bytes at least.

    Two-stage sorting. Suffixes smaller than their successors (type B) are sorted directly by
    their first ``depth`` bytes. All others (type A) start with a byte not below the one after
    it, so they come before the type B suffixes of their bucket and in the order of their
    successors: scanning the buckets upwards and appending each suffix's predecessor to its own
    bucket places them all. Past the end counts as smaller than any byte, so the last suffix is of
    type A. Ties beyond ``depth`` bytes keep any order.

    ``wanted`` flags the places to sort (all by default). A type A place needs its successor, so
    those up to the next type B place are sorted along, and all sorted places are returned.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # Type of a place: that of the next place with another byte.
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    rise = np.append(text[change + 1] > text[change], False)
    upward = np.repeat(rise, np.diff(np.append(-1, ends)))
    if wanted is None:
        needed = np.ones(n, bool)
    else:
        # A place is needed if the last wanted one at or before it has no type B place between.
        place = np.arange(n)
        last_wanted = np.maximum.accumulate(np.where(wanted, place, -1))
        last_b = np.maximum.accumulate(np.where(upward, place, -1))
        before_b = np.concatenate([[-1], last_b[:-1]])
        needed = last_wanted > before_b
        needed |= wanted

    direct = _direct_order(_words8(text), np.flatnonzero(upward & needed), depth)
    cut = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)

    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        heads[int(text[n - 1])].append(np.array([n - 1]))
    order = []
    for c in range(256):
        front = heads[c]
        k = 0
        while k < len(front):  # predecessors with the same byte join this bucket, after those there
            before = front[k] - 1
            before = before[before >= 0]
            before = before[(text[before] == c) & needed[before]]
            if len(before):
                front.append(before)
            k += 1
        if not front and cut[c + 1] == cut[c]:
            continue
        bucket = np.concatenate([*front, direct[cut[c] : cut[c + 1]]])
        order.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[(text[before] > c) & needed[before]]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            at = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(first)]):
                heads[int(first[i])].append(before[i:j])
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``order`` but the first: whether it shares ``length`` bytes with the one before."""
    words = _words8(text)
    a, b = order[:-1], order[1:]
    same = np.maximum(a, b) + length <= len(text)
    for k in [*range(0, length - 7, 8), max(length - 8, 0)]:
        i = np.flatnonzero(same)
        if length >= 8:
            same[i] = words[a[i] + k] == words[b[i] + k]
        else:
            same[i] = (words[a[i]] >> U64(64 - 8 * length)) == (words[b[i]] >> U64(64 - 8 * length))
    return same


# -- anchors and fragments --------------------------------------------------------------------


class _Anchors:
    """The anchor of every window of a block, and the runs of windows with one anchor."""

    def __init__(self, rows: pa.Table, id_col: str, text_col: str, length: int, gram: int):
        self.raw, self.offsets = text_bytes(rows.column(text_col))
        self.ids, self.present = ids_of(rows.column(id_col))
        self.length = length
        n, width = len(self.raw), length - gram + 1
        m = n - length + 1
        if m <= 0:
            self.at = self.lo = self.hi = self.row = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
            return
        # Smallest of each window's grams, by doubling. The low half of the order key is the place,
        # later ones smaller: the last of equals wins, and the minimum tells where it is.
        h = run_hashes(byte_values()[self.raw], gram)
        best, reach = (h & ~LOW32) | (LOW32 - np.arange(len(h), dtype=U64)), 1
        while reach * 2 <= width:
            best = np.minimum(best[: len(best) - reach], best[reach:])
            reach *= 2
        best = np.minimum(best[:m], best[width - reach : width - reach + m]).astype(np.uint32)
        # Runs of windows with one anchor, cut at the rows' first and last windows.
        begin, end = self.offsets[:-1], np.maximum(self.offsets[1:] - length + 1, self.offsets[:-1])
        change = np.flatnonzero(best[1:] != best[:-1]) + 1
        cut = np.unique(np.concatenate([change, np.minimum(begin, m), np.minimum(end, m), [0, m]]))
        lo, hi = cut[:-1], cut[1:] - 1
        row = rows_of(lo, self.offsets)
        ok = self.present[row] & (lo < end[row])
        self.lo, self.hi, self.row = lo[ok], hi[ok], row[ok]
        self.at = np.int64(LOW32) - best[self.lo].astype(np.int64)
        # Anchors are small hashes by choice: spread them again over all shards.
        self.hash = mix(h[self.at])

    def groups(self) -> _Groups:
        return _Groups(self.hash, self.ids[self.row])

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, _Groups]:
        """Starts of all windows of the chosen runs, and the groups of equal ones."""
        lo, n = self.lo[chosen], self.hi[chosen] - self.lo[chosen] + 1
        at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        key = span_hashes(byte_values()[self.raw], at, at + self.length) if len(at) else self.hash[:0]
        return at, _Groups(key, np.repeat(self.ids[self.row[chosen]], n))


class _Fragments:
    """Distinct fragments of the chosen anchors of a block, ordered by anchor hash."""

    def __init__(self, anchors: _Anchors, chosen: np.ndarray):
        a = anchors
        self.lo, self.hi = a.lo[chosen], a.hi[chosen]
        end = self.hi + a.length
        key = span_hashes(byte_values()[a.raw], self.lo, end) if len(self.lo) else a.hash[:0]
        self.ids = a.ids[a.row[chosen]]
        order = np.lexsort([key, a.hash[chosen]])
        k, h = key[order], a.hash[chosen][order]
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(head)
        self.of = np.empty(len(k), np.int64)
        self.of[order] = np.cumsum(head) - 1
        self.hashes = h[at]
        self.key = k[at]
        self.low = np.minimum.reduceat(self.ids[order], at) if len(at) else self.ids
        self.start, self.size = self.lo[order[at]], (end - self.lo)[order[at]]


def _gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(sizes)
    place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - sizes, sizes)
    return raw[np.repeat(starts, sizes) + place]


def _pack(raw, frags: _Fragments, i: int, j: int) -> bytes:
    text = _gather(raw, frags.start[i:j], frags.size[i:j])
    body = pa.Codec("zstd").compress(text.tobytes(), asbytes=True)
    head = np.array([j - i, len(text), len(body)], np.int64).tobytes()
    return head + frags.size[i:j].astype(np.uint16).tobytes() + frags.key[i:j].tobytes() + body + pack_ids(frags.low[i:j])


def _unpack(body):
    view = memoryview(body)
    n, size, packed = map(int, np.frombuffer(view[:24], np.int64))
    sizes = np.frombuffer(view[24 : 24 + 2 * n], np.uint16).astype(np.int64)
    keys = np.frombuffer(view[24 + 2 * n : 24 + 10 * n], U64)
    rest = view[24 + 10 * n :]
    text = np.frombuffer(pa.Codec("zstd").decompress(rest[:packed], size, asbytes=True), np.uint8)
    return sizes, keys, text, unpack_ids(rest[packed:])


def _sizes(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Anchors of a block and in how many of its distinct fragments each is (mostly one)."""
    more = np.flatnonzero(counts > 1)
    return np.int64(len(hashes)).tobytes() + short(hashes) + more.astype(np.uint32).tobytes() + counts[more].astype(np.uint32).tobytes()


def _split_sizes(body) -> tuple[np.ndarray, np.ndarray]:
    view = memoryview(body)
    end = 8 + 4 * int(np.frombuffer(view[:8], np.int64)[0])
    hashes, rest = np.frombuffer(view[8:end], np.uint32), np.frombuffer(view[end:], np.uint32)
    counts = np.ones(len(hashes), np.int64)
    counts[rest[: len(rest) // 2]] = rest[len(rest) // 2 :]
    return hashes, counts


def _twice_and_hot(hot: int):
    def work(_, bodies: list) -> list[bytes]:
        """For each anchor of each body: a bit if another body has it, and a bit if it is hot."""
        parts = [_split_sizes(b) for b in bodies]
        every, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        twice = np.bincount(place, minlength=len(every)) > 1
        large = np.bincount(place, np.concatenate([p[1] for p in parts]), len(every)) > hot
        cut = np.cumsum([0] + [len(p[0]) for p in parts])
        return [bits(twice[place[i:j]]) + bits(large[place[i:j]]) for i, j in zip(cut[:-1], cut[1:])]

    return work


def _halves(body) -> tuple[memoryview, memoryview]:
    view = memoryview(body)
    return view[: len(view) // 2], view[len(view) // 2 :]


def _shard(length: int, width: int):
    def work(_, bodies: list) -> list[bytes]:
        """For each fragment of each body: a bit for each of its windows that a smaller id has."""
        if np.frombuffer(memoryview(bodies[0])[:8], np.int64)[0] == WINDOWS:
            return smaller_elsewhere(_, [memoryview(b)[8:] for b in bodies])
        parts = [_unpack(b) for b in bodies]
        sizes, keys, low = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3))
        text = np.concatenate([p[2] for p in parts])
        begin = np.cumsum(sizes) - sizes
        _, one, of = np.unique(keys, return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, of, low)
        # Distinct fragments in one text, each closed by a zero; bytes of UTF-8 are below 0xFF.
        own = sizes[one] + 1
        start = np.cumsum(own) - own
        joined = np.zeros(int(own.sum()), np.uint8)
        into = np.ones(len(joined), bool)
        into[start + sizes[one]] = False
        joined[into] = _gather(text, begin[one], sizes[one]) + 1
        span = np.repeat(sizes[one] - length + 1, own)
        room = np.arange(len(joined)) - np.repeat(start, own) < span
        order = suffix_array(joined, length, room)
        order = order[room[order]]  # suffixes with a whole window
        same = adjacent_prefixes(joined, order, length)
        cls = np.concatenate([[0], np.cumsum(~same)]) if len(order) else order
        owner = np.repeat(np.arange(len(one)), own)[order]
        best = np.full(int(cls[-1]) + 1 if len(cls) else 0, np.iinfo(np.int64).max)
        np.minimum.at(best, cls, least[owner])
        smallest = np.zeros(len(joined), np.int64)
        smallest[order] = best[cls]
        # windows of every fragment that was asked, in order
        count = sizes - length + 1
        k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        less = smallest[np.repeat(start[of], count) + k] < np.repeat(low, count)
        cut = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0] + [len(p[0]) for p in parts])]
        return [np.packbits(less[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:])]

    return work


def remove_repeated_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts under a smaller id.

    Returns the columns of ``docs`` without ``text_col``, then ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept`` (the remaining bytes, binary) and
    ``kept_sha256`` (spare names where ``docs`` has these already).
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must be between 8 and length")
    blocks = write_blocks(docs, text_col, BLOCK_BYTES)
    shards = shard_count(blocks)

    def first(block, rows):
        anchors = _Anchors(rows, id_col, text_col, length, gram)
        hashes, counts = np.unique(_Fragments(anchors, np.arange(len(anchors.at))).hashes, return_counts=True)
        return pieces(block, hashes, shards, lambda i, j: _sizes(hashes[i:j], counts[i:j]))

    def fragments(block, rows, bodies):
        anchors = _Anchors(rows, id_col, text_col, length, gram)
        groups = anchors.groups()
        sizes, said = asked_sizes(groups.hashes, shards), [_halves(b) for b in bodies]
        elsewhere, large = (unbits([x[k] for x in said], sizes) for k in (0, 1))
        repeated = elsewhere | (groups.low < groups.high)
        chosen, split = (repeated & ~large)[groups.of], (repeated & large)[groups.of]
        frags = _Fragments(anchors, np.flatnonzero(chosen))
        flags = bits(chosen) + bits(split)
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([STATE], pa.int32()), "block": pa.array([block], pa.int64()), "body": pa.array([flags], pa.binary())}
        )
        yield pieces(block, frags.hashes, shards, lambda i, j: _pack(anchors.raw, frags, i, j))
        if split.any():
            _, alone = anchors.windows(np.flatnonzero(split))
            mark = np.int64(WINDOWS).tobytes()
            asks = pieces(block, alone.hashes, shards, lambda i, j: mark + hashes_and_ids(alone.hashes[i:j], alone.low[i:j]))
            shard = pa.array(asks.column("shard").to_numpy() + np.int32(shards), pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *asks.columns[1:]], names=asks.schema.names)

    found = answer(ask(blocks, first), _twice_and_hot(hot))
    asked = materialise(meet(blocks, found, fragments, ASK), "fragments")
    release(docs.sparkSession)
    answers = _with_state(asked, answer(_asked(asked), _shard(length, length - gram + 1)))

    carried = [f for f in docs.schema if f.name != text_col]
    names = [f.name for f in carried]
    new = [spare_name(x, docs.columns) for x in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.StringType()]
    schema = T.StructType([*carried, *(T.StructField(n, k) for n, k in zip(new, kinds))])

    def use(block, rows, bodies):
        anchors = _Anchors(rows, id_col, text_col, length, gram)
        chosen, split = (unbits([x], [len(anchors.at)]) for x in _halves(bodies[0]))
        frags = _Fragments(anchors, np.flatnonzero(chosen))
        count = frags.size - length + 1
        cut = bounds(frags.hashes, shards)
        total = np.concatenate([[0], np.cumsum(count)])
        sizes = total[cut[1:]] - total[cut[:-1]]
        sizes = sizes[sizes > 0]
        less = unbits(bodies[1:], sizes)
        # windows of every occurrence: gone with a smaller id in this block, or elsewhere
        n = (frags.hi - frags.lo + 1) if len(frags.lo) else frags.lo
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        gone = less[np.repeat(total[frags.of], n) + k] if len(less) else np.zeros(len(k), bool)
        gone |= np.repeat(frags.ids > frags.low[frags.of], n) if len(n) else False
        starts = (np.repeat(frags.lo, n) + k)[gone]
        if split.any():  # the windows of hot anchors, asked one by one
            split = np.flatnonzero(split)
            at, alone = anchors.windows(split)
            less = unbits(bodies[1 + len(sizes) :], asked_sizes(alone.hashes, shards))
            own = np.repeat(anchors.ids[anchors.row[split]], anchors.hi[split] - anchors.lo[split] + 1)
            starts = np.concatenate([starts, at[less[alone.of] | (own > alone.low[alone.of])]])
        lost = covered(starts, length, len(anchors.raw))
        sums = np.concatenate([[0], np.cumsum(lost)])[anchors.offsets]
        head = lost.copy()
        head[1:] &= ~lost[:-1]
        edge = anchors.offsets[:-1]
        edge = edge[edge < len(lost)]
        head[edge] = lost[edge]
        spans = np.concatenate([[0], np.cumsum(head)])[anchors.offsets]
        left, at = anchors.raw[~lost].tobytes(), anchors.offsets - sums
        kept = [left[i:j] for i, j in zip(at[:-1], at[1:])]
        made = [
            pa.array(np.diff(anchors.offsets), pa.int64()),
            pa.array(np.diff(sums), pa.int64()),
            pa.array(np.diff(spans), pa.int64()),
            pa.array(kept, pa.binary()),
            pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*(_one(rows.column(x)) for x in names), *made], names=[*names, *new])

    return meet(blocks, answers, use, schema)
