"""Operator 5: language model scores by context-tree weighting over bytes.

Each byte is predicted bit by bit (255 binary nodes for each context); contexts are the last 0 to 4
bytes. Every node of every context keeps a Krichevsky-Trofimov estimate of its bits, and all depths
are mixed with context-tree weights: a context's weighted probability is half its own estimate and
half the product over its longer contexts. The trained tree is frozen, so the probability of a byte
depends on the five-byte string (context and byte) alone, and a text's score is a sum over its
strings, its end included. Texts start in a context of four start marks.

Corpus counts travel packed by blocks: each block sends its distinct five-byte strings with their
training counts to the shard of the whole string's hash, where they are summed over the blocks. From
there each string goes once to the shard of its two latest context bytes, where the tree below is
built (at most 2**24 strings a context, whatever the corpus and its blocks); the answers take the
same two steps back. The two top levels have at most 65,280 nodes
and are summed by Spark. Strings that occur only in held-out texts enter with a count of zero, so
every string that is asked for has its node. Words are counted the same way for the unigram base.

Lower-cases A-Z. A null text is empty: it has the end alone. Without training texts all counts are
zero. Rows are scored one by one; rows that repeat score alike; the learning rows are those with a
false ``held_col``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywatch.llm.blocks import ASK, ANSWER, bounds, meet, rows_in, shard_count, write_blocks
from skywatch.llm.common import LOWER, SPACED, U64, find_words, materialise, mix, release, text_bytes, word_hashes

DEPTH = 4
BLOCK_BYTES = 2 << 20
SLICE = 1 << 17
MARK = 0xFF  # never a byte of UTF-8: start and end of a text
GRAMS, WORDS = 0, 1
STATS = -1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a bit string with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def strings(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The five-byte string that ends at each byte or end of each text, and each text's first.

    Packed latest context byte first: ``c1 c2 c3 c4 byte``, so that a shorter context is a prefix.
    """
    size = np.diff(offsets)
    rows = len(size)
    ends = np.arange(1, rows + 1) * (DEPTH + 1) + offsets[1:] - 1
    inside = np.ones(len(raw) + rows * (DEPTH + 1), bool)
    for k in range(DEPTH):
        inside[ends - size - DEPTH + k] = False
    at = np.flatnonzero(inside)
    inside[ends] = False
    line = np.full(len(inside), MARK, np.uint8)
    line[inside] = LOWER[raw]
    packed = np.empty(len(at), U64)
    for i in range(0, len(at), SLICE):  # in slices, so that no wide copy of a whole block arises
        place = at[i : i + SLICE]
        part = line[place].astype(U64)
        for k in range(1, DEPTH + 1):
            part |= line[place - k].astype(U64) << U64(8 * (DEPTH + 1 - k))
        packed[i : i + SLICE] = part
    return packed, offsets + np.arange(rows + 1)


def shard_key(packed: np.ndarray) -> np.ndarray:
    """Sorts by shard first: 24 mixed bits of the two latest context bytes, then the string."""
    return ((mix(packed >> U64(24)) >> U64(40)) << U64(40)) | packed


def string_key(packed: np.ndarray, shards: int) -> np.ndarray:
    """Sorts by shard first (a power of two): high bits of the mixed string, then the string."""
    high = U64(64 - (shards.bit_length() - 1))
    return ((mix(packed) >> high) << high) | packed


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs; sorts ``keys`` in place."""
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs where ``learn`` holds."""
    known, n = _runs(keys[learn])
    other, _ = _runs(keys[~learn])
    if not len(other):
        return known, n
    every = np.union1d(known, other)
    total = np.zeros(len(every), np.int64)
    total[np.searchsorted(every, known)] = n
    return every, total


def _squeeze(values: np.ndarray) -> bytes:
    data = np.ascontiguousarray(values).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _expand(body, kind) -> np.ndarray:
    view = memoryview(body)
    size = int.from_bytes(view[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(view[8:], size, asbytes=True), kind)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    first = _squeeze(np.diff(keys, prepend=U64(0)))
    return len(first).to_bytes(8, "little") + first + _squeeze(counts.astype(np.uint32))


def _unpack(body) -> tuple[np.ndarray, np.ndarray]:
    view = memoryview(body)
    n = int.from_bytes(view[:8], "little")
    return np.cumsum(_expand(view[8 : 8 + n], U64), dtype=U64), _expand(view[8 + n :], np.uint32)


# -- the tree ---------------------------------------------------------------------------------------


def _bits(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight binary nodes (1 to 255) on the way to each byte, and the bit taken at each."""
    k = np.arange(8, dtype=np.uint16)
    byte = byte.astype(np.uint16)[:, None]
    return ((1 << k) | (byte >> (8 - k))).astype(np.uint8), ((byte >> (7 - k)) & 1).astype(np.uint8)


class Level:
    """Nodes of all contexts of one depth: counts, own estimate and weighted probability (logs)."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.key, self.zeros, self.ones = key, zeros, ones
        self.own = log_kt(zeros, ones)
        self.weighted = self.own if below is None else np.logaddexp(self.own, below) + math.log(0.5)
        self.share = np.exp(np.minimum(0.0, math.log(0.5) + self.own - self.weighted)) if below is not None else np.ones(len(key))

    def estimate(self, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return (np.where(bit == 1, self.ones[node], self.zeros[node]) + 0.5) / (self.zeros[node] + self.ones[node] + 1.0)


def shorter(level: Level, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums for the contexts without their earliest byte: key, place of each node, counts, products."""
    key = ((level.key >> U64(8 + 8 * drop)) << U64(8)) | (level.key & U64(0xFF))
    key, place = np.unique(key, return_inverse=True)
    sums = [np.bincount(place, x, len(key)) for x in (level.zeros, level.ones, level.weighted)]
    return key, place, *sums


class Branch:
    """The tree below contexts of two bytes, from distinct strings and their counts."""

    def __init__(self, packed: np.ndarray, counts: np.ndarray):
        node, self.bit = _bits(packed & U64(0xFF))
        key = ((packed >> U64(8))[:, None] << U64(8)) | node.astype(U64)
        key, place = np.unique(key, return_inverse=True)
        place = place.reshape(node.shape)
        ones, total = np.zeros(len(key)), np.zeros(len(key))
        for k in range(8):
            ones += np.bincount(place[:, k], counts * self.bit[:, k], len(key))
            total += np.bincount(place[:, k], counts, len(key))
        self.levels, self.places = [Level(key, total - ones, ones, None)], [place]
        for _ in range(2):  # contexts of three and two bytes
            key, up, zeros, ones, below = shorter(self.levels[-1], 1)
            self.levels.append(Level(key, zeros, ones, below))
            self.places.append(up[self.places[-1]])

    def top(self):
        """Sums of the two-byte contexts for the one-byte contexts: key, counts, products."""
        key, _, zeros, ones, below = shorter(self.levels[-1], 1)
        return key, zeros, ones, below

    def log10(self, crown: "Crown") -> np.ndarray:
        """log10 of the probability of each string's byte after its context."""
        p = self.levels[0].estimate(self.places[0], self.bit)
        for level, place in zip(self.levels[1:], self.places[1:]):
            share = level.share[place]
            p = share * level.estimate(place, self.bit) + (1 - share) * p
        key = self.levels[-1].key[self.places[-1]]
        latest, node = (key >> U64(16)).astype(np.int64), (key & U64(0xFF)).astype(np.int64)
        for share, zeros, ones, at in ((*crown.one, latest * 256 + node), (*crown.none, node)):
            own = (np.where(self.bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
            p = share[at] * own + (1 - share[at]) * p
        return np.log10(p).sum(axis=1)


class Crown:
    """The contexts of one byte and of none: weights and counts by ``byte * 256 + node``."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        one = Level(key, zeros, ones, below)
        key, _, zeros, ones, below = shorter(one, 1)
        self.one, self.none = self._spread(one, 1 << 16), self._spread(Level(key, zeros, ones, below), 1 << 8)

    @staticmethod
    def _spread(level: Level, size: int):
        out = [np.full(size, 0.5), np.zeros(size), np.zeros(size)]
        for table, values in zip(out, (level.share, level.zeros, level.ones)):
            table[level.key.astype(np.int64)] = values
        return out


# -- Spark ------------------------------------------------------------------------------------------

STRING = U64((1 << 40) - 1)
SUMS = "origin int, shard int, body binary"


def _plain(packed: np.ndarray, counts: np.ndarray) -> bytes:
    """Few strings and counts: packing would cost more than it saves."""
    return packed.tobytes() + counts.astype(np.int64).tobytes()


def _joined(bodies: list) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Strings and counts of all bodies (each string is in one of them), and the bodies' sizes."""
    parts = [np.frombuffer(b, U64).reshape(2, -1) for b in bodies]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64), [p.shape[1] for p in parts]


def _merged(bodies: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a shard and their counts over all bodies."""
    parts = [_unpack(b) for b in bodies]
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)


def score(docs: DataFrame, held_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, held flag, ``n_bytes, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte``. Rows with a true ``held_col`` are scored but not learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.coalesce(F.col(held_col), F.lit(False)).alias("h"))
    blocks = write_blocks(rows, "t", BLOCK_BYTES)
    shards = 1 << max((shard_count(blocks) - 1).bit_length(), 1)  # a power of two: no context is split

    def load(rows):
        raw, offsets = text_bytes(rows.column("t"))
        held = rows.column("h").to_numpy()
        packed, first = strings(raw, offsets)
        starts, ends, first_word = find_words(LOWER[raw], offsets, SPACED)
        return held, np.diff(offsets), packed, first, word_hashes(LOWER[raw], starts, ends), first_word

    def question(block, rows):
        held, _, packed, first, words, first_word = load(rows)
        shard, body = [], []
        for kind, keys, begin in ((GRAMS, string_key(packed, shards), first), (WORDS, words, first_word)):
            keys, n = counted(keys, np.repeat(~held, np.diff(begin)))
            cut = bounds(keys, shards)
            for k in np.flatnonzero(cut[1:] > cut[:-1]):
                shard.append(kind * shards + int(k))
                body.append(_pack(keys[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]))
        learned = ~held
        shard.append(STATS)
        body.append(np.array([learned.sum(), np.diff(first_word)[learned].sum()], np.int64).tobytes())
        return pa.RecordBatch.from_pydict(
            {"shard": pa.array(shard, pa.int32()), "block": pa.array([block] * len(shard), pa.int64()), "body": pa.array(body, pa.binary())}
        )

    def ask_all(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                yield question(block, rows_in(body.as_buffer()))

    asked = materialise(blocks.mapInArrow(ask_all, ASK), "counts")
    release(spark)

    # Each string once, with its sum over all blocks, on the way to the shard of its context.
    def merge(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys, n = _merged([b.as_buffer() for b in group.column("body")])
        packed = keys & STRING
        order = np.argsort(shard_key(packed))
        packed, n = packed[order], n[order]
        cut = bounds(shard_key(packed), shards)
        some = np.flatnonzero(cut[1:] > cut[:-1])
        body = [_plain(packed[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]) for k in some]
        origin = np.full(len(some), group.column("shard")[0].as_py(), np.int32)
        return pa.table({"origin": pa.array(origin), "shard": pa.array(some.astype(np.int32)), "body": pa.array(body, pa.binary())})

    sums = asked.filter((F.col("shard") >= 0) & (F.col("shard") < shards)).groupBy("shard").applyInArrow(merge, SUMS)
    sums = materialise(sums, "sums")
    release(spark)

    # The crown of the tree: sums over all shards, bounded by 256 x 255 nodes.
    def trunk(group: pa.Table) -> pa.Table:
        packed, n, _ = _joined([b.as_buffer() for b in group.combine_chunks().column("body")])
        key, zeros, ones, below = Branch(packed, n).top()
        return pa.table({"k": pa.array(key.astype(np.int64)), "zeros": pa.array(zeros), "ones": pa.array(ones), "below": pa.array(below)})

    nodes = sums.groupBy("shard").applyInArrow(trunk, "k long, zeros double, ones double, below double")
    nodes = nodes.groupBy("k").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    crown_rows = nodes.orderBy("k").toArrow()
    column = [crown_rows.column(c).to_numpy() for c in ("k", "zeros", "ones", "below")]
    crown = Crown(column[0].astype(U64), *column[1:])
    release(spark)

    def values(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        packed, n, sizes = _joined([b.as_buffer() for b in group.column("body")])
        value = Branch(packed, n).log10(crown).astype(np.float32)
        cut = np.cumsum([0, *sizes])
        body = [value[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
        return pa.table({"origin": group.column("origin"), "shard": group.column("shard"), "body": pa.array(body, pa.binary())})

    known = materialise(sums.groupBy("shard").applyInArrow(values, SUMS), "values")
    release(spark)

    # Back at the shard of the whole string: to each block its strings' values, or its words' counts.
    def work(group: pa.Table, found: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shard = group.column("shard")[0].as_py()
        bodies = [b.as_buffer() for b in group.column("body")]
        keys, n = _merged(bodies)
        block, out = group.column("block").to_pylist(), []
        if shard < shards:
            found = found.sort_by("shard").combine_chunks()
            value = np.empty(len(keys), np.float32)
            value[np.argsort(shard_key(keys & STRING))] = np.concatenate([np.frombuffer(b.as_buffer(), np.float32) for b in found.column("body")])
        else:
            value = n.astype(np.uint32)
        for body in bodies:
            out.append(_squeeze(value[np.searchsorted(keys, _unpack(body)[0])]))
        block.append(-1)  # how many of the shard's keys were learned
        out.append(np.int64(np.count_nonzero(n) if shard >= shards else 0).tobytes())
        return pa.table(
            {"block": pa.array(block, pa.int64()), "shard": pa.array([shard] * len(block), pa.int32()), "body": pa.array(out, pa.binary())}
        )

    back = asked.filter(F.col("shard") >= 0).groupBy("shard").cogroup(known.groupBy("origin"))
    answers = materialise(back.applyInArrow(work, ANSWER), "answers")
    release(spark)

    def number(df: DataFrame, n: int) -> list[int]:
        def run(batches):
            for batch in batches:
                found = [np.frombuffer(b.as_buffer(), np.int64) for b in batch.column("body")]
                yield pa.RecordBatch.from_pydict({f"x{k}": pa.array([int(f[k]) for f in found], pa.int64()) for k in range(n)})

        row = df.mapInArrow(run, ", ".join(f"x{k} long" for k in range(n))).agg(*(F.sum(f"x{k}") for k in range(n))).first()
        return [int(x or 0) for x in row]

    train_docs, train_words = number(asked.filter(F.col("shard") == STATS), 2)
    (distinct,) = number(answers.filter(F.col("block") < 0), 1)
    tokens = train_words + train_docs
    distinct += train_docs > 0
    floor = math.log10(tokens + 0.1 * (distinct + 1))
    end_score, end_known = math.log10(train_docs + 0.1), int(train_docs > 0)

    schema = "i long, h boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"

    def use(block, rows, bodies):
        held, n_bytes, packed, first, words, first_word = load(rows)
        keys = np.unique(string_key(packed, shards))
        n_grams = int((np.diff(bounds(keys, shards)) > 0).sum())
        value = np.concatenate([_expand(b, np.float32) for b in bodies[:n_grams]])
        logs = np.zeros(len(packed) + 1)
        for i in range(0, len(packed), SLICE):
            part = packed[i : i + SLICE]
            logs[i + 1 : i + 1 + len(part)] = value[np.searchsorted(keys, string_key(part, shards))]
        np.cumsum(logs, out=logs)
        total = logs[first[1:]] - logs[first[:-1]]
        known, base = np.zeros(len(held), np.int64), np.zeros(len(held))
        if len(words):
            vocabulary = np.unique(words)
            count = np.concatenate([_expand(b, np.uint32) for b in bodies[n_grams:]])[np.searchsorted(vocabulary, words)]
            some = np.flatnonzero(np.diff(first_word))
            base[some] = np.add.reduceat(np.log10(count + 0.1), first_word[some])
            known[some] = np.add.reduceat((count > 0).astype(np.int64), first_word[some])
        n_tokens = np.diff(first_word) + 1
        made = [
            rows.column("i").cast(pa.int64()).combine_chunks(),
            pa.array(held, pa.bool_()),
            pa.array(n_bytes, pa.int64()),
            pa.array(n_tokens, pa.int64()),
            pa.array(known + end_known, pa.int64()),
            pa.array(base + end_score - n_tokens * floor, pa.float64()),
            pa.array(total, pa.float64()),
        ]
        made = [m.chunk(0) if isinstance(m, pa.ChunkedArray) else m for m in made]
        yield pa.RecordBatch.from_arrays(made, names=["i", "h", "n_bytes", "n_tokens", "n_known", "base_score", "score"])

    out = meet(blocks, answers.filter(F.col("block") >= 0), use, schema)
    return out.select(
        F.col("i").alias(id_col), F.col("h").alias(held_col), "n_bytes", "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
