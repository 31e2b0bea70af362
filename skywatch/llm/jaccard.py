"""Operator 8: n-gram Jaccard join by parity sketches.

A document's set are its distinct hashed five-word shingles. A set of size *a* is sketched for its
size band (sizes from 2**g to below 2**(g+1); also for the next band, if a partner there is
possible): each shingle flips one bit of a long bit vector, which is cut into blocks. The Hamming
distance of two sketches is a lower bound of the symmetric difference, so two sets with Jaccard
similarity of at least p/q differ in at most ``t = (a + b) * (q - p) / (q + p)`` blocks. By
pigeonhole a set with more than t non-empty blocks shares a non-empty block with every partner, and
if all sets order their blocks alike, one of its first t + 1. Blocks are ordered by how many
documents hold them, rarest first, so blocks of common lines and passages come last and blocks held
by one document alone cost nothing. (The few sets without more than t non-empty blocks also meet
each other by a prefix of their shingles.) Candidates are verified on the whole sets.

Links within a group of candidates: all members are compared with one, links merge into components,
and only members still in different components are then compared with each other, if the Hamming
distance of a second, short sketch allows. So no link between components is lost, and a group of
copies costs its size, not its square. Equal sets are one
node throughout.

A null text, or one without words, has an empty set and no links; a text of fewer than five words
has one shingle, the whole sequence. Rows that repeat link to each other. A null id is never
another row's component id. Equality of sets and shingles is that of 128-bit and 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.llm.blocks import ASK, answer, ask, asked_sizes, meet, message, pieces, rows_in, shard_count, write_blocks
from skywatch.llm.common import (
    LOWER,
    SPACED,
    U64,
    find_words,
    ids_of,
    materialise,
    mix,
    release,
    rows_of,
    span_hashes,
    text_bytes,
    window_starts,
    word_hashes,
)
from skywatch.llm.components import components

SHINGLE = 5
THRESHOLD = (3, 4)
DOCS, TEXT = -1, -2
#: Bits of the short sketch that is compared before whole sets are.
SHORT_BITS = 1024
LOW32 = U64(0xFFFFFFFF)


class ShingleSets:
    """Distinct shingles of each text, sorted within the text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
        raw = LOWER[raw]
        starts, ends, first = find_words(raw, offsets, SPACED)
        words = word_hashes(raw, starts, ends)
        at = window_starts(first, shingle)
        n = np.diff(first)
        few = np.flatnonzero((n > 0) & (n < shingle))
        begin = np.concatenate([at, first[few]])
        end = np.concatenate([at + shingle, first[few + 1]])
        h = span_hashes(words, begin, end)
        row = rows_of(begin, first)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hash, self.row = h[head], row[head]
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.size = np.diff(self.first)

    def parities(self, bits: int) -> np.ndarray:
        """A short sketch of each set: the parity of its shingles on each of ``bits`` bits, as numbers."""
        rows = len(self.size)
        cell = self.row * bits + (self.hash >> U64(17)).astype(np.int64) % bits
        odd = (np.bincount(cell, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
        return np.packbits(odd, axis=1).view(np.int64)

    def digests(self) -> np.ndarray:
        """128 bits of each set, as two columns; zeros for empty sets."""
        out = np.zeros((len(self.size), 2), U64)
        some = np.flatnonzero(self.size)
        if len(some):
            out[some, 0] = np.add.reduceat(mix(self.hash), self.first[some])
            out[some, 1] = np.add.reduceat(mix(self.hash ^ U64(0x5851F42D4C957F2D)), self.first[some])
        return out


def _limit(a: np.ndarray, p: int, q: int) -> np.ndarray:
    """The largest symmetric difference of a set of size a and any partner."""
    return (a + a * q // p) * (q - p) // (q + p)


class Sketches:
    """The non-empty blocks of the sketches of the chosen sets: key, set and size band of each."""

    def __init__(self, sets: ShingleSets, rows: np.ndarray, p: int, q: int):
        size = sets.size[rows]
        rows, size = rows[size > 0], size[size > 0]
        band = np.frexp(size.astype(np.float64))[1] - 1  # floor(log2(size))
        next_ = np.flatnonzero(size * q >= p << (band + 1))
        who = np.concatenate([rows, rows[next_]])
        band = np.concatenate([band, band[next_] + 1])
        size = sets.size[who]
        high = (2 << band) - 1
        width = np.maximum(64, 2 * (2 * high * (q - p) // (q + p) + 1))
        # All shingles of all (set, band) pairs; sorted hashes give ascending block numbers.
        entry = np.repeat(np.arange(len(who)), size)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(sets.first[who], size)
        h = sets.hash[place]
        block = ((h >> U64(32)) * width[entry].astype(U64)) >> U64(32)
        flip = mix((h & LOW32) + U64(1))
        head = np.ones(len(h), bool)
        head[1:] = (block[1:] != block[:-1]) | (entry[1:] != entry[:-1])
        at = np.flatnonzero(head)
        parity = np.bitwise_xor.reduceat(flip, at) if len(at) else flip
        entry, block = entry[at], block[at]
        live = parity != 0
        entry, block, parity = entry[live], block[live], parity[live]
        self.key = mix(parity ^ mix((band[entry].astype(U64) << U64(40)) | block))
        self.entry, self.who, self.size = entry, who, size

    def prefixes(self, order: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of each sketch's first blocks in the given order, and sketches with too few."""
        count = np.bincount(self.entry, minlength=len(self.who))
        # Among equals any order common to all sets will do; one that leaves the keys spread.
        by = np.lexsort((mix(self.key), order, self.entry))
        rank = np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count)
        limit = _limit(self.size, p, q)
        first = by[rank <= limit[self.entry[by]]]
        return first, np.flatnonzero(count <= limit)


def _unique_rows(digest: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first row of each distinct non-empty set."""
    some = np.flatnonzero(size)
    _, one = np.unique(digest[some], axis=0, return_index=True) if len(some) else (None, some)
    return np.sort(some[one])


def _names(digest: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(digest).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digest), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _candidates(asked: DataFrame) -> DataFrame:
    """Groups of sets that share a block: ``g, rep, d``; groups with the same members are one."""

    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_buffer(), U64).reshape(-1, 3) for b in group.combine_chunks().column("body")]
        every = np.concatenate(parts)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        new_key = np.ones(len(every), bool)
        new_key[1:] = every[1:, 0] != every[:-1, 0]
        keep = new_key.copy()
        keep[1:] |= (every[1:, 1:] != every[:-1, 1:]).any(axis=1)
        every, new_key = every[keep], new_key[keep]
        at = np.flatnonzero(new_key)
        size = np.diff(np.append(at, len(every)))
        name = np.add.reduceat(mix(every[:, 1] ^ mix(every[:, 2])), at) if len(at) else every[:, 0]
        _, one = np.unique(name, return_index=True)
        one = one[size[one] > 1]
        place = np.arange(int(size[one].sum())) - np.repeat(np.cumsum(size[one]) - size[one], size[one]) + np.repeat(at[one], size[one])
        return pa.table(
            {
                "g": pa.array(np.repeat(name[one], size[one]).view(np.int64), pa.int64()),
                "rep": _names(np.repeat(every[at[one], 1:], size[one], axis=0)),
                "d": _names(every[place, 1:]),
            }
        )

    return asked.groupBy("shard").applyInArrow(run, "g long, rep binary, d binary")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """The pairs ``u, v`` whose sets have a similarity of at least p/q."""
    one = texts.select(F.col("d").alias("u"), F.col("body").alias("a"))
    two = texts.select(F.col("d").alias("v"), F.col("body").alias("b"))

    def run(batches):
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            i = 0
            while i < len(a):
                held, j = [], i
                total = 0
                while j < len(a) and (j == i or total < 4 << 20):
                    for x in (a[j], b[j]):
                        size = int.from_bytes(x[:8], "little")
                        held.append(pa.Codec("zstd").decompress(x[8:], size, asbytes=True) if size else b"")
                        total += size
                    j += 1
                raw = np.frombuffer(b"".join(held), np.uint8)
                sets = ShingleSets(raw, np.cumsum([0] + [len(x) for x in held]), shingle)
                pair = sets.row // 2
                order = np.lexsort((sets.hash, pair))
                h, pair = sets.hash[order], pair[order]
                both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=j - i)
                union = sets.size[0::2] + sets.size[1::2] - both
                ok = pa.array((q * both >= p * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([u.slice(i, j - i).filter(ok), v.slice(i, j - i).filter(ok)], names=["u", "v"])
                i = j

    joined = pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b")
    return joined.mapInArrow(run, "u binary, v binary")


def _apart(groups: DataFrame, roots: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs ``u, v`` of one group but different components that may be similar enough.

    The Hamming distance of the short sketches bounds the symmetric difference from below, so pairs
    too far apart are never put together.
    """
    apart = groups.join(roots.withColumnRenamed("node", "d"), "d", "left").select("g", "d", F.coalesce("root", "d").alias("root"))
    mixed = apart.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") != F.col("high"))
    apart = materialise(apart.join(mixed.select("g"), "g", "left_semi"), "apart")
    sets = sets.join(apart.select("d").distinct(), "d", "left_semi").dropDuplicates(["d"])
    apart = materialise(apart.join(sets, "d"), "apart")
    other = apart.select("g", *(F.col(c).alias(f"{c}_2") for c in apart.columns if c != "g"))
    distance = F.lit(0)
    for k in range(SHORT_BITS // 64):
        distance = distance + F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}_2")))
    n, n2 = F.col("n"), F.col("n_2")
    near = (q * n >= p * n2) & (q * n2 >= p * n) & ((q + p) * distance <= (q - p) * (n + n2))
    return (
        apart.join(other, "g")
        .filter((F.col("root") < F.col("root_2")) & near)
        .select(F.least("d", "d_2").alias("u"), F.greatest("d", "d_2").alias("v"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    threshold: tuple[int, int] = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The rows as blocks, and for each row ``block, row, id, n_shingles, component, first``.

    ``component`` is the smallest id reachable by links (the row's own if it has none), ``first``
    marks one row of each component, of those with the smallest id; rows without words are all
    first.
    """
    p, q = threshold
    if not q < 2 * p <= 2 * q:
        raise ValueError("threshold must be over 1/2 and at most 1")
    spark = docs.sparkSession
    blocks = write_blocks(docs, text_col)
    shards = shard_count(blocks)

    def load(rows):
        raw, offsets = text_bytes(rows.column(text_col))
        sets = ShingleSets(raw, offsets, shingle)
        digest = sets.digests()
        return raw, offsets, sets, digest, Sketches(sets, _unique_rows(digest, sets.size), p, q)

    def counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and how many sets of the block have each."""
        key = np.sort(key)
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(head)
        return key[at], np.diff(np.append(at, len(key)))

    def question(block, rows):
        key, n = counts(load(rows)[4].key)
        n = np.minimum(n, 255).astype(np.uint8)

        def body(i, j):
            low = (key[i:j] & LOW32).astype(np.uint32)
            return np.int64(j - i).tobytes() + low.tobytes() + pa.Codec("zstd").compress(n[i:j].tobytes(), asbytes=True)

        return pieces(block, key, shards, body)

    def frequencies(_, bodies):
        """For each key of each body: the binary logarithm of how many sets have it."""
        keys, n = [], []
        for body in bodies:
            view = memoryview(body)
            size = int(np.frombuffer(view[:8], np.int64)[0])
            keys.append(np.frombuffer(view[8 : 8 + 4 * size], np.uint32))
            n.append(np.frombuffer(pa.Codec("zstd").decompress(view[8 + 4 * size :], size, asbytes=True), np.uint8))
        every, weight = np.concatenate(keys), np.concatenate(n).astype(np.int64)
        order = np.argsort(every)
        sorted_ = every[order]
        head = np.ones(len(every), bool)
        head[1:] = sorted_[1:] != sorted_[:-1]
        total = np.add.reduceat(weight[order], np.flatnonzero(head))
        level = np.empty(len(every), np.uint8)
        level[order] = (np.frexp(total.astype(np.float64))[1] - 1)[np.cumsum(head) - 1]
        cut = np.cumsum([0] + [len(k) for k in keys])
        return [pa.Codec("zstd").compress(level[i:j].tobytes(), asbytes=True) for i, j in zip(cut[:-1], cut[1:])]

    def use(block, rows, bodies):
        raw, offsets, sets, digest, sketch = load(rows)
        key = counts(sketch.key)[0]
        sizes = asked_sizes(key, shards)
        level = [np.frombuffer(pa.Codec("zstd").decompress(b, int(n), asbytes=True), np.uint8) for b, n in zip(bodies, sizes)]
        level = np.concatenate(level)[np.searchsorted(key, sketch.key)] if level else np.zeros(0, np.uint8)
        first, few = sketch.prefixes(level, p, q)
        first = first[level[first] > 0]
        keys, who = [sketch.key[first]], [sketch.who[sketch.entry[first]]]
        for e in few:  # too few blocks: a prefix of the shingles themselves
            w = sketch.who[e]
            h = sets.hash[sets.first[w] : sets.first[w + 1]]
            h = h[: len(h) - -(-len(h) * p // q) + 1]
            keys.append(mix(h ^ U64(0xD6E8FEB86659FD93)))
            who.append(np.full(len(h), w))
        key, who = np.concatenate(keys), np.concatenate(who).astype(np.int64)
        order = np.argsort(key)
        key, who = key[order], who[order]
        sent = np.column_stack([key, digest[who]]) if len(key) else np.zeros((0, 3), U64)
        ids, present = ids_of(rows.column(id_col))
        table = pa.table(
            {
                "block": pa.array(np.full(len(ids), block), pa.int64()),
                "row": pa.array(np.arange(len(ids)), pa.int64()),
                "id": pa.array(ids, pa.int64(), mask=~present),
                "n_shingles": pa.array(sets.size, pa.int64()),
                "d": _names(digest),
                "short": pa.FixedSizeListArray.from_arrays(pa.array(sets.parities(SHORT_BITS).ravel()), SHORT_BITS // 64).cast(
                    pa.list_(pa.int64())
                ),
            }
        )
        yield _special(DOCS, block, [message(table)])
        wanted = np.unique(who)
        packed = []
        for w in wanted:
            text = raw[offsets[w] : offsets[w + 1]].tobytes()
            packed.append(digest[w].tobytes() + len(text).to_bytes(8, "little") + pa.Codec("zstd").compress(text, asbytes=True))
        yield _special(TEXT, block, packed)
        yield pieces(block, key, shards, lambda i, j: np.ascontiguousarray(sent[i:j]).tobytes())

    level = materialise(meet(blocks, answer(ask(blocks, question), frequencies), use, ASK), "sketches")
    release(spark)

    members = materialise(_unpacked(level.filter(F.col("shard") == DOCS)), "members")
    groups = _candidates(level.filter(F.col("shard") >= 0)).dropDuplicates(["g", "d"])
    groups = materialise(groups, "groups")
    release(spark)
    texts = level.filter(F.col("shard") == TEXT).select(F.substring("body", 1, 16).alias("d"), F.expr("substring(body, 17)").alias("body"))
    texts = texts.dropDuplicates(["d"])
    first = groups.filter(F.col("rep") != F.col("d")).select(F.col("rep").alias("u"), F.col("d").alias("v")).distinct()
    links = materialise(_verified(first, texts, shingle, p, q), "links")
    roots = components(links)

    # Members of one group that are still apart: first in one group of each set, its largest, which
    # joins most of a family, then in all groups with what is left.
    size = groups.groupBy("g").agg(F.count("*").alias("n"))
    largest = groups.select("g", "d").join(size, "g").groupBy("d").agg(F.max(F.struct("n", "g"))["g"].alias("g"))
    sets = members.select("d", F.col("n_shingles").alias("n"), *(F.col("short")[k].alias(f"s{k}") for k in range(SHORT_BITS // 64)))
    tried = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    for some_groups in (largest, groups.select("g", "d")):
        rest = materialise(_apart(some_groups, roots, sets, p, q).join(tried, ["u", "v"], "left_anti"), "pairs")
        more = materialise(_verified(rest, texts, shingle, p, q), "links")
        tried = tried.unionByName(rest)
        if not more.isEmpty():
            roots = components(roots.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(more))
        release(spark)

    some = F.col("n_shingles") > 0
    labelled = members.join(roots.withColumnRenamed("node", "d"), "d", "left").select(
        "block", "row", "id", "n_shingles", F.when(some, F.coalesce("root", "d")).alias("root")
    )
    # Smallest id of a component, rows without an id last.
    place = F.struct(F.col("id").isNull().alias("none"), "id", "block", "row")
    lowest = labelled.filter(some).groupBy("root").agg(F.min(place).alias("low"))
    out = labelled.join(lowest, "root", "left").select(
        "block", "row", "id", "n_shingles",
        F.when(some, F.col("low.id")).otherwise(F.col("id")).alias("component"),
        (~some | ((F.col("low.block") == F.col("block")) & (F.col("low.row") == F.col("row")))).alias("first"),
    )
    return blocks, out


def _special(kind: int, block: int, bodies: list[bytes]) -> pa.RecordBatch:
    n = len(bodies)
    return pa.RecordBatch.from_pydict(
        {"shard": pa.array([kind] * n, pa.int32()), "block": pa.array([block] * n, pa.int64()), "body": pa.array(bodies, pa.binary())}
    )


def _unpacked(packed: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for body in batch.column("body"):
                yield from rows_in(body.as_buffer()).to_batches()

    return packed.mapInArrow(run, "block long, row long, id long, n_shingles long, d binary, short array<long>")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component."""
    blocks, found = near_duplicates(docs, **options)
    kept = materialise(found.filter("first").select("block", "row"), "kept")
    release(docs.sparkSession)
    schema = docs.schema

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return empty
        rows = rows_in(left.combine_chunks().column("body")[0].as_buffer())
        return rows.take(np.sort(right.column("row").to_numpy()))

    return blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(run, schema)
