"""Operator 12: vector code compression (product quantisation) in integers, by Walsh-Hadamard transform.

A vector's components become integers ``floor(scale * x)``, and the vector is cut into equal parts; each
part is stored as the index of its nearest entry in a codebook of that part position. Codebooks start
from the vectors of the smallest ids and are improved by rounds of assignment and mean (floor of the
sum over the count).

Nearest entries are found by elimination in the transformed space. Parts and entries are padded with
zeros to a power of two ``D`` and multiplied by the Hadamard matrix, whose rows are in the order of
their sign changes (sequency); the squared distance of the transforms is exactly ``D`` times that of the
parts. Squared differences are added coordinate by coordinate: after the first, the entry with the
smallest sum is measured fully, and an entry whose sum so far is above that bound can't be nearest and
goes. All numbers are integers, so ties are exact and go to the lower index.

Spark reads the table once for each assignment. A task keeps one sum and count for each part and entry
(map-side), Spark adds them up, and the codebooks (``entries * dimensions`` integers, whatever the table)
go to the tasks. Nothing else is collected and no vector is shuffled.

Dropped rows: a null vector, null or non-finite components. Vectors of another length than that of the
first entry's vector, and vectors with a component of magnitude ``LIMIT`` or more after scaling (whose
squared distances may not fit 64 bits), keep their row with a null code and error, and do not take part
in codebooks. A length that the parts do not divide is padded with zeros. With fewer vectors than entries
the codebook is shorter. Ties of the smallest ids are broken by the vectors; null ids come last. Repeated
rows count as often as they occur. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.llm.common import materialise, spare_name

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Magnitude of scaled components from which vectors are not coded.
LIMIT = 1 << 30
#: Vectors assigned at a time.
ROWS = 4096


# -- the transform ------------------------------------------------------------------------------------


def sequency(size: int) -> np.ndarray:
    """The rows of the Hadamard matrix of a power of two, ordered by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")


def transformed(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, zero-padded, by sequency: additions only."""
    n, width = parts.shape
    size = 1 << max(width - 1, 0).bit_length()
    x = np.zeros((n, size), parts.dtype)
    x[:, :width] = parts
    step = 1
    while step < size:  # natural order
        pair = x.reshape(n, -1, 2, step)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x[:, sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (ties: the lowest) and the squared distance.

    64-bit integers where they hold every sum, Python's integers beyond.
    """
    n, width = parts.shape
    size = 1 << max(width - 1, 0).bit_length()
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * width * size >= 1 << 62:
        parts, entries = parts.astype(object), entries.astype(object)
    x, e = transformed(parts), transformed(entries)
    total = (x[:, :1] - e[None, :, 0]) ** 2
    guess = total.argmin(axis=1)
    bound = ((x - e[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero((total <= bound[:, None]).astype(bool))
    total = total[row, entry]
    for k in range(1, size):
        total = total + (x[row, k] - e[entry, k]) ** 2
        alive = (total <= bound[row]).astype(bool)
        if not alive.all():
            row, entry, total = row[alive], entry[alive], total[alive]
    # Rows and, within them, entries are in order: the first of the smallest sums is the answer.
    head = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, head) if n else total
    at = np.flatnonzero((total == np.repeat(least, np.diff(np.append(head, len(row))))).astype(bool))
    one = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
    return entry[one], least // size


# -- vectors of a batch ---------------------------------------------------------------------------------


def scaled(column, scale: int = SCALE) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The components of all vectors as ``floor(scale * x)`` (0 where that is ``LIMIT`` or more), the
    vectors' offsets, and flags of the vectors that can be coded."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(size))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)  # the scale is a power of two: exact
        large = ~(np.abs(x) < LIMIT)
    count = np.append(0, np.cumsum(large))
    x = np.where(large, 0, x).astype(np.int64)
    return x, offsets, count[offsets[1:]] == count[offsets[:-1]]


def kept(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and whole: no null and no non-finite component."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _matrix(x: np.ndarray, offsets: np.ndarray, fit: np.ndarray, parts: int, length: int) -> np.ndarray:
    """The vectors flagged ``fit``, as (vector, part, position), zero-padded."""
    width = -(-length // parts)
    out = np.zeros((int(fit.sum()), parts * width), np.int64)
    at = offsets[:-1][fit]
    out[:, :length] = x[at[:, None] + np.arange(length)]
    return out.reshape(len(out), parts, width)


class Codebooks:
    """Entries by part: ``(part, entry, position)`` integers, and the vectors' length."""

    def __init__(self, entries: np.ndarray, length: int):
        self.entries, self.length = entries, length

    @property
    def sha256(self) -> str:
        """Hex SHA-256 of all entries' decimal components by part, entry and position, comma-joined."""
        parts, width = self.entries.shape[0], self.entries.shape[2]
        flat = self.entries
        if parts * width != self.length:  # without the padding of a length that the parts do not divide
            inside = (np.arange(parts * width) < self.length).reshape(parts, 1, width)
            flat = flat[np.broadcast_to(inside, flat.shape)]
        return hashlib.sha256(",".join(map(str, flat.ravel().tolist())).encode()).hexdigest()

    def assign(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each part and its squared distance, as (vector, part)."""
        found = [nearest(matrix[:, p], self.entries[p]) for p in range(len(self.entries))]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _slices(batch: pa.RecordBatch):
    for i in range(0, batch.num_rows, ROWS):
        yield batch.slice(i, min(ROWS, batch.num_rows - i))


# -- Spark ------------------------------------------------------------------------------------------


def fit(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks | None:
    """Codebooks learned from all vectors; None without a vector that can be coded."""
    rows = kept(df, vector_col).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    small = F.forall("v", lambda x: F.abs(x) < float(LIMIT // SCALE))
    able = rows.filter(small & (F.size("v") > 0))
    # Ids alone find how far the smallest reach; only vectors up to there are sorted.
    found = able.agg(F.count("*").alias("n"), F.min("i").alias("low")).first()
    if not found["n"]:
        return None
    same = F.col("i").eqNullSafe(F.lit(found["low"]).cast("long"))
    length = len(able.filter(same).orderBy("v").limit(1).first()["v"])
    able = able.filter(F.size("v") == length)
    top = able.select("i").orderBy(F.col("i").asc_nulls_last()).limit(entries)
    top = top.agg(F.max("i").alias("high"), F.count("*").alias("n"), F.count("i").alias("n_ids")).first()
    reach = F.col("i") <= F.lit(top["high"]).cast("long")
    if top["n"] > top["n_ids"]:  # too few ids: rows without one come last
        reach = F.coalesce(reach, F.lit(False)) | F.col("i").isNull()
    first = able.filter(reach).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    x, offsets, whole = scaled(first.column("v"))
    books = Codebooks(np.ascontiguousarray(_matrix(x, offsets, whole, parts, length).transpose(1, 0, 2)), length)
    width = books.entries.shape[2]

    def learn(books: Codebooks):
        def run(batches):
            total = np.zeros(books.entries.shape, np.int64)
            count = np.zeros(books.entries.shape[:2], np.int64)
            for whole in batches:
                for batch in _slices(whole):
                    x, offsets, able = scaled(batch.column("v"))
                    matrix = _matrix(x, offsets, able & (np.diff(offsets) == length), parts, length)
                    code, _ = books.assign(matrix)
                    for p in range(parts):
                        np.add.at(total[p], code[:, p], matrix[:, p])
                        count[p] += np.bincount(code[:, p], minlength=count.shape[1])
            part, entry = np.nonzero(count)
            made = {"part": part, "entry": entry, "n": count[part, entry]}
            made |= {f"s{k}": total[part, entry, k] for k in range(width)}
            yield pa.RecordBatch.from_pydict({c: pa.array(a, pa.int64()) for c, a in made.items()})

        return run

    schema = ", ".join(f"{c} long" for c in ("part", "entry", "n", *(f"s{k}" for k in range(width))))
    for _ in range(rounds):
        summed = rows.select("v").mapInArrow(learn(books), schema).groupBy("part", "entry")
        summed = summed.agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{k}" for k in range(width))))).toArrow()
        column = {c: summed.column(c).to_numpy() for c in summed.column_names}
        new = books.entries.copy()
        for k in range(width):
            new[column["part"], column["entry"], k] = column[f"s{k}"] // column["n"]
        books = Codebooks(new, length)
    return books


def encode(df: DataFrame, books: Codebooks | None, vector_col: str = "embedding") -> DataFrame:
    """The kept rows of ``df`` without their vector, with ``code`` (two hex digits for each part) and
    ``error`` (squared distance to the entries, summed over parts; null where it does not fit 64 bits)."""
    others = [c for c in df.columns if c != vector_col]
    code_col = spare_name("code", others)
    error_col = spare_name("error", [*others, code_col])
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(code_col, T.StringType()), T.StructField(error_col, T.LongType())])
    digits = np.array([f"{k:02x}" for k in range(256)], "S2")

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                n = batch.num_rows
                code, error = np.full(n, None, object), np.zeros(n, np.int64)
                missing = np.ones(n, bool)
                if books is not None:
                    parts, length = len(books.entries), books.length
                    x, offsets, able = scaled(batch.column(vector_col))
                    able &= np.diff(offsets) == length
                    found, distance = books.assign(_matrix(x, offsets, able, parts, length))
                    at = np.flatnonzero(able)
                    if len(at):
                        code[at] = np.ascontiguousarray(digits[found]).view(f"S{2 * parts}").ravel().astype(str).astype(object)
                        total = distance.sum(axis=1)
                        fits = (total < 1 << 63).astype(bool)
                        error[at[fits]] = total[fits].astype(np.int64)
                        missing[at[fits]] = False
                made = [pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=missing)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=schema.names)

    return kept(df, vector_col).select(*others, vector_col).mapInArrow(run, schema)


def with_group_error(coded: DataFrame, group_col: str, error_col: str = "error", name: str = "label_error") -> DataFrame:
    """``coded`` with the errors summed over equal values of ``group_col`` (nulls together).

    One row for each value meets the vectors in a join that Spark plans by the sums' measured size;
    adaptive execution splits a value that holds many rows.
    """
    name = spare_name(name, coded.columns)
    key, value = spare_name("_group", coded.columns), spare_name("_sum", coded.columns)
    sums = coded.groupBy(F.col(group_col).alias(key)).agg(F.sum(error_col).alias(value))
    joined = coded.join(sums, coded[group_col].eqNullSafe(sums[key]), "left")
    return joined.select(*coded.columns, F.col(value).alias(name))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", **options) -> tuple[DataFrame, Codebooks | None]:
    """Fit codebooks on all of ``df`` and encode it; codes are written once, for their two readers."""
    books = fit(df, id_col, vector_col, **options)
    coded = materialise(encode(df, books, vector_col), "vector-codes")
    return with_group_error(coded, group_col), books
