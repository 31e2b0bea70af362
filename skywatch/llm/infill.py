"""Operator 11: fill-in-middle transformation with a ``pyarrow.compute`` pipeline.

A text is cut into units (code points, words or lines); two cuts drawn from the document's id divide
them into prefix, middle and suffix, which are put together again around three marks:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle,
* ``plain``: the text as it is: an empty text, one that holds a mark, or one left alone by the draw.

Spark draws: the first four 8-digit groups of the hex SHA-256 of ``seed:id`` decide cuts and form, so
that a row's result depends on its id and text alone. Arrow cuts, batch by batch: the units of all rows
are one list array; the list is flattened with its parent indices, each unit's ordinal in its text
tells its role, the units of a role are filtered, built into lists again and joined.

A batch is worked on a bounded piece (``PIECE_BYTES``) at a time. A longer text lies in several pieces,
cut between units; each piece yields its share of prefix, middle and suffix, which are joined by row at
the end. So the memory beside the texts themselves does not depend on their length.

A null text is empty (form ``plain``, output the empty text). A null id draws as the empty id. Rows that
repeat give equal results; extra columns stay, and added names that clash get an underscore.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.llm.common import SPACED, rows_of, spare_name, text_bytes

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNITS = ("char", "word", "line")
#: Bytes of text whose units are in memory at a time.
PIECE_BYTES = 1 << 20


# -- units ------------------------------------------------------------------------------------------


def unit_heads(raw: np.ndarray, unit: str, edge: bool = True) -> np.ndarray:
    """Flags of the bytes at which a unit begins; ``edge``: the first byte begins a text.

    A line keeps its line feed, a word the white space after it; white space before a text's first
    word is a unit of its own.
    """
    if unit == "char":
        return (raw & 0xC0) != 0x80
    head = np.zeros(len(raw), bool)
    if len(raw):
        head[0] = edge
    if unit == "line":
        head[1:] |= raw[:-1] == 0x0A
    else:
        word = SPACED[raw]
        head[1:] |= word[1:] & ~word[:-1]
    return head


def _pieces(raw: np.ndarray, offsets: np.ndarray, unit: str):
    """Runs of whole units of about ``PIECE_BYTES``: first and last byte, head flags of its bytes.

    Every row border is a unit border as well.
    """
    edges = offsets[:-1][np.diff(offsets) > 0]
    low, n = 0, len(raw)
    while low < n:
        high, want = low, PIECE_BYTES
        while True:  # up to the last unit border in reach; further where a unit is longer
            high = min(low + want, n)
            back = max(low - 1, 0)  # a unit border shows in the byte before
            head = unit_heads(raw[back : high + 1], unit, True)[low - back :]
            head[edges[np.searchsorted(edges, low) : np.searchsorted(edges, high, "right")] - low] = True
            if high == n:
                break
            borders = np.flatnonzero(head[1 : high - low + 1])
            if len(borders):
                high = low + 1 + int(borders[-1])
                break
            want *= 2
        yield low, high, head[: high - low]
        low = high


def count_units(raw: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Units of each row."""
    total = np.zeros(len(offsets) - 1, np.int64)
    for low, _, head in _pieces(raw, offsets, unit):
        at = np.flatnonzero(head) + low
        total += np.bincount(rows_of(at, offsets), minlength=len(total))
    return total


# -- the pipeline on one batch ------------------------------------------------------------------------


def cut_three(raw: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str) -> list[pa.Array]:
    """Prefix, middle and suffix of each row: its units before ``first``, before ``second`` and after."""
    rows = len(offsets) - 1
    done = np.zeros(rows, np.int64)  # units of each row in earlier pieces
    parts: list[list[pa.Array]] = [[], [], []]  # strings by role, and
    owner: list[np.ndarray] = []  # the rows they belong to, piece by piece
    for low, high, head in _pieces(raw, offsets, unit):
        at = np.flatnonzero(head)
        row = rows_of(at + low, offsets)
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        here = row[begin]  # the rows that lie in this piece
        texts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, high - low)), pa.py_buffer(raw[low:high]))
        bounds = pa.array(np.append(begin, len(at)), pa.int64())
        lists = pa.LargeListArray.from_arrays(bounds, texts)
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        start = pa.array(begin - done[here], pa.int64())
        ordinal = pc.subtract(pa.array(np.arange(len(at)), pa.int64()), pc.take(start, parent))
        before_first = pc.less(ordinal, pc.take(pa.array(first[here], pa.int64()), parent))
        before_second = pc.less(ordinal, pc.take(pa.array(second[here], pa.int64()), parent))
        roles = (before_first, pc.and_not(before_second, before_first), pc.invert(before_second))
        for strings, role in zip(parts, roles):
            kept = pc.filter(parent, role).to_numpy()
            ends = np.cumsum(np.bincount(kept, minlength=len(here)))
            again = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends), pa.int64()), pc.filter(flat, role))
            strings.append(pc.binary_join(again, pa.scalar("", pa.large_string())))
        owner.append(here)
        done[here] += np.diff(np.append(begin, len(at)))
    if not owner:
        return [pa.array([""] * rows, pa.large_string())] * 3
    size = np.bincount(np.concatenate(owner), minlength=rows)
    bounds = pa.array(np.append(0, np.cumsum(size)), pa.int64())
    # The pieces come in the order of the rows, so each row's strings lie together.
    return [
        pc.binary_join(pa.LargeListArray.from_arrays(bounds, pa.concat_arrays(p)), pa.scalar("", pa.large_string())) for p in parts
    ]


def _check_marks(marks) -> None:
    """No mark may overlap itself or another, or a mark could appear where text and mark meet."""
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different, non-empty marks are needed")
    for a in marks:
        for b in marks:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) or (a != b and a in b):
                raise ValueError(f"marks overlap: {a!r} and {b!r}")


# -- Spark ------------------------------------------------------------------------------------------


def draws(id_col: str, seed: int) -> list[Column]:
    """The four numbers below 2**32 that the id and the seed give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    unit: str = "char",
    seed: int = 1,
    fim_percent: int = 90,
    spm_percent: int = 20,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``docs`` with five more columns: ``n_units``, ``form``, ``prefix_units``, ``middle_units`` (null in
    plain rows) and ``fim``, the transformed text."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    _check_marks(marks)
    added = {}
    for name in ("_h1", "_h2", "_h3", "_h4", "n_units", "form", "prefix_units", "middle_units", "fim"):
        added[name] = spare_name(name, [*docs.columns, *added.values()])
    drawn = docs.select("*", *(h.alias(added[f"_h{k}"]) for k, h in enumerate(draws(id_col, seed), 1)))
    kinds = {"n_units": T.LongType(), "form": T.StringType(), "prefix_units": T.LongType(), "middle_units": T.LongType(), "fim": T.StringType()}
    schema = T.StructType([*docs.schema, *(T.StructField(added[c], k) for c, k in kinds.items())])
    width = len(docs.columns)
    pattern = "|".join(map(re.escape, marks))

    def join(*columns):
        return pc.binary_join_element_wise(*columns, pa.scalar("", pa.large_string()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col).cast(pa.large_string()).fill_null("")
        h = [batch.column(added[f"_h{k}"]).to_numpy() for k in (1, 2, 3, 4)]
        raw, offsets = text_bytes(texts)
        n = count_units(raw, offsets, unit)
        marked = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        plain = (n == 0) | marked | (h[2] % 100 >= fim_percent)
        one, two = h[0] % (n + 1), h[1] % (n + 1)
        first, second = np.minimum(one, two), np.maximum(one, two)
        prefix, middle, suffix = cut_three(raw, offsets, first, second, unit)
        p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
        form = np.where(plain, PLAIN, np.where(h[3] % 100 < spm_percent, SPM, PSM))
        role = pa.array(np.where(plain, 0, np.where(form == SPM, 1, 2)), pa.int64())
        out = pc.choose(role, texts, join(s, suffix, p, prefix, m, middle), join(p, prefix, s, suffix, m, middle))
        made = [
            pa.array(n, pa.int64()),
            pa.array(form.astype(object), pa.string()),
            pa.array(first, pa.int64(), mask=plain),
            pa.array(second - first, pa.int64(), mask=plain),
            out.cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=schema.names)

    def run(batches):
        for batch in batches:
            at = text_bytes(batch.column(text_col))[1]
            i = 0
            while i < batch.num_rows:  # rows of about a piece at a time, a longer text alone
                j = int(np.searchsorted(at, at[i] + PIECE_BYTES, "right")) - 1
                j = min(max(j, i + 1), batch.num_rows)
                yield work(batch.slice(i, j - i))
                i = j

    return drawn.mapInArrow(run, schema)


def restore(fim: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text again, from the transformed text and its form (Spark functions only).

    The text of a transformed row holds no mark and marks do not overlap, so the marks in the output
    are the three that were put in.
    """
    pattern = "|".join("\\Q" + m + "\\E" for m in marks)
    piece = F.split(fim, pattern, -1)
    psm = F.concat(piece[1], piece[3], piece[2])
    spm = F.concat(piece[2], piece[3], piece[1])
    return F.when(form == PLAIN, fim).when(form == PSM, psm).otherwise(spm)
