"""Operator 13: token counts of a byte-level BPE tokenizer by a map-side two-tier lookup.

The number of tokens of a text is the sum of its pre-tokens' numbers, and few pre-tokens make up most of
a text. So each task cuts texts into pre-tokens, hashes them, and looks their numbers up:

1. in a compact hash table of frequent pre-tokens, built once and broadcast: the vocabulary's own whole
   pre-tokens (its merges are in the order of frequency) and the most frequent ones of a bounded draw of
   the corpus (``SAMPLE_TEXTS`` texts of ``SAMPLE_BYTES`` together; at most ``FREQUENT`` of them);
2. in a cache of the worker process, which outlives its tasks and is emptied at ``CACHE`` entries.

Only what neither has is encoded by the library, once. The tables hold numbers, not answers to anything
else, so the draw and the cache's state change the time and never a count. No pre-token is shuffled.

Pre-tokens are cut with numpy from the code points' classes (letter, number, white space, other) by the
tokenizer's byte-level pattern: optional space and a run of one class, contractions, and white space that
leaves its last character to what follows. Added tokens in a text (the library's default matches them)
are one token each and cut the text around them. Texts are worked on ``PIECE_BYTES`` at a time; a longer
text is cut where the pattern surely has a border, so memory is bounded but for a longer run of
characters of one class, which is one pre-token.

A null text is empty and has no tokens. Rows that repeat count alike; extra columns stay, and an added
name that clashes gets an underscore. Tokenizers with a normaliser, another pre-tokenizer or added tokens
with conditions are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.llm.common import U64, rows_of, spare_name, text_bytes, word_hashes

SAMPLE_TEXTS, SAMPLE_BYTES, FREQUENT = 512, 4 << 20, 32_768
CACHE = 1 << 20
PIECE_BYTES = 1 << 20
SPACE, LETTER, NUMBER, OTHER, ADDED = 0, 1, 2, 3, 4


# -- pre-tokens ---------------------------------------------------------------------------------------


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """First code point and class of each run of code points of one class.

    The library's own pattern engine tells the classes, so that both follow one version of Unicode.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = "".join(map(chr, points.tolist()))
    found = np.full(0x110000, OTHER, np.uint8)
    for kind, rest in ((LETTER, r"\P{L}+"), (NUMBER, r"\P{N}+"), (SPACE, r"\S+")):
        for _, (i, j) in Split(Regex(rest), "removed").pre_tokenize_str(every):
            found[points[i:j]] = kind
    head = np.flatnonzero(np.diff(found, prepend=255))
    return head.astype(np.int32), found[head]


def class_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    head, kind = runs
    return np.repeat(kind, np.diff(np.append(head, 0x110000)))


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and the byte at which each begins."""
    if not (raw & 0x80).any():
        return raw, np.arange(len(raw))
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.flatnonzero((raw & 0xC0) != 0x80)


def heads(point: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a pre-token begins.

    ``kind``: classes; ``edge``: a text, or the text between added tokens, begins here.
    """
    n = len(point)
    if n == 0:
        return np.zeros(0, bool)
    head = edge.copy()
    head[1:] |= kind[1:] != kind[:-1]
    # White space before something else leaves it its last character: a space joins it, others stand alone.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:]) + 1
    head[after - 1] = True
    head[after] = point[after - 1] != 0x20
    # Contractions: an apostrophe that begins a pre-token, and the letters that go with it.
    at = np.flatnonzero((point == 0x27) & head)
    at = at[at + 1 < n]
    at = at[~edge[at + 1] & (kind[at + 1] == LETTER)]
    one = point[at + 1]
    two = np.where(at + 2 < n, point[np.minimum(at + 2, n - 1)], 0)
    two = np.where((at + 2 < n) & ~edge[np.minimum(at + 2, n - 1)], two, 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    at, size = at[short | long], np.where(long, 2, 1)[short | long]
    head[at + 1] = False
    rest = at + 1 + size
    head[rest[rest < n]] = True
    return head


class Splitter:
    """Cuts texts into pre-tokens; ``added``: the added tokens' strings."""

    def __init__(self, runs, added: list[str]):
        self.table = class_table(runs)
        self.added = re.compile(b"|".join(re.escape(a.encode()) for a in sorted(added, key=len, reverse=True))) if added else None

    def _added_spans(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts and ends of added tokens (none runs over the end of a text)."""
        spans = []
        if self.added is not None:
            data = raw.tobytes()
            if self.added.search(data):
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    spans += [m.span() for m in self.added.finditer(data, i, j)]
        return np.array(spans, np.int64).reshape(-1, 2)

    def _border(self, raw: np.ndarray, low: int, high: int, spans: np.ndarray) -> int:
        """The last place in (low, high] at which a pre-token surely begins, or -1."""
        view = min(1 << 14, high - low)
        while True:
            begin = high - view
            while begin > low and (raw[begin] & 0xC0) == 0x80:
                begin -= 1
            point, at = code_points(raw[begin:high])
            kind = self.table[point]
            sure = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE) & (point[:-1] != 0x27)) + 1
            sure = at[sure] + begin
            inside = np.searchsorted(spans[:, 0], sure, "left") - 1
            sure = sure[(inside < 0) | (sure >= spans[np.maximum(inside, 0), 1])] if len(spans) else sure
            if len(sure):
                return int(sure[-1])
            if begin == low:
                return -1
            view = min(view * 4, high - low)

    def cut(self, raw: np.ndarray, offsets: np.ndarray):
        """Byte starts and ends of the pre-tokens of the rows, some bytes at a time."""
        spans = self._added_spans(raw, offsets)
        edges = np.unique(np.concatenate([offsets[:-1], spans.ravel()]))
        low, n = 0, len(raw)
        while low < n:
            want = PIECE_BYTES
            while True:
                high = min(low + want, n)
                while high < n and (raw[high] & 0xC0) == 0x80:
                    high += 1
                if high == n:
                    break
                border = self._border(raw, low, high, spans)
                if border > low:
                    high = border
                    break
                want *= 2
            point, at = code_points(raw[low:high])
            kind = self.table[point]
            edge = np.zeros(len(point), bool)
            here = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)] - low
            edge[np.searchsorted(at, here)] = True
            edge[0] = True  # the piece begins at a border without white space before it
            if len(spans):
                some = spans[(spans[:, 0] >= low) & (spans[:, 0] < high)] - low
                for i, j in np.searchsorted(at, some).tolist():
                    kind[i:j] = ADDED
            head = at[np.flatnonzero(heads(point, kind, edge))] + low
            yield head, np.append(head[1:], high)
            low = high


# -- the table of lengths -------------------------------------------------------------------------------


class Lengths:
    """An open hash table in two arrays: 64-bit hash (0: free) and number of tokens."""

    def __init__(self, room: int):
        size = 1 << max(2 * room - 1, 15).bit_length()
        self.key, self.value, self.used = np.zeros(size, U64), np.zeros(size, np.uint32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - (len(self.key).bit_length() - 1))).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, and which keys are missing."""
        keys = np.maximum(keys, U64(1))
        slot, value = self._slots(keys), np.zeros(len(keys), np.int64)
        missing, left = np.zeros(len(keys), bool), np.arange(len(keys))
        while len(left):
            there = self.key[slot[left]]
            found = there == keys[left]
            value[left[found]] = self.value[slot[left[found]]]
            missing[left[there == 0]] = True
            left = left[~found & (there != 0)]
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)
        return value, missing

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys; there must be room."""
        keys = np.maximum(keys, U64(1))
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.key[slot[left]] == 0]
            self.key[slot[free]] = keys[free]  # of several at one place the last stays
            won = free[self.key[slot[free]] == keys[free]]
            self.value[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)
        self.used += len(keys)


# -- the tokenizer --------------------------------------------------------------------------------------


def load_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def added_tokens(source: str) -> list[str]:
    """The added tokens' strings; refuses tokenizers whose counts are not sums over pre-tokens."""
    config = json.loads(source)
    cut = config.get("pre_tokenizer") or {}
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError("only byte-level tokenizers with their own pattern and no prefix space")
    if config["model"].get("type", "BPE") != "BPE" or config.get("normalizer"):
        raise ValueError("only BPE tokenizers without a normaliser")
    if config["model"].get("dropout"):
        raise ValueError("a tokenizer with dropout has no fixed counts")
    tokens = config.get("added_tokens") or []
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in tokens):
        raise ValueError("added tokens with conditions are not supported")
    return [t["content"] for t in tokens if t["content"]]


def _library(source: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(source)
    made.no_truncation()
    made.no_padding()
    return made


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _numbers(library, data: list[bytes]) -> np.ndarray:
    coded = library.encode_batch([d.decode("utf-8") for d in data], add_special_tokens=False)
    return np.array([len(c.ids) for c in coded], np.int64)


def _hashes(data: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(d) for d in data]).astype(np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    return word_hashes(raw, np.append(0, ends[:-1]).astype(np.int64), ends) if data else np.zeros(0, U64)


def frequent_lengths(source: str, runs, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of the vocabulary's whole pre-tokens, the added tokens, and the pre-tokens
    most frequent in ``texts`` (ties by their bytes)."""
    library, added = _library(source), added_tokens(source)
    splitter, byte = Splitter(runs, added), byte_characters()
    wanted: dict[bytes, None] = {a.encode(): None for a in added}
    pieces = []
    for token in library.get_vocab(with_added_tokens=False):
        if all(c in byte for c in token):
            try:
                bytes(byte[c] for c in token).decode("utf-8")
            except UnicodeDecodeError:
                continue  # a part of a character is never a pre-token
            pieces.append(bytes(byte[c] for c in token))
    offsets = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    count = np.zeros(len(pieces), np.int64)
    for start, _ in splitter.cut(raw, offsets):
        count += np.bincount(rows_of(start, offsets), minlength=len(pieces))
    wanted |= {p: None for p, n in zip(pieces, count.tolist()) if n == 1}
    seen: Counter[bytes] = Counter()
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        data = raw.tobytes()
        for start, end in splitter.cut(raw, np.array([0, len(raw)], np.int64)):
            seen.update(data[i:j] for i, j in zip(start.tolist(), end.tolist()))
    top = sorted(seen, key=lambda p: (-seen[p], p))[:FREQUENT]
    wanted |= {p: None for p in top if len(p) <= 256}
    data = list(wanted)
    keys, first = np.unique(_hashes(data), return_index=True)
    return keys, _numbers(library, [data[k] for k in first.tolist()])


class Worker:
    """What a worker process keeps between tasks: library, tables and cache."""

    def __init__(self, source: str, runs, frequent):
        self.library = _library(source)
        self.splitter = Splitter(runs, added_tokens(source))
        self.frequent = Lengths(len(frequent[0]))
        self.frequent.add(*frequent)
        self.cache = Lengths(CACHE)

    def lengths(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        keys = word_hashes(raw, start, end)
        value, missing = self.frequent.get(keys)
        left = np.flatnonzero(missing)
        if not len(left):
            return value
        value[left], missing = self.cache.get(keys[left])
        left = left[missing]
        if len(left):
            new, first, place = np.unique(keys[left], return_index=True, return_inverse=True)
            data = [raw[start[k] : end[k]].tobytes() for k in left[first].tolist()]
            number = _numbers(self.library, data)
            value[left] = number[place]
            if self.cache.used + len(new) > CACHE:
                self.cache = Lengths(CACHE)
            if len(new) <= CACHE:
                self.cache.add(new, number)
        return value

    def count(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        total = np.zeros(len(offsets) - 1, np.int64)
        for start, end in self.splitter.cut(raw, offsets):
            total += np.bincount(rows_of(start, offsets), self.lengths(raw, start, end), len(total)).astype(np.int64)
        return total


_WORKERS: dict[str, Worker] = {}


def worker(tag: str, source: str, runs, frequent) -> Worker:
    """The process's worker for this tokenizer and table."""
    if tag not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[tag] = Worker(source, runs, frequent)
    return _WORKERS[tag]


# -- Spark ------------------------------------------------------------------------------------------


def draw(docs: DataFrame, text_col: str = "text") -> list[str]:
    """A bounded random draw of texts, for the table of frequent pre-tokens alone.

    Each row is drawn with the same chance, so that about ``SAMPLE_TEXTS`` rows leave the scan however
    many there are; of these whole texts up to ``SAMPLE_BYTES`` come to the driver.
    """
    size = F.octet_length("t")
    texts = docs.select(F.col(text_col).alias("t"))
    share = min(1.0, SAMPLE_TEXTS / max(texts.count(), 1))
    drawn = texts.filter((F.rand(13) < share) & F.col("t").isNotNull() & (size <= SAMPLE_BYTES // 8)).limit(2 * SAMPLE_TEXTS)
    held = F.sum(size).over(Window.orderBy(F.xxhash64("t"), "t").rowsBetween(Window.unboundedPreceding, 0))
    return [r["t"] for r in drawn.withColumn("held", held).filter(F.col("held") <= SAMPLE_BYTES).select("t").collect()]


def count_tokens(docs: DataFrame, source: str, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text (under a spare name if the column exists).

    ``source``: the tokenizer's JSON text.
    """
    runs = class_runs()
    frequent = frequent_lengths(source, runs, draw(docs, text_col))
    tag = hashlib.sha256(source.encode() + frequent[0].tobytes()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((source, runs, frequent))
    schema = T.StructType([*docs.schema, T.StructField(spare_name(name, docs.columns), T.LongType())])

    def run(batches):
        me = worker(tag, *shared.value)
        for batch in batches:
            at = text_bytes(batch.column(text_col))[1]
            i = 0
            while i < batch.num_rows:
                j = int(np.searchsorted(at, at[i] + PIECE_BYTES, "right")) - 1
                j = min(max(j, i + 1), batch.num_rows)
                rows = batch.slice(i, j - i)
                made = pa.array(me.count(*text_bytes(rows.column(text_col))), pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns, made], names=schema.names)
                i = j

    return docs.mapInArrow(run, schema)
