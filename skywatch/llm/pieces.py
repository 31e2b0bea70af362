"""Operator 1: SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a batch (a run of spaces, as ``\\u2581``, and the characters up to the
next space) are sorted, which is the depth-first order of their trie: a word keeps the forward
states of the prefix that it shares with the word before, and only the rest is computed. A forward
state is that of the best path over the text so far.

* Unigram models: the path with the highest sum of piece scores, as usual.
* BPE models: the highest sum is not what merging gives. There, each prefix of a word has exactly one
  last piece such that merging yields it; the forward state is that piece, found by checking which
  piece may follow the state it starts from. This gives the ids of the merge procedure.

Characters without a piece fall back to their bytes. No space or piece is normalised away: models
whose normaliser changes text are refused. A null text has no ids (null), an empty text the empty
list; decoding is the exact inverse. Pieces that run over a word start are refused too.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skywatch.llm.common import U64, rows_of, spare_name, text_bytes, word_hashes

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words are kept with their ids up to this many bytes of arrays, and this many neighbouring pieces;
#: beyond, they are forgotten and computed again. No result depends on it.
CACHE_BYTES, CACHE_PAIRS = 24 << 20, 100_000
#: Bytes of text encoded, and ids decoded, at a time.
SLICE_BYTES, SLICE_IDS = 1 << 20, 1 << 19


# -- the model file -------------------------------------------------------------------------------


def _fields(data: memoryview):
    """The fields of a protocol buffer message: number and value."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[i : i + n]
            i += n


class Model:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.prefix, self.squeeze, self.rules = UNIGRAM, True, True, b""
        for number, value in _fields(memoryview(data)):
            if number == 1:
                piece = {n: v for n, v in _fields(value)}
                self.pieces.append(bytes(piece.get(1, b"")).decode())
                self.scores.append(float(np.frombuffer(piece[2], np.float32)[0]) if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = next((v for n, v in _fields(value) if n == 3), UNIGRAM)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        self.rules = bytes(v)
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        if self.rules or self.squeeze or not self.prefix:
            raise ValueError("the model's normaliser changes text; only a dummy space prefix is supported")
        if any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds) if k == NORMAL):
            raise ValueError("pieces that run over a word start are not supported")
        if USER in self.kinds:
            raise ValueError("user-defined pieces are not supported")


class Encoder:
    """Encodes marked words; ``ids`` of a word do not depend on the words beside it."""

    def __init__(self, model: Model):
        self.model = model
        normal = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.ids = normal
        # A trie of the pieces: each node's children by character, and the piece that ends there.
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for p, k in normal.items():
            if model.kind == BPE and not self._mergeable(p, normal, model.scores):
                continue
            node = 0
            for c in p:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][c]
            self.ends[node] = k
        self.byte = {}
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds)):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.score = model.scores
        self.text = model.pieces
        self.halves: dict[int, tuple[str, str]] = {}
        self.follows: dict[int, bool] = {}  # by left piece * number of pieces + right piece
        self.low = min((s for s, k in zip(model.scores, model.kinds) if k == NORMAL), default=0.0)

    # BPE: how a piece is merged, and which piece may follow which.

    @staticmethod
    def _merges(piece: str, ids: dict[str, int], scores: list[float]) -> list[str]:
        """What merging leaves of the piece's characters, and the two halves of its last merge."""
        parts, halves = list(piece), ["", ""]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            halves = parts[at : at + 2]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [*halves, *parts]

    @classmethod
    def _mergeable(cls, piece: str, ids: dict[str, int], scores: list[float]) -> bool:
        return len(cls._merges(piece, ids, scores)) == 3

    def _split(self, piece: int) -> tuple[str, str]:
        """The two halves of the merge that makes a piece of several characters."""
        if piece not in self.halves:
            self.halves[piece] = tuple(self._merges(self.text[piece], self.ids, self.score)[:2])
        return self.halves[piece]

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging keeps a border between two pieces: no merge across it comes first.

        Both pieces are taken apart step by step, the later merge first; a merge over the border
        that would have come before the one undone joins them.
        """
        known = self.follows.get(left * len(self.text) + right)
        if known is not None:
            return known
        a, b = self.text[left], self.text[right]
        limit = float("-inf")  # the score of the last merge undone; a merge above it comes first
        from_left = True
        ok = True
        while True:
            k = self.ids.get(a + b)
            if k is not None and (self.score[k] > limit or (self.score[k] == limit and not from_left)):
                ok = False
                break
            i, j = self.ids.get(a), self.ids.get(b)
            one = self._split(i) if i is not None and len(a) > 1 else None
            two = self._split(j) if j is not None and len(b) > 1 else None
            if one is None and two is None:
                break
            if two is None or (one is not None and self.score[i] <= self.score[j] and not (self.score[i] == self.score[j])):
                limit, a, from_left = self.score[i], one[1], True
            else:
                limit, b, from_left = self.score[j], two[0], False
        self.follows[left * len(self.text) + right] = ok
        return ok

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted, distinct words."""
        out = []
        # Forward states of the current trie path: last piece, its start, best score, and the
        # pieces under way (start, node of the piece trie), longest first.
        last: list[int] = [-1]
        came: list[int] = [0]
        best: list[float] = [0.0]
        under: list[list[tuple[int, int]]] = [[]]
        before = ""
        bpe = self.model.kind == BPE
        children, ends, score, follows, width = self.children, self.ends, self.score, self.follows, len(self.text)
        for word in words:
            keep = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                keep += 1
            del last[keep + 1 :], came[keep + 1 :], best[keep + 1 :], under[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                c = word[end - 1]
                found, start_of, top = -2, end - 1, float("-inf")
                alive = []
                for start, node in (*under[-1], (end - 1, 0)):
                    node = children[node].get(c)
                    if node is None:
                        continue
                    alive.append((start, node))
                    k = ends[node]
                    if k < 0:
                        continue
                    if bpe:
                        if found == -2:
                            left = last[start]
                            ok = left < 0 or follows.get(left * width + k)
                            if ok is None:
                                ok = self._may_follow(left, k)
                            if ok:
                                found, start_of = k, start
                    elif best[start] + score[k] > top:
                        found, start_of, top = k, start, best[start] + score[k]
                if found == -2:  # no piece ends here: bytes
                    top = best[end - 1] + self.low - 10.0
                last.append(found)
                came.append(start_of)
                best.append(top)
                under.append(alive)
            path: list[int] = []
            end = len(word)
            while end:
                k, start = last[end], came[end]
                if k >= 0:
                    path.append(k)
                else:
                    path.extend(self.byte.get(b, self.unknown) for b in reversed(word[start:end].encode("utf-8", "surrogateescape")))
                end = start
            path.reverse()
            out.append(path)
            before = word
        return out


def marked_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with their dummy space, starts and ends of the marked words, and each
    text's first word. A mark in a text is a space to the model. Empty texts have no words."""
    column = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), MARK, " ")
    raw, offsets = text_bytes(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    space = raw == 0x20
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[offsets[:-1]] = True
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(raw))
    row = rows_of(starts, offsets)
    some = np.diff(offsets)[row] > 1
    starts, ends, row = starts[some], ends[some], row[some]
    return raw, starts, ends, np.searchsorted(row, np.arange(len(offsets)))


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class WordIds:
    """Ids of the words seen so far, in arrays: the words' sorted hashes, where their ids begin, the ids."""

    def __init__(self):
        self.key, self.begin = np.zeros(0, U64), np.zeros(0, np.int64)
        self.size, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int32)

    @property
    def bytes(self) -> int:
        return self.key.nbytes + self.begin.nbytes + self.size.nbytes + self.pool.nbytes

    def missing(self, key: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that are not here."""
        if not len(self.key):
            return np.arange(len(key))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.flatnonzero(self.key[at] != key)

    def add(self, key: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        pool = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        begin = len(self.pool) + np.cumsum(size, dtype=np.int64) - size
        key = np.concatenate([self.key, key])
        order = np.argsort(key)
        self.key = key[order]
        self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]
        self.pool = np.concatenate([self.pool, pool])

    def joined(self, key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``key[word]`` one after the other, and where each word's end."""
        at = np.searchsorted(self.key, key)[word]
        begin, size = self.begin[at], self.size[at].astype(np.int64)
        total = np.cumsum(size)
        return self.pool[np.arange(int(size.sum())) + np.repeat(begin - (total - size), size)], total


def _slices(batch: pa.RecordBatch, at: np.ndarray, size: int):
    """Runs of rows of about ``size`` by the rows' bounds ``at``; a larger row alone."""
    i = 0
    while i < batch.num_rows:
        j = min(max(int(np.searchsorted(at, at[i] + size, "right")) - 1, i + 1), batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text (under a spare name if the column exists).

    ``decoded_col`` adds the text that the ids give back, in the same pass over the rows.
    """
    Model(model)  # refuse unsupported models before any task starts
    added = [T.StructField(spare_name(ids_col, docs.columns), T.ArrayType(T.IntegerType()))]
    if decoded_col is not None:
        added.append(T.StructField(spare_name(decoded_col, [*docs.columns, added[0].name]), T.StringType()))
    schema = T.StructType([*docs.schema, *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        made = Model(shared.value)
        encoder, decoder, cache = Encoder(made), Decoder(made), WordIds()
        for whole in batches:
            for batch in _slices(whole, text_bytes(whole.column(text_col))[1], SLICE_BYTES):
                raw, starts, ends, first = marked_words(batch.column(text_col))
                if cache.bytes > CACHE_BYTES:
                    cache = WordIds()
                if len(encoder.follows) > CACHE_PAIRS:
                    encoder.follows.clear()
                key, one, word = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
                new = cache.missing(key)
                spelt = {
                    raw[starts[k] : ends[k]].tobytes().decode("utf-8", "surrogateescape").replace(" ", MARK): h
                    for k, h in zip(one[new].tolist(), key[new])
                }
                order = sorted(spelt)
                if order:
                    cache.add(np.array([spelt[w] for w in order], U64), encoder.encode(order))
                flat, total = cache.joined(key, word)
                bounds = np.concatenate([[0], total])[first].astype(np.int32)
                missing = pc.is_null(batch.column(text_col))
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat), mask=missing)]
                if decoded_col is not None:
                    columns.append(decoder.column(flat, bounds, missing))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


class Decoder:
    """Ids back to text: the bytes of the pieces, the dummy mark dropped."""

    def __init__(self, model: Model):
        data = []
        for piece, kind in zip(model.pieces, model.kinds):
            if kind == BYTE:
                data.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                data.append(b"")
            elif kind == UNKNOWN:
                data.append(" ⁇ ".encode())
            else:
                data.append(piece.replace(MARK, " ").encode())
        self.data = np.array(data, object)

    def decode(self, ids) -> str:
        text = b"".join(self.data[ids]) if len(ids) else b""
        return text[1:].decode("utf-8", "replace") if text[:1] == b" " else text.decode("utf-8", "replace")

    def column(self, ids: np.ndarray, bounds: np.ndarray, missing: pa.Array) -> pa.Array:
        """The texts of lists of ids, null where a list is missing."""
        gone = missing.to_pylist()
        return pa.array([None if n else self.decode(ids[i:j]) for n, i, j in zip(gone, bounds[:-1], bounds[1:])], pa.string())


def decode(docs: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each id list (under a spare name if the column exists)."""
    name = spare_name(text_col, docs.columns)
    schema = T.StructType([*docs.schema, T.StructField(name, T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        decoder = Decoder(Model(shared.value))
        for whole in batches:
            size = pc.fill_null(pc.list_value_length(whole.column(ids_col)), 0).to_numpy(zero_copy_only=False)
            for batch in _slices(whole, np.append(0, np.cumsum(size, dtype=np.int64)), SLICE_IDS):
                column = batch.column(ids_col)
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                bounds, ids = np.append(0, np.cumsum(size, dtype=np.int64)), pc.list_flatten(column).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns, decoder.column(ids, bounds, pc.is_null(column))], names=schema.names)

    return docs.mapInArrow(run, schema)
