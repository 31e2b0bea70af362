"""Operator 3: language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built over labelled text. A whole text, its words between
single spaces, is cut into the longest phrases that occur in the language's text: the automaton is
followed as far as it goes, over word ends too, and a new phrase starts where it stops. The number of
phrases times the logarithm of the training length is the cross-parsing entropy; the language needing
fewest such normalised phrases wins, the first by name among equals.

A parse depends on all that came before it in its text, so texts are parsed side by side: numpy takes
one byte of every text of a batch, in every language, at a time (``Automata``, the transitions in three
arrays). The few texts that are much longer than the others are finished byte by byte.

Learning takes ``sample_texts`` labelled texts of a language at most, chosen by a hash of the text,
and of these whole texts up to ``sample_bytes``; a language none of whose texts fits is learned from
its shortest one, whole. Every text is parsed whole. A null text, or one
without any letter, is ``und`` with score 0, as is every text when no language was learned. Words
are those between white space, A-Z lower-cased.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.llm.common import LOWER, SPACED, find_words, rows_of, spare_name, text_bytes

SAMPLE_TEXTS = 64
SAMPLE_BYTES = 40_000
UNKNOWN = "und"
#: Texts that are parsed side by side at least; fewer are finished byte by byte.
SIDE_BY_SIDE = 12
#: Bytes of text in a batch that is parsed side by side; a longer text is a batch of its own.
BATCH_BYTES = 32 << 20
#: Bytes of text whose words are found at a time.
SLICE_BYTES = 1 << 20


class SuffixAutomaton:
    """The smallest automaton of all substrings of a byte string; transitions by (state, byte)."""

    def __init__(self, text: bytes):
        nexts: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for b in text:
            new = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and b not in nexts[p]:
                nexts[p][b] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][b]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nexts[p].get(b) == q:
                        nexts[p][b] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        #: ``state * 256 + byte`` to state.
        self.moves = {s << 8 | b: t for s, out in enumerate(nexts) for b, t in out.items()}

    def phrases(self, text: bytes) -> int:
        """Longest-match phrases in ``text``; a byte that never occurs is a phrase of its own."""
        move, n, state = self.moves.get, 0, 0
        for b in text:
            following = move(state << 8 | b)
            if following is None:
                n += 1  # the phrase so far, or a byte that never occurs
                following = 0
                if state:
                    following = move(b, 0)
                    n += not following
            state = following
        return n + (state > 0)


class Automata:
    """The automata of all languages in three arrays, for many texts at a time.

    A state's transitions lie in one shared row, displaced so that no two states use one place:
    ``owner[place[state] + byte]`` is the state if it has that transition, ``follow[...]`` where it goes.
    """

    def __init__(self, texts: list[bytes]):
        moves = [SuffixAutomaton(t).moves for t in texts]
        first = np.cumsum([0] + [1 + max((max(s >> 8, t) for s, t in m.items()), default=0) for m in moves])
        self.root = first[:-1].astype(np.int32)
        key = np.concatenate([np.array(sorted(m), np.int64) for m in moves] or [np.zeros(0, np.int64)])
        into = np.concatenate([np.array([m[k] for k in sorted(m)], np.int64) for m in moves] or [np.zeros(0, np.int64)])
        of = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        state, byte, into = (key >> 8) + first[of], key & 0xFF, into + first[of]
        self.place = self._displace(state, byte, int(first[-1]))
        size = int(self.place.max(initial=0)) + 256
        self.owner, self.follow = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        at = self.place[state] + byte
        self.owner[at], self.follow[at] = state, into
        #: From the start of each language: where a byte leads, or -1.
        self.start = np.full((len(moves), 256), -1, np.int32)
        for k, r in enumerate(self.root):
            at = self.place[r] + np.arange(256)
            self.start[k] = np.where(self.owner[at] == r, self.follow[at], -1)

    @staticmethod
    def _displace(state: np.ndarray, byte: np.ndarray, states: int) -> np.ndarray:
        """Where each state's transitions begin; the states with most of them first, the many with
        one into what is left."""
        place = np.zeros(states, np.int32)
        head = np.flatnonzero(np.diff(state, prepend=-1))
        size = np.diff(np.append(head, len(state)))
        used = np.zeros(2 * len(state) + 1024 + 256 * max(int((size > 40).sum()), 1), bool)
        used[:256] = True  # so that no place is negative
        low, width = 256, 0
        for k in np.argsort(-size, kind="stable"):
            if size[k] == 1:
                break
            bytes_ = byte[head[k] : head[k] + size[k]]
            if size[k] != width:  # fewer transitions fit into earlier gaps
                low, width = 256, size[k]
            while used[low + bytes_ - bytes_[0]].any():
                low += 1
            place[state[head[k]]] = low - bytes_[0]
            used[low + bytes_ - bytes_[0]] = True
        single = head[size == 1]
        free = np.flatnonzero(~used)[: len(single)]
        place[state[single]] = free - byte[single]
        return place

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (column) in each language (row)."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        begin, size = offsets[:-1][order], size[order]
        n = np.zeros((len(self.root), len(size)), np.int32)
        state = np.repeat(self.root[:, None], len(size), axis=1)
        root = self.root[:, None]
        side_by_side = int(size[SIDE_BY_SIDE - 1]) if len(size) >= SIDE_BY_SIDE else 0
        alive = np.searchsorted(-size, -np.arange(side_by_side), "left") if side_by_side else []
        for step, a in enumerate(alive):
            byte = data[begin[:a] + step]
            here = state[:, :a]
            at = self.place[here] + byte
            to = self.follow[at]
            lang, text = np.nonzero(self.owner[at] != here)
            if len(lang):
                again = self.start[lang, byte[text]]
                n[lang, text] += (here[lang, text] != self.root[lang]).astype(np.int32) + (again < 0)
                to[lang, text] = np.where(again < 0, self.root[lang], again)
            state[:, :a] = to
        for k in range(min(SIDE_BY_SIDE, len(size))):
            rest = data[begin[k] + side_by_side : begin[k] + size[k]].tobytes()
            if rest:
                for lang in range(len(self.root)):
                    n[lang, k], state[lang, k] = self._finish(lang, int(state[lang, k]), int(n[lang, k]), rest)
        n += state != root
        out = np.empty_like(n)
        out[:, order] = n
        return out

    def _finish(self, lang: int, state: int, n: int, rest: bytes) -> tuple[int, int]:
        """Phrases and state after the rest of one text in one language."""
        place, owner, follow, start = memoryview(self.place), memoryview(self.owner), memoryview(self.follow), self.start[lang].tolist()
        root = int(self.root[lang])
        for b in rest:
            at = place[state] + b
            if owner[at] == state:
                state = follow[at]
                continue
            n += state != root
            state = start[b]
            if state < 0:
                n, state = n + 1, root
        return n, state


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words, lower-cased, each between single spaces: bytes and offsets (no words: empty)."""
    parts, bounds, i, rows = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)], 0, len(offsets) - 1
    size = 0
    while i < rows:  # some texts at a time: the places of words take many times the words' bytes
        j = min(max(int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1, i + 1), rows)
        data, ends = _spaced(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append(data)
        bounds.append(ends[1:] + size)
        i, size = j, size + len(data)
    return np.concatenate(parts), np.concatenate(bounds)


def _spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = LOWER[raw]
    starts, ends, first = find_words(raw, offsets, SPACED)
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    some = np.diff(first) > 0
    lead = np.cumsum(some)  # spaces before the first words of the texts so far
    filled = np.cumsum(ends - starts)
    after = filled + np.arange(len(starts)) + lead[rows_of(np.arange(len(starts)), first)]
    out = np.full(int(filled[-1]) + len(starts) + int(lead[-1]), 0x20, np.uint8)
    letter = np.ones(len(out), bool)
    letter[after] = False
    total = np.append(0, after + 1)[first]  # the text's end is after the space behind its last word
    bounds = np.where(first > 0, total, 0)
    begin = np.append(0, bounds[1:])
    letter[begin[:-1][some]] = False
    out[letter] = raw[SPACED[raw]]
    return out, begin


def marked(text: str) -> bytes:
    """Lower-cased words, each between single spaces."""
    data, _ = spaced(*text_bytes(pa.array([text])))
    return data.tobytes() or b" "


def fit(
    docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES, text_col: str = "text", lang_col: str = "lang"
) -> dict[str, bytes]:
    """Training text of each language, from ``docs`` (the rows to learn from).

    A share of each language's distinct texts is drawn by hash before the exact choice, so that the
    choice of the smallest hashes never sorts a whole language in one task. Only texts that fit into
    ``sample_bytes`` are drawn, and they are cut to that in Spark, before they come to the driver. A
    language without such a text has its shortest text.
    """
    known = docs.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).filter("l is not null and t is not null")
    # A text's marked form has two bytes more at most.
    known = known.withColumn("h", F.xxhash64("t")).withColumn("n", F.octet_length("t") + 2)
    # Texts that repeat have one hash: each counts once, as it is drawn once below.
    distinct = known.select("l", "h", "n").dropDuplicates(["l", "h"]).groupBy("l")
    small = F.col("n") <= sample_bytes
    sizes = distinct.agg(F.count(F.when(small, 1)).alias("n"), F.min(F.struct("n", "h"))["h"].alias("shortest")).collect()
    if not sizes:
        return {}
    # Four times the wanted number on average, all texts of a small language.
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, 4 * sample_texts / max(r["n"], 1)))])
    drawn = small & ((F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)) <= share[F.col("l")])
    for r in sizes:
        if not r["n"]:
            drawn |= (F.col("l") == r["l"]) & (F.col("h") == r["shortest"])
    low = known.filter(drawn).dropDuplicates(["l", "h"])
    from pyspark.sql import Window

    order = Window.partitionBy("l").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h")
    low = low.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample_texts)

    def filled(sizes):
        return F.aggregate(sizes, F.lit(0), lambda total, n: F.when(total + n <= sample_bytes, total + n).otherwise(total))

    low = low.withColumn("upto", F.collect_list("n").over(Window.partitionBy("l").orderBy("k")))
    fits = filled(F.col("upto")) > filled(F.slice("upto", F.lit(1), F.col("k") - 1))
    rows = low.filter(fits | ~small).orderBy("l", "k").select("l", "t").collect()
    text: dict[str, bytes] = {lang: b"" for lang in sorted({r["l"] for r in rows})}
    for r in rows:
        more = marked(r["t"])
        text[r["l"]] += more if not text[r["l"]] else more[1:]
    return text


def _has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are decoded."""
    low = LOWER[raw]
    ascii_letters = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])[offsets]
    has = np.diff(ascii_letters) > 0
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
        has[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    return has


def costs(raw: np.ndarray, offsets: np.ndarray, automata: Automata, norms: np.ndarray) -> np.ndarray:
    """Normalised phrases of every text (row) in every language (column)."""
    return automata.phrases(*spaced(raw, offsets)).T * norms


def predict(docs: DataFrame, training: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the runner-up's share of both costs, 0 to 1."""
    langs = sorted(training)
    names = [spare_name(x, docs.columns) for x in ("lang_pred", "score")]
    schema = T.StructType([*docs.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    norms = np.array([math.log2(len(training[x]) + 2) for x in langs])
    # Some 60 bytes for each byte of training text, of which a language has ``sample_bytes``.
    shared = docs.sparkSession.sparkContext.broadcast(Automata([training[x] for x in langs]))

    def run(batches):
        for whole in batches:
            at = text_bytes(whole.column(text_col))[1]
            i = 0
            while i < whole.num_rows:
                j = min(max(int(np.searchsorted(at, at[i] + BATCH_BYTES, "right")) - 1, i + 1), whole.num_rows)
                batch = whole.slice(i, j - i)
                raw, offsets = text_bytes(batch.column(text_col))
                known = _has_letter(raw, offsets)
                lang, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
                if langs:
                    cost = costs(raw, offsets, shared.value, norms)
                    best = cost.argmin(axis=1)
                    low = cost.min(axis=1)
                    rival = np.partition(cost, 1, axis=1)[:, 1] if len(langs) > 1 else np.full(len(low), np.inf)
                    share = np.where(np.isinf(rival), 1.0, rival / np.maximum(np.where(np.isinf(rival), 1, rival + low), 1e-9))
                    lang[known] = np.array(langs, object)[best[known]]
                    score[known] = share[known]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names
                )
                i = j

    return docs.mapInArrow(run, schema)
