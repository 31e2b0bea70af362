"""Operator 10: toxicity scores from a bidirectional gated recurrent network with attention pooling.

Words (lower-cased A-Z, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) enter as a hashed word vector beside
the mean of their hashed character trigram vectors. Two gated recurrent layers read each window of
``WINDOW`` words in both directions, attention pools their states, and a logistic unit scores the
window. A text's score is the highest over all overlapping windows (one every ``STRIDE`` words,
the last reaches the end), calibrated on the training texts.

Training runs in numpy on at most ``sample`` labelled texts of each class, chosen by a hash of the
id, that have ``SAMPLE_BYTES`` bytes together at most, with at most ``per_text`` windows of each; scoring covers all windows of all texts. Weights have
a fixed size, so shipping them to the tasks does not grow with the data. A null or empty text is
scored as one window without words. If the labels hold one class only, the score is that class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.llm.common import LETTERED, LOWER, U64, byte_values, find_words, mix, rows_of, spare_name, text_bytes, word_hashes

WINDOW = 32
STRIDE = 16  # half a window: each run of WINDOW - STRIDE + 1 words stands whole in some window
HIDDEN = 8
WORD_SLOTS, WORD_DIM = 1 << 14, 10
CHAR_SLOTS, CHAR_DIM = 1 << 12, 6
SAMPLE = 1500
#: Of the sampled texts of a class, those that fit into so many bytes together come to the driver.
SAMPLE_BYTES = 16 << 20
PER_TEXT = 16
#: Words of fewer training texts are read by their characters alone.
SEEN = 6
DECAY = 1.0


# -- inputs ------------------------------------------------------------------------------------


class Inputs:
    """Distinct words of a batch: word slots, and character trigram slots of each."""

    def __init__(self, column):
        raw, offsets = text_bytes(column)
        raw = LOWER[raw]
        starts, ends, self.first = find_words(raw, offsets, LETTERED)
        h = word_hashes(raw, starts, ends)
        _, one, self.word = np.unique(h, return_index=True, return_inverse=True)
        h, starts, ends = h[one], starts[one], ends[one]
        self.slot = (h % U64(WORD_SLOTS)).astype(np.int64)
        self.grams = ends - starts + 1
        self.n = len(self.grams)
        parts = [self._trigrams(raw, starts[i : i + 50_000], ends[i : i + 50_000]) for i in range(0, self.n, 50_000)]
        self.gram = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    @staticmethod
    def _trigrams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of the trigrams of marked words: one for each byte and one past the end."""
        size = ends - starts + 1
        place = np.repeat(starts - 1, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        low, high = np.repeat(starts, size), np.repeat(ends, size)
        values = byte_values()
        gram = np.zeros(len(place), U64)
        for k in range(3):
            at = place + k
            inside = (at >= low) & (at < high)
            part = np.full(len(at), 7, U64)
            part[inside] = values[raw[at[inside]]]
            gram = gram * U64(0x100000001B3) + part
        return (mix(gram) % U64(CHAR_SLOTS)).astype(np.int32)

    def vectors(self, net: dict) -> np.ndarray:
        if self.n == 0:
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        begin = np.cumsum(self.grams) - self.grams
        chars = np.empty((self.n, CHAR_DIM), np.float32)
        step = 1 << 18
        for i in range(0, self.n, step):
            j = min(i + step, self.n)
            lo, hi = begin[i], begin[j - 1] + self.grams[j - 1]
            chars[i:j] = np.add.reduceat(net["char"][self.gram[lo:hi]], begin[i:j] - lo, axis=0)
        return np.hstack([net["word"][self.slot] * net["seen"][self.slot, None], chars / self.grams[:, None].astype(np.float32)])


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of every window (one at least for each text)."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(k * STRIDE, np.maximum(n[row] - WINDOW, 0))
    return first[:-1][row] + at, np.minimum(n[row], WINDOW), row


# -- the network ---------------------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def new_net(seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN

    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    net = {"word": normal(WORD_SLOTS, WORD_DIM, scale=0.1), "char": normal(CHAR_SLOTS, CHAR_DIM, scale=0.1)}
    for side in "fb":
        net[f"in_{side}"] = normal(d, 3 * h, scale=d**-0.5)
        net[f"bias_{side}"] = np.zeros(3 * h, np.float32)
        net[f"rec_{side}"] = normal(h, 3 * h, scale=h**-0.5)
    net |= {"att": normal(2 * h, h, scale=(2 * h) ** -0.5), "focus": normal(h, scale=0.3)}
    net |= {"out": normal(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
    return net


def _read(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, rec: np.ndarray, backward: bool, tape: list | None):
    """States of one direction, (steps, windows, hidden)."""
    steps, h = index.shape[1], HIDDEN
    state = np.zeros((len(index), h), np.float32)
    states = np.empty((steps, len(index), h), np.float32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        x = gates[index[:, t]]
        y = state @ rec
        rz = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
        r, z = rz[:, :h], rz[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
        m = mask[:, t, None]
        new = state + m * (1 - z) * (n - state)
        if tape is not None:
            tape.append((t, state, r, z, n, y[:, 2 * h :], m))
        state = new
        states[t] = state
    return states


def forward(net: dict, gates: dict, index: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """A logit for each window."""
    tapes = {"f": [], "b": []} if tape is not None else {"f": None, "b": None}
    sides = [_read(gates[s], index, mask, net[f"rec_{s}"], s == "b", tapes[s]) for s in "fb"]
    both = np.concatenate(sides, axis=2)  # steps, windows, 2h
    hidden = np.tanh(both @ net["att"])
    focus = np.where(mask.T > 0, hidden @ net["focus"], np.float32(-1e9))
    weight = np.exp(focus - focus.max(axis=0)) * mask.T
    weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tb,tbk->bk", weight, both)
    if tape is not None:
        tape.update(tapes=tapes, both=both, hidden=hidden, weight=weight, pooled=pooled)
    return pooled @ net["out"] + net["bias"][0]


def project(net: dict, vectors: np.ndarray) -> dict:
    """The words' shares of the gates, one more row (zeros' share) for places past the end."""
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    return {s: padded @ net[f"in_{s}"] + net[f"bias_{s}"] for s in "fb"}


def _gradients(net: dict, inputs: Inputs, index, mask, target, weights) -> tuple[dict, np.ndarray]:
    used, local = np.unique(index, return_inverse=True)
    local = local.reshape(index.shape)
    real = used[used < inputs.n]
    part = _Part(inputs, real)
    vectors = part.vectors(net)
    gates = project(net, vectors)
    local = np.minimum(local, len(real))
    tape: dict = {}
    logit = forward(net, gates, local, mask, tape)
    p = _sigmoid(logit)
    d_logit = ((p - target) * weights / weights.sum()).astype(np.float32)
    grad = {"out": tape["pooled"].T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    both, hidden, weight = tape["both"], tape["hidden"], tape["weight"]
    d_pooled = d_logit[:, None] * net["out"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = np.einsum("bk,tbk->tb", d_pooled, both)
    d_focus = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["focus"] = np.einsum("tb,tbk->k", d_focus, hidden)
    d_hidden = d_focus[:, :, None] * net["focus"] * (1 - hidden**2)
    grad["att"] = np.einsum("tbi,tbk->ik", both, d_hidden, optimize=True)
    d_both = d_both + d_hidden @ net["att"].T
    h = HIDDEN
    d_vectors = np.zeros((len(real) + 1, vectors.shape[1]), np.float32)
    for i, side in enumerate("fb"):
        rec = net[f"rec_{side}"]
        d_gates = np.zeros_like(gates[side])
        d_rec = np.zeros_like(rec)
        d_state = np.zeros((len(index), h), np.float32)
        for t, before, r, z, n, y, m in reversed(tape["tapes"][side]):
            d_new = d_state + d_both[t, :, i * h : (i + 1) * h]
            d_n = d_new * m * (1 - z) * (1 - n**2)
            d_z = d_new * m * (before - n) * z * (1 - z)
            d_r = d_n * y * r * (1 - r)
            d_x = np.concatenate([d_r, d_z, d_n], axis=1)
            d_y = np.concatenate([d_r, d_z, d_n * r], axis=1)
            np.add.at(d_gates, local[:, t], d_x)
            d_rec += before.T @ d_y
            d_state = d_new * (1 - m * (1 - z)) + d_y @ rec.T
        grad[f"rec_{side}"] = d_rec
        padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        grad[f"in_{side}"] = padded.T @ d_gates
        grad[f"bias_{side}"] = d_gates.sum(axis=0)
        d_vectors += d_gates @ net[f"in_{side}"].T
    d_vectors = d_vectors[:-1]
    grad["word"], grad["char"] = np.zeros_like(net["word"]), np.zeros_like(net["char"])
    np.add.at(grad["word"], part.slot, d_vectors[:, :WORD_DIM] * net["seen"][part.slot, None])
    spread = d_vectors[:, WORD_DIM:] / part.grams[:, None].astype(np.float32)
    np.add.at(grad["char"], part.gram, np.repeat(spread, part.grams, axis=0))
    return grad, p


class _Part(Inputs):
    """The given distinct words alone."""

    def __init__(self, whole: Inputs, chosen: np.ndarray):
        begin = np.cumsum(whole.grams) - whole.grams
        self.n, self.slot, self.grams = len(chosen), whole.slot[chosen], whole.grams[chosen]
        size = self.grams
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[chosen], size)
        self.gram = whole.gram[place]


def _laid_out(inputs: Inputs, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes and mask of windows; places past the end point at the extra row."""
    steps = np.arange(WINDOW)
    mask = steps < size[:, None]
    if not len(inputs.word):
        return np.full(mask.shape, inputs.n), mask.astype(np.float32)
    at = np.minimum(start[:, None] + steps, len(inputs.word) - 1)
    return np.where(mask, inputs.word[at], inputs.n), mask.astype(np.float32)


def window_logits(net: dict, inputs: Inputs, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows, and their texts."""
    start, size, row = windows(inputs.first)
    gates = project(net, inputs.vectors(net))
    out = np.empty(len(start), np.float32)
    for i in range(0, len(start), chunk):
        index, mask = _laid_out(inputs, start[i : i + chunk], size[i : i + chunk])
        out[i : i + chunk] = forward(net, gates, index, mask)
    return out, row


def text_logits(net: dict, inputs: Inputs) -> np.ndarray:
    logit, row = window_logits(net, inputs)
    n = len(inputs.first) - 1
    return np.maximum.reduceat(logit, np.searchsorted(row, np.arange(n))) if n else logit


def train(texts: pa.Array, labels: np.ndarray, per_text: int = PER_TEXT, seed: int = 7) -> dict:
    """Weights and calibration, from the texts and their 0/1 labels (both must occur).

    First all chosen windows carry their text's label. Then a positive text teaches by the windows
    that score highest in it, since the others may well be clean.
    """
    rng = np.random.default_rng(seed)
    net = new_net(seed)
    inputs = Inputs(texts)
    start, size, row = windows(inputs.first)
    order = rng.permutation(len(row))
    rank = np.empty(len(row), np.int64)
    by = order[np.argsort(row[order], kind="stable")]
    rank[by] = np.arange(len(row)) - np.searchsorted(row, row)
    chosen = np.flatnonzero(rank < per_text)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    text = rows_of(np.arange(len(inputs.word)), inputs.first)
    uses = np.unique(text * WORD_SLOTS + inputs.slot[inputs.word]) % WORD_SLOTS
    net["seen"] = (np.bincount(uses, minlength=WORD_SLOTS) >= SEEN).astype(np.float32)
    step = 0

    def epoch(which: np.ndarray, rate: float):
        nonlocal step
        which = rng.permutation(which)
        positive = labels[row[which]].mean()
        for i in range(0, len(which), 256):
            some = which[i : i + 256]
            index, mask = _laid_out(inputs, start[some], size[some])
            target = labels[row[some]].astype(np.float32)
            weights = np.where(target > 0, 1 - positive, positive).astype(np.float32) + np.float32(1e-3)
            grad, _ = _gradients(net, inputs, index, mask, target, weights)
            step += 1
            for k, g in grad.items():
                a, b = moment[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                net[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
                if k in ("word", "char"):
                    net[k] *= 1 - rate * DECAY

    least = 120 * 256  # windows in an epoch, by repeating a small sample
    for rate in (0.01, 0.005):
        epoch(np.tile(chosen, max(1, least // (2 * max(len(chosen), 1)))), rate)
    for rate in (0.005, 0.003):
        logit, _ = window_logits(net, inputs)
        by = np.lexsort((-logit, row))
        best = np.arange(len(by)) - np.searchsorted(row, row)
        top = by[best < 2]
        hard = top[(labels[row[top]] == 0) | (best[best < 2] == 0)]
        easy = chosen[labels[row[chosen]] == 0]
        easy = rng.permutation(easy)[: len(hard)]
        which = np.concatenate([hard, easy])
        epoch(np.tile(which, max(1, least // (4 * max(len(which), 1)))), rate)
    # One slope and offset on the highest window of each text, classes of equal weight.
    x, y = text_logits(net, inputs).astype(np.float64), labels.astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    middle, spread = x.mean(), x.std() + 1e-6
    x = (x - middle) / spread
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        a, b = a - 4 * ((g * x).sum() + 1e-3 * a), b - 4 * g.sum()
    net["slope"], net["offset"] = a / spread, b - a * middle / spread
    return net


# -- Spark -----------------------------------------------------------------------------------------


def _fitting(sizes: list[tuple[int, int]], limit: int) -> set[int]:
    """Ids, in the order given, whose texts fit into ``limit`` bytes together; if none does, the shortest."""
    chosen, total = set(), 0
    for i, n in sizes:
        if total + n <= limit:
            chosen.add(i)
            total += n
    return chosen or {i for i, _ in sorted(sizes, key=lambda x: x[1])[:1]}


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> dict | float:
    """A network, or the one class that the labels hold as a constant score (0.0 without labels).

    ``labels`` are the rows to learn from. At most ``sample`` ids of each class are taken, lowest
    hash first; of their texts those that fit into ``SAMPLE_BYTES`` a class come to the driver. Where
    none fits, the class has its shortest one.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).filter("i is not null and y in (0, 1)")
    picked = [
        r for y in (0, 1) for r in known.filter(F.col("y") == y).dropDuplicates(["i"]).orderBy(F.xxhash64("i"), "i").limit(sample).collect()
    ]
    classes = {int(r["y"]) for r in picked}
    if len(classes) < 2:
        return float(classes.pop()) if classes else 0.0
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(r["i"]), int(r["y"])) for r in picked], "i long, y int").dropDuplicates(["i"]))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(wanted, "i")
    sizes = rows.groupBy("i").agg(F.max(F.coalesce(F.octet_length("t"), F.lit(0))).alias("n"))
    size = {r["i"]: r["n"] for r in sizes.collect()}
    fits = set()
    for y in (0, 1):
        fits |= _fitting([(r["i"], size[r["i"]]) for r in picked if r["y"] == y and r["i"] in size], SAMPLE_BYTES)
    rows = rows.filter(F.col("i").isin(sorted(fits))) if len(fits) < len(size) else rows
    rows = rows.dropDuplicates(["i"]).orderBy("i").toArrow()
    y = rows.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.0
    return train(rows.column("t"), y)


def score(docs: DataFrame, net: dict | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text (under a spare name if the column exists)."""
    name = spare_name(score_col, docs.columns)
    schema = T.StructType([*docs.schema, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for whole in batches:
            at = text_bytes(whole.column(text_col))[1]
            i = 0
            while i < whole.num_rows:
                j = min(max(int(np.searchsorted(at, at[i] + (4 << 20), "right")) - 1, i + 1), whole.num_rows)
                batch = whole.slice(i, j - i)
                if isinstance(net, float):
                    value = np.full(batch.num_rows, net)
                else:
                    x = text_logits(net, Inputs(batch.column(text_col))).astype(np.float64)
                    value = 1 / (1 + np.exp(-np.clip(net["slope"] * x + net["offset"], -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=schema.names)
                i = j

    return docs.mapInArrow(run, schema)
