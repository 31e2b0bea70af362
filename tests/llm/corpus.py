"""Small corpora with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib

from pyspark.sql import types as T

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Names that the operators use themselves.
CLASHING = ["block", "row", "body", "shard", "n_words", "n_removed", "score", "ids", "kept", "lang_pred", "words", "k", "_row"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def words(text):
    return SPACED.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def texts(seed=3):
    """(id, text) with copies, near copies, shared passages, odd characters, nulls and a long text."""
    rng = random.Random(seed)
    vocabulary = [rng.choice(["la", "über", "the", "of", "señ", "ion", "Wort", "xi"]) + str(rng.randrange(60)) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage = prose(60)
    rows = []
    for k in range(60):
        text = prose(rng.choice([1, 3, 4, 5, 12, 13, 40, 120]))
        if k % 4 == 0:
            text = text + "\n" + passage + "\n" + prose(5)
        rows.append((k * 3 + 1, text))
    base = rows[7][1] + " " + prose(200)
    rows.append((500, base))
    rows += [(501 + k, base) for k in range(5)]  # exact copies
    for k in range(8):  # near copies
        w = base.split(" ")
        for _ in range(k + 1):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((520 + k, " ".join(w)))
    chain = prose(100).split(" ")
    for k in range(6):  # a chain: neighbours are near, the ends are not
        rows.append((540 + k, " ".join(chain[4 * k : 4 * k + 70])))
    rows += [(600, None), (601, ""), (602, " \t\n\r\x0b\x0c "), (603, "  　x y"), (604, "!!! ### ..."), (605, "日本語 テスト"), (606, "😀 a😀b")]
    rows += [(607, base), (607, base), (607, "other text of the same id " + passage)]  # rows that repeat
    rows += [(None, base), (None, base), (None, None)]
    rows += [(-5, "spam spam spam spam spam " * 40), (700, "spam " * 3000 + passage), (701, "a" * 3000), (702, "a" * 500 + "b")]
    rows.append((703, " ".join(rng.choice(vocabulary) for _ in range(6000))))  # long
    return rows


def frame(spark, rows, extra=CLASHING):
    """The rows as documents, with extra columns whose names clash."""
    kinds = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    kinds += [T.StructField(c, T.StringType()) for c in extra]
    return spark.createDataFrame([(*r, *(f"x{k}" for k, _ in enumerate(extra))) for r in rows], T.StructType(kinds)).repartition(3)


def ordered(rows, columns):
    """Rows as sorted tuples, for comparison whatever their order."""
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def documents(spark, path, tables):
    """Write tables as a data folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


# -- brute force -----------------------------------------------------------------------------------


def repeated_words(rows, window=13):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def repeated_bytes(rows, length=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            if i is not None:
                least[b[k : k + length]] = min(least.get(b[k : k + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and least[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept)))
    return out


def quality(text):
    w = words(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    repeat = set()
    for k, x in enumerate(windows):
        if seen[x] > 1:
            repeat.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    return (
        n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat),
        n < 10 or 100 * len(repeat) > 20 * n,
    )


def contamination(rows, items, window=10):
    windows = {}
    for item, t in items:
        w = LETTERED.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in rows:
        w = LETTERED.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                x = windows.get(tuple(w[k : k + n]))
                if x:
                    hit.update(range(k, k + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def linked(a, b):
    return 100 * len(a & b) >= 75 * len(a | b) and bool(a or b)


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and linked(sets[a], sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]
