"""Rows that every operator must take, and plain-Python versions of the contracts."""

import hashlib
import re
from collections import Counter

EXTRA = "key long, n int, kept string, digest string, spans string, n_words string, c long, _key long, u string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"

LONG = " ".join(f"word{k % 977} and{k}" for k in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog and the river runs to the sea. "


def awkward_rows():
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, LONG), (6, PROSE * 3), (6, PROSE * 3),
        (7, PROSE * 3 + "Nothing else."), (None, PROSE * 3), (8, "ÀÉ 漢字 🙂\nÀÉ 漢字 🙂"), (9, "one"), (10, "\x00\x1c x"),
    ]
    return [(i, t, None, None, None if t is None else len(t)) + (1,) * 2 + ("x",) * 4 + (2, 3, "u") for i, t in texts]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = space_words(lowered(text))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(rows, size, percent):
    """component_id of each row by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(root(i))) for i, (doc_id, _) in enumerate(rows)]


def without_repeats(rows, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out
