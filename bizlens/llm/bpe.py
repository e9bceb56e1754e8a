"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens: a path spells a word's symbols and carries its
tokens as arc labels, and exactly one path through it spells each word. It is
compiled by adding one gadget per merge, in merge order. The gadget of
``u + v -> w`` removes the arc ``v`` from the state behind ``u``, lets every state
that had an arc ``u`` (whose target had ``v``) have an arc ``w``, and gives the state
behind ``w`` the arcs that the state behind ``v`` has at that time.

Written out, the arcs are a square table over the vocabulary (2.4e9 entries for
49 k tokens), so states keep only their gadget (left part, right part, time) and
an arc's existence is followed back through the gadgets on first use and kept
in a bounded transition table. Encoding a word reads each symbol once: a table of
transitions over all labels names the tokens that end at the symbol, and the one
with an arc from the state reached at its start continues the path. Decoding
emits the labels of the arcs.

Words are pre-split (normalised to NFC, lower-cased, cut by the file's pattern).
Per worker, stretches between white space, words and arcs are kept in two
generations each: a full table becomes the old one, which is asked before
anything is worked out anew, and the older one goes. Decoding holds the labels
only, no automaton.

Defined cases: null or empty text has no ids and decodes to the empty string;
special strings inside a text are one id each; repeated rows are encoded one by
one; other columns are ignored by ``encode`` and ``decode``.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import as_bytes, as_text, kept_by, map_batches, table
from bizlens.llm.token_counts import CACHED_CHARS, WHITE, byte_symbols, merge_list, tokenizer_path

#: The pre-split pattern of word_bpe_49k.json (fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+".replace(r"\s", WHITE)

#: Words, stretches and arcs that a worker keeps, each, in one of two generations.
CACHED = 1 << 17


class Recent(dict):
    """A dict of bounded size; what was put in lately is found again."""

    def __init__(self, size: int = CACHED) -> None:
        super().__init__()
        self.size, self.old = size, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def revive(self, key):
        """The value of a key that only the old generation may hold, or None."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value


class MergeAutomaton:
    """The token automaton of a merge list; states are named by the label of
    the arcs that lead to them (0: the start)."""

    def __init__(self, merges: list[tuple[str, str]], symbols: list[str]) -> None:
        self.labels = [""]
        #: one character for each symbol, and the labels spelled in them
        self.letter = {s: chr(1 + k) for k, s in enumerate(symbols)}
        self.spelled = [""]
        self.number: dict[str, int] = {}
        self.left, self.right, self.time = [0], [0], [-1]
        self.gadget: dict[tuple[int, int], int] = {}
        for s in symbols:
            self._state(s, 0, 0, -1)
        for time, (a, b) in enumerate(merges):
            u, v = self.number[a], self.number[b]
            if (u, v) in self.gadget:
                continue
            self.gadget[u, v] = time
            if a + b not in self.number:  # else the label exists; its first gadget stands
                self._state(a + b, u, v, time)
        self.arcs = Recent()
        # an arc w appears only where u was followed by v when its gadget was added
        self.arc_of: dict[str, int] = {}
        real = [True] * len(self.labels)
        for t in range(1, len(self.labels)):
            if self.time[t] >= 0:
                u, v = self.left[t], self.right[t]
                real[t] = real[u] and real[v] and self._arc(u, v, self.time[t])
            if real[t]:
                self.arc_of[self.spelled[t]] = t
        self.ends = ahocorasick.Automaton()
        for spelled, t in self.arc_of.items():
            self.ends.add_word(spelled, (t, len(spelled)))
        self.ends.make_automaton()

    def _state(self, label: str, left: int, right: int, time: int) -> None:
        self.number[label] = len(self.labels)
        self.labels.append(label)
        self.spelled.append(self.spelled[left] + self.spelled[right] if left else self.letter[label])
        self.left.append(left)
        self.right.append(right)
        self.time.append(time)

    def arc(self, state: int, label: int) -> bool:
        """Whether the state has the arc once all gadgets are in."""
        if not state:
            return True
        key = state * len(self.labels) + label
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs.revive(key)
        if known is None:
            known = self._arc(state, label, len(self.labels))
            self.arcs.keep(key, known)
        return known

    def _arc(self, p: int, t: int, limit: int) -> bool:
        """Whether the state behind p has the arc t before the gadget ``limit``."""
        time = self.time
        wins = False  # whether a gadget of just that time still removes the arc
        while True:
            removed = self.gadget.get((p, t))
            if removed is not None and (removed < limit or wins and removed == limit):
                return False
            if time[p] < 0 and time[t] < 0:
                return True
            if time[p] >= time[t]:  # behind p: a copy of what was behind its right part
                limit, wins, p = time[p], False, self.right[p]
            else:  # to t: wherever its left part led; of equals the left one merges first
                wins = wins or time[t] < limit  # unless p's own merge of that time came first
                limit, t = time[t], self.left[t]

    def walk(self, symbols: list[str]) -> list[int]:
        """Labels along the one path that spells the symbols."""
        return self.path("".join([self.letter[s] for s in symbols]))

    def path(self, word: str) -> list[int]:
        """The same for a word written in the symbols' letters."""
        if (whole := self.arc_of.get(word)) is not None:
            return [whole]
        n = len(word)
        at, size = [0] * (n + 1), [0] * (n + 1)  # behind each symbol: the state, its label's length
        known, width = self.arcs.get, len(self.labels)
        for last, (token, length) in self.ends.iter(word):
            end = last + 1
            if size[end]:
                continue
            state = at[end - length]
            if state:
                there = known(state * width + token)
                if there is None:
                    there = self.arc(state, token)
                if not there:
                    continue
            at[end], size[end] = token, length
        path, end = [], n
        while end:
            if not size[end]:
                raise AssertionError(word)
            path.append(at[end])
            end -= size[end]
        return path[::-1]


class WordLabels:
    """Decoder of a word-end BPE file: the labels of its ids and nothing else."""

    def __init__(self, spec: dict) -> None:
        self.label = {i: t for t, i in spec["model"]["vocab"].items()}
        self.label |= {t["id"]: t["content"] for t in spec["added_tokens"]}

    def decode(self, ids: bytes | None) -> str:
        """The labels of the ids, one space between two, as the library gives them
        for a file without decoder."""
        label = self.label
        return " ".join([label[i] for i in memoryview(ids).cast("I")]) if ids else ""


class WordBpe:
    """Encoder and decoder of a word-end BPE file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        chars = byte_symbols()
        symbols = list(dict.fromkeys(chars + [c + self.suffix for c in chars]))
        self.automaton = MergeAutomaton(merge_list(model), symbols)
        letter = self.automaton.letter
        self.inner = {b: letter[c] for b, c in enumerate(chars)}
        self.final = [letter[c + self.suffix] for c in chars]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        cut = sorted(added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, cut)) + ")") if cut else None
        self.word = regex.compile(WORD)
        self.space = re.compile(f"[{WHITE}]+")
        self.decode = WordLabels(spec).decode
        self.ids = [self.vocab.get(label, -1) for label in self.automaton.labels]
        self.words = Recent()
        self.known = Recent()

    def _stretch(self, stretch: str) -> bytes:
        short = len(stretch) <= CACHED_CHARS
        if short and (out := self.known.revive(stretch)) is not None:
            return out
        if stretch.isascii():
            text = stretch.lower()
        else:
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", stretch)])
        known, make = self.words.get, self._word
        out = b"".join([known(w) or make(w) for w in self.word.findall(text)])
        if short:
            self.known.keep(stretch, out)
        return out

    def _word(self, word: str) -> bytes:
        short = len(word) <= CACHED_CHARS
        if short and (ids := self.words.revive(word)) is not None:
            return ids
        data = word.encode()
        spelled = data[:-1].decode("latin-1").translate(self.inner) + self.final[data[-1]]
        number = self.ids
        path = [number[s] for s in self.automaton.path(spelled)]
        ids = struct.pack(f"<{len(path)}I", *path)
        if short:
            self.words.keep(word, ids)
        return ids

    def _plain(self, text: str) -> list[bytes]:
        # str.split() also cuts at U+001C to U+001F, which are no white space here
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        known, make = self.known, self._stretch
        return [
            known.get(s) or make(s) for s in (self.space.split(text) if odd else text.split()) if s
        ]

    def encode(self, text: str | None) -> tuple[bytes, int]:
        """Ids as little-endian unsigned 32-bit integers, and their number."""
        if not text:
            return b"", 0
        if self.cut and any(s in text for s in self.added):
            parts: list[bytes] = []
            for k, piece in enumerate(self.cut.split(text)):
                if k % 2:
                    parts.append(struct.pack("<I", self.added[piece]))
                else:
                    parts += self._plain(piece)
        else:
            parts = self._plain(text)
        ids = b"".join(parts)
        return ids, len(ids) // 4


_CODERS: dict[str, WordBpe | WordLabels] = kept_by(__name__)


def coder(path: str) -> WordBpe:
    if path not in _CODERS:
        _CODERS[path] = WordBpe(path)
    return _CODERS[path]


def labels(path: str) -> WordLabels:
    key = f"labels:{path}"
    if key not in _CODERS:
        with open(path, encoding="utf-8") as f:
            _CODERS[key] = WordLabels(json.load(f))
    return _CODERS[key]


def encode(docs: DataFrame, name: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""

    def make():
        run = coder(path or tokenizer_path(name)).encode

        def step(batch):
            found = [run(t) for t in as_text(batch.column(1))]
            return [batch.column(0), [n for _, n in found], pa.array([b for b, _ in found], pa.binary())]

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids binary", make)


def decode(encoded: DataFrame, name: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and decoded: the text that the ids stand for."""

    def make():
        run = labels(path or tokenizer_path(name)).decode

        def step(batch):
            return [*batch.columns, [run(b) for b in as_bytes(batch.column(2))]]

        return step

    return map_batches(
        encoded.select("doc_id", "n_tokens", "ids"),
        "doc_id long, n_tokens long, ids binary, decoded string",
        make,
    )


def encoded_and_decoded(docs: DataFrame) -> DataFrame:
    return decode(encode(docs)).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return encoded_and_decoded(table(spark, sf_dir, "documents"))
