"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as a linked list of byte symbols; a heap holds the ranks
of adjacent pairs; the lowest-ranked pair (leftmost among equals) is merged
until none is left. Its token count is the initial number of symbols minus the
merges made; token identifiers are never emitted.

Texts are cut before every space that precedes a non-space: no pre-token of the
byte-level pattern spans such a place, so counts per piece add up and a bounded
per-worker cache answers repeated pieces.

Defined cases: null or empty text has 0 bytes and 0 tokens; special strings
inside a text are one token each, as the tokenizer library does by default;
repeated rows are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import as_text, kept_by, map_batches, table

#: Pieces longer than this are counted anew each time, to bound the cache.
CACHED_CHARS = 64
#: Pieces, and pre-tokens, that a worker keeps.
CACHED = 1 << 18
LIMIT = 512
#: Unicode White_Space, the class \s of the tokenizer library (Python's \s is wider).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level pre-tokenizer's pattern (fixed value).
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
).replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(own)))
    return [table[b] for b in range(256)]


def merge_list(model: dict) -> list[tuple[str, str]]:
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


class HeapMerger:
    """Counts what is left of a symbol sequence after all merges.

    Symbols are numbered so that merge number r makes symbol ``first + r``; a heap
    entry is one integer, rank then place, so that it pops in that order."""

    def __init__(self, merges: list[tuple[str, str]], symbols: list[str]) -> None:
        number: dict[str, int] = {s: i for i, s in enumerate(symbols)}
        self.first = first = len(symbols)
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault(number[a] << 32 | number[b], rank)
            number.setdefault(a + b, first + rank)
        self.made = [number[a + b] for a, b in merges]

    def count(self, symbols: bytes) -> int:
        get, n = self.pairs.get, len(symbols)
        if n < 2:
            return n
        symbols = list(symbols)
        heap = []
        for i in range(n - 1):
            rank = get(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return n
        heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made, merges = self.made, 0
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            a, j = symbols[i], following[i]
            if a < 0 or j >= n or get(a << 32 | symbols[j]) != rank:
                continue  # one of the two has been merged since
            a = symbols[i] = made[rank]
            symbols[j] = -1
            merges += 1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                rank = get(a << 32 | symbols[k])
                if rank is not None:
                    heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = get(symbols[h] << 32 | a)
                if rank is not None:
                    heappush(heap, rank << 32 | h)
        return n - merges


class _Merged(dict):
    """Counts of pre-tokens, kept per worker."""

    def __init__(self, merger: HeapMerger) -> None:
        self.merger = merger

    def __missing__(self, token: str) -> int:
        n = self.merger.count(token.encode())
        if len(token) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[token] = n
        return n


class TokenCounter:
    """Token count of a text under a byte-level BPE file without normalizer."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = HeapMerger(merge_list(spec["model"]), byte_symbols())
        self.merged = _Merged(self.merger)
        self.pretoken = regex.compile(PRETOKEN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = special
        self.cut = re.compile("(?:" + "|".join(map(re.escape, special)) + ")") if special else None
        self.white = re.compile(f"[{WHITE}]")
        self.piece = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.spaced = _Counts(self, " ")
        self.bare = _Counts(self, "")

    def whole(self, text: str) -> int:
        """Count by the pattern's pre-tokens."""
        return sum(map(self.merged.__getitem__, self.pretoken.findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        for s in self.special:
            if s in text:
                parts = self.cut.split(text)
                return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        try:
            return (self.bare[first] if first else 0) + sum(map(self.spaced.__getitem__, rest))
        except _NoCut:  # several spaces in a row, or a space before other white space
            return sum(map(self.bare.__getitem__, self.piece.findall(text)))


class _NoCut(Exception):
    pass


class _Counts(dict):
    def __init__(self, counter: TokenCounter, lead: str) -> None:
        self.counter, self.lead = counter, lead

    def __missing__(self, piece: str) -> int:
        if self.lead and (not piece or self.counter.white.match(piece)):
            raise _NoCut
        n = self.counter.whole(self.lead + piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


_COUNTERS: dict[str, TokenCounter] = kept_by(__name__)


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text. ``name`` is looked up on
    each executor; ``path`` names a file that every executor can open instead."""

    def make():
        count = counter(path or tokenizer_path(name)).count

        def step(batch):
            texts = as_text(batch.column(1))
            return [
                batch.column(0),
                [len(t.encode()) if t else 0 for t in texts],
                [count(t) for t in texts],
            ]

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long", make)


def op6(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn(
        "over_limit", F.col("n_tokens") > LIMIT
    )
