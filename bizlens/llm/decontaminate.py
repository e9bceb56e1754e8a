"""Benchmark decontamination: one Aho-Corasick automaton over test items.

Texts are normalised by lower-casing A-Z and keeping words of ASCII letters,
digits and any character beyond ASCII. A benchmark item's windows are its runs
of ``window`` consecutive words (an item with fewer words, but not none, is one
window). All windows of all items go into one automaton over word numbers, so
each document is scanned once however many items there are. Word positions of
hits map back to offsets (in code points) of the original text.

Defined cases: null or empty text has no words, is not hit and has no items;
null or wordless benchmark texts and null item_ids are no items; repeated items
count once by item_id; repeated documents are judged one by one; other columns
are ignored by ``report`` and passed through by ``drop_contaminated``.

The automaton is broadcast. Its size is bounded: the benchmark is cut into
blocks of at most ``block_words`` words (a pass over the documents each; the
usual benchmark is one block), with lineage cut between passes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import ALNUM, as_bytes, as_text, cut_lineage, keep_rows, kept_by, map_batches

WINDOW = 10
#: Words of benchmark text per automaton: about ten trie nodes each, some 100 MB.
BLOCK_WORDS = 200_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

REPORT = (
    "doc_id long, n_words long, n_hit long, items array<string>, "
    "spans array<struct<start:int,end:int>>"
)


class ItemAutomaton:
    """Automaton over the windows of (item_id, text) pairs, on word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = text.translate(ALNUM).split()
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, who in owners.items():
            self.automaton.add_word(ids, (len(ids), tuple(who)))
        self.size = len(owners)
        if owners:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [first, last + 1) runs of hit words, and the items that occur."""
        runs: list[list[int]] = []
        found: set[str] = set()
        if not self.size or not words:
            return runs, found
        get = self.numbers.get
        for end, (length, who) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            start = end + 1 - length
            found.update(who)
            while runs and runs[-1][1] >= start:  # a shorter window may end first
                start = min(start, runs.pop()[0])
            runs.append([start, end + 1])
        return runs, found


def _items(benchmark: DataFrame, blocks: int, block: int) -> list[tuple[str, bytes]]:
    rows = (
        benchmark.where("item_id is not null and text is not null")
        .where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)) == block)
        .select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
        .distinct()
        .collect()  # at most about block_words words
    )
    return [(r.i, bytes(r.t)) for r in rows]


def _block_count(benchmark: DataFrame, block_words: int) -> int:
    # every word is followed by another character, so half the bytes bound the words
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-(total // 2) // block_words))


def _char_spans(text: str, runs: list[list[int]]) -> list[dict]:
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))] if runs else []
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _merge(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def report(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: n_words, n_hit (words inside hits), items (distinct
    item_ids that occur, sorted as strings), spans (hit stretches as code-point
    offsets of the original text, end exclusive)."""
    blocks = _block_count(benchmark, block_words)
    frame = docs.select("doc_id", "text")
    for block in range(blocks - 1):  # all blocks but the last only gather hits
        frame = cut_lineage(_gather(frame, _items(benchmark, blocks, block), window))
    automaton = frame.sparkSession.sparkContext.broadcast(_items(benchmark, blocks, blocks - 1))

    def make():
        build = _automaton(automaton.value, window)

        def step(batch):
            texts = as_bytes(batch.column(1))
            earlier = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
            n_words, n_hit, items, spans = [], [], [], []
            for t, before in zip(texts, earlier):
                words = t.translate(ALNUM).split() if t else []
                runs, found = build.hits(words)
                if before:
                    runs = _merge(runs + [list(x) for x in zip(before["runs"][::2], before["runs"][1::2])])
                    found |= set(before["items"])
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in runs))
                items.append(sorted(found))
                spans.append(_char_spans(t.decode(), runs) if runs else [])
            return [batch.column(0), n_words, n_hit, items, spans]

        return step

    return map_batches(frame, REPORT, make)


def _gather(frame: DataFrame, items: list, window: int) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(items)

    def make():
        build = _automaton(shared.value, window)

        def step(batch):
            texts = as_bytes(batch.column(1))
            earlier = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
            hits = []
            for t, before in zip(texts, earlier):
                runs, found = build.hits(t.translate(ALNUM).split() if t else [])
                flat = [x for run in runs for x in run]
                if before:
                    flat, found = before["runs"] + flat, found | set(before["items"])
                hits.append({"runs": flat, "items": sorted(found)})
            return [batch.column(0), batch.column(1), hits]

        return step

    return map_batches(
        frame, "doc_id long, text string, hits struct<runs:array<int>,items:array<string>>", make
    )


_BUILT: dict = kept_by(__name__)


def _automaton(items: list, window: int) -> ItemAutomaton:
    """Built once per worker and benchmark (the key is the content)."""
    key = (window, hash(tuple(items)))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemAutomaton(items, window)
    return _BUILT[key]


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of ``docs`` without any window of any item, all columns kept."""
    at = docs.columns.index("text")
    blocks = _block_count(benchmark, block_words)
    for block in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(_items(benchmark, blocks, block))

        def make(shared=shared):
            build = _automaton(shared.value, window)

            def step(batch):
                texts = as_bytes(batch.column(at))
                return [not t or not build.hits(t.translate(ALNUM).split())[0] for t in texts]

            return step

        docs = keep_rows(docs, make)
        if block < blocks - 1:
            docs = cut_lineage(docs)
    return docs


def op2(spark, sf_dir: str) -> DataFrame:
    from bizlens.llm.common import table

    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Windows of all items joined to the documents' word runs of the same length.
OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS k,
    array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
runs AS (
  SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM words, (SELECT DISTINCT k FROM windows) s, unnest(range(1, len(w) - k + 2)) AS t(i)
  WHERE len(w) >= k),
hits AS (SELECT r, i, k, item_id FROM runs JOIN windows USING (k, g)),
hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY r),
hit_items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
