"""Substring dedup by line hashing.

A text's pieces are its lines, cut further behind each sentence end (``.``, ``!`` or ``?``
with white space after it), so that a passage is found inside a longer line as well.
Pieces are normalised (A-Z lower-cased, white space runs to one space, trimmed). A
piece is long if it has ``min_words`` words or ``MIN_CHARS`` code points or more, where
two code points of a script without spaces count as a word besides. Each long piece
is hashed to 128 bits. Short ones are hashed in passages: from each piece of a run of
short ones (blank ones neither count nor end the run) as many as make ``run_words``
words, so a passage is found wherever it lies in a run, but for a tail smaller than
one short piece. Short pieces outside such passages are left alone.

Of all occurrences of a digest in the corpus the earliest ranked one stays (lowest
doc_id, then text hash, then place in the text) and the pieces of the others go; a
passage that overlaps the one it repeats loses only what lies behind it. Offsets of
what goes are kept as code points of the original text. The rest is joined again as
it stood; a line of which nothing is left goes with its line feed.

Counting is a partial aggregation per digest, and occurrences meet only the one
surviving place of their digest, so a piece that a third of all documents share
makes no large group.

Defined cases: null text stays null and has no units; empty text has none either;
rows that share doc_id and text are one document (what one keeps, both keep); rows
without doc_id rank after all others; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import SPACE, as_bytes, as_text, map_batches, stored, table

#: Shorter lines recur by chance; alone they are left alone, see RUN_WORDS.
MIN_WORDS = 6
#: Code points that make a line long with fewer words.
MIN_CHARS = 60
#: Words of a passage of short lines.
RUN_WORDS = 50
#: Two of these count as a word: Thai to Burmese, Khmer, Han with kana and bopomofo.
NO_SPACES = re.compile(
    "[\u0e00-\u109f\u1780-\u17ff\u2e80-\u312f\u31a0-\ua4cf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]"
)

_SENTENCE = re.compile(rb"([.!?][ \t\x0b\x0c\r]+)")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _hash() -> Column:
    return F.xxhash64("text").alias("th")


def size(words: list[bytes]) -> tuple[int, int]:
    """Words and code points of a normalised line."""
    line = b" ".join(words)
    if line.isascii():
        return len(words), len(line)
    text = line.decode()
    return len(words) + len(NO_SPACES.findall(text)) // 2, len(text)


def pieces(line: bytes) -> list[bytes]:
    """The sentences of a line, each with the white space behind it."""
    return _SENTENCE.sub(rb"\1\n", line).split(b"\n")


def passages(run: list[tuple[int, bytes, int]], run_words: int | None) -> list[tuple[int, int, bytes]]:
    """First piece, last piece and content of each passage of a run of short pieces
    (place, normal form, words)."""
    found, end, held = [], 0, 0
    if run_words is None:
        return found
    for k, (first, _, words) in enumerate(run):
        while held < run_words and end < len(run):
            held += run[end][2]
            end += 1
        if held < run_words:
            break
        found.append((first, run[end - 1][0], b"\n".join(line for _, line, _ in run[k:end])))
        held -= words
    return found


def text_units(
    text: bytes, min_words: int = MIN_WORDS, run_words: int | None = RUN_WORDS
) -> list[tuple[int, int, bytes]]:
    """First piece, last piece and content of each unit of a text."""
    found: list[tuple[int, int, bytes]] = []
    run: list[tuple[int, bytes, int]] = []
    for k, piece in enumerate(p for line in text.split(b"\n") for p in pieces(line)):
        words = piece.translate(_LOWER).split()
        if len(words) < min_words:
            n, chars = size(words)
            if n < min_words and chars < MIN_CHARS:
                if words:
                    run.append((k, b" ".join(words), n))
                continue
        found += passages(run, run_words)
        run = []
        found.append((k, k, b" ".join(words)))
    return found + passages(run, run_words)


def units(docs: DataFrame, min_words: int = MIN_WORDS, run_words: int | None = RUN_WORDS) -> DataFrame:
    """doc_id, th (text hash), unit (its first piece), last (its last piece), digest of
    every unit that counts."""

    def make():
        import xxhash

        def step(batch):
            out: tuple = ([], [], [], [], [])
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, th, text in zip(ids, hashes, as_bytes(batch.column(2))):
                for first, last, content in text_units(text, min_words, run_words) if text else ():
                    for column, v in zip(out, (doc_id, th, first, last, xxhash.xxh3_128_digest(content))):
                        column.append(v)
            return [*out[:4], pa.array(out[4], pa.binary())]

        return step

    return map_batches(
        docs.select("doc_id", _hash(), "text"), "doc_id long, th long, unit int, last int, digest binary", make
    )


def removals(
    docs: DataFrame, min_words: int = MIN_WORDS, run_words: int | None = RUN_WORDS
) -> DataFrame:
    """doc_id, th, gone (first and last pieces of what another occurrence stands for)."""
    found = units(docs, min_words, run_words)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "unit", "last")
    kept = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("end"))
    kept = kept.where(~F.col("first").eqNullSafe(F.col("end"))).select("digest", "first")
    again = found.join(kept, "digest").where(~place.eqNullSafe(F.col("first")))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    start = F.when(same, F.greatest("unit", F.col("first.last") + 1)).otherwise(F.col("unit"))
    gone = again.select("doc_id", "th", F.struct(start.alias("start"), "last").alias("lines"))
    return gone.groupBy("doc_id", "th").agg(F.collect_set("lines").alias("gone"))


RESULT = (
    "doc_id long, n_units long, n_removed long, n_removed_chars long, "
    "removed array<struct<start:int,end:int>>, text string"
)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, run_words: int | None = RUN_WORDS) -> DataFrame:
    """One row per document: n_units, n_removed, n_removed_chars, removed (offsets in
    the original text, ends exclusive), text (what is left); n_units counts pieces. Without
    ``run_words``, short pieces are left alone wherever they lie."""
    gone = removals(docs, min_words, run_words).select(F.col("doc_id").alias("i"), F.col("th").alias("h"), "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash(), "text")
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["i"]) & (rows["th"] == gone["h"]), "left")

    def make():
        def step(batch):
            out: tuple = ([], [], [], [], [])
            for text, gone in zip(as_text(batch.column(1)), batch.column(2).to_pylist()):
                drop = {k for g in gone or () for k in range(g["start"], g["last"] + 1)}
                spans, at, n, kept = [], 0, 0, []
                for line in text.split("\n") if text else ():
                    left = []
                    for piece in map(bytes.decode, pieces(line.encode())):
                        if n in drop:
                            spans.append({"start": at, "end": at + len(piece)})
                        else:
                            left.append(piece)
                        at += len(piece)
                        n += 1
                    at += 1
                    if left:
                        kept.append("".join(left))
                values = (
                    n, len(spans), sum(s["end"] - s["start"] for s in spans), spans,
                    "\n".join(kept) if text else text,
                )
                for column, v in zip(out, values):
                    column.append(v)
            return [batch.column(0), *out]

        return step

    return map_batches(rows.select("doc_id", "text", "gone"), RESULT, make)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"]))
    return found.withColumn("removed", F.array_join(spans, ","))


#: The code points of NO_SPACES.
_SQL_NO_SPACES = (
    r"[\x{0e00}-\x{109f}\x{1780}-\x{17ff}\x{2e80}-\x{312f}\x{31a0}-\x{a4cf}\x{f900}-\x{faff}"
    r"\x{ff66}-\x{ff9f}\x{1b000}-\x{1b16f}\x{20000}-\x{3ffff}]"
)

#: Needs distinct doc_ids, as the given tables have.
OP5_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
  FROM documents WHERE text <> ''),
cut AS (
  SELECT doc_id, ln, string_split(regexp_replace(line, '([.!?][\x20\x09\x0B\x0C\x0D]+)', '\1' || chr(10), 'g'), chr(10)) AS ps FROM lines),
pieces AS (
  SELECT doc_id, ln, piece, row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) - 1 AS p
  FROM (SELECT doc_id, ln, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM cut)),
placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + ln - 1 AS a
  FROM pieces),
normal AS (
  SELECT *, array_to_string(w, ' ') AS norm, len(w) AS words FROM (
    SELECT *, list_filter(regexp_split_to_array(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM placed)),
sized AS (
  SELECT *, n >= {MIN_WORDS} OR length(norm) >= {MIN_CHARS} AS long FROM (
    SELECT *, words + len(regexp_extract_all(norm, '{_SQL_NO_SPACES}')) // 2 AS n FROM normal)),
runs AS (SELECT *, sum(CAST(long AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM sized),
shorts AS (
  SELECT doc_id, p, norm, n, run, sum(n) OVER (PARTITION BY doc_id, run ORDER BY p) AS upto, sum(n) OVER (PARTITION BY doc_id, run) AS total
  FROM runs WHERE NOT long AND words > 0),
ends AS (
  SELECT s.doc_id, s.run, s.p AS unit, min(e.p) AS last FROM shorts s JOIN shorts e
    ON s.doc_id = e.doc_id AND s.run = e.run AND e.p >= s.p AND e.upto - s.upto + s.n >= {RUN_WORDS}
  WHERE s.total >= {RUN_WORDS} GROUP BY ALL),
units AS (
  SELECT doc_id, p AS unit, p AS last, norm AS content FROM sized WHERE long
  UNION ALL
  SELECT e.doc_id, unit, last, string_agg(norm, chr(10) ORDER BY p) FROM ends e JOIN shorts x
    ON e.doc_id = x.doc_id AND e.run = x.run AND x.p BETWEEN unit AND last GROUP BY e.doc_id, unit, last),
ranked AS (
  SELECT *, first(doc_id) OVER same AS first_id, first(unit) OVER same AS first_unit, first(last) OVER same AS first_last
  FROM units WINDOW same AS (PARTITION BY content ORDER BY doc_id, unit)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first_id THEN greatest(unit, first_last + 1) ELSE unit END, last + 1)) AS p
  FROM ranked WHERE (doc_id, unit) <> (first_id, first_unit)),
marked AS (SELECT placed.*, gone.p IS NOT NULL AS gone FROM placed LEFT JOIN gone USING (doc_id, p)),
kept AS (
  SELECT doc_id, ln, string_agg(piece, '' ORDER BY p) FILTER (NOT gone) AS line FROM marked GROUP BY doc_id, ln),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM kept GROUP BY doc_id),
counts AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, sum(length(piece)) FILTER (gone) AS chars,
    string_agg(concat(a, ':', a + length(piece)), ',' ORDER BY p) FILTER (gone) AS removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(chars, 0) AS BIGINT) AS n_removed_chars, coalesce(removed, '') AS removed,
  CASE WHEN d.text <> '' THEN coalesce(texts.text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN texts USING (doc_id)
"""
