"""CSV records of files that many tasks read, with line breaks inside quoted fields.

A range of a file cannot tell by itself whether it begins inside a quoted field. So
the ranges are scanned twice. The first scan runs every range from both possible
starts and notes where each ends; it touches only lines that hold a quote, and the two
runs mostly meet at the first such line. Chaining the notes of a file's ranges (one row per
range) gives every range its true start. The second scan then cuts each range into
records. A record that spans ranges comes out in pieces, which are glued afterwards;
there are at most two pieces per range besides ranges that lie inside one field.

A quote opens a field only where the field begins, and inside a quoted field a doubled
quote is a character, so stray quotes in plain fields change nothing. Records end at
``\\n`` or ``\\r\\n`` outside quotes; breaks inside quotes are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.session import ship_package

BOM = "﻿"


_OPENING = re.compile('(?:^|,)"')
_CLOSING = re.compile('[^"]*+(?:""[^"]*+)*+"')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind ``line``, if one was (``inside``) before it."""
    at = 0
    while True:
        found = (_CLOSING.match if inside else _OPENING.search)(line, at)
        if not found:
            return inside
        at, inside = found.end(), not inside


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, pa.Array]]:
    """(file, range start), whether its first lines come now, lines; in order."""
    current = None
    for batch in batches:
        f, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = np.flatnonzero((np.diff(f) != 0) | (np.diff(b) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(f)]):
            if lo == hi:
                continue
            key = (int(f[lo]), int(b[lo]))
            yield key, key != current, batch.column(2).slice(lo, hi - lo)
            current = key


def _quoted(key: tuple[int, int], first: bool, lines: pa.Array) -> Iterator[tuple[int, str]]:
    """Place and text of the lines that hold a quote."""
    places = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    for k, line in zip(places.tolist(), lines.take(pa.array(places)).to_pylist()):
        yield k, line.removeprefix(BOM) if first and k == 0 and key[1] == 0 else line


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: whether it ends inside a field from either start, and whether
    a record that was open before it ends in it."""
    done: list = []
    for key, first, lines in _ranges(batches):
        if first:
            done.append([*key, False, True, False])
        plain, inside, shut = done[-1][2:]
        for _, line in _quoted(key, first, lines):
            same = plain == inside
            plain = ends_inside(line, plain)
            inside = plain if same else ends_inside(line, inside)
            shut = shut or not inside
        done[-1][2:] = plain, inside, shut
    if done:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*done)], names=["f", "b", "plain", "inside", "shut"]
        )


def _cut(starts: dict[tuple[int, int], int]):
    """Records of ranges; ``starts`` names the ranges that begin inside a record and the
    range that the record began in."""

    names = ["f", "b", "r", "text", "owner"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def rows(key, numbers, texts, owner=None):
        n = len(texts)
        columns = [[key[0]] * n, [key[1]] * n, numbers, texts, [owner] * n]
        return pa.RecordBatch.from_arrays(
            [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []  # lines of the record that is open
        key = current = owner = None
        seen = number = 0  # lines of the range so far; line that the open record began with

        def flush():
            if held:
                yield rows(current, [number], ["\n".join(held)], owner)
                held.clear()

        for key, first, lines in _ranges(batches):
            if first:
                if held and owner is None:
                    owner = current[1]  # it goes on in the next range
                yield from flush()
                current, seen, number = key, 0, 0
                owner = starts.get(key)
            inside = np.zeros(len(lines) + 1, bool)  # before each line, and behind the last
            state, at = bool(held) or (first and owner is not None), 0
            for k, line in _quoted(key, first, lines):
                inside[at : k + 1] = state
                state, at = ends_inside(line, state), k + 1
            inside[at:] = state
            begins = np.flatnonzero(~inside[:-1])
            head = int(begins[0]) if len(begins) else len(lines)
            held += lines.slice(0, head).to_pylist()
            if len(begins):
                yield from flush()
                owner = None
                ends = len(lines)
                if inside[-1]:  # the last record stays open
                    ends = int(begins[-1])
                    held += lines.slice(ends).to_pylist()
                    number = seen + ends
                    begins = begins[:-1]
                if len(begins):
                    texts = lines.slice(head, ends - head)
                    if len(begins) < len(texts):
                        offsets = pa.array(np.append(begins, ends) - head, pa.int32())
                        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, texts), "\n")
                    yield rows(key, pa.array(begins + seen), texts)
            elif not inside[-1]:
                yield from flush()
                owner = None
            seen += len(lines)
        if held and owner is None:
            owner = current[1]
        yield from flush()

    return run


_RANGE = "f long, b long, plain boolean, inside boolean, shut boolean"
_RECORD = "f long, b long, r long, text string, owner long"


def _starts(ranges: list[tuple[int, int, bool, bool, bool]]) -> dict[tuple[int, int], int]:
    """The ranges that begin inside a record, and the range where it began."""
    found: dict[tuple[int, int], int] = {}
    file = owner = None
    for f, b, plain, inside, shut in sorted(ranges):
        if f != file:
            file, owner = f, None
        if owner is None:
            owner = b if plain else None
            continue
        found[f, b] = owner
        if shut:
            owner = b if inside else None
    return found


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, b, r (order of records within a file), text of every record of the
    files but their first, the header. The driver sees one row per range."""
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(paths)
    path = F.col("_metadata.file_path")
    block = F.col("_metadata.file_block_start").alias("b")
    lines = lines.select(F.xxhash64(path).alias("f"), block, F.make_valid_utf8("value").alias("text"))
    ends = [tuple(r) for r in lines.mapInArrow(_scan, _RANGE).collect()]
    starts = _starts(ends)
    found = lines.mapInArrow(_cut(starts), _RECORD)
    whole = found.where("owner IS NULL").select("f", "b", "r", "text")
    if starts:
        # only the ranges that share a record with another are read for its pieces
        wanted = sorted({key for key in starts} | {(f, owner) for (f, _), owner in starts.items()})
        near = F.broadcast(spark.createDataFrame(wanted, "f long, b long"))
        pieces = lines.join(near, ["f", "b"], "left_semi").select("f", "b", "text")
        pieces = pieces.mapInArrow(_cut(starts), _RECORD).where("owner IS NOT NULL")
        place = F.struct("b", "r", "text")
        parts = pieces.groupBy("f", F.col("owner").alias("b")).agg(F.array_sort(F.collect_list(place)).alias("parts"))
        whole = whole.unionByName(
            parts.select(
                "f", "b", F.col("parts")[0]["r"].alias("r"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text")
            )
        )
    named = _named_files(spark, paths)
    whole = whole.where("NOT (b = 0 AND r = 0)").join(named, "f")
    return whole.select("source_file", "b", "r", F.regexp_replace("text", "\r$", "").alias("text"))


def _named_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """f, source_file of each file, as Spark names it (one row per file)."""
    one = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("source_file"))
    return F.broadcast(one.select(F.xxhash64("source_file").alias("f"), "source_file"))
