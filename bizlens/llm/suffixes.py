"""Suffix dedup: bytes of 200-byte strings that start anywhere else too.

This replaces prefix doubling, which gives every position a rank for its first k
bytes, then for 2k, until ranks are unique or k passes the threshold, and for every
byte needs the whole text many times over in each round (not measured here). No rank
pairs are sorted and no length is doubled; substrings are grouped by hash instead

* only sampled positions take part at first. The anchor of a ``LENGTH``-byte string is
  its ``SAMPLE``-byte substring of least hash (the first of equals), so equal strings
  have equal anchors at equal distances, and each string is dealt with at its anchor.
  Consecutive strings with one anchor form its run.
* round 1 ranks anchors by their ``SAMPLE`` bytes: unique ones are out. It also ranks
  them by all that their run covers: if that recurs, so does every string of the run.
* round 2 cuts the runs that are left (ends of repeated passages) into blocks of
  ``BLOCK`` starts and ranks the bytes that all strings of a block have in common
  (``LENGTH - BLOCK + 1``); unique blocks are out, and recurring whole blocks done.
* round 3 ranks the strings of the blocks that are left by all their ``LENGTH`` bytes.

Ranks are 64-bit polynomial hashes of the bytes; a rank is shared if an aggregation
counts it twice. A finished run or block takes part in later rounds with one
representative (counting as two) as long as an unfinished one could equal a part of
it. Per round, one aggregation counts ranks and a join takes the answer back to the
positions, so that a passage in a third of all documents makes no large group.

Defined cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose
none; rows that share doc_id and text are two places (their bytes go); rows without
doc_id are judged like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import as_bytes, map_batches, mixed, release, stored, table

LENGTH, SAMPLE, BLOCK = 200, 64, 8
#: Texts are sampled in overlapping pieces of this many starts (place fits 24 bits).
PIECE = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Powers:
    """Powers of the multiplier and of its inverse, modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n >= len(self.up):
            size = max(2 * len(self.up), n + 1)
            inverse = pow(_MULTIPLIER, -1, 1 << 64)
            for name, base in (("up", _MULTIPLIER), ("down", inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(p))


POWERS = Powers()


class Ranks:
    """Hashes of any substrings of one byte string."""

    def __init__(self, text: bytes) -> None:
        n = len(text)
        POWERS.to(n)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[np.frombuffer(text, np.uint8)] * POWERS.up[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        """Of bytes start to end (arrays, or slices of equal length)."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * POWERS.down[start])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(text: bytes) -> tuple[np.ndarray, ...]:
    """first, last (starts of an anchor's run), place (of the anchor), and the ranks of
    the anchor's sample and of all that the run covers."""
    n = len(text)
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    ranks = Ranks(text)
    samples = ranks.of(slice(0, n - SAMPLE + 1), slice(SAMPLE, n + 1))
    anchor = []
    low = np.uint64(24)
    for base in range(0, n - LENGTH + 1, PIECE):
        part = samples[base : base + PIECE + LENGTH - SAMPLE]
        keys = (part >> low << low) | np.arange(len(part), dtype=np.uint64)
        least = _sliding_least(keys, LENGTH - SAMPLE + 1)[:PIECE]
        anchor.append((least & np.uint64((1 << 24) - 1)).astype(np.int64) + base)
    anchor = np.concatenate(anchor)
    change = np.flatnonzero(np.diff(anchor))
    first = np.concatenate([[0], change + 1])
    last = np.concatenate([change, [len(anchor) - 1]])
    place = anchor[first]
    whole = _with(ranks.of(first, last + LENGTH), place - first)
    return first, last, place, samples[place], whole


def _with(rank: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Rank of a string together with a small number."""
    with np.errstate(over="ignore"):
        return mixed(rank + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def _key() -> Column:
    """What stands for a row in the rounds: 64 bits of doc_id and text."""
    return F.xxhash64("doc_id", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("key"), "text")


def anchors(docs: DataFrame) -> DataFrame:
    """key, spot (first, last, place of a run in 24, 20 and 20 bits if they fit), and
    the ranks g of the sample and u of the run."""

    def make():
        def step(batch):
            out: list = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                first, last, place, g, u = runs(text or b"")
                values = (np.full(len(first), key), first, last - first, place - first, g.view(np.int64), u.view(np.int64))
                for column, v in zip(out, values):
                    column.append(v)
            return [np.concatenate(c) if c else [] for c in out]

        return step

    return map_batches(_keyed(docs), "key long, first int, more short, ahead short, g long, u long", make)


def _packed(docs: DataFrame) -> DataFrame:
    """key, doc_id, packed (compressed text), for a small shuffle."""

    def make():
        def step(batch):
            packed = [None if t is None else zlib.compress(t, 1) for t in as_bytes(batch.column(2))]
            return [batch.column(0), batch.column(1), pa.array(packed, pa.binary())]

        return step

    rows = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, "key long, doc_id long, packed binary", make)


def _settled(rows: DataFrame, spot: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round over rows with a rank ``c`` of what a run or block has in common, a rank
    ``u`` of all that it covers, and a weight: (rows whose all recurs, rows that the next
    round must look at, with their weight there)."""
    classes = rows.groupBy("c", "u").agg(F.sum("weight").alias("w"))
    common = classes.groupBy("c").agg(F.sum("w").alias("all"), F.min("w").alias("least")).where("all > 1")
    classes = classes.join(common, "c").select("u", "w", F.col("least") == 1) \
        .toDF("u", "w", "open")
    found = stored(rows.drop("c", "weight").join(classes, "u"), "ranks")
    alike = found.where("w > 1")
    first = alike.where("open").groupBy("u").agg(F.min(F.struct(*spot)).alias("s"))
    further = found.where("w = 1").select(*spot, F.lit(1).alias("weight")).unionByName(
        first.select(*[F.col(f"s.{c}").alias(c) for c in spot], F.lit(2).alias("weight"))
    )
    return alike, further


def removed_intervals(docs: DataFrame) -> DataFrame:
    """key, spans (flat starts and ends of byte stretches to remove, unmerged)."""
    spark = docs.sparkSession
    run = ["key", "first", "more", "ahead"]
    first_rows = anchors(docs).withColumnRenamed("g", "c").withColumn("weight", F.lit(1))
    alike, further = _settled(first_rows, run)
    covered = [alike.select("key", F.col("first").alias("a"), (F.col("first") + F.col("more") + LENGTH).alias("b"))]
    release(spark)

    # the bytes around each run that is left, once
    need = further.groupBy("key").agg(F.collect_list(F.struct("first", "more", "ahead", "weight")).alias("need"))
    texts = _packed(docs).select("key", "packed").join(need, "key")
    fields = "key long, first int, more short, ahead short, weight int, bytes binary"
    around = stored(map_batches(texts, fields, lambda: _around), "around")
    release(spark)

    spot = ["key", "first", "place", "low", "high"]
    blocks = map_batches(around, "key long, first int, place int, low short, high short, weight int, c long, u long", lambda: _blocks)
    alike, further = _settled(blocks, spot)
    to_bytes = lambda low, high: [
        "key", (F.col("place") - F.col(high)).alias("a"), (F.col("place") - F.col(low) + LENGTH).alias("b")
    ]
    covered.append(alike.select(*to_bytes("low", "high")))
    release(spark)

    left = further.groupBy("key", "first").agg(F.collect_list(F.struct("low", "high", "weight")).alias("blocks"))
    held = around.select("key", "first", "ahead", "bytes").join(left, ["key", "first"])
    strings = map_batches(
        held.select("key", "first", "ahead", "bytes", "blocks"), "key long, a int, weight int, c long", lambda: _strings
    )
    again = strings.groupBy("c").agg(F.sum("weight").alias("w")).where("w > 1").select("c")
    last = stored(strings.select("key", "a", "c").join(again, "c", "left_semi").select("key", "a"), "strings")
    covered.append(last.select("key", "a", (F.col("a") + LENGTH).alias("b")))
    release(spark)
    every = covered[0].unionByName(covered[1]).unionByName(covered[2])
    return every.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _around(batch):
    """The bytes of each run that is left, from its first start on."""
    out: list = [[], [], [], [], [], []]
    for key, packed, need in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
        text = zlib.decompress(packed)
        for r in need:
            a, more = r["first"], r["more"]
            values = (key, a, more, r["ahead"], r["weight"], text[a : a + more + LENGTH])
            for column, v in zip(out, values):
                column.append(v)
    return [*out[:5], pa.array(out[5], pa.binary())]


def _joined(column: pa.Array) -> tuple[Ranks, np.ndarray]:
    """Ranks of all the byte strings of a column, and where each begins. (A rank does
    not depend on where its bytes are.)"""
    strings = as_bytes(column)
    ends = np.cumsum([len(x) for x in strings], dtype=np.int64)
    return Ranks(b"".join(strings)), np.concatenate([[0], ends])[:-1].astype(np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that each give ``counts`` results: the results' rows, and their number
    within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _numbers(batch, *columns: int) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in columns]


def _blocks(batch):
    """Blocks of starts by their distance to the anchor, aligned so that equal strings
    fall into equal blocks: ranks of what all strings of a block have in common (c)
    and of all that the block's part of the run covers (u)."""
    key, first, more, ahead, weight = _numbers(batch, 0, 1, 2, 3, 4)
    ranks, base = _joined(batch.column(5))
    near, far = ahead - more, ahead  # distances of the run's last and first start
    row, number = _spread(far // BLOCK - near // BLOCK + 1)
    block = (near // BLOCK)[row] + number
    low = np.maximum(block * BLOCK, near[row])
    high = np.minimum(block * BLOCK + BLOCK - 1, far[row])
    place = (base + ahead)[row]
    c = _with(ranks.of(place - block * BLOCK, place - block * BLOCK - BLOCK + 1 + LENGTH), block)
    u = _with(ranks.of(place - high, place - low + LENGTH), low * 256 + high)
    return [key[row], first[row], (first + ahead)[row], low, high, weight[row], c.view(np.int64), u.view(np.int64)]


def _strings(batch):
    """Each string of the blocks that are left, with the rank of all its bytes."""
    key, first, ahead = _numbers(batch, 0, 1, 2)
    ranks, base = _joined(batch.column(3))
    blocks = batch.column(4)
    row = np.repeat(np.arange(len(key)), np.asarray(blocks.value_lengths()))
    low, high, weight = (
        blocks.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)
    )
    block, number = _spread(high - low + 1)
    row, start = row[block], ahead[row][block] - low[block] - number
    c = ranks.of(base[row] + start, base[row] + start + LENGTH)
    return [key[row], first[row] + start, weight[block], c.view(np.int64)]


RESULT = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<start:int,end:int>>, kept binary"
)


def dedup(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256, spans (maximal
    removed stretches, byte offsets) and kept (the remaining bytes, if asked for)."""
    spans = removed_intervals(docs)
    rows = _packed(docs).join(spans, "key", "left").select("doc_id", "packed", "spans")

    def make():
        def step(batch):
            out: list = [[], [], [], [], [], []]
            for packed, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                text = zlib.decompress(packed) if packed else b""
                merged: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and merged[-1][1] >= s[0]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                values = (
                    len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                    [{"start": a, "end": b} for a, b in merged], kept if with_bytes else None,
                )
                for column, v in zip(out, values):
                    column.append(v)
            return [batch.column(0), *out[:5], pa.array(out[5], pa.binary())]

        return step

    return map_batches(rows, RESULT, make)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"), with_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
