"""F5/Q5 by index: which entities' names hold a text, without scanning every name.

``write_name_index`` inverts the names once: every three-character piece of a lower-cased
name leads to the rows whose name holds it. Rows are numbered in blocks of ``BLOCK``; a
posting is a piece, a block and the places in it, so that what is shuffled and written is
two bytes a place. A block's keys (month, uen) are written beside. Postings are laid out
in folders by hash of the piece and sorted inside, so a search reads a few row groups.
Pieces that more than ``MAX_SHARE`` of the rows hold select nothing and get no
postings; a table of all pieces with their counts tells.

A search picks the rarest pieces of its text, intersects their postings block by block,
reads the candidates' rows and tests those names as the scan would. A text of which a
piece occurs nowhere has no match; one that is shorter than a piece, or has only frequent
ones, or very many candidates, is answered by the scan. Results equal the scan's in every
case.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.operators.filters import text_search
from bizlens.session import cut_lineage, ship_package

SIZE = 3
FOLDERS = 64
#: Rows of a block: a place in it takes two bytes.
BLOCK = 1 << 16
#: Share of the rows above which a piece is left out of the postings.
MAX_SHARE = 0.05
#: Pieces of a text whose postings are intersected.
PICKED = 3
#: Candidates up to which their keys are pushed into the scan of the fact.
MAX_PUSHED = 1000
#: Candidates up to which their keys are broadcast; for more of them all names are tested.
MAX_CANDIDATES = 1_000_000

NAME, MONTH = "entity_name", "registration_month"


def pieces(text: Column) -> Column:
    """Distinct three-character pieces of the lower-cased text."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= SIZE, F.sequence(F.lit(1), F.length(low) - SIZE + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(SIZE))))


def _folder(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(FOLDERS)).cast("int")


_CHUNKS = pa.schema([
    ("kind", pa.string()), ("piece", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("places", pa.binary()),
    ("uens", pa.list_(pa.string())), ("months", pa.list_(pa.int32())),
])
_CHUNK_TYPES = "kind string, piece string, block long, n int, places binary, uens array<string>, months array<int>"


def block_postings(names: list[str]) -> tuple[list[str], np.ndarray, bytes]:
    """The pieces of up to ``BLOCK`` lower-cased names, how many names hold each, and
    the names' places one piece after the other, each as its distance from the last."""
    codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(names)), [len(n) for n in names])
    inside = row[:-2] == row[2:]
    found, which = np.unique(((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[inside], return_inverse=True)
    held = np.unique(which * BLOCK + row[:-2][inside])
    which, place = held // BLOCK, held % BLOCK
    first = np.diff(which, prepend=-1) > 0
    gaps = np.where(first, place, np.diff(place, prepend=0)).astype(np.uint16)
    mask = (1 << 21) - 1
    texts = [chr(k >> 42) + chr((k >> 21) & mask) + chr(k & mask) for k in found.tolist()]
    return texts, np.bincount(which, minlength=len(found)), gaps.tobytes()


def places_of(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, np.uint16).astype(np.int64))


def _chunks(batches):
    """Keys and postings of the blocks that a task's rows (uen, month, name) make."""
    block, held = TaskContext.get().partitionId() << 32, []

    def made(rows):
        table = pa.Table.from_batches(rows)
        columns = [table.column(k).to_pylist() for k in range(3)]
        pieces_, counts, gaps = block_postings([name or "" for name in columns[2]])
        empty = len(pieces_)
        yield pa.RecordBatch.from_pydict({
            "kind": ["keys"], "piece": [None], "block": [block], "n": [len(columns[0])], "places": [None],
            "uens": [columns[0]], "months": [columns[1]]}, _CHUNKS)
        ends = np.concatenate([[0], np.cumsum(counts) * 2]).astype(np.int32)
        places = pa.BinaryArray.from_buffers(pa.binary(), empty, [None, pa.py_buffer(ends), pa.py_buffer(gaps)])
        yield pa.RecordBatch.from_arrays([
            pa.array(["pieces"] * empty, pa.string()), pa.array(pieces_, pa.string()),
            pa.array([block] * empty, pa.int64()), pa.array(counts, pa.int32()), places,
            pa.nulls(empty, _CHUNKS.field("uens").type), pa.nulls(empty, _CHUNKS.field("months").type)], schema=_CHUNKS)

    for batch in batches:
        while batch.num_rows:
            room = BLOCK - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in held) == BLOCK:
                yield from made(held)
                block, held = block + 1, []
    if held:
        yield from made(held)


def write_name_index(fact: DataFrame, path: str) -> None:
    """Postings, their counts and the blocks' keys under ``path``."""
    spark = fact.sparkSession
    ship_package(spark)
    named = fact.select("uen", MONTH, F.lower(NAME).alias("name"))
    named.mapInArrow(_chunks, _CHUNK_TYPES).write.mode("overwrite").partitionBy("kind").option(
        "compression", "zstd").parquet(f"{path}/chunks")
    held = spark.read.schema(_CHUNK_TYPES).parquet(f"{path}/chunks").where("kind = 'pieces'")
    counts = held.groupBy("piece").agg(F.sum("n").alias("n"))
    counts.withColumn("folder", _folder(F.col("piece"))).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/counts")
    counts = spark.read.schema("piece string, n long, folder int").parquet(f"{path}/counts")
    rows = fact.count()
    kept = counts.where(F.col("n") <= MAX_SHARE * rows).select("piece", "folder")
    # A folder that is large is written by several tasks, its pieces sorted in each.
    held.select("piece", "block", "places").join(kept, "piece").hint("rebalance", "folder").sortWithinPartitions(
        "folder", "piece", "block").write.mode("overwrite").partitionBy("folder").option("compression", "zstd").parquet(
        f"{path}/postings")
    spark.createDataFrame([(rows,)], "rows long").write.mode("overwrite").parquet(f"{path}/size")


def _shared_places(batches):
    """(block, places that all posting lists of the block have)."""
    for batch in batches:
        blocks, found = [], []
        for block, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            both = reduce(lambda x, y: np.intersect1d(x, y, assume_unique=True), map(places_of, lists))
            if len(both):
                blocks.append(block)
                found.append(both.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                                         names=["block", "found"])


class NameIndex:
    """A written index and the fact it was made of."""

    def __init__(self, spark: SparkSession, path: str, fact: DataFrame):
        self.fact = fact
        self.counts = spark.read.schema("piece string, n long, folder int").parquet(f"{path}/counts")
        self.postings = spark.read.schema("piece string, block long, places binary, folder int").parquet(f"{path}/postings")
        self.keys = spark.read.schema(_CHUNK_TYPES).parquet(f"{path}/chunks").where("kind = 'keys'").select(
            "block", "uens", "months")
        self.limit = MAX_SHARE * spark.read.parquet(f"{path}/size").first().rows

    def _chosen(self, text: str) -> list[str] | None:
        """The pieces to intersect; none if the text cannot match, None if it needs the scan."""
        low = self.fact.sparkSession.range(1).select(F.lit(text).alias("t"))
        asked = low.select(F.explode(pieces(F.col("t"))).alias("piece"))
        asked = asked.select("piece", _folder(F.col("piece")).alias("folder")).collect()
        if not asked:
            return None
        names = [r.piece for r in asked]
        found = self.counts.where(F.col("folder").isin([r.folder for r in asked]) & F.col("piece").isin(names)).collect()
        if len(found) < len(names):
            return []
        rare = sorted((r.n, r.piece) for r in found if r.n <= self.limit)
        return [piece for _, piece in rare[:PICKED]] or None

    def _held(self, chosen: list[str]) -> DataFrame:
        """block, found: the places of the rows whose name holds every chosen piece."""
        folders = self.postings.sparkSession.range(1).select(
            *[_folder(F.lit(p)).alias(f"c{k}") for k, p in enumerate(chosen)]).first()
        rows = self.postings.where(F.col("folder").isin(list(folders)) & F.col("piece").isin(chosen))
        # at most PICKED lists of a block, each of no more places than the block has
        lists = rows.groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(chosen))
        ship_package(rows.sparkSession)
        return cut_lineage(lists.select("block", "lists").mapInArrow(_shared_places, "block long, found array<int>"))

    def _entities(self, held: DataFrame) -> DataFrame:
        """uen, month of places of blocks."""
        keyed = self.keys.join(F.broadcast(held), "block")
        at = keyed.select("uens", "months", F.explode("found").alias("at"))
        return at.select(F.get("uens", F.col("at")).alias("uen"), F.get("months", F.col("at")).alias(MONTH)).distinct()

    def rows(self, text: str) -> DataFrame:
        """Rows of the fact that ``text_search(text)`` finds."""
        chosen = self._chosen(text)
        if chosen is None:
            return self.fact.where(text_search(text))
        named = F.coalesce(F.contains(F.lower(NAME), F.lower(F.lit(text))), F.lit(False))
        by_key = self.fact.where((F.col("uen") == F.lit(text)) & ~named)
        if not chosen:
            return by_key
        held = self._held(chosen)
        places = held.agg(F.sum(F.size("found"))).first()[0] or 0
        if places > MAX_CANDIDATES:
            return self.fact.where(text_search(text))
        if places <= MAX_PUSHED:
            few = self._entities(held).collect()
            months, keys = sorted({r[MONTH] for r in few}), sorted({r.uen for r in few})
            rows = self.fact.where(F.col(MONTH).isin(months) & F.col("uen").isin(keys))
        else:
            rows = self.fact.join(F.broadcast(self._entities(held)), ["uen", MONTH], "left_semi")
        return rows.where(named).unionByName(by_key)


def search_texts(index: NameIndex, texts: list[str]) -> DataFrame:
    """q, uen, entity_name, registration_incorporation_date of the rows each text finds."""
    columns = ["uen", NAME, "registration_incorporation_date"]
    found = [index.rows(t).select(F.lit(t).alias("q"), *columns) for t in texts]
    return reduce(DataFrame.unionByName, found)
