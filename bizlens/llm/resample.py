"""Target-distribution importance resampling.

Texts become bags of hashed words and word pairs. How much more frequent each bucket
is in a target corpus than in the documents gives the bucket a gain; a document's weight
is the mean gain of its features, looked up in one array for whole batches. Adding
Gumbel noise from a keyed hash of the document turns "draw without replacement in
proportion to the importance weight" into "take the highest scores".

The order is found by parallel sorting by regular sampling. Every task sorts its own
scores into a run, which is written. Regular places of all runs give splitters, which
cut every run into segments. The sizes of the segments are counted where the runs are,
and only segments that hold a place to be drawn are exchanged; each is merged from its
sorted pieces by one task (Spark's sort, which spills), and the prefix sums of the
sizes turn a row's place in its segment into its exact rank in the corpus.

The driver sees the bucket sums, at most ``2 * SAMPLES * SEGMENTS`` samples and one count
per segment; what moves is one thin row per document of the drawn segments.

Hashes of word pairs come from those of the words: the checksum is linear, so
appending a word is a table look-up by its length, done for a whole batch at once.

Defined cases: null, empty and wordless texts have no features and weight 0; rows without
doc_id hash as an empty one and come after all others of their score; repeated rows are
drawn one by one; without eligible documents none is drawn; an empty target or corpus
only leaves the smoothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import ALNUM, CACHE_ENTRIES, as_bytes, map_batches, ship, stored, table
from bizlens.llm.sums import summed_vectors

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Rows that a segment aims at, segments at most, and samples that place a splitter.
SEGMENT_ROWS, SEGMENTS, SAMPLES = 25_000, 4096, 16
#: Longer words are not appended by table.
LONGEST = 48

_STEP = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
_STEP = _STEP ^ _STEP[0]  # checksum of one byte without the initial value


def _append_tables() -> np.ndarray:
    """For each length, each byte of a checksum and each value of it: what is left of
    it behind that many zero bytes."""
    tables = np.empty((LONGEST + 1, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, LONGEST + 1):
        before = tables[n - 1]
        tables[n] = _STEP[before & 255] ^ (before >> np.uint32(8))
    return tables.reshape(-1)


_APPEND = _append_tables()


class WordSums(dict):
    """Checksum of a word and, above its 32 bits, its length (``LONGEST`` + 1 if more)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        v = self[word] = zlib.crc32(word) | min(len(word), LONGEST + 1) << 32
        return v


WORD_SUMS = WordSums()


def _behind_space(sums: np.ndarray) -> np.ndarray:
    raw = ~sums
    return ~(_STEP[(raw ^ np.uint32(32)) & np.uint32(255)] ^ (raw >> np.uint32(8)))


def pair_sums(words: list[bytes], sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksum of every two consecutive words with a space between."""
    left, right, n = _behind_space(sums[:-1]), sums[1:], lengths[1:]
    at = np.minimum(n, LONGEST) * 1024
    out = right.copy()
    for k in range(4):
        out ^= _APPEND[at + 256 * k + ((left >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
    for i in np.flatnonzero(n > LONGEST):
        out[i] = zlib.crc32(words[i + 1], int(left[i]))
    return out


def features(texts: list[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; bucket of every word; bucket of the pair it begins
    (``buckets`` where the text ends)."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        if t:
            found = t.translate(ALNUM).split()
            counts[k] = len(found)
            words += found
    packed = np.fromiter(map(WORD_SUMS.__getitem__, words), np.uint64, len(words))
    sums = packed.astype(np.uint32)
    pairs = np.full(len(words), buckets, np.int64)
    if len(words) > 1:
        pairs[:-1] = pair_sums(words, sums, (packed >> np.uint64(32)).astype(np.int64)) % np.uint32(buckets)
    ends = np.cumsum(counts)
    pairs[ends[counts > 0] - 1] = buckets
    return counts, (sums % np.uint32(buckets)).astype(np.int64), pairs


def bucket_sums(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts of the column ``text``."""

    def vector(values: list) -> np.ndarray:
        _, single, pairs = features([v.encode() if v else None for v in values], buckets)
        return np.bincount(single, minlength=buckets) + np.bincount(pairs, minlength=buckets + 1)[:buckets]

    return summed_vectors(texts.select("text"), vector, buckets)[0]


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    n = float(len(corpus))
    ratio = (target + 1.0) * (corpus.sum() + n) / ((corpus + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(np.append(gains, 0))

    def make():
        def step(batch):
            found = shared.value
            counts, single, pairs = features(as_bytes(batch.column(1)), len(found) - 1)
            total = np.concatenate([[0], np.cumsum(found[single] + found[pairs])])
            ends = np.cumsum(counts)
            n = counts + np.maximum(counts - 1, 0)
            mean = (total[ends] - total[ends - counts]) // np.maximum(n, 1)
            return [batch.column(0), *(pa.array(v) for v in (counts, n, mean))]

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, "doc_id long, n_words long, n_features long, weight long", make)


def noise(seed: int) -> Column:
    """Gumbel noise from a hash of the document, in thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ordered(rows: DataFrame, *first: Column | str) -> DataFrame:
    """Every partition sorted: highest score first, ties by smaller doc_id."""
    return rows.sortWithinPartitions(*first, F.desc("score"), F.asc_nulls_last("doc_id"))


def sorted_runs(scored: DataFrame, eligible: Column) -> DataFrame:
    """The rows as written runs, one per task, the eligible ones sorted in front:
    ``run`` and ``place`` in it."""
    runs = _ordered(scored.withColumn("eligible", eligible), F.desc("eligible"))
    at = F.monotonically_increasing_id()  # task number above 33 bits of row number
    runs = runs.withColumn("run", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1))
    return stored(runs, "runs")


def splitters(runs: DataFrame, n: int) -> list[tuple[int, bool, int]]:
    """Places in the order (negated score, no doc_id, doc_id) that cut the corpus into
    segments of like size, from every ``stride``-th row of each run."""
    segments = min(SEGMENTS, -(-n // SEGMENT_ROWS))
    if segments < 2:
        return []
    stride = max(1, n // (SAMPLES * segments))
    regular = F.col("place") % stride == F.pmod(F.xxhash64("run"), F.lit(stride))
    rows = runs.where("eligible").where(regular).select("score", "doc_id").collect()
    order = sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in rows)
    return sorted({order[k * len(order) // segments] for k in range(1, segments)}) if order else []


def with_segments(runs: DataFrame, cuts: list[tuple[int, bool, int]]) -> DataFrame:
    """The segment of every eligible row: how many cuts come before it or equal it."""
    columns = ["doc_id", "n_features", "weight", "score", "eligible"]
    cut = [np.array([c[k] for c in cuts], np.int64) for k in range(3)]

    def make():
        def step(batch):
            doc_id, score = batch.column(0), batch.column(3)
            row = (
                -score.to_numpy(zero_copy_only=False),
                doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                doc_id.fill_null(0).to_numpy(zero_copy_only=False),
            )
            both = [np.concatenate([c, r]) for c, r in zip(cut, row)]
            order = np.lexsort((*both[::-1],))  # stable: a cut stands before its equals
            seen = np.empty(len(order), np.int64)
            seen[order] = np.cumsum(order < len(cuts))
            segment = pa.array(seen[len(cuts) :], pa.int32(), mask=~batch.column(4).to_numpy(zero_copy_only=False))
            return [*batch.columns[:4], segment]

        return step

    schema = "doc_id long, n_features long, weight long, score long, segment int"
    return map_batches(runs.select(*columns), schema, make)


def _numbered(before: dict[int, int], limit: int) -> Callable:
    """Ranks of rows that come segment by segment, each in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = -1, 0
        for batch in batches:
            segment = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = np.empty(len(segment), np.int64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(segment)]])
            for a, b in zip(starts[:-1], starts[1:]):
                if a == b:
                    continue
                if segment[a] != current:
                    current, seen = int(segment[a]), 0
                rank[a:b] = before[current] + seen + 1 + np.arange(b - a)
                seen += int(b - a)
            ranks = pa.array(rank, pa.int64(), mask=rank > limit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ranks], names=[*batch.schema.names[:4], "rank"])

    return run


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """doc_id, n_features, weight, score, rank: 1, 2, 3... of the ``percent`` of the
    eligible rows with the highest scores, null for all others."""
    runs = sorted_runs(scored, eligible)
    n = runs.where("eligible").count()
    limit = percent * n // 100
    cut = with_segments(runs, splitters(runs, n))
    sizes = {r["segment"]: r["count"] for r in cut.where("segment is not null").groupBy("segment").count().collect()}
    before, total = {}, 0
    for segment in sorted(sizes):
        before[segment] = total
        total += sizes[segment]
    drawn = max((s for s in before if before[s] < limit), default=-1)
    moved = _ordered(cut.where(F.col("segment") <= drawn).repartition("segment"), "segment")
    schema = "doc_id long, n_features long, weight long, score long, rank long"
    placed = moved.mapInArrow(_numbered(before, limit), schema)
    rest = cut.where(F.coalesce(F.col("segment") > drawn, F.lit(True))).drop("segment")
    return placed.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and its rank in the draw of
    ``percent`` of those with ``min_words`` words, weighted towards ``target``."""
    ship(docs.sparkSession)
    gains = bucket_gains(bucket_sums(docs, buckets), bucket_sums(target, buckets))
    scored = weights(docs, gains).withColumn("score", F.col("weight") + noise(seed))
    return ranked(scored, F.col("n_words") >= min_words, percent)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The checksum of each distinct feature, byte by byte; its 256 steps come from the polynomial.
OP12_SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda v: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS step),
texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM texts),
grams AS (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS f FROM words),
found AS (SELECT side, doc_id, f, count(*) AS c FROM grams GROUP BY ALL),
bytes AS (
  SELECT f, list_transform(range(strlen(f)), lambda i:
    (strpos('0123456789ABCDEF', substr(hex(f), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(f), 2 * i + 2, 1)) - 1) AS b
  FROM (SELECT DISTINCT f FROM found)),
hashed AS (
  SELECT f, xor(list_reduce(b, lambda c, v: xor(c >> 8, step[xor(c & 255, v) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM bytes, steps),
counted AS (
  SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 'b'), 0) AS t
  FROM found JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counted),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM counted, totals),
weights AS (
  SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, CAST(floor(sum(c * gain) / sum(c)) AS BIGINT) AS weight
  FROM found JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || substr(sha256(concat('7:', w.doc_id)), 1, 8) AS BIGINT) AS h
  FROM words w LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
final AS (
  SELECT doc_id, n_words, n_features, weight,
    weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM final WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank
FROM final LEFT JOIN drawn USING (doc_id)
"""
