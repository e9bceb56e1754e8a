"""Small helpers the training-data operators share.

Word forms are defined on bytes: ``bytes.translate``/``split`` act on ASCII
only, which is what the operators' word classes say, and a UTF-8 character
beyond ASCII never contains an ASCII byte.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import bizlens
from bizlens.session import cut_lineage, shared_dir  # noqa: F401

#: A-Z to a-z, every other ASCII character that is no letter or digit to a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
#: The ASCII white space: space and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"
#: Entries a per-worker cache may hold before it starts anew.
CACHE_ENTRIES = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows per Arrow batch: rows hold whole texts, so Spark's 10,000 would be large.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make the session fit for text rows: smaller Arrow batches than Spark's default
    (a setting of the user's own stays), and the package's Python files sent to the
    executors once."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size, "10000") == "10000":
        spark.conf.set(size, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_bizlens_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(bizlens.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="bizlens-code-"), "bizlens_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith((".py", ".json", ".geojson")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._bizlens_shipped = True


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def as_text(column: pa.Array) -> list[str | None]:
    return column.cast(pa.string()).to_pylist()


def sliced(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that only a few texts at a time are Python objects."""
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


_KEPT: dict[str, dict] = {}


def kept_by(owner: str) -> dict:
    """A dict that a worker keeps between the tasks of one operator (by module name)."""
    return _KEPT.setdefault(owner, {})


def forget_others(owner: str) -> None:
    """Drop what this worker keeps for operators before ``owner``: Spark gives a worker
    to one operator after the other, and each one's tables would add up."""
    others = [held for name, held in _KEPT.items() if name != owner and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()


def map_batches(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list]]
) -> DataFrame:
    """``mapInArrow`` with ``make()`` called once per task; what it returns turns
    a batch into the list of output columns (Arrow arrays or plain lists)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    parsed = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(make.__module__)
        step = make()
        for batch in (b for whole in batches for b in sliced(whole)):
            columns = step(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                    for c, f in zip(columns, arrow)
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, parsed)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Filter whole rows by what ``make()`` returns (one boolean per row); every
    column passes through untouched, whatever its name."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(make.__module__)
        step = make()
        for batch in (b for whole in batches for b in sliced(whole)):
            yield batch.filter(pa.array(step(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


class WordHashes(dict):
    """64-bit hash per word, kept per worker; starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]
            out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter, non-empty text is one shingle."""
    if 0 < len(hashes) < size:
        return window_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(window_hashes(hashes, size))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from what was written."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: it does so once the driver
    has collected the frames that used them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
