"""Sums of fixed-length vectors over all rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import as_text, forget_others, ship, sliced

#: Entries per piece of a vector, and tasks that add up a piece's first sums.
PIECE = 1 << 16
FAN = 4

_SCHEMA = "piece int, salt int, rows long, sums binary"
_FIELDS = [("piece", pa.int32()), ("salt", pa.int32()), ("rows", pa.int64()), ("sums", pa.binary())]


def _rows(found: dict[tuple[int, int], tuple[int, np.ndarray]]) -> pa.RecordBatch:
    keys = sorted(found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.int32()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([found[k][0] for k in keys], pa.int64()),
            pa.array([zlib.compress(found[k][1].tobytes(), 1) for k in keys], pa.binary()),
        ],
        schema=pa.schema(_FIELDS),
    )


def _added(keep_salt: bool):
    def run(batches):
        found: dict = {}
        for b in batches:
            for piece, salt, rows, sums in zip(*(c.to_pylist() for c in b.columns)):
                key = (piece, salt if keep_salt else 0)
                v = np.frombuffer(zlib.decompress(sums), np.int64)
                n, old = found.get(key, (0, 0))
                found[key] = (n + rows, old + v)
        if found:
            yield _rows(found)

    return run


def summed_vectors(
    frame: DataFrame, vector: Callable[[list], np.ndarray], size: int
) -> tuple[np.ndarray, int]:
    """Sum of ``vector(values)`` (int64, ``size`` entries) over all batches of the
    frame's one text column, and the number of rows. Each task sends one vector
    in pieces; pieces are summed in two levels, so neither a task nor the driver
    gets more than a bounded share. ``size`` bounds what the driver receives."""
    ship(frame.sparkSession)

    def run(batches):
        forget_others(vector.__module__)
        total, rows = np.zeros(size, np.int64), 0
        for b in (part for whole in batches for part in sliced(whole)):
            values = as_text(b.column(0))
            rows += len(values)
            total += vector(values)
        if rows:
            from pyspark import TaskContext

            salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % FAN
            cuts = range(0, size, PIECE)
            yield _rows({(k, salt): (rows, total[c : c + PIECE]) for k, c in enumerate(cuts)})

    first = frame.mapInArrow(run, _SCHEMA)
    second = first.repartition("piece", "salt").mapInArrow(_added(True), _SCHEMA)
    last = second.repartition("piece").mapInArrow(_added(False), _SCHEMA)
    out, rows = np.zeros(size, np.int64), 0
    for r in last.select("piece", "rows", "sums").collect():
        v = np.frombuffer(zlib.decompress(r.sums), np.int64)
        out[r.piece * PIECE : r.piece * PIECE + len(v)] = v
        rows = r.rows
    return out, rows
