"""L2: any page of an ordered result, however deep.

``offset`` and ``limit`` alone bring every row before the page to one task. A ``Pager``
sorts the result once by range partitions, writes it with its place in the order, and
knows the rows of each partition; prefix sums of these few numbers name the places
of a page, and reading it skips all row groups but the page's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.session import shared_dir

#: Rows before and in a page up to which one task may order them.
SHALLOW = 10_000
_AT = "_place"


class Pager:
    """An ordered result, written once under the shared folder."""

    def __init__(self, rows: DataFrame, order: list[Column]):
        path = shared_dir(rows.sparkSession, "pages")
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        placed.withColumn(_AT, F.monotonically_increasing_id()).write.parquet(path)
        self.rows = rows.sparkSession.read.parquet(path)
        part = F.shiftright(_AT, 33).alias("part")
        self.sizes = sorted(tuple(r) for r in self.rows.groupBy(part).count().collect())
        self.total = sum(n for _, n in self.sizes)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, in order."""
        places, before = F.lit(False), 0
        for part, n in self.sizes:
            lo, hi = max(offset - before, 0), min(offset + limit - before, n)
            if lo < hi:
                places = places | F.col(_AT).between((part << 33) + lo, (part << 33) + hi - 1)
            before += n
        return self.rows.where(places).orderBy(_AT).drop(_AT)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, shallow: int = SHALLOW) -> DataFrame:
    """One page: ordered by one task if that has few rows to hold, else by a ``Pager``."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be non-negative")
    if offset + limit > shallow:
        return Pager(rows, order).page(limit, offset)
    ordered = rows.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)
