"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import stored


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of ``links`` (a, b).

    Each round is two small aggregations; a node's neighbours are only ever folded
    to their minimum, never collected, so a node of many links is no large group.
    The rounds end when nothing changes, after about log(longest path) of them; it is
    an error if they still change after ``max_rounds``."""
    edges = links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u <> v").distinct()
    edges = stored(edges, "links")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to u's smallest neighbour or u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "links")
        if _same(edges, after):
            break
        edges = after
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )


def _same(x: DataFrame, y: DataFrame) -> bool:
    state = [
        d.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        for d in (x, y)
    ]
    return tuple(state[0]) == tuple(state[1])
