"""Merkle dataset manifest.

Every row becomes a leaf, the digest of its fields. The leaves of a partition of the
dataset (a language) are ordered by id and hashed upwards in runs of ``FANOUT``; the
partitions' roots, ordered by name, are hashed on to the root of the dataset. A
document's proof is what stands beside its path: with it, leaf and root alone tell whether
the document is the one the manifest was made of.

Leaves get their places from one range sort and the sizes of its parts. An aligned block
of ``FANOUT ** LEVELS`` leaves is hashed by one task. The levels above are exchanged as in
a butterfly: in round r the blocks whose numbers differ in their r-th digit only swap
the roots they hold, and every one of them hashes their common ancestor itself. So each
block knows its siblings on every level once the rounds end, and nothing has to be sent
down again. Where the last subtree is not full, its blocks also stand in for
the partners that are missing. The partitions' roots take the same two steps.

A group of the exchange has ``FANOUT`` members, and a block a fixed number of
leaves, however many rows a partition has; a round moves one row per block. The driver sees
the size of the largest partition only (for the number of rounds).

Defined cases: null fields are ``-``, empty ones ``0:``; a null language is a partition of
its own, before all others; rows without doc_id come first in theirs; rows of one doc_id
are ordered by their leaves; a single leaf is its partition's root, and an only partition's
root that of the dataset; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.llm.common import ship, stored, table

FANOUT = 8
#: Levels that one task hashes: blocks of 4,096 leaves.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: One level of a path: place in the run, and what else the run holds.
_STEP = "struct<at:int,siblings:array<string>>"
_PATH = f"array<{_STEP}>"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field by its length in bytes and its value."""
    text = [f.cast("string") for f in fields]
    parts = [
        F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f))
        for f in text
    ]
    return F.sha2(F.concat(*parts), 256)


def _tree(name: Column) -> Column:
    """A partition's name as a key that orders nulls first, then by bytes."""
    return F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name.cast("string")))


def placed(leaves: DataFrame, levels: int) -> DataFrame:
    """``leaves`` (tree, id, leaf, claim) with pos (rank by id in its tree, from 0), n
    (leaves of the tree) and block."""
    key = ["tree", "id", "leaf"]
    rows = leaves.repartitionByRange(*key).sortWithinPartitions(*key)
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    # a tree has one row here per part of the sort that it lies in
    parts = rows.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    ahead = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree", "part", "first", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"), F.sum("c").over(whole).alias("n")
    )
    rows = rows.join(parts, ["tree", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("ahead"))
    block = F.floor(F.col("pos") / FANOUT**levels)
    return rows.select("tree", "id", "leaf", "claim", "pos", "n", block.cast("long").alias("block"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def upwards(leaves: list[str], n: int, levels: int) -> list[list[str]]:
    """The levels of a block of a tree of ``n`` leaves, at most ``levels`` above them."""
    out, width = [leaves], n
    while width > 1 and len(out) <= levels:
        below = out[-1]
        out.append([digest("".join(below[k : k + FANOUT])) for k in range(0, len(below), FANOUT)])
        width = -(-width // FANOUT)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """The rows of each (tree, block) in turn, as lists of columns. Rows come sorted."""
    key, held = None, [[] for _ in range(columns)]
    for batch in batches:
        found = [c.to_pylist() for c in batch.columns]
        for row in zip(*found):
            if row[:2] != key:
                if key is not None:
                    yield key, held
                key, held = row[:2], [[] for _ in range(columns)]
            for column, v in zip(held, row[2:]):
                column.append(v)
    if key is not None:
        yield key, held


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def block_roots(rows: DataFrame, levels: int) -> DataFrame:
    """tree, block, n (leaves of the tree), node (the block's root) of every block."""

    def run(batches):
        for (tree, block), (_, n, leaves) in _blocks(batches, 3):
            node = upwards(leaves, n[0], levels)[-1][0]
            yield pa.RecordBatch.from_pylist([{"tree": tree, "block": block, "n": n[0], "node": node}], arrow)

    arrow = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
    thin = _by_block(rows.select("tree", "block", "pos", "n", "leaf"))
    return thin.mapInArrow(run, "tree string, block long, n long, node string")


def exchanged(blocks: DataFrame, levels: int) -> DataFrame:
    """tree, block, node (the tree's root), path (siblings from the block upwards)."""
    size = FANOUT**levels
    state = blocks.select(
        "tree", "block", F.ceil(F.col("n") / size).cast("long").alias("width"), "node", F.lit(None).cast(_PATH).alias("path")
    ).withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    state = stored(state, "blocks")
    widest = state.agg(F.max("width")).first()[0] or 0
    done, step = [], 1
    while True:
        done.append(state.where(F.col("width") <= step))
        if widest <= step:
            break
        state = _swapped(state.where(F.col("width") > step), step)
        step *= FANOUT
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("tree", "block", "node", "path")


def _swapped(state: DataFrame, step: int) -> DataFrame:
    """One round: blocks that differ in the digit worth ``step`` swap their nodes."""
    subtree = F.floor(F.col("block") / step)
    last = F.floor((F.col("width") - 1) / step)
    held = F.when(subtree == last, F.col("width") - last * step).otherwise(F.lit(step)).cast("long")
    low = F.pmod("block", F.lit(step)).cast("long")
    # a block answers for its own place in the subtree and for every held-th behind it
    rows = state.select(
        "*",
        F.floor(F.col("block") / (step * FANOUT)).cast("long").alias("group"),
        F.pmod(subtree, F.lit(FANOUT)).cast("int").alias("digit"),
        low.alias("own"),
        F.explode(F.sequence(low, F.lit(step - 1).cast("long"), held)).alias("low"),
    )
    member = F.struct("digit", "node", "block", "path", (F.col("low") == F.col("own")).alias("real"))
    met = rows.groupBy("tree", "width", "group", "low").agg(F.sort_array(F.collect_list(member)).alias("members"))
    nodes = F.transform("members", lambda m: m["node"])
    met = met.select("tree", "width", "members", nodes.alias("nodes"), F.sha2(F.concat_ws("", nodes), 256).alias("node"))
    met = met.select("tree", "width", "node", "nodes", F.explode("members").alias("m")).where("m.real")
    level = F.struct(
        F.col("m.digit").alias("at"), F.filter("nodes", lambda _, k: k != F.col("m.digit")).alias("siblings")
    )
    return met.select(
        "tree", F.col("m.block").alias("block"), "width", "node", F.concat("m.path", F.array(level)).alias("path")
    )


def folded(start: str, path: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that ``start`` and the siblings of its path lead to."""
    for at, siblings in path:
        start = digest("".join([*siblings[:at], start, *siblings[at:]]))
    return start


def _own_path(levels: list[list[str]], k: int) -> list[tuple[int, list[str]]]:
    """Place and siblings of leaf ``k`` of a block on each of the block's levels."""
    path = []
    for nodes in levels[:-1]:
        first = k - k % FANOUT
        path.append((k % FANOUT, nodes[first:k] + nodes[k + 1 : first + FANOUT]))
        k //= FANOUT
    return path


_HELD = [("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string())]
_PATH_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def proven(rows: DataFrame, blocks: DataFrame, levels: int, paths: bool) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root of every leaf, and its whole
    path if ``paths``. ``blocks``: tree, block, subroot, root, path; each block's row goes
    ahead of its leaves."""
    names = ["tree", "block", "pos", "n", "id", "leaf", "claim", "subroot", "root", "path"]
    empty = lambda *c: [F.lit(None).cast("string").alias(x) for x in c]
    heads = blocks.select(
        "tree", "block", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("long").alias("id"), *empty("leaf", "claim"), "subroot", "root", "path",
    )
    body = rows.select(*names[:7], *empty("subroot", "root"), F.lit(None).cast(_PATH).alias("path"))
    arrow = pa.schema(
        [*_HELD, ("proof_sha256", pa.string()), ("folded_root", pa.string())] + ([("path", _PATH_ARROW)] if paths else [])
    )

    def run(batches):
        for _, (_, n, ids, leaves, claims, subroots, roots, heads_) in _blocks(batches, 8):
            upper = [(s["at"], s["siblings"]) for s in heads_[0]]
            above = "".join("".join(s) for _, s in upper)
            found = upwards(leaves[1:], n[1], levels)
            proofs, ends, whole = [], [], []
            for k, (own, claim) in enumerate(zip(leaves[1:], claims[1:])):
                path = _own_path(found, k)
                proofs.append(digest("".join("".join(s) for _, s in path) + above))
                ends.append(folded(own if claim is None else claim, path + upper))
                if paths:
                    whole.append([{"at": at, "siblings": s} for at, s in path + upper])
            size = len(proofs)
            columns = [ids[1:], leaves[1:], [subroots[0]] * size, [roots[0]] * size, proofs, ends]
            columns = [pa.array(c, f.type) for c, f in zip(columns + ([whole] if paths else []), arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    both = _by_block(body.unionByName(heads))
    return both.mapInArrow(run, schema + (f", path {_PATH}" if paths else ""))


def manifest(
    docs: DataFrame,
    claim: Column | None = None,
    fields: Sequence[str] = FIELDS,
    name: str = "lang",
    levels: int = LEVELS,
    paths: bool = True,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, path (place and siblings from the leaf to
    the root, if ``paths``), folded_root, verified of every document. ``claim`` is the
    leaf that is to be verified with the original's siblings (null or none: the original).
    """
    ship(docs.sparkSession)
    leaves = docs.select(
        _tree(F.col(name)).alias("tree"),
        F.col("doc_id").cast("long").alias("id"),
        leaf([F.col(f) for f in fields]).alias("leaf"),
        (F.lit(None).cast("string") if claim is None else claim).alias("claim"),
    )
    rows = stored(placed(stored(leaves, "leaves"), levels), "placed")
    blocks = stored(exchanged(block_roots(rows, levels), levels), "exchanged")
    # the partitions' roots are the leaves of the tree above
    tops = blocks.where("block = 0").select("tree", F.col("node").alias("leaf"))
    ordered = placed(
        tops.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "leaf", F.lit(None).cast("string").alias("claim")), levels
    )
    ordered = stored(ordered, "partitions")
    upper = exchanged(block_roots(ordered, levels), levels).select(
        "tree", "block", F.col("node").alias("subroot"), F.col("node").alias("root"), "path"
    )
    by_place = ordered.withColumn("name", F.col("id")).withColumn("id", F.col("pos"))
    above = proven(by_place, upper, levels, paths=True).select(F.col("id").alias("pos"), "root", F.col("path").alias("above"))
    above = ordered.select("pos", F.col("id").alias("tree")).join(above, "pos").drop("pos")
    heads = blocks.join(above, "tree").select(
        "tree", "block", F.col("node").alias("subroot"), "root", F.concat("path", "above").alias("path")
    )
    return proven(rows, heads, levels, paths).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", *(["path"] if paths else []),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: The contract's tampering lower-cases these letters.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", CAPITALS, CAPITALS.lower())
    changed = leaf([lowered if f == "text" else F.col(f) for f in FIELDS])
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)
    return manifest(table(spark, sf_dir, "documents"), claim, paths=False)


#: Levels by recursion; the checksum of doc_id as in the resampling query.
OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda v: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS step),
digits AS (
  SELECT *, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)) AS codes,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
rows_ AS (
  SELECT doc_id, lang,
    concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
      coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head,
    coalesce(concat(strlen(text), ':', text), '-') AS body,
    CASE WHEN xor(list_reduce(codes, lambda c, v: xor(c >> 8, step[xor(c & 255, v) + 1]), 4294967295), 4294967295) % 3 = 0
      THEN coalesce(concat(strlen(low), ':', low), '-') ELSE coalesce(concat(strlen(text), ':', text), '-') END AS claimed
  FROM digits, steps),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256(head || body) AS leaf, sha256(head || claimed) AS claim FROM rows_),
level0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos FROM leaves),
nodes(tree, level, run, nodes, width) AS (
  SELECT tree, 0, pos // 8, list(leaf ORDER BY pos), any_value(n) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM level0)
  GROUP BY tree, pos // 8
  UNION ALL
  SELECT tree, level + 1, run // 8, list(sha256(array_to_string(nodes, '')) ORDER BY run), any_value((width + 7) // 8)
  FROM nodes WHERE width > 1 GROUP BY tree, level, run // 8),
subroots AS (SELECT tree, nodes[1] AS subroot, level FROM nodes WHERE width = 1),
top0 AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM subroots),
tops(level, run, nodes, width) AS (
  SELECT 0, pos // 8, list(subroot ORDER BY pos), any_value(n) FROM top0 GROUP BY pos // 8
  UNION ALL
  SELECT level + 1, run // 8, list(sha256(array_to_string(nodes, '')) ORDER BY run), any_value((width + 7) // 8)
  FROM tops WHERE width > 1 GROUP BY level, run // 8),
runs AS (
  SELECT tree, level, run, nodes FROM nodes WHERE width > 1
  UNION ALL
  SELECT x.tree, x.level + t.level, t.run, t.nodes FROM tops t, top0 x WHERE t.width > 1 AND t.run = x.pos // CAST(power(8, t.level + 1) AS BIGINT)),
paths(doc_id, tree, level, pos, proof, node) AS (
  SELECT doc_id, tree, 0, pos, '', claim FROM level0
  UNION ALL
  SELECT p.doc_id, p.tree, p.level + 1,
    CASE WHEN p.level + 1 = s.level THEN s.pos ELSE p.pos // 8 END,
    p.proof || array_to_string(list_concat(list_slice(r.nodes, 1, p.pos % 8), list_slice(r.nodes, p.pos % 8 + 2, 8)), ''),
    sha256(array_to_string(list_concat(list_slice(r.nodes, 1, p.pos % 8), [p.node], list_slice(r.nodes, p.pos % 8 + 2, 8)), ''))
  FROM paths p JOIN top0 s USING (tree) JOIN runs r ON r.tree = p.tree AND r.level = p.level
    AND r.run = (CASE WHEN p.level = 0 AND s.level = 0 THEN s.pos ELSE p.pos END) // 8),
ends AS (SELECT doc_id, arg_max(proof, level) AS proof, arg_max(node, level) AS folded FROM paths GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM level0 JOIN top0 USING (tree) JOIN ends USING (doc_id), (SELECT nodes[1] AS root FROM tops WHERE width = 1)
"""
