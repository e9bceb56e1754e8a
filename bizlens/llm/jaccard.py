"""N-gram Jaccard join: documents whose shingle sets are alike, and their groups.

Texts become sets of word shingles (64-bit hashes). Two sets link if their Jaccard
similarity reaches ``percent`` / 100. Sets are ordered rarest shingle first, so two
linked sets share ``m`` shingles within their first ``n - ceil(t n) + m`` (prefix
filter; ``m`` grows with the set, see ``common``); only these are joined. Shingles
without a second set of fitting length (length filter) and sets that are left with
too few of them are dropped before any pair is made, so that words which meet by
chance do not multiply. Pairs must share enough prefix shingles and pass the
positional filter (what can still follow the last of them) and the suffix filter (an
upper bound of the overlap from how many shingles lie in each of 32 sections of the
hash range). The last join splits both bounds at the shared shingle: before it only prefix
shingles that some other set has can be common (not the edits of one copy), behind it
no more than the sections of what is behind it allow. Copies of one text that are
further from each other than a link allows so do not leave that join as pairs.
What is left is verified once per pair on the whole sets.

Rarity comes from counts over all documents in a fixed number of hash buckets:
any one order is right, and frequent shingles stand out in their bucket. Equal sets
are one class, joined once however many documents there are.

Only the components of the link graph are wanted, and pairs within one component
need no look. So classes that share a prefix shingle are first compared with one
of them, a hub that changes from round to round, while that merges components;
the pairs across components that are then left are all verified. A group of near
copies so costs some comparisons per copy, not one per pair, and no link is lost.

Defined cases: null, empty and wordless texts have an empty set and link with
nothing; fewer words than a shingle are one shingle; rows that share a doc_id are
grouped by their texts (their component_id may be the doc_id for both); rows
without doc_id take part and have the component_id of their group's documents, null
if there are none; other columns are ignored by ``groups`` and pass through
``keep_one``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.llm.common import (
    WORD_HASHES,
    as_bytes,
    map_batches,
    release,
    shingle_set,
    stored,
    table,
)
from bizlens.llm.components import components
from bizlens.llm.sums import summed_vectors

#: Buckets in which shingles are counted: 16 MB, whatever the corpus.
BUCKETS = 1 << 21
SECTIONS = 32
#: A section's count is held in 16 bits; at this one it is taken as unbounded.
_FULL = 32767
#: Links per candidate set that a round with hubs must find to be followed by another.
HUB_YIELD = 0.01
#: One more common prefix shingle is asked for with every so many shingles of a set.
COMMON_STEP = 64


def text_set(text: bytes | None, size: int) -> np.ndarray:
    return shingle_set(WORD_HASHES.of(text.lower().split()), size) if text else np.empty(0, np.uint64)


def digest(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def common(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` must share with a linked set no smaller than it
    within both prefixes of ``prefix_length(n) + common(n) - 1``."""
    return min(-(-percent * n // 100), 2 + n // COMMON_STEP)


def _least_overlap(n: str, percent: int) -> Column:
    return F.expr(f"int(({percent} * {n} + 99) div 100)")


def _common(n: str, percent: int) -> Column:
    return F.least(_least_overlap(n, percent), F.expr(f"int(2 + {n} div {COMMON_STEP})"))


def _key() -> Column:
    """What stands for a row: its doc_id, or its text's hash if it has none."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def described(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """key, doc_id, n, digest, prefix (rarest shingles first), sections per row."""

    def bucket_counts(texts):
        found = np.zeros(BUCKETS, np.int64)
        for t in texts:
            if t:
                places = text_set(t.encode(), size) & np.uint64(BUCKETS - 1)
                np.add.at(found, places.astype(np.int64), 1)
        return found

    counts, _ = summed_vectors(docs.select("text"), bucket_counts, BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32))

    def make():
        def step(batch):
            counts, out = shared.value, ([], [], [], [])
            for t in as_bytes(batch.column(2)):
                found = text_set(t, size)
                n = len(found)
                rarity = counts[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]
                prefix = prefix_length(n, percent) + common(n, percent) - 1 if n else 0
                first = np.lexsort((found, rarity))[:prefix]
                sections = np.bincount((found >> np.uint64(59)).astype(np.int64), minlength=SECTIONS)
                sections = np.minimum(sections, _FULL).astype(np.int16)
                for column, value in zip(out, (n, digest(found), found[first].view(np.int64), sections)):
                    column.append(value)
            return [batch.column(0), batch.column(1), out[0], pa.array(out[1], pa.binary()), out[2], out[3]]

        return step

    schema = "key long, doc_id long, n int, digest binary, prefix array<long>, sections array<short>"
    return map_batches(_keyed(docs), schema, make)


def _fitting_lengths(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def postings_of(classes: DataFrame, percent: int) -> DataFrame:
    """h, cid, n, pos: the prefix shingles that may count for some link.

    A shingle counts for a set if another set of fitting length has it: the next one
    by length on either side tells. A set needs as many of them as it must share with
    the smallest set of fitting length. Both are asked twice, as each thins the other."""
    kept = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "h"))
    by_length = Window.partitionBy("h").orderBy("n")
    for _ in range(2):
        kept = kept.select("*", F.lag("n").over(by_length).alias("less"), F.lead("n").over(by_length).alias("more"))
        near = lambda other: F.col(other).isNotNull() & _fitting_lengths("n", other, percent)
        kept = kept.where(near("less") | near("more")).select("h", "cid", "n", "pos")
        kept = kept.withColumn("c", F.count("*").over(Window.partitionBy("cid")))
        smallest = kept.withColumn("s", _least_overlap("n", percent))
        kept = smallest.where(F.col("c") >= _common("s", percent)).select("h", "cid", "n", "pos")
    return kept


def _most_common(x: str, y: str, n_x: str, n_y: str) -> Column:
    """What two sets can share by their section counts: the sum of the lesser ones."""
    least_n = F.least(n_x, n_y)
    least = lambda p, q: F.when((p == _FULL) & (q == _FULL), least_n).otherwise(F.least(p, q).cast("int"))
    return F.aggregate(F.zip_with(x, y, least), F.lit(0), lambda acc, v: acc + v)


def _enough(overlap: Column, n_x: str, n_y: str, percent: int) -> Column:
    """overlap >= t / (1 + t) * total"""
    return (100 + percent) * overlap >= percent * (F.col(n_x) + F.col(n_y))


def _alike_sections(x: str, y: str, n_x: str, n_y: str, percent: int) -> Column:
    """Suffix filter: the overlap is at most the sum of the lesser section counts."""
    return _enough(_most_common(x, y, n_x, n_y), n_x, n_y, percent)


def may_link(pairs: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """a, b, ka, da, kb, db of those pairs (a, b) that pass the suffix filter."""
    side = lambda c: traits.select(
        F.col("cid").alias(c), F.col("key").alias(f"k{c}"), F.col("digest").alias(f"d{c}"),
        F.col("n").alias(f"n{c}"), F.col("sections").alias(f"s{c}"),
    )
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    alike = both.where(_alike_sections("sa", "sb", "na", "nb", percent))
    return alike.select("a", "b", "ka", "da", "kb", "db")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b: classes; ka, kb: keys of texts; da, db: digests) whose whole sets link."""
    wanted = pairs.select(F.col("ka").alias("key"), F.col("da").alias("digest")).unionByName(
        pairs.select(F.col("kb").alias("key"), F.col("db").alias("digest"))
    ).distinct()
    # one plan at every size: no broadcast that only small inputs could have
    held = texts.join(wanted.hint("merge"), "key").select("key", "digest", "text")
    side = lambda c: held.select(F.col("key").alias(f"k{c}"), F.col("digest").alias(f"d{c}"), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("a"), ["ka", "da"]).join(side("b"), ["kb", "db"])

    def make():
        def step(batch):
            known: dict = {}

            def of(text, wanted):
                if wanted not in known:
                    if len(known) > 64:
                        known.clear()
                    found = text_set(text, size)
                    known[wanted] = found if digest(found) == wanted else None
                return known[wanted]

            linked = []
            columns = [as_bytes(batch.column(k)) for k in (2, 3, 4, 5)]
            for da, db, ta, tb in zip(*columns):
                x, y = of(ta, da), of(tb, db)
                if x is None or y is None:  # another text under the same key
                    known.pop(da, None), known.pop(db, None)
                    linked.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            return [batch.column(0), batch.column(1), linked]

        return step

    judged = map_batches(both.select("a", "b", "da", "db", "ta", "tb"), "a long, b long, linked boolean", make)
    return judged.where("linked").select("a", "b")


def class_links(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links (a, b) between classes whose components are those of all links.

    ``classes``: cid, key, n, digest, prefix, sections. None if no two may link."""
    postings = stored(postings_of(classes, percent), "postings")
    release(classes.sparkSession)
    if postings.isEmpty():
        return None
    candidates = postings.select("cid").distinct()
    traits = stored(classes.join(candidates, "cid", "left_semi").select("cid", "key", "n", "digest", "sections"), "traits")
    sets = traits.count()
    # the texts that any pair can need, once for all rounds
    texts = stored(texts.join(traits.select("key").distinct().hint("merge"), "key", "left_semi"), "texts")
    release(classes.sparkSession)
    links = tested = merged = None
    labels, rounds = None, 0
    while True:
        current = postings.withColumn("component", F.col("cid"))
        if labels is not None:
            current = postings.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
                "component", F.coalesce("component", "cid")
            )
        left = current.groupBy("h", "component").agg(F.count("*").alias("c"))
        left = left.groupBy("h").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        open_ = stored(left.where("s * s > q").select("h"), "open")
        if open_.isEmpty():
            return links
        current = current.join(open_, "h", "left_semi")
        last = merged is not None and merged < HUB_YIELD * sets
        pairs = _all_pairs(current, classes, percent) if last else _hub_pairs(current, percent, rounds)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(may_link(pairs, traits, percent), "pairs")
        found = stored(verified(pairs, texts, size, percent), "found")
        release(classes.sparkSession)
        links = found if links is None else links.unionByName(found)
        if last:
            return links
        merged = found.count()
        pairs = pairs.select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = _labels(found, labels)
        rounds += 1


def _labels(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, component after a hub round: nodes with one label are in one component
    (not always the other way round; that is left to the end). A hub takes the least
    label around it, its members take the hub's, and labels stand for one another."""
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if labels is not None:  # links between labels
        name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"l{c}"))
        both = both.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
            F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")
        )
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    least = stored(least, "least")
    via = both.join(least.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m2"))
    step = least.join(via, "a").select("a", F.least("m", "m2").alias("component"))
    if labels is None:
        return stored(step.withColumnRenamed("a", "node"), "labels")
    moved = labels.join(step.select(F.col("a").alias("component"), F.col("component").alias("c")), "component", "left")
    moved = moved.select("node", F.coalesce("c", "component").alias("component"))
    new = step.select(F.col("a").alias("node"), "component").join(labels.select("node"), "node", "left_anti")
    return stored(moved.unionByName(new), "labels")


def _hub_pairs(postings: DataFrame, percent: int, round_: int) -> DataFrame:
    """Each class with the one hub that it shares most prefix shingles with, if more
    than one (a pair of a single one is left to the last round)."""
    # first the class with most shared shingles, which an original has of its copies
    order = F.xxhash64("cid", F.lit(round_)).alias("o")
    if not round_:
        degree = postings.groupBy("cid").agg((-F.count("*")).alias("d"))
        postings = postings.join(degree, "cid")
        order = F.struct("d", order).alias("o")
    hubs = postings.groupBy("h").agg(F.min(F.struct(order, "cid", "n", "component")).alias("y"))
    shared = postings.join(hubs, "h").where(
        (F.col("component") != F.col("y.component")) & _fitting_lengths("n", "y.n", percent)
    )
    counted = shared.groupBy("cid", F.col("y.cid").alias("hub")).agg(F.count("*").alias("c"))
    best = counted.where("c > 1").groupBy("cid").agg(F.max(F.struct("c", "hub")).alias("b"))
    return best.select(F.least("cid", "b.hub").alias("a"), F.greatest("cid", "b.hub").alias("b")).distinct()


def _placed(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """postings with ``rank``, a set's postings before this one, and ``behind``, the
    section counts of all its shingles behind this one (in or after the prefix)."""

    def make():
        def step(batch):
            kept, found, ranks, behind = [], [], [], []
            columns = [batch.column(k) for k in (3, 4, 5)]
            for k, (prefix, sections, at) in enumerate(zip(*columns)):
                prefix = prefix.values.to_numpy().view(np.uint64)
                sections = sections.values.to_numpy().astype(np.int32)
                at = np.sort(at.values.to_numpy())
                passed = np.zeros((len(prefix), SECTIONS), np.int32)
                passed[np.arange(len(prefix)), (prefix >> np.uint64(59)).astype(np.int64)] = 1
                left = np.where(sections < _FULL, sections - passed.cumsum(axis=0)[at], _FULL)
                kept.append(np.full(len(at), k))
                found.append((prefix[at].view(np.int64), at))
                ranks.append(np.arange(len(at)))
                behind.append(left.astype(np.int16))
            rows = pa.array(np.concatenate(kept))
            h, pos = (np.concatenate(x) for x in zip(*found))
            ends = np.arange(0, SECTIONS * len(rows) + 1, SECTIONS, dtype=np.int32)
            behind = pa.ListArray.from_arrays(ends, np.concatenate(behind).ravel())
            same = [batch.column(k).take(rows) for k in range(3)]
            return [*same, pa.array(h), pa.array(pos), pa.array(np.concatenate(ranks)), behind]

        return step

    # a set's positions are at most its prefix
    held = postings.groupBy("cid", "component").agg(F.collect_list("pos").alias("at"))
    rows = held.join(classes.select("cid", "n", "prefix", "sections"), "cid")
    schema = "cid long, component long, n int, h long, pos int, rank int, behind array<short>"
    return map_batches(rows.select("cid", "component", "n", "prefix", "sections", "at"), schema, make)


def _meetings(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """A row for each prefix shingle that two sets of different components share, by the
    length filter, the suffix filter and the positional filter.

    A shared shingle of a linked pair has at most min(ranks) common ones before it (what
    comes before it in either set is in the prefix, and common ones have postings of both)
    and, behind it, what the rest of either set allows. So all of its shared shingles
    stay in the join."""
    columns = ("cid", "n", "pos", "component", "rank", "behind")
    held = _placed(postings, classes)
    one = lambda n: held.select("h", *[F.col(c).alias(f"{c}_{n}") for c in columns])
    across = (F.col("cid_x") < F.col("cid_y")) & (F.col("component_x") != F.col("component_y"))
    before = F.expr("least(rank_x, rank_y) + 1")
    rest = F.expr("least(n_x - pos_x - 1, n_y - pos_y - 1)")
    may = (
        _fitting_lengths("n_x", "n_y", percent)
        & _enough(before + rest, "n_x", "n_y", percent)
        & _enough(before + _most_common("behind_x", "behind_y", "n_x", "n_y"), "n_x", "n_y", percent)
    )
    left, right = one("x"), one("y").withColumnRenamed("h", "h2")
    return left.join(right, (F.col("h") == F.col("h2")) & across & may)


def _all_pairs(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Every pair across components with enough common prefix shingles: they are counted,
    and the last of them bounds what can follow."""
    shared = _meetings(postings, classes, percent).groupBy(F.col("cid_x").alias("a"), F.col("cid_y").alias("b"), "n_x", "n_y").agg(
        F.count("*").alias("c"), F.max("pos_x").alias("last_x"), F.max("pos_y").alias("last_y")
    )
    smaller = shared.withColumn("n", F.least("n_x", "n_y"))
    behind = F.least(F.expr("n_x - last_x - 1"), F.expr("n_y - last_y - 1"))
    enough = _enough(F.col("c") + behind, "n_x", "n_y", percent)
    return smaller.where((F.col("c") >= _common("n", percent)) & enough).select("a", "b")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """key, doc_id, n_shingles, component_id, kept_key for every row. ``kept_key`` is
    the key of the one document of the group that stands for it."""
    rows = stored(described(docs, size, percent), "described")
    release(docs.sparkSession)
    same = rows.where("n > 0").groupBy("digest").agg(
        F.min("key").alias("key"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"), F.first("sections").alias("sections"),
        F.min("doc_id").alias("first_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("key").alias("k"))).alias("stay"),
    )
    same = stored(same, "sets")
    # a class is named by its key; of sets that share one, all but one by their digest
    named = same.groupBy("key").agg(F.min("digest").alias("named"))
    others = stored(same.select("digest", "key").join(named, "key").where("digest <> named").select("digest"), "others")
    classes = same.withColumn("cid", F.col("key"))
    if not others.isEmpty():
        marked = same.join(others.withColumn("other", F.lit(True)), "digest", "left")
        classes = marked.withColumn("cid", F.when(F.col("other"), F.xxhash64("digest")).otherwise(F.col("key")))
    links = class_links(classes, _keyed(docs).select("key", "text"), size, percent)
    light = rows.select("key", "doc_id", "n", "digest")
    of_class = classes.select("digest", "cid", "first_id", "stay")
    if links is None:
        of_class = of_class.withColumn("group", F.col("cid"))
    else:
        of_class = of_class.join(components(links).withColumnRenamed("node", "cid"), "cid", "left")
        of_class = of_class.withColumn("group", F.coalesce("component", "cid"))
    of_class = stored(of_class.select("digest", "group", "first_id", "stay"), "classes")
    release(docs.sparkSession)
    of_group = of_class.groupBy("group").agg(
        F.min("first_id").alias("component_id"), F.min("stay").alias("stay")
    )
    named = of_class.select("digest", "group").join(of_group, "group")
    empty = light.where("n = 0").select(
        "key", "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.col("doc_id").alias("component_id"), F.col("key").alias("kept_key"),
    )
    linked = light.where("n > 0").join(named, "digest").select(
        "key", "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id",
        F.col("stay.k").alias("kept_key"),
    )
    return linked.unionByName(empty)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose group another document stands for.
    Of rows that share doc_id and text one stays."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    kept = groups(docs, size, percent).groupBy("key").agg(
        F.max(F.col("key") == F.col("kept_key")).alias("stays"), F.count("*").alias("c")
    )
    kept = stored(kept.where("stays").select(F.col("key").alias(name), "c"), "kept")
    release(docs.sparkSession)
    keyed = docs.withColumn(name, _key())
    once = keyed.join(kept.where("c = 1").select(name), name, "left_semi")
    again = kept.where("c > 1").select(name)
    if again.isEmpty():
        return once.drop(name)
    more = keyed.join(again, name, "left_semi").dropDuplicates([name, "text"])
    return once.unionByName(more).drop(name)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


#: All pairs of documents that share a shingle; the closure by repeated joins.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (
  SELECT DISTINCT doc_id, doc_id FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""
