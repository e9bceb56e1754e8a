import random

import pytest

from bizlens.llm import jaccard
from bizlens.llm.components import components as linked

from .helpers import components


def _rows(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "a b"), (n + 3, "A\tB"), (0, rows[0][1])]
    return rows


def _check(spark, rows, size, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.groups(docs, size, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(components(rows, size, percent))


def test_against_all_pairs(spark):
    _check(spark, _rows(), 4, 85)


def test_hub_rounds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_YIELD", 1e-9)  # hubs until they merge nothing
    _check(spark, _rows(5), 5, 80)


def test_one_hub_round(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_YIELD", 1e9)  # the rest by all pairs that are left
    _check(spark, _rows(7), 4, 85)


def test_far_copies_of_one_text_do_not_meet(spark, monkeypatch):
    rng = random.Random(13)
    base, rows = [f"w{k}" for k in range(140)], []
    for n in range(60):  # about 0.8 of the original's shingles and 0.6 of each other's
        copy = list(base)
        for k in rng.sample(range(0, 140, 5), 4):
            copy[k] = f"x{n}-{k}"
        rows.append((n, " ".join(copy)))
    # a pair that the last join must find
    rows += [(100, " ".join(f"y{k}" for k in range(140))), (101, " ".join(f"y{k}" for k in range(139)))]
    met, meetings = [], jaccard._meetings

    def counted(*args):
        joined = meetings(*args)
        met.append(joined.count())
        return joined

    monkeypatch.setattr(jaccard, "_meetings", counted)
    monkeypatch.setattr(jaccard, "HUB_YIELD", 1e9)
    monkeypatch.setattr(jaccard, "_hub_pairs", lambda postings, *_: postings.selectExpr("cid AS a", "cid AS b").limit(0))
    _check(spark, rows, 4, 85)
    assert len(met) == 1 and met[0] < 60 * 59 // 2  # less than once per pair


def test_linked_sets_share_enough_prefix_shingles():
    rng = random.Random(11)
    for percent in (80, 85):
        for _ in range(3000):
            n = rng.randrange(1, 400)
            same = set(rng.sample(range(2000), n))
            other = set(rng.sample(sorted(same), rng.randrange(1, n + 1))) | set(rng.sample(range(2000), n // 9))
            if 100 * len(same & other) < percent * len(same | other):
                continue
            prefix = lambda s: set(sorted(s)[: jaccard.prefix_length(len(s), percent) + jaccard.common(len(s), percent) - 1])
            needed = jaccard.common(min(len(same), len(other)), percent)
            assert len(prefix(same) & prefix(other)) >= needed
            smallest = -(-percent * max(len(same), len(other)) // 100)
            assert needed >= jaccard.common(smallest, percent)


def test_sets_of_one_doc_id(spark):
    text = " ".join(f"a{k}" for k in range(40))
    docs = spark.createDataFrame(
        [(7, text), (7, " ".join(f"b{k}" for k in range(40))), (9, text + " more")], "doc_id long, text string"
    )
    got = jaccard.groups(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(7, 37, 7), (7, 37, 7), (9, 38, 7)]


def test_prefix_length_finds_every_partner():
    for percent in (80, 85):
        for n in range(1, 400):
            need = -(-percent * n // 100)
            assert jaccard.prefix_length(n, percent) == n - need + 1


def test_long_chain(spark):
    links = spark.range(64).selectExpr("id + 1 AS a", "id AS b")
    got = {r.node: r.component for r in linked(links).collect()}
    assert got == dict.fromkeys(range(65), 0)


def test_components_that_still_change_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        linked(path, max_rounds=1)
    assert {r.component for r in linked(path).collect()} == {0}
