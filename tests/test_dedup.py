"""A9 keep-latest equals the sequential fold; A10 newest version per key."""

import datetime as dt
import random

from bizlens.operators.dedup import dedup_keep_latest, latest_by_key

D1, D2 = dt.date(2020, 1, 1), dt.date(2021, 1, 1)


def _fold(rows):
    kept = {}
    for uen, d, ordv, payload in rows:
        if not uen:
            continue
        if uen not in kept:
            kept[uen] = (d, payload)
            continue
        old = kept[uen][0]
        if (old is not None and d is not None and d > old) or (old is None and d is not None):
            kept[uen] = (d, payload)
    return {k: v[1] for k, v in kept.items()}


def _run(spark, rows):
    df = spark.createDataFrame(rows, "uen string, d date, ord long, payload string")
    out = dedup_keep_latest(df, "uen", "d", "ord").collect()
    return {r.uen: r.payload for r in out}


def test_fixture_table(spark):
    cases = [
        ([D1, D2], "2"), ([D2, D1], "1"), ([D1, D1], "1"),
        ([None, D1], "2"), ([D1, None], "1"), ([None, None], "1"),
    ]
    rows = []
    for i, (dates, _) in enumerate(cases):
        for j, d in enumerate(dates):
            rows.append((f"u{i}", d, j, str(j + 1)))
    got = _run(spark, rows)
    assert got == {f"u{i}": want for i, (_, want) in enumerate(cases)}


def test_random_rows_equal_fold(spark):
    rnd = random.Random(42)
    dates = [None, D1, D2, dt.date(2019, 5, 5)]
    rows = [(f"k{rnd.randint(0, 60)}" if rnd.random() > 0.02 else "", rnd.choice(dates), i, f"p{i}")
            for i in range(3000)]
    assert _run(spark, rows) == _fold(rows)


def test_latest_by_key(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 5, "q")]
    df = spark.createDataFrame(rows, "k string, v int, p string")
    got = {r.k: r.p for r in latest_by_key(df, "k", "v").collect()}
    assert got == {"a": "y", "b": "q"}
