"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bizlens.llm import resample

from .helpers import SCHEMA, awkward, awkward_rows, lowered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text):
    w = WORD.findall(lowered(text))
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
    return [zlib.crc32(f.encode()) % 10000 for f in w + pairs], len(w)


def brute_force(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(feature_buckets(text)[0])
    for text in target:
        t.update(feature_buckets(text)[0])
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000))))
    rows = []
    for doc_id, text in docs:
        found, n_words = feature_buckets(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, n_words])
    order = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: 25 * len(order) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def _corpus(n):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)] + ["É漢字", "x" * 47, "y" * 48, "z" * 49, "q" * 300]
    text = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(k))
    docs = [(k, text(rng.choice([0, 1, 2, 19, 20, 21, 60]))) for k in range(n)]
    docs += [(n + 1, None), (n + 2, ""), (n + 3, "..."), (None, text(30)), (-5, docs[-1][1])]
    return docs, [text(25).title() for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("segment_rows, samples", [(25_000, 16), (40, 16), (7, 2), (1, 1)])
def test_against_brute_force(spark, monkeypatch, segment_rows, samples):
    monkeypatch.setattr(resample, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(resample, "SAMPLES", samples)
    docs, target = _corpus(500)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resample.resample(frame, goal).collect()]
    assert sorted(got, key=str) == sorted(brute_force(docs, target), key=str)


def test_pair_sums_equal_checksums():
    texts = [b"a bc  def", b"", None, b"x" * 48 + b" " + b"y" * 49 + b" z", "é 漢字".encode()]
    counts, single, pairs = resample.features(texts, 1 << 31)
    flat = [t.split() for t in texts if t]
    assert counts.tolist() == [3, 0, 0, 3, 2]
    assert single.tolist() == [zlib.crc32(w) % (1 << 31) for ws in flat for w in ws]
    want: list = []
    for ws in flat:
        want += [zlib.crc32(a + b" " + b) % (1 << 31) for a, b in zip(ws, ws[1:])] + [1 << 31]
    assert pairs.tolist() == want


def test_ties_and_hot_scores(spark, monkeypatch):
    monkeypatch.setattr(resample, "SEGMENT_ROWS", 50)
    scored = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(59).cast("long").alias("n_features"),
        F.lit(0).cast("long").alias("weight"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 4).cast("long").alias("score"),
    ).repartition(7)
    got = {r.doc_id: r["rank"] for r in resample.ranked(scored, F.col("n_words") >= 20, 40).collect()}
    order = sorted(got, key=lambda i: (-(5 if i % 3 == 0 else i % 4), i))
    assert {i: r for i, r in got.items() if r} == {i: k + 1 for k, i in enumerate(order[:400])}


def test_awkward_rows(spark):
    docs = awkward(spark)
    goal = spark.createDataFrame([(1, "the river"), (2, None)], "item_id long, text string")
    got = [tuple(r) for r in resample.resample(docs, goal).collect()]
    want = brute_force([r[:2] for r in awkward_rows()], ["the river", None])
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert resample.resample(empty, goal).count() == 0
    assert resample.resample(docs, empty).count() == len(awkward_rows())
