"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bizlens.llm import manifest

from .helpers import SCHEMA, awkward, awkward_rows, lowered


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return H("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def brute_force(rows):
    """rows: doc_id, source, lang, n_chars, text"""
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    found = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        found[name] = levels([leaf(*r) for r in trees[name]])
    top = levels([found[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for k, r in enumerate(trees[name]):
            own = leaf(*r)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            end = leaf(*r[:4], None if r[4] is None else lowered(r[4])) if tampered else own
            proof = ""
            for nodes, at in [(found[name], k), (top, place)]:
                for level in nodes[:-1]:
                    run = level[at - at % 8 : at - at % 8 + 8]
                    proof += "".join(run[: at % 8] + run[at % 8 + 1 :])
                    end = H("".join(run[: at % 8] + [end] + run[at % 8 + 1 :]))
                    at //= 8
            out.append((r[0], own, found[name][-1][0], top[-1][0], H(proof), end, end == top[-1][0]))
    return out


def _claim():
    low = F.translate("text", manifest.CAPITALS, manifest.CAPITALS.lower())
    changed = manifest.leaf([low if f == "text" else F.col(f) for f in manifest.FIELDS])
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)


def _check(spark, rows, height):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema).repartition(5)
    got = manifest.manifest(docs, _claim(), levels=height).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(brute_force(rows), key=str)
    for r in got:
        path = [(s["at"], s["siblings"]) for s in r.path]
        assert manifest.folded(r.leaf, path) == r.root
        assert H("".join("".join(s) for _, s in path)) == r.proof_sha256
    return got


def _rows(sizes, seed=13):
    rng = random.Random(seed)
    ids = rng.sample(range(-50, 10 * sum(sizes.values())), sum(sizes.values()))
    texts = ["Abc", "abc", "", None, "É漢字🙂 X", "x" * 300]
    pick = lambda *c: rng.choice(c)
    langs = [name for name, n in sizes.items() for _ in range(n)]
    return [(i, pick("s", None, "ü"), lang, pick(1, None, 30), rng.choice(texts)) for i, lang in zip(ids, langs)]


@pytest.mark.parametrize("height", [1, 2])
def test_rounds_against_brute_force(spark, height):
    """Full, partial and single last subtrees on every level; one to four rounds."""
    sizes = {None: 1, "": 7, "a": 8, "B": 9, "é": 64, "en": 73, "de": 513, "fr": 600, "z": 72}
    got = _check(spark, _rows(sizes), height)
    assert {r.verified for r in got} == {True, False}


def test_many_partitions_and_an_only_one(spark):
    _check(spark, _rows({f"l{k}": 1 + k % 3 for k in range(75)}), 1)
    _check(spark, _rows({"en": 20}), 1)
    _check(spark, _rows({"en": 1}), 4)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = [tuple(r) for r in manifest.manifest(docs, _claim(), paths=False).collect()]
    rows = [(r[0], None, None, r[4], r[1]) for r in awkward_rows()]
    assert sorted(got, key=str) == sorted(brute_force(rows), key=str)
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    got = [tuple(r) for r in manifest.op13(spark, "/root/testdata/sf0.001").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(got) == sorted(brute_force(rows))
