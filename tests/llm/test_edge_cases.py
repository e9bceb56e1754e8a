"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

from bizlens.llm import bpe, decontaminate, jaccard, language, lines, pii, quality, suffixes, token_counts

from .helpers import LONG, PROSE, SCHEMA, awkward, awkward_rows

BENCHMARK = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, "word0 and0"), (4, "one"), (5, "...")]


def _benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda d: decontaminate.report(d, _benchmark(d.sparkSession)),
    "jaccard": lambda d: jaccard.groups(d),
    "quality": lambda d: quality.judge(d),
    "lines": lambda d: lines.dedup(d),
    "tokens": lambda d: token_counts.count_tokens(d),
    "language": lambda d: language.predict(d, language.fit(d.where("lang is not null").select("doc_id", "text", "lang"))),
    "suffixes": lambda d: suffixes.dedup(d),
    "pii": lambda d: pii.replace(d, count="n_entities"),
    "bpe": lambda d: bpe.decode(bpe.encode(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_table(spark, name):
    rows = OPERATORS[name](awkward(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None) == sorted(
        (False, r[0]) for r in awkward_rows() if r[0] is not None
    )
    assert len(rows) == len(awkward_rows())
    empty = OPERATORS[name](spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == OPERATORS[name](awkward(spark)).columns


def test_decontamination_values(spark):
    got = {r.doc_id: r for r in OPERATORS["decontaminate"](awkward(spark)).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1]["items"] == []
    assert got[6]["items"] == ["1"] and got[6].n_hit == got[6].n_words
    assert got[9]["items"] == ["4"] and got[9].spans[0].asDict() == {"start": 0, "end": 3}
    assert got[4].n_hit == 0 and got[4].n_words == len(LONG.split())


@pytest.mark.parametrize("name", ["quality", "jaccard", "decontaminate", "pii"])
def test_stage_forms_keep_columns(spark, name):
    stage = {
        "quality": quality.keep_good,
        "jaccard": jaccard.keep_one,
        "decontaminate": lambda d: decontaminate.drop_contaminated(d, _benchmark(spark)),
        "pii": pii.replace,
    }[name]
    docs = awkward(spark)
    out = stage(docs)
    assert out.schema == docs.schema
    kept = [(r.doc_id, r.text) for r in out.collect()]
    given = [r[:2] for r in awkward_rows()]
    if name == "pii":
        assert sorted(kept, key=str) == sorted(given, key=str)
    if name == "decontaminate":
        assert {i for i, _ in kept} == {1, 2, 3, 4, 5, 8, 10}
    if name == "jaccard":  # 4 for 5; 6 once, for 7 and the row without doc_id
        assert sorted(i for i, _ in kept) == [1, 2, 3, 4, 6, 8, 9, 10]
    assert stage(spark.createDataFrame([], SCHEMA)).count() == 0
