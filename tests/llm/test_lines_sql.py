"""Line dedup through its query against DuckDB, with sentences, passages and scripts without spaces."""

import random

import duckdb
import pandas as pd

from bizlens.llm import lines


def _texts():
    rng = random.Random(15)
    word = lambda: rng.choice(["a", "Be", "cé", "漢字漢", "d.e", "ไทย", "f", "gg!"])
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 12))) + rng.choice([".", "!", "?", ""])
    pool = [sentence() for _ in range(40)] + ["漢字" * 6, "x" * 60, "", "  ", "wait... what?! "]
    verse = "\n".join(f"verse {k} of it." for k in range(16))
    text = lambda: "".join(rng.choice(pool) + rng.choice([" ", "\n", "  \n", "\t", " \r\n"]) for _ in range(rng.randrange(12)))
    out = [text() + (rng.choice([verse, verse.replace("\n", " "), verse.upper()]) if rng.random() < 0.4 else "") + text() for _ in range(60)]
    return [*out, None, "", "\n", verse * 3, "again. " * 120]


def test_query_against_sql(spark, tmp_path):
    rows = list(enumerate(_texts()))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lines.op5(spark, str(tmp_path)).collect()}
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by DuckDB
    want = duckdb.sql(lines.OP5_SQL).fetchall()
    assert sorted(tuple(r) for r in got.values()) == sorted((a, b, c, d, e, f) for a, b, c, d, e, f in want) or [
        (tuple(got[r[0]]), r) for r in want if tuple(got[r[0]]) != r] == []
    assert sum(r.n_removed > 0 for r in got.values()) > 20


def test_passage_inside_longer_lines(spark):
    shared = "The old mill stands by the quiet river bank. " * 1 + " ".join(
        f"Sentence number {k} tells of the same long passage here." for k in range(7))
    rows = [(1, f"First text begins alone here today. {shared} And it ends."), (2, f"Other words stand in the second one. {shared} Then more words.")]
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].text == "Other words stand in the second one. Then more words." and got[2].n_removed == 8
