"""Shared steps that grew faster than their input: what they compile to, shuffle and write."""

import glob
import json

import numpy as np
from pyspark.sql import functions as F

from bizlens.functions import cleaning as C
from bizlens.operators import name_index as NI
from bizlens.operators.clean import clean_record
from bizlens.operators.enrich import enrich_geo
from bizlens.plans import catalog
from bizlens.schema import KEEP_COLUMNS
from bizlens.sources import tpch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_is_compiled(spark):
    """The long date rule is kept out of the generated code, which then compiles."""
    row = {c: " x " for c in KEEP_COLUMNS} | {"registration_incorporation_date": "2020-W01-1", "uen_issue_date": "20200131"}
    raw = spark.createDataFrame([row])
    name = "spark.sql.codegen.fallback"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        plan = _plan(clean_record(raw))
        found = clean_record(raw).first()
    finally:
        spark.conf.set(name, before)
    assert "lambdafunction" in plan.lower()
    assert str(found.registration_incorporation_date) == "2019-12-30" and str(found.uen_issue_date) == "2020-01-31"


def test_strip_and_codes(spark):
    texts = ["", " ", "a", " a ", "　a\t", "a ", "é", " é ", "\x1ca b\x85", "12", "1٢", "12345", "1x", "7\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.s for r in df.select(C.strip_ws("t").alias("s")).collect()]
    assert found == [None if t is None else t.strip() for t in texts]
    codes = {r.t: r.c for r in df.select("t", C.ssic_from_na("t").alias("c")).collect()}
    assert codes["12"] == "00012" and codes["1٢"] == "0001٢" and codes["1x"] == "1x" and codes["12345"] == "12345"


def test_small_dim_of_joins_is_broadcast(spark, tmp_path):
    rows = [{c: "1" for c in KEEP_COLUMNS} | {"postal_code": f"{k:06d}"} for k in range(20)]
    raw = spark.createDataFrame(rows).withColumn("registration_incorporation_date", F.current_date())
    side = spark.range(1000).select(F.col("id"), F.col("id").alias("k"))
    side.write.parquet(str(tmp_path / "a"))
    side, other = spark.read.parquet(str(tmp_path / "a")), spark.range(50).withColumnRenamed("id", "k2")
    dim = side.join(other, side.k == other.k2).select(
        F.lpad(F.col("k").cast("string"), 6, "0").alias("postal_code"), F.lit(1.0).alias("latitude"),
        F.lit(2.0).alias("longitude"), F.lit("s").alias("subzone_id"), F.lit("p").alias("planning_area_id"),
        F.current_timestamp().alias("updated_at"))
    # the estimate is the product of both sides, whatever the join keeps
    dim = dim.crossJoin(spark.range(10**7).limit(1).select(F.lit(1).alias("one"))).drop("one")
    out = enrich_geo(raw, dim, codes_cleaned=True)
    plan = _plan(out)
    assert plan.count("BroadcastHashJoin [postal_code") == 1, plan
    assert out.where("subzone_id = 's'").count() == 20


def test_pages_are_compressed_and_whole(spark, tmp_path):
    rows = [(o, n, o, o % 7, "O", "R", 30.0, 0.01, 20) for o in range(1, 301) for n in (1, 2)]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string, " \
           "l_quantity double, l_discount double, d int"
    spark.createDataFrame(rows, cols).withColumn("l_shipdate", F.expr("date_add(DATE'2000-01-01', d)")).drop("d").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    root = catalog._write_pages(spark, str(tmp_path))
    assert glob.glob(f"{root.removeprefix('file:')}/*.json.gz") and not glob.glob(f"{root.removeprefix('file:')}/*.json")
    pages = [json.loads(r.value) for r in spark.read.text(root).collect()]
    assert sum(len(p["result"]["records"]) for p in pages) == 600
    assert {p["result"]["total"] for p in pages} == {600}
    first = min((p for p in pages if p["result"]["records"]), key=lambda p: p["offset"])
    assert first["result"]["records"][0].keys() == {*KEEP_COLUMNS, "extra_col"}


def test_block_postings():
    names = ["abcabc", "", "bca", "ab", "éßa"]
    texts, counts, gaps = NI.block_postings(names)
    at, found = 0, {}
    for text, n in zip(texts, counts):
        found[text] = NI.places_of(gaps[at : at + 2 * n]).tolist()
        at += 2 * n
    assert found == {"abc": [0], "bca": [0, 2], "cab": [0], "éßa": [4]}
    assert NI.block_postings(["", "a"])[0] == [] and NI.block_postings([])[0] == []
    many = ["xyz"] * NI.BLOCK
    assert np.array_equal(NI.places_of(NI.block_postings(many)[2]), np.arange(NI.BLOCK))


def test_index_over_many_blocks(spark, tmp_path, monkeypatch):
    """Postings are a row per piece and block, not one per piece and entity."""
    rows = spark.range(5000).select(
        F.format_string("%08dK", "id").alias("uen"), F.lit(202401).alias("registration_month"),
        F.format_string("Name %d", F.col("id") * 7919 % 5000).alias("entity_name")).repartition(3).cache()
    NI.write_name_index(rows, str(tmp_path))
    index = NI.NameIndex(spark, str(tmp_path), rows)
    assert index.postings.groupBy("piece").count().agg(F.max("count")).first()[0] <= 3
    for text in ("me 12", "4321", "E 77", "999"):
        want = sorted(r.uen for r in rows.where(F.lower("entity_name").contains(text.lower())).collect())
        assert sorted(r.uen for r in index.rows(text).collect()) == want, text
    monkeypatch.setattr(NI, "MAX_CANDIDATES", 0)
    assert index.rows("4321").count() == 1
