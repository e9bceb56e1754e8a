"""Name search by index equals the scan; deep pages equal offset and limit."""

import random

import pytest
from pyspark.sql import functions as F

from bizlens.operators import name_index as NI
from bizlens.operators.filters import text_search
from bizlens.operators.paging import Pager, page


def _fact(spark, n=600):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcÉß ") for _ in range(rng.randrange(1, 9)))
    rows = [(f"{k % 400:08d}K", 202400 + k % 12 + 1, rng.choice(["Acme Holdings ", "ACME ", ""]) + word() + word()) for k in range(n)]
    rows += [("X1", 202401, None), ("X2", 202401, ""), ("X3", 202402, "ab"), ("abc", 202403, "other %_ name\nline")]
    return spark.createDataFrame(rows, "uen string, registration_month int, entity_name string")


@pytest.mark.parametrize("share, pushed", [(0.05, 1000), (0.6, 3), (0.0, 1000), (1.0, 0)])
def test_index_equals_scan(spark, tmp_path, monkeypatch, share, pushed):
    monkeypatch.setattr(NI, "MAX_SHARE", share)
    monkeypatch.setattr(NI, "MAX_PUSHED", pushed)
    fact = _fact(spark).cache()
    NI.write_name_index(fact, str(tmp_path))
    index = NI.NameIndex(spark, str(tmp_path), fact)
    rng = random.Random(1)
    names = [r[0] for r in fact.where("entity_name <> ''").select("entity_name").collect()]
    texts = ["acme h", "ab", "a", "zzzz", "%_ n", "name\nline", "abc", "00000007K", "ME HOLD", "É", "no such", "ss"]
    for _ in range(12):
        name = rng.choice(names)
        k = rng.randrange(len(name))
        texts.append(rng.choice([str.upper, str.lower, str])(name[k : k + rng.randrange(1, 7)]))
    for t in texts:
        want = sorted(tuple(r) for r in fact.where(text_search(t)).collect())
        assert sorted(tuple(r) for r in index.rows(t).collect()) == want, t


def test_only_candidates_are_read(spark, tmp_path):
    fact = _fact(spark)
    fact.write.partitionBy("registration_month").parquet(f"{tmp_path}/fact")
    stored = spark.read.parquet(f"{tmp_path}/fact")
    NI.write_name_index(stored, f"{tmp_path}/index")
    index = NI.NameIndex(spark, f"{tmp_path}/index", stored)
    scan = index.rows("%_ name")._jdf.queryExecution().executedPlan().toString().split("FileScan")[1]
    assert "(registration_month" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "EqualTo(uen,abc)" in scan or "In(uen" in scan
    assert index._chosen("ab") is None and index._chosen("qqq") == []


@pytest.mark.parametrize("limit, offset", [(10, 0), (7, 2990), (50, 1000), (5, 3000), (5, 10**9), (0, 5), (10**6, 10)])
def test_pages(spark, many_partitions, limit, offset):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 3 * 0).alias("hot"), (F.col("id") * 7919 % 1000).alias("k")).repartition(6)
    order = [F.col("hot").desc(), F.col("k").asc(), F.col("id").asc()]
    want = [tuple(r) for r in rows.orderBy(*order).collect()][offset : offset + limit]
    assert [tuple(r) for r in page(rows, order, limit, offset, shallow=0).collect()] == want
    assert [tuple(r) for r in page(rows, order, limit, offset, shallow=10**10).collect()] == want


@pytest.fixture
def many_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_pager_reads_a_page(spark, many_partitions):
    rows = spark.range(5000).withColumn("v", F.col("id") % 10).repartition(5)
    pager = Pager(rows, [F.col("v"), F.col("id")])
    assert pager.total == 5000 and len(pager.sizes) > 1
    assert [r.id for r in pager.page(3, 4000).collect()] == [8, 18, 28]
    assert Pager(rows.limit(0), [F.col("id")]).page(5).collect() == []
    with pytest.raises(ValueError):
        page(rows, [F.col("id")], 5, -1)
