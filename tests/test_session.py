"""Session helpers: shared folder under the checkpoint dir, size-checked broadcast, tuning."""

from bizlens.plans.joins import checked_broadcast, estimated_bytes, fits_broadcast
from bizlens.session import checkpoint_root, shared_dir, tune


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()  # hints show before optimisation


def test_shared_dir_under_checkpoint_root(spark):
    root = checkpoint_root(spark)
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a.startswith(root.rstrip("/")) and a != b


def test_checked_broadcast_bounds(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert 0 < estimated_bytes(small) < 1 << 20
    assert "broadcast" in _plan(checked_broadcast(small)).lower()
    assert not fits_broadcast(small, max_bytes=10)
    assert "broadcast" not in _plan(checked_broadcast(small, max_bytes=10)).lower()
    unknown = spark.createDataFrame([(1,)], "a int")  # in-memory rows: size unknown to the optimizer
    assert not fits_broadcast(unknown)


def test_exploded_rows_are_not_trusted(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "small"))
    grown = spark.read.parquet(str(tmp_path / "small")).selectExpr("id", "explode(sequence(1, 100000)) AS n")
    assert not fits_broadcast(grown)
    assert "broadcast" not in _plan(checked_broadcast(grown)).lower()


def test_tuned_shuffle_partitions_are_small(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        tune(spark)
        assert spark.conf.get(key) == "16MB"
        spark.conf.set(key, "256MB")
        tune(spark)
        assert spark.conf.get(key) == "256MB"
    finally:
        spark.conf.set(key, old)


def test_tune_only_touches_defaults(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "65535")
        tune(spark)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "12345")
        tune(spark)
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.set(key, old)
