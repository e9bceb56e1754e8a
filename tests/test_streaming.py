"""Streaming upkeep equals the batch rollup; deltas are merged exactly once."""

import datetime as dt
import os
from collections import Counter

from pyspark.sql import types as T

from bizlens.operators.rollups import rollup
from bizlens.session import shared_dir
from bizlens.streaming.rollups import stream_rollup, stream_rollup_deltas


def test_stream_equals_batch(spark):
    rows = [(dt.date(2024, m, 1), 202400 + m, f"{m % 3}", "L" if m % 2 else "X") for m in range(1, 13)] * 5
    df = spark.createDataFrame(rows, "registration_incorporation_date date, registration_month int, "
                               "primary_ssic_norm string, entity_status_description string")
    src = shared_dir(spark, "test-stream-src")
    df.repartition(6).write.partitionBy("registration_month").parquet(src)
    schema = spark.read.parquet(src).schema
    name = "new_entities_monthly_by_ssic"
    want = sorted((tuple(r) for r in rollup(df, name).collect()), key=str)
    for mode in ("update", "complete"):
        got = stream_rollup(spark, src, schema, name, shared_dir(spark, "o"), shared_dir(spark, "c"),
                            max_files_per_trigger=2, mode=mode)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want, mode
    ckpt, out = shared_dir(spark, "c2"), shared_dir(spark, "o2")
    got2 = stream_rollup_deltas(spark, src, schema, name, out, ckpt, max_files_per_trigger=2)
    assert sorted((tuple(r) for r in got2.collect()), key=str) == want
    # re-running from the same checkpoint finds no new files: still exactly once
    got3 = stream_rollup_deltas(spark, src, schema, name, out, ckpt, max_files_per_trigger=2)
    assert sorted((tuple(r) for r in got3.collect()), key=str) == want


def test_replayed_batch_changes_nothing(spark):
    """A batch that wrote some of its output and died before its commit runs again."""
    rows = [(dt.date(2024, m, 1), 202400 + m, f"{m % 3}", "L") for m in range(1, 9)] * 3
    df = spark.createDataFrame(rows, "registration_incorporation_date date, registration_month int, "
                               "primary_ssic_norm string, entity_status_description string")
    src, out, ckpt = (shared_dir(spark, f"test-replay-{k}") for k in ("src", "out", "ckpt"))
    df.repartition(4).write.parquet(src)
    schema, name = spark.read.parquet(src).schema, "new_entities_monthly_by_ssic"
    want = sorted(map(tuple, rollup(df, name).collect()), key=str)

    def run():
        got = stream_rollup(spark, src, schema, name, out, ckpt, max_files_per_trigger=1)
        return sorted(map(tuple, got.collect()), key=str)

    assert run() == want
    local = lambda p: p.removeprefix("file:")
    last = max(int(f) for f in os.listdir(local(ckpt) + "/commits") if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        if os.path.exists(path := f"{local(ckpt)}/commits/{f}"):
            os.remove(path)
    parts = sorted(f for f in os.listdir(f"{local(out)}/batch_id={last}") if f.startswith("part-"))
    os.remove(f"{local(out)}/batch_id={last}/{parts[0]}")
    assert run() == want


def test_batches_count_on_from_written_totals(spark):
    """Each batch writes the new totals of its own keys, also of keys without a month or code, and after
    a restart; months come again behind a batch without them. No state store holds the keys."""
    name, keys = "new_entities_monthly_by_ssic", ["registration_month", "primary_ssic_norm", "entity_status_description"]
    src, out, ckpt = (shared_dir(spark, f"count-on-{x}") for x in "soc")
    files = [
        [(202401, "a", "L"), (202401, None, "L"), (202401, "", "L"), (None, "a", "L")],
        [(202402, "a", "L"), (202402, "b", None)],
        [(202401, "a", "L"), (202401, "a", "L"), (202401, None, "L"), (202402, "c", "L"), (None, "a", "L")],
        [(202401, "a", "L"), (202401, "", "L"), (202401, "b", "L"), (202402, "b", None), (None, None, None)],
    ]
    schema = T.StructType.fromDDL("registration_month int, primary_ssic_norm string, entity_status_description string")
    totals: Counter = Counter()
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        if n == 0:  # the first two files come in one run, each of the others in a run of its own
            continue
        got = stream_rollup(spark, src, schema, name, out, ckpt, max_files_per_trigger=1)
        for k, part in enumerate(files[:2] if n == 1 else [rows], start=n - (n == 1)):
            totals.update(part)
            written = spark.read.parquet(f"{out}/batch_id={k}").select(*keys, "new_entities")
            assert Counter(map(tuple, written.collect())) == Counter((*key, totals[key]) for key in set(part)), k
        assert Counter(map(tuple, got.collect())) == Counter((*key, c) for key, c in totals.items())
    assert not os.path.exists(f"{ckpt.removeprefix('file:')}/state")


def test_checkpoint_with_a_state_store_goes_on(spark):
    """Update mode once kept its totals in Spark's state store; such a checkpoint still resumes."""
    name = "new_entities_monthly_by_subzone"
    src, out, ckpt = (shared_dir(spark, f"stateful-{x}") for x in "soc")
    schema = T.StructType.fromDDL("registration_month int, subzone_id string")
    spark.createDataFrame([(202401, "a"), (202401, None)], schema).coalesce(1).write.parquet(src)
    (rollup(spark.readStream.schema(schema).parquet(src), name).writeStream.outputMode("update")
     .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch_id={n}"))
     .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    spark.createDataFrame([(202401, "a"), (202402, "a")], schema).coalesce(1).write.mode("append").parquet(src)
    got = stream_rollup(spark, src, schema, name, out, ckpt)
    assert Counter(map(tuple, got.collect())) == Counter([(202401, "a", 2), (202401, None, 1), (202402, "a", 1)])
