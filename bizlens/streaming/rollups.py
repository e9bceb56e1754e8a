"""Structured Streaming upkeep of the monthly rollups (ST1..ST5).

The reference keeps its rollups current with insert-triggered materialised
views summed by the storage engine. Here a file stream over the enriched
fact's folder feeds either

* ``stream_rollup`` (ST1..ST4): ``groupBy(keys).count()`` kept up over all batches. In
  ``update`` mode (default) a micro-batch emits the new totals of the keys whose
  counts changed and writes them to ``batch_id=<n>``; readers take each key's newest
  total. Nothing written before is touched, so a batch that dies half-way loses
  nothing, and its replay overwrites its own folder alone. The written totals are the
  state: a batch counts on from those of its own months, so no executor holds an entry
  for each key (codes x months grow with the table). The output folder belongs to the
  checkpoint: neither is of use without the other. In ``complete`` mode every batch
  rewrites the whole rollup from Spark's state store (best while the rollup is small);
  that state is bounded by months x keys, so no watermark is needed; or
* ``stream_rollup_deltas`` (ST5): a stateless per-batch rollup written to
  ``batch_id=<n>`` (overwrite, so replays are exactly-once), merged on read
  with R5 (``sum_rollups``).

Both run with ``trigger(availableNow=True)`` from a checkpoint in the shared
folder, so a restarted job resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pyspark.sql import functions as F

from bizlens.operators.rollups import ROLLUP_KEYS, rollup, sum_rollups


def _source(spark: SparkSession, path: str, schema: T.StructType, max_files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def newest_totals(written: DataFrame, keys: list[str]) -> DataFrame:
    """The rollup from totals written per batch: of each key the newest one."""
    return written.groupBy(*keys).agg(F.max_by("new_entities", "batch_id").alias("new_entities"))


def _names_in(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def _totals_of(spark: SparkSession, out_path: str, schema: T.StructType, batches: list[int]) -> DataFrame:
    folders = [f"{out_path}/batch_id={b}" for b in batches]
    return spark.read.schema(schema).option("basePath", out_path).parquet(*folders)


def months_written(spark: SparkSession, out_path: str, schema: T.StructType, batch_id: int) -> dict[int, set]:
    """The months in the totals of each batch before ``batch_id`` (written by an earlier run)."""
    names = [n for n in _names_in(spark, out_path) if n.startswith("batch_id=")]
    before = [int(n.removeprefix("batch_id=")) for n in names]
    months: dict[int, set] = {b: set() for b in before if b < batch_id}
    if months:
        held = _totals_of(spark, out_path, schema, [*months]).select("batch_id", "registration_month").distinct()
        for b, month in held.collect():
            months[b].add(month)
    return months


def count_on(delta: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """The new totals of the keys in ``delta``: what it adds to each key's newest earlier total."""
    parts = delta.withColumnRenamed("new_entities", "added").unionByName(
        earlier.select(*keys, "batch_id", F.col("new_entities").alias("total")), allowMissingColumns=True)
    merged = parts.groupBy(*keys).agg(F.sum("added").alias("added"), F.max_by("total", "batch_id").alias("before"))
    total = F.col("added") + F.coalesce("before", F.lit(0))
    return merged.filter(F.col("added").isNotNull()).select(*keys, total.cast("long").alias("new_entities"))


def stream_rollup(spark: SparkSession, source_path: str, schema: T.StructType, name: str,
                  out_path: str, checkpoint: str, max_files_per_trigger: int = 16,
                  mode: str = "update") -> DataFrame:
    """ST1..ST4: run the stream to the end of the available files; return the rollup."""
    src, keys = _source(spark, source_path, schema, max_files_per_trigger), ROLLUP_KEYS[name]
    months: dict[int, set] = {}  # of each batch: a batch reads only those that share one of its own

    def sink(batch: DataFrame, batch_id: int) -> None:
        to = out_path if mode == "complete" else f"{out_path}/batch_id={batch_id}"
        batch.select(*keys, "new_entities").write.mode("overwrite").parquet(to)

    def append(batch: DataFrame, batch_id: int) -> None:
        session, delta = batch.sparkSession, rollup(batch, name)
        if batch_id > 0 and not months:
            months.update(months_written(session, out_path, delta.schema, batch_id))
        own = {r[0] for r in batch.select("registration_month").distinct().collect()}
        totals = delta
        if shared := sorted(b for b, held in months.items() if held & own):
            month = F.col("registration_month")
            earlier = _totals_of(session, out_path, delta.schema, shared).filter(
                month.isin([m for m in own if m is not None]) | (month.isNull() if None in own else F.lit(False)))
            totals = count_on(delta, earlier, keys)
        totals.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        months[batch_id] = own

    # a checkpoint that was begun with a state store (update mode had one too) goes on with it
    if mode == "complete" or "state" in _names_in(spark, checkpoint):
        stream = rollup(src, name).writeStream.outputMode(mode).foreachBatch(sink)
    else:
        stream = src.select(*keys).writeStream.foreachBatch(append)
    q = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    written = spark.read.parquet(out_path)
    return written.select(*keys, "new_entities") if mode == "complete" else newest_totals(written, keys)


def stream_rollup_deltas(spark: SparkSession, source_path: str, schema: T.StructType, name: str,
                         out_root: str, checkpoint: str, max_files_per_trigger: int = 16) -> DataFrame:
    """ST5: per-batch partial rollups, merged on read; returns the merged rollup."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        rollup(batch, name).write.mode("overwrite").parquet(f"{out_root}/batch_id={batch_id}")

    q = (
        _source(spark, source_path, schema, max_files_per_trigger).writeStream
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return sum_rollups(spark.read.parquet(out_root), name)


def stream_counts(spark: SparkSession, source_dir: str, file_glob: str, schema: T.StructType, keys,
                  out_path: str, checkpoint: str, max_files_per_trigger: int = 16) -> DataFrame:
    """The same upkeep for any keyed count: a file stream over ``source_dir``
    (files matching ``file_glob``), ``keys`` given as named Columns, complete
    mode written idempotently per micro-batch."""
    src = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    agg = src.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (agg.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_path)
