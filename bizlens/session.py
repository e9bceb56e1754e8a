"""Session construction and the shared scratch folder.

Jobs that cut lineage (round-trip writes, streaming checkpoints) write under
the folder the cluster names in ``spark.checkpoint.dir``. Only when the
session has none (local tests) do we pick one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every bizlens job wants; anything already set on the session wins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Fall back from whole-stage codegen for any stage whose generated method
    # exceeds HotSpot's JIT limit (8000 bytes); such methods would otherwise
    # run interpreted (the wide cleaning projections hit this).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Suggested settings for the ~100 TB, ~1000-executor target (pass as
# ``get_session(extra=SCALE_CONF)`` or through the cluster's defaults):
# * 100 TB / 256 MB splits ~ 400k scan tasks; shuffles start wide (AQE then
#   coalesces small partitions to the advisory size, so small queries do not
#   pay for the width) and a skewed partition is split once it exceeds 5x the
#   median and 1 GB;
# * broadcasts stay capped by our own size check (64 MB) and Spark's.
SCALE_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Runtime SQL settings applied to a caller's session when still at Spark's default.
# A task sorts or aggregates a whole (coalesced) shuffle partition: 64 MB of compressed
# narrow rows are some millions of rows, so Spark's default would let a task's memory
# grow with the table up to gigabytes.
RUNTIME_TUNING = {
    "spark.sql.codegen.hugeMethodLimit": ("65535", "8000"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("64MB", "16MB"),
}


def tune(spark: SparkSession) -> None:
    """Apply RUNTIME_TUNING to a session that still has Spark's defaults."""
    for key, (default, value) in RUNTIME_TUNING.items():
        try:
            if spark.conf.get(key, default) == default:
                spark.conf.set(key, value)
        except Exception:  # noqa: BLE001 - a locked conf keeps its value
            pass


def get_session(
    app: str = "bizlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the whole cluster.
        conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's files to the executors once, for steps that run Python there
    (the archive is code, no data; Spark's own file server distributes it)."""
    sc = spark.sparkContext
    if getattr(sc, "_bizlens_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="bizlens-code-"), "bizlens_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith((".py", ".json", ".geojson")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._bizlens_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only if unset."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # unset
            root = None
    if not root:
        root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        # A folder of our own only does where driver and executors are one machine.
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="bizlens-ckpt-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, uniquely named folder under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/bizlens/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder and continue from the
    written copy (reliable checkpoint: survives executor loss, truncates the
    plan so later stages do not re-plan or recompute it)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
