"""The warehouse views every analytics query reads, derived from the driver tables.

``raw_fact``      S1 -> P10 + P6 + P7 (what the loader inserts)
``enriched_fact`` raw LEFT JOIN latest postal geo (J1 + P8 + P9)

Both are lazy DataFrames: Catalyst prunes the columns and pushes the
filters each query needs down to the ``lineitem`` scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.functions.cleaning import normalize_na, normalize_ssic
from bizlens.operators.clean import clean_for_load, clean_record
from bizlens.operators.enrich import enrich_geo
from bizlens.operators.name_index import NameIndex, write_name_index
from bizlens.operators.windows import Rollups
from bizlens.sources import tpch


def raw_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_for_load(tpch.registry_extract(spark, sf_dir))


def clean_extract(spark: SparkSession, sf_dir: str, with_order: bool = False) -> DataFrame:
    carry = ("_ord",) if with_order else ()
    return clean_record(tpch.registry_extract(spark, sf_dir, with_order=with_order), carry=carry)


def enriched_fact(spark: SparkSession, sf_dir: str, drop_undated: bool = False) -> DataFrame:
    return enrich_geo(raw_fact(spark, sf_dir), tpch.postal_geo(spark, sf_dir), drop_undated=drop_undated,
                      codes_cleaned=True)


def ssic_dim(spark: SparkSession, sf_dir: str, pad_codes: bool = True) -> DataFrame:
    """S4 applied to the part table: NA-normalised; codes padded unless ``pad_codes=False``."""
    d = tpch.dim_ssic(spark, sf_dir)
    code = normalize_ssic("ssic_code") if pad_codes else normalize_na("ssic_code")
    return d.select(
        code.alias("ssic_code"),
        normalize_na("ssic_description").alias("ssic_description"),
        normalize_na("section").alias("section"),
        normalize_na("division").alias("division"),
    )


def subzone_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpch.dim_subzone(spark, sf_dir)


# ------------------------------------------------------------------ S7 ---

_BUILT: dict[tuple, str] = {}

SORT_WITHIN = ["registration_month", "primary_ssic_norm", "subzone_id", "uen"]


def write_fact(df: DataFrame, path: str) -> None:
    """Month-partitioned Parquet, clustered within files.

    A ``rebalance`` on the month sends each month to few tasks (no
    small-file explosion: a task writes one month folder), and AQE splits a
    month that holds a third of the rows into advisory-sized tasks and packs
    small months together -- without the extra sampling pass a range
    partitioning would make over the whole cleaning pipeline.
    """
    (
        df.hint("rebalance", "registration_month")
        .sortWithinPartitions(*SORT_WITHIN)
        .write.mode("overwrite")
        # Point lookups (entity detail, UEN questions) push `uen = ...` to the
        # scan; a bloom filter lets it skip row groups the min/max cannot.
        .option("parquet.bloom.filter.enabled#uen", "true")
        .option("compression", "zstd")
        .partitionBy("registration_month")
        .parquet(path)
    )


def _source_signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Application, folder, and every source file's name, length and time."""
    sig = [spark.sparkContext.applicationId, sf_dir]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in ("lineitem", "supplier", "nation", "region"):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = p.getFileSystem(conf)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            sig.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sig)


def warehouse_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched fact as a table: built once per session and source state
    (T2's last step, written to the shared checkpoint folder), then read with
    partition pruning on ``registration_month`` and Parquet filter pushdown.
    """
    from bizlens.session import shared_dir

    key = _source_signature(spark, sf_dir)
    path = _BUILT.get(key)
    if path is None:
        path = shared_dir(spark, "warehouse-enriched")
        write_fact(enriched_fact(spark, sf_dir), path)
        _BUILT[key] = path
    from bizlens.schema import ENRICHED_COLUMNS

    return spark.read.parquet(path).select(*ENRICHED_COLUMNS)


def warehouse_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the materialised enriched fact (built on first use)."""
    warehouse_fact(spark, sf_dir)
    return _BUILT[_source_signature(spark, sf_dir)]


_INDEXED: dict[str, str] = {}


def name_index(spark: SparkSession, sf_dir: str) -> NameIndex:
    """The name index of the materialised fact (written on first use)."""
    from bizlens.session import shared_dir

    fact, path = warehouse_fact(spark, sf_dir), warehouse_path(spark, sf_dir)
    if path not in _INDEXED:
        _INDEXED[path] = shared_dir(spark, "name-index")
        write_name_index(fact, _INDEXED[path])
    return NameIndex(spark, _INDEXED[path], fact)


_ROLLED: dict[str, str] = {}


def rollups(spark: SparkSession, sf_dir: str) -> Rollups:
    """R1-R4 of the materialised fact (written on first use)."""
    from bizlens.session import shared_dir

    fact, path = warehouse_fact(spark, sf_dir), warehouse_path(spark, sf_dir)
    if path not in _ROLLED:
        root = shared_dir(spark, "rollups")
        Rollups(spark, root).write(fact)
        _ROLLED[path] = root
    return Rollups(spark, _ROLLED[path])


def enriched_schema(spark: SparkSession, sf_dir: str):
    return spark.read.parquet(warehouse_path(spark, sf_dir)).schema


def rebuild_partitions(df: DataFrame, path: str, months: list[int] | None = None) -> None:
    """Replace only the given month folders of a written fact (dynamic
    partition overwrite, one distributed write); ``months=None`` rewrites the
    whole table. Months not listed keep their files untouched."""
    if months is None:
        write_fact(df, path)
        return
    (
        df.filter(F.col("registration_month").isin([int(m) for m in months]))
        .hint("rebalance", "registration_month")
        .sortWithinPartitions(*SORT_WITHIN)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("registration_month")
        .parquet(path)
    )
