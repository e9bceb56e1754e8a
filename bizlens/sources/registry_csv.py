"""S1 registry CSV extracts, S4 industry-code CSV, S6 clean-table writer.

S1 reads every ``*.csv`` under a folder (its subfolders included, in path order) as
text columns bound **by name**: files are grouped by their header line, each group
is one multi-file ``spark.read.csv`` (positional binding is right inside a
group), and the groups are combined with ``unionByName(allowMissingColumns)``.
A single multi-path read would bind every file by the first file's column
positions.

Each row carries ``source_file`` and ``_ord`` = (file path, split start,
row id within the split), which orders rows as they appear in the files, so
"first seen" is well defined without a shuffle. Lines with too few or too
many fields are kept (missing fields NULL, extras ignored -- as a dict
reader does) and also reported in ``_corrupt``; with ``stop_at_first_error``
a file's rows after its first such line are dropped instead.
"""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.cleaning import normalize_na, normalize_ssic
from bizlens.sources.split_csv import read_records

CORRUPT = "_corrupt"

# The standard dialect, reading and writing: quotes inside a quoted field are
# doubled, a backslash is an ordinary character, padding belongs to the field.
DIALECT = {
    "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
PARSING = {
    **DIALECT, "encoding": "UTF-8", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
}
WRITE_DIALECT = {**DIALECT, "header": "true", "emptyValue": "", "nullValue": ""}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, root: str, suffix: str = ".csv") -> list[tuple[str, int]]:
    """Path and bytes of all files under ``root`` ending in ``suffix``, by path (metadata only)."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        st = it.next()
        name = st.getPath().toString()
        base = st.getPath().getName()
        if name.endswith(suffix) and not base.startswith((".", "_")):
            out.append((name, st.getLen()))
    return sorted(out)


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The header line of a CSV file (first line only; BOM removed)."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        line = reader.readLine() or ""
    finally:
        reader.close()
    line = line.lstrip("\ufeff")
    return tuple(next(csv.reader(io.StringIO(line)), []))


def _column_names(header: tuple[str, ...]) -> list[str]:
    """Names to read a header's columns by: of a repeated one the last column counts."""
    return [
        name if name not in header[k + 1 :] else f"_repeated_{k}" for k, name in enumerate(header)
    ]


def _order(path: Column, block: Column, row: Column) -> Column:
    return F.struct(path.alias("f"), block.alias("b"), row.alias("r")).alias("_ord")


def _read_whole(spark: SparkSession, paths: list[str], schema: T.StructType, multi_line: bool) -> DataFrame:
    """Files that one task each reads."""
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).options(header=True, multiLine=multi_line, **PARSING).csv(paths)
    order = _order(path, F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select(*[F.col(f"`{c}`") for c in schema.names], path.alias("source_file"), order)


def _read_split(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Files that many tasks each read."""
    records = read_records(spark, paths).where(F.col("text") != "")
    parsed = F.from_csv("text", schema.simpleString(), {**PARSING, "multiLine": "true"})
    rows = records.select(parsed.alias("_row"), "source_file", _order(F.col("source_file"), F.col("b"), F.col("r")))
    return rows.select(*[F.col(f"_row.`{c}`") for c in schema.names], "source_file", "_ord")


def read_registry_csv(spark: SparkSession, root: str, multi_line: bool = True,
                      stop_at_first_error: bool = False, split_above: int | None = None) -> DataFrame:
    """Union by name of every CSV under ``root`` with source_file and _ord.

    Quoted fields may hold line breaks. A file of more than ``split_above`` bytes (by
    default what Spark puts into one task) is read by many tasks, see ``split_csv``; a
    smaller one is parsed by one task. ``multi_line=False`` leaves out the scan for
    open quotes, for extracts known to have no line break inside a field.
    """
    files = list_files(spark, root)
    if not files:
        raise FileNotFoundError(f"No CSV files found in {root}")
    if split_above is None:
        split_above = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get("spark.sql.files.maxPartitionBytes")))
    # First line of each file only; concurrent, since object stores have
    # high per-request latency and there may be thousands of files.
    with ThreadPoolExecutor(max_workers=min(32, len(files))) as pool:
        headers = list(pool.map(lambda f: read_header(spark, f[0]), files))
    groups: dict[tuple, list[str]] = {}
    for (path, size), header in zip(files, headers):
        groups.setdefault((header, multi_line and size > split_above), []).append(path)
    frames = []
    for (header, large), paths in groups.items():
        names = _column_names(header)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
        df = _read_split(spark, paths, schema) if large else _read_whole(spark, paths, schema, multi_line)
        # The parser prunes columns, and a line is only checked against the
        # columns a query reads; Spark also refuses scans whose only data
        # column is the corrupt-record one. So the exposed copy references
        # every data column (the added branch is never taken).
        every = F.concat_ws("", *[F.col(f"`{c}`") for c in names]) if names else F.lit("")
        corrupt = F.coalesce(F.col(CORRUPT), F.when(F.length(every) < 0, every))
        wanted = [F.col(f"`{c}`") for c, name in zip(names, header) if c == name]
        frames.append(df.select(*wanted, corrupt.alias(CORRUPT), "source_file", "_ord"))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    if stop_at_first_error:
        first_bad = (
            out.filter(F.col(CORRUPT).isNotNull())
            .groupBy(F.col("source_file").alias("_bad_file"))
            .agg(F.min("_ord").alias("_bad_ord"))
        )
        # One row per file with an error: bounded by the file count.
        out = out.join(F.broadcast(first_bad), out.source_file == first_bad._bad_file, "left").filter(
            F.col("_bad_ord").isNull() | (F.col("_ord") < F.col("_bad_ord"))
        ).drop("_bad_file", "_bad_ord")
    return out


def read_ssic_csv(spark: SparkSession, path: str, pad_codes: bool = True) -> DataFrame:
    """Industry codes; each field from its lower-case header, else UPPER-case;
    NA-normalised. Codes are padded like the fact's codes unless ``pad_codes=False``."""
    raw = spark.read.option("header", True).options(**DIALECT).option("multiLine", True).csv(path)
    cols = set(raw.columns)

    def field(name):
        opts = [normalize_na(F.col(n)) for n in (name, name.upper()) if n in cols]
        return F.coalesce(*opts) if opts else F.lit(None).cast("string")

    code = field("ssic_code")
    return raw.select(
        (normalize_ssic(code) if pad_codes else code).alias("ssic_code"),
        field("ssic_description").alias("ssic_description"),
        field("section").alias("section"),
        field("division").alias("division"),
    )


def write_clean(df: DataFrame, path: str) -> None:
    """The clean table as Parquet (path ending .parquet) or CSV with a header
    (NULL -> empty field, fields quoted only where they must be)."""
    w = df.write.mode("overwrite")
    if path.lower().rstrip("/").endswith(".parquet"):
        w.parquet(path)
    else:
        w.options(**WRITE_DIALECT).csv(path)
