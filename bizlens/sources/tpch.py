"""Registry-shaped inputs derived from the driver's TPC-H-like tables.

The operators take column names, so the same code runs on the registry
schema and on these derived frames. Mapping (one entity row per lineitem):

  uen                    l_orderkey padded to 8 digits + 'K' (UEN shape; duplicated
                         keys exercise keep-latest dedup)
  entity_name            'ORDER <orderkey> LINE <linenumber>', on lines 1 to 5 with quotes, a comma,
                         a closing backslash, a line break, padding
  status / type          l_linestatus / l_returnflag (status padded with a space)
  constitution           ' Sole Proprietor ' when l_quantity > 25 else 'NA'
  company type           'Exempt Private' when l_discount > 0.05 else ''
  registration date      l_shipdate as ISO text, compact yyyyMMdd on even lines
  uen issue date         l_shipdate as datetime text with +08:00 offset
  primary / secondary    l_partkey / l_suppkey as unpadded text
  postal code            'S' || l_suppkey (cleaning strips the letter and pads)
  dim_postal_geo         supplier (s_acctbal >= 0) x nation x region
  dim_subzone            nation (id = n_name, area = r_name, square polygon text)
  dim_planning_area      region
  dim_ssic               part (code = lpad(p_partkey, 5), description = p_name)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEO_VERSION_TS = "2024-01-01 00:00:00"

# Columns that fix the "first seen" order of lineitem rows within one key
# (unique per key at sf0.01 and up; any remaining tie is settled by the
# row's own values, which follow the rank in the keep-latest comparison).
LINEITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uen_of(key) -> "F.Column":
    """Business-style UEN text for a numeric key: 8+ digits and a letter."""
    k = key.cast("string")
    return F.concat(F.when(F.length(k) < 8, F.lpad(k, 8, "0")).otherwise(k), F.lit("K"))


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work at least one partition per core.

    A small input stored as a few row groups scans as a few tasks; then the
    cleaning regexes would run on a few cores. Only in that case is the input
    redistributed, by a hash of the whole row (uniform, deterministic on
    retry, and without the local sort a round-robin repartition needs); a
    large input already has more splits than cores and is left alone."""
    try:
        want = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= want:
            return df
    except Exception:  # noqa: BLE001 - no RDD view of the plan (e.g. Spark Connect)
        return df
    return df.repartition(want, F.xxhash64(*[F.col(c) for c in df.columns]))


def _entity_name(order, line) -> "F.Column":
    """Names with what real company names hold: quotes, commas, a closing
    backslash, a line break, padding (by line number)."""
    number = line.cast("string")
    return (
        F.when(line == 1, F.concat(F.lit('ORDER "'), order, F.lit('" LINE '), number))
        .when(line == 2, F.concat(F.lit("ORDER "), order, F.lit(", LINE "), number))
        .when(line == 3, F.concat(F.lit("ORDER "), order, F.lit(" LINE "), number, F.lit("\\")))
        .when(line == 4, F.concat(F.lit("ORDER "), order, F.lit("\nLINE "), number))
        .when(line == 5, F.concat(F.lit("  ORDER "), order, F.lit(" LINE "), number, F.lit(" ")))
        .otherwise(F.concat(F.lit("ORDER "), order, F.lit(" LINE "), number))
    )


def registry_extract(spark: SparkSession, sf_dir: str, with_order: bool = False) -> DataFrame:
    """Raw text rows as a registry CSV extract would deliver them."""
    li = spread(table(spark, sf_dir, "lineitem"))
    ship = F.col("l_shipdate")
    cols = [
        uen_of(F.col("l_orderkey")).alias("uen"),
        _entity_name(F.col("l_orderkey").cast("string"), F.col("l_linenumber")).alias("entity_name"),
        F.concat(F.lit(" "), F.col("l_linestatus")).alias("entity_status_description"),
        F.col("l_returnflag").alias("entity_type_description"),
        F.when(F.col("l_quantity") > 25, F.lit(" Sole Proprietor "))
        .otherwise(F.lit("NA"))
        .alias("business_constitution_description"),
        F.when(F.col("l_discount") > 0.05, F.lit("Exempt Private"))
        .otherwise(F.lit(""))
        .alias("company_type_description"),
        F.when(F.col("l_linenumber") % 2 == 0, F.date_format(ship, "yyyyMMdd"))
        .otherwise(F.date_format(ship, "yyyy-MM-dd"))
        .alias("registration_incorporation_date"),
        F.concat(F.date_format(ship, "yyyy-MM-dd"), F.lit("T00:00:00+08:00")).alias("uen_issue_date"),
        F.col("l_partkey").cast("string").alias("primary_ssic_code"),
        F.col("l_suppkey").cast("string").alias("secondary_ssic_code"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("postal_code"),
    ]
    if with_order:
        cols.append(F.struct(*[F.col(c) for c in LINEITEM_ORDER]).alias("_ord"))
    return li.select(*cols)


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name")


def nation_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region (both tiny, fixed-size dims)."""
    n = table(spark, sf_dir, "nation")
    r = region_names(spark, sf_dir)
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_name", "n_regionkey", "r_name"
    )


def postal_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dim_postal_geo: one version per supplier in good standing."""
    s = table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 0)
    na = nation_areas(spark, sf_dir)
    j = s.join(F.broadcast(na), s.s_nationkey == na.n_nationkey)
    return j.select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("postal_code"),
        (F.col("s_acctbal") / 1000.0).alias("latitude"),
        F.col("s_nationkey").cast("double").alias("longitude"),
        F.col("n_name").alias("subzone_id"),
        F.col("r_name").alias("planning_area_id"),
        F.to_timestamp(F.lit(GEO_VERSION_TS)).alias("updated_at"),
    )


def square_geojson(x0, y0, size) -> "F.Column":
    """GeoJSON text of an axis-aligned square with lower-left corner (x0, y0)."""
    x1 = x0 + size
    y1 = y0 + size

    def pt(x, y):
        return F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))

    ring = F.concat_ws(",", pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))


def dim_subzone(spark: SparkSession, sf_dir: str) -> DataFrame:
    na = nation_areas(spark, sf_dir)
    k = F.col("n_nationkey")
    return na.select(
        F.col("n_name").alias("subzone_id"),
        F.initcap(F.col("n_name")).alias("name"),
        F.col("r_name").alias("planning_area_id"),
        square_geojson(k, F.col("n_regionkey"), F.lit(1)).alias("geometry"),
    )


def dim_planning_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = region_names(spark, sf_dir)
    k = F.col("r_regionkey")
    return r.select(
        F.col("r_name").alias("planning_area_id"),
        F.initcap(F.col("r_name")).alias("name"),
        square_geojson(k * 5, F.lit(0), F.lit(5)).alias("geometry"),
    )


def dim_ssic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("ssic_code"),
        F.col("p_name").alias("ssic_description"),
        F.col("p_type").alias("section"),
        F.col("p_brand").alias("division"),
    )


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates per postal code from the embeddings table (the 'geocoder').

    x = embedding[0] (longitude), y = embedding[1] (latitude), keyed by
    vec_id = supplier key.
    """
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("postal_code"),
        F.col("embedding")[1].cast("double").alias("latitude"),
        F.col("embedding")[0].cast("double").alias("longitude"),
    )



def search_terms(spark: SparkSession, sf_dir: str, col: str = "query") -> DataFrame:
    """Free-text inputs for category search: every distinct word of a part
    name, every whole part name and every part size (digits)."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias(col))
    names = p.select(F.col("p_name").alias(col))
    sizes = p.select(F.col("p_size").cast("string").alias(col))
    return words.unionByName(names).unionByName(sizes).distinct()


AS_OF = "2001-11-04"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question): plain-language questions built from the data.

    * per region: ranking, trend, hotspot, comparison (with the next region)
      and change questions naming the region;
    * per nation: code-filtered trend and top-industry questions;
    * per order: a UEN lookup ("Show uen 00004242K details");
    * every user turn of ``conversations``, whole text.
    """
    r = region_names(spark, sf_dir)
    nxt = r.select((F.col("r_regionkey") - 1).alias("prev_key"), F.col("r_name").alias("next_name"))
    r2 = r.join(F.broadcast(nxt), r.r_regionkey == nxt.prev_key, "left")
    name = F.col("r_name")
    rk = F.col("r_regionkey").cast("string")

    def templates(prefix, key, texts):
        """One row per (entity, template) through a single explode."""
        items = [
            F.struct(F.concat(F.lit(prefix), key, F.lit(f":{i}")).alias("question_id"), t.alias("question"))
            for i, t in enumerate(texts, start=1)
        ]
        return F.inline(F.array(*items))

    region_qs = r2.select(templates("region:", rk, [
        F.concat(F.lit("Top SSICs in "), name, F.lit(" last 12 months")),
        F.concat(F.lit("Trend of new entities in "), name, F.lit(" since 1998")),
        F.concat(F.lit("Where are ssic 00"), rk, F.lit(" companies hottest in 2000")),
        F.concat(F.lit("Compare "), name, F.lit(" vs "), F.coalesce(F.col("next_name"), F.lit("AFRICA")),
                 F.lit(" for new F&B entities")),
        F.concat(F.lit("Why the spike in "), name, F.lit(" 2000 to 1998")),
        F.concat(F.lit("Show uen details for "), name),
        F.concat(F.lit("compare * vs "), name, F.lit(" last 3650 days")),
        F.concat(F.lit("compare "), name, F.lit(" vs "), name, F.lit(" from 1970 to 2000")),
    ]))
    n = table(spark, sf_dir, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    nk = F.col("n_nationkey").cast("string")
    nation_qs = n.select(templates("nation:", nk, [
        F.concat(F.lit("New entities with ssic 0"), nk, F.lit(" in "), name, F.lit(" last 6 months")),
        F.concat(F.lit("Top industries for "), name, F.lit(" 1999 and 2001")),
        F.concat(F.lit("compare "), name, F.lit(" vs "), F.col("n_name"), F.lit(" last 3 months")),
    ]))
    o = table(spark, sf_dir, "orders")
    order_qs = o.select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("question_id"),
        F.concat(F.lit("Show uen "), F.lower(uen_of(F.col("o_orderkey"))), F.lit(" details")),
    )
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    conv_qs = c.select(
        F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
        .alias("question_id"),
        F.col("text"),
    )
    out = None
    for part in [region_qs, nation_qs, order_qs, conv_qs]:
        part = part.toDF("question_id", "question")
        out = part if out is None else out.unionByName(part)
    return out
