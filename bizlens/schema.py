"""Column contract and table schemas (explicit; never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# The 11 contract columns, in contract order.
KEEP_COLUMNS = [
    "uen",
    "entity_name",
    "entity_status_description",
    "entity_type_description",
    "business_constitution_description",
    "company_type_description",
    "registration_incorporation_date",
    "uen_issue_date",
    "primary_ssic_code",
    "secondary_ssic_code",
    "postal_code",
]

# Columns that are non-nullable in the warehouse ('' instead of NULL).
NON_NULLABLE_COLUMNS = [
    "uen",
    "entity_name",
    "entity_status_description",
    "entity_type_description",
    "business_constitution_description",
]

DATE_COLUMNS = ["registration_incorporation_date", "uen_issue_date"]
SSIC_COLUMNS = ["primary_ssic_code", "secondary_ssic_code"]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in KEEP_COLUMNS])

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField(c, T.DateType() if c in DATE_COLUMNS else T.StringType(), True)
        for c in KEEP_COLUMNS
    ]
)

# Enriched fact: raw + 2 normalised codes + month + geo (18 columns).
ENRICHED_COLUMNS = KEEP_COLUMNS[:10] + [
    "primary_ssic_norm",
    "secondary_ssic_norm",
    "postal_code",
    "registration_month",
    "latitude",
    "longitude",
    "subzone_id",
    "planning_area_id",
]

POSTAL_GEO_SCHEMA = T.StructType(
    [
        T.StructField("postal_code", T.StringType(), False),
        T.StructField("latitude", T.DoubleType(), True),
        T.StructField("longitude", T.DoubleType(), True),
        T.StructField("subzone_id", T.StringType(), True),
        T.StructField("planning_area_id", T.StringType(), True),
        T.StructField("updated_at", T.TimestampType(), True),
    ]
)

# Columns returned by the entity detail / lookup (17).
DETAIL_COLUMNS = [
    "uen",
    "entity_name",
    "entity_status_description",
    "entity_type_description",
    "business_constitution_description",
    "company_type_description",
    "registration_incorporation_date",
    "uen_issue_date",
    "primary_ssic_code",
    "secondary_ssic_code",
    "primary_ssic_norm",
    "secondary_ssic_norm",
    "postal_code",
    "planning_area_id",
    "subzone_id",
    "latitude",
    "longitude",
]

# Columns returned by search (13).
SEARCH_COLUMNS = [
    "uen",
    "entity_name",
    "entity_status_description",
    "entity_type_description",
    "business_constitution_description",
    "company_type_description",
    "registration_incorporation_date",
    "uen_issue_date",
    "primary_ssic_code",
    "secondary_ssic_code",
    "postal_code",
    "planning_area_id",
    "subzone_id",
]
