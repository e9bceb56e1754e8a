"""Record cleaning (P1, P6, P7, P10, P11): one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.cleaning import (
    date_from_na,
    na_from_stripped,
    postal_digits,
    postal_from_digits,
    ssic_from_na,
    strip_ws,
)
from bizlens.schema import DATE_COLUMNS, KEEP_COLUMNS, NON_NULLABLE_COLUMNS, SSIC_COLUMNS


def keep_columns(df: DataFrame, columns=KEEP_COLUMNS, carry=()) -> DataFrame:
    """Project the contract columns; missing ones become NULL, extras are dropped.

    ``carry`` names bookkeeping columns (e.g. source file, row order) to keep.
    """
    present = set(df.columns)
    cols = [
        F.col(c).cast("string").alias(c) if c in present else F.lit(None).cast("string").alias(c)
        for c in columns
    ]
    return df.select(*cols, *[F.col(c) for c in carry if c in present])


def clean_record(df: DataFrame, carry=()) -> DataFrame:
    """P10: contract projection with per-column normalisation (P2..P5).

    Staged projections (strip -> NA -> digits -> final) so every regex is
    evaluated once per value; Catalyst keeps the stages apart because they
    reference non-trivial expressions more than once.
    """
    df = keep_columns(df, carry=carry)
    keep = [F.col(c) for c in carry]
    s1 = df.select(*[strip_ws(c).alias(c) for c in KEEP_COLUMNS], *keep)
    s2 = s1.select(*[na_from_stripped(c).alias(c) for c in KEEP_COLUMNS], *keep)
    s3 = s2.select(
        *[(postal_digits(c) if c == "postal_code" else F.col(c)).alias(c) for c in KEEP_COLUMNS], *keep
    )
    out = []
    for c in KEEP_COLUMNS:
        if c == "postal_code":
            e = postal_from_digits(c)
        elif c in SSIC_COLUMNS:
            e = ssic_from_na(c)
        elif c in DATE_COLUMNS:
            e = date_from_na(c)
        else:
            e = F.col(c)
        out.append(e.alias(c))
    return s3.select(*out, *keep)


def not_null_default(df: DataFrame, columns=NON_NULLABLE_COLUMNS) -> DataFrame:
    """NULL -> '' on the warehouse's non-nullable text columns."""
    return df.na.fill("", subset=[c for c in columns if c in df.columns])


def drop_missing_key(df: DataFrame, key: str = "uen") -> DataFrame:
    """Rows without a key are dropped."""
    return df.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def clean_for_load(df: DataFrame, carry=()) -> DataFrame:
    """Loader variant of P10: clean, drop keyless rows, fill non-nullables."""
    return not_null_default(drop_missing_key(clean_record(df, carry=carry)))


def rename_output(df: DataFrame, names) -> DataFrame:
    """Positional rename of a result (e.g. cnt -> count)."""
    return df.toDF(*names)
