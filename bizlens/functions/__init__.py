from bizlens.functions.cleaning import (
    normalize_date,
    normalize_na,
    normalize_postal,
    normalize_ssic,
    ssic_norm,
    strip_ws,
    yyyymm,
)

__all__ = [
    "normalize_date",
    "normalize_na",
    "normalize_postal",
    "normalize_ssic",
    "ssic_norm",
    "strip_ws",
    "yyyymm",
]
