"""Cleaning expressions for the registry contract (all ``Column -> Column``).

Every function is built from Spark SQL built-ins so it stays inside
whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The common ISO forms: a date, optionally 'T' or ' ' + HH:MM[:SS[.ffffff]] and
# Z or +-HH:MM. The general forms below are only tried on other texts.
_FAST_ISO = (r"^(\d{4}-\d{2}-\d{2}|\d{8})([T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?"
             r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d)?)?$")
_DATE_PART = r"^(\d{4}-\d{2}-\d{2}|\d{8})"


def _time_of_day(fraction: str, end: str = "") -> str:
    """HH, HH:MM, HH:MM:SS, HHMM or HHMMSS, each with a fraction or ``end``."""
    f, mm = f"({fraction}|{end})", r"[0-5]\d"
    return rf"([01]\d|2[0-3])({f}|:{mm}({f}|:{mm}{f})|{mm}({f}|{mm}{f}))"


# What Python's datetime.fromisoformat takes as a time. In front of an offset it
# overlooks an empty fraction and one character behind a complete field.
_TIME = _time_of_day(r"[.,]\d+")
_GENERAL_TIME = (rf"^(?s:{_TIME}|" + _time_of_day(r"[.,](\d{0,5}|\d{6,}[^\d]?)", r"[^\d]?")
                 + rf"(Z|[+-]{_TIME}))$")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's str.isspace() accepts (Unicode
# White_Space plus U+001C..U+001F), i.e. what str.strip() removes.
WHITESPACE = (
    ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", "\u1680"]
    + [chr(c) for c in range(0x2000, 0x200B)]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
)


def _python_digit_class() -> str:
    """Regex class body of every character Python's str.isdigit() accepts,
    derived from Python itself (as code point ranges)."""
    cps = [c for c in range(0x110000) if chr(c).isdigit()]
    ranges, start, prev = [], cps[0], cps[0]
    for c in cps[1:] + [None]:
        if c is not None and c == prev + 1:
            prev = c
            continue
        ranges.append(f"\\x{{{start:X}}}" + (f"-\\x{{{prev:X}}}" if prev != start else ""))
        if c is not None:
            start = prev = c
    return "".join(ranges)


DIGITS = _python_digit_class()
_ASCII = r"^[\x00-\x7F]*$"


def _bare(c) -> Column:
    """Whether a text begins and ends with a visible ASCII character."""
    return F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")


def strip_ws(c) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip``). Trimming a set
    of characters costs far more than a look at both ends, which settles most values."""
    c = _c(c)
    spaces = F.trim(c)
    return F.when(_bare(c), c).when(_bare(spaces), spaces).otherwise(F.trim(c, F.lit("".join(WHITESPACE))))


def na_from_stripped(t) -> Column:
    """P2 second half: an already-stripped value; '' or 'na' (any case) -> NULL."""
    t = _c(t)
    missing = (F.length(t) <= 2) & F.lower(t).isin("", "na")
    return F.when(missing, F.lit(None).cast("string")).otherwise(t)


def postal_digits(t) -> Column:
    """P3 first half: keep the characters Python's isdigit() accepts."""
    t = _c(t)
    plain = t.rlike(_ASCII)  # one small character class for nearly all values
    return F.when(plain, F.regexp_replace(t, "[^0-9]", "")).otherwise(F.regexp_replace(t, f"[^{DIGITS}]", ""))


def postal_from_digits(d) -> Column:
    """P3 second half: left-pad to 6; none or more than 6 digits -> NULL.
    (lpad truncates longer input, so only pad when length <= 6.)"""
    d = _c(d)
    n = F.length(d)
    return F.when((n > 0) & (n <= 6), F.lpad(d, 6, "0"))


def ssic_from_na(t) -> Column:
    """P4 on an NA-normalised value (all characters isdigit() -> pad to 5)."""
    t = _c(t)
    # the large character class only for texts beyond ASCII
    digits = t.rlike("^[0-9]+$") | (~t.rlike(_ASCII) & t.rlike(f"^[{DIGITS}]+$"))
    return F.when((F.length(t) < 5) & digits, F.lpad(t, 5, "0")).otherwise(t)


def _general_iso_date(t) -> Column:
    """P5 on the rarer forms: ISO week dates, any separator, lenient times."""
    n = F.length(t)
    at = lambda i: F.substring(t, i + 1, 1)
    digits = lambda i: F.length(F.regexp_extract(F.substr(t, F.lit(i + 1)), "^[0-9]*", 0))
    basic_week = digits(7) + 7
    # where the date part ends
    end = (
        F.when(n == 7, 7)
        .when((at(4) == "-") & (at(5) != "W"), 10)
        .when(at(4) == "-", F.when((n > 8) & (at(8) == "-"),
                                   F.when(n == 9, 0).when((n > 10) & at(10).rlike("[0-9]"), 8).otherwise(10))
              .otherwise(8))
        .when(at(4) == "W", F.when(basic_week < 9, basic_week).when(basic_week % 2 == 0, 7).otherwise(8))
        .otherwise(8)
    )
    day, time = F.substr(t, F.lit(1), end), F.substr(t, end + 2)
    timed = (n <= end) | time.rlike(_GENERAL_TIME)
    compact = F.replace(day, F.lit("-"), F.lit(""))
    calendar = F.when(day.rlike(_DATE_PART + "$") & ~day.startswith("0000"), F.try_to_date(compact, "yyyyMMdd"))
    year, week = F.substring(compact, 1, 4).cast("int"), F.substring(compact, 6, 2).cast("int")
    weekday = F.coalesce(F.nullif(F.substring(compact, 8, 1), F.lit("")), F.lit("1")).cast("int")
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_add(fourth, week * 7 - 7 - F.weekday(fourth))
    in_year = (week >= 1) & weekday.between(1, 7) & (F.year(F.date_add(monday, 3)) == year) & (year > 0)
    found = F.date_add(monday, weekday - 1)
    is_week = day.rlike(r"^(\d{4}-W\d{2}(-\d)?|\d{4}W\d{2}\d?)$")
    week_date = F.when(is_week & in_year & (F.year(found) <= 9999), found)
    return F.when((n >= 7) & timed, F.coalesce(calendar, week_date))


def date_from_na(t) -> Column:
    """P5 on an NA-normalised value: the common ISO forms by one pattern, the
    other forms that Python's datetime.fromisoformat accepts by rule."""
    t = _c(t)
    digits = F.replace(F.substr(t, F.lit(1), F.when(F.substring(t, 5, 1) == "-", 10).otherwise(8)), F.lit("-"), F.lit(""))
    common = F.when(~t.startswith("0000"), F.try_to_date(digits, "yyyyMMdd"))
    # The long rule is kept out of the generated code, which would outgrow the JVM's
    # method size and run uncompiled; it is called for the rarer forms alone.
    general = F.get(F.transform(F.array(t), _general_iso_date), F.lit(0))
    return F.when(t.rlike(_FAST_ISO), common).when(t.isNotNull(), general)


# Single-expression forms (handy in ad-hoc selects). Bulk cleaning uses the
# staged projections in ``bizlens.operators.clean`` so each regex runs once.

def normalize_na(c) -> Column:
    """Strip; empty or case-insensitive ``na`` -> NULL."""
    return na_from_stripped(strip_ws(c))


def normalize_postal(c) -> Column:
    """Keep what Python's isdigit() accepts; left-pad to 6; anything not 6 long -> NULL."""
    return postal_from_digits(postal_digits(normalize_na(c)))


def normalize_ssic(c) -> Column:
    """An all-digit code shorter than 5 is left-padded to 5; else unchanged."""
    return ssic_from_na(normalize_na(c))


def normalize_date(c) -> Column:
    """P5: ISO date / datetime text -> DATE of its local date part; invalid -> NULL."""
    return date_from_na(normalize_na(c))


def ssic_norm(c) -> Column:
    """Warehouse-side code normalisation (NULL/'' -> NULL, pad digits to 5)."""
    x = _c(c)
    return (
        F.when(x.isNull() | (x == ""), F.lit(None).cast("string"))
        .when(x.rlike("^[0-9]+$") & (F.length(x) < 5), F.lpad(x, 5, "0"))
        .otherwise(x)
    )


def yyyymm(c) -> Column:
    """YYYYMM as int; a NULL date maps to 0 (pinned decision)."""
    d = _c(c)
    return F.coalesce((F.year(d) * 100 + F.month(d)).cast("int"), F.lit(0))


def yyyymm_of(d) -> int:
    """YYYYMM of a Python date (used to derive month predicates)."""
    return d.year * 100 + d.month
