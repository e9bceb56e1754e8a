"""Question parsing as Column expressions (N1..N8): no Python per row.

Word boundaries are written as explicit classes over letters, digits and
'_' (``[\\p{L}\\p{N}_]``), matching Python's Unicode ``\\b`` on real text.
Patterns whose content is all word characters between two boundaries (a
year, an 8-digit-plus-letter UEN) are whole word tokens, so they are found
by filtering the question's tokens.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizlens.functions.cleaning import WHITESPACE, strip_ws

# Intent names.
NEW_ENTITIES_TREND = "NEW_ENTITIES_TREND"
TOP_INDUSTRIES_IN_AREA = "TOP_INDUSTRIES_IN_AREA"
HOTTEST_AREAS_FOR_INDUSTRY = "HOTTEST_AREAS_FOR_INDUSTRY"
COMPARE_AREAS = "COMPARE_AREAS"
ENTITY_LOOKUP = "ENTITY_LOOKUP"
EXPLAIN_CHANGE = "EXPLAIN_CHANGE"

# Industry keyword -> code prefix, checked in this order
# (plain substring tests, so "it" also fires inside "entities").
INDUSTRY_KEYWORDS = [
    ("f&b", "56"),
    ("food", "56"),
    ("restaurant", "56"),
    ("cafe", "56"),
    ("retail", "47"),
    ("wholesale", "46"),
    ("finance", "64"),
    ("bank", "64"),
    ("insurance", "65"),
    ("software", "62"),
    ("it", "62"),
    ("tech", "62"),
]

# Relative-range phrases -> days back from as_of, in test order.
RELATIVE_RANGES = [
    (("last 12 months", "past 12 months", "last year"), 365),
    (("last 6 months",), 180),
    (("last 3 months",), 90),
    (("last 24 months",), 730),
]
DEFAULT_RANGE_DAYS = 24 * 30
MAX_SPAN_DAYS = 365 * 10

_W = r"[\p{L}\p{N}_]"
_NB = rf"(?:^|[^\p{{L}}\p{{N}}_])"  # boundary before a word character
# Python's re semantics in Java: (?d) makes '\n' the only line terminator for
# '.' and '$' (Python: '.' excludes only '\n'; '$' also matches before a final
# '\n'); (?iu) folds case over Unicode; \s is Python's whitespace set.
_S = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WHITESPACE) + "]"
_FLAGS = "(?diu)"
_AREA = (rf"{_FLAGS}{_NB}(in|for){_S}+([A-Za-z ]+?)"
         rf"(?:{_S}+last|{_S}+since|{_S}+from|{_S}+to|{_S}+[0-9]{{4}}|$)")
_COMPARE = rf"{_FLAGS}compare{_S}+(.+?){_S}+vs{_S}+(.+?)(?:{_S}+for|{_S}+last|{_S}+since|{_S}+[0-9]{{4}}|$)"
# A match that starts inside a line also starts at the line's begin, so only those are tried.
_VS = rf"{_FLAGS}(?<![^\n])(.+?){_S}+vs{_S}+(.+?)(?:{_S}+for|{_S}+last|{_S}+since|{_S}+[0-9]{{4}}|$)"
# What both comparisons need, found by position before either is tried.
_HAS_VS = rf"(?iu){_S}vs{_S}"
_SSIC = rf"{_FLAGS}{_NB}ssic{_S}*([0-9]{{2,5}})(?:$|[^\p{{L}}\p{{N}}_])"
_TOKEN = rf"{_W}+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(q) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(_c(q), F.lit(_TOKEN), 0)


def extract_uen(q, toks=None) -> Column:
    """First whole token of 8 digits + a letter (any case), upper-cased."""
    hits = F.filter(tokens(q) if toks is None else _c(toks), lambda t: t.rlike("^[0-9]{8}[A-Za-z]$"))
    return F.upper(F.get(hits, 0))


def years(q, toks=None) -> Column:
    """Years 1900..2099 written as whole tokens, as integers, ascending."""
    hits = F.filter(tokens(q) if toks is None else _c(toks), lambda t: t.rlike("^(19|20)[0-9]{2}$"))
    return F.array_sort(F.transform(hits, lambda t: t.cast("int")))


def classify_intent(q, toks=None) -> Column:
    """Ordered keyword rules on the lower-cased text."""
    t = F.lower(_c(q))

    def has(s):
        return t.contains(s)

    return (
        F.when(has("uen") | extract_uen(q, toks).isNotNull(), F.lit(ENTITY_LOOKUP))
        .when(has("compare") | has(" vs "), F.lit(COMPARE_AREAS))
        .when(has("top") & (has("ssic") | has("industry") | has("industries")), F.lit(TOP_INDUSTRIES_IN_AREA))
        .when(has("where") & (has("cluster") | has("hot") | has("hottest")), F.lit(HOTTEST_AREAS_FOR_INDUSTRY))
        .when(has("why") | has("spike"), F.lit(EXPLAIN_CHANGE))
        .otherwise(F.lit(NEW_ENTITIES_TREND))
    )


def relative_days(q) -> Column:
    """Days back for a relative phrase, NULL when none applies."""
    t = F.lower(_c(q))
    expr = None
    for phrases, days in RELATIVE_RANGES:
        cond = None
        for p in phrases:
            cond = t.contains(p) if cond is None else (cond | t.contains(p))
        expr = F.when(cond, F.lit(days)) if expr is None else expr.when(cond, F.lit(days))
    return expr


def range_bounds(rel, ys, as_of: _dt.date) -> tuple[Column, Column]:
    """N2 before the clamp: (start, end) from relative days or the years list."""
    end = F.lit(as_of)
    rel = _c(rel)
    ys = _c(ys)
    y0 = F.get(ys, 0)
    y1 = F.try_element_at(ys, F.lit(-1))
    start = (
        F.when(rel.isNotNull(), F.date_sub(end, rel))
        .when(y0.isNotNull(), F.make_date(y0, F.lit(1), F.lit(1)))
        .otherwise(F.date_sub(end, F.lit(DEFAULT_RANGE_DAYS)))
    )
    stop = F.when(rel.isNull() & y0.isNotNull(), F.make_date(y1, F.lit(12), F.lit(31))).otherwise(end)
    return start, stop


def clamp_start(lo, hi) -> Column:
    """N3 (after ordering): keep the end, cap the span at ten years."""
    lo, hi = _c(lo), _c(hi)
    return F.when(F.datediff(hi, lo) > MAX_SPAN_DAYS, F.date_sub(hi, MAX_SPAN_DAYS)).otherwise(lo)


def extract_range(q, as_of: _dt.date) -> Column:
    """N2 + N3 as one expression: struct(start_date, end_date).
    (Bulk parsing uses the staged form in ``bizlens.operators.questions``.)"""
    start, stop = range_bounds(relative_days(q), years(q), as_of)
    lo = F.least(start, stop)
    hi = F.greatest(start, stop)
    return F.struct(clamp_start(lo, hi).alias("start_date"), hi.alias("end_date"))


def extract_area(q) -> Column:
    """Text after 'in'/'for' up to a range word or the end; '' -> NULL."""
    a = F.trim(F.regexp_extract(_c(q), _AREA, 2))
    return F.when(a != "", a)


def extract_compare_areas(q) -> Column:
    """[A, B] from 'compare A vs B ...' (fallback 'A vs B ...'); NULL if none."""
    q = _c(q)

    def sides(pattern):
        return F.array(*(strip_ws(F.regexp_extract(q, pattern, k)) for k in (1, 2)))

    return F.when(q.rlike(_HAS_VS), F.when(q.rlike(_COMPARE), sides(_COMPARE)).when(q.rlike(_VS), sides(_VS)))


def extract_ssic(q) -> Column:
    """N7 first half: 'ssic' followed by 2-5 digits as a whole token tail."""
    s = F.regexp_extract(_c(q), _SSIC, 1)
    return F.when(s != "", s)


def industry_keyword(q) -> Column:
    """N7 second half: first keyword contained in the lower-cased text."""
    t = F.lower(_c(q))
    expr = None
    for kw, code in INDUSTRY_KEYWORDS:
        expr = F.when(t.contains(kw), F.lit(code)) if expr is None else expr.when(t.contains(kw), F.lit(code))
    return expr


def extract_ssic_or_keyword(q, word_boundary: bool = False) -> Column:
    """N7. ``word_boundary=True`` matches keywords as whole words instead."""
    if not word_boundary:
        return F.coalesce(extract_ssic(q), industry_keyword(q))
    t = F.lower(_c(q))
    expr = None
    for kw, code in INDUSTRY_KEYWORDS:
        pat = rf"(?:^|[^\p{{L}}\p{{N}}_]){kw}(?:$|[^\p{{L}}\p{{N}}_])"
        cond = t.rlike(pat)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return F.coalesce(extract_ssic(q), expr)
