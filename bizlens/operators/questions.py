"""Question analytics over a table of questions (N1..N16).

``parse_questions`` turns (question_id, question) rows into intent + slot
columns with built-in expressions. ``answer_rows`` answers every question
from running totals:

1. slots are de-duplicated (many questions share a slot). What a slot counts is
   its scope: an area or any with a code prefix or any (series by month), the
   codes of an area (ranking), the areas of a prefix (ranking);
2. the days at which some slot needs a total cut the calendar into spans. The fact is
   aggregated to counts per span of the scopes that are asked for, and of each
   code or area within a ranking's scope -- partial aggregates, so hot keys fold
   map-side;
3. each of these series is summed up over its spans (at most a calendar of them);
4. a count is the total at the end minus the total before the begin: rows joined do not
   depend on the length of the range. A series by month is probed at the days its slots
   need and joined on (scope, day). A ranking's members stay where their spans were
   summed up: a total holds until the member's next span, so the days and slots of the
   scope, broadcast, find it there, and only the top of each task is shuffled;
5. per-intent group-bys and top-k per slot produce the answer rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions import questions as QF
from bizlens.operators.filters import date_between
from bizlens.schema import DETAIL_COLUMNS
from bizlens.session import cut_lineage

_WITH_SSIC = [QF.COMPARE_AREAS, QF.HOTTEST_AREAS_FOR_INDUSTRY, QF.EXPLAIN_CHANGE, QF.NEW_ENTITIES_TREND]
_WITH_AREA = [QF.TOP_INDUSTRIES_IN_AREA, QF.EXPLAIN_CHANGE, QF.NEW_ENTITIES_TREND]

TOP = 10
# Scopes that may be broadcast: rows of some 200 bytes, 64 MB at most.
MAX_BROADCAST_SCOPES = 300_000

SLOT_COLUMNS = ["intent", "start_date", "end_date", "ssic", "area", "area_1", "area_2", "uen"]


def parse_questions(questions: DataFrame, as_of: _dt.date, id_col: str = "question_id",
                    text_col: str = "question", word_boundary: bool = False) -> DataFrame:
    """N1..N8: (question_id, question, intent, start_date, end_date, ssic, area,
    area_1, area_2, uen, error). Slots not used by the intent are NULL; an
    error row (lookup without a UEN, comparison without two areas) has no slots.
    """
    q = F.col("question")
    base = questions.select(F.col(id_col).alias("question_id"), F.col(text_col).alias("question")).select(
        "question_id", "question", QF.tokens(q).alias("toks")
    )
    staged = base.select("question_id", "question", "toks", QF.classify_intent(q, "toks").alias("intent"))
    # Slot extractors run only for the intents that use them (CASE short-circuits),
    # as the per-call parser only calls them for its intent. Each stage is its
    # own projection so shared sub-expressions are computed once.
    i = F.col("intent")
    dated_intent = i != QF.ENTITY_LOOKUP
    pieces = staged.select(
        "question_id", "question", "intent",
        F.when(dated_intent, QF.relative_days(q)).alias("rel"),
        F.when(dated_intent, QF.years(q, "toks")).alias("ys"),
        F.when(i.isin(_WITH_SSIC), QF.extract_ssic_or_keyword(q, word_boundary)).alias("ssic_any"),
        F.when(i.isin(_WITH_AREA), QF.extract_area(q)).alias("area_any"),
        F.when(i == QF.COMPARE_AREAS, QF.extract_compare_areas(q)).alias("areas_any"),
        F.when(i == QF.ENTITY_LOOKUP, QF.extract_uen(q, "toks")).alias("uen_any"),
    )
    start, stop = QF.range_bounds("rel", "ys", as_of)
    bounds = pieces.select("*", F.when(dated_intent, start).alias("s0"), F.when(dated_intent, stop).alias("e0"))
    ordered = bounds.select("*", F.least("s0", "e0").alias("lo0"), F.greatest("s0", "e0").alias("hi"))
    raw = ordered.select("*", F.struct(QF.clamp_start("lo0", "hi").alias("start_date"),
                                       F.col("hi").alias("end_date")).alias("rng"))
    intent = F.col("intent")
    error = (
        F.when((intent == QF.ENTITY_LOOKUP) & F.col("uen_any").isNull(), F.lit("UEN not found in question"))
        .when((intent == QF.COMPARE_AREAS) & F.col("areas_any").isNull(), F.lit("Provide two areas to compare"))
    )
    ok = error.isNull()
    dated = ok & (intent != QF.ENTITY_LOOKUP)
    return raw.select(
        "question_id", "question", "intent",
        F.when(dated, F.col("rng.start_date")).alias("start_date"),
        F.when(dated, F.col("rng.end_date")).alias("end_date"),
        F.when(ok & intent.isin(_WITH_SSIC), F.col("ssic_any")).alias("ssic"),
        F.when(ok & intent.isin(_WITH_AREA), F.col("area_any")).alias("area"),
        F.when(ok & (intent == QF.COMPARE_AREAS), F.get("areas_any", 0)).alias("area_1"),
        F.when(ok & (intent == QF.COMPARE_AREAS), F.get("areas_any", 1)).alias("area_2"),
        F.when(ok & (intent == QF.ENTITY_LOOKUP), F.col("uen_any")).alias("uen"),
        error.alias("error"),
    )


def _slot_id():
    """The slots as one text that tells every combination apart (NULLs too)."""
    return F.to_json(F.struct(*SLOT_COLUMNS))


# Keys begin with what they are, so that no value can read as "any".
_ANY = "any"
# What a scope is asked for: a series by month, its codes, its areas.
_SERIES, _CODES, _AREAS = "series", "codes", "areas"
_SCOPE = ["kind", "area_key", "prefix_key"]


def _key(value):
    return F.concat(F.lit("="), value)


def _scopes(slots: DataFrame) -> DataFrame:
    """The scope of each dated slot; one per area for a comparison."""
    s = slots.filter(F.col("start_date").isNotNull())
    intent = F.col("intent")
    kind = (
        F.when(intent == QF.TOP_INDUSTRIES_IN_AREA, F.lit(_CODES))
        .when(intent == QF.HOTTEST_AREAS_FOR_INDUSTRY, F.lit(_AREAS))
        .otherwise(F.lit(_SERIES))
    )
    area_keys = (
        F.when(intent == QF.COMPARE_AREAS, F.array_distinct(F.array(_key(F.col("area_1")), _key(F.col("area_2")))))
        .when(intent.isin(_WITH_AREA), F.array(F.coalesce(_key(F.col("area")), F.lit(_ANY))))
        .otherwise(F.array(F.lit(_ANY)))
    )
    return s.select(
        "slot", "intent", "start_date", "end_date", kind.alias("kind"),
        F.explode(area_keys).alias("area_key"),
        F.coalesce(_key(F.col("ssic")), F.lit(_ANY)).alias("prefix_key"),
    )


def _points(scopes: DataFrame) -> DataFrame:
    """The days whose totals make up a slot's counts, with their signs: the end and the
    day before the begin, of every month for a series and of the range for a ranking."""
    whole = F.array(F.struct(
        F.col("start_date").alias("lo"), F.col("end_date").alias("hi"), F.lit(None).cast("int").alias("month")))
    months = F.transform(
        F.sequence(F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("INTERVAL 1 MONTH")),
        lambda d: F.struct(
            F.greatest(d, F.col("start_date")).alias("lo"), F.least(F.last_day(d), F.col("end_date")).alias("hi"),
            (F.year(d) * 100 + F.month(d)).cast("int").alias("month")),
    )
    spans = scopes.select("*", F.explode(F.when(F.col("kind") == _SERIES, months).otherwise(whole)).alias("span"))
    ends = F.array(
        F.struct(F.col("span.hi").alias("day"), F.lit(1).alias("sign")),
        F.struct(F.date_sub("span.lo", 1).alias("day"), F.lit(-1).alias("sign")),
    )
    return spans.select(
        "slot", "intent", *_SCOPE, F.col("span.month").alias("month"), F.explode(ends).alias("end")
    ).select("slot", "intent", *_SCOPE, "month", "end.day", "end.sign")


def _calendar(spark, days: list[_dt.date]) -> DataFrame:
    """(on, day): for every date the next of ``days``. One row per date of the calendar."""
    rows, begin = [], min(days, default=None)
    for day in sorted(days):
        rows += [(begin + _dt.timedelta(k), day) for k in range((day - begin).days + 1)]
        begin = day + _dt.timedelta(1)
    return F.broadcast(spark.createDataFrame(rows, "on date, day date"))


def _spans(fact: DataFrame, wanted: DataFrame, days: dict[str, set], small: bool) -> tuple[DataFrame, DataFrame]:
    """Counts per span (named by its last day) of every wanted scope and of each member
    that it ranks: (series and areas, codes). Keys that nobody asks for are dropped before
    anything is shuffled. ``days``: what the slots of a kind need; ``small``: the scopes
    may be broadcast."""
    def asked(kinds, *columns):
        found = wanted.filter(F.col("kind").isin(kinds)).select(*columns)
        return F.broadcast(found) if small else found

    def dated(kinds):
        rows = fact.select(F.col("registration_incorporation_date").alias("on"),
                           F.col("planning_area_id").alias("area"), F.col("primary_ssic_norm").alias("norm"))
        needed = set().union(*(days.get(k, ()) for k in kinds))
        return rows.join(_calendar(fact.sparkSession, list(needed)), "on")

    norm, area_key = F.col("norm"), _key(F.col("area"))
    prefixes = F.array_compact(F.array(
        F.lit(_ANY), *[F.when(F.length(norm) >= n, _key(F.substring(norm, 1, n))) for n in range(2, 6)]))
    areas = F.explode(F.array_compact(F.array(F.lit(_ANY), area_key))).alias("area_key")
    none, total = F.lit(None).cast("string"), F.sum("n").alias("n")

    by_prefix = dated([_SERIES, _AREAS]).select("day", "area", F.explode(prefixes).alias("prefix_key"))
    by_prefix = by_prefix.join(asked([_SERIES, _AREAS], "prefix_key"), "prefix_key", "left_semi")
    by_prefix = by_prefix.groupBy("day", "area", "prefix_key").agg(F.count(F.lit(1)).alias("n"))
    series = by_prefix.select(F.lit(_SERIES).alias("kind"), "day", areas, "prefix_key", none.alias("member"), "n")
    ranked = by_prefix.select(
        F.lit(_AREAS).alias("kind"), "day", F.lit(_ANY).alias("area_key"), "prefix_key", F.col("area").alias("member"), "n")
    both = series.unionByName(ranked).join(asked([_SERIES, _AREAS], *_SCOPE), _SCOPE, "left_semi")
    both = both.groupBy(*_SCOPE, "member", "day").agg(total)

    codes = dated([_CODES]).select("day", areas, F.col("norm").alias("member"))
    codes = codes.join(asked([_CODES], "area_key"), "area_key", "left_semi")
    codes = codes.groupBy("area_key", "member", "day").agg(F.count(F.lit(1)).alias("n"))
    return both, codes


def _totals(spans: DataFrame, points: DataFrame) -> DataFrame:
    """(scope, day, total): the running total of each series at every day that some slot
    needs."""
    days = points.select(*_SCOPE, "day").distinct()
    found = spans.select(*_SCOPE).distinct()
    probes = found.join(days, _SCOPE).select(*_SCOPE, "day", F.lit(0).cast("long").alias("n"),
                                             F.lit(True).alias("probe"))
    both = spans.select(*_SCOPE, "day", "n", F.lit(False).alias("probe")).unionByName(probes)
    # one series: at most a calendar of spans and one of days asked for
    w = Window.partitionBy(*_SCOPE).orderBy("day", "probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("total", F.sum("n").over(w)).filter("probe").drop("n", "probe")


def _ranked(spans: DataFrame, points: DataFrame, key: str, small: bool) -> DataFrame:
    """(slot, member, count, row_no): the top members of each slot. ``spans``: (key,
    member, day, n); ``key`` tells the scopes of the kind apart; ``small``: the points may
    be broadcast. A member's totals are made, found and subtracted in one task: a total
    holds from its span's day until the next one, so no day is probed for a member."""
    def asked(rows):
        return F.broadcast(rows) if small else rows

    w = Window.partitionBy(key, "member").orderBy("day")
    totals = spans.select(
        key, "member", F.col("day").alias("since"), F.lead("day").over(w).alias("until"),
        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    holds = (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    days = points.select(F.col(key).alias("_k"), "day").distinct()
    at = totals.join(asked(days), (F.col(key) == F.col("_k")) & holds).drop("_k", "since", "until")
    ends = points.select(F.col(key).alias("_k"), F.col("day").alias("_d"), "slot", "sign")
    hits = at.join(asked(ends), (F.col(key) == F.col("_k")) & (F.col("day") == F.col("_d")))
    counts = hits.groupBy(key, "member", "slot").agg(
        F.sum(F.col("sign") * F.col("total")).alias("count")).filter("count > 0")
    # Spark keeps the first TOP per slot of each task before it shuffles for this window.
    top = Window.partitionBy("slot").orderBy(F.col("count").desc(), F.col("member").asc_nulls_last())
    return counts.drop(key).withColumn("row_no", F.row_number().over(top)).filter(F.col("row_no") <= TOP)


def answer_rows(parsed: DataFrame, fact: DataFrame) -> DataFrame:
    """N9..N12, N14, N16: one row per (question, answer row):
    (question_id, intent, row_no, month, planning_area_id, ssic_code, count).
    """
    with_id = cut_lineage(parsed.filter(
        F.col("error").isNull() & (F.col("intent") != QF.ENTITY_LOOKUP)
    ).select("question_id", _slot_id().alias("slot_id"), *SLOT_COLUMNS))
    slots = cut_lineage(with_id.select("slot_id", *SLOT_COLUMNS).distinct().withColumn(
        "slot", F.monotonically_increasing_id()))
    scopes = cut_lineage(_scopes(slots))
    points = _points(scopes)
    # The driver sees the days that some slot needs (at most a calendar per kind) and the
    # number of scopes, which no size estimate of the plan would show: it decides on the
    # broadcast. Only the days some question asks about are read.
    days = {r["kind"]: set(r["days"]) for r in points.groupBy("kind").agg(F.collect_set("day").alias("days")).collect()}
    every = set().union(*days.values())
    fact = fact.filter(date_between(min(every), max(every)) if every else F.lit(False))
    small = scopes.count() <= MAX_BROADCAST_SCOPES
    both, codes = _spans(fact, scopes.select(*_SCOPE), days, small)
    both = cut_lineage(both)

    kind, intent = F.col("kind"), F.col("intent")
    no_text, no_month = F.lit(None).cast("string"), F.lit(None).cast("int")
    # Series by month; grouping keys that an intent does not use are NULL, so they do not
    # split its groups. A slot has at most 242 rows.
    monthly = points.filter(kind == _SERIES)
    hits = monthly.join(_totals(both.filter(kind == _SERIES), monthly), [*_SCOPE, "day"])
    area = F.when(intent == QF.COMPARE_AREAS, F.expr("substring(area_key, 2)"))
    series = hits.groupBy("slot", "intent", "month", area.alias("planning_area_id")).agg(
        F.sum(F.col("sign") * F.col("total")).alias("count")).filter("count > 0")
    in_order = Window.partitionBy("slot").orderBy(F.col("month").asc(), F.col("planning_area_id").asc_nulls_last())
    series = series.drop("intent").withColumn("row_no", F.row_number().over(in_order)).withColumn("ssic_code", no_text)

    by_area = _ranked(both.filter(kind == _AREAS), points.filter(kind == _AREAS), "prefix_key", small)
    by_code = _ranked(codes, points.filter(kind == _CODES), "area_key", small)
    answers = series.unionByName(
        by_area.withColumn("ssic_code", no_text).withColumnRenamed("member", "planning_area_id").withColumn("month", no_month)
    ).unionByName(
        by_code.withColumn("planning_area_id", no_text).withColumnRenamed("member", "ssic_code").withColumn("month", no_month)
    ).join(slots.select("slot", "slot_id"), "slot")
    return with_id.select("question_id", "intent", "slot_id").join(answers, "slot_id").select(
        "question_id", "intent", F.col("row_no").cast("int").alias("row_no"), "month", "planning_area_id",
        "ssic_code", F.col("count").cast("long").alias("count"),
    )


def entity_lookups(parsed: DataFrame, fact: DataFrame) -> DataFrame:
    """The entity row (17 columns) for each lookup question with a hit.
    Should a UEN repeat in the fact, the newest registration wins, then the
    smallest remaining columns (as in the single-entity detail)."""
    asks = parsed.filter((F.col("intent") == QF.ENTITY_LOOKUP) & F.col("uen").isNotNull())
    wanted = asks.select("uen").distinct()
    rows = fact.join(wanted, "uen", "left_semi")
    others = [c for c in DETAIL_COLUMNS if c not in ("uen", "registration_incorporation_date")]
    fields = [F.coalesce(-F.unix_date("registration_incorporation_date"), F.lit(2**31 - 1)).alias("d")]
    for i, c in enumerate(others):  # ascending, NULLs last
        fields += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    rank = F.struct(*fields)
    best = rows.groupBy("uen").agg(
        F.min(F.struct(rank.alias("_k"), *[F.col(c) for c in DETAIL_COLUMNS if c != "uen"])).alias("r")
    )
    found = best.select("uen", *[F.col("r." + c).alias(c) for c in DETAIL_COLUMNS if c != "uen"])
    return asks.select("question_id", "uen").join(found, "uen").select("question_id", *DETAIL_COLUMNS)


def narratives(parsed: DataFrame, answers: DataFrame, lookups: DataFrame) -> DataFrame:
    """One sentence per question from its first answer row and row count."""
    firsts = answers.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by(F.struct("ssic_code", "planning_area_id", "count"), "row_no").alias("first"),
    )
    looked = lookups.select("question_id", "entity_name", "entity_status_description",
                            F.lit(True).alias("found"))
    j = parsed.select("question_id", "intent", "error").join(firsts, "question_id", "left").join(
        looked, "question_id", "left"
    )
    intent = F.col("intent")

    def s(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    text = (
        F.when(F.col("error").isNotNull(), F.lit(None).cast("string"))
        .when(intent == QF.ENTITY_LOOKUP,
              F.when(F.col("found").isNull(), F.lit("No entity found for that UEN."))
              .otherwise(F.concat(F.lit("Found "), s("entity_name"), F.lit(" ("),
                                  s("entity_status_description"), F.lit(")."))))
        .when(F.coalesce(F.col("n_rows"), F.lit(0)) == 0, F.lit("No results for the selected filters."))
        .when(intent == QF.TOP_INDUSTRIES_IN_AREA,
              F.concat(F.lit("Top SSIC: "), s("first.ssic_code"), F.lit(" with "), s("first.count"),
                       F.lit(" new entities.")))
        .when(intent == QF.HOTTEST_AREAS_FOR_INDUSTRY,
              F.concat(F.lit("Hottest planning area: "), s("first.planning_area_id"), F.lit(" with "),
                       s("first.count"), F.lit(" new entities.")))
        .when(intent == QF.COMPARE_AREAS, F.lit("Compared areas across the selected period."))
        .when(intent == QF.EXPLAIN_CHANGE, F.lit("Trend data prepared; use month-by-month view to spot spikes."))
        .otherwise(F.lit("Trend generated."))
    )
    n_rows = F.when(intent == QF.ENTITY_LOOKUP, F.when(F.col("found").isNotNull(), 1).otherwise(0)).otherwise(
        F.coalesce(F.col("n_rows"), F.lit(0)))
    return j.select("question_id", "intent", n_rows.cast("long").alias("n_rows"), text.alias("narrative"), "error")
