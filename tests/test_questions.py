"""N1..N8 on the representative questions, N16/N15 on a small fact."""

import datetime as dt

from pyspark.sql import functions as F

from bizlens.operators.questions import answer_rows, entity_lookups, narratives, parse_questions

AS_OF = dt.date(2024, 6, 30)


def _parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    return {r.question_id: r for r in parse_questions(df, AS_OF).collect()}


def test_representative_questions(spark):
    qs = [
        "Top SSICs in Northgate last 12 months",
        "Compare Riverside West vs Eastwood for new F&B entities",
        "Trend of new entities",
        "uen 12345678a",
        "Why the spike in retail 2021 to 2019",
        "Show uen please",
        "compare nothing",
        "Where do ssic 6201 firms cluster in 2015",
        "new software firms from 1990 to 2023",
    ]
    r = _parse(spark, qs)
    assert r[0].intent == "TOP_INDUSTRIES_IN_AREA" and r[0].area == "Northgate" and r[0].ssic is None
    assert (r[0].end_date - r[0].start_date).days == 365 and r[0].end_date == AS_OF
    assert r[1].intent == "COMPARE_AREAS" and (r[1].area_1, r[1].area_2) == ("Riverside West", "Eastwood")
    assert r[1].ssic == "56" and (r[1].end_date - r[1].start_date).days == 720
    assert r[2].intent == "NEW_ENTITIES_TREND" and r[2].ssic == "62" and r[2].area is None
    assert r[3].intent == "ENTITY_LOOKUP" and r[3].uen == "12345678A" and r[3].start_date is None
    assert r[4].intent == "EXPLAIN_CHANGE" and r[4].ssic == "47" and r[4].area == "retail"
    assert (r[4].start_date, r[4].end_date) == (dt.date(2019, 1, 1), dt.date(2021, 12, 31))
    assert r[5].error == "UEN not found in question" and r[5].uen is None
    assert r[6].error == "Provide two areas to compare"
    assert r[7].intent == "HOTTEST_AREAS_FOR_INDUSTRY" and r[7].ssic == "6201"
    assert r[8].ssic == "62" and r[8].end_date == dt.date(2023, 12, 31)
    assert (r[8].end_date - r[8].start_date).days == 3650  # ten-year clamp keeps the end


def _fact(spark):
    rows = [
        ("00000001A", "Acme", "Live", dt.date(2024, 5, 1), 202405, "56101", "EAST"),
        ("00000002B", "Beta", "Live", dt.date(2024, 5, 20), 202405, "56101", "EAST"),
        ("00000003C", "Gamma", "Gone", dt.date(2024, 6, 2), 202406, "62011", "WEST"),
        ("00000004D", "Delta", "Live", dt.date(2023, 1, 1), 202301, "47110", None),
    ]
    cols = ("uen string, entity_name string, entity_status_description string, "
            "registration_incorporation_date date, registration_month int, primary_ssic_norm string, "
            "planning_area_id string")
    df = spark.createDataFrame(rows, cols)
    from pyspark.sql import functions as F

    from bizlens.schema import DETAIL_COLUMNS
    for c in DETAIL_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double" if c in ("latitude", "longitude") else "string"))
    return df


def test_answers_and_narratives(spark):
    qs = ["Trend of food firms in EAST last 3 months", "Top industries last year",
          "Where are firms hottest last 12 months", "compare EAST vs WEST last 6 months",
          "uen 00000003c", "uen 99999999z", "Trend in NOWHERE last 3 months"]
    df = spark.createDataFrame(list(enumerate(qs)), "question_id long, question string")
    parsed = parse_questions(df, AS_OF)
    fact = _fact(spark)
    ans = answer_rows(parsed, fact)
    rows = sorted((r.question_id, r.row_no, r.month, r.planning_area_id, r.ssic_code, r["count"])
                  for r in ans.collect())
    assert [r for r in rows if r[0] == 0] == [(0, 1, 202405, None, None, 2)]
    assert [r[4:] for r in rows if r[0] == 1] == [("56101", 2), ("62011", 1)]
    assert [r[3:] for r in rows if r[0] == 2] == [("EAST", None, 2), ("WEST", None, 1)]
    assert [r[2:4] + r[5:] for r in rows if r[0] == 3] == [(202405, "EAST", 2), (202406, "WEST", 1)]
    look = entity_lookups(parsed, fact)
    nar = {r.question_id: r.narrative for r in narratives(parsed, ans, look).collect()}
    assert nar[1] == "Top SSIC: 56101 with 2 new entities."
    assert nar[2] == "Hottest planning area: EAST with 2 new entities."
    assert nar[3] == "Compared areas across the selected period."
    assert nar[4] == "Found Gamma (Gone)."
    assert nar[5] == "No entity found for that UEN."
    assert nar[6] == "No results for the selected filters."
    assert nar[0] == "Trend generated."


def test_star_is_an_area_name_like_any_other(spark):
    qs = ["compare * vs EAST last 12 months", "compare EAST vs EAST last 12 months"]
    df = spark.createDataFrame(list(enumerate(qs)), "question_id long, question string")
    got = sorted((r.question_id, r.planning_area_id, r["count"])
                 for r in answer_rows(parse_questions(df, AS_OF), _fact(spark)).collect())
    assert got == [(0, "EAST", 2), (1, "EAST", 2)]


def test_question_patterns_match_python_regex_engine(spark):
    """The extraction patterns give the same groups in Spark (Java regex) and
    in Python's ``regex`` module on generated questions."""
    import random

    import regex

    from bizlens.functions import questions as QF

    rnd = random.Random(3)
    words = ["Top", "SSIC", "ssic62", "ssic 4711", "in", "IN", "for", "Jade Hill", "vs", "VS", "compare", "Compare",
             "last", "since", "from", "to", "today", "2019", "2021", "12 months", "entities", "f&b", "retail",
             "  ", "\t", "café", "Été", "x1", "12345678a", "uen", "north  shore", "2020s", "1999 ",
             "\u3000", "\xa0in", "ſsic 56", "\r", "\n", "Kompare"]
    texts = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) for _ in range(600)})
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    pats = {"area": (QF._AREA, 2), "cmp1": (QF._COMPARE, 1), "cmp2": (QF._COMPARE, 2), "vs1": (QF._VS, 1),
            "ssic": (QF._SSIC, 1)}
    rows = df.select("q", *[F.regexp_extract("q", p, g).alias(k) for k, (p, g) in pats.items()]).collect()

    def py(p, g, t):
        # Python has no (?d) ('\n' is already its only terminator) and spells
        # code points \UXXXXXXXX instead of \x{...}
        p = regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U%08X" % int(m.group(1), 16), p.replace("(?diu)", "(?iu)"))
        m = regex.search(p, t)
        return (m.group(g) or "") if m else ""

    for r in rows:
        for k, (p, g) in pats.items():
            assert r[k] == py(p, g, r.q), (k, r.q)


def test_long_questions(spark):
    """No comparison, one at the end, one in a later line: each in one pass."""
    import time

    words = " ".join(f"word{k}" for k in range(20_000))
    texts = [f"compare {words}", f"{words}\n{words}", f"{words} vs Eastwood", f"compare A vs {words}", f"x {words}\nNorth Gate vs Eastwood\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    parse_questions(df.limit(1), AS_OF).collect()
    began = time.time()
    got = {r.question_id: r for r in parse_questions(df, AS_OF).collect()}
    assert time.time() - began < 10
    assert got[0].error and got[2].area_2 == "Eastwood" and got[2].area_1 == words
    assert got[3].area_1 == "A" and (got[4].area_1, got[4].area_2) == ("North Gate", "Eastwood")


def test_running_totals_against_counting(spark):
    """Answers equal a plain count over the range, whatever the slots share."""
    import random
    from collections import Counter

    rnd = random.Random(5)
    areas, codes = ["EAST", "WEST", None], ["56101", "56", "62011", "6", None, "47110"]
    day = lambda: dt.date(2014, 1, 1) + dt.timedelta(rnd.randrange(3900))
    rows = [(day(), rnd.choice(areas), rnd.choice(codes)) for _ in range(900)] + [(None, "EAST", "56")] * 3
    fact = spark.createDataFrame(rows, "registration_incorporation_date date, planning_area_id string, primary_ssic_norm string")
    fact = fact.withColumn("registration_month", F.expr(
        "year(registration_incorporation_date) * 100 + month(registration_incorporation_date)"))
    texts = [f"{kind}{place}{what} {when}" for kind in ("Trend of firms", "Top industries", "Where hot firms", "why")
             for place in ("", " in EAST", " in NOWHERE") for what in (" food", " ssic 6201", " ssic 56101", "")
             for when in ("last 3 months", "last 12 months", "2015 to 2019", "2020", "")]
    texts += ["compare EAST vs WEST 2016 to 2018", "compare EAST vs EAST for food 2016", "compare X vs WEST last 6 months"]
    df = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    parsed = parse_questions(df, AS_OF).collect()
    got: dict = {}
    for r in answer_rows(parse_questions(df, AS_OF), fact).collect():
        got.setdefault(r.question_id, []).append((r.row_no, r.month, r.planning_area_id, r.ssic_code, r["count"]))
    last = lambda k: (k is None, k or "")
    for q in parsed:
        held = [r for r in rows if r[0] and q.start_date <= r[0] <= q.end_date
                and (q.ssic is None or (r[2] or "").startswith(q.ssic)) and (q.area is None or r[1] == q.area)]
        if q.intent == "COMPARE_AREAS":
            n = Counter((r[0].year * 100 + r[0].month, r[1]) for r in held if r[1] in (q.area_1, q.area_2))
            want = [(m, a, None, c) for (m, a), c in sorted(n.items())]
        elif q.intent == "TOP_INDUSTRIES_IN_AREA":
            want = [(None, None, k, c) for k, c in sorted(Counter(r[2] for r in held).items(), key=lambda x: (-x[1], last(x[0])))][:10]
        elif q.intent == "HOTTEST_AREAS_FOR_INDUSTRY":
            want = [(None, k, None, c) for k, c in sorted(Counter(r[1] for r in held).items(), key=lambda x: (-x[1], last(x[0])))][:10]
        else:
            want = [(m, None, None, c) for m, c in sorted(Counter(r[0].year * 100 + r[0].month for r in held).items())]
        assert sorted(got.get(q.question_id, [])) == [(k + 1, *w) for k, w in enumerate(want)], (q.question, q.intent)


def test_ranked_members_are_not_probed_and_each_task_keeps_its_top(spark):
    """Many codes, few of them with a row in each span: totals hold over the spans a code
    skips, no row is made for a (code, day) and only the top of a task is shuffled."""
    day = dt.date(2015, 3, 1)
    rows = [(day.replace(year=2015 + k % 5), "EAST" if k % 3 else "WEST", f"{k % 400:05d}") for k in range(3000)]
    rows += [(day.replace(year=2016), "EAST", None)] * 9 + [(dt.date(2018, 7, 1), None, "00007")] * 30
    fact = spark.createDataFrame(
        rows, "registration_incorporation_date date, planning_area_id string, primary_ssic_norm string"
    ).withColumn("registration_month", F.expr(
        "year(registration_incorporation_date) * 100 + month(registration_incorporation_date)"))
    texts = [f"Top industries in EAST {a} to {b}" for a in range(2015, 2020) for b in range(a, 2020)]
    texts += ["Top industries 2018", "Where are ssic 000 firms hottest 2015 to 2018"]
    df = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    answers = answer_rows(parse_questions(df, AS_OF), fact)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number(), 10, Partial") == 2  # codes and areas
    assert "probe" not in plan.split("row_number(), 10, Final", 1)[1]
    got: dict = {}
    for r in answers.collect():
        got.setdefault(r.question_id, []).append((r.row_no, r.planning_area_id, r.ssic_code, r["count"]))
    from collections import Counter

    def top(held, last=lambda k: (k is None, k or "")):
        return sorted(Counter(held).items(), key=lambda x: (-x[1], last(x[0])))[:10]

    k = 0
    for a in range(2015, 2020):
        for b in range(a, 2020):
            want = top(c for d, p, c in rows if p == "EAST" and a <= d.year <= b)
            assert sorted(got[k]) == [(n + 1, None, c, x) for n, (c, x) in enumerate(want)], texts[k]
            k += 1
    want = top(c for d, _, c in rows if d.year == 2018)
    assert sorted(got[k]) == [(n + 1, None, c, x) for n, (c, x) in enumerate(want)]
    want = top(p for d, p, c in rows if d.year < 2019 and (c or "").startswith("000"))
    assert sorted(got[k + 1]) == [(n + 1, p, None, x) for n, (p, x) in enumerate(want)]
