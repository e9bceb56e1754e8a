"""Forms of personal data, very long ones and exhausted formats."""

import pytest

from bizlens.llm import pii


def _replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.replace(docs, count="n_entities").collect()}


FORMS = [
    "+49 30 12345678", "+33 1 23 45 67 89", "(030) 1234567", "+44 20 7946 0958", "+1 (415) 555-2671",
    "Bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIx", "xoxb-123456789012-abcdefABCDEF", "AIza" + "aB3_-" * 7,
    "müller@post.de", "Mr. O'Brien", "Mr. John F. Kennedy-Smith", "Frau Anna-Lena Groß",
]


def test_forms_are_replaced(spark):
    got = _replaced(spark, [f"see {f} there" for f in FORMS])
    for k, form in enumerate(FORMS):
        text = got[k].text
        assert got[k].n_entities and text.startswith("see ") and text.endswith(" there"), form
        assert not any(part in text for part in form.split() if len(part) > 6 and not part.startswith(("Bearer", "+"))), (form, text)
    assert "ü" not in got[8].text and "Smith" not in got[10].text and "Brien" not in got[9].text
    plain = ["we add +5 to 3 and 4", "room (12) 34", "a xox- b", "the Bearer of 12 rings"]
    assert [r.text for r in sorted(_replaced(spark, plain).values())] == plain


def test_very_long_forms(spark):
    texts = ["x@a" + ".b" * 100_000, "a" * 200_000 + "@b.c", "(030) " * 50_000, "+1 " * 50_000, "Mr. A" + "b" * 100_000, "token=" + "aB3" * 10_000]
    got = _replaced(spark, texts)
    assert got[0].n_entities == 1 and got[1].n_entities == 0  # longer than mail allows
    assert got[5].n_entities == 1 and len(got[5].text) == len(texts[5]) and "aB3aB3" not in got[5].text


def test_short_formats_are_widened_or_refused(spark, monkeypatch):
    units = spark.createDataFrame([("email", f"{d}@2.x{k}.de") for d in range(10) for k in range(13)], "kind string, norm string")
    drawn = [r.drawn for r in pii.distinct_surrogates(units).collect()]
    assert len(drawn) == len(set(drawn)) == 130
    monkeypatch.setattr(pii, "MAX_DRAWS", 3)
    full = spark.createDataFrame([("phone", str(k)) for k in range(1, 10)], "kind string, norm string")
    with pytest.raises(RuntimeError, match="no free surrogates"):
        pii.distinct_surrogates(full)
