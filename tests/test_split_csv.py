"""Large CSV files cut into ranges give the rows that Python's csv module reads."""

import csv
import io
import random

import pytest

from bizlens.sources.registry_csv import CORRUPT, read_registry_csv
from bizlens.sources.split_csv import ends_inside

FIELDS = ["uen", "entity_name", "postal_code"]
VALUES = ["", "plain", 'say "hi"', "a, b", "two\nlines", '"', '""', "\n\n", "  pad ", 'x"y', "end\\", "é漢字", ',"', '",', "1\r\n2", "'"]


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda n: [spark.conf.set(c, str(n)) for c in names]
    for c in names:
        spark.conf.unset(c)


def _file(path, header, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(out.getvalue().encode("utf-8-sig" if path.name < "b" else "utf-8"))


def _expected(folder):
    out = []
    for path in sorted(folder.rglob("*.csv")):
        with path.open(encoding="utf-8-sig", newline="") as f:
            out += [tuple(r.get(c) or None for c in FIELDS) for r in csv.DictReader(f)]
    return out


def _read(spark, folder):
    rows = read_registry_csv(spark, str(folder), split_above=0).collect()
    rows.sort(key=lambda r: tuple(r._ord))
    return [tuple(r[c] or None for c in FIELDS) for r in rows]


@pytest.mark.parametrize("size", [61, 200, 1000, 10**6])
def test_ranges_against_python(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    rows = lambda n: [[f"U{k}", rng.choice(VALUES) + rng.choice(VALUES), rng.choice(VALUES)] for k in range(n)]
    _file(tmp_path / "a.csv", FIELDS, rows(120))
    _file(tmp_path / "b.csv", FIELDS[::-1], rows(60), "\r\n")
    _file(tmp_path / "c" / "c.csv", FIELDS, [["U", "x\n" * 400, "y"], *rows(5), ["V", "", 'z"\n' * 90], *rows(20)])
    _file(tmp_path / "d.csv", FIELDS, [])
    small_ranges(size)
    assert _read(spark, tmp_path) == _expected(tmp_path)


def test_stray_quotes_blank_lines_and_no_last_break(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('uen,entity_name,postal_code\nU1,5" pipe,1\n\nU2,6" by 7",2\nU3,"a\n""b""",3\n\nU4,x,4')
    small_ranges(20)
    got = _read(spark, tmp_path)
    assert got == _expected(tmp_path)
    assert got[2] == ("U3", 'a\n"b"', "3") and len(got) == 4


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    _file(tmp_path / "a.csv", FIELDS, [[f"U{k}", "two\nlines", "1"] for k in range(3000)])
    small_ranges(4096)
    raw = read_registry_csv(spark, str(tmp_path), split_above=0)
    assert raw.rdd.getNumPartitions() > 8 and raw.count() == 3000


def test_malformed_and_repeated_header(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("uen,entity_name,uen\nlost,a,U1\nlost,b,U2,extra\nlost\nlost,c,U3\n")
    small_ranges(16)
    for above in (0, None):
        raw = read_registry_csv(spark, str(tmp_path), split_above=above)
        rows = sorted(raw.collect(), key=lambda r: tuple(r._ord))
        assert [(r.uen, r.entity_name, r[CORRUPT] is not None) for r in rows] == [
            ("U1", "a", False), ("U2", "b", True), (None, None, True), ("U3", "c", False)]
        stopped = read_registry_csv(spark, str(tmp_path), stop_at_first_error=True, split_above=above)
        assert [r.uen for r in stopped.collect()] == ["U1"]


def test_ends_inside():
    rng = random.Random(3)
    for _ in range(3000):
        line = "".join(rng.choice('",a') for _ in range(rng.randrange(9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line + "\n" + '"'
            fields = next(csv.reader(io.StringIO(text, newline="")))
            assert ends_inside(line, inside) == ("\n" in (fields or [""])[-1]), (line, inside)
