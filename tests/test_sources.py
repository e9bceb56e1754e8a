"""S1 by-name union (reordered headers, missing column, BOM), arrival order,
stop at the first malformed line; S2 pages; T1 end to end."""

import csv
import json

from bizlens.operators.clean import clean_record
from bizlens.operators.dedup import dedup_keep_latest
from bizlens.plans.pipelines import clean_registry
from bizlens.sources.api_pages import page_audit, page_records, read_pages
from bizlens.sources.registry_csv import read_registry_csv, read_ssic_csv, write_clean


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("utf-8"))


def test_read_by_name_and_order(spark, tmp_path):
    _write(tmp_path / "A.csv", "﻿uen,entity_name,registration_incorporation_date,postal_code\n"
           "U1,First,2020-01-01,S1234\nU2,Two,2020-01-01,\n")
    _write(tmp_path / "B.csv", "postal_code,registration_incorporation_date,uen,extra\n"
           "99,2020-01-01,U1,zzz\n88,2021-05-05,U2,zzz\n")
    raw = read_registry_csv(spark, str(tmp_path))
    rows = {(r.uen, r.postal_code): r for r in raw.collect()}
    assert rows[("U1", "99")].entity_name is None          # column missing in B.csv
    assert rows[("U1", "S1234")].entity_name == "First"    # BOM stripped from the first header
    out = clean_registry(raw)["clean"].collect()
    got = {r.uen: (r.entity_name, r.postal_code) for r in out}
    # Equal dates -> first seen (A.csv) kept; U2: later date in B.csv wins
    assert got == {"U1": ("First", "001234"), "U2": (None, "000088")}


def test_arrival_order_within_file(spark, tmp_path):
    lines = "\n".join(f"K,{i},2020-01-01" for i in range(2000))
    _write(tmp_path / "one.csv", "uen,entity_name,registration_incorporation_date\n" + lines + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = read_registry_csv(spark, str(tmp_path))
        kept = dedup_keep_latest(clean_record(raw, carry=("_ord",)), "uen",
                                 "registration_incorporation_date", "_ord").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert kept.entity_name == "0"


def test_malformed_lines(spark, tmp_path):
    _write(tmp_path / "a.csv", "uen,entity_name\nU1,a,extra\nU2\nU3,c\n")
    _write(tmp_path / "b.csv", "uen,entity_name\nU4,d\n")
    kept = {r.uen: (r.entity_name, r._corrupt is not None) for r in read_registry_csv(spark, str(tmp_path)).collect()}
    assert kept == {"U1": ("a", True), "U2": (None, True), "U3": ("c", False), "U4": ("d", False)}
    stopped = sorted(r.uen for r in read_registry_csv(spark, str(tmp_path), stop_at_first_error=True).collect())
    assert stopped == ["U4"]


def test_ssic_csv_upper_headers(spark, tmp_path):
    _write(tmp_path / "ssic.csv", "SSIC_CODE,SSIC_DESCRIPTION,SECTION,DIVISION\n111,Growing,A,01\nNA,x,B,02\n")
    rows = read_ssic_csv(spark, str(tmp_path / "ssic.csv")).collect()
    assert [(r.ssic_code, r.ssic_description) for r in rows] == [("00111", "Growing"), (None, "x")]
    raw = read_ssic_csv(spark, str(tmp_path / "ssic.csv"), pad_codes=False).collect()
    assert raw[0].ssic_code == "111"


def test_api_pages(spark, tmp_path):
    pages = [
        {"resource_id": "r1", "offset": 0, "success": True, "result": {"total": 3, "records": [
            {"uen": "U1", "entity_name": "A", "junk": "x"}, {"uen": "U2", "entity_name": "B"}]}},
        {"resource_id": "r1", "offset": 2, "success": False, "error": "boom", "result": None},
        {"resource_id": "r1", "offset": 2, "success": True, "result": {"total": 3, "records": [{"uen": "U3"}]}},
    ]
    _write(tmp_path / "p.json", "\n".join(json.dumps(p) for p in pages) + "\n")
    df = read_pages(spark, str(tmp_path / "p.json"))
    recs = page_records(df).collect()
    assert sorted(r.uen for r in recs) == ["U1", "U2", "U3"] and "junk" not in page_records(df).columns
    a = page_audit(df).first()
    assert (a.total_rows, a.fetched_rows, a.first_offset, a.last_offset, a.failed_pages) == (3, 3, 0, 2, 1)


def test_spark_reader_paths_for_uris(spark, tmp_path):
    """Shared-storage URIs go through Spark's JSON reader and give the same rows."""
    from bizlens.sources.geojson import PACKAGED_ZONES, SUBZONE_MATCH_KEYS, match_layer, read_features, subzone_dim
    from bizlens.sources.taxonomy import PACKAGED, categories, read_taxonomy, sectors

    shipped = read_features(spark, PACKAGED_ZONES)
    assert shipped.count() == subzone_dim(shipped).count() > match_layer(shipped, SUBZONE_MATCH_KEYS).count() > 0
    assert categories(read_taxonomy(spark, PACKAGED)).count() == categories(read_taxonomy(spark)).count() > 0
    missing = read_taxonomy(spark, str(tmp_path / "none.json"))
    assert categories(missing).count() == sectors(missing).count() == 0
    # typed ids: a numeric 0 names a dimension row but no layer to match; blank and missing ids
    _write(tmp_path / "z.geojson", json.dumps({"type": "FeatureCollection", "features": [
        {"properties": {"SUBZONE_C": 0, "SUBZONE_N": "Zero"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}},
        {"properties": {"SUBZONE_C": "0", "n": 1.5, "b": True}, "geometry": None},
        {"properties": {"SUBZONE_C": "", "SUBZONE_N": "Blank"}, "geometry": None},
        {"properties": None, "geometry": None},
        {"properties": {"id": 7}, "geometry": None},
    ]}))
    feats = read_features(spark, str(tmp_path / "z.geojson"))
    rows = feats.orderBy("seq").collect()
    assert rows[0].properties == {"SUBZONE_C": "0", "SUBZONE_N": "Zero"} and rows[0].falsy_keys == ["SUBZONE_C"]
    assert json.loads(rows[0].geometry) == {"type": "Point", "coordinates": [1.5, 2]} and rows[1].geometry is None
    assert rows[1].properties == {"SUBZONE_C": "0", "n": "1.5", "b": "True"} and rows[1].falsy_keys == []
    assert [r.subzone_id for r in subzone_dim(feats).orderBy("seq").collect()] == ["0", "0", "Blank", "unknown", "7"]
    assert [(r.seq, r.feature_id) for r in match_layer(feats, SUBZONE_MATCH_KEYS).orderBy("seq").collect()] == [
        (1, "0"), (4, "7")]


AWKWARD = [
    ("U1", 'ACME "BEST" PTE', "1"), ("U2", 'A "B", C LTD', "456"), ("U3", "BACK\\", "789"),
    ("U4", "TWO\nLINES", "12"), ("U5", "  padded ", "3"), ("U6", "", "4"), ("U7", 'half"quote', "5"),
]


def test_reads_what_the_csv_module_writes(spark, tmp_path):
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([("uen", "entity_name", "postal_code"), *AWKWARD])
    got = {r.uen: (r.entity_name or "", r.postal_code) for r in read_registry_csv(spark, str(tmp_path)).collect()}
    assert got == {u: (n, p) for u, n, p in AWKWARD}


def test_csv_module_reads_what_is_written(spark, tmp_path):
    rows = [*AWKWARD, ("U8", None, "6")]
    write_clean(spark.createDataFrame(rows, "uen string, entity_name string, postal_code string").coalesce(1),
                str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    text = part.read_text(encoding="utf-8")
    with open(part, newline="", encoding="utf-8") as f:
        got = {r["uen"]: (r["entity_name"], r["postal_code"]) for r in csv.DictReader(f)}
    assert got == {u: (n or "", p) for u, n, p in rows}
    assert '"ACME ""BEST"" PTE"' in text and "U6,,4" in text and "U8,,6" in text
