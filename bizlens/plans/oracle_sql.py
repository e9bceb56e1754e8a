"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The driver runs these against the same parquet tables (views named after
the tables). The CTEs below restate, in plain SQL, the derived registry
frames of ``bizlens.sources.tpch`` and the cleaning rules of
``bizlens.functions.cleaning``.
"""

from __future__ import annotations

_ISO = (
    r"(?s)^(\d{4}-\d{2}-\d{2}|\d{8})(.([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?|[0-5]\d([0-5]\d([.,]\d+)?)?)?"
    r"(Z|[+-]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d)?|[0-5]\d([0-5]\d)?)?)?)?$"
)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def na(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN lower({s}) IN ('', 'na') THEN NULL ELSE {s} END)"


def postal(x: str) -> str:
    d = f"regexp_replace({na(x)}, '[^0-9]', '', 'g')"
    return f"(CASE WHEN length({d}) BETWEEN 1 AND 6 THEN lpad({d}, 6, '0') END)"


def ssic(x: str) -> str:
    t = na(x)
    return f"(CASE WHEN regexp_full_match({t}, '[0-9]+') AND length({t}) < 5 THEN lpad({t}, 5, '0') ELSE {t} END)"


def iso_date(x: str) -> str:
    t = na(x)
    digits = f"replace(regexp_extract({t}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{8}})', 1), '-', '')"
    return (
        f"(CASE WHEN regexp_matches({t}, '{_ISO}') AND NOT starts_with({t}, '0000') "
        f"THEN CAST(try_strptime({digits}, '%Y%m%d') AS DATE) END)"
    )


def ssic_norm(x: str) -> str:
    return (
        f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
        f"WHEN regexp_full_match({x}, '[0-9]+') AND length({x}) < 5 THEN lpad({x}, 5, '0') ELSE {x} END)"
    )


def month(d: str) -> str:
    return f"CAST(coalesce(year({d}) * 100 + month({d}), 0) AS INTEGER)"


EXTRACT = """
ext AS (
  SELECT (CASE WHEN length(CAST(l_orderkey AS VARCHAR)) < 8 THEN lpad(CAST(l_orderkey AS VARCHAR), 8, '0')
               ELSE CAST(l_orderkey AS VARCHAR) END) || 'K' AS uen,
         CASE l_linenumber
           WHEN 1 THEN 'ORDER "' || CAST(l_orderkey AS VARCHAR) || '" LINE ' || CAST(l_linenumber AS VARCHAR)
           WHEN 2 THEN 'ORDER ' || CAST(l_orderkey AS VARCHAR) || ', LINE ' || CAST(l_linenumber AS VARCHAR)
           WHEN 3 THEN 'ORDER ' || CAST(l_orderkey AS VARCHAR) || ' LINE ' || CAST(l_linenumber AS VARCHAR) || chr(92)
           WHEN 4 THEN 'ORDER ' || CAST(l_orderkey AS VARCHAR) || chr(10) || 'LINE ' || CAST(l_linenumber AS VARCHAR)
           WHEN 5 THEN '  ORDER ' || CAST(l_orderkey AS VARCHAR) || ' LINE ' || CAST(l_linenumber AS VARCHAR) || ' '
           ELSE 'ORDER ' || CAST(l_orderkey AS VARCHAR) || ' LINE ' || CAST(l_linenumber AS VARCHAR) END AS entity_name,
         ' ' || l_linestatus AS entity_status_description,
         l_returnflag AS entity_type_description,
         CASE WHEN l_quantity > 25 THEN ' Sole Proprietor ' ELSE 'NA' END AS business_constitution_description,
         CASE WHEN l_discount > 0.05 THEN 'Exempt Private' ELSE '' END AS company_type_description,
         CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y%m%d')
              ELSE strftime(l_shipdate, '%Y-%m-%d') END AS registration_incorporation_date,
         strftime(l_shipdate, '%Y-%m-%d') || 'T00:00:00+08:00' AS uen_issue_date,
         CAST(l_partkey AS VARCHAR) AS primary_ssic_code,
         CAST(l_suppkey AS VARCHAR) AS secondary_ssic_code,
         'S' || CAST(l_suppkey AS VARCHAR) AS postal_code,
         l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus
  FROM lineitem
)"""

ORDER_COLS = "l_linenumber, l_partkey, l_suppkey"


def clean_cols(src: str = "") -> str:
    p = f"{src}." if src else ""
    return f"""
    {na(p + 'uen')} AS uen,
    {na(p + 'entity_name')} AS entity_name,
    {na(p + 'entity_status_description')} AS entity_status_description,
    {na(p + 'entity_type_description')} AS entity_type_description,
    {na(p + 'business_constitution_description')} AS business_constitution_description,
    {na(p + 'company_type_description')} AS company_type_description,
    {iso_date(p + 'registration_incorporation_date')} AS registration_incorporation_date,
    {iso_date(p + 'uen_issue_date')} AS uen_issue_date,
    {ssic(p + 'primary_ssic_code')} AS primary_ssic_code,
    {ssic(p + 'secondary_ssic_code')} AS secondary_ssic_code,
    {postal(p + 'postal_code')} AS postal_code"""


CLEAN = f"""
cln AS (
  SELECT {clean_cols()}, {ORDER_COLS}
  FROM ext
)"""

RAW = """
raw AS (
  SELECT uen, coalesce(entity_name, '') AS entity_name,
         coalesce(entity_status_description, '') AS entity_status_description,
         coalesce(entity_type_description, '') AS entity_type_description,
         coalesce(business_constitution_description, '') AS business_constitution_description,
         company_type_description, registration_incorporation_date, uen_issue_date,
         primary_ssic_code, secondary_ssic_code, postal_code
  FROM cln WHERE uen IS NOT NULL AND uen <> ''
)"""

GEO = """
geo AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS postal_code,
         s_acctbal / 1000.0 AS latitude,
         CAST(s_nationkey AS DOUBLE) AS longitude,
         n_name AS subzone_id,
         r_name AS planning_area_id,
         TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_acctbal >= 0
)"""

LATEST_GEO = """
lgeo AS (
  SELECT postal_code, latitude, longitude, subzone_id, planning_area_id FROM (
    SELECT *, row_number() OVER (PARTITION BY postal_code
        ORDER BY updated_at DESC, latitude DESC NULLS LAST, longitude DESC NULLS LAST,
                 subzone_id DESC NULLS LAST, planning_area_id DESC NULLS LAST) AS rn
    FROM geo) WHERE rn = 1
)"""

ENRICHED = f"""
fact AS (
  SELECT r.uen, r.entity_name, r.entity_status_description, r.entity_type_description,
         r.business_constitution_description, r.company_type_description,
         r.registration_incorporation_date, r.uen_issue_date,
         r.primary_ssic_code, r.secondary_ssic_code,
         {ssic_norm('r.primary_ssic_code')} AS primary_ssic_norm,
         {ssic_norm('r.secondary_ssic_code')} AS secondary_ssic_norm,
         r.postal_code,
         {month('r.registration_incorporation_date')} AS registration_month,
         g.latitude, g.longitude, g.subzone_id, g.planning_area_id
  FROM raw r LEFT JOIN lgeo g ON r.postal_code = g.postal_code
)"""

SUBZONE = """
subzone AS (
  SELECT n_name AS subzone_id,
         upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS name,
         r_name AS planning_area_id,
         '{"type":"Polygon","coordinates":[[[' || n_nationkey || ',' || n_regionkey || '],['
           || (n_nationkey + 1) || ',' || n_regionkey || '],[' || (n_nationkey + 1) || ',' || (n_regionkey + 1)
           || '],[' || n_nationkey || ',' || (n_regionkey + 1) || '],[' || n_nationkey || ',' || n_regionkey
           || ']]]}' AS geometry
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

SSIC_DIM = f"""
ssic_dim AS (
  SELECT {ssic('CAST(p_partkey AS VARCHAR)')} AS ssic_code, {na('p_name')} AS ssic_description,
         {na('p_type')} AS section, {na('p_brand')} AS division
  FROM part
)"""


def with_fact(*extra: str) -> str:
    """WITH clause defining ext, cln, raw, geo, lgeo, fact (+ extras)."""
    parts = [EXTRACT, CLEAN, RAW, GEO, LATEST_GEO, ENRICHED, *extra]
    return "WITH " + ",".join(parts)


def date_window(lo: str, hi: str, col: str = "registration_incorporation_date") -> str:
    return f"{col} BETWEEN DATE '{lo}' AND DATE '{hi}'"


def taxonomy_ctes(path: str) -> str:
    """tax, cats (pos, id, label, sector, keywords, ssic), secs, pats."""
    return f"""
tax AS (SELECT * FROM read_json('{path}', format = 'auto')),
cats AS (
  SELECT pos - 1 AS pos, c.id AS id, c.label AS label, c.sector AS sector,
         coalesce(c.keywords, []) AS keywords, coalesce(c.ssic, []) AS ssic
  FROM (SELECT unnest(categories) AS c, generate_subscripts(categories, 1) AS pos FROM tax)),
secs AS (SELECT s.id AS id, s.label AS label FROM (SELECT unnest(sectors) AS s FROM tax)),
pats AS (SELECT id AS category_id, unnest(ssic) AS pattern FROM cats)"""


TERMS = """
terms AS (
  SELECT DISTINCT query FROM (
    SELECT unnest(string_split(p_name, ' ')) AS query FROM part
    UNION ALL SELECT p_name FROM part
    UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part))"""


# ------------------------------------------------------------- questions ---

_UEN_SQL = ("(CASE WHEN length(CAST({k} AS VARCHAR)) < 8 THEN lpad(CAST({k} AS VARCHAR), 8, '0') "
            "ELSE CAST({k} AS VARCHAR) END) || 'K'")

QUESTIONS = f"""
nr AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
qs AS (
  SELECT 'region:' || r_regionkey || ':1' AS question_id, 'Top SSICs in ' || r_name || ' last 12 months' AS question FROM region
  UNION ALL SELECT 'region:' || r_regionkey || ':2', 'Trend of new entities in ' || r_name || ' since 1998' FROM region
  UNION ALL SELECT 'region:' || r_regionkey || ':3', 'Where are ssic 00' || r_regionkey || ' companies hottest in 2000' FROM region
  UNION ALL SELECT 'region:' || r.r_regionkey || ':4', 'Compare ' || r.r_name || ' vs ' || coalesce(r2.r_name, 'AFRICA')
         || ' for new F&B entities' FROM region r LEFT JOIN region r2 ON r2.r_regionkey - 1 = r.r_regionkey
  UNION ALL SELECT 'region:' || r_regionkey || ':5', 'Why the spike in ' || r_name || ' 2000 to 1998' FROM region
  UNION ALL SELECT 'region:' || r_regionkey || ':6', 'Show uen details for ' || r_name FROM region
  UNION ALL SELECT 'region:' || r_regionkey || ':7', 'compare * vs ' || r_name || ' last 3650 days' FROM region
  UNION ALL SELECT 'region:' || r_regionkey || ':8', 'compare ' || r_name || ' vs ' || r_name || ' from 1970 to 2000' FROM region
  UNION ALL SELECT 'nation:' || n_nationkey || ':1', 'New entities with ssic 0' || n_nationkey || ' in ' || r_name
         || ' last 6 months' FROM nr
  UNION ALL SELECT 'nation:' || n_nationkey || ':2', 'Top industries for ' || r_name || ' 1999 and 2001' FROM nr
  UNION ALL SELECT 'nation:' || n_nationkey || ':3', 'compare ' || r_name || ' vs ' || n_name || ' last 3 months' FROM nr
  UNION ALL SELECT 'order:' || o_orderkey, 'Show uen ' || lower({_UEN_SQL.format(k='o_orderkey')}) || ' details' FROM orders
  UNION ALL SELECT 'conv:' || conv_id || ':' || turn, text FROM conversations WHERE role = 'user'
)"""

_NB = r"(?:^|[^\p{L}\p{N}_])"
_AREA_RE = _NB + r"(in|for)\s+([A-Za-z ]+?)(?:\s+last|\s+since|\s+from|\s+to|\s+[0-9]{4}|$)"
_COMPARE_RE = r"(?i)compare\s+(.+?)\s+vs\s+(.+?)(?:\s+for|\s+last|\s+since|\s+[0-9]{4}|$)"
_VS_RE = r"(?i)(.+?)\s+vs\s+(.+?)(?:\s+for|\s+last|\s+since|\s+[0-9]{4}|$)"
_SSIC_RE = _NB + r"ssic\s*([0-9]{2,5})(?:$|[^\p{L}\p{N}_])"

_KEYWORDS = [("f&b", "56"), ("food", "56"), ("restaurant", "56"), ("cafe", "56"), ("retail", "47"),
             ("wholesale", "46"), ("finance", "64"), ("bank", "64"), ("insurance", "65"),
             ("software", "62"), ("it", "62"), ("tech", "62")]


def _ws_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def parse_sql(as_of: str) -> str:
    """CTEs qs, p1, p2, parsed (the N1..N8 columns)."""
    kw = " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in _KEYWORDS)
    return QUESTIONS + f""",
p1 AS (
  SELECT question_id, question, lower(question) AS t,
         regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+') AS toks
  FROM qs),
p2 AS (
  SELECT *,
    upper(list_filter(toks, lambda x: regexp_full_match(x, '[0-9]{{8}}[A-Za-z]'))[1]) AS uen_tok,
    CASE WHEN contains(t, 'uen') OR upper(list_filter(toks, lambda x: regexp_full_match(x, '[0-9]{{8}}[A-Za-z]'))[1]) IS NOT NULL
           THEN 'ENTITY_LOOKUP'
         WHEN contains(t, 'compare') OR contains(t, ' vs ') THEN 'COMPARE_AREAS'
         WHEN contains(t, 'top') AND (contains(t, 'ssic') OR contains(t, 'industry') OR contains(t, 'industries'))
           THEN 'TOP_INDUSTRIES_IN_AREA'
         WHEN contains(t, 'where') AND (contains(t, 'cluster') OR contains(t, 'hot') OR contains(t, 'hottest'))
           THEN 'HOTTEST_AREAS_FOR_INDUSTRY'
         WHEN contains(t, 'why') OR contains(t, 'spike') THEN 'EXPLAIN_CHANGE'
         ELSE 'NEW_ENTITIES_TREND' END AS intent,
    CASE WHEN contains(t, 'last 12 months') OR contains(t, 'past 12 months') OR contains(t, 'last year') THEN 365
         WHEN contains(t, 'last 6 months') THEN 180 WHEN contains(t, 'last 3 months') THEN 90
         WHEN contains(t, 'last 24 months') THEN 730 END AS rel,
    list_sort(list_transform(list_filter(toks, lambda x: regexp_full_match(x, '(19|20)[0-9]{{2}}')),
                             lambda x: CAST(x AS INTEGER))) AS ys,
    nullif(regexp_extract(question, '(?i){_SSIC_RE}', 1), '') AS ssic_tok,
    CASE {kw} END AS kw_code,
    nullif(trim(regexp_extract(question, '(?i){_AREA_RE}', 2)), '') AS area_tok,
    CASE WHEN regexp_matches(question, '{_COMPARE_RE}')
           THEN [{_ws_strip(f"regexp_extract(question, '{_COMPARE_RE}', 1)")},
                 {_ws_strip(f"regexp_extract(question, '{_COMPARE_RE}', 2)")}]
         WHEN regexp_matches(question, '{_VS_RE}')
           THEN [{_ws_strip(f"regexp_extract(question, '{_VS_RE}', 1)")},
                 {_ws_strip(f"regexp_extract(question, '{_VS_RE}', 2)")}] END AS areas_tok
  FROM p1),
p3 AS (
  SELECT *,
    CASE WHEN rel IS NOT NULL THEN DATE '{as_of}' - rel
         WHEN len(ys) > 0 THEN make_date(ys[1], 1, 1)
         ELSE DATE '{as_of}' - 720 END AS s0,
    CASE WHEN rel IS NULL AND len(ys) > 0 THEN make_date(ys[len(ys)], 12, 31) ELSE DATE '{as_of}' END AS e0,
    CASE WHEN intent = 'ENTITY_LOOKUP' AND uen_tok IS NULL THEN 'UEN not found in question'
         WHEN intent = 'COMPARE_AREAS' AND areas_tok IS NULL THEN 'Provide two areas to compare' END AS error
  FROM p2),
p4 AS (
  SELECT *, greatest(s0, e0) AS hi, least(s0, e0) AS lo0 FROM p3),
parsed AS (
  SELECT question_id, question, intent,
    CASE WHEN error IS NULL AND intent <> 'ENTITY_LOOKUP' THEN
      CASE WHEN hi - lo0 > 3650 THEN hi - 3650 ELSE lo0 END END AS start_date,
    CASE WHEN error IS NULL AND intent <> 'ENTITY_LOOKUP' THEN hi END AS end_date,
    CASE WHEN error IS NULL AND intent IN ('COMPARE_AREAS', 'HOTTEST_AREAS_FOR_INDUSTRY', 'EXPLAIN_CHANGE',
                                           'NEW_ENTITIES_TREND') THEN coalesce(ssic_tok, kw_code) END AS ssic,
    CASE WHEN error IS NULL AND intent IN ('TOP_INDUSTRIES_IN_AREA', 'EXPLAIN_CHANGE', 'NEW_ENTITIES_TREND')
         THEN area_tok END AS area,
    CASE WHEN error IS NULL AND intent = 'COMPARE_AREAS' THEN areas_tok[1] END AS area_1,
    CASE WHEN error IS NULL AND intent = 'COMPARE_AREAS' THEN areas_tok[2] END AS area_2,
    CASE WHEN error IS NULL AND intent = 'ENTITY_LOOKUP' THEN uen_tok END AS uen,
    error
  FROM p4)"""


def answers_sql() -> str:
    """CTE ans (question_id, intent, row_no, month, planning_area_id, ssic_code, count); needs parsed, fact."""
    return """,
m AS (
  SELECT q.question_id, q.intent, f.registration_month AS month, f.planning_area_id, f.primary_ssic_norm
  FROM parsed q JOIN fact f
    ON f.registration_incorporation_date BETWEEN q.start_date AND q.end_date
  WHERE q.error IS NULL AND q.intent <> 'ENTITY_LOOKUP'
    AND (q.intent NOT IN ('TOP_INDUSTRIES_IN_AREA', 'EXPLAIN_CHANGE', 'NEW_ENTITIES_TREND')
         OR q.area IS NULL OR f.planning_area_id = q.area)
    AND (q.intent <> 'COMPARE_AREAS' OR f.planning_area_id IN (q.area_1, q.area_2))
    AND (q.ssic IS NULL OR starts_with(f.primary_ssic_norm, q.ssic))),
a1 AS (
  SELECT question_id, intent, month, CAST(NULL AS VARCHAR) AS planning_area_id, CAST(NULL AS VARCHAR) AS ssic_code,
         count(*) AS count, row_number() OVER (PARTITION BY question_id ORDER BY month) AS row_no
  FROM m WHERE intent IN ('NEW_ENTITIES_TREND', 'EXPLAIN_CHANGE') GROUP BY question_id, intent, month),
a2 AS (
  SELECT question_id, intent, month, planning_area_id, CAST(NULL AS VARCHAR) AS ssic_code, count(*) AS count,
         row_number() OVER (PARTITION BY question_id ORDER BY month, planning_area_id) AS row_no
  FROM m WHERE intent = 'COMPARE_AREAS' GROUP BY question_id, intent, month, planning_area_id),
a3 AS (
  SELECT * FROM (
    SELECT question_id, intent, CAST(NULL AS INTEGER) AS month, CAST(NULL AS VARCHAR) AS planning_area_id,
           primary_ssic_norm AS ssic_code, count(*) AS count,
           row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, primary_ssic_norm ASC NULLS LAST) AS row_no
    FROM m WHERE intent = 'TOP_INDUSTRIES_IN_AREA' GROUP BY question_id, intent, primary_ssic_norm) WHERE row_no <= 10),
a4 AS (
  SELECT * FROM (
    SELECT question_id, intent, CAST(NULL AS INTEGER) AS month, planning_area_id, CAST(NULL AS VARCHAR) AS ssic_code,
           count(*) AS count,
           row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, planning_area_id ASC NULLS LAST) AS row_no
    FROM m WHERE intent = 'HOTTEST_AREAS_FOR_INDUSTRY' GROUP BY question_id, intent, planning_area_id) WHERE row_no <= 10),
ans AS (
  SELECT question_id, intent, CAST(row_no AS INTEGER) AS row_no, month, planning_area_id, ssic_code,
         CAST(count AS BIGINT) AS count FROM a1
  UNION ALL SELECT question_id, intent, CAST(row_no AS INTEGER), month, planning_area_id, ssic_code, CAST(count AS BIGINT) FROM a2
  UNION ALL SELECT question_id, intent, CAST(row_no AS INTEGER), month, planning_area_id, ssic_code, CAST(count AS BIGINT) FROM a3
  UNION ALL SELECT question_id, intent, CAST(row_no AS INTEGER), month, planning_area_id, ssic_code, CAST(count AS BIGINT) FROM a4)"""


def lookups_sql(detail_cols, detail_order: str) -> str:
    """CTE lk (question_id + detail columns); needs parsed, fact."""
    cols = ", ".join(detail_cols)
    return f""",
lk_rows AS (
  SELECT {cols} FROM (
    SELECT *, row_number() OVER (PARTITION BY uen ORDER BY {detail_order}) AS rn
    FROM fact WHERE uen IN (SELECT uen FROM parsed WHERE intent = 'ENTITY_LOOKUP' AND uen IS NOT NULL))
  WHERE rn = 1),
lk AS (
  SELECT q.question_id, {", ".join("r." + c for c in detail_cols)}
  FROM parsed q JOIN lk_rows r ON r.uen = q.uen
  WHERE q.intent = 'ENTITY_LOOKUP' AND q.uen IS NOT NULL)"""


NARRATIVES = """,
fr AS (SELECT question_id, ssic_code, planning_area_id, count FROM ans WHERE row_no = 1),
nr_rows AS (SELECT question_id, count(*) AS n_rows FROM ans GROUP BY 1),
nar AS (
  SELECT q.question_id, q.intent,
    CAST(CASE WHEN q.intent = 'ENTITY_LOOKUP' THEN CASE WHEN lk.question_id IS NOT NULL THEN 1 ELSE 0 END
         ELSE coalesce(c.n_rows, 0) END AS BIGINT) AS n_rows,
    CASE WHEN q.error IS NOT NULL THEN NULL
         WHEN q.intent = 'ENTITY_LOOKUP' THEN
           CASE WHEN lk.question_id IS NULL THEN 'No entity found for that UEN.'
                ELSE 'Found ' || coalesce(lk.entity_name, 'None') || ' ('
                     || coalesce(lk.entity_status_description, 'None') || ').' END
         WHEN coalesce(c.n_rows, 0) = 0 THEN 'No results for the selected filters.'
         WHEN q.intent = 'TOP_INDUSTRIES_IN_AREA' THEN
           'Top SSIC: ' || coalesce(fr.ssic_code, 'None') || ' with ' || CAST(fr.count AS VARCHAR) || ' new entities.'
         WHEN q.intent = 'HOTTEST_AREAS_FOR_INDUSTRY' THEN
           'Hottest planning area: ' || coalesce(fr.planning_area_id, 'None') || ' with ' || CAST(fr.count AS VARCHAR)
           || ' new entities.'
         WHEN q.intent = 'COMPARE_AREAS' THEN 'Compared areas across the selected period.'
         WHEN q.intent = 'EXPLAIN_CHANGE' THEN 'Trend data prepared; use month-by-month view to spot spikes.'
         ELSE 'Trend generated.' END AS narrative,
    q.error
  FROM parsed q LEFT JOIN fr ON fr.question_id = q.question_id
  LEFT JOIN nr_rows c ON c.question_id = q.question_id
  LEFT JOIN lk ON lk.question_id = q.question_id)"""


# --------------------------------------------------------------- spatial ---

def edges_values(path: str, id_keys) -> str:
    """VALUES rows (seq, feature_id, x1, y1, x2, y2) of a GeoJSON layer: the
    brute-force oracle's independent reading of the fixture file."""
    import json

    with open(path, encoding="utf-8") as fh:
        data = json.load(fh)
    rows = []
    for seq, f in enumerate(data.get("features", [])):
        props = f.get("properties") or {}
        fid = next((str(props[k]) for k in id_keys if props.get(k) not in (None, "")), None)
        geom = f.get("geometry") or {}
        if fid is None:
            continue
        if geom.get("type") == "Polygon":
            rings = geom["coordinates"]
        elif geom.get("type") == "MultiPolygon":
            rings = [r for poly in geom["coordinates"] for r in poly]
        else:
            rings = []
        for ring in rings:
            for (xa, ya), (xb, yb) in zip(ring, ring[1:]):
                rows.append(f"({seq}, '{fid}', {float(xa)!r}, {float(ya)!r}, {float(xb)!r}, {float(yb)!r})")
    return ",\n".join(rows)


def pip_ctes(path: str, id_keys, out_col: str, tag: str, points: str = "pts") -> str:
    """CTEs e_<tag>, t_<tag>, hit_<tag>(pid, out_col): brute-force even-odd
    test of every point of ``points`` against every edge (no WITH keyword)."""
    return f"""
e_{tag}(seq, feature_id, x1, y1, x2, y2) AS (VALUES {edges_values(path, id_keys)}),
t_{tag} AS (
  SELECT p.pid, e.seq, e.feature_id,
    sum(CASE WHEN ((e.y1 > p.y) <> (e.y2 > p.y)) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
             THEN 1 ELSE 0 END) AS n_cross,
    max(CASE WHEN (e.x2 - e.x1) * (p.y - e.y1) = (e.y2 - e.y1) * (p.x - e.x1)
              AND p.x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
              AND p.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2) THEN 1 ELSE 0 END) AS on_edge
  FROM {points} p CROSS JOIN e_{tag} e GROUP BY 1, 2, 3),
hit_{tag} AS (SELECT pid, arg_min(feature_id, seq) AS {out_col} FROM t_{tag}
              WHERE n_cross % 2 = 1 AND on_edge = 0 GROUP BY 1)"""


def pip_sql(points_cte: str, path: str, id_keys, out_col: str) -> str:
    return "WITH " + points_cte + "," + pip_ctes(path, id_keys, out_col, "x") + ", hit AS (SELECT * FROM hit_x)"


POSTAL_POINTS = """pts AS (
  SELECT lpad(CAST(vec_id AS VARCHAR), 6, '0') AS pid, CAST(embedding[1] AS DOUBLE) AS x,
         CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""
