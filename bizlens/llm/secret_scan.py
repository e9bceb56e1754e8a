"""Secret scans.

Three plain patterns find what announces itself: an assignment to a telling name, an
access key id, a long lower-case hexadecimal run. Secrets without such a mark are
found by their disorder: in every candidate, a maximal run of one character class, a
window of ``WINDOW`` characters slides along while the counts of its characters, and
with them its Shannon entropy, are updated by the character that enters and the one
that leaves. Windows at or above the class's threshold that hold a letter and a digit
are joined to spans. A candidate that the allow-list matches as a whole (documented
samples, sequences, unique ids, slugs) yields none, and a span that meets one of a plain
pattern adds nothing to it.

The entropy sums are held in fixed point, so they do not drift along a long candidate
and a window's verdict does not depend on where the candidate began.

Defined cases: null and empty texts have no spans; repeated rows and rows without
doc_id are scanned one by one; candidates may be as long as the text; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import as_bytes, map_batches, table

#: The patterns of the contract and the least lengths of what they find.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "entropy")

#: Characters in the sliding window.
WINDOW = 20
#: Character classes and the entropy (bits a character) a window of theirs needs.
CLASSES = ((rb"[0-9a-fA-F]", 3.0), (rb"[A-Za-z0-9+/=_-]", 3.7))
#: Candidates that are no secrets, matched as a whole.
ALLOW = (
    r".*(?:EXAMPLE|[Ee]xample|[Ss]ample|[Pp]laceholder|[Cc]hange_?me|[Xx]{6}).*",
    r".*(?:0123456789|123456789|[Aa]bcdefgh|ABCDEFGH|qwertyuiop).*",
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"[-_/+=]*(?:[A-Za-z]+|[0-9]{1,8})(?:[-_/+=]+(?:[A-Za-z]+|[0-9]{1,8}))+[-_/+=]*",
)

_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX[:-1] + b"{%d,}" % MIN_HEX)
_RUNS = [re.compile(c + b"{%d,}" % WINDOW) for c, _ in CLASSES]
#: Every candidate character to 1, any other to 0: long runs are found by one search.
_MASK = bytes(bool(re.match(CLASSES[1][0], bytes([c]))) for c in range(256))
_LONG = b"\1" * WINDOW
_DIGIT = bytes(48 <= c <= 57 for c in range(256))
_LETTER = bytes(65 <= c <= 90 or 97 <= c <= 122 for c in range(256))
_UNIT = 1 << 40
#: n log2 n in fixed point, for the counts a window can hold.
_WEIGHT = [0, *(round(n * math.log2(n) * _UNIT) for n in range(1, WINDOW + 2))]


def plain_spans(text: bytes) -> list[tuple[int, int, int]]:
    """start, kind, end of what the plain patterns find, in bytes."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if _LONG in text.translate(_MASK):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def disordered(candidate: bytes, threshold: float) -> Iterator[tuple[int, int]]:
    """Joined windows of ``candidate`` whose entropy reaches ``threshold``."""
    most = (math.log2(WINDOW) - threshold) * WINDOW * _UNIT
    counts = [0] * 256
    total = digits = letters = 0
    start = end = -1
    for k, c in enumerate(candidate):
        n = counts[c]
        counts[c] = n + 1
        total += _WEIGHT[n + 1] - _WEIGHT[n]
        digits += _DIGIT[c]
        letters += _LETTER[c]
        if k >= WINDOW:
            c = candidate[k - WINDOW]
            n = counts[c]
            counts[c] = n - 1
            total -= _WEIGHT[n] - _WEIGHT[n - 1]
            digits -= _DIGIT[c]
            letters -= _LETTER[c]
        if k >= WINDOW - 1 and total <= most and digits and letters:
            if k - WINDOW + 1 > end:
                if end >= 0:
                    yield start, end
                start = k - WINDOW + 1
            end = k + 1
    if end >= 0:
        yield start, end


def entropy_spans(text: bytes, allow: re.Pattern | None) -> list[tuple[int, int]]:
    """Disordered spans of candidates that are not allow-listed, in bytes."""
    if _LONG not in text.translate(_MASK):
        return []
    found = []
    for runs, (_, threshold) in zip(_RUNS, CLASSES):
        for m in runs.finditer(text):
            spans = list(disordered(m.group(), threshold))
            if spans and not (allow and allow.fullmatch(m.group())):
                found += [(m.start() + a, m.start() + b) for a, b in spans]
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def scan(text: bytes | None, allow: re.Pattern | None) -> list[tuple[str, int, int]]:
    """kind, start, end (code points, end exclusive) by start, then kind."""
    if not text:
        return []
    found = plain_spans(text)
    extra, k, reach = [], 0, 0
    for a, b in entropy_spans(text, allow):
        while k < len(found) and found[k][0] < b:
            reach = max(reach, found[k][2])
            k += 1
        if reach <= a:
            extra.append((a, len(KINDS) - 1, b))
    found = sorted(found + extra)
    if text.isascii():
        return [(KINDS[kind], a, b) for a, kind, b in found]
    points, at, n = {}, 0, 0
    for place in sorted({p for a, _, b in found for p in (a, b)}):
        n += len(text[at:place].decode())
        at = place
        points[place] = n
    return [(KINDS[kind], points[a], points[b]) for a, kind, b in found]


def find(docs: DataFrame, allow: Sequence[str] = ALLOW) -> DataFrame:
    """doc_id, spans (kind, start, end in code points of the text) of every document.
    ``allow``: patterns of candidates that are no secrets."""
    patterns = "|".join(f"(?:{p})" for p in allow).encode()

    def make():
        allowed = re.compile(patterns) if patterns else None

        def step(batch):
            found = [scan(t, allowed) for t in as_bytes(batch.column(1))]
            keys = ("kind", "start", "end")
            return [batch.column(0), [[dict(zip(keys, s)) for s in spans] for spans in found]]

        return step

    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, make)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _places(kind: str, pattern: str, length: str) -> str:
    """Matches of a pattern and where they start: what lies between them tells."""
    return f"""SELECT doc_id, '{kind}' AS kind, unnest(m) AS s, unnest({length}) AS n, unnest(list_transform(range(1, len(m) + 1),
      lambda i: CAST(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) AS BIGINT)
        + coalesce(CAST(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))) AS BIGINT), 0))) AS a
    FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM texts
      WHERE regexp_matches(t, '{pattern}'))"""


_ANY_CASE = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name).replace("_", "_?")
    for name in ("password", "passwd", "secret", "token", "api_key")
)
_SQL_ASSIGN = rf"({_ANY_CASE})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
_SQL_ALLOW = "|".join(f"(?:{p})" for p in ALLOW)

OP11_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
plain AS (
  SELECT doc_id, kind, a, a + length(s) AS b FROM ({_places("assign", _SQL_ASSIGN, f"list_transform(regexp_extract_all(t, '{_SQL_ASSIGN}', 2), lambda x: length(x))")}) WHERE n >= {MIN_ASSIGN}
  UNION ALL SELECT doc_id, kind, a, a + n FROM ({_places("access", ACCESS.decode(), "list_transform(m, lambda x: length(x))")}) WHERE n >= {MIN_ACCESS}
  UNION ALL SELECT doc_id, kind, a, a + n FROM ({_places("hex", HEX.decode()[:-1] + "{32,}", "list_transform(m, lambda x: length(x))")}) WHERE n >= {MIN_HEX}),
runs AS (
  SELECT *, {CLASSES[0][1]} AS least FROM ({_places("entropy", CLASSES[0][0].decode() + "{20,}", "list_transform(m, lambda x: length(x))")})
  UNION ALL SELECT *, {CLASSES[1][1]} FROM ({_places("entropy", CLASSES[1][0].decode() + "{20,}", "list_transform(m, lambda x: length(x))")})),
windows AS (
  SELECT doc_id, a + i AS a, a + i + {WINDOW} AS b, substr(s, i + 1, {WINDOW}) AS w, least
  FROM (SELECT *, unnest(range(n - {WINDOW} + 1)) AS i FROM runs WHERE NOT regexp_full_match(s, '{_SQL_ALLOW}'))),
dense AS (
  SELECT DISTINCT doc_id, a, b FROM windows
  WHERE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND list_entropy(string_split(w, '')) >= least),
starts AS (
  SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new
  FROM dense),
islands AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (
    SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM starts) GROUP BY doc_id, island),
spans AS (
  SELECT doc_id, kind, a, b, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS k FROM plain
  UNION ALL SELECT doc_id, 'entropy', a, b, 3 FROM islands i
  WHERE NOT EXISTS (SELECT 1 FROM plain p WHERE p.doc_id = i.doc_id AND p.a < i.b AND p.b > i.a)),
joined AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3,
    string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k) FILTER (k < 3) AS base,
    string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, coalesce(n3, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined USING (doc_id)
"""
