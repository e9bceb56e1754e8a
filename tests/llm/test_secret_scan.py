"""Secret scans against plain Python and DuckDB."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import duckdb
import pandas as pd
import pytest

from bizlens.llm import secret_scan

from .helpers import LONG, SCHEMA, awkward, awkward_rows


def brute_force(text):
    text, found = text or "", []
    for kind, pattern, group, least in (
        ("assign", secret_scan.ASSIGN, 2, 8), ("access", secret_scan.ACCESS, 0, 16), ("hex", secret_scan.HEX, 0, 32),
    ):
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        for m in re.finditer(pattern.decode(), text, flags):
            if len(m.group(group)) >= least:
                found.append((m.start(), secret_scan.KINDS.index(kind), m.end()))
    covered = [False] * len(text)
    joins = [False] * (len(text) + 1)  # a window covers both sides of this place
    for cls, least in secret_scan.CLASSES:
        for m in re.finditer(cls.decode() + "+", text):
            if any(re.fullmatch(p, m.group()) for p in secret_scan.ALLOW):
                continue
            for i in range(m.start(), m.end() - 19):
                w = text[i : i + 20]
                h = -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())
                if h >= least and re.search("[0-9]", w) and re.search("[A-Za-z]", w):
                    covered[i : i + 20] = [True] * 20
                    joins[i + 1 : i + 20] = [True] * 19
    i = 0
    extra = []
    while i < len(text):
        if covered[i]:
            j = i + 1
            while j < len(text) and covered[j]:
                j += 1
            if not any(a < j and b > i for a, _, b in found):
                extra.append((i, 3, j))
            i = j
        i += 1
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(found + extra)]


def texts():
    rng = random.Random(11)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    base64 = string.ascii_letters + string.digits + "+/"
    parts = [
        lambda: pick(base64, rng.randrange(15, 60)), lambda: pick("0123456789abcdef", rng.randrange(15, 50)),
        lambda: pick("0123456789ABCDEF", rng.randrange(15, 50)), lambda: "AKIA" + pick(string.ascii_uppercase + "0123", rng.randrange(9, 20)),
        lambda: rng.choice(["Password", "api_key", "APIKEY", "token", "passwd", "seCret"]) + rng.choice(['"', "", "'"])
        + rng.choice(["", "  "]) + rng.choice("=:") + rng.choice(["", " ", " '"]) + pick(base64 + "=.-_", rng.randrange(5, 30)),
        lambda: "é漢🙂 words \n", lambda: pick("ab1", 40), lambda: "some-slug-of-2019/how-to-do-it-well-12", lambda: " plain words here ",
        lambda: "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "toſken=abcdefgh1 toKen=abcdefgh",
    ]
    out = ["".join(rng.choice(parts)() + rng.choice([" ", "", "\n", "="]) for _ in range(rng.randrange(8))) for _ in range(300)]
    return [*out, None, "", "token = short", "token=aaaaaaaa" * 3, 'Secret"  :  \'abc.def-gh\'', "AKIA" + "A" * 12, "akia" + "A" * 12]


def test_against_brute_force():
    allow = re.compile("|".join(f"(?:{p})" for p in secret_scan.ALLOW).encode())
    kinds = Counter()
    for t in texts():
        got = secret_scan.scan(None if t is None else t.encode(), allow)
        assert got == brute_force(t), t
        kinds.update(k for k, _, _ in got)
    assert min(kinds[k] for k in secret_scan.KINDS) > 10


def test_query_columns_and_sql(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secret_scan.op11(spark, str(tmp_path)).collect()}
    for i, t in rows:
        found = brute_force(t)
        line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        base = [s for s in found if s[0] != "entropy"]
        counts = Counter(k for k, _, _ in found)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert got[i].spans == line(found) and got[i].base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by DuckDB
    want = duckdb.sql(secret_scan.OP11_SQL).df()
    for r in want.itertuples():
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex, g.n_entropy, g.base_sha256, g.spans) == (
            r.n_assign, r.n_access, r.n_hex, r.n_entropy, r.base_sha256, r.spans)


def test_allow_list_is_a_parameter(spark):
    text = "key aB3dE5gH7jK9mN1pQ2rS4tU6 end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(s) for s in secret_scan.find(docs).first().spans] == [("entropy", 4, 28)]
    assert secret_scan.find(docs, [r"aB3dE5.*"]).first().spans == []
    assert len(secret_scan.find(docs, []).first().spans) == 1


def test_awkward_rows(spark):
    got = secret_scan.find(awkward(spark)).collect()
    assert len(got) == len(awkward_rows()) and all(r.spans == [] for r in got)
    assert secret_scan.find(spark.createDataFrame([], SCHEMA)).count() == 0
    assert secret_scan.scan((LONG * 3).encode(), None) == []
    run = "a1B2c3D4e5F6g7H8i9J0" * 20_000  # one candidate as long as the text
    assert secret_scan.scan(run.encode(), None) == [("entropy", 0, len(run))]
    assert secret_scan.scan(b"token" + b" " * 200_000 + b"x", None) == []


@pytest.mark.parametrize("least", [c[1] for c in secret_scan.CLASSES])
def test_threshold_is_no_reachable_entropy(least):
    def sums(left, most):
        if not left:
            yield ()
        for n in range(min(left, most), 0, -1):
            yield from ((n, *rest) for rest in sums(left - n, n))

    assert min(abs(sum(n / 20 * math.log2(20 / n) for n in p) - least) for p in sums(20, 20)) > 1e-6
