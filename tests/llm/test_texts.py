"""Line and suffix dedup, decontamination and quality counts against plain Python."""

import random
import re

import numpy as np

from bizlens.llm import decontaminate, lines, quality, suffixes

from .helpers import lowered, space_words, without_repeats


def _repetitive(seed):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choice("abé d\n") for _ in range(k))
    shared = [piece(k) for k in (150, 199, 200, 201, 260, 700)]
    texts = ["".join(piece(rng.randrange(300)) + (rng.choice(shared) if rng.random() < 0.6 else "") for _ in range(4)) for _ in range(40)]
    return texts + texts[:3] + ["the same " * 90, "the same " * 40, "x" * 1000, "x" * 199, None, "", shared[-1]]


def test_suffixes_against_brute_force(spark):
    texts = _repetitive(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffixes.dedup(docs).collect()}
    for i, want in enumerate(without_repeats(texts, suffixes.LENGTH)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        assert sum(s["end"] - s["start"] for s in r.spans) == r.n_removed


def test_runs_across_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    whole = suffixes.runs(text)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    pieces = suffixes.runs(text)
    spread = lambda r: np.repeat(r[2], r[1] - r[0] + 1)  # noqa: E731  the anchor of each start
    assert (spread(whole) == spread(pieces)).all()


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    style = lambda s: rng.choice([s, s.upper(), "  " + s.replace(" ", "  ")])
    rows = [(i, "\n".join(style(rng.choice(pool)) for _ in range(rng.randrange(6)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen: set = set()
    for r, (i, text) in zip(sorted(lines.dedup(docs).collect()), sorted(rows)):
        kept, spans, at = [], [], 0
        for line in text.split("\n") if text else []:
            norm = " ".join(space_words(lowered(line)))
            if len(norm.split()) >= lines.MIN_WORDS and norm in seen:
                spans.append((at, at + len(line)))
            else:
                kept.append(line)
                seen.add(norm)
            at += len(line) + 1
        assert (r.doc_id, r.text, [(s["start"], s["end"]) for s in r.removed]) == (i, "\n".join(kept), spans)


def test_lines_without_spaces_and_passages_of_short_lines(spark):
    han, thai, wide = "今天天气很好我们一起去公园散步", "วันนี้อากาศดีมากเราไปเดินเล่น", "x" * lines.MIN_CHARS
    verse = [f"verse {k} of the song" for k in range(12)]  # 60 words, five to a line
    words = [f"item{k}" for k in range(60)]
    rows = [
        (1, "\n".join([han, thai, wide, "你好", *verse, "a long line that is only in the first text"])),
        (2, "\n".join([wide, "你好", thai, "other words stand here", *verse[:5], "", *verse[5:], "and there", han])),
        (3, "\n".join(words)), (4, "\n".join(["before", *words, "behind"])), (5, "\n".join(verse[:9])),
        (6, "\n".join(verse[:9])), (7, "\n".join(["again"] * 120)), (8, "\n".join([han] * 3)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lines.dedup(docs).collect()}
    for i, text in rows:
        left = "".join(c for k, c in enumerate(text) if not any(s["start"] <= k < s["end"] for s in got[i].removed))
        assert left.replace("\n", "") == got[i].text.replace("\n", "")
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "你好\nother words stand here\nand there"
    assert got[4].text == "before\nbehind"
    assert got[5].text == rows[4][1] and got[6].text == rows[5][1]  # 45 words: below RUN_WORDS
    assert got[7].text == "\n".join(["again"] * lines.RUN_WORDS)  # the first passage stays whole
    assert got[8].text == ""


def test_decontamination_in_blocks(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 30)))) for i in range(30)]
    texts = [" ".join(f"W{rng.randrange(40)}," for _ in range(50)) + rng.choice(items)[1].title() for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in (row for k in (10**6, 60) for row in decontaminate.report(docs, bench, block_words=k).collect()):
        w = word.findall(lowered(texts[r.doc_id]))
        hit, found = set(), set()
        for item_id, text in items:
            v = word.findall(lowered(text))
            k = min(10, len(v))
            for j in range(len(v) - k + 1):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == v[j : j + k]:
                        hit.update(range(i, i + k))
                        found.add(str(item_id))
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
        assert sum(len(word.findall(lowered(texts[r.doc_id][s["start"] : s["end"]]))) for s in r.spans) == len(hit)


def _base_counts(text):
    w = space_words(text)
    windows: dict = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    earlier, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(space_words(line)) and line in earlier
        earlier.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def test_quality_counts():
    texts = [*_repetitive(8), "a #b\na #b\n\n\n x|y", " ".join("one two three".split() * 9), " no\xa0break\x85 é"]
    for t in texts:
        assert quality.measure(None if t is None else t.encode())[:5] == _base_counts(t)


def test_vote_model_separates_classes():
    rng = np.random.default_rng(5)
    good = rng.random(4000) < 0.85
    right = rng.random((4000, len(quality.RULES))) < 0.85
    speaks = rng.random(right.shape) < 0.5
    votes = np.where(right, 1, -1) * np.where(good, 1, -1)[:, None] * speaks
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.VoteModel().fit(patterns, counts)
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.95
    assert (model.accuracy > 0.7).all()
    assert quality.VoteModel().fit(patterns[:0], counts[:0]).share == quality.VoteModel.SHARE
