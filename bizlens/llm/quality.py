"""Quality rules under weak supervision.

Each rule looks at one trait of a text and votes good (+1), bad (-1) or abstains
(0). Nobody knows which rules to trust, so expectation-maximisation estimates,
from the votes of all documents, how often each rule is right when it votes
and how common good texts are; a document's posterior probability
of being good follows from its votes. A text is kept if that is at least
``threshold`` and the two base rules hold, instead of having to pass every rule.

Votes are independent given the class, so the corpus enters the estimate only
through the number of documents with each of the 3**rules vote patterns: one
small aggregation, whose bounded result is all that the driver sees.

Defined cases: null, empty and wordless texts have no words, fail the base rules
and take no part in the estimate; without any document left the rules keep their
starting accuracies; repeated rows are judged one by one; other columns are
ignored by ``judge`` and passed through by ``keep_good``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import (
    SPACE,
    WORD_HASHES,
    as_bytes,
    cut_lineage,
    keep_rows,
    map_batches,
    table,
    window_hashes,
)

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
#: Base rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    "the of and to in is that der die und das ist le la les et des un el los y una por".encode().split()
)
#: The rules, in the order of their votes.
RULES = (
    "length", "word_length", "symbols", "line_repeats", "run_repeats",
    "capitals", "exclamations", "function_words", "sentence_ends", "top_word",
    "punctuation", "distinct_words", "echoes",
)
#: Rules that also vote for a text.
SPEAK_FOR = ("function_words", "sentence_ends", "punctuation")

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CONTINUED = bytes(range(0x80, 0xC0))

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes int"
)


def _repeated_words(hashes: np.ndarray) -> int:
    windows = window_hashes(hashes, REPEAT_WINDOW)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int32)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The base counts and the votes, the latter as one base-3 number."""
    text = text or b""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else words[:1]
    dup_lines = len(lines) - len(set(lines))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    if not n:
        return 0, 0, symbols, dup_lines, 0, -1
    word_chars = len(text.translate(None, SPACE + _CONTINUED))
    hashes = WORD_HASHES.of(words)
    repeated = _repeated_words(hashes)
    upper = len(text) - len(text.translate(None, _UPPER))
    letters = upper + len(text) - len(text.translate(None, _LOWER))
    _, counts = np.unique(hashes, return_counts=True)
    stops = sum(map(STOP_WORDS.__contains__, words)) / n
    ends = (text.count(b".") + text.count(b"?")) / n
    marks = len(text) - len(text.translate(None, _MARKS))
    votes = (
        -1 if n < MIN_WORDS else 0,
        -1 if not 2.5 <= word_chars / n <= 14 else 0,
        -1 if symbols > 0.1 * n else 0,
        -1 if dup_lines > 0.3 * len(lines) else 0,
        -1 if repeated > 0.2 * n else 0,
        -1 if upper > 0.4 * letters and letters >= 20 else 0,
        -1 if text.count(b"!") > 0.2 * n else 0,
        1 if stops >= 0.06 else -1 if stops < 0.02 and n >= 2 * MIN_WORDS else 0,
        1 if 0.01 <= ends <= 0.5 else -1 if n >= 100 and ends < 0.002 else 0,
        -1 if counts.max() > 0.25 * n and n >= MIN_WORDS else 0,
        -1 if marks > 0.5 * n else 1 if marks < 0.3 * n else 0,
        -1 if len(counts) < 0.3 * n and n >= MIN_WORDS else 0,
        -1 if np.count_nonzero(hashes[1:] == hashes[:-1]) > 0.3 * n else 0,
    )
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return n, word_chars, symbols, dup_lines, repeated, code


def base_failed(n_words, n_repeat_words):
    """The contract's base rules, on columns or plain numbers."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def votes_of(codes: np.ndarray) -> np.ndarray:
    """(patterns, rules) array of votes from their base-3 numbers."""
    powers = 3 ** np.arange(len(RULES) - 1, -1, -1)
    return (codes[:, None] // powers) % 3 - 1


class VoteModel:
    """Share of good texts, and how often each rule is right when it votes.

    Different kinds of junk set off different rules, and junk that sets off one rule
    alone gives no evidence on it; left alone, expectation-maximisation then makes
    the largest kind of junk the whole bad class. So each estimate is averaged with
    what is believed of it beforehand (a prior that weighs as much as the votes):
    a rule that speaks against a text is precise, one that speaks for it less so."""

    SHARE, AGAINST, FOR, LIMITS = 0.8, 0.9, 0.7, (0.55, 0.99)

    def __init__(self) -> None:
        self.share = self.SHARE
        self.believed = np.where(np.isin(RULES, SPEAK_FOR), self.FOR, self.AGAINST)
        self.accuracy = self.believed

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        weight = np.log(self.accuracy) - np.log1p(-self.accuracy)
        log = math.log(self.share) - math.log1p(-self.share) + votes @ weight
        return 1 / (1 + np.exp(-np.clip(log, -700, 700)))

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> VoteModel:
        """Expectation (posterior of each pattern), then maximisation, until still."""
        if not counts.sum():
            return self
        good, bad = votes == 1, votes == -1
        voted = counts @ (good | bad)
        for _ in range(rounds):
            p = self.posterior(votes)
            right = (p * counts) @ good + ((1 - p) * counts) @ bad
            before = self.accuracy
            seen = np.divide(right, voted, out=self.believed.copy(), where=voted > 0)
            self.accuracy = np.clip((seen + self.believed) / 2, *self.LIMITS)
            self.share = float((p @ counts / counts.sum() + self.SHARE) / 2)
            if np.abs(self.accuracy - before).max() < 1e-9:
                break
        return self


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the votes of every whole text."""

    def make():
        def step(batch):
            found = [measure(t) for t in as_bytes(batch.column(1))]
            return [batch.column(0), *(zip(*found) if found else [[]] * 6)]

        return step

    return map_batches(docs.select("doc_id", "text"), f"doc_id long, {STATS}", make)


def fitted(stats: DataFrame) -> tuple[VoteModel, dict[int, float]]:
    """The model of all documents' votes, and the posterior of each pattern that
    occurs (at most 3**rules)."""
    rows = stats.where("votes >= 0").groupBy("votes").count().collect()
    codes = np.array(sorted(r["votes"] for r in rows), np.int64)
    count = {r["votes"]: r["count"] for r in rows}
    votes = votes_of(codes)
    model = VoteModel().fit(votes, np.array([count[c] for c in codes], float))
    return model, dict(zip(codes.tolist(), model.posterior(votes).tolist()))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_failed, quality (posterior; 0 without words), kept."""
    stats = cut_lineage(measured(docs))
    spark = docs.sparkSession
    _, posterior = fitted(stats)
    known = spark.createDataFrame(
        list(posterior.items()) or [(-2, 0.0)], "votes int, quality double"
    )
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (
        stats.join(F.broadcast(known), "votes", "left")  # at most 3**rules rows
        .withColumn("quality", F.coalesce("quality", F.lit(0.0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= threshold))
        .drop("votes")
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns untouched. Two scans:
    carrying the votes to the rows would need a join on every document."""
    _, posterior = fitted(measured(docs.select(F.lit(0).cast("long").alias("doc_id"), "text")))
    good = docs.sparkSession.sparkContext.broadcast(
        {code for code, p in posterior.items() if p >= threshold}
    )
    at = docs.columns.index("text")

    def make():
        def step(batch):
            found = map(measure, as_bytes(batch.column(at)))
            return [not base_failed(m[0], m[4]) and m[5] in good.value for m in found]

        return step

    return keep_rows(docs, make)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality",
    )
