"""Language identification: sparse multinomial logistic regression.

Features are the hashed character 1- to 3-grams of the lower-cased whole text,
weighted TF-IDF and scaled to unit length. Weights are trained with
follow-the-regularised-leader and elastic-net penalties, whose L1 part leaves
most of them zero. A temperature, fitted on sample rows left out of training,
calibrates the probabilities.

Document frequencies cover every document that may be learned from. The
classifier knows every language that occurs in them and is fitted on the rows of
lowest hash of doc_id in each language: an equal share of ``sample_rows``, but
``LEAST_ROWS`` at least, or all it has. That is a number of sparse vectors on the
driver that grows with the languages only.

Defined cases: null text and text without a letter give ``und`` with score 0, as
does everything when there is nothing to learn from; rows without lang are not
learned from; ties go to the alphabetically first language; repeated rows are
predicted one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.llm.common import as_text, map_batches, mixed, ship, table
from bizlens.llm.sums import summed_vectors

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 3000
#: Rows of each language that a sample has room for, however many languages there are.
LEAST_ROWS = 20
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """How often each feature occurs in the text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(np.uint64)
    counts = np.zeros(FEATURES)
    grams = points
    with np.errstate(over="ignore"):
        for order in ORDERS:
            if order > 1:
                grams = grams[:-1] * np.uint64(0x100000001B3) + points[order - 1 :]
            place = mixed(grams + np.uint64(order << 56)) & np.uint64(FEATURES - 1)
            counts += np.bincount(place.astype(np.int64), minlength=FEATURES)
            if len(points) <= order:
                break
    return counts


def _letters():
    import regex

    return regex.compile(r"\p{L}").search


class Classifier:
    """idf (features), weights (features, languages), bias, temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray) -> None:
        self.langs, self.idf = langs, idf
        self.weights = np.zeros((FEATURES, len(langs)))
        self.bias = np.zeros(len(langs))
        self.temperature = 1.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        norm = np.sqrt(x @ x)
        at = np.flatnonzero(x) if norm else []
        return self.bias + (x[at] @ self.weights[at] / norm if norm else 0)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        e = np.exp((scores - scores.max(-1, keepdims=True)) / self.temperature)
        return e / e.sum(-1, keepdims=True)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    model: Classifier,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.01,
    epochs: int = 3,
) -> Classifier:
    """FTRL-proximal over (feature places, unit-length values, language number)."""
    z = np.zeros_like(model.weights)
    n = np.zeros_like(model.weights)
    zb, nb = np.zeros_like(model.bias), np.zeros_like(model.bias)

    def weights(z, n, l1):
        return np.where(
            np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        )

    for _ in range(epochs):
        for at, x, y in rows:
            w, b = weights(z[at], n[at], l1), weights(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            for g, zz, nn, ww, k in ((np.outer(x, p), z, n, w, at), (p, zb, nb, b, slice(None))):
                old = nn[k]
                nn[k] = old + g * g
                zz[k] += g - (np.sqrt(nn[k]) - np.sqrt(old)) / alpha * ww
    model.weights, model.bias = weights(z, n, l1), weights(zb, nb, 0.0)
    return model


def calibrate(model: Classifier, scores: np.ndarray, labels: np.ndarray) -> Classifier:
    """The temperature of least log loss on rows that weights were not trained on."""
    best = np.inf
    for t in np.geomspace(0.02, 20, 121):
        model.temperature, kept = float(t), model.temperature
        p = model.probabilities(scores)[np.arange(len(labels)), labels]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if loss < best - 1e-12:
            best = loss
        else:
            model.temperature = kept
    return model


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Learn from (doc_id, text, lang) rows with text and lang."""
    ship(train.sparkSession)

    def frequencies(texts):
        found = np.zeros(FEATURES, np.int64)
        for t in texts:
            found += gram_counts(t) > 0
        return found

    total, documents = summed_vectors(train.select("text"), frequencies, FEATURES)
    idf = np.log((1 + documents) / (1 + total)) + 1

    def make():
        def step(batch):
            places, values = [], []
            for t in as_text(batch.column(1)):
                counts = gram_counts(t)
                at = np.flatnonzero(counts)
                places.append(at)
                values.append(counts[at])
            return [batch.column(0), places, values]

        return step

    langs = sorted(r[0] for r in train.select("lang").distinct().collect())
    model = Classifier(langs, idf)
    if not langs:
        return model
    share = max(LEAST_ROWS, sample_rows // len(langs))
    # the lowest hashes are found without the texts, first in 64 parts of a language
    train = train.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    lowest = train.select("lang", "h", F.pmod(F.xxhash64("h"), F.lit(64)).alias("part"))
    for by in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        lowest = lowest.withColumn("place", place).where(F.col("place") <= share).drop("place")
    tops = lowest.groupBy("lang").agg(F.max("h").alias("top")).collect()
    tops = train.sparkSession.createDataFrame([tuple(r) for r in tops], "lang string, top long")
    sample = train.join(F.broadcast(tops), "lang").where("h <= top")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))  # of rows with one hash
    sample = sample.withColumn("place", place).where(F.col("place") <= share)
    sample = sample.orderBy("h", "doc_id", "lang", "text")
    rows = map_batches(
        sample.select("lang", "text"), "lang string, places array<int>, counts array<float>", make
    ).toArrow()
    examples, aside, seen = [], [], dict.fromkeys(langs, 0)
    for lang, at, counts in zip(*(rows.column(k).to_pylist() for k in range(3))):
        at = np.array(at, np.int64)
        x = np.array(counts) * idf[at]
        norm = np.sqrt(x @ x)
        seen[lang] += 1  # each fifth of a language is for the temperature
        (examples if seen[lang] % 5 else aside).append((at, x / norm if norm else x, langs.index(lang)))
    train_ftrl(examples, model)
    aside = aside or examples
    scores = np.array([x @ model.weights[at] + model.bias for at, x, _ in aside])
    return calibrate(model, scores, np.array([y for _, _, y in aside]))


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; only text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages: bounded

    def make():
        letter = _letters()

        def step(batch):
            model, out, sure = shared.value, [], []
            for t in as_text(batch.column(1)):
                if not t or not model.langs or not letter(t):
                    out.append(UNKNOWN)
                    sure.append(0.0)
                else:
                    p = model.probabilities(model.scores(gram_counts(t)))
                    out.append(model.langs[int(p.argmax())])
                    sure.append(float(p.max()))
            return [batch.column(0), out, sure]

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double", make)


def held_out(doc_id):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aside = F.coalesce(held_out("doc_id"), F.lit(False))
    train = docs.where(~aside).where("lang is not null and text is not null").where("text rlike '\\\\p{L}'")
    found = predict(docs, fit(train.select("doc_id", "text", "lang")))
    return found.select("doc_id", aside.alias("held_out"), "lang_pred", "score")
