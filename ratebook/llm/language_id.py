"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: runs of 1 to 3 characters of the lower-cased text, hashed to ``FEATURES`` places; (1 + log tf) * idf, scaled
  to length 1.  Document frequencies are counted over all learning documents.
* Training: follow the regularised leader with per-coordinate steps and elastic-net penalties (``L1`` makes most
  weights zero, ``L2`` shrinks the rest), on a sample of at most ``SAMPLE`` learning documents, those of smallest hash.
* Calibration: one temperature for all scores, fitted by log loss on a part of the sample that training leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import bounded_batches, mix
from .work import by_batch

FEATURES, GRAMS = 1 << 14, (1, 2, 3)
SAMPLE, CALIBRATION = 6000, 0.2
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 0.5, 1.0, 0.002, 0.01, 4, 16
#: Characters of a text that are turned to features at once; counts of longer texts are added up.
PIECE = 1 << 18
UNKNOWN = "und"


def _counts(text: str) -> np.ndarray:
    """Counts of hashed character n-grams of a whole text."""
    total = np.zeros(FEATURES, np.int64)
    text = text.lower()
    longest = max(GRAMS)
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE + longest - 1]
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        last = min(PIECE, len(text) - at)
        gram = np.zeros(len(code), np.uint64)
        for n in range(1, longest + 1):
            # the code points of a run of n characters side by side
            gram = gram[: len(code) - n + 1] << np.uint64(21) | code[n - 1 :]
            if n in GRAMS and len(gram):
                place = mix(gram[:last] ^ np.uint64(n << 60)) >> np.uint64(64 - FEATURES.bit_length() + 1)
                total += np.bincount(place.astype(np.int64), minlength=FEATURES)
    return total


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of documents by feature of a whole partition; the last row (place FEATURES) counts documents."""
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for text in batch.column(0):
            total[:FEATURES] += _counts(text.as_py() or "") > 0
            total[FEATURES] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(total)], names=["place", "n"])


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features, scaled to length 1."""
    place = np.flatnonzero(counts)
    value = (1 + np.log(counts[place])) * idf[place]
    return place, value / (np.sqrt((value * value).sum()) or 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class FTRL:
    """Multinomial follow-the-regularised-leader; weights follow from the sums z and n of gradients."""

    def __init__(self, features: int, classes: int):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def step(self, places: list[np.ndarray], values: list[np.ndarray], targets: np.ndarray) -> None:
        rows, where = np.unique(np.concatenate(places), return_inverse=True)
        doc = np.repeat(np.arange(len(places)), [len(p) for p in places])
        x = np.zeros((len(places), len(rows)))
        x[doc, where] = np.concatenate(values)
        w = self.weights(rows)
        error = softmax(x @ w)
        error[np.arange(len(targets)), targets] -= 1
        g = x.T @ error
        sigma = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / ALPHA
        self.z[rows] += g - sigma * w
        self.n[rows] += g * g


def temperature(scores: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least log loss, found by a golden-section search over its logarithm."""
    if not len(targets):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))[np.arange(len(targets)), targets]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, golden = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        place, value = _vector(_counts(text), self.idf)
        p = softmax(value @ self.weights[place] / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def held_out(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string")) % 3 == 1


def train(learning: DataFrame, text_column: str = "text", lang_column: str = "lang", order: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the rows of ``learning`` with a text and a language; without any, all texts are unknown."""
    bounded_batches(learning.sparkSession)
    rows = learning.select(
        F.col(text_column).alias("text"), F.col(lang_column).alias("lang"), F.xxhash64(F.col(order).cast("string")).alias("h")
    ).filter("text is not null and lang is not null")
    counts = rows.select("text").mapInArrow(_document_frequencies, "place int, n long")
    df = np.zeros(FEATURES + 1, np.int64)
    for r in counts.groupBy("place").agg(F.sum("n").alias("n")).collect():  # FEATURES + 1 rows
        df[r["place"]] = r["n"]
    total = int(df[FEATURES])
    idf = np.log((1 + total) / (1 + df[:FEATURES])) + 1
    if not total:
        return Model([], idf, np.zeros((FEATURES, 0)), 1.0)

    # the rows of smallest hash: a threshold first, so that only about as many texts are sorted and sent
    share = min(1.0, 1.5 * sample / total + 50 / total)
    limit = int(-(1 << 63) + share * ((1 << 64) - 1))
    chosen = rows.filter(F.col("h") <= F.lit(min(limit, (1 << 63) - 1))).select("h", "lang", "text")

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [_vector(_counts(t.as_py()), idf) for t in batch.column(2)]
        packed = [p.astype(np.uint16).tobytes() + v.astype(np.float16).tobytes() for p, v in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["h", "lang", "x"])

    made = by_batch(chosen, features, "h long, lang string, x binary").orderBy("h", "lang", "x").limit(sample).collect()
    places = [np.frombuffer(r["x"], np.uint16, len(r["x"]) // 4).astype(np.int64) for r in made]
    values = [np.frombuffer(r["x"], np.float16, offset=len(r["x"]) // 2).astype(np.float64) for r in made]
    languages = sorted({r["lang"] for r in made})
    targets = np.array([languages.index(r["lang"]) for r in made])
    del made
    cut = max(1, int(len(targets) * (1 - CALIBRATION)))
    leader = FTRL(FEATURES, len(languages))
    shuffle = np.random.default_rng(3)
    for _ in range(EPOCHS):
        order_ = shuffle.permutation(cut)
        for k in range(0, cut, BATCH):
            own = order_[k : k + BATCH]
            leader.step([places[x] for x in own], [values[x] for x in own], targets[own])
    weights = leader.weights()
    left = [values[x] @ weights[places[x]] for x in range(cut, len(targets))]
    heat = temperature(np.array(left).reshape(-1, len(languages)), targets[cut:])
    return Model(languages, idf, weights, heat)


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of ``docs``: null texts and texts without a letter are ``und`` with score 0.
    Rows are judged on their text alone; null and repeated ids make no difference."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # FEATURES * languages weights

    def predict(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [sent.value.predict(t.as_py()) for t in batch.column(1)]
        lang, score = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"]
        )

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return by_batch(plain, predict, "id long, lang_pred string, score double").withColumnRenamed("id", id_column)


def language_id(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Train on the rows that are not held out, then predict all rows; ``held_out`` is false for a null id."""
    flag = F.coalesce(held_out(id_column), F.lit(False))
    model = train(docs.filter(~flag), text_column, lang_column, id_column)
    found = identify(docs, model, id_column, text_column)
    return found.select(id_column, flag.alias("held_out"), "lang_pred", "score")
