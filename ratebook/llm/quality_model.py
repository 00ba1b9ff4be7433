"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document of grade g has P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all grades and increasing
thresholds t_k.  Grades of the rated documents: 0 toxic, 1 neither toxic nor of quality, 2 of quality and not toxic
(ratings that are null say nothing: such rows are not learnt from).

Features are hashed words of the whole text, the word itself and its shape (case, digits and other characters as
classes), each present or not, so that one bad word of a long text counts in full, plus shares of characters.  Training
minimises the penalised likelihood with adaptive steps on a sample of at most ``SAMPLE`` rated documents, those of
smallest hash.  Words take part if their score test against the model without words exceeds what the largest of so many
tests of meaningless words would be: the many words of long texts otherwise learn the errors of the ratings by heart.
Frequent words take part like others.  A document is selected when its tail probability P(grade >= 2) is at least
``SELECT``.

Null and empty texts have no words and are judged by their shares.  Where all ratings are the same, no word takes part and
all documents get the same probabilities but for the shares.  Without ratings all are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import LOWER, SPACE, Words, blocks, bounded_batches, mix, span_hashes
from .work import by_batch

FEATURES, SHARES = 1 << 18, 8
SAMPLE, EPOCHS, BATCH, RATE, PENALTY = 12000, 8, 32, 0.3, 2e-5
GRADES, SELECT = 3, 0.6
#: Words that fewer rated documents hold say nothing about others.
MIN_DOCS = 3

#: Classes of bytes for the shape of a word: lower case, upper case, digit, beyond ASCII, and each other byte itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def _features(data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted feature numbers of each document of a block, and its shares of characters."""
    words = Words(data, bounds, SPACE)
    # words without what stands around their letters and digits
    lower = LOWER[data]
    inner = np.flatnonzero(~_EDGE[lower[words.start]]) if len(words) else np.empty(0, int)
    ends = words.end - _EDGE[lower[words.end - 1]] if len(words) else words.end
    keep = inner[ends[inner] > words.start[inner]] if len(inner) else inner
    word = span_hashes(lower, words.start[keep], ends[keep])
    shape_data = _SHAPE[data]
    same = np.concatenate([[False], shape_data[1:] == shape_data[:-1]]) if len(data) else np.empty(0, bool)
    same[words.start] = False  # a run of one class is one character of the shape
    squeezed = shape_data[~same]
    at = np.concatenate([[0], np.cumsum(~same)])
    shape = span_hashes(squeezed, at[words.start], at[words.end]) if len(words) else word[:0]
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    word, shape = (mix(word ^ np.uint64(1)) >> shift).astype(np.int64), (mix(shape ^ np.uint64(2)) >> shift).astype(np.int64)
    first_kept = np.searchsorted(keep, words.first)
    found = []
    for d in range(len(bounds) - 1):
        own = word[first_kept[d] : first_kept[d + 1]], shape[words.first[d] : words.first[d + 1]]
        found.append(np.unique(np.concatenate(own)))
    size = np.maximum(np.diff(bounds), 1)
    classes = [data == 10, (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), data == 33, data == 124]
    shares = [np.diff(np.concatenate([[0], np.cumsum(c)])[bounds]) / size for c in classes]
    count = words.counts
    shares += [np.diff(words.first) / size, np.log1p(count) / 10, (count < 50).astype(float)]
    return found, np.array(shares).T.reshape(-1, SHARES)


_EDGE = np.zeros(256, bool)
_EDGE[:128] = [not chr(b).isalnum() for b in range(128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray  # FEATURES + SHARES
    thresholds: np.ndarray  # of P(grade > 0), P(grade > 1), ..., increasing

    def tails(self, found: list[np.ndarray], shares: np.ndarray) -> np.ndarray:
        """P(grade > k) of each document."""
        score = np.array([self.weights[f].sum() for f in found]) + shares @ self.weights[FEATURES:]
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def score_tests(found: list[np.ndarray], grades: np.ndarray) -> tuple[np.ndarray, float]:
    """For each feature, how many standard deviations the slope of the likelihood by its weight is from 0 in the model of
    thresholds only (0 for features of fewer than ``MIN_DOCS`` documents), and the limit sqrt(2 ln m) of m such tests."""
    if not found:
        return np.zeros(FEATURES), 0.0
    chance = np.bincount(grades, minlength=GRADES) / len(grades)
    tail = np.concatenate([[1.0], 1 - np.cumsum(chance)[:-1], [0.0]])  # P(grade >= 0), P(grade >= 1), ..., 0
    spread = tail * (1 - tail)
    slope = ((spread[:-1] - spread[1:]) / np.maximum(chance, 1e-9))[grades]
    slope -= slope.mean()
    every = np.concatenate(found)
    seen = np.bincount(every, minlength=FEATURES)
    total = np.bincount(every, np.repeat(slope, [len(f) for f in found]), FEATURES)
    variance = seen * (1 - seen / len(found)) * slope.var()
    tested = (seen >= MIN_DOCS) & (variance > 1e-12)
    tests = np.where(tested, np.abs(total) / np.sqrt(np.maximum(variance, 1e-12)), 0.0)
    return tests, float(np.sqrt(2 * np.log(max(tested.sum(), 2))))


def fit(found: list[np.ndarray], shares: np.ndarray, grades: np.ndarray, seed: int = 5) -> Model:
    """Penalised maximum likelihood with per-weight adaptive steps, over the features that pass their score test."""
    tests, limit = score_tests(found, grades)
    found = [f[tests[f] > limit] for f in found]
    w, g2 = np.zeros(FEATURES + SHARES), np.full(FEATURES + SHARES, 1e-8)
    # thresholds start at the shares of grades; steps between them stay positive
    share = np.array([(grades > k).mean() for k in range(GRADES - 1)]).clip(0.01, 0.99) if len(grades) else np.full(GRADES - 1, 0.5)
    start = np.log((1 - share) / share)
    base, gaps = start[0], np.log(np.maximum(np.diff(start), 0.1))
    side2 = np.full(GRADES - 1, 1e-8)
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        index = order.permutation(len(found))
        for k in range(0, len(index), BATCH):
            own = index[k : k + BATCH]
            rows, where = np.unique(np.concatenate([found[i] for i in own]), return_inverse=True)
            doc = np.repeat(np.arange(len(own)), [len(found[i]) for i in own])
            t = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            score = np.bincount(doc, w[rows][where], len(own)) + shares[own] @ w[FEATURES:]
            p = np.concatenate([np.ones((len(own), 1)), _sigmoid(score[:, None] - t[None, :]), np.zeros((len(own), 1))], 1)
            g = grades[own]
            line = np.arange(len(own))
            above, below = p[line, g], p[line, g + 1]  # P(grade > g - 1), P(grade > g)
            chance = np.maximum(above - below, 1e-9)
            da, db = above * (1 - above), below * (1 - below)
            slope = -(da - db) / chance / len(own)  # of the loss, by the score
            step = np.bincount(where, slope[doc], len(rows)) + PENALTY * w[rows]
            g2[rows] += step * step
            w[rows] -= RATE * step / np.sqrt(g2[rows])
            step = slope @ shares[own]
            g2[FEATURES:] += step * step
            w[FEATURES:] -= RATE * step / np.sqrt(g2[FEATURES:])
            by_t = np.zeros(GRADES - 1)
            np.add.at(by_t, g[g > 0] - 1, (da / chance / len(own))[g > 0])
            np.add.at(by_t, g[g < GRADES - 1], -(db / chance / len(own))[g < GRADES - 1])
            side = np.concatenate([[by_t.sum()], np.exp(gaps) * np.cumsum(by_t[::-1])[::-1][1:]])
            side2 += side * side
            move = 0.1 * side / np.sqrt(side2)
            base, gaps = base - move[0], gaps - move[1:]
    return Model(w, base + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def grade() -> Column:
    """Grade of a rated document from quality and toxic."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality").isNotNull(), 1)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Model | None:
    """A model of the rated documents, or None where there are none."""
    bounded_batches(docs.sparkSession)
    rated = labels.select(F.col(id_column).cast("long").alias("id"), grade().alias("grade")).filter("id is not null and grade is not null")
    rated = rated.groupBy("id").agg(F.min("grade").alias("grade"))
    total = rated.count()
    if not total:
        return None
    # the ids of smallest hash: a threshold first, so that only about as many rows are sorted
    share = min(1.0, 1.2 * sample / total + 50 / total)
    limit = min(int(-(1 << 63) + share * ((1 << 64) - 1)), (1 << 63) - 1)
    rated = rated.withColumn("h", F.xxhash64("id")).filter(F.col("h") <= limit).orderBy("h").limit(sample)
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    chosen = plain.join(F.broadcast(rated), "id").select("h", "grade", "text")  # at most ``sample`` rows

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, bounds in blocks(batch.column(2)):
            found, shares = _features(data, bounds)
            packed = [f.astype(np.uint32).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(packed, pa.binary()), pa.array(list(shares), pa.list_(pa.float64()))],
                names=["h", "grade", "f", "s"],
            )

    rows = by_batch(chosen, features, "h long, grade int, f binary, s array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["f"]))[:sample]
    if not rows:
        return None
    found = [np.frombuffer(r["f"], np.uint32).astype(np.int64) for r in rows]
    return fit(found, np.array([r["s"] for r in rows]), np.array([r["grade"] for r in rows]))


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, expected_grade, p_top, keep): P(grade >= 2) is ``p_top``.  Null texts have no words and are judged as such."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, bounds in blocks(batch.column(1)):
            tails = sent.value.tails(*_features(data, bounds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(tails.sum(1)), pa.array(tails[:, -1])], names=["id", "expected_grade", "p_top"]
            )

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    out = by_batch(plain, score, "id long, expected_grade double, p_top double").withColumnRenamed("id", id_column)
    return out.withColumn("keep", F.col("p_top") >= SELECT)


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Train on the rated documents and score all; without ratings every document has grade null and is kept."""
    model = train(docs, labels, id_column, text_column)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col(id_column), none.alias("expected_grade"), none.alias("p_top"), F.lit(True).alias("keep"))
    return predict(docs, model, id_column, text_column)


def keep_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` that the classifier selects, all columns as they are; each row is judged on its own text."""
    model = train(docs, labels, id_column, text_column)
    if model is None:
        return docs
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def select(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, bounds in blocks(batch.column(place)):
            keep = sent.value.tails(*_features(data, bounds))[:, -1] >= SELECT
            yield batch.slice(i, j - i).filter(pa.array(keep))

    return by_batch(docs, select, docs.schema)
