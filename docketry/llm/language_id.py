"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 lower-cased characters are hashed into 2**16 features. Document frequencies come from all
training documents. The weights are fitted by follow-the-regularised-leader (proximal, one rate for each weight) with
an elastic-net penalty on a sample of at most ``SAMPLE_ROWS`` labelled training documents, spread evenly over the
languages and chosen by a hash of the key (with more than SAMPLE_ROWS / 20 languages, 20 of each); every fifth of them only
fits the temperature that calibrates the scores. Features of a document are divided by their sum, so a prediction is one
sum over the places of the text, however long it is.

Defined results: a text that is null, empty or without any letter is ``und`` with score 0, and so is every text if there
is nothing to learn from; equal scores go to the first language in alphabetic order; a null key is not held out and not
learned from; repeated rows have a line each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import releasing

SAMPLE_ROWS = 2000
FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
SCALE = 40.0
UNKNOWN = "und"

_MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def features(text: str) -> np.ndarray:
    """Feature of every n-gram at every place of the text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - FEATURE_BITS)
    grams, state = [], np.zeros(len(codes), np.uint32)
    for n, mix in enumerate(_MIX):
        if len(codes) <= n:
            break
        state = (state[:len(codes) - n] ^ codes[n:]) * mix
        state ^= state >> np.uint32(15)
        grams.append((state * _MIX[0]) >> shift)
    return np.concatenate(grams) if grams else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _document_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int8)
    n = 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found = features(text)
            seen[found] = 1
            total += seen
            seen[found] = 0
            n += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], n), pa.int64())], ["feature", "n"])


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.unique(features(text), return_counts=True) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("hash"), pa.array([x.astype("<u4").tobytes() for x, _ in rows], pa.binary()),
             pa.array([n.astype("<u4").tobytes() for _, n in rows], pa.binary())], ["lang", "hash", "features", "counts"])


class Model:
    """Weights, bias, inverse document frequencies and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.weights = np.zeros((FEATURES, len(languages)), np.float32)
        self.bias = np.zeros(len(languages))
        self.temperature = 1.0

    def ready(self) -> Model:
        self.table = np.concatenate([self.weights * self.idf[:, None], self.idf[:, None]], axis=1).astype(np.float32)
        return self

    def logits(self, text: str) -> np.ndarray:
        found = features(text)
        if len(found) < FEATURES:
            sums = self.table[found].sum(axis=0, dtype=np.float64)
        else:
            sums = np.bincount(found, minlength=FEATURES) @ self.table.astype(np.float64)
        return sums[:-1] / max(sums[-1], 1e-12) * SCALE + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """Fit on (language, features, counts) rows in their order; every fifth row is kept for the temperature."""
    model = Model(sorted({lang for lang, _, _ in rows}), idf)
    number = {lang: i for i, lang in enumerate(model.languages)}
    data = []
    for lang, found, counts in rows:
        x = counts * idf[found]
        data.append((number[lang], found, x / max(x.sum(), 1e-12) * SCALE))
    held = data[::5] if len(data) >= 50 else data
    learned = [row for i, row in enumerate(data) if i % 5] if len(data) >= 50 else data
    k = len(model.languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))  # the last row is the bias, without penalty
    for _ in range(EPOCHS):
        for target, found, x in learned:
            at, value = np.append(found, FEATURES), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = _weights(zs, ns)
            g = softmax(value @ w)
            g[target] -= 1
            g = value[:, None] * g
            new = ns + g * g
            z[at] = zs + g - (np.sqrt(new) - np.sqrt(ns)) / ALPHA * w
            n[at] = new
    w = _weights(z, n, np.append(np.full(FEATURES, L1), 0.0))
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    scores = np.array([x @ model.weights[found] + model.bias for _, found, x in held])
    targets = np.array([target for target, _, _ in held])
    grid = np.exp(np.linspace(-3, 3, 121))
    losses = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(targets)), targets], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    return model


def _weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray | None = None) -> np.ndarray:
    penalty = np.append(np.full(len(z) - 1, L1), 0.0)[:, None] if l1 is None else l1[:, None]
    return np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame) -> Model:
    """A model from the labelled documents whose key is not held out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")) \
        .filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.ones(FEATURES)).ready()
    rows = known.select("text").mapInArrow(releasing(_document_counter), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(FEATURES)
    total = 0
    for row in rows:  # at most one for each feature, and the number of documents
        if row["feature"] < 0:
            total = row["n"]
        else:
            frequency[row["feature"]] = row["n"]
    idf = np.log((1 + total) / (1 + frequency)) + 1
    each = max(20, SAMPLE_ROWS // len(counts))
    # one literal for each language: the filter needs no join, and no text moves
    rate = F.try_element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * each / n))]), F.col("lang"))
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000))
    chosen = known.filter(place < rate * 1_000_000).select("lang", F.xxhash64("doc_id").alias("hash"), "text") \
        .mapInArrow(releasing(_sampler), "lang string, hash long, features binary, counts binary")
    taken: dict[str, int] = {}
    sample = []
    for row in sorted(chosen.collect(), key=lambda row: (row["hash"], row["lang"], row["features"], row["counts"])):
        taken[row["lang"]] = taken.get(row["lang"], 0) + 1
        if taken[row["lang"]] <= each:
            sample.append((row["lang"], np.frombuffer(row["features"], "<u4").astype(np.int64), np.frombuffer(row["counts"], "<u4").astype(np.float64)))
    return fit(sample, idf).ready()


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(text) for text in batch.column("text").to_pylist()]
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in kept), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*kept, "lang_pred", "score"])
    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; without a model, one is trained on ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # 2**16 rows, a column for each language
    key = F.col("doc_id").cast("long")
    read = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(releasing(_predictor(shared)), "doc_id long, held_out boolean, lang_pred string, score double")


def _keeper(shared, least: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(text) for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))
    return keep


def keep_identified(docs: DataFrame, least: float) -> DataFrame:
    """Rows, with all their columns, whose language is known with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(releasing(_keeper(shared, least)), docs.schema)
