"""Language identification with a blended-spectrum string kernel.

The kernel counts the distinct byte n-grams (n = 1 to 3, of the lower-cased text)
that two texts share, divided by the root of the product of their own numbers of
distinct n-grams. A few training texts are the Nystroem landmarks: a text is
mapped to its kernel values against them, whitened by the landmarks' own kernel
matrix, and one-versus-rest ridge regression on these features gives a value per
language. All of it is linear in the presence vector but for one division, so a
batch of texts is scored by a matrix product of its presence rows with the
landmarks' presence matrix and another one with the weights.

Defined results for odd input: a null text, or one without any letter, is
``und`` with score 0; a null doc_id is carried through and never used to learn;
repeated rows are judged one by one; texts of any length are read whole (the set of a
text has fewer than 2**24 + 2**16 + 2**8 n-grams); an empty table gives an empty
result; extra columns are ignored by ``identify_documents`` and kept by
``filter_documents``. Without any labelled row every text is ``und``, and
``filter_documents`` keeps those with a letter. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

ORDERS = 3
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """The distinct byte n-grams of the whole text, as sorted integers below 2**26."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    found, code = [], b
    for n in range(1, ORDERS + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        if not len(code):
            break
        found.append(np.unique(code) + np.uint32((n - 1) << 24))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    """Labels, the landmarks' n-grams (sorted), their presence matrix and the weights."""

    labels: list[str]
    vocabulary: np.ndarray
    presence: np.ndarray  # n-grams x landmarks, columns divided by the root of their sums
    weights: np.ndarray  # landmarks x labels

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of each n-gram set against each landmark."""
        rows = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for row, s in zip(rows, sets, strict=True):
            at = np.searchsorted(self.vocabulary, s)
            at[at == len(self.vocabulary)] = 0
            row[at[self.vocabulary[at] == s]] = 1
        own = np.sqrt([max(len(s), 1) for s in sets])
        return (rows @ self.presence) / own[:, None]

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """The one-versus-rest regression values, rows x labels."""
        return self.kernel(sets) @ self.weights


def _landmarks(labels: list[str], landmarks: int) -> list[int]:
    """The rows that are landmarks: every so-many-th of each language's, one at least."""
    by_label: dict[str, list[int]] = {}
    for i, x in enumerate(labels):
        by_label.setdefault(x, []).append(i)
    share = max(1, landmarks // len(by_label))
    return [i for name in sorted(by_label) for i in by_label[name][:: max(1, len(by_label[name]) // share)][:share]]


def _from_landmarks(names: list[str], sets: list[np.ndarray]) -> LanguageModel:
    """A model without weights yet."""
    vocabulary = np.unique(np.concatenate(sets))
    presence = np.zeros((len(vocabulary), len(sets)), np.float32)
    for column, s in enumerate(sets):
        presence[np.searchsorted(vocabulary, s), column] = 1 / np.sqrt(max(len(s), 1))
    return LanguageModel(names, vocabulary, presence, np.zeros((len(sets), len(names)), np.float32))


def _sums(model: LanguageModel, sets: list[np.ndarray], labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """K'K and K'Y of training rows, K being their kernel values and Y one column per language."""
    k = model.kernel(sets).astype(float)
    y = (np.array(labels)[:, None] == np.array(model.labels)[None, :]).astype(float)
    return k.T @ k, k.T @ y


def _solve(model: LanguageModel, landmarks: list[np.ndarray], inner: np.ndarray, target: np.ndarray, rows: int, ridge: float) -> LanguageModel:
    """The weights of the ridge regression on whitened kernel values, from the sums over all rows."""
    k_mm = model.kernel(landmarks).astype(float)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    m = len(landmarks)
    found = np.linalg.solve(whiten.T @ inner @ whiten + ridge * rows * np.eye(m) / m, whiten.T @ target)
    model.weights = (whiten @ found).astype(np.float32)
    return model


def train_language_model(sets: list[np.ndarray], labels: list[str], landmarks: int = 96, ridge: float = 1e-2) -> LanguageModel:
    """Fit on n-gram sets; every ``len(sets) // landmarks``-th of each language's is a landmark."""
    chosen = [sets[i] for i in _landmarks(labels, landmarks)]
    model = _from_landmarks(sorted(set(labels)), chosen)
    inner, target = map(sum, zip(*(_sums(model, sets[i : i + 256], labels[i : i + 256]) for i in range(0, len(sets), 256)), strict=True))
    return _solve(model, chosen, inner, target, len(sets), ridge)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that training must not see."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_sample(documents: DataFrame, per_label: int) -> DataFrame:
    """lang, doc_id and found (packed n-grams) of ``per_label`` documents of each language, all if it has fewer.

    Twice as many are first taken by a cutoff on the hash of doc_id, which follows from the
    language's approximate number of ids; so the ranking that leaves ``per_label`` reads few rows,
    whatever a language holds. A repeated doc_id of a language counts once.
    """
    named = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    counts = named.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.05).alias("n"))  # one short row per language; twice per_label is far beyond its error
    ids = named.select("lang", "doc_id", share.alias("share")).join(F.broadcast(counts), "lang").where(F.col("share") * F.col("n") < 2 * per_label + 32).select("lang", "doc_id", "share").distinct()
    place = F.row_number().over(W.partitionBy("lang").orderBy("share", "doc_id"))
    chosen = F.broadcast(ids.withColumn("place", place).where(F.col("place") <= per_label).select("lang", "doc_id"))  # at most per_label short rows a language

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["lang", "doc_id", "found"])

    texts = named.select("lang", "doc_id", "text").join(chosen, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return texts.mapInArrow(sets, "lang string, doc_id long, found binary")


def fit_language_model(documents: DataFrame, per_label: int = 400, landmarks: int = 96, ridge: float = 1e-2) -> LanguageModel | None:
    """Learn from at most ``per_label`` documents of each language, of all languages there are.

    The sample is the lowest hashes of doc_id among documents with a language and not
    held out. Its n-gram sets stay on the executors: the driver gets the sample's ids, the
    landmarks' sets and, from each task, the sums that the regression needs (landmarks
    times landmarks and languages). None if no row has a language.
    """
    sample = materialise(training_sample(documents, per_label), "language-sample")
    rows = sorted(map(tuple, sample.select("lang", "doc_id").collect()))
    if not rows:
        return None
    picked = [rows[i] for i in _landmarks([x for x, _ in rows], landmarks)]
    wanted = F.broadcast(sample.sparkSession.createDataFrame(picked, "lang string, doc_id long"))  # one row per landmark
    sets = [np.frombuffer(r.found, "<u4") for r in sorted(sample.join(wanted, ["lang", "doc_id"]).collect(), key=lambda r: (r.lang, r.doc_id))]
    model = _from_landmarks(sorted({x for x, _ in rows}), sets)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in _parts(batches):
            if batch.num_rows:
                parts.append(_sums(model, [np.frombuffer(f, "<u4") for f in batch.column(1).to_pylist()], batch.column(0).to_pylist()))
        if parts:
            inner, target = map(sum, zip(*parts, strict=True))
            yield pa.record_batch([pa.array([inner.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())], ["inner", "target"])

    found = sorted(map(tuple, sample.select("lang", "found").mapInArrow(sums, "inner binary, target binary").collect()))
    inner, target = (sum(np.frombuffer(x[i]).reshape(len(sets), -1) for x in found) for i in (0, 1))
    return _solve(model, sets, inner, target, len(rows), ridge)


def identify(texts: list[str | None], model: LanguageModel | None) -> tuple[list[str], list[float]]:
    """Language and score (the winner's regression value, held to 0..1) of each text."""
    named, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
    if some:
        values = model.values([grams(texts[i]) for i in some])
        for i, row in zip(some, values, strict=True):
            best = int(row.argmax())
            named[i], scores[i] = model.labels[best], float(min(max(row[best], 0), 1))
    return named, scores


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def identify_documents(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            named, scores = identify(batch.column(1).to_pylist(), model)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(named, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")


def filter_documents(documents: DataFrame, model: LanguageModel | None, min_score: float = 0.3) -> DataFrame:
    """Documents whose language is recognised with at least ``min_score``, all columns as they are.

    Without a model no language can be told, and documents with a letter are kept.
    """
    at = documents.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column(at).to_pylist()
            good = [s >= min_score for s in identify(texts, model)[1]] if model else [any(map(str.isalpha, t or "")) for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(apply, documents.schema)
