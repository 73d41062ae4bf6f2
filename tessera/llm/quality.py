"""Quality rules: gradient-boosted trees over document statistics.

``document_stats`` computes counts per document from the whole text, a small
boosted-tree classifier (own histogram trainer, logistic loss, monotonic
constraints on chosen features) gives the verdict. The trained forest is
flattened into numpy node arrays, so that a batch of documents is scored by a
few fancy-indexing steps per tree level and no Python loop over rows.

Defined results for odd input: a null or empty text has all counts 0 and fails
the base rules (fewer than 50 words); a null doc_id is carried through; repeated
rows are judged one by one; extra columns are ignored by ``score_documents`` and
kept by ``filter_documents``, whatever their names. Without usable labels (none,
or one class only) the base rules alone decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?;:"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
    "digit_share", "mark_share", "unique_share", "words_per_line", "wide_share",
)
#: +1: the score never falls as the feature grows; -1: it never rises.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "mark_share": -1}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    twice = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(windows)] |= twice
    return int(covered.sum())


def one_document(text: bytes, n_chars: int) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts and the model's features of one text."""
    words = text.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = lambda chars: len(text) - len(text.translate(None, chars))
    word_chars = n_chars - without(SPACES)
    symbols, dup_lines, repeats = without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)
    chars = max(word_chars, 1)
    features = (
        np.log1p(n), word_chars / max(n, 1), symbols / chars, dup_lines / max(len(lines), 1), repeats / max(n, 1),
        without(UPPER) / chars, without(DIGITS) / chars, without(MARKS) / chars, len(set(words)) / max(n, 1),
        n / max(len(lines), 1), (len(text) - n_chars) / chars,
    )
    return (n, word_chars, symbols, dup_lines, repeats), features


def document_stats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows x 5, int64) and features (rows x 11, float64) of a column of texts."""
    chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    rows = [one_document(t or b"", c) for t, c in zip(texts.cast(pa.large_binary()).to_pylist(), chars, strict=True)]
    counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
    return counts, np.array([r[1] for r in rows], np.float64).reshape(-1, len(FEATURES))


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class Forest:
    """Boosted trees as flat node arrays; a leaf points to itself on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of the positive class for each row of ``x``."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def train_forest(
    x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], n_trees: int = 40, depth: int = 3,
    rate: float = 0.2, bins: int = 48, min_rows: int = 10, l2: float = 1.0,
) -> Forest:
    """Logistic boosting on quantile bins.

    A split on a constrained feature is taken only if its two leaf values have
    the wanted order, and their midpoint bounds all values further down, so the
    whole forest is monotone in that feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin, nodes, roots = np.full(len(y), base), [], []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        leaf = lambda gs, hs: float(np.clip(-gs / (hs + l2), low, high))
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append([0, 0.0, me, me, rate * leaf(total_g, total_h)])
        best, gain_of = None, lambda gs, hs: gs * gs / (hs + l2)
        if level < depth and len(rows) >= 2 * min_rows:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                n_left = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                g_left = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                h_left = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                gain = gain_of(g_left, h_left) + gain_of(total_g - g_left, total_h - h_left) - gain_of(total_g, total_h)
                v_left = np.clip(-g_left / (h_left + l2), low, high)
                v_right = np.clip(-(total_g - g_left) / (total_h - h_left + l2), low, high)
                ok = (n_left >= min_rows) & (len(rows) - n_left >= min_rows) & (monotone[j] * (v_right - v_left) >= 0)
                gain = np.where(ok, gain, 0)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, (v_left[k] + v_right[k]) / 2)
        if best:
            _, j, k, mid = best
            down = binned[rows, j] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[j]]
            left = grow(rows[down], g, h, level + 1, *bounds[0])
            right = grow(rows[~down], g, h, level + 1, *bounds[1])
            nodes[me] = [j, float(edges[j][k]), left, right, 0.0]
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
        tree = _flat(nodes, [roots[-1]], depth, 0.0)
        at = np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
        margin += tree.value[at]
        if len(nodes) == first + 1:  # no split helps any more
            break
    return _flat(nodes, roots, depth, base)


def _flat(nodes: list[list], roots: list[int], depth: int, base: float) -> Forest:
    f, t, left, right, v = zip(*nodes, strict=True)
    return Forest(np.array(f), np.array(t), np.array(left), np.array(right), np.array(v), np.array(roots), depth, base)


def train_quality(documents: DataFrame, labels: DataFrame, max_train: int = 20_000) -> Forest | None:
    """Fit the forest on at most ``max_train`` labelled documents (lowest hash of doc_id first).

    Statistics are taken on the executors; the driver gets one short row of
    numbers per sampled document. None if there is no row of either class.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    wanted = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_train short rows
    wanted = wanted.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a repeated doc_id counts once

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = document_stats(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rows = wanted.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, x array<double>").toArrow()
    y = rows.column("quality").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(rows.column("x").to_pylist())
    order = np.lexsort((*x.T, rows.column("doc_id").to_numpy()))  # the forest doesn't depend on the order of arrival
    return train_forest(x[order], y[order], tuple(MONOTONE.get(f, 0) for f in FEATURES))


def judge(texts: pa.Array, forest: Forest | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, score and kept for a column of texts."""
    counts, x = document_stats(texts)
    failed = base_failed(counts)
    score = forest.score(x) if forest else np.ones(len(x))
    return counts, failed, score, ~failed & (score >= threshold)


def score_documents(documents: DataFrame, forest: Forest | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and score of every document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            counts, failed, score, kept = judge(batch.column(1), forest, threshold)
            yield pa.record_batch([batch.column(0), *map(pa.array, counts.T), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return documents.select("doc_id", "text").mapInArrow(apply, f"doc_id long, {counts}, base_failed boolean, kept boolean, score double")


def filter_documents(documents: DataFrame, forest: Forest | None, threshold: float = 0.3) -> DataFrame:
    """The documents that the rules keep, all columns as they are."""
    at = documents.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            yield batch.filter(pa.array(judge(batch.column(at), forest, threshold)[3]))

    return documents.mapInArrow(apply, documents.schema)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
