"""Embedders: bring a vectors column, or use the deterministic hash embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH = 16


class Embedder(Protocol):
    """Texts to vectors of one length."""

    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Vectors from a SHA-256 chain over the text, of unit length: repeatable, without meaning."""

    def __init__(self, dims: int = 16):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            link = text.encode()
            for i in range(self.dims):
                link = hashlib.sha256(link).digest()
                row[i] = int.from_bytes(link[:4], "little") / 2**32 - 0.5
        return normalise(out)


def normalise(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


def embed_column(df: DataFrame, embedder: Embedder, text: str = "body", out: str = "embedding") -> DataFrame:
    """``df`` with a vector of each text, in Arrow batches and small model batches."""
    names = df.columns
    at = names.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            rows = [r for i in range(0, len(texts), BATCH) for r in embedder.embed(texts[i : i + BATCH]).astype(np.float32).tolist()]
            yield pa.record_batch([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], [*names, out])

    return df.mapInArrow(apply, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))
