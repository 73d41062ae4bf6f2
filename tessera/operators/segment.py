"""Text segmentation: paragraphs, chunks, embedding windows, slices.

Cutting at sentence ends is a recurrence, which window functions can't express, so
these run as Arrow batches in Python: sentence ends are found once per text, each
cut is a binary search among them. One row in, many rows out, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS, CHUNK_OVERLAP = 40_000, 300
WINDOW_CHARS, WINDOW_OVERLAP = 800, 100
BLANK = re.compile(r"\n\s*\n")
#: The characters that end a sentence.
STOP = re.compile("[。！？.!?\n]")
Span = tuple[int, int]


def trimmed(text: str, start: int, end: int) -> Span:
    """The span without white space at either side."""
    part = text[start:end]
    return start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())


def paragraphs(text: str) -> list[Span]:
    """Spans between blank lines, trimmed, empty ones dropped."""
    edges = [0, *(x for m in BLANK.finditer(text) for x in m.span()), len(text)]
    spans = (trimmed(text, a, b) for a, b in zip(edges[::2], edges[1::2], strict=True))
    return [s for s in spans if s[1] > s[0]]


class Cutter:
    """Where to cut a text that is too long: after the last sentence end of the far half, else at the limit."""

    def __init__(self, text: str):
        self.stops = [m.start() for m in STOP.finditer(text)]

    def cut(self, start: int, limit: int) -> int:
        i = bisect_left(self.stops, start + limit) - 1
        return self.stops[i] + 1 if i >= 0 and self.stops[i] - start > limit // 2 else start + limit


def pieces(text: str, limit: int) -> list[Span]:
    """Paragraphs, those over the limit cut into parts."""
    out, cutter = [], None
    for start, end in paragraphs(text):
        while end - start > limit:
            cutter = cutter or Cutter(text)
            cut = cutter.cut(start, limit)
            out.append((start, cut))
            start = cut
        if start < end:
            out.append((start, end))
    return out


def chunk_spans(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[Span]:
    """Greedy runs of pieces; each run but the first reaches ``overlap`` characters back."""
    out: list[list[int]] = []
    for start, end in pieces(text, size):
        if out and out[-1][1] - out[-1][0] + end - start <= size:
            out[-1][1] = end
        else:
            out.append([max(0, out[-1][1] - overlap) if out else start, end])
    return [(a, b) for a, b in out]


def window_spans(text: str, size: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> list[Span]:
    """Overlapping windows that end at sentence ends where they can; blank ones are left out."""
    n, start, out = len(text), 0, []
    cutter = Cutter(text) if n > size else None
    while start < n:
        end = cutter.cut(start, size) if cutter and start + size < n else n
        if text[start:end].strip():
            out.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def slice_texts(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Slices for files: paragraphs (or lines, if there is one paragraph) joined by blank lines.

    A slice begins with the tail of the one before; it isn't a substring of the text.
    """
    parts = [p for p in map(str.strip, BLANK.split(text)) if p]
    if len(parts) < 2:
        parts = [p for p in map(str.strip, text.splitlines()) if p] or [text]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for piece in (p for part in parts for p in _stripped_cuts(part, size)):
        if held and length + len(piece) + 1 > size:
            out.append("\n\n".join(held))
            tail = out[-1][-overlap:].strip() if overlap else ""
            held, length = ([tail] if tail else []), len(tail)
        held.append(piece)
        length += len(piece) + 1
    return [*out, "\n\n".join(held)] if held else out


def _stripped_cuts(part: str, limit: int) -> Iterator[str]:
    while len(part) > limit:
        cut = Cutter(part[:limit]).cut(0, limit)
        yield part[:cut].strip()
        part = part[cut:].strip()
    if part:
        yield part


def _exploded(df: DataFrame, key: str, text: str, spans: Callable[[str], list[Span]], names: tuple[str, str, str]) -> DataFrame:
    number, start, end = names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(k, i, a, b, t[a:b]) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t for i, (a, b) in enumerate(spans(t))]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = (part.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key, number, start, end, "body"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(apply, f"{key} {kind}, {number} long, {start} long, {end} long, body string")


def chunks(df: DataFrame, key: str = "entry_id", text: str = "text", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_no, start, stop, body); each body is the exact substring."""
    return _exploded(df, key, text, lambda t: chunk_spans(t, size, overlap), ("chunk_no", "start", "stop"))


def windows(df: DataFrame, key: str = "entry_id", text: str = "text", size: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """(key, window_no, win_start, win_end, body)."""
    return _exploded(df, key, text, lambda t: window_spans(t, size, overlap), ("window_no", "win_start", "win_end"))


def paragraph_rows(df: DataFrame, key: str = "entry_id", text: str = "text") -> DataFrame:
    """(key, para_no, start, stop, body)."""
    return _exploded(df, key, text, paragraphs, ("para_no", "start", "stop"))


def slice_manifest(df: DataFrame, key: str = "entry_id", text: str = "text", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, slice_no, chars, sha256): the manifest of the slices of each text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i, s in enumerate(slice_texts(t, size, overlap))]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (batch.schema.types[0], pa.int64(), pa.string()), strict=True)], [key, "slice_no", "body"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text).mapInArrow(apply, f"{key} {kind}, slice_no long, body string")
    return rows.select(key, "slice_no", F.length("body").cast("bigint").alias("chars"), F.substring(F.sha2("body", 256), 1, 16).alias("sha256"))
