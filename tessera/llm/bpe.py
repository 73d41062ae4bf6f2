"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The model is built from a rank file: every pair of tokens whose concatenation is
a token becomes a merge, ordered by the rank of what it makes, and the bytes are
shown to the library as the characters of the usual byte-to-character table.
Texts are parted by the pattern; each distinct part is encoded once by the
library and kept in a bounded cache, so that a batch costs one split and one
lookup per part. Decoding maps ids to tokens and tokens back to bytes by the
reversed byte table; ``spans`` and ``decode_pieces`` handle characters whose
bytes are split between tokens.

Defined results for odd input: a null text counts as empty and gives no ids and
the digest of nothing; texts of any length are encoded whole, part by part; a
null doc_id is carried through; repeated rows and ties are encoded alike; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

CACHE_PARTS = 400_000
CACHED_LENGTH = 64


BEYOND_LATIN = re.compile("[^\x00-\u0377]")


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """Code points that the two libraries class differently, each with a character of tiktoken's class."""
    every = "".join(chr(c) for c in range(0x378, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    out, moved = {}, set()
    for one, likeness in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\u2003")):
        theirs = set(bytes(tiktoken.Encoding("one", pat_str=one, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        ours = set(regex.findall(one, every))
        out |= {ord(c): likeness for c in theirs - ours}
        moved |= ours - theirs
    return {ord(c): "\u20ac" for c in moved if ord(c) not in out} | out


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes with one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        shown = byte_characters()
        show = lambda b: "".join(map(shown.__getitem__, b))
        pairs = sorted((rank, i) for token, rank in self.ranks.items() for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks)
        by_rank = {rank: token for token, rank in self.ranks.items()}
        merges = [(show(by_rank[rank][:i]), show(by_rank[rank][i:])) for rank, i in pairs]
        self.model = Tokenizer(models.BPE(vocab={show(t): r for t, r in self.ranks.items()}, merges=merges, ignore_merges=True))
        self.show = show
        self.byte_of = {c: b for b, c in enumerate(shown)}
        size = max(self.ranks.values()) + 1
        self.tokens = [self._bytes(self.model.id_to_token(i)) if i in by_rank else b"" for i in range(size)]
        self.parts: dict[str, bytes] = {}

    def _bytes(self, token: str) -> bytes:
        return bytes(map(self.byte_of.__getitem__, token))

    def _part(self, part: str) -> bytes:
        ids = self.model.encode(self.show(part.encode()), add_special_tokens=False).ids
        found = np.array(ids, "<u4").tobytes()
        if len(part) <= CACHED_LENGTH:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            self.parts[part] = found
        return found

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, make = self.parts.get, self._part
        return b"".join([known(p) or make(p) for p in self.split(text)])

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, with the character classes that tiktoken has.

        The two libraries follow different Unicode versions. A text with a
        character that they class differently is matched with a stand-in of the
        right class, and the parts are cut from the text itself.
        """
        if text.isascii() or not BEYOND_LATIN.search(text) or stand_ins().keys().isdisjoint(map(ord, text)):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(stand_ins()))]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first character, end character) of each token; one that holds a part of a character spans it."""
        starts = np.cumsum([0] + [len(c.encode()) for c in text])
        out, at = [], 0
        for i in self.encode(text):
            end = at + len(self.tokens[i])
            out.append((i, int(np.searchsorted(starts, at, side="right")) - 1, int(np.searchsorted(starts, end, side="left"))))
            at = end
        return out

    def decode_pieces(self, ids: list[int]) -> list[str]:
        """The text each id completes; a character split between ids comes with the last of them."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        pieces = [decoder.decode(self.tokens[i]) for i in ids]
        if ids:
            pieces[-1] += decoder.decode(b"", True)
        return pieces


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker; ``path`` may name a file shipped with ``SparkContext.addFile``."""
    try:
        return Codec(path, pattern)
    except FileNotFoundError:
        return Codec(SparkFiles.get(path.rsplit("/", 1)[-1]), pattern)


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (packed little-endian uint32) of every document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, pattern).encode_packed
        for batch in _parts(batches):
            ids = [encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(apply, "doc_id long, ids binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass over the batches."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in _parts(batches):
            packed = [own.encode_packed(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(own.decode_bytes(p)).hexdigest() for p in packed], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select("doc_id", "text").mapInArrow(apply, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
