"""Exact removal of repeated 50-byte strings by prefix-free parsing.

Every byte covered by a ``WIDTH``-byte string that also starts in a document with
a smaller doc_id is removed; strings are judged on the input texts.

Parsing. A rolling hash of ``GRAM`` bytes is taken at every byte; the smallest hash
in a window of ``WIDTH`` bytes is the window's trigger, and a phrase is a maximal
run of windows with the same trigger. So each window lies in exactly one phrase,
the parse around it depends on nothing but its own bytes, and equal windows have
equal triggers. Phrases overlap by WIDTH - 1 bytes; no phrase's suffix of that
length or more is needed from its neighbour, which is the property that
prefix-free parsing rests on: order and equality of text suffixes up to ``WIDTH``
bytes are order and equality of dictionary suffixes.

Steps, all on tables in the shared folder or shuffles:

1. Documents are packed into batches (a table bucketed by batch, so that later
   joins shuffle only what they bring to it).
2. Each batch parses its texts and sends, per distinct phrase, the trigger, a
   hash and the smallest doc_id: copies collapse before the shuffle.
3. Per trigger: if all batches have one phrase for it, the smallest doc_id is
   known. If there are several phrases, their texts are asked from one batch each
   (the dictionary), and the dictionary's suffix array (to depth WIDTH) joined
   with the parse (which phrase occurs in which batch, from which document on)
   gives the smallest doc_id of each window.
4. Each batch gets the doc_ids that are smaller than those it knows itself, parses
   its texts again and removes what is covered.

The full suffix array of the parse isn't built: to depth WIDTH the dictionary's
order is the corpus order, and equal suffixes are ordered by doc_id.

Phrases are told apart by a 56-bit trigger and a 48-bit hash (104 bits together);
texts are compared byte by byte wherever a trigger has more than one phrase.

Defined results for odd input: a null or empty text has no bytes and nothing is
removed; rows that repeat a doc_id don't affect each other; a null doc_id neither
removes nor loses anything; texts of any length are parsed whole (in overlapping
slices); an empty table gives an empty result; extra columns are ignored by
``remove_repeats`` and kept by ``filter_documents``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, materialise

ID, TEXT = "doc_id", "text"
BATCH_COLUMNS = ["batch", "rest", "sizes", "text"]
WIDTH, GRAM = 50, 20
SPAN = WIDTH - GRAM + 1
BATCH_BYTES, SLICE_BYTES, LONGEST_RUN = 4 << 20, 1 << 19, 255
LOW56, LOW48 = np.uint64((1 << 56) - 1), np.uint64((1 << 48) - 1)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BYTE_HASH = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= C2
    x ^= x >> np.uint64(29)
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * C1 + b)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM (20) bytes from each position on, by doubling 1, 2, 4, 8, 16."""
    h1 = BYTE_HASH[data]
    h2 = _pair(h1[:-1], h1[1:])
    h4 = _pair(h2[:-2], h2[2:])
    h8 = _pair(h4[:-4], h4[4:])
    h16 = _pair(h8[:-8], h8[8:])
    return _pair(h16[:-4], h4[16:])


def _power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    """C3 ** i and C3 ** -i modulo 2 ** 64, for i below ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(C3), -1, 1 << 64))
        for base in (C3, inverse):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def phrases(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, windows, trigger, hash of the phrases of texts that end at ``stops`` in ``data``."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    m = np.minimum(h[:-1], h[1:])
    for step in (2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[: n], m[SPAN - 16 : SPAN - 16 + n])
    starts = np.r_[0, stops[:-1]]
    edge = np.zeros(n + 1, bool)  # a phrase begins here, or the valid windows of a text end
    edge[1:n] = m[1:] != m[:-1]
    last = stops - WIDTH + 1  # after the last window of each text
    has = last > starts
    edge[starts[has]] = True
    edge[last[has]] = True
    at = np.flatnonzero(edge)
    of = np.searchsorted(stops, at, side="right")
    inside = (at < n) & (at < np.r_[last, 0][of])
    begin, windows = at[inside], np.diff(np.r_[at, n])[inside]
    if len(windows) and windows.max() > LONGEST_RUN:
        parts = -(-windows // LONGEST_RUN)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        k = np.arange(len(first)) - first
        begin, windows = np.repeat(begin, parts) + k * LONGEST_RUN, np.minimum(np.repeat(windows, parts) - k * LONGEST_RUN, LONGEST_RUN)
    up, down = _power_pair(len(h) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)])]
    own = (sums[begin + windows + SPAN - 1] - sums[begin]) * down[begin]
    return begin, windows, m[begin] & LOW56, _mix(own + windows.astype(np.uint64)) & LOW48


class Batch:
    """The texts of one packed row (with all other columns), and their parse."""

    def __init__(self, row: dict):
        self.number = row["batch"]
        self.rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
        ids = self.rest.column(ID)
        self.known, self.ids = pc.is_valid(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.data = np.frombuffer(_unzip(row["text"]), np.uint8)

    def parse(self) -> tuple[np.ndarray, ...]:
        """start, windows, trigger, hash and row of every phrase; rows without doc_id have none."""
        stops = np.cumsum(self.sizes)
        found, at, row = [], 0, 0
        while at < len(self.data):
            end = min(at + SLICE_BYTES, len(self.data))
            cut = int(np.searchsorted(stops, end, side="right"))
            reach = end
            if cut < len(stops) and (cut == 0 or stops[cut - 1] <= at):
                reach = min(end + WIDTH - 1, int(stops[cut]))  # within one long text: slices overlap
            elif cut:
                end = reach = int(stops[cut - 1])
            inner = stops[row:cut] - at
            inner = np.r_[inner, reach - at] if not len(inner) or inner[-1] < reach - at else inner
            begin, windows, trigger, mark = phrases(self.data[at:reach], inner)
            rows = np.searchsorted(stops, begin + at, side="right")
            keep = self.known[rows]
            found.append((begin[keep] + at, windows[keep], trigger[keep], mark[keep], rows[keep]))
            at = end
            row = int(np.searchsorted(stops, at, side="right"))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _each(source: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one at a time: a packed row is some MB, and memory goes back after each."""
    for rows in source:
        for i in range(rows.num_rows):
            yield rows.slice(i, 1).to_pylist()[0]
            pa.default_memory_pool().release_unused()


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, plane by plane."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def pack_columns(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of 64-bit values with the bytes each needs; the first is delta coded if it ascends."""
    n, body = len(columns[0][0]), b""
    for i, (values, width) in enumerate(columns):
        values = values.astype(np.int64).view(np.uint64) if values.dtype.kind == "i" else values
        body += _planes(np.diff(values, prepend=np.uint64(0)) if i == 0 else values, width)
    return n.to_bytes(8, "little") + _zip(body)


def unpack_columns(data: bytes, *widths: int) -> list[np.ndarray]:
    n, body, at, out = int.from_bytes(data[:8], "little"), _unzip(data[8:]), 0, []
    for i, width in enumerate(widths):
        values = _unplanes(body[at : at + n * width], n, width)
        out.append(np.cumsum(values) if i == 0 else values)
        at += n * width
    return out


#: trigger, hash, windows, smallest doc_id, 1 if the batch has it in several documents
CLASS = (8, 6, 1, 8, 1)


def _by_key(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins, rows taken in ``order``."""
    if not len(order):
        return np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return np.flatnonzero(new)


def batches_of(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs rows into batch rows: texts in one block, all other columns in another."""
    number = TaskContext.get().partitionId() << 24
    rests, texts, size = [], [], 0

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rests[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(pa.Table.from_batches(rests).combine_chunks())
        columns = [sink.getvalue().to_pybytes(), np.array([len(t) for t in texts], np.int64).tobytes(), _zip(b"".join(texts))]
        return pa.record_batch([pa.array([number], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], BATCH_COLUMNS)

    for rows in source:
        at = rows.schema.names.index(TEXT)
        names = [n for n in rows.schema.names if n != TEXT]
        for start in range(0, rows.num_rows, 256):
            part = rows.slice(start, 256)
            rests.append(pa.record_batch([c for i, c in enumerate(part.columns) if i != at], names))
            more = [t or b"" for t in part.column(at).cast(pa.large_binary()).to_pylist()]
            texts += more
            size += sum(map(len, more))
            if size >= BATCH_BYTES:
                yield packed()
                rests, texts, size, number = [], [], 0, number + 1
    if rests:
        yield packed()


def _classes(bits: int):
    """Step 2: the distinct phrases of each batch, by bucket of triggers."""

    def apply(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(source):
            batch = Batch(row)
            _, windows, trigger, mark, at = batch.parse()
            doc = batch.ids[at]
            order = np.lexsort((mark, trigger))
            first = _by_key(order, trigger, mark)
            if not len(first):
                continue
            doc = doc[order]
            low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
            t, h, w = trigger[order][first], mark[order][first], windows[order][first]
            bucket = (t >> np.uint64(56 - bits)).astype(np.int64)
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            blobs = [pack_columns((t[a:b], 8), (h[a:b], 6), (w[a:b], 1), (low[a:b], 8), ((low != high)[a:b].astype(np.int64), 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([pa.array(bucket[cuts[:-1]]), pa.array(np.full(len(blobs), batch.number, np.int64)), pa.array(blobs, pa.binary())], ["bucket", "batch", "found"])

    return apply


RESULT, REQUEST, PARSE = 0, 1, 2


def _resolve(table: pa.Table) -> pa.Table:
    """Step 3, per bucket: results for triggers with one phrase; requests and parse rows for the others."""
    bucket, batch_ids = table["bucket"][0].as_py(), table["batch"].to_numpy()
    columns = [unpack_columns(b, *CLASS) for b in table["found"].to_pylist()]
    t, h, w, low, several = (np.concatenate(c) for c in zip(*columns, strict=True))
    low, batch = low.view(np.int64), np.repeat(batch_ids, [len(c[0]) for c in columns])
    order = np.lexsort((batch, h, t))
    t, h, w, low, several, batch = (x[order] for x in (t, h, w, low, several, batch))
    every = np.arange(len(t))
    by_class, by_trigger = _by_key(every, t, h), _by_key(every, t)
    size = np.diff(np.r_[by_trigger, len(t)])
    n_classes = np.diff(np.r_[np.searchsorted(by_class, by_trigger), len(by_class)])
    least, most = np.minimum.reduceat(low, by_trigger), np.maximum.reduceat(low, by_trigger)
    across = (least != most) | (np.add.reduceat(several, by_trigger) > 0)
    one = np.repeat(n_classes == 1, size)
    lower = np.repeat(least, size)
    out: list[tuple[int, int, int, bytes]] = []

    def by_batch(chosen: np.ndarray, kind: int, columns: Callable[[np.ndarray], tuple]) -> None:
        rows = np.flatnonzero(chosen)
        rows = rows[np.argsort(batch[rows], kind="stable")]
        cuts = np.r_[_by_key(rows, batch), len(rows)]
        out.extend((kind, bucket, int(batch[rows[a]]), pack_columns(*columns(rows[a:b]))) for a, b in zip(cuts, cuts[1:], strict=False))

    by_batch(one & (lower < low), RESULT, lambda r: ((t[r], 8), (h[r], 6), (w[r], 1), (lower[r], 8)))
    unsure = np.repeat((n_classes > 1) & across, size)
    by_batch(unsure & np.isin(every, by_class), REQUEST, lambda r: ((t[r], 8), (h[r], 6)))
    by_batch(unsure, PARSE, lambda r: ((t[r], 8), (h[r], 6), (w[r], 1), (low[r], 8)))
    kinds, buckets, batches, blobs = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.table([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int64()), pa.array(batches, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "bucket", "batch", "found"])


def _numbering(t: np.ndarray, h: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """One number for each pair of a trigger and a hash among those given: both in full, as ranks side by side."""
    triggers, hashes = np.unique(t), np.unique(h)
    return lambda t, h: (np.searchsorted(triggers, t).astype(np.uint64) << np.uint64(32)) | np.searchsorted(hashes, h).astype(np.uint64)


def _texts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: the texts of the phrases that buckets ask a batch for."""
    for row in _each(source):
        batch = Batch(row)
        begin, windows, trigger, mark, _ = batch.parse()
        number = _numbering(trigger, mark)
        key = number(trigger, mark)
        order = np.argsort(key, kind="stable")
        out = []
        for ask in row["asked"]:
            t, h = unpack_columns(ask["found"], 8, 6)
            at = order[np.searchsorted(key, number(t, h), sorter=order)]
            pieces = [self_bytes(batch.data, begin[i], windows[i]) for i in at]
            out.append((ask["bucket"], pack_columns((t, 8), (h, 6), (windows[at], 1)), _zip(b"".join(pieces))))
        buckets, heads, texts = zip(*out, strict=True)
        yield pa.record_batch([pa.array(buckets, pa.int64()), pa.array(heads, pa.binary()), pa.array(texts, pa.binary())], ["bucket", "heads", "texts"])


def self_bytes(data: np.ndarray, begin: int, windows: int) -> bytes:
    return data[begin : begin + windows + WIDTH - 1].tobytes()


def suffix_ranks(data: np.ndarray) -> np.ndarray:
    """The rank of each suffix among all, by its first WIDTH (50) bytes; ends are padded."""
    padded = np.r_[data, np.zeros(WIDTH + 8, np.uint8)]
    n = len(data) + WIDTH
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    for step in (8, 16, WIDTH - 32):
        key = (rank[: len(rank) - step] << np.uint64(32)) | rank[step:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    return rank


def _combine(key: tuple, parse: pa.Table, texts: pa.Table) -> pa.Table:
    """Step 3: dictionary suffixes and parse give the smallest doc_id of each window of each phrase."""
    names = ["batch", "found"]
    if not parse.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names)
    columns = [unpack_columns(b, 8, 6, 1, 8) for b in parse["found"].to_pylist()]
    batch = np.repeat(parse["batch"].to_numpy(), [len(c[0]) for c in columns])
    t, h, w, low = (np.concatenate(c) for c in zip(*columns, strict=True))
    low = low.view(np.int64)
    heads = [unpack_columns(b, 8, 6, 1) for b in texts["heads"].to_pylist()]
    dt, dh, dw = (np.concatenate(c) for c in zip(*heads, strict=True))
    data = np.frombuffer(b"".join(map(_unzip, texts["texts"].to_pylist())), np.uint8)
    dw = dw.astype(np.int64)
    d_start = np.cumsum(dw + WIDTH - 1) - (dw + WIDTH - 1)
    number = _numbering(dt, dh)
    mark, d_mark = number(t, h), number(dt, dh)
    sorter = np.argsort(d_mark, kind="stable")
    entry = sorter[np.searchsorted(d_mark, mark, sorter=sorter)]  # the dictionary phrase of each parse row
    least = np.full(len(dt), np.iinfo(np.int64).max)
    np.minimum.at(least, entry, low)
    of = np.repeat(np.arange(len(dw)), dw)
    window = d_start[of] + np.arange(dw.sum()) - np.repeat(np.cumsum(dw) - dw, dw)
    rank = suffix_ranks(data)[window]
    order = np.argsort(rank, kind="stable")
    first = _by_key(order, rank)
    lowest = np.empty(len(window), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(least[of][order], first), np.diff(np.r_[first, len(order)]))
    w_start = np.cumsum(dw) - dw
    better = np.minimum.reduceat(lowest, w_start)[entry] < low
    out: list[tuple[int, bytes]] = []
    rows = np.flatnonzero(better)
    rows = rows[np.lexsort((t[rows], batch[rows]))]
    cuts = np.r_[_by_key(rows, batch), len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        r = rows[a:b]
        e = entry[r]
        count = dw[e]
        spread = np.repeat(w_start[e], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        head = pack_columns((t[r], 8), (h[r], 6), (w[r], 1))
        out.append((int(batch[r[0]]), len(head).to_bytes(8, "little") + head + _zip(lowest[spread].tobytes())))
    batches, blobs = zip(*out, strict=True) if out else ([], [])
    return pa.table([pa.array(batches, pa.int64()), pa.array(blobs, pa.binary())], names)


def removed_bytes(batch: Batch, results: list[dict]) -> np.ndarray:
    """Step 4: True for each byte of the batch that goes."""
    begin, windows, trigger, mark, row = batch.parse()
    doc = batch.ids[row]
    gone = np.zeros(len(batch.data) + 1, np.int32)
    if len(begin):
        number = _numbering(trigger, mark)
        key = number(trigger, mark)
        order = np.argsort(key, kind="stable")
        first = _by_key(order, key)
        names = key[order][first]
        of = np.empty(len(key), np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        low = np.minimum.reduceat(doc[order], first)
        each: dict[int, np.ndarray] = {}
        for result in results:
            if result["kind"] == RESULT:
                t, h, _, lower = unpack_columns(result["found"], 8, 6, 1, 8)
                at = np.searchsorted(names, number(t, h))
                low[at] = np.minimum(low[at], lower.view(np.int64))
            else:
                n = int.from_bytes(result["found"][:8], "little")
                t, h, w = unpack_columns(result["found"][8 : 8 + n], 8, 6, 1)
                lowest = np.frombuffer(_unzip(result["found"][8 + n :]), np.int64)
                ends = np.cumsum(w.astype(np.int64))
                for c, a, b in zip(np.searchsorted(names, number(t, h)).tolist(), (ends - w.astype(np.int64)).tolist(), ends.tolist(), strict=True):
                    each[c] = lowest[a:b]
        apart = np.isin(of, np.fromiter(each, np.int64, len(each))) if each else np.zeros(len(of), bool)
        goes = ~apart & (doc > low[of])
        np.add.at(gone, begin[goes], 1)
        np.add.at(gone, begin[goes] + windows[goes] + WIDTH - 1, -1)
        for i in np.flatnonzero(apart):
            hit = begin[i] + np.flatnonzero(doc[i] > np.minimum(each[int(of[i])], low[of[i]]))
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + WIDTH, -1)
    return np.cumsum(gone, out=gone)[:-1] > 0


def _left(batch: Batch, gone: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The bytes left of each text and the number of runs taken from it."""
    stops = np.cumsum(batch.sizes)
    starts = stops - batch.sizes
    left = [batch.data[a:b][~gone[a:b]].tobytes() for a, b in zip(starts, stops, strict=True)]
    edges = gone & ~np.r_[False, gone[:-1]]
    firsts = starts[batch.sizes > 0]
    edges[firsts] = gone[firsts]  # a run doesn't go on across texts
    total = np.r_[0, np.cumsum(edges)]
    return left, total[stops] - total[starts]


def _digests(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: what was removed of each document, and the digest of what is left."""
    for row in _each(source):
        batch = Batch(row)
        left, spans = _left(batch, removed_bytes(batch, row["results"] or []))
        removed = batch.sizes - np.array([len(x) for x in left], np.int64)
        kept = pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())
        yield pa.record_batch([batch.rest.column(ID).combine_chunks(), pa.array(batch.sizes), pa.array(removed), pa.array(spans, pa.int64()), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut_texts(names: list[str], nulls: str):
    """Step 4: the documents with what is left of their texts; a cut character goes as a whole."""

    def apply(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(source):
            batch = Batch(row)
            left, _ = _left(batch, removed_bytes(batch, row["results"] or []))
            null = batch.rest.column(nulls).to_pylist()
            texts = pa.array([None if n else x.decode("utf-8", "ignore") for x, n in zip(left, null, strict=True)], pa.string())
            yield pa.record_batch([texts if n == TEXT else batch.rest.column(n).combine_chunks() for n in names], names)

    return apply


MOST_BUCKETS = 1 << 16


def bucket_count(size: int) -> int:
    """Buckets of the batch table: about two batches a task, more of them beyond ``MOST_BUCKETS`` (tables have less than 100,000)."""
    return min(max(8, size >> 23), MOST_BUCKETS)


def _prepared(source: DataFrame) -> DataFrame:
    """The batch table joined with the results that each batch needs."""
    size = source.agg(F.sum(F.octet_length(TEXT).cast("bigint"))).first()[0] or 0
    parts, bits = bucket_count(size), max(4, math.ceil(math.log2(max(size >> 22, 1))))
    batches = bucketed(source.mapInArrow(batches_of, "batch long, rest binary, sizes binary, text binary"), parts, "batch")
    classes = batches.mapInArrow(_classes(bits), "bucket long, batch long, found binary")
    sorted_out = materialise(classes.groupBy("bucket").applyInArrow(_resolve, "kind int, bucket long, batch long, found binary"), "resolved")

    def gathered(rows: DataFrame, column: str) -> DataFrame:
        return rows.repartition(parts, "batch").groupBy("batch").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "batch"])).alias(column))

    asked = gathered(sorted_out.where(F.col("kind") == REQUEST).select("batch", "bucket", "found"), "asked")
    texts = batches.join(asked, "batch").mapInArrow(_texts, "bucket long, heads binary, texts binary")
    parse = sorted_out.where(F.col("kind") == PARSE).select("bucket", "batch", "found")
    combined = parse.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(_combine, "batch long, found binary")
    results = sorted_out.where(F.col("kind") == RESULT).select("batch", "kind", "found").unionByName(combined.select("batch", F.lit(PARSE).alias("kind"), "found"))
    return batches.join(gathered(results, "results"), "batch", "left")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    ready = _prepared(documents.select("doc_id", "text"))
    return ready.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def filter_documents(documents: DataFrame) -> DataFrame:
    """The documents without repeated strings, all other columns as they are.

    Cutting bytes may cut a character; what is left of it goes too. A text of
    which nothing is left stays as an empty one, a null text stays null.
    """
    nulls = next(n for n in (f"_null{i or ''}" for i in range(len(documents.columns) + 1)) if n not in documents.columns)
    ready = _prepared(documents.withColumn(nulls, F.col("text").isNull()))
    return ready.mapInArrow(_cut_texts(documents.columns, nulls), documents.schema)
