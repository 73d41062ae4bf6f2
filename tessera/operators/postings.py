"""A stored keyword index: positional postings of trigrams, and what queries read from it.

A posting row is (workspace, bucket, block, gram, places): all places of a trigram in a block of
chunks of a workspace. A block's texts, lower-cased, lie one after the other, each chunk's columns in
their order, and a place is a number from its start; ``places`` are the differences of neighbours, the
first one whole, as 32-bit numbers. A gram is a number, 21 bits for each of its
characters. Each block also has a row of gram ``DIRECTORY`` with its chunks in order: key, start,
length and the sizes of its columns, said once and not at each place. Rows are made block by block
where the chunks lie; readers filter on bucket and gram, so a query reads the rows of its own trigrams
and the directories, and no text. A term of n characters is found from the trigrams at 0, 3, 6, ...
and n - 3: it starts where all of them stand in their places.

Defined results for odd input: a null column has no places; a text of fewer than three
characters has none; a chunk without any is in its block's directory and in the statistics only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import query as q

BUCKETS = 16
BLOCK, BLOCK_CHARS = 2_048, 2_000_000
DIRECTORY = -1
KEY = ("workspace", "entry_id", "chunk_no")
CHUNK = "struct<entry_id:string,chunk_no:bigint,start:bigint,length:bigint,sizes:array<int>>"
SCHEMA = f"workspace string, bucket int, block string, gram long, places binary, chunks array<{CHUNK}>"
STATS = "workspace string, n long, length long"
_CHUNK = pa.struct([("entry_id", pa.string()), ("chunk_no", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("sizes", pa.list_(pa.int32()))])
_CHUNK_KEY = [(f.name, f.type) for f in _CHUNK][:4]
_OUT = pa.schema([("workspace", pa.string()), ("bucket", pa.int32()), ("block", pa.string()), ("gram", pa.int64()), ("places", pa.binary()), ("chunks", pa.list_(_CHUNK))])


def gram_codes(text: str) -> np.ndarray:
    """The trigrams of a text as numbers, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return points[:-2] | points[1:-1] << 21 | points[2:] << 42 if len(points) >= q.TRIGRAM else np.zeros(0, np.int64)


def chunk_length(columns: tuple[str, ...] = q.TEXT_COLUMNS) -> Column:
    """How many trigrams a chunk's columns have: its length in the ranking."""
    return sum((F.greatest(F.lit(0), F.length(F.coalesce(F.col(c), F.lit(""))) - (q.TRIGRAM - 1)) for c in columns), F.lit(0)).cast("bigint")


def _sorted_grams(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at``, ascending ones, by the code of the trigram there, and where each code begins.

    Code and place are sorted as one number where the block's alphabet leaves room for both.
    """
    if not len(at):
        return at, at
    seen = np.unique(points)
    number = np.zeros(int(seen[-1]) + 1, np.int64)
    number[seen] = np.arange(len(seen))
    each, rest = max(len(seen) - 1, 1).bit_length(), len(points).bit_length()
    own = number[points]
    if 3 * each + rest > 63:
        at = at[np.lexsort((own[at], own[at + 1], own[at + 2]))]
        new = (np.diff(own[at]) != 0) | (np.diff(own[at + 1]) != 0) | (np.diff(own[at + 2]) != 0)
    else:
        packed = (own[:-2] | own[1:-1] << each | own[2:] << 2 * each) << rest | np.arange(len(own) - 2)
        packed = packed[at]
        packed.sort()
        at = packed & (1 << rest) - 1
        packed >>= rest
        new = packed[1:] != packed[:-1]
    return at, np.flatnonzero(np.r_[True, new])


def _block(part: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """The rows of one block: its directory and a row for each trigram."""
    width = len(q.TEXT_COLUMNS)
    columns = [part.column(5 + c).to_pylist() for c in range(width)]
    pieces = [(text or "").encode("utf-32-le", "surrogatepass") for row in zip(*columns, strict=True) for text in row]
    points = np.frombuffer(b"".join(pieces), "<u4").astype(np.int64)
    size = np.array([len(p) // 4 for p in pieces], np.int64)
    grams = np.maximum(size - (q.TRIGRAM - 1), 0)
    at = np.arange(grams.sum()) + np.repeat(np.cumsum(size) - size - np.cumsum(grams) + grams, grams)
    at, gram = _sorted_grams(points, at)
    first = at[gram]
    found = points[first] | points[first + 1] << 21 | points[first + 2] << 42
    n = len(found)
    step = np.diff(at, prepend=0)
    step[gram] = first
    places = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * np.r_[gram, len(at)]).astype(np.int32)), pa.py_buffer(step.astype("<i4"))])
    sizes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(size) + 1, width, np.int32)), pa.array(size.astype(np.int32)))
    known = pa.StructArray.from_arrays([*(part.column(c) for c in range(1, 5)), sizes], fields=list(_CHUNK))
    directory = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), known)
    name = f"{part.column(1)[0].as_py()}#{part.column(2)[0].as_py()}"
    return pa.RecordBatch.from_arrays([
        pa.array([part.column(0)[0].as_py()] * (n + 1), pa.string()), pa.array(np.r_[DIRECTORY, found % 1_000_003 % buckets].astype(np.int32)), pa.array([name] * (n + 1), pa.string()),
        pa.array(np.r_[DIRECTORY, found]), pa.concat_arrays([pa.nulls(1, places.type), places]), pa.concat_arrays([directory, pa.nulls(n, directory.type)]),
    ], schema=_OUT)


def build(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the index of ``chunks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            chars = np.asarray(batch.column(4)).astype(np.int64)
            first = held = 0
            for i in range(batch.num_rows + 1):  # a block has one workspace, and is long only where one chunk is
                if i == batch.num_rows or i > first and (names[i] != names[first] or i - first == BLOCK or held + chars[i] > BLOCK_CHARS):
                    if i > first:
                        yield _block(batch.slice(first, i - first), buckets)
                    first, held = i, 0
                if i < batch.num_rows:
                    held += chars[i]

    rows = chunks.select(*KEY, "start", chunk_length().alias("length"), *[F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in q.TEXT_COLUMNS])
    return rows.sortWithinPartitions(*KEY).mapInArrow(run, SCHEMA)


def statistics(chunks: DataFrame) -> DataFrame:
    """(workspace, n, length): number of chunks and sum of their lengths."""
    return chunks.groupBy("workspace").agg(F.count("*").alias("n"), F.sum(chunk_length()).alias("length"))


def stored_statistics(postings: DataFrame) -> DataFrame:
    """The same of the chunks of a stored index, from its directories alone."""
    known = postings.where((F.col("bucket") == DIRECTORY) & (F.col("gram") == DIRECTORY)).select("workspace", F.explode("chunks").alias("c"))
    return known.groupBy("workspace").agg(F.count("*").alias("n"), F.sum("c.length").alias("length"))


def usable(query: q.Query) -> bool:
    """Whether the index can answer a query: all that is scored has a trigram."""
    return bool(query.terms) and all(len(p) >= q.TRIGRAM for p in query.phrases)


def _offsets(body: str) -> list[tuple[int, int]]:
    """(gram, offset) of the trigrams that cover a lower-cased term."""
    codes = gram_codes(body).tolist()
    return [(codes[i], i) for i in sorted({*range(0, len(codes), q.TRIGRAM), len(codes) - 1})]


def _without_overlap(positions: Column, n: int) -> Column:
    """How many of a term's sorted places are left if none overlaps the one before."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda s, p: F.when(p >= s["end"], F.struct((p + n).alias("end"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(positions, start, step, lambda s: s["n"])


def _near(item: q.Near, places: dict[str, Column]) -> Column:
    """Whether all bodies of a NEAR group stand in some order, no further apart than it allows."""
    gap = max(item.distance - (q.TRIGRAM - 1), 0)

    def after(reached: Column, n: int, body: str) -> Column:
        return F.filter(places[body], lambda s: F.exists(reached, lambda a: (s - a - n).between(0, gap)))

    def ordered(bodies: tuple[str, ...]) -> Column:
        reached = places[bodies[0]]
        for before, body in itertools.pairwise(bodies):
            reached = after(reached, len(before), body)
        return F.size(reached) > 0

    return reduce(Column.__or__, map(ordered, itertools.permutations([b.lower() for b in item.bodies])))


def _positions(grams: dict[int, str]):
    """For a block's rows: key, start, length and column of each text that has one of ``grams``, with the positions of each in it."""
    kinds = [("workspace", pa.string()), *_CHUNK_KEY, ("col", pa.int32()), *((c, pa.list_(pa.int32())) for c in grams.values())]

    def apply(block: pa.Table) -> pa.Table:
        found = {g: np.frombuffer(block.column("places")[i].as_py(), "<i4").cumsum() for i, g in enumerate(block.column("gram").to_pylist()) if g != DIRECTORY}
        known = block.filter(pc.equal(block.column("gram"), DIRECTORY)).column("chunks").combine_chunks().flatten()
        end = np.cumsum(known.field("sizes").flatten().to_numpy())
        slots = {g: np.searchsorted(end, at, "right") for g, at in found.items()}
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *slots.values()]))
        begin = np.r_[0, end][used]
        lists = []
        for g in grams:
            row = np.searchsorted(used, slots[g]) if g in found else np.zeros(0, np.int64)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(used)))].astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array((found[g] - begin[row] + 1 if g in found else row).astype(np.int32))))
        own = known.take(pa.array(used // len(q.TEXT_COLUMNS)))
        names = pa.array([block.column("workspace")[0].as_py()] * len(used), pa.string())
        return pa.Table.from_arrays([names, *(own.field(k) for k, _ in _CHUNK_KEY), pa.array((used % len(q.TEXT_COLUMNS)).astype(np.int32)), *lists], schema=pa.schema(kinds))

    return apply


def term_counts(postings: DataFrame, query: q.Query) -> DataFrame:
    """For each chunk that has a term: key, start, _length, _f<i> of the query's terms, _near<i> of its NEAR groups, coverage, tf and first (place of the first phrase).

    The places of the query's own trigrams and the directories are shuffled by block, then numbers by chunk.
    """
    terms, groups = query.terms, [i for i in query.items if isinstance(i, q.Near)]
    bodies = sorted({*(t.body.lower() for t in terms), *(p.lower() for p in query.phrases)})
    grams = {g: f"_g{i}" for i, g in enumerate(sorted({g for b in bodies for g, _ in _offsets(b)}))}
    wanted = sorted({DIRECTORY, *(g % 1_000_003 % BUCKETS for g in grams)})
    rows = postings.where(F.col("bucket").isin(wanted) & F.col("gram").isin([DIRECTORY, *grams])).select("workspace", "block", "gram", "places", "chunks")
    kinds = "workspace string, entry_id string, chunk_no long, start long, length long, col int" + "".join(f", {c} array<int>" for c in grams.values())
    each = rows.groupBy("workspace", "block").applyInArrow(_positions(grams), kinds)
    empty = F.array().cast("array<int>")

    def found(body: str) -> Column:
        starts = lambda g, offset: F.transform(F.coalesce(F.col(grams[g]), empty), lambda x: x - offset)
        return reduce(F.array_intersect, [starts(g, offset) for g, offset in _offsets(body)])

    each = each.select(*KEY, "col", "start", "length", *[found(b).alias(f"_b{i}") for i, b in enumerate(bodies)])
    places = {b: F.col(f"_b{i}") for i, b in enumerate(bodies)}
    inside = F.col("col") == q.TEXT_COLUMNS.index("chunk_text")
    sums = []
    for i, t in enumerate(terms):
        allowed = F.col("col").isin([q.TEXT_COLUMNS.index(c) for c in t.columns])
        sums.append(F.sum(F.when(allowed, F.size(places[t.body.lower()])).otherwise(0)).cast("double").alias(f"_f{i}"))
    sums += [F.max(_near(g, places) if all(len(b) >= q.TRIGRAM for b in g.bodies) else F.lit(False)).alias(f"_near{i}") for i, g in enumerate(groups)]
    own = [F.when(inside, places[p.lower()]).otherwise(empty) for p in query.phrases]
    coverage = sum((F.max((F.size(p) > 0).cast("int")) for p in own), F.lit(0)).cast("bigint")
    tf = sum((F.max(F.least(F.lit(5).cast("bigint"), _without_overlap(p, len(b)))) for p, b in zip(own, query.phrases, strict=True)), F.lit(0).cast("bigint"))
    first = F.min(F.array_min(F.flatten(F.array(*own)))) if own else F.lit(None).cast("int")
    return each.groupBy(*KEY).agg(F.first("start").alias("start"), F.first("length").cast("double").alias("_length"), *sums, coverage.alias("coverage"), tf.alias("tf"), first.alias("first"))
