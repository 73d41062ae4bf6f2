"""Packing into optimal length buckets with token-budget batches.

Lengths are whitespace words (``[^\\x20\\x09-\\x0D]+``) of the whole text. The global
histogram of lengths (one row per distinct length) goes to a dynamic program that
chooses at most ``n_buckets`` upper bounds with the least total padding, each
sequence being padded to the bound of its bucket. Inside a bucket a batch holds as
many padded sequences as the token budget allows, one at least.

Positions inside a bucket come without sorting it in one task: rows are dealt out
by a hash into many slots of each bucket, the small table of slot sizes is summed
up, and a row's position is the sum before its slot plus its place in the slot.

Words are the measure of bounds, budget and padding alike: a text without spaces is one
word however long it is. ``lengths_of`` is the place to count otherwise.

Defined results for odd input: null and empty texts have length 0 and are packed
like any other; a text over the budget makes a batch of its own; a null doc_id is
packed too; repeated rows are packed one by one; an empty table gives an empty
result; texts of any length are counted whole; only doc_id and text are read. The histogram has at most as many rows as
the longest text has words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

SLOT_ROWS = 20_000


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least total padding.

    ``lengths`` ascend and are distinct; the last bound is the largest of them.
    The cost of a bucket is concave in the Monge sense, so the best last cut
    never moves back as the range grows, and each layer is found by halving.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n = len(lengths)
    if not n:
        return []
    rows = np.r_[0, np.cumsum(counts)]
    tokens = np.r_[0, np.cumsum(lengths * counts)]
    cost = lambda i, j: lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])  # noqa: E731  of lengths i..j-1
    infinite = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, infinite)
    best[0] = 0
    cuts = []
    for _ in range(min(n_buckets, n)):
        now, cut = np.full(n + 1, infinite), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            j0, j1, i0, i1 = todo.pop()
            j = (j0 + j1) // 2
            i = np.arange(i0, min(i1, j - 1) + 1)
            total = best[i] + cost(i, j)
            k = int(total.argmin())
            now[j], cut[j] = min(int(total[k]), infinite), i[k]
            if j0 < j:
                todo.append((j0, j - 1, i0, int(i[k])))
            if j < j1:
                todo.append((j + 1, j1, int(i[k]), i1))
        cuts.append(cut)
        if now[n] >= best[n]:  # more buckets don't help
            cuts.pop()
            break
        best = now
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
        if not j:
            break
    return bounds[::-1]


def lengths_of(documents: DataFrame) -> DataFrame:
    """doc_id, length and a hash that deals rows out, of every document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for start in range(0, batch.num_rows, 256):
                words += [len(t.split()) if t else 0 for t in batch.column(1).slice(start, 256).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), batch.column(2)], ["doc_id", "length", "mixed"])

    # a number for each row, so that repeated rows are dealt out like any others; the result is written before it is used
    chosen = documents.select("doc_id", "text", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("mixed"))
    return chosen.mapInArrow(apply, "doc_id long, length long, mixed long")


def bucket_of(length: Column, bounds: list[int]) -> Column:
    """The number of the first bucket whose bound is not below ``length``."""
    return F.aggregate(F.array(*[F.lit(b) for b in bounds[:-1]]).cast("array<bigint>"), F.lit(0), lambda n, b: n + (length > b).cast("int")) if len(bounds) > 1 else F.lit(0)


def pack(documents: DataFrame, n_buckets: int = 16, budget: int = 32_768) -> DataFrame:
    """doc_id, length, bucket, bucket_len, batch (number in the bucket), place (in the batch) and padding."""
    rows = materialise(lengths_of(documents), "lengths")
    histogram = rows.groupBy("length").count().toPandas().sort_values("length")
    bounds = optimal_bounds(histogram["length"].to_numpy(), histogram["count"].to_numpy(), n_buckets) or [0]
    slots = 1 + int(histogram["count"].sum()) // SLOT_ROWS
    bound = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in bounds]), F.col("bucket") + 1)
    dealt = rows.withColumn("bucket", bucket_of(F.col("length"), bounds)).withColumn("slot", F.pmod("mixed", F.lit(slots)))
    inside = W.partitionBy("bucket", "slot").orderBy("mixed", "doc_id", "length")
    before = W.partitionBy("bucket").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("bucket", "slot").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    placed = dealt.withColumn("at", F.row_number().over(inside) - 1).join(sizes, ["bucket", "slot"])
    at, per_batch = F.col("start") + F.col("at"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1))))
    return placed.select(
        "doc_id", "length", F.col("bucket").cast("int").alias("bucket"), bound.alias("bucket_len"),
        F.floor(at / per_batch).cast("bigint").alias("batch"), (at % per_batch).cast("bigint").alias("place"), (bound - F.col("length")).alias("padding"),
    )
