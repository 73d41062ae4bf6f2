"""Exact top-k search by the three-phase uniform threshold algorithm.

A vector is cut into ``N_LISTS`` slices of dimensions, and each slice gives every
(query, candidate) pair a local score; the score is the sum of these. Candidates
and queries are packed into blocks, and a task handles pairs of blocks.

1. Gather: per block and query, the k highest entries of each local list are
   taken and scored in full; the k-th best over all blocks is a lower bound of the
   query's true k-th score.
2. Broadcast: this bound goes back to all blocks with the queries. A candidate
   that reaches it has at least one local score of a uniform N_LISTS-th of it, so
   just such entries are collected.
3. Resolve: what was collected is scored exactly, and the k best of each query
   remain, ties to the smaller vec_id.

Scores are integer inner products of floor(scale * x); they are exact while they
stay below 2**63 (double arithmetic is used below 2**53).

Defined results for odd input: null vectors, vectors with null or non-finite
components and rows without vec_id take no part; a shorter vector counts as
continued with zeros; rows that repeat a vec_id are candidates each for others,
never for their own id, and as a query the smallest of their vectors counts;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

N_LISTS = 2
CANDIDATE_ROWS, QUERY_ROWS = 4096, 256
NO_BOUND = -(1 << 62)
PENDING = 20_000


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = table.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad)
    return usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Packed blocks of at most ``rows`` vectors: ids, bounds, width and values as bytes.

    ``vectors`` has vec_id, v and, for queries, bound.
    """
    bounded = "bound" in vectors.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                lists = part.column(1).to_pylist()
                width = max(map(len, lists), default=0)
                values = np.zeros((len(lists), width), np.int64)
                for row, x in zip(values, lists, strict=True):
                    row[: len(x)] = x
                small = values.astype(np.int32) if not values.size or np.abs(values).max() < 1 << 31 else values
                bound = part.column(2).to_numpy() if bounded else np.zeros(0, np.int64)
                fields = (part.column(0).to_numpy().tobytes(), bound.tobytes(), small.tobytes())
                yield pa.record_batch([*(pa.array([f], pa.binary()) for f in fields), pa.array([width], pa.int32())], ["ids", "bounds", "data", "width"])

    return vectors.mapInArrow(apply, "ids binary, bounds binary, data binary, width int")


def _matrix(ids: np.ndarray, data: bytes, width: int, to: int) -> np.ndarray:
    kind = np.int32 if len(data) == 4 * len(ids) * width else np.int64
    m = np.frombuffer(data, kind).reshape(len(ids), width)
    return np.pad(m, ((0, 0), (0, to - width))) if to > width else m


def _local_scores(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The local lists: integer scores of each slice of dimensions, queries x candidates."""
    cuts = np.linspace(0, q.shape[1], N_LISTS + 1).astype(int)
    top = lambda m: int(np.abs(m).max()) if m.size else 0
    if top(q) * top(c) * max(q.shape[1], 1) < 1 << 53:
        return [(q[:, a:b].astype(float) @ c[:, a:b].astype(float).T).astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [q[:, a:b].astype(np.int64) @ c[:, a:b].astype(np.int64).T for a, b in zip(cuts, cuts[1:], strict=False)]


def _pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every query block with every candidate block; candidate blocks stay spread over all tasks.

    The join is a shuffle by hint: Spark judges the size of the query blocks before the explode,
    and would send all copies of them through the driver.
    """
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = candidates.select(F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int").alias("part"), *[F.col(c).alias(f"c_{c}") for c in ("ids", "data", "width")])
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "bounds", "data", "width")])
    return left.join(right.hint("merge"), "part").drop("part")


class _Best:
    """The best entries of each query so far in a task; handed on when there are too many queries."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.of:
            ids, scores = np.r_[self.of[query][0], ids], np.r_[self.of[query][1], scores]
        order = np.lexsort((ids, -scores))[: self.k]
        self.of[query] = (ids[order], scores[order])

    def drain(self) -> pa.RecordBatch:
        rows = [(q, i, s) for q, (ids, scores) in self.of.items() for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        self.of = {}
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def _collect(k: int, gather: bool):
    """Phase 1 (``gather``) or phases 2 and 3 for pairs of blocks."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                width = max(r["q_width"], r["c_width"])
                local = _local_scores(_matrix(q_ids, r["q_data"], r["q_width"], width), _matrix(c_ids, r["c_data"], r["c_width"], width))
                bounds = np.frombuffer(r["q_bounds"], np.int64)
                for i, query in enumerate(q_ids.tolist()):
                    if gather:
                        n = min(k + 1, len(c_ids))  # one more, as the query's own row may be among them
                        picked = np.unique(np.concatenate([np.argpartition(-s[i], n - 1)[:n] for s in local]))
                    else:
                        share = -(-int(bounds[i]) // N_LISTS) if bounds[i] != NO_BOUND else NO_BOUND
                        picked = np.flatnonzero(np.logical_or.reduce([s[i] >= share for s in local]))
                    total = sum(s[i][picked] for s in local)
                    keep = c_ids[picked] != query
                    if not gather:
                        keep &= total >= bounds[i]
                    if keep.any():
                        best.add(query, c_ids[picked][keep], total[keep])
                if len(best.of) > PENDING:
                    yield best.drain()
        yield best.drain()

    return apply


def top_k(table: DataFrame, k: int = 10, queries: Column | None = None, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates.

    ``queries`` says which rows of the table are queries (vec_id divisible by 100
    unless given); all rows but the query's own are its candidates.
    """
    vectors = integer_vectors(table, scale)
    chosen = vectors.where(queries if queries is not None else F.col("vec_id") % 100 == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    candidates = blocks(vectors, CANDIDATE_ROWS)
    entry = "query_id long, vec_id long, score long"
    gathered = _pairs(blocks(chosen, QUERY_ROWS), candidates).mapInArrow(_collect(k, True), entry)
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = gathered.withColumn("place", F.row_number().over(place)).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = chosen.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(NO_BOUND)).alias("bound"))
    found = _pairs(blocks(bounded, QUERY_ROWS), candidates).mapInArrow(_collect(k, False), entry)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
