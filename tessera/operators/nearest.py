"""Exact nearest vectors from cells around pivots: cells that can't hold a hit are not read.

Each vector lies in the cell of its nearest pivot. A cell knows the least and the greatest
distance of its vectors to the pivot and the greatest length of a vector. A pivot has one cell
number in all workspaces; ``later_pivots`` gives new ones numbers of their own. By the triangle
inequality these bound the inner product of a query with any vector of the cell, so once the
best cells have given enough hits, only cells whose bound reaches the last of these hits
are read, as partition filters on ``cell``. The rows are those of ``retrieve.vector_route``.

Vectors whose cell is null are in no cell yet and are always read: new rows are appended
without cells and get theirs at the next ``assign``. Removed rows leave the bounds right.

Defined results for odd input: a null vector, or one with a null or non-finite component, or of
another length than the pivots, stays without a cell; without any vector there are no cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import retrieve as r

#: At most so many cells, so pivots are few whatever the number of vectors: 1,024 vectors go to the driver and to tasks.
CELLS = 1_024
#: The cells read first hold at least so many rows for each hit that is wanted.
SEED_ROWS = 4
BLOCK = 4_096
SLACK = 1e-6
DIGITS = 4
SCHEMA = "cell int, pivot array<double>, near double, far double, size double, rows long, workspace string"


@dataclass
class VectorIndex:
    """Vectors with their ``cell`` and the bounds of the cells, by workspace."""

    vectors: DataFrame
    cells: DataFrame


def sound(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def choose_pivots(vectors: DataFrame, most: int = CELLS) -> np.ndarray:
    """Pivots of a table: about the root of its number of vectors, ``most`` at most, the same at each run.

    They are the vectors with the smallest hashes, of the length that most of these have.
    """
    good = vectors.where(sound(F.col("embedding")))
    wanted = min(most, int(np.ceil(np.sqrt(good.count()))))
    rows = [x.embedding for x in good.select("embedding", F.xxhash64("embedding").alias("_h")).distinct().orderBy("_h").limit(wanted).collect()]  # at most ``most``
    sizes = [len(x) for x in rows]
    usual = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    return np.array([x for x in rows if len(x) == usual], dtype=np.float64) if rows else np.zeros((0, 0))


def later_pivots(vectors: DataFrame, cells: DataFrame, most: int = CELLS) -> tuple[np.ndarray, int]:
    """(pivots, number of the first one's cell) for ``vectors``: those of ``cells``, or new ones where these are under half of what is wanted.

    Each new set is twice as large, so there are at most eleven sets, each of ``most`` numbers.
    """
    known = {x.cell: x.pivot for x in cells.select("cell", "pivot").distinct().collect()}  # at most eleven sets
    last = max(known, default=-1) // most
    now = [known[c] for c in sorted(known) if c // most == last]
    numbers = [c for c in sorted(known) if c // most == last]
    whole = bool(now) and numbers == list(range(last * most, last * most + len(now)))
    wanted = min(most, int(np.ceil(np.sqrt(vectors.where(sound(F.col("embedding"))).count()))))
    if whole and 2 * len(now) >= wanted:
        return np.array(now, dtype=np.float64), last * most
    return choose_pivots(vectors, most), (last + 1) * most


def assign(vectors: DataFrame, pivots: np.ndarray, first: int = 0) -> DataFrame:
    """``vectors`` with ``cell``, the distance ``_far`` to its pivot and the length ``_size``; nothing is shuffled."""
    kept = vectors.drop("cell")
    rows = kept.withColumn("_use", F.when(sound(F.col("embedding")) & (F.size("embedding") == pivots.shape[1]), F.transform("embedding", lambda x: x.cast("double"))))
    plain = len(kept.columns)
    schema = T.StructType([*kept.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("_far", T.DoubleType()), T.StructField("_size", T.DoubleType())])
    out = to_arrow_schema(schema)
    lengths = (pivots * pivots).sum(1)

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = batch.column(plain)
        which = np.flatnonzero(use.is_valid().to_numpy(zero_copy_only=False))
        cell, far, size = np.zeros(len(use), np.int32), np.zeros(len(use)), np.zeros(len(use))
        none = np.ones(len(use), bool)
        if len(which) and len(pivots):
            x = use.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(which), -1)
            best = (lengths - 2 * (x @ pivots.T)).argmin(1)
            cell[which], none[which] = best + first, False
            far[which], size[which] = np.linalg.norm(x - pivots[best], axis=1), np.linalg.norm(x, axis=1)
        made = [pa.array(v, kind, mask=none) for v, kind in ((cell, pa.int32()), (far, pa.float64()), (size, pa.float64()))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns[:plain], *made], out, strict=True)], schema=out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield block(batch.slice(at, BLOCK))

    return rows.mapInArrow(apply, schema)


def bounds(assigned: DataFrame, pivots: np.ndarray, first: int = 0) -> DataFrame:
    """The table of cells (``SCHEMA``) of vectors that ``assign`` gave their cells."""
    session = assigned.sparkSession
    named = session.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pivots, first)], "cell int, pivot array<double>")
    ranges = assigned.where("cell is not null").groupBy("workspace", "cell").agg(F.min("_far").alias("near"), F.max("_far").alias("far"), F.max("_size").alias("size"), F.count("*").alias("rows"))
    return ranges.join(F.broadcast(named), "cell").select("cell", "pivot", "near", "far", "size", "rows", "workspace")  # at most CELLS pivots


def upper_bounds(cells: list, query: np.ndarray) -> np.ndarray:
    """The greatest score that a vector of each cell can have, as scores are rounded."""
    if not cells:
        return np.zeros(0)
    near, far, size = (np.array([c[k] for c in cells]) for k in ("near", "far", "size"))
    pivots = np.array([c["pivot"] for c in cells])
    apart = np.linalg.norm(pivots - query, axis=1)
    least = np.maximum(0, np.maximum(apart - far, near - apart) - SLACK)
    length = np.linalg.norm(query)
    inside = pivots @ query + length * (far + SLACK)
    product = np.minimum.reduce([(size**2 + length**2 - least**2) / 2, size * length, inside])
    return np.round(np.maximum(0, product) + SLACK + 10.0**-DIGITS, DIGITS)


def vector_route(index: VectorIndex, unit_query: list[float], limit: int = 20, allowed: DataFrame | None = None, most_allowed: int | None = None) -> DataFrame:
    """The rows of ``retrieve.vector_route`` over ``index.vectors``, read from the cells that can hold them.

    The cells with the highest bounds are read first, more of them until they give
    ``limit`` hits; their last score is what a cell's bound must reach. What is read again
    is these few cells.
    """
    query = np.asarray(unit_query, dtype=np.float64)
    cells = _cells(index, len(query))
    ranked = sorted(zip(upper_bounds(cells, query), cells, strict=True), key=lambda x: (-x[0], x[1]["cell"]))
    wanted, floor = limit * SEED_ROWS, None
    while floor is None:
        taken, rows = 0, 0
        while taken < len(ranked) and rows < wanted:
            rows += ranked[taken][1]["rows"]
            taken += 1
        if taken == len(ranked):
            return r.vector_route(index.vectors, unit_query, limit, allowed, most_allowed)
        seeds = r.vector_route(_of(index.vectors, [c for _, c in ranked[:taken]], False), unit_query, limit, allowed, most_allowed)
        found = seeds.agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
        floor = found.low if found.n == limit else None
        wanted *= 4
    return r.vector_route(_of(index.vectors, [c for bound, c in ranked if bound >= floor]), unit_query, limit, allowed, most_allowed)


def _cells(index: VectorIndex, dims: int) -> list[dict]:
    """The bounds of each cell over all workspaces; as many rows as there are pivots."""
    one = index.cells.where(F.size("pivot") == dims).groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("near").alias("near"), F.max("far").alias("far"), F.max("size").alias("size"), F.sum("rows").alias("rows"))
    return [c.asDict() for c in one.collect()]


def _of(vectors: DataFrame, cells: list[dict], loose: bool = True) -> DataFrame:
    """The vectors of some cells and (``loose``) those without a cell."""
    test = F.col("cell").isin([c["cell"] for c in cells])
    return vectors.where(test | F.col("cell").isNull() if loose else test)


def share_read(index: VectorIndex, unit_query: list[float], limit: int = 20) -> tuple[int, int]:
    """(vectors in the cells that can hold a hit, vectors in all cells)."""
    low = vector_route(index, unit_query, limit).agg(F.min("score")).first()[0]
    cells = _cells(index, len(unit_query))
    above = upper_bounds(cells, np.asarray(unit_query, dtype=np.float64)) >= (0 if low is None else low)
    return sum(c["rows"] for c, yes in zip(cells, above, strict=True) if yes), sum(c["rows"] for c in cells)
