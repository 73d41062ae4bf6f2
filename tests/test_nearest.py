"""The pivot index gives the rows of the full scan and reads less where vectors lie in groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.embed import HashEmbedder
from tessera.operators import nearest
from tessera.operators import retrieve as r
from tessera.plans.library import Store

SCHEMA = "workspace string, entry_id string, chunk_no long, win_start long, embedding array<float>"
DIMS = 16


def indexed(vectors, most=nearest.CELLS):
    pivots = nearest.choose_pivots(vectors, most)
    done = nearest.assign(vectors, pivots).cache()
    return nearest.VectorIndex(done, nearest.bounds(done, pivots))


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(25, DIMS))
    x = middles[rng.integers(0, 25, 3_000)] + 0.15 * rng.normal(size=(3_000, DIMS))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:200] = x[0]  # repeated rows and ties
    x[200:230] *= 1.7  # not of unit length
    rows = [("ab"[i % 2], f"e{i % 900}", i % 3, i, [float(v) for v in x[i]]) for i in range(3_000)]
    rows += [("a", "odd", i, 0, v) for i, v in enumerate([[1.0] * 3 + [None] + [1.0] * (DIMS - 4), [0.0] * DIMS])]
    return spark.createDataFrame(rows, SCHEMA).cache(), [list(map(float, x[i])) for i in (0, 1_500, 2_999)] + [list(map(float, -x[5])), [0.0] * DIMS]


def same(found, wanted):
    order = ["route_rank"]
    return [tuple(x) for x in found.orderBy(*order).collect()] == [tuple(x) for x in wanted.orderBy(*order).collect()]


def test_rows_of_the_full_scan(grouped):
    vectors, queries = grouped
    index = indexed(vectors)
    assert index.vectors.where("cell is null").count() == 1
    for q in queries:
        assert same(nearest.vector_route(index, q, 20), r.vector_route(vectors, q, 20))
    allowed = vectors.where("entry_id in ('e7', 'e8', 'e700')").select("entry_id").distinct()
    assert same(nearest.vector_route(index, queries[0], 5, allowed), r.vector_route(vectors, queries[0], 5, allowed))
    assert same(nearest.vector_route(index, queries[1], 5_000), r.vector_route(vectors, queries[1], 5_000))
    read, total = nearest.share_read(index, queries[1], 20)
    assert total == 3_001 and read < total / 3


def test_rows_added_and_taken_away(spark, grouped):
    vectors, queries = grouped
    index = indexed(vectors.where("win_start < 2000"))
    late = vectors.where("win_start >= 2000").withColumns({"cell": F.lit(None).cast("int"), "_far": F.lit(None).cast("double"), "_size": F.lit(None).cast("double")})
    now = nearest.VectorIndex(index.vectors.where("entry_id <> 'e1'").unionByName(late), index.cells)
    assert same(nearest.vector_route(now, queries[2], 20), r.vector_route(vectors.where("entry_id <> 'e1' or win_start >= 2000"), queries[2], 20))


def test_empty_and_unfit(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nearest.vector_route(indexed(none), [1.0, 0.0], 5).count() == 0
    unfit = spark.createDataFrame([("a", "x", 0, 0, None), ("a", "y", 0, 0, []), ("a", "z", 0, 0, [float("nan"), 1.0]), ("a", "ok", 0, 0, [1.0, 0.0])], SCHEMA)
    index = indexed(unfit)
    assert [x.entry_id for x in index.vectors.where("cell is not null").collect()] == ["ok"]


def test_a_store_keeps_its_cells(spark, tmp_path):
    store, embedder = Store(spark, f"file://{tmp_path}/lib"), HashEmbedder(8)
    rows = [("a", f"text number {n} about pears") for n in range(40)] + [("b", "one of the other workspace")]
    store.ingest(spark.createDataFrame(rows, "workspace string, text string"), "2024-01-01", embedder)
    query = embedder.embed(["text number 7 about pears"])[0].tolist()
    wanted = [tuple(x) for x in r.vector_route(store.table("vectors"), query, 5).orderBy("route_rank").collect()]
    store.vacuum("a")
    lib = store.library()
    assert lib.cells.count() >= 2 and lib.vectors.where("cell is null").count() == 1
    assert [tuple(x) for x in nearest.vector_route(nearest.VectorIndex(lib.vectors, lib.cells), query, 5).orderBy("route_rank").collect()] == wanted
    hits, _ = store.search("text number 7 about pears", embedder, mode="vector", limit=3)
    assert hits.count() == 3
