"""Joins by bands of a text, and checks beside a text, against plain loops."""

import random

from pyspark.sql import functions as F

from tessera.operators import anchors as a
from tessera.operators import verify as v


def test_chunk_times_agree_with_all_pairs(spark):
    rng = random.Random(5)
    chunks, spans = [], []
    for key in ("a", "b"):
        chunks += [(key, n, s, s + size) for n in range(60) for s, size in [(rng.randrange(30_000), rng.choice([0, 1, 300, 4_096, 9_000]))]]
        starts = sorted(rng.sample(range(40_000), 200))
        spans += [(key, s, s + rng.choice([0, 1, 40, 12_000]), s * 10, s * 10 + 5) for s in starts]
    chunks.append(("alone", 0, 0, 10))
    got = a.chunk_times(spark.createDataFrame(chunks, "k string, chunk_no long, start long, stop long"), spark.createDataFrame(spans, "k string, char_start long, char_end long, start_ms long, end_ms long"), "k")
    want = set()
    for k, n, start, stop in chunks:
        over = [s for s in spans if s[0] == k and s[2] > start and s[1] < stop]
        want.add((k, n, over[0][3] if over else None, over[-1][4] if over else None))
    assert {tuple(r) for r in got.collect()} == want


def test_a_heading_that_recurs_meets_its_neighbours_only(spark):
    """30,000 like headings on each side of one entry: all pairs would be 900 million."""
    n = 30_000
    parsed = spark.range(n).select(F.lit("e").alias("entry_id"), (F.col("id") * 700).alias("start"), F.lit(2).cast("bigint").alias("level"), F.lit("Same  Head").alias("heading_text"))
    pages = spark.range(n).select(F.lit("e").alias("entry_id"), F.col("id").alias("page"), (F.col("id") * 700 + F.when(F.col("id") % 2 == 0, 499).otherwise(350)).alias("start"))
    outline = spark.range(0, n, 2).select(F.lit("e").alias("entry_id"), F.lit(1).cast("bigint").alias("level"), F.lit("same head").alias("heading_text"), F.col("id").alias("page"))
    got = a.merge_outline(parsed, outline, pages)
    left = {r.start // 700 for r in got.where("level = 2").collect()}
    starts = {i * 700 + 499 for i in range(0, n, 2)}
    assert got.where("level = 1").count() == n // 2
    assert left == {i for i in range(n) if not any(abs(i * 700 - s) < 500 for s in (i * 700 + 499, (i - 1) * 700 + 499, (i + 1) * 700 + 499) if s in starts)}


def test_checks_beside_the_text(spark):
    text = "First part.  \n　Zweiter Teil, größer. " * 40
    entries = spark.createDataFrame([("e", text), ("blank", "ab   "), ("none", None), ("bare", "text"), ("empty", "")], "entry_id string, text string")
    rows = [("e", 0, 0, text[:100]), ("e", 1, 90, text[90:300]), ("e", 2, 310, text[310:400]), ("e", 3, 500, "not there"), ("e", 4, len(text) - 3, "beyond the end"), ("e", 5, -1, "x"), ("e", 6, None, "x"), ("e", 7, 5, None)]
    rows += [("blank", 0, 0, "ab"), ("none", 0, 0, "x"), ("none", 1, -5, "x"), ("empty", 0, 0, ""), ("unknown", 0, 0, "x")]
    chunks = spark.createDataFrame(rows, "entry_id string, chunk_no int, start int, chunk_text string")
    found = {(r.entry_id, r.chunk_no): r.reason for r in v.text_mismatch(entries, chunks).collect()}
    outside = "offset_out_of_range"
    assert found == {("e", 3): "chunk_text_mismatch", ("e", 4): outside, ("e", 5): outside, ("e", 6): outside, ("none", 1): outside}
    gaps = v.coverage(entries, chunks.where("chunk_no < 4"))
    assert {(r.entry_id, r.gap_start, r.gap_end, r.reason) for r in gaps.collect()} == {("e", 300, 310, "coverage_gap"), ("e", 400, 500, "coverage_gap"), ("e", 509, len(text), "coverage_tail")}
    assert v.text_mismatch(entries.limit(0), chunks).count() == 0 == v.coverage(entries, chunks.limit(0)).count()
