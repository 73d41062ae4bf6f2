"""Integrity checks of a library; each returns the rows at fault."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SAID = re.compile(r"\S", re.ASCII)


def chunk_counts(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entry_id, stored, actual) where the stored chunk_count is wrong."""
    actual = chunks.groupBy("entry_id").agg(F.count("*").alias("actual"))
    rows = entries.select("entry_id", F.col("chunk_count").cast("bigint").alias("stored")).join(actual, "entry_id", "left")
    return rows.withColumn("actual", F.coalesce("actual", F.lit(0))).where("not (stored <=> actual)")


def _beside(entries: DataFrame, spans: DataFrame, test: Callable[[str | None, list[dict]], list[dict]], schema: str) -> DataFrame:
    """What ``test`` finds of an entry's text and the list of all its ``spans``, which have entry_id.

    A text is shuffled and read once, whatever number of spans it has.
    """
    fields = [c for c in spans.columns if c != "entry_id"]
    gathered = spans.groupBy("entry_id").agg(F.collect_list(F.struct(*fields)).alias("_spans"))
    rows = entries.select("entry_id", F.col("text").alias("_full")).join(gathered, "entry_id")
    kind = rows.schema["entry_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                found = test(row.column(1)[0].as_py(), row.column(2)[0].as_py())
                if found:
                    yield pa.Table.from_pylist([{"entry_id": row.column(0)[0].as_py(), **f} for f in found], out).combine_chunks().to_batches()[0]

    out = to_arrow_schema(entries.sparkSession.createDataFrame([], f"entry_id {kind}, {schema}").schema)
    return rows.mapInArrow(apply, f"entry_id {kind}, {schema}")


def text_mismatch(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entry_id, chunk_no, reason): chunks outside their text or unlike the substring they name.

    A chunk without an offset is outside; one without text has no fault.
    """

    def test(full: str | None, spans: list[dict]) -> list[dict]:
        found = []
        for x in spans:
            start, body = x["start"], x["chunk_text"]
            known = full is not None and body is not None
            if start is None or start < 0 or (known and start + len(body) > len(full)):
                found.append({"chunk_no": x["chunk_no"], "reason": "offset_out_of_range"})
            elif known and full[start : start + len(body)] != body:
                found.append({"chunk_no": x["chunk_no"], "reason": "chunk_text_mismatch"})
        return found

    kind = chunks.schema["chunk_no"].dataType.simpleString()
    return _beside(entries, chunks.select("entry_id", "chunk_no", F.col("start").cast("bigint"), "chunk_text"), test, f"chunk_no {kind}, reason string")


def coverage(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entry_id, gap_start, gap_end, reason): stretches with text that no chunk covers.

    Only the chunks' places are gathered, not their texts.
    """

    def test(full: str | None, spans: list[dict]) -> list[dict]:
        if full is None:
            return []
        found, end = [], 0
        for x in sorted((x for x in spans if x["start"] is not None and x["size"] is not None), key=lambda x: x["start"]):
            if x["start"] > end:
                found.append((end, x["start"], "coverage_gap"))
            end = max(end, x["start"] + x["size"])
        if spans and end < len(full):
            found.append((end, len(full), "coverage_tail"))
        return [{"gap_start": a, "gap_end": b, "reason": why} for a, b, why in found if SAID.search(full, a, b)]

    places = chunks.select("entry_id", F.col("start").cast("bigint").alias("start"), F.length("chunk_text").cast("bigint").alias("size"))
    return _beside(entries, places, test, "gap_start bigint, gap_end bigint, reason string")


def headings_outside(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """(entry_id, start) of headings without an offset inside their text."""
    rows = headings.join(entries.select("entry_id", "total_chars"), "entry_id", "left")
    return rows.where("start is null or start < 0 or start > coalesce(total_chars, 0)").select("entry_id", "start")


def ledger_invalid(ledger: DataFrame) -> DataFrame:
    return ledger.where("start is null or start < 0").select("entry_id", "start", "kind")


def index_mismatch(chunks: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("entry_id", "chunk_no")) -> DataFrame:
    """Keys on one side only: rows the index lacks, and rows it has too many."""
    a, b = chunks.select(*keys).distinct(), index.select(*keys).distinct()
    return a.join(b, [*keys], "left_anti").withColumn("reason", F.lit("not_indexed")).unionByName(b.join(a, [*keys], "left_anti").withColumn("reason", F.lit("stale_index")))


def against_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(entry_id, reason): entries without a text file, and files without an entry or left half-written.

    ``files``: entry_id, is_temporary.
    """
    f = files.groupBy("entry_id").agg(F.max("is_temporary").alias("_tmp"), F.min("is_temporary").alias("_all_tmp"))
    both = entries.select("entry_id", F.lit(True).alias("_known")).join(f, "entry_id", "full_outer")
    reason = F.when(F.col("_known").isNull(), "orphan_entry_dir").when(F.col("_tmp").isNull() | F.col("_all_tmp"), "full_text_missing").when(F.col("_tmp"), "tmp_residual")
    return both.select("entry_id", reason.alias("reason")).where("reason is not null")


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, problems): how many rows each check found."""
    counted: list[DataFrame] = [df.agg(F.count("*").alias("problems")).select(F.lit(name).alias("check"), "problems") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)


def ok(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)) == 0
