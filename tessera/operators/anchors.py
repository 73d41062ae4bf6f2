"""Headings, sub-sections, provenance ledgers and as-of lookups."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normal_heading

SECTION_CHARS = 20_000
HEADING_CHARS = 60
BAND_CHARS = 4_096
#: Line patterns of headings without mark-up, with their level (None: from the dots).
PATTERNS: list[tuple[str, int | None]] = [
    (r"^第[一二三四五六七八九十百千零〇\d]+[章篇部卷]", 1),
    (r"^第[一二三四五六七八九十百千零〇\d]+[节回部分]", 2),
    (r"^条款\s*\d+", 2),
    (r"(?i)^Chapter\s+\d+", 1),
    (r"(?i)^Section\s+\d+", 2),
    (r"^\d+(\.\d+)+\s*\S", None),
]
PREFACE, CONTINUED = "卷首", "·续"


def line_rows(df: DataFrame, key: str = "entry_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, line_no, start, line and the columns ``carry``): lines with their offsets.

    Each text is read once where it lies: its lines give the running sum of their lengths,
    so nothing is sorted or shuffled.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.split("\n") if t is not None else [] for t in part.column(0).to_pylist()]
                each = pa.array(np.repeat(np.arange(len(texts)), list(map(len, texts))))
                starts = [s for ls in texts if ls for s in itertools.accumulate((len(x) + 1 for x in ls[:-1]), initial=0)]
                columns = [part.column(i).take(each) for i in range(1, part.num_columns)]
                yield pa.record_batch([columns[0], pa.array([i for ls in texts for i in range(len(ls))], pa.int64()), pa.array(starts, pa.int64()), pa.array([x for ls in texts for x in ls], pa.string()), *columns[1:]], names)

    names = [key, "line_no", "start", "line", *carry]
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *carry)}
    return df.select(text, key, *carry).mapInArrow(apply, ", ".join([f"{key} {kinds[key]}", "line_no long", "start long", "line string", *(f"{c} {kinds[c]}" for c in carry)]))


def heading_level(line: Column) -> tuple[Column, Column]:
    """(level, text) of a heading line; level is null for others."""
    bare = F.regexp_replace(line, r"[\r\n]+$", "")
    marked = r"^(#{1,6})\s+(.+?)\s*$"
    body = F.trim(bare)
    level = F.when(bare.rlike(marked), F.length(F.regexp_extract(bare, marked, 1)))
    short = (F.length(body) <= HEADING_CHARS) & (body != "") & ~body.rlike("[。！？；!?;.]$")
    for pattern, fixed in PATTERNS:
        dots = F.least(F.lit(6), 1 + F.regexp_count(F.regexp_extract(body, pattern, 0), F.lit(r"\.")))
        level = level.when(short & body.rlike(pattern), F.lit(fixed) if fixed else dots)
    return level, F.when(bare.rlike(marked), F.regexp_extract(bare, marked, 2)).otherwise(body)


def headings(df: DataFrame, key: str = "entry_id", text: str = "text", pages: str | None = None) -> DataFrame:
    """(key, heading_no, start, level, heading_text) in text order.

    A heading that recurs at least max(3, 60 % of the pages) times is a running
    header and goes. ``pages`` names a column with the number of pages.
    """
    lines = line_rows(df, key, text, (pages,) if pages else ()).withColumn("_pages", F.col(pages) if pages else F.lit(0))
    level, body = heading_level(F.col("line"))
    found = lines.select(key, "start", level.cast("bigint").alias("level"), body.alias("heading_text"), "_pages").where("level is not null")
    same = W.partitionBy(key, normal_heading(F.col("heading_text")))
    least = F.greatest(F.lit(3), F.floor(F.coalesce("_pages", F.lit(0)) * 0.6))
    kept = found.withColumn("_times", F.count("*").over(same)).where(F.col("_times") < least)
    number = F.row_number().over(W.partitionBy(key).orderBy("start"))
    return kept.select(key, number.cast("bigint").alias("heading_no"), "start", "level", "heading_text")


def merge_outline(parsed: DataFrame, outline: DataFrame, pages: DataFrame, key: str = "entry_id", near: int = 500) -> DataFrame:
    """Outline entries at their page's start, plus parsed headings without a like one nearby.

    ``outline``: key, level, heading_text, page and perhaps outline_no, the place in the outline;
    ``pages``: key, page, start. One heading per offset stays, the outline's first one before
    the parsed one. Headings meet in bands of ``near``
    characters, so one that recurs in an entry is compared with its neighbours alone.
    """
    place = F.col("outline_no") if "outline_no" in outline.columns else F.lit(0)
    fixed = outline.join(pages, [key, "page"]).select(key, "start", "level", "heading_text", place.cast("bigint").alias("_place"))
    same = normal_heading(F.col("heading_text"))
    band = F.floor(F.col("start") / near)
    other = fixed.select(F.col(key).alias("_key"), F.col("start").alias("_start"), same.alias("_like"), F.explode(F.array(band - 1, band, band + 1)).alias("_at")).distinct()
    found = parsed.select(key, "start", "level", "heading_text", same.alias("_same"), band.alias("_band"))
    close = (F.col(key) == F.col("_key")) & (F.col("_same") == F.col("_like")) & (F.col("_band") == F.col("_at")) & (F.abs(F.col("start") - F.col("_start")) < near)
    rest = found.join(other, close, "left_anti").drop("_same", "_band")
    both = fixed.withColumn("_from", F.lit(0)).unionByName(rest.withColumn("_from", F.lit(1)).withColumn("_place", F.lit(0).cast("bigint")))
    first = W.partitionBy(key, "start").orderBy("_from", "_place", "level", "heading_text")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_from", "_place")


def subsections(anchors: DataFrame, entries: DataFrame, key: str = "entry_id", step: int = SECTION_CHARS) -> DataFrame:
    """(key, start, level, title): an anchor every ``step`` characters inside longer gaps.

    ``entries``: key, total_chars. A gap after a heading gets an anchor while more than
    ``step`` characters lie ahead; a text without headings only where more than
    ``step`` characters follow the anchor.
    """
    totals = entries.select(key, F.col("total_chars").cast("bigint").alias("_total"))
    heads = anchors.select(key, F.col("start").cast("bigint").alias("start"), F.col("level").cast("bigint").alias("level"), "heading_text").withColumn("_preface", F.lit(False))
    fronts = totals.select(key, F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("level"), F.lit(PREFACE).alias("heading_text"), F.lit(True).alias("_preface"))
    inside = W.partitionBy(key).orderBy("start", F.desc("_preface"))
    gaps = heads.unionByName(fronts).join(totals, key).select(
        "*", F.coalesce(F.lead("start").over(inside), F.col("_total")).alias("_end"), F.count("*").over(W.partitionBy(key)).alias("_n")
    )
    room = F.col("_end") - F.col("start")
    steps = F.ceil(room / F.lit(step)) - 1
    alone = (F.col("_n") == 1) & F.col("_preface")
    number = F.greatest(F.lit(0), F.when(alone, steps - 1).otherwise(steps))
    made = gaps.withColumn("_k", number.cast("int")).where("_k > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("_i"))
    return made.select(key, (F.col("start") + F.col("_i") * step).alias("start"), "level", F.concat("heading_text", F.lit(CONTINUED), "_i").alias("title"))


def asof_backward(probes: DataFrame, breaks: DataFrame, keys: list[str], at: str, carry: list[str], start: str = "start") -> DataFrame:
    """``probes`` with the columns ``carry`` of the last break at or before ``at`` (null: none).

    One shuffle on the keys: breaks and probes are sorted together and the last
    break is carried on, so neither side is ever paired with the other.
    """
    left = probes.select(F.struct(*probes.columns).alias("_probe"), *keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(breaks.select(F.struct(start, *carry)).schema[0].dataType).alias("_break"))
    right = breaks.select(F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), *keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(start, *carry).alias("_break"))
    order = W.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = left.unionByName(right).withColumn("_break", F.last("_break", ignorenulls=True).over(order)).where("_kind = 1")
    return both.select("_probe.*", *[F.col(f"_break.{c}").alias(c) for c in carry])


def ledger(pages: DataFrame | None = None, chapters: DataFrame | None = None, segments: DataFrame | None = None, key: str = "entry_id") -> DataFrame:
    """(key, start, kind, v1, v2, title): breakpoints of pages, chapters and timed segments."""
    none = lambda t: F.lit(None).cast(t)
    parts = []
    if pages is not None:
        parts.append(pages.select(key, "start", F.lit("page").alias("kind"), F.col("page").cast("bigint").alias("v1"), none("bigint").alias("v2"), none("string").alias("title")))
    if chapters is not None:
        parts.append(chapters.select(key, "start", F.lit("chapter").alias("kind"), F.col("chapter").cast("bigint").alias("v1"), none("bigint").alias("v2"), "title"))
    if segments is not None:
        parts.append(segments.select(key, F.col("char_start").alias("start"), F.lit("time").alias("kind"), F.col("start_ms").alias("v1"), F.col("end_ms").alias("v2"), none("string").alias("title")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def segment_spans(segments: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """Segments with char_start and char_end in the text that joins them by line ends; blank ones go."""
    kept = segments.withColumn(text, F.trim(text)).where(F.col(text) != "")
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    return kept.withColumn("char_start", start.cast("bigint")).withColumn("char_end", F.col("char_start") + F.length(text))


def joined_text(segments: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """(key, full_text) of segments."""
    kept = segments.withColumn(text, F.trim(text)).where(F.col(text) != "")
    grouped = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("_all"))
    return grouped.select(key, F.array_join(F.transform("_all", lambda x: x[text]), "\n").alias("full_text"))


def _bands(start: Column, stop: Column, width: int) -> Column:
    """The numbers of the bands of ``width`` characters that [start, stop) touches; an empty span lies in that of its start."""
    last = F.greatest(start, stop - 1)
    return F.sequence(F.floor(start / width), F.floor(last / width))


def chunk_times(chunks: DataFrame, spans: DataFrame, key: str, width: int = BAND_CHARS) -> DataFrame:
    """(key, chunk_no, start_ms, end_ms): first start and last end among segments that a chunk overlaps.

    Both sides are cut into bands of ``width`` characters and meet band by band, so the work
    follows the length of a text, also of one entry that holds most segments, and its bands
    are many tasks' work. A pair may meet in several bands; the first and the last are the same.
    """
    parts = chunks.select(key, "chunk_no", "start", "stop", F.explode_outer(_bands(F.col("start"), F.col("stop"), width)).alias("_band"))
    s = spans.select(F.col(key).alias("_key"), "char_start", "char_end", "start_ms", "end_ms", F.explode(_bands(F.col("char_start"), F.col("char_end"), width)).alias("_at"))
    over = (F.col(key) == F.col("_key")) & (F.col("_band") == F.col("_at")) & (F.col("char_end") > F.col("start")) & (F.col("char_start") < F.col("stop"))
    return parts.join(s, over, "left").groupBy(key, "chunk_no").agg(F.min_by("start_ms", "char_start").alias("start_ms"), F.max_by("end_ms", "char_start").alias("end_ms"))


def source_location(kind: Column, v1: Column, v2: Column, title: Column, line: Column) -> Column:
    """The provenance struct of a ledger row, or the line for texts without a ledger."""
    form = lambda k, **more: F.struct(F.lit(k).alias("kind"), *[(more.get(f, F.lit(None)).cast(t)).alias(f) for f, t in (("n", "bigint"), ("start_ms", "bigint"), ("end_ms", "bigint"), ("title", "string"))])
    return (
        F.when(kind == "page", form("pdf", n=v1)).when(kind == "chapter", form("epub", n=v1, title=title))
        .when(kind == "time", form("time", start_ms=v1, end_ms=v2)).when(line.isNotNull(), form("line", n=line))
    )
