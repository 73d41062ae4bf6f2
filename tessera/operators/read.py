"""Reading entries: sections, prefaces, chunks, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import capped
from .anchors import SECTION_CHARS, subsections

READ_CHARS = 30_000


def sections(anchors: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, section_no, start, stop): from each anchor to the next or the end; number 0 is the preface."""
    totals = entries.select("entry_id", F.col("total_chars").cast("bigint").alias("_total"))
    front = totals.select("entry_id", F.lit(0).cast("bigint").alias("section_no"), F.lit(0).cast("bigint").alias("start"))
    rows = anchors.select("entry_id", F.col("heading_no").cast("bigint").alias("section_no"), F.col("start").cast("bigint").alias("start")).unionByName(front)
    following = F.lead("start").over(W.partitionBy("entry_id").orderBy("start", "section_no"))
    return rows.withColumn("_next", following).join(totals, "entry_id").select("entry_id", "section_no", "start", F.coalesce("_next", "_total").alias("stop"))


def anchored(anchors: DataFrame, entries: DataFrame, step: int = SECTION_CHARS) -> DataFrame:
    """(entry_id, section_no, start, stop, level, title): each anchor up to the next one or the end.

    Headings have their own numbers, sub-sections -1, -2 and so on in text order, what is
    before the first anchor has 0 and neither level nor title.
    """
    totals = entries.select("entry_id", F.col("total_chars").cast("bigint").alias("_total"))
    none = lambda t: F.lit(None).cast(t)
    fronts = totals.select("entry_id", F.lit(0).cast("bigint").alias("section_no"), F.lit(0).cast("bigint").alias("start"), none("bigint").alias("level"), none("string").alias("title"))
    heads = anchors.select("entry_id", F.col("heading_no").cast("bigint").alias("section_no"), F.col("start").cast("bigint").alias("start"), F.col("level").cast("bigint").alias("level"), F.col("heading_text").alias("title"))
    number = -F.row_number().over(W.partitionBy("entry_id").orderBy("start")).cast("bigint")
    subs = subsections(anchors, entries, step=step).select("entry_id", number.alias("section_no"), "start", "level", "title")
    rank = F.when(F.col("section_no") == 0, 0).when(F.col("section_no") > 0, 1).otherwise(2)
    following = F.lead("start").over(W.partitionBy("entry_id").orderBy("start", rank, "section_no"))
    rows = fronts.unionByName(heads).unionByName(subs).withColumn("_next", following)
    return rows.join(totals, "entry_id").select("entry_id", "section_no", "start", F.coalesce("_next", "_total").alias("stop"), "level", "title")


def subsection_spans(anchors: DataFrame, entries: DataFrame, step: int = SECTION_CHARS) -> DataFrame:
    """(entry_id, section_no, start, stop) of the sub-sections, numbered from 1: up to the next one, the next heading or the end."""
    return anchored(anchors, entries, step).where("section_no < 0").select("entry_id", (-F.col("section_no")).alias("section_no"), "start", "stop")


def window(start: Column, stop: Column, at: Column, most: int) -> tuple[Column, Column]:
    """A window of ``most`` characters around ``at`` inside [start, stop); the whole span if it is shorter or ``at`` is null."""
    if most <= 0:
        return start, stop
    first = F.greatest(start, F.least(at - most // 2, stop - most))
    apart = at.isNotNull() & (stop - start > most)
    return F.when(apart, first).otherwise(start), F.when(apart, F.least(stop, first + most)).otherwise(stop)


def read_spans(spans: DataFrame, entries: DataFrame, most: int = READ_CHARS) -> DataFrame:
    """Content of spans (entry_id, start, stop, at and others) with read_chars, remaining_chars, truncated."""
    first, last = window(F.col("start"), F.col("stop"), F.col("at"), most)
    rows = spans.withColumn("_a", first).withColumn("_b", last).join(entries.select("entry_id", "text"), "entry_id")
    body = capped(F.substr("text", F.col("_a").cast("int") + 1, (F.col("_b") - F.col("_a")).cast("int")), most)
    out = rows.withColumn("content", body).withColumn("read_chars", F.length("content").cast("bigint"))
    left = F.col("stop") - F.col("start") - F.col("read_chars")
    return out.withColumn("remaining_chars", F.greatest(F.lit(0).cast("bigint"), left)).withColumn("truncated", left > 0).drop("_a", "_b", "text")


def parse_ref(ref: Column) -> Column:
    """A section reference (``<entry>#s3@120``, ``#u2``, ``#front@5``) as a struct; null if malformed."""
    pattern = r"^(.+)#(?:([su])(\d+)|(front))(?:@(\d+))?$"
    get = lambda i: F.nullif(F.regexp_extract(ref, pattern, i), F.lit(""))
    kind = F.coalesce(get(2), F.when(get(4).isNotNull(), "front"))
    return F.when(ref.rlike(pattern), F.struct(get(1).alias("entry_id"), kind.alias("kind"), get(3).cast("bigint").alias("number"), get(5).cast("bigint").alias("at")))


def section_ref(entry: Column, number: Column, at: Column) -> Column:
    """The reference of a hit: its section (0 or null: the preface, below 0: a sub-section) and its place."""
    known = F.coalesce(number, F.lit(0))
    head = F.when(known > 0, F.concat(entry, F.lit("#s"), number)).when(known < 0, F.concat(entry, F.lit("#u"), -number)).otherwise(F.concat(entry, F.lit("#front")))
    return F.when(at.isNotNull(), F.concat(head, F.lit("@"), at)).otherwise(head)


def library_stats(entries: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per workspace: entries, chunks, characters, vectors, last update."""
    per = lambda df, name: df.groupBy("workspace").agg(F.count("*").alias(name))
    base = entries.groupBy("workspace").agg(F.count("*").alias("entries"), F.sum("total_chars").alias("total_chars"), F.max("updated_at").alias("updated_at"))
    joined = base.join(per(chunks, "chunks"), "workspace", "left").join(per(vectors, "vectors"), "workspace", "left")
    return joined.select("workspace", "entries", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("vectors", F.lit(0)).alias("vectors"), "total_chars", "updated_at")


def entry_list(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entries with their number of vectors, the latest update first."""
    counts = vectors.groupBy("entry_id").agg(F.count("*").alias("vectors"))
    rows = entries.join(counts, "entry_id", "left").select("workspace", "entry_id", "title", "total_chars", "updated_at", F.coalesce("vectors", F.lit(0)).alias("vectors"))
    return rows.orderBy(F.desc("updated_at"), "entry_id")
