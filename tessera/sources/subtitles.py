"""Subtitle texts (SRT, WebVTT, JSON) to timed segments, by SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import timestamp_ms

SEGMENT = "start_ms bigint, end_ms bigint, text string"
JSON_ITEM = "array<struct<`from`: double, `to`: double, content: string>>"


def _blocks(text: Column) -> Column:
    """Blocks between blank lines as arrays of their non-blank lines."""
    tidy = F.regexp_replace(F.trim(F.regexp_replace(text, "\r\n?", "\n")), r"^\s+|\s+$", "")
    return F.transform(F.split(tidy, r"\n\s*\n"), lambda b: F.filter(F.split(b, "\n"), lambda x: F.trim(x) != ""))


def _segment(lines: Column, stamp, keep, clean) -> Column:
    """The segment of a block: cue times on its first line with an arrow, text below it."""
    cue = F.array_position(F.transform(lines, lambda x: x.contains("-->")), True)
    at = F.try_element_at(lines, cue.cast("int"))
    body = F.filter(F.transform(F.slice(lines, (cue + 1).cast("int"), F.size(lines)), lambda x: F.trim(x)), keep)
    side = lambda i: timestamp_ms(stamp(F.try_element_at(F.split(at, "-->"), F.lit(i))))
    return F.when(cue > 0, F.struct(side(1).alias("start_ms"), side(2).alias("end_ms"), clean(F.array_join(body, " ")).alias("text")))


def _whole(segments: Column) -> Column:
    return F.filter(segments, lambda s: s.isNotNull() & s["start_ms"].isNotNull() & s["end_ms"].isNotNull() & (s["text"] != ""))


def parse_srt(text: Column) -> Column:
    """array<struct<start_ms, end_ms, text>> of an SRT text."""
    return _whole(F.transform(_blocks(text), lambda b: _segment(b, F.trim, lambda x: x != "", lambda x: x)))


def parse_vtt(text: Column) -> Column:
    """array<struct<start_ms, end_ms, text>> of a WebVTT text; cue settings, tags and header blocks go."""
    first = lambda x: F.element_at(F.split(F.trim(x), " "), 1)
    said = lambda x: (x != "") & ~x.startswith("Kind:") & ~x.startswith("Language:")
    bare = lambda x: F.regexp_replace(x, "<[^>]+>", "")
    cues = F.filter(_blocks(text), lambda b: ~F.coalesce(F.upper(F.trim(F.get(b, F.lit(0)))), F.lit("NOTE")).rlike("^(WEBVTT|NOTE|STYLE)"))
    return _whole(F.transform(cues, lambda b: _segment(b, first, said, bare)))


def parse_json_subtitle(text: Column) -> Column:
    """Segments of a JSON list of {from, to, content} with seconds."""
    ms = lambda x: F.bround(x * 1000).cast("bigint")
    items = F.filter(F.from_json(text, JSON_ITEM), lambda x: F.coalesce(x["content"], F.lit("")) != "")
    return F.transform(items, lambda x: F.struct(ms(F.coalesce(x["from"], F.lit(0.0))).alias("start_ms"), ms(F.coalesce(x["to"], F.lit(0.0))).alias("end_ms"), x["content"].alias("text")))


def split_web_page(text: Column) -> Column:
    """struct<title, content> of a fetched page: the first line (leading characters of "Title: " stripped) and the rest."""
    title = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "^[Title: ]+", ""))
    rest = F.when(F.instr(text, "\n") > 0, F.trim(F.regexp_replace(F.substr(text, F.instr(text, "\n") + 1), r"^\s+|\s+$", ""))).otherwise("")
    return F.struct(title.alias("title"), rest.alias("content"))


def transcriber_backend(log: Column) -> Column:
    """The compute backend that a transcriber's log names."""
    low = F.lower(log)
    name = F.when(low.rlike(r"\bcuda\b|cublas"), "cuda").when(low.contains("vulkan"), "vulkan").when(low.contains("metal"), "metal")
    return name.when(low.rlike(r"openblas|\bblas\s*=\s*1"), "blas").otherwise("cpu")
