"""A search as one lazy plan: parse, filter, three routes, fusion, sections, provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import anchors as a
from ..operators import nearest, read
from ..operators import query as q
from ..operators import retrieve as r

MODES = ("fused", "fts", "vector")


@dataclass
class Library:
    """The tables a search reads."""

    entries: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    headings: DataFrame
    ledger: DataFrame | None = None
    index: r.KeywordIndex | None = None
    cells: DataFrame | None = None


@dataclass
class Search:
    """The parts of a planned search; all DataFrames are lazy."""

    hits: DataFrame
    candidates: DataFrame
    keyword: DataFrame
    allowed: DataFrame | None
    mode: str
    vector_available: bool
    error: str | None = None
    limit: int = 20
    terms: tuple[str, ...] = ()
    like_terms: tuple[str, ...] = ()


def plan(library: Library, text: str, unit_query: list[float] | None = None, limit: int = 20, mode: str = "fused", workspaces: list[str] | None = None, embed: bool = True, vector_cap: int | None = None) -> Search:
    """Plan a search over all or the named workspaces.

    Column filters alone make a keyword search over them; range filters alone, and
    a query without anything to look for, are errors. Without a query vector a fused
    search uses the other routes, a vector search is an error. ``vector_cap`` keeps
    the optional cap on filtered entries: beyond it fused drops the vector route.
    """
    if mode not in MODES:
        raise q.QueryError("bad_mode", mode)
    limit = r.clamp(limit)
    if workspaces is not None:
        here = lambda df: df.where(F.col("workspace").isin(workspaces))
        index = library.index and r.KeywordIndex(here(library.index.postings), here(library.index.statistics))
        library = Library(*map(here, (library.entries, library.chunks, library.vectors, library.headings)), index=index, cells=library.cells and here(library.cells))
    topic = q.parse(text, as_filters=True)
    allowed = r.entry_filter(library.entries, topic)
    if not topic.items and not topic.like_terms:
        if not topic.filters:
            raise q.QueryError("range_only" if topic.ranges else "empty_query")
        topic, mode = q.parse(text), "fts"
    wide = r.route_limit(limit)
    error = None
    keyword = r.keyword_route(library.chunks, topic, wide, allowed, library.index)
    heading = r.heading_route(library.headings, topic, wide, allowed)
    available = bool(unit_query) and embed
    vector = None
    if mode == "vector" and not available:
        raise q.QueryError("vector_unavailable")
    if mode != "fts" and available:
        try:
            if library.cells is not None:
                vector = nearest.vector_route(nearest.VectorIndex(library.vectors, library.cells), unit_query, wide, allowed, vector_cap)
            else:
                vector = r.vector_route(library.vectors, unit_query, wide, allowed, vector_cap)
        except q.QueryError as e:
            if mode == "vector":
                raise
            error, available = e.code, False
    if vector is None:
        vector = r.vector_route(library.vectors.limit(0), [0.0], wide)
    none = keyword.limit(0), heading.limit(0)
    fused = r.fuse(*((none[0], vector, none[1]) if mode == "vector" else (keyword, vector, heading)))
    if mode == "fts":  # keyword hits, then headings, each in its own order
        first = F.when(F.col("unit").startswith("h"), 1).otherwise(0)
        fused = fused.withColumn("total", F.col("total") - first)
    hits = r.top_fused(fused, limit)
    return Search(hits, fused, keyword, allowed, mode, available, error, limit, (*topic.phrases, *topic.like_terms), tuple(topic.like_terms))


def shaped(library: Library, search: Search) -> DataFrame:
    """Hits by section: rank, reference, heading, section length, line and scores."""
    places = library.chunks.select("workspace", "entry_id", F.col("chunk_no").cast("string").alias("unit"), F.col("start"))
    hits = search.hits.join(places, ["workspace", "entry_id", "unit"], "left").withColumn("at", F.coalesce("hit_offset", "win_start", "start", "heading_offset"))
    near = library.headings.join(F.broadcast(hits.select("entry_id").distinct()), "entry_id", "left_semi")
    marked = a.asof_backward(hits.drop("start"), near.select("entry_id", "start", F.col("heading_no").alias("section_no")), ["entry_id"], "at", ["section_no"])
    merged = r.by_section(marked)
    rep = hits.select("workspace", "entry_id", "unit", "at")
    wanted = F.broadcast(hits.select("entry_id").distinct())  # at most as many short rows as hits, 100
    found = library.entries.join(wanted, "entry_id", "left_semi")
    heads = library.headings.join(wanted, "entry_id", "left_semi")
    spans = read.sections(heads.dropDuplicates(["entry_id", "heading_no"]), found.select("entry_id", "total_chars").distinct()).select("entry_id", F.col("section_no").alias("_no"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    rows = merged.join(rep, ["workspace", "entry_id", "unit"]).withColumn("_no", F.coalesce("section_no", F.lit(0)))
    whole = found.select("workspace", "entry_id", "title", "text")
    out = rows.join(spans, ["entry_id", "_no"], "left").join(whole, ["workspace", "entry_id"])
    line = F.regexp_count(F.substr("text", F.lit(1), F.col("at").cast("int")), F.lit("\n")) + 1
    return out.select(
        "section_rank", "workspace", "entry_id", "title", "unit", read.section_ref(F.col("entry_id"), F.col("section_no"), F.col("at")).alias("section_ref"),
        (F.col("_b") - F.col("_a")).alias("section_chars"), line.cast("bigint").alias("line"), "score", "score_source", "same_section_hits",
    )


def detailed(library: Library, search: Search, scheme: str = "tessera", step: int = read.SECTION_CHARS) -> DataFrame:
    """Hits by section as a caller shows them, over headings and sub-sections.

    To what ``shaped`` has come the anchor's text and level, a snippet, the place in the
    source (page, chapter or time by the ledger, else the line), times with their precision,
    and a locator. A text that lies in several workspaces is one hit in each. What is
    joined is bounded by the hits, of which there are at most 100.
    """
    keys = ["workspace", "entry_id"]
    places = library.chunks.select(*keys, F.col("chunk_no").cast("string").alias("unit"), "start", "chunk_text")
    hits = search.hits.join(places, [*keys, "unit"], "left").withColumn("at", F.coalesce("hit_offset", "win_start", "start", "heading_offset"))
    wanted = F.broadcast(search.hits.select(*keys).distinct())
    found = library.entries.join(wanted, keys, "left_semi")
    heads = library.headings.join(wanted, keys, "left_semi").dropDuplicates(["entry_id", "heading_no"])
    spans = read.anchored(heads, found.select("entry_id", "total_chars").distinct(), step)
    marked = a.asof_backward(hits.drop("start"), spans.where("section_no <> 0").select("entry_id", "start", "section_no"), ["entry_id"], "at", ["section_no"])
    merged = r.by_section(marked)
    precision = F.when(F.col("hit_offset").isNotNull(), "segment").when(F.col("win_start").isNotNull(), "window").otherwise("chunk")
    rows = merged.join(hits.select(*keys, "unit", "at", "chunk_text", precision.alias("_precision")), [*keys, "unit"])
    none = lambda kind: F.lit(None).cast(kind)
    if library.ledger is None:
        rows = rows.select("*", none("string").alias("kind"), none("bigint").alias("v1"), none("bigint").alias("v2"), none("string").alias("_chapter"), none("boolean").alias("_has_ledger"))
    else:
        known = library.ledger.join(wanted, keys, "left_semi")
        rows = a.asof_backward(rows, known.withColumnRenamed("title", "_chapter"), keys, "at", ["kind", "v1", "v2", "_chapter"])
        rows = rows.join(known.select(*keys, F.lit(True).alias("_has_ledger")).distinct(), keys, "left")
    sections = spans.select("entry_id", F.col("section_no").alias("_no"), (F.col("stop") - F.col("start")).alias("section_chars"), F.col("title").alias("heading_text"), F.col("level").alias("heading_level"))
    whole = found.select(*keys, F.col("title").alias("_title"), "source_ref", "text")
    out = rows.withColumn("_no", F.coalesce("section_no", F.lit(0).cast("bigint"))).join(sections, ["entry_id", "_no"], "left").join(whole, keys)
    line = F.when(F.col("_has_ledger").isNull(), t.line_number(F.col("text"), F.col("at").cast("int"))).cast("bigint")
    out = out.withColumn("source_location", a.source_location(F.col("kind"), F.col("v1"), F.col("v2"), F.col("_chapter"), line))
    timed = F.col("source_location.kind") == "time"
    shown = F.coalesce("chunk_text", "heading_text")
    return out.select(
        "section_rank", *keys, F.col("_title").alias("title"), "unit", read.section_ref(F.col("entry_id"), F.col("section_no"), F.col("at")).alias("section_ref"), "heading_text", "heading_level", "section_chars",
        (t.snippet(shown, list(search.terms)) if search.terms else F.substring(shown, 1, 64)).alias("snippet"), "source_location", "source_ref",
        F.col("source_location.start_ms").alias("start_ms"), F.col("source_location.end_ms").alias("end_ms"), F.when(timed, F.col("_precision")).alias("timestamp_precision"),
        t.locator(scheme, F.col("workspace"), F.col("entry_id"), F.col("source_location.start_ms"), F.col("source_location.kind"), F.col("source_location.n")).alias("locator"),
        "score", "score_source", "same_section_hits",
    )
