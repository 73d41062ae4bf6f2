"""Registered queries: keyword, vector and heading routes, fusion, sections, envelope."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import anchors as a
from ..operators import nearest, postings
from ..operators import query as q
from ..operators import retrieve as r
from ..session import materialise
from . import model as m
from .registry import query
from .search import Library, detailed, plan, shaped
from .text_queries import ANCHORS_SQL

LIMIT = 20
DIMS = 64


def query_vector(seed: str, dims: int = DIMS) -> list[float]:
    """A unit vector made from a seed, six decimals before scaling."""
    raw = [round(int.from_bytes(hashlib.sha256(f"{seed}{i}".encode()).digest()[:4], "little") / 2**32 - 0.5, 6) for i in range(dims)]
    size = sum(x * x for x in raw) ** 0.5
    return [round(x / size, 9) for x in raw]


VECTOR = query_vector("open")


def bm25_sql(terms: list[str], columns: tuple[str, ...] = ("chunk_text", "title", "author", "publisher", "publish_date"), table: str = "chunks", within: tuple[str, ...] = ()) -> str:
    """CTEs counted, stats and scored of ``table`` for terms that don't overlap themselves."""
    count = lambda c, p: f"(length(lower({c})) - length(replace(lower({c}), '{p}', ''))) / {len(p)}"
    f = ", ".join(f"({' + '.join(count(c, p) for c in within or columns)})::DOUBLE AS f{i}" for i, p in enumerate(terms))
    n = "".join(f", count(*) FILTER (f{i} > 0)::DOUBLE AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"ln((n - n{i} + 0.5) / (n{i} + 0.5))"
    part = lambda i: f"(CASE WHEN {idf(i)} > 0 THEN {idf(i)} ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / mean))"
    return f"""
counted AS (SELECT *, ({' + '.join(f'greatest(0, length({c}) - 2)' for c in columns)})::DOUBLE AS dl, {f} FROM {table}),
stats AS (SELECT workspace, count(*)::DOUBLE AS n, avg(dl) AS mean{n} FROM counted GROUP BY workspace),
scored AS (SELECT c.*, round(-({' + '.join(part(i) for i in range(len(terms)))}), 12) AS bm25 FROM counted c JOIN stats s USING (workspace))"""


CHUNKS_SQL = "chunks AS (SELECT workspace, entry_id, 0::BIGINT AS chunk_no, 0::BIGINT AS start, text AS chunk_text, title, author, publisher, publish_date FROM entries)"


def keyword_sql(match: list[str], phrases: list[str], test: str, allowed: str = "TRUE", limit: int = LIMIT) -> str:
    """The keyword route as CTEs, the last one named keyword."""
    low = "lower(chunk_text)"
    coverage = " + ".join(f"contains({low}, '{p}')::INT" for p in phrases)
    tf = " + ".join(f"least(5, (length({low}) - length(replace({low}, '{p}', ''))) / {len(p)})" for p in phrases)
    first = ", ".join(f"nullif(instr({low}, '{p}'), 0)" for p in phrases)
    return f"""
{bm25_sql(match)},
matched AS (SELECT workspace, entry_id, chunk_no, bm25, ({coverage})::BIGINT AS coverage, ({tf})::BIGINT AS tf, (start + least({first}) - 1)::BIGINT AS hit_offset FROM scored WHERE ({test}) AND {allowed}),
recalled AS (SELECT * FROM matched ORDER BY bm25, entry_id, chunk_no LIMIT 500),
presorted AS (SELECT * FROM recalled ORDER BY coverage DESC, bm25, entry_id, chunk_no LIMIT {max(60, 3 * limit)}),
keyword AS (SELECT workspace, entry_id, chunk_no, row_number() OVER (ORDER BY coverage DESC, tf DESC, bm25, entry_id, chunk_no) AS route_rank, round(coverage / {float(len(phrases))}::DOUBLE, 4) AS score,
  bm25, coverage, tf, hit_offset, 'fts' AS match_mode FROM presorted QUALIFY route_rank <= {limit})"""


def anywhere(p: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{p}')" for c in q.TEXT_COLUMNS) + ")"


def index_of(chunks: DataFrame) -> r.KeywordIndex:
    """The keyword index of ``chunks``, stored in the shared folder."""
    stored = materialise(postings.build(chunks), "postings")
    return r.KeywordIndex(stored, materialise(postings.stored_statistics(stored), "index-stats"))


COLUMNS_SQL = "SELECT workspace, entry_id, chunk_no, route_rank, round(score, 4) AS score, round(bm25, 6) AS bm25, coverage, tf, hit_offset, match_mode FROM keyword"


def _hits(found: DataFrame) -> DataFrame:
    return found.select("workspace", "entry_id", "chunk_no", "route_rank", "score", F.round("bm25", 6).alias("bm25"), "coverage", "tf", "hit_offset", "match_mode")


def keyword_query(name: str, text: str, match: list[str], phrases: list[str], test: str, allowed: str = "TRUE", indexed: bool = False) -> None:
    """Register a keyword search over all chunks, or over an index of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        topic = q.parse(text, as_filters=True)
        known = m.chunks(spark, sf_dir)
        return _hits(r.keyword_route(known, topic, LIMIT, r.entry_filter(m.entries(spark, sf_dir), topic), index_of(known) if indexed else None))

    query(f"WITH {m.ENTRIES_SQL}, {CHUNKS_SQL}, {keyword_sql(match, phrases, test, allowed)} {COLUMNS_SQL}", name)(run)


keyword_query("kw_or_coverage", "eaux tion reering", ["eaux", "tion", "reering"], ["eaux", "tion", "reering"], " OR ".join(map(anywhere, ["eaux", "tion", "reering"])))
keyword_query("kw_index_or", "eaux tion reering", ["eaux", "tion", "reering"], ["eaux", "tion", "reering"], " OR ".join(map(anywhere, ["eaux", "tion", "reering"])), indexed=True)
keyword_query("kw_index_precedence", "eaux OR tion AND reering NOT ingly", ["eaux", "tion", "reering", "ingly"], ["eaux", "tion", "reering", "ingly"],
              f"{anywhere('eaux')} OR ({anywhere('tion')} AND ({anywhere('reering')} AND NOT {anywhere('ingly')}))", indexed=True)
keyword_query("kw_index_phrase", '"of the" "in the"', ["of the", "in the"], ["of the", "in the"], f"{anywhere('of the')} OR {anywhere('in the')}", indexed=True)
keyword_query("kw_and", "tion AND reering", ["tion", "reering"], ["tion", "reering"], f"{anywhere('tion')} AND {anywhere('reering')}")
keyword_query("kw_not", "tion NOT reering", ["tion", "reering"], ["tion", "reering"], f"{anywhere('tion')} AND NOT {anywhere('reering')}")
keyword_query("kw_precedence", "eaux OR tion AND reering NOT ingly", ["eaux", "tion", "reering", "ingly"], ["eaux", "tion", "reering", "ingly"],
              f"{anywhere('eaux')} OR ({anywhere('tion')} AND ({anywhere('reering')} AND NOT {anywhere('ingly')}))")
keyword_query("kw_phrase", '"of the" "in the"', ["of the", "in the"], ["of the", "in the"], f"{anywhere('of the')} OR {anywhere('in the')}")
keyword_query("kw_prefix", "reeri* eauxv*", ["reeri", "eauxv"], ["reeri", "eauxv"], f"{anywhere('reeri')} OR {anywhere('eauxv')}")
keyword_query("kw_range_filter", "publish_date>=2010 publish_date<2018 tion", ["tion"], ["tion"], anywhere("tion"), "entry_id IN (SELECT entry_id FROM entries WHERE publish_date >= '2010' AND publish_date < '2018')")
keyword_query("kw_filter_candidates", 'author:author title:the tion', ["tion"], ["tion"], anywhere("tion"),
              "entry_id IN (SELECT entry_id FROM entries WHERE contains(lower(title), 'the') AND contains(lower(author), 'author'))")


@query(f"""WITH {m.ENTRIES_SQL}, {CHUNKS_SQL}, {bm25_sql(["the"], within=("title",))}
SELECT workspace, entry_id, chunk_no, row_number() OVER (ORDER BY bm25, entry_id, chunk_no) AS route_rank, NULL::DOUBLE AS score, round(bm25, 6) AS bm25
FROM scored WHERE contains(lower(title), 'the') QUALIFY route_rank <= {LIMIT}""")
def kw_column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column filter alone: the term scores in that column only, without coverage."""
    found = r.keyword_route(m.chunks(spark, sf_dir), q.parse("title:the"), LIMIT)
    return found.select("workspace", "entry_id", "chunk_no", "route_rank", "score", F.round("bm25", 6).alias("bm25"))


@query(f"""WITH {m.ENTRIES_SQL}, {CHUNKS_SQL}
SELECT workspace, entry_id, chunk_no, row_number() OVER (ORDER BY entry_id, chunk_no) AS route_rank, (least(instr(lower(chunk_text), 'ñ'), instr(lower(chunk_text), 'ó')) - 1)::BIGINT AS hit_offset
FROM chunks WHERE contains(lower(chunk_text), 'ñ') AND contains(lower(chunk_text), 'ó') QUALIFY route_rank <= {LIMIT}""")
def kw_short_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.keyword_route(m.chunks(spark, sf_dir), q.parse("ñ ó"), LIMIT)
    return found.select("workspace", "entry_id", "chunk_no", "route_rank", "hit_offset")


@query(f"""WITH {m.ENTRIES_SQL}, {CHUNKS_SQL}, {bm25_sql(["tion", "reering"])}
SELECT workspace, entry_id, chunk_no, round(bm25, 6) AS bm25 FROM scored WHERE {anywhere('tion')} OR {anywhere('reering')} ORDER BY scored.bm25, entry_id, chunk_no LIMIT 20""")
def kw_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = q.parse("tion reering")
    scored = r.bm25(m.chunks(spark, sf_dir), topic, q.TEXT_COLUMNS).where(q.condition(topic, F.col))
    rows = scored.select("workspace", "entry_id", "chunk_no", F.round("bm25", 12).alias("bm25")).orderBy("bm25", "entry_id", "chunk_no").limit(20)
    return rows.withColumn("bm25", F.round("bm25", 6))


NEAR_TESTS = " OR ".join(f"regexp_matches(lower({c}), '(?s)tion.{{0,8}}reer') OR regexp_matches(lower({c}), '(?s)reer.{{0,8}}tion')" for c in q.TEXT_COLUMNS)


@query(f"""WITH {m.ENTRIES_SQL}, {CHUNKS_SQL} SELECT workspace, entry_id, chunk_no FROM chunks WHERE {NEAR_TESTS}""")
def kw_index_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proximity search from the positions of the index."""
    found = r.indexed_matches(index_of(m.chunks(spark, sf_dir)), q.parse("NEAR(tion reer, 10)"))
    return found.select("workspace", "entry_id", "chunk_no")


@query(f"""WITH {m.ENTRIES_SQL}, {CHUNKS_SQL} SELECT workspace, entry_id, chunk_no FROM chunks WHERE {NEAR_TESTS}""")
def kw_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = q.parse("NEAR(tion reer, 10)")
    return m.chunks(spark, sf_dir).where(q.condition(topic, F.col)).select("workspace", "entry_id", "chunk_no")


@query(f"""WITH {m.ENTRIES_SQL}, {CHUNKS_SQL}, placed AS (SELECT entry_id, chunk_text AS s, instr(lower(chunk_text), 'reering') - 1 AS p FROM chunks WHERE contains(lower(chunk_text), 'reering'))
SELECT entry_id, (CASE WHEN p > 32 THEN '…' ELSE '' END) || s[greatest(0, p - 32) + 1:p] || '『' || s[p + 1:p + 7] || '』' || s[p + 8:least(length(s), p + 32)] || (CASE WHEN p + 32 < length(s) THEN '…' ELSE '' END) AS snippet FROM placed""")
def snippet_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.chunks(spark, sf_dir).where(q.contains(F.col("chunk_text"), "reering"))
    return rows.select("entry_id", t.snippet(F.col("chunk_text"), ["reering"]).alias("snippet"))


LIST_SQL = "[" + ", ".join(map(repr, VECTOR)) + "]::DOUBLE[]"
VECTOR_SQL = f"""
near AS (SELECT workspace, entry_id, 0::BIGINT AS chunk_no, 0::BIGINT AS win_start, max(round(greatest(0.0::DOUBLE, list_inner_product(embedding, {LIST_SQL})), 4)) AS score FROM vectors GROUP BY workspace, entry_id),
vector AS (SELECT *, row_number() OVER (ORDER BY score DESC, entry_id, chunk_no) AS route_rank FROM near QUALIFY route_rank <= 60)"""


@query(f"WITH {m.ENTRIES_SQL}, {m.VECTORS_SQL}, {VECTOR_SQL} SELECT workspace, entry_id, chunk_no, score, route_rank FROM vector WHERE route_rank <= 20")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.vector_route(m.vectors(spark, sf_dir), VECTOR, LIMIT).select("workspace", "entry_id", "chunk_no", "score", "route_rank")


def cells_of(vectors: DataFrame) -> nearest.VectorIndex:
    """The index of ``vectors``, stored by cell in the shared folder."""
    pivots = nearest.choose_pivots(vectors)
    stored = materialise(nearest.assign(vectors, pivots), "cells", "cell")
    return nearest.VectorIndex(stored, nearest.bounds(stored, pivots))


@query(f"WITH {m.ENTRIES_SQL}, {m.VECTORS_SQL}, {VECTOR_SQL} SELECT workspace, entry_id, chunk_no, score, route_rank FROM vector WHERE route_rank <= 20")
def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits from an index that is built first: only cells that can hold one are read."""
    return nearest.vector_route(cells_of(m.vectors(spark, sf_dir)), VECTOR, LIMIT).select("workspace", "entry_id", "chunk_no", "score", "route_rank")


@query(f"""WITH {m.ENTRIES_SQL}, {m.VECTORS_SQL}, {VECTOR_SQL.replace("FROM vectors", "FROM vectors WHERE entry_id IN (SELECT entry_id FROM entries WHERE publish_date >= '2010')")}
SELECT workspace, entry_id, score, route_rank FROM vector WHERE route_rank <= 20""")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = r.entry_filter(m.entries(spark, sf_dir), q.parse("publish_date>=2010"))
    return r.vector_route(m.vectors(spark, sf_dir), VECTOR, LIMIT, allowed).select("workspace", "entry_id", "score", "route_rank")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (3 * x)::DOUBLE * (3 * x)::DOUBLE))) / 3, 3) AS size, 1.0::DOUBLE AS unit_size FROM embeddings""")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = F.transform("embedding", lambda x: x * 3)
    return m.table(spark, sf_dir, "embeddings").select("vec_id", F.round(size(v) / 3, 3).alias("size"), F.round(size(r.unit(v)), 6).alias("unit_size"))


@query(f"""WITH w AS (SELECT label::VARCHAR AS entry_id, vec_id // 7 AS chunk_no, vec_id AS win_start, round(greatest(0.0::DOUBLE, list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), {LIST_SQL})), 4) AS score FROM embeddings),
best AS (SELECT entry_id, chunk_no, win_start, score FROM w QUALIFY row_number() OVER (PARTITION BY entry_id, chunk_no ORDER BY score DESC, win_start) = 1)
SELECT entry_id, chunk_no::BIGINT AS chunk_no, win_start, score FROM best ORDER BY score DESC, entry_id, chunk_no LIMIT 20""")
def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several windows per chunk: the best one stands for it."""
    v = m.table(spark, sf_dir, "embeddings").select(F.lit("all").alias("workspace"), F.col("label").cast("string").alias("entry_id"), F.floor(F.col("vec_id") / 7).alias("chunk_no"), F.col("vec_id").alias("win_start"), "embedding")
    return r.vector_route(v, VECTOR, LIMIT).select("entry_id", "chunk_no", "win_start", "score")


HEADING_ROUTE_SQL = f"""
titled AS (SELECT *, heading_text AS chunk_text FROM headings),
{bm25_sql(["tion", "the"], ("chunk_text",), "titled").replace("counted", "h_counted").replace("stats", "h_stats").replace("scored", "h_scored")},
h_kept AS (SELECT workspace, entry_id, heading_no, start AS heading_offset, heading_text, level, bm25, round((contains(lower(heading_text), 'tion')::INT + contains(lower(heading_text), 'the')::INT) / 2.0::DOUBLE, 4) AS score
  FROM h_scored WHERE contains(lower(heading_text), 'tion') OR contains(lower(heading_text), 'the')),
heading AS (SELECT *, row_number() OVER (ORDER BY bm25, entry_id, heading_no) AS route_rank FROM h_kept QUALIFY route_rank <= {{limit}})"""
BASE_SQL = f"{m.ENTRIES_SQL}, {CHUNKS_SQL}, {m.VECTORS_SQL}, {m.LINES_SQL}, {m.HEADINGS_SQL}"


@query(f"WITH {BASE_SQL}, {HEADING_ROUTE_SQL.format(limit=60)} SELECT workspace, entry_id, heading_no, score, heading_text, level, heading_offset, route_rank FROM heading")
def heading_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.heading_route(m.headings(spark, sf_dir), q.parse("tion the"), LIMIT)


ROUTES_SQL = f"{BASE_SQL}, {keyword_sql(['tion', 'the'], ['tion', 'the'], anywhere('tion') + ' OR ' + anywhere('the'), limit=60)}, {VECTOR_SQL}, {HEADING_ROUTE_SQL.format(limit=180)}"
FUSE_SQL = """
united AS (
  SELECT workspace, entry_id, chunk_no::VARCHAR AS unit, 'fts' AS route, route_rank, hit_offset, NULL::BIGINT AS win_start, NULL::BIGINT AS heading_offset FROM keyword
  UNION ALL SELECT workspace, entry_id, chunk_no::VARCHAR, 'vector', route_rank, NULL, win_start, NULL FROM vector
  UNION ALL SELECT workspace, entry_id, 'h' || heading_no, 'heading', route_rank, NULL, NULL, heading_offset FROM heading
),
sums AS (SELECT workspace, entry_id, unit, sum(CASE WHEN route = 'fts' THEN 1.0::DOUBLE / (60 + route_rank) ELSE 0 END) AS f, sum(CASE WHEN route = 'vector' THEN 1.0::DOUBLE / (60 + route_rank) ELSE 0 END) AS v,
  sum(CASE WHEN route = 'heading' THEN 1.0::DOUBLE / (60 + route_rank) ELSE 0 END) AS h, max(hit_offset) AS hit_offset, max(win_start) AS win_start, max(heading_offset) AS heading_offset FROM united GROUP BY ALL),
fused AS (SELECT *, round(f + v + h, 9) AS total, CASE WHEN f > 0 AND v > 0 THEN 'fused' WHEN f > 0 THEN 'fts' WHEN v > 0 THEN 'vector' ELSE 'heading' END AS score_source FROM sums),
top AS (SELECT *, row_number() OVER (ORDER BY total DESC, workspace, entry_id, unit) AS fused_rank FROM fused QUALIFY fused_rank <= 20)"""


def library(spark: SparkSession, sf_dir: str) -> Library:
    """The tables of a search; entries and headings, which several parts read, are written once."""
    known = materialise(m.entries(spark, sf_dir), "entries")
    return Library(known, m.chunks(spark, sf_dir, known), m.vectors(spark, sf_dir, known), materialise(m.headings(spark, sf_dir, known), "headings"))


@query(f"WITH {ROUTES_SQL}, {FUSE_SQL} SELECT workspace, entry_id, unit, fused_rank, round(total, 4) AS score, round(f, 4) AS fts_score, round(v, 4) AS vector_score, round(h, 4) AS heading_score, score_source FROM top")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = plan(library(spark, sf_dir), "tion the", VECTOR, LIMIT).hits
    return hits.select("workspace", "entry_id", "unit", "fused_rank", "score", "fts_score", "vector_score", "heading_score", "score_source")


SECTION_SQL = """
placed AS (SELECT *, coalesce(hit_offset, win_start, CASE WHEN unit = '0' THEN 0 END, heading_offset) AS place FROM top),
marked AS (SELECT p.*, (SELECT max(heading_no) FROM headings h WHERE h.entry_id = p.entry_id AND h.start <= p.place) AS section_no FROM placed p),
keyed AS (SELECT *, CASE WHEN section_no IS NULL THEN 'r' || fused_rank ELSE 's' || section_no END AS grp FROM marked),
merged AS (SELECT workspace, entry_id, grp, min(fused_rank) AS section_rank, arg_min(unit, fused_rank) AS unit, arg_min(place, fused_rank) AS place, min(section_no) AS section_no, round(sum(round(f, 4)), 4) AS fs, round(sum(round(v, 4)), 4) AS vs, round(sum(round(h, 4)), 4) AS hs,
  concat_ws('+', CASE WHEN bool_or(score_source = 'fused') THEN 'fused' END, CASE WHEN bool_or(score_source = 'heading') THEN 'heading' END, CASE WHEN bool_or(score_source = 'fts') THEN 'fts' END, CASE WHEN bool_or(score_source = 'vector') THEN 'vector' END) AS score_source,
  (count(*) - 1)::BIGINT AS same_section_hits FROM keyed GROUP BY workspace, entry_id, grp)"""


@query(f"WITH {ROUTES_SQL}, {FUSE_SQL}, {SECTION_SQL} SELECT workspace, entry_id, section_rank, unit, section_no, fs AS fts_score, vs AS vector_score, hs AS heading_score, round(fs + vs + hs, 4) AS score, score_source, same_section_hits FROM merged")
def section_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    hits = plan(lib, "tion the", VECTOR, LIMIT).hits
    at = F.coalesce("hit_offset", "win_start", F.when(F.col("unit") == "0", F.lit(0).cast("bigint")), "heading_offset")
    marked = a.asof_backward(hits.withColumn("at", at), lib.headings.select("entry_id", "start", F.col("heading_no").alias("section_no")), ["entry_id"], "at", ["section_no"])
    return r.by_section(marked)


@query(f"""WITH {ROUTES_SQL}, {FUSE_SQL}, {SECTION_SQL},
anchors AS (SELECT entry_id, heading_no AS no, start FROM headings UNION ALL SELECT entry_id, 0, 0 FROM entries),
sections AS (SELECT s.entry_id, no, coalesce(lead(start) OVER (PARTITION BY s.entry_id ORDER BY start, no), e.total_chars) - start AS chars FROM anchors s JOIN entries e USING (entry_id))
SELECT section_rank, m.workspace, m.entry_id, title, unit, m.entry_id || CASE WHEN section_no > 0 THEN '#s' || section_no ELSE '#front' END || '@' || place AS section_ref, chars AS section_chars,
  (length(text[1:place]) - length(replace(text[1:place], chr(10), '')) + 1)::BIGINT AS line, round(fs + vs + hs, 4) AS score, m.score_source, same_section_hits
FROM merged m JOIN entries e USING (entry_id) JOIN sections s ON s.entry_id = m.entry_id AND s.no = coalesce(m.section_no, 0)""")
def search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: three routes fused, merged by section, with reference, section length and line."""
    lib = library(spark, sf_dir)
    return shaped(lib, plan(lib, "tion the", VECTOR, LIMIT))


#: Sections of hits by any anchor, and the text around the first term.
ANY_SECTION_SQL = SECTION_SQL.replace("(SELECT max(heading_no) FROM headings h WHERE h.entry_id = p.entry_id AND h.start <= p.place)", "(SELECT arg_max(no, h.start) FROM anchors h WHERE h.entry_id = p.entry_id AND h.start <= p.place AND no <> 0)")
AROUND = "CASE WHEN p IS NULL THEN left(s, 64) ELSE (CASE WHEN p > 32 THEN '…' ELSE '' END) || s[greatest(0, p - 32) + 1:p] || '『' || s[p + 1:p + 4] || '』' || s[p + 5:least(length(s), p + 32)] || (CASE WHEN p + 32 < length(s) THEN '…' ELSE '' END) END"


@query(f"""WITH {ROUTES_SQL}, {FUSE_SQL}, {ANCHORS_SQL}, {ANY_SECTION_SQL},
joined AS (SELECT m.*, e.title AS entry_title, e.source_ref, e.text, c.title AS heading_text, c.level AS heading_level, c.stop - c.start AS section_chars FROM merged m JOIN entries e USING (entry_id) JOIN anchored c ON c.entry_id = m.entry_id AND c.no = coalesce(m.section_no, 0)),
shown AS (SELECT *, CASE WHEN unit = '0' THEN text ELSE heading_text END AS s, (length(text[1:place]) - length(replace(text[1:place], chr(10), '')) + 1)::BIGINT AS line FROM joined),
sought AS (SELECT *, least(nullif(instr(lower(s), 'tion'), 0), nullif(instr(lower(s), 'the'), 0)) - 1 AS p FROM shown)
SELECT section_rank, workspace, entry_id, entry_title AS title, unit, entry_id || CASE WHEN section_no > 0 THEN '#s' || section_no WHEN section_no < 0 THEN '#u' || -section_no ELSE '#front' END || '@' || place AS section_ref, heading_text, heading_level, section_chars,
  {AROUND} AS snippet, 'line' AS place_kind, line AS place_no, source_ref, 'tessera://goto?ws=' || workspace || '&entry=' || entry_id AS link, 'line ' || line AS label, round(fs + vs + hs, 4) AS score, same_section_hits
FROM sought""")
def search_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search as a caller sees it: anchors with sub-sections, snippets, places in the source and links."""
    lib = library(spark, sf_dir)
    found = detailed(lib, plan(lib, "tion the", VECTOR, LIMIT), step=500)
    return found.select(
        "section_rank", "workspace", "entry_id", "title", "unit", "section_ref", "heading_text", "heading_level", "section_chars", "snippet", F.col("source_location.kind").alias("place_kind"),
        F.col("source_location.n").alias("place_no"), "source_ref", F.col("locator.link").alias("link"), F.col("locator.label").alias("label"), "score", "same_section_hits",
    )


@query(f"WITH {ROUTES_SQL}, {FUSE_SQL} SELECT 'vector' AS mode, entry_id, round(1.0::DOUBLE / (60 + route_rank), 4) AS score FROM vector WHERE route_rank <= 20 UNION ALL SELECT 'fts', entry_id, round(1.0::DOUBLE / (60 + route_rank), 4) FROM keyword WHERE route_rank <= 20")
def route_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same query by the vector route alone and by the keyword route."""
    lib = library(spark, sf_dir)
    by = lambda mode: plan(lib, "tion the", VECTOR, LIMIT, mode).hits.select(F.lit(mode).alias("mode"), "entry_id", F.round(F.col("fts_score") + F.col("vector_score"), 4).alias("score"))
    return by("vector").unionByName(by("fts"))


@query(f"""WITH {BASE_SQL.replace("FROM entries)", "FROM entries WHERE workspace IN ('fr', 'es'))", 1)}, {keyword_sql(["eaux", "tion"], ["eaux", "tion"], anywhere("eaux") + " OR " + anywhere("tion"))} SELECT workspace, entry_id, route_rank, score FROM keyword""")
def cross_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two libraries searched at once, ranked together."""
    rows = m.chunks(spark, sf_dir).where(F.col("workspace").isin("fr", "es"))
    return r.keyword_route(rows, q.parse("eaux tion"), LIMIT).select("workspace", "entry_id", "route_rank", "score")


@query(f"""WITH {ROUTES_SQL}, {FUSE_SQL} SELECT (SELECT count(*) FROM fused) AS candidates_total, (SELECT count(*) FROM fused) > 20 AS truncated_by_limit, NULL::BIGINT AS filtered_entries, (SELECT count(*) FROM keyword) = 0 AS keyword_miss,
(SELECT count(*) FROM vectors) AS vectors_rows, (SELECT count(*) FROM vectors) = 0 AS vector_zero_hint""")
def truncation_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    s = plan(lib, "tion the", VECTOR, LIMIT)
    return r.envelope(s.candidates, s.keyword, lib.vectors, LIMIT, s.allowed)
