"""Registered queries: ingest, maintenance, statistics, verification, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as i
from ..operators import read
from ..operators import verify as v
from ..streaming import landing
from . import model as m
from .registry import query

TABLE = ["workspace", "entry_id", "source_ref", "author", "publisher", "publish_date", "created_at", "updated_at", "title", "total_chars"]


@query(f"WITH {m.ENTRIES_SQL} SELECT entry_id, doc_id, workspace, source_ref, copies, total_chars FROM entries")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.entries(spark, sf_dir).select("entry_id", "doc_id", "workspace", "source_ref", "copies", "total_chars")


@query("SELECT doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'empty_text' ELSE 'bad_workspace' END AS reason FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' || chr(10) ELSE text END AS text, CASE WHEN doc_id % 7 = 0 THEN 'a b' ELSE lang END AS ws FROM documents) WHERE NOT regexp_matches(coalesce(text, ''), '\\S') OR NOT regexp_matches(ws, '^[A-Za-z0-9_-]+$')")
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with blank texts and bad workspace names: each is refused alone."""
    rows = m.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, " \n").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 7 == 0, "a b").otherwise(F.col("lang")).alias("ws"))
    return i.split_rejects(rows, "text", "ws")[1].select("doc_id", "reason")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The entries as an old library and a later batch that overlap."""
    e = m.entries(spark, sf_dir).drop("text", "copies")
    return e.where("doc_id % 3 < 2"), e.where("doc_id % 3 > 0").withColumn("created_at", F.lit("2025-01-01")).withColumn("updated_at", F.lit("2025-01-01"))


@query(f"""WITH {m.ENTRIES_SQL}
SELECT entry_id, CASE WHEN doc_id % 3 = 2 THEN '2025-01-01' ELSE updated_at END AS created_at, CASE WHEN doc_id % 3 = 0 THEN updated_at ELSE '2025-01-01' END AS updated_at, title FROM entries""")
def ingest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch merged into a library: created_at of known entries stays."""
    old, new = _halves(spark, sf_dir)
    return i.upsert(old, new).select("entry_id", "created_at", "updated_at", "title")


@query(f"WITH {m.ENTRIES_SQL} SELECT entry_id, first_value(entry_id) OVER (PARTITION BY source_ref ORDER BY updated_at DESC, entry_id DESC) AS superseded_by FROM entries QUALIFY entry_id <> superseded_by")
def supersede_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.superseded(m.entries(spark, sf_dir))


@query(f"""WITH {m.ENTRIES_SQL},
old AS (SELECT * FROM entries WHERE doc_id % 2 = 0),
new AS (SELECT entry_id, source_ref, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE title END AS title, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE author END AS author FROM entries),
other AS (SELECT n.entry_id, o.title AS t2, o.author AS a2 FROM new n JOIN old o ON o.source_ref = n.source_ref AND o.entry_id <> n.entry_id QUALIFY row_number() OVER (PARTITION BY n.entry_id ORDER BY o.updated_at DESC, o.entry_id DESC) = 1)
SELECT entry_id, coalesce(title, t2) AS title, coalesce(author, a2) AS author FROM new LEFT JOIN other USING (entry_id)""")
def metadata_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing titles and authors come from the latest other entry of the same source."""
    e = m.entries(spark, sf_dir).drop("text")
    new = e.withColumn("title", F.when(F.col("doc_id") % 3 != 0, F.col("title"))).withColumn("author", F.when(F.col("doc_id") % 5 != 0, F.col("author")))
    return i.carry_metadata(new, e.where("doc_id % 2 = 0")).select("entry_id", "title", "author")


@query(f"WITH {m.ENTRIES_SQL} SELECT entry_id, title FROM entries")
def title_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.entries(spark, sf_dir).select("entry_id", "title")


@query(f"WITH {m.ENTRIES_SQL}, {m.VECTORS_SQL}, {m.LINES_SQL}, {m.HEADINGS_SQL} SELECT 'entries' AS name, count(*) AS kept FROM entries WHERE doc_id % 4 <> 0 UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE entry_id NOT IN (SELECT entry_id FROM entries WHERE doc_id % 4 = 0) UNION ALL SELECT 'headings', count(*) FROM headings WHERE entry_id NOT IN (SELECT entry_id FROM entries WHERE doc_id % 4 = 0)")
def remove_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the entries goes from every table."""
    e = m.entries(spark, sf_dir)
    left = i.remove({"entries": e, "vectors": m.vectors(spark, sf_dir), "headings": m.headings(spark, sf_dir)}, e.where("doc_id % 4 = 0"))
    return v.summary(left).select(F.col("check").alias("name"), F.col("problems").alias("kept"))


@query(f"WITH {m.ENTRIES_SQL}, {m.VECTORS_SQL} SELECT entry_id, doc_id FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM vectors)")
def zero_vector_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.without_vectors(m.entries(spark, sf_dir), m.vectors(spark, sf_dir)).select("entry_id", "doc_id")


@query(f"WITH {m.ENTRIES_SQL}, {m.VECTORS_SQL} SELECT entry_id, count(*) AS vectors FROM vectors GROUP BY entry_id")
def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.vectors(spark, sf_dir).groupBy("entry_id").agg(F.count("*").alias("vectors"))


@query(f"WITH {m.ENTRIES_SQL}, {m.VECTORS_SQL} SELECT workspace, count(*) AS entries, count(*) AS chunks, coalesce(any_value(v), 0) AS vectors, sum(total_chars)::BIGINT AS total_chars, max(updated_at) AS updated_at FROM entries LEFT JOIN (SELECT workspace, count(*) AS v FROM vectors GROUP BY 1) USING (workspace) GROUP BY workspace")
def ws_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.library_stats(m.entries(spark, sf_dir), m.chunks(spark, sf_dir), m.vectors(spark, sf_dir))


@query(f"WITH {m.ENTRIES_SQL} SELECT workspace, source_ref AS source, count(*) AS entries FROM entries GROUP BY ALL")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.entries(spark, sf_dir).groupBy("workspace", F.col("source_ref").alias("source")).agg(F.count("*").alias("entries"))


@query(f"WITH {m.ENTRIES_SQL}, {m.VECTORS_SQL}, c AS (SELECT entry_id, count(*) AS n FROM vectors GROUP BY 1) SELECT workspace, entry_id, title, total_chars, updated_at, coalesce(n, 0) AS vectors FROM entries LEFT JOIN c USING (entry_id)")
def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.entry_list(m.entries(spark, sf_dir), m.vectors(spark, sf_dir))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 512")
def cache_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 512 latest rows stay, as in the query cache."""
    return i.newest(m.table(spark, sf_dir, "events"), 512, "ts", "event_id").select("event_id", "user_id")


def _damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries, and their text in two chunks of which some are shifted, changed or lost."""
    e = m.entries(spark, sf_dir).withColumn("half", F.floor(F.col("total_chars") / 2))
    halves = e.select("entry_id", "doc_id", "text", "half", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("chunk_no"))
    start = F.when(F.col("chunk_no") == 0, 0).otherwise(F.col("half"))
    body = F.when(F.col("chunk_no") == 0, F.substr("text", F.lit(1), F.col("half").cast("int"))).otherwise(F.substr("text", F.col("half").cast("int") + 1))
    cut = halves.select("entry_id", "chunk_no", "doc_id", F.when((F.col("doc_id") % 11 == 0) & (F.col("chunk_no") == 1), start + 1_000_000).otherwise(start).alias("start"), F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("~"), body)).otherwise(body).alias("chunk_text"))
    kept = cut.where("not (doc_id % 17 = 0 and chunk_no = 1) and not (doc_id % 19 = 0 and chunk_no = 0)")
    return e.withColumn("chunk_count", F.lit(2)), kept.drop("doc_id")


DAMAGED_SQL = f"""{m.ENTRIES_SQL},
cut AS (SELECT entry_id, doc_id, text, total_chars, c AS chunk_no, CASE WHEN c = 0 THEN 0 ELSE total_chars // 2 END AS s, CASE WHEN c = 0 THEN text[1:total_chars // 2] ELSE text[total_chars // 2 + 1:] END AS body FROM entries, (VALUES (0::BIGINT), (1::BIGINT)) x(c)),
pieces AS (SELECT entry_id, doc_id, text, total_chars, chunk_no, CASE WHEN doc_id % 11 = 0 AND chunk_no = 1 THEN s + 1000000 ELSE s END AS start, CASE WHEN doc_id % 13 = 0 THEN '~' || body ELSE body END AS chunk_text FROM cut WHERE NOT (doc_id % 17 = 0 AND chunk_no = 1) AND NOT (doc_id % 19 = 0 AND chunk_no = 0))"""


@query(f"WITH {DAMAGED_SQL} SELECT entry_id, 2::BIGINT AS stored, coalesce(n, 0) AS actual FROM entries LEFT JOIN (SELECT entry_id, count(*) AS n FROM pieces GROUP BY 1) USING (entry_id) WHERE coalesce(n, 0) <> 2")
def verify_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.chunk_counts(*_damaged(spark, sf_dir))


@query(f"WITH {DAMAGED_SQL}, j AS (SELECT entry_id, chunk_no, CASE WHEN start + length(chunk_text) > total_chars THEN 'offset_out_of_range' WHEN text[start + 1:start + length(chunk_text)] <> chunk_text THEN 'chunk_text_mismatch' END AS reason FROM pieces) SELECT * FROM j WHERE reason IS NOT NULL")
def verify_text_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.text_mismatch(*_damaged(spark, sf_dir))


@query(f"""WITH {DAMAGED_SQL},
o AS (SELECT entry_id, text, total_chars, coalesce(max(start + length(chunk_text)) OVER (PARTITION BY entry_id ORDER BY start, chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, start AS gap_end FROM pieces),
g AS (SELECT entry_id, text, gap_start::BIGINT AS gap_start, gap_end::BIGINT AS gap_end, 'coverage_gap' AS reason FROM o WHERE gap_end > gap_start UNION ALL SELECT entry_id, any_value(text), max(start + length(chunk_text))::BIGINT, any_value(total_chars), 'coverage_tail' FROM pieces GROUP BY entry_id HAVING any_value(total_chars) > max(start + length(chunk_text)))
SELECT entry_id, gap_start, gap_end, reason FROM g WHERE regexp_matches(text[gap_start + 1:gap_end], '\\S')""")
def verify_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.coverage(*_damaged(spark, sf_dir))


@query(f"WITH {m.ENTRIES_SQL}, {m.LINES_SQL}, {m.HEADINGS_SQL}, moved AS (SELECT entry_id, CASE WHEN heading_no % 2 = 0 THEN NULL ELSE start * 2 END AS start FROM headings) SELECT h.entry_id, h.start FROM moved h LEFT JOIN entries e USING (entry_id) WHERE h.start IS NULL OR h.start < 0 OR h.start > coalesce(e.total_chars, 0)")
def verify_heading_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = m.headings(spark, sf_dir).withColumn("start", F.when(F.col("heading_no") % 2 != 0, F.col("start") * 2))
    return v.headings_outside(m.entries(spark, sf_dir), moved)


@query(f"WITH {m.ENTRIES_SQL} SELECT entry_id, NULLIF(CASE WHEN doc_id % 4 = 0 THEN -1 WHEN doc_id % 4 = 1 THEN -99 ELSE doc_id END, -99)::BIGINT AS start, 'page' AS kind FROM entries WHERE doc_id % 4 < 2")
def verify_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.entries(spark, sf_dir).select("entry_id", F.when(F.col("doc_id") % 4 == 0, F.lit(-1)).when(F.col("doc_id") % 4 == 1, F.lit(None)).otherwise(F.col("doc_id")).cast("bigint").alias("start"), F.lit("page").alias("kind"))
    return v.ledger_invalid(rows)


@query(f"WITH {m.ENTRIES_SQL} SELECT entry_id, 0::BIGINT AS chunk_no, 'not_indexed' AS reason FROM entries WHERE doc_id % 5 = 0 UNION ALL SELECT entry_id, 1, 'stale_index' FROM entries WHERE doc_id % 7 = 0")
def verify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lacks some chunks and holds others that are gone."""
    e = m.entries(spark, sf_dir)
    zero, one = F.lit(0).cast("bigint").alias("chunk_no"), F.lit(1).cast("bigint").alias("chunk_no")
    index = e.where("doc_id % 5 <> 0").select("entry_id", zero).unionByName(e.where("doc_id % 7 = 0").select("entry_id", one))
    return v.index_mismatch(e.select("entry_id", zero), index)


@query(f"WITH {m.ENTRIES_SQL} SELECT entry_id, 'full_text_missing' AS reason FROM entries WHERE doc_id % 6 IN (0, 1) UNION ALL SELECT entry_id, 'tmp_residual' FROM entries WHERE doc_id % 6 = 2 UNION ALL SELECT 'orphan' || doc_id, 'orphan_entry_dir' FROM entries WHERE doc_id % 6 = 3")
def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries against a listing with missing, half-written and foreign folders."""
    e = m.entries(spark, sf_dir).select("entry_id", "doc_id", (F.col("doc_id") % 6).alias("c"))
    made = e.where("c <> 0").select("entry_id", (F.col("c") == 1).alias("is_temporary"))
    more = e.where("c = 2").select("entry_id", F.lit(True).alias("is_temporary"))
    foreign = e.where("c = 3").select(F.concat(F.lit("orphan"), "doc_id").alias("entry_id"), F.lit(False).alias("is_temporary"))
    return v.against_files(e, made.unionByName(more).unionByName(foreign))


EVENTS = "count(*) AS n, round(sum(value), 4) AS total FROM"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT time_bucket(INTERVAL '1 day', ts) AS win_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS win_end, event_type, {EVENTS} events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(landing.tumbling(_events(spark, sf_dir)))


@query(f"WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) - to_days(k::INTEGER) AS win_start, event_type, value FROM events, (VALUES (0), (1)) x(k)) SELECT win_start, win_start + INTERVAL '2 days' AS win_end, event_type, {EVENTS} w GROUP BY ALL")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(landing.sliding(_events(spark, sf_dir)))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, g""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(landing.sessions(_events(spark, sf_dir)))
