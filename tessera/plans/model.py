"""The engine's tables, built from the source tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import anchors as a
from ..operators import ingest

ANCHOR_CHARS = (3, 60)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dated(doc_id: Column) -> tuple[Column, Column]:
    """(publish_date, updated_at): dates as text, made from the id."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat((2000 + doc_id % 25).cast("string"), F.lit("-"), two(1 + doc_id % 12)), F.concat(F.lit("2024-01-"), two(1 + doc_id % 28))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ingest items."""
    published, updated = dated(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("workspace"), F.lit("text").alias("source_type"), F.col("source").alias("source_ref"), F.concat(F.lit("author "), F.col("doc_id") % 7).alias("author"),
        F.concat(F.lit("press "), F.col("doc_id") % 3).alias("publisher"), published.alias("publish_date"), updated.alias("created_at"), updated.alias("updated_at"), "text",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ingest.split_rejects(items(spark, sf_dir))
    return ingest.entries_of(good).withColumn("title", t.title_hint(F.lit(None).cast("string"), F.col("text"), F.col("entry_id")))


def chunks(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """One chunk per entry, the whole text; ``known`` are the entries, if they are at hand."""
    zero = F.lit(0).cast("bigint")
    return (known or entries(spark, sf_dir)).select("workspace", "entry_id", zero.alias("chunk_no"), zero.alias("start"), F.col("text").alias("chunk_text"), "title", "author", "publisher", "publish_date")


def vectors(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """The embeddings table as windows of the entries that hold the text of the document with the vector's number.

    A vector without such an entry stands for one of its own, in the workspace ``none``.
    """
    e = (known or entries(spark, sf_dir)).select("workspace", "entry_id")
    texts = table(spark, sf_dir, "documents").select("doc_id", t.entry_id(F.col("text")).alias("entry_id"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    zero = F.lit(0).cast("bigint")
    own = F.coalesce("workspace", F.lit("none")), F.when(F.col("workspace").isNull(), F.concat(F.lit("vector "), "doc_id")).otherwise(F.col("entry_id"))
    return v.join(texts, "doc_id", "left").join(e, "entry_id", "left").select(own[0].alias("workspace"), own[1].alias("entry_id"), zero.alias("chunk_no"), zero.alias("win_start"), "embedding")


def lines(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    return a.line_rows(known or entries(spark, sf_dir), carry=("workspace",))


def headings(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Short lines as anchors: workspace, entry_id, heading_no, start, level, heading_text."""
    from pyspark.sql import Window as W

    short = lines(spark, sf_dir, known).where(F.length("line").between(*ANCHOR_CHARS))
    number = F.row_number().over(W.partitionBy("entry_id").orderBy("start")).cast("bigint")
    return short.select("entry_id", number.alias("heading_no"), "start", F.lit(1).cast("bigint").alias("level"), F.col("line").alias("heading_text"), "workspace")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as ten-second segments."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", (F.col("turn") * 10_000).alias("start_ms"), ((F.col("turn") + 1) * 10_000).alias("end_ms"), "text")


#: The same tables as common table expressions.
ENTRIES_SQL = r"""
firsts AS (
  SELECT left(sha256(text), 16) AS entry_id, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS workspace, arg_min(source, doc_id) AS source_ref, any_value(text) AS text, count(*)::BIGINT AS copies
  FROM documents WHERE regexp_matches(text, '\S') GROUP BY 1
),
entries AS (
  SELECT *, 'author ' || (doc_id % 7) AS author, 'press ' || (doc_id % 3) AS publisher, (2000 + doc_id % 25) || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') AS publish_date,
    '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') AS updated_at, length(text)::BIGINT AS total_chars,
    coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^#+', ''))), lambda x: x <> '')[1][:80], entry_id) AS title
  FROM firsts
)"""
VECTORS_SQL = """vectors AS (
  SELECT coalesce(e.workspace, 'none') AS workspace, coalesce(e.entry_id, 'vector ' || v.vec_id) AS entry_id, list_transform(v.embedding, lambda x: x::DOUBLE) AS embedding
  FROM embeddings v LEFT JOIN documents d ON v.vec_id = d.doc_id LEFT JOIN entries e ON e.entry_id = left(sha256(d.text), 16)
)"""
LINES_SQL = """
numbered AS (SELECT entry_id, workspace, unnest(range(len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (SELECT entry_id, workspace, string_split(text, chr(10)) AS l FROM entries)),
lines AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY entry_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM numbered)"""
HEADINGS_SQL = "headings AS (SELECT workspace, entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY start) AS heading_no, start, 1::BIGINT AS level, line AS heading_text FROM lines WHERE length(line) BETWEEN 3 AND 60)"
SEGMENTS_SQL = """
segments AS (SELECT conv_id, turn, turn * 10000 AS start_ms, (turn + 1) * 10000 AS end_ms, trim(text) AS text FROM conversations WHERE trim(text) <> ''),
spans AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM segments)"""
