"""Building and maintaining library tables: ingest, upsert, supersede, removal.

Each operator is a pure function of DataFrames; ``plans.library`` writes the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t

SALTS = 16
METADATA = ("title", "author", "publisher", "publish_date")


def split_rejects(items: DataFrame, text: str = "text", workspace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with ``reason``): blank texts and bad workspace names are refused row by row."""
    blank = ~F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))
    reason = F.when(blank, "empty_text")
    if workspace:
        reason = reason.when(~F.coalesce(F.col(workspace).rlike(t.WORKSPACE_NAME), F.lit(False)), "bad_workspace")
    marked = items.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def entries_of(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """One entry per distinct text: the values of the row with the smallest ``key``, and ``copies``."""
    rest = [c for c in items.columns if c not in (key, "text")]
    grouped = items.withColumn("entry_id", t.entry_id(F.col("text"))).groupBy("entry_id").agg(
        F.min(key).alias(key), *[F.min_by(c, key).alias(c) for c in rest], F.count("*").alias("copies"), F.first("text").alias("text")
    )
    return grouped.withColumn("total_chars", F.length("text").cast("bigint"))


def upsert(old: DataFrame, new: DataFrame, key: str = "entry_id") -> DataFrame:
    """All of ``new``, keeping the ``created_at`` of entries already there, and the rest of ``old``."""
    before = old.select(key, F.col("created_at").alias("_before"))
    merged = new.join(before, key, "left").withColumn("created_at", F.coalesce("_before", "created_at")).drop("_before")
    return merged.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def superseded(entries: DataFrame) -> DataFrame:
    """(entry_id, superseded_by): older entries of a source that has a newer one.

    The newest entry of a source by updated_at, then entry_id, stands. It is the maximum of
    a partial aggregation, and is handed out in ``SALTS`` copies, so that a source of very
    many entries is spread over as many tasks.
    """
    rows = entries.where(F.col("source_ref").isNotNull()).select("entry_id", "source_ref", "updated_at")
    newest = rows.groupBy("source_ref").agg(F.max(F.struct("updated_at", "entry_id")).alias("_newest"))
    spread = newest.select("source_ref", F.col("_newest.entry_id").alias("superseded_by"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    marked = rows.withColumn("_salt", F.pmod(F.xxhash64("entry_id"), F.lit(SALTS)).cast("int")).join(spread, ["source_ref", "_salt"])
    return marked.where("entry_id <> superseded_by").select("entry_id", "superseded_by")


def carry_metadata(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` with missing metadata taken from the latest other entry of the same source."""
    latest = old.where(F.col("source_ref").isNotNull()).select("source_ref", F.struct("updated_at", "entry_id", *METADATA).alias("r"))
    # two latest per source are enough: one of them is another entry
    place = W.partitionBy("source_ref").orderBy(F.desc("r.updated_at"), F.desc("r.entry_id"))
    two = latest.withColumn("_n", F.row_number().over(place)).where("_n <= 2").groupBy("source_ref").agg(F.array_sort(F.collect_list(F.struct("_n", "r"))).alias("_all"))
    other = F.get(F.filter("_all", lambda x: x["r"]["entry_id"] != F.col("entry_id")), F.lit(0))["r"]
    joined = new.join(two, "source_ref", "left").withColumn("_other", other)
    kept = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_other.{c}")).alias(c) if c in METADATA else F.col(c) for c in new.columns]
    return joined.select(*kept)


def remove(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the entries of ``gone`` (entry_id): vectors and sub-sections too."""
    return {name: df.join(gone.select("entry_id").distinct(), "entry_id", "left_anti") for name, df in tables.items()}


def without_vectors(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Entries that have no vector yet."""
    return entries.join(vectors.select("entry_id").distinct(), "entry_id", "left_anti")


def newest(table: DataFrame, keep: int, order: str, key: str) -> DataFrame:
    """The ``keep`` latest rows (a cache's retention)."""
    return table.orderBy(F.desc(order), key).limit(keep)


def meta_json(entries: DataFrame) -> DataFrame:
    """(entry_id, meta): each entry's metadata as one JSON text."""
    fields = [c for c in ("entry_id", "workspace", *METADATA, "source_type", "source_ref", "total_chars") if c in entries.columns]
    return entries.select("entry_id", F.to_json(F.struct(*fields)).alias("meta"))
