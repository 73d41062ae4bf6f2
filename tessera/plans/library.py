"""A library on disk: versions of Parquet tables by workspace, and what is done with them.

A change writes the new state of the workspaces it touches to folders of its own and
then a manifest, which names the folders of every table; the highest manifest is the state
of the library. So all tables change at once: until the manifest is there, readers see the
old state whole, and what a change that ended early has written is never read. A reader
takes all its tables from one manifest. ``prune`` deletes old manifests and the folders
that only they, or no manifest, name.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..functions.embed import Embedder, embed_column
from ..operators import anchors as a
from ..operators import ingest as i
from ..operators import nearest, postings, read, verify
from ..operators import retrieve as r
from ..operators import segment as s
from ..session import materialise
from ..sources.subtitles import parse_srt
from .search import Library, Search, detailed, plan

NAME = re.compile("[A-Za-z0-9一-鿿_-]+")
SCHEMAS = {
    "entries": "entry_id string, title string, source_type string, source_ref string, author string, publisher string, publish_date string, created_at string, updated_at string, total_chars long, chunk_count long, text string, workspace string",
    "chunks": "entry_id string, chunk_no long, start long, stop long, chunk_text string, title string, author string, publisher string, publish_date string, workspace string",
    "vectors": "entry_id string, chunk_no long, win_start long, win_end long, embedding array<float>, cell int, workspace string",
    "cells": nearest.SCHEMA,
    "headings": "entry_id string, heading_no long, start long, level long, heading_text string, workspace string",
    "ledger": "entry_id string, start long, kind string, v1 long, v2 long, title string, workspace string",
    "postings": postings.SCHEMA,
    "index_stats": postings.STATS,
}
OPTIONAL = ("title", "source_type", "source_ref", "author", "publisher", "publish_date")
#: Where the text comes from in its source: offsets of pages and chapters, bookmarks of pages, or timed segments that make the text.
ORIGIN = {"pages": "array<struct<start:bigint,page:bigint>>", "chapters": "array<struct<start:bigint,chapter:bigint,title:string>>", "segments": "array<struct<start_ms:bigint,end_ms:bigint,text:string>>", "outline": "array<struct<level:bigint,title:string,page:bigint>>"}
PARTS = ("chunks", "headings", "vectors", "ledger")
INDEX = ("postings", "index_stats")
KEYS = ["workspace", "entry_id"]


def _timed(items: DataFrame) -> DataFrame:
    """Items whose segments, if they have any with text, make their text: trimmed, one a line."""
    said = F.filter(F.transform(F.coalesce("segments", parse_srt(F.col("srt_text"))), lambda s: s.withField("text", F.trim(s["text"]))), lambda s: s["text"] != "")
    kept = F.when(F.size(said) > 0, said)
    return items.withColumn("segments", kept).drop("srt_text").withColumn("text", F.coalesce(F.array_join(F.transform("segments", lambda s: s["text"]), "\n"), "text"))


def _ledger(entries: DataFrame) -> DataFrame:
    """The ledger rows of entries with ``ORIGIN`` columns."""
    keyed = entries.select(F.concat_ws("\0", *KEYS).alias("_key"), "pages", "chapters", "segments")
    part = lambda c: keyed.select("_key", F.posexplode(c).alias("_no", "_x")).select("_key", "_no", "_x.*")
    rows = a.ledger(part("pages"), part("chapters"), a.segment_spans(part("segments"), "_key", ["_no"]), key="_key")
    key = F.split("_key", "\0")
    return rows.select(key[0].alias("workspace"), key[1].alias("entry_id"), "start", "kind", "v1", "v2", "title")


class Conflict(RuntimeError):
    """Another change became the next version first; nothing was changed."""


@dataclass
class State:
    """A version: when each workspace was created, the folder of each table and workspace, the last batch of each stream."""

    version: int = 0
    workspaces: dict[str, str] = field(default_factory=dict)
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {f for by_workspace in self.tables.values() for f in by_workspace.values()}


class Store:
    """The tables of a library below ``root``, and its operations. ``version`` pins a state for reading."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def _versions(self) -> list[int]:
        path = self._path("versions")
        files = self._files(path)
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def state(self) -> State:
        """The pinned state, or the latest one."""
        number = self.version if self.version is not None else max(self._versions(), default=0)
        if not number:
            return State()
        lines = self.spark.read.option("wholetext", True).text(f"{self.root}/versions/{number:012d}.json").collect()  # one manifest
        return State(**json.loads(lines[0][0]))

    def _commit(self, state: State) -> None:
        """Make ``state`` the next version; the rename of its manifest is the moment of the change."""
        if self.version is not None:
            raise ValueError(f"pinned: version {self.version} is for reading")
        state.version += 1
        path, draft = self._path(f"versions/{state.version:012d}.json"), self._path(f"drafts/{uuid.uuid4().hex}.json")
        files = self._files(path)
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(state.__dict__, ensure_ascii=False).encode()))
        out.close()
        files.mkdirs(path.getParent())
        if files.exists(path) or not files.rename(draft, path):
            files.delete(draft, False)
            raise Conflict(f"version {state.version} is there already")

    def table(self, name: str, state: State | None = None) -> DataFrame:
        """A table of the given state, or of the current one."""
        folders = sorted((state or self.state()).tables.get(name, {}).values())
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        found = self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.root}/data/{name}").parquet(*[f"{self.root}/{f}" for f in folders])
        return found.drop("change", "_w")

    def _replace(self, state: State, name: str, rows: DataFrame, workspaces: Iterable[str]) -> None:
        """Write ``rows`` as all that ``name`` has of these workspaces, and note that in ``state``.

        The rows are rebalanced: small workspaces go to one file each, large ones are
        split over many tasks by size.
        """
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).withColumn("_w", F.col("workspace"))
        folder, parts = f"data/{name}/change={uuid.uuid4().hex}", ["_w"]
        if name == "postings":
            dealt, parts = rows.hint("rebalance", "_w", "bucket").sortWithinPartitions("bucket", "gram"), ["_w", "bucket"]
        elif name == "vectors":
            dealt, parts = rows.hint("rebalance", "_w", "cell"), ["_w", "cell"]
        else:
            dealt = rows.hint("rebalance", "_w").sortWithinPartitions(schema.names[0])
        dealt.write.partitionBy(*parts).parquet(f"{self.root}/{folder}")
        held = state.tables.setdefault(name, {})
        for w in set(workspaces):
            path = self._path(f"{folder}/_w={w}")
            if self._files(path).exists(path):
                held[w] = f"{folder}/_w={w}"
            else:
                held.pop(w, None)

    def _index(self, state: State, workspaces: list[str]) -> None:
        """The keyword index of these workspaces from the chunks of ``state``."""
        chunks = self.table("chunks", state).where(F.col("workspace").isin(workspaces))
        self._replace(state, "postings", postings.build(chunks), workspaces)
        self._replace(state, "index_stats", postings.statistics(chunks), workspaces)

    def _cells(self, state: State, workspace: str) -> None:
        """All vectors of a workspace in cells, and the bounds of these; vectors that come later are in none until the next time."""
        mine = self.table("vectors", state).where(F.col("workspace") == workspace)
        pivots, first = nearest.later_pivots(mine, self.table("cells", state))
        done = materialise(nearest.assign(mine, pivots, first), "cells")
        self._replace(state, "vectors", done, [workspace])
        self._replace(state, "cells", nearest.bounds(done, pivots, first), [workspace])

    def prune(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions and what only these name; returns how many folders went.

        Not to be run while a change is being written.
        """
        versions = self._versions()
        wanted = {f.rsplit("/", 1)[0] for n in versions[-keep:] for f in Store(self.spark, self.root, n).state().folders()}
        for n in versions[:-keep]:
            path = self._path(f"versions/{n:012d}.json")
            self._files(path).delete(path, False)
        gone = 0
        for name in SCHEMAS:
            path = self._path(f"data/{name}")
            files = self._files(path)
            for found in [f.getPath() for f in files.listStatus(path)] if files.exists(path) else []:
                if f"data/{name}/{found.getName()}" not in wanted:
                    files.delete(found, True)
                    gone += 1
        return gone

    def _check(self, name: str) -> str:
        if not NAME.fullmatch(name):
            raise ValueError(f"bad_workspace: {name!r}")
        return name

    # workspaces

    def create(self, name: str, now: str) -> None:
        state = self.state()
        if name in self.names():
            raise ValueError(f"workspace_exists: {name}")
        state.workspaces[self._check(name)] = now
        self._commit(state)

    def names(self) -> list[str]:
        """All workspaces."""
        state = self.state()
        return sorted({*state.workspaces, *state.tables.get("entries", {})})

    def delete(self, name: str, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("confirm_needed")
        state = self.state()
        for held in (state.workspaces, *state.tables.values()):
            held.pop(self._check(name), None)
        self._commit(state)

    def rename(self, old: str, new: str) -> None:
        if self._check(new) in self.names():
            raise ValueError(f"workspace_exists: {new}")
        state = self.state()
        for name in SCHEMAS:
            if state.tables.get(name, {}).get(self._check(old)):
                mine = self.table(name, state).where(F.col("workspace") == old)
                self._replace(state, name, mine.withColumn("workspace", F.lit(new)), [new])
                state.tables[name].pop(old)
        if old in state.workspaces:
            state.workspaces[new] = state.workspaces.pop(old)
        self._commit(state)

    # ingest and maintenance

    def ingest(self, items: DataFrame, now: str, embedder: Embedder | None = None, replace: bool = False, batch: tuple[str, int] | None = None) -> DataFrame:
        """Add items (workspace, text, optional metadata and origin); returns the refused ones with a reason.

        The same text is the same entry: it is updated and keeps its created_at.
        Missing metadata comes from an older entry of the source; ``replace`` drops
        older entries of a source that has a new one, and a boolean column ``replace``
        says so item by item (null: the argument). ``segments``, or ``srt_text`` that is
        parsed into them, make the text of a timed item; ``pages`` and ``chapters`` give
        offsets in ``text``. All of them go to the ledger. All tables change at once. ``batch``
        (stream, number) is remembered with the change: a batch that is in already does nothing.
        """
        state = self.state()
        if batch and state.streams.get(batch[0], -1) >= batch[1]:
            return items.limit(0).withColumn("reason", F.lit(None).cast("string"))
        if batch:
            state.streams[batch[0]] = batch[1]
        for c, kind in {"text": "string", "srt_text": "string", **dict.fromkeys(OPTIONAL, "string"), **ORIGIN, "replace": "boolean"}.items():
            if c not in items.columns:
                items = items.withColumn(c, F.lit(None).cast(kind))
        items = _timed(items).withColumn("replace", F.coalesce("replace", F.lit(replace)))
        good, refused = i.split_rejects(items, "text", "workspace")
        keyed = good.withColumn("entry_id", t.entry_id(F.col("text"))).withColumn("_at", F.monotonically_increasing_id())
        # of items with one text the last stands, with all its metadata
        last = F.max_by(F.struct(*OPTIONAL, *ORIGIN, "replace"), F.col("_at"))
        one = keyed.groupBy("workspace", "entry_id").agg(last.alias("_item"), F.first("text").alias("text")).select("workspace", "entry_id", "_item.*", "text")
        stamped = one.withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now)).withColumn("total_chars", F.length("text").cast("bigint"))
        old = self.table("entries", state)
        scope = lambda df: df.withColumn("source_ref", F.concat_ws("\u0000", "workspace", F.nullif("source_ref", F.lit(""))))  # noqa: E731  sources are per workspace
        carried = i.carry_metadata(stamped.withColumn("_ref", F.col("source_ref")).transform(scope), scope(old.where(F.col("source_ref").isNotNull())))
        new = materialise(carried.withColumn("source_ref", F.col("_ref")).drop("_ref").withColumn("title", t.title_hint(F.col("title"), F.col("text"), F.col("entry_id"))), "new-entries")
        touched = sorted(r.workspace for r in new.select("workspace").distinct().collect())
        if not touched:
            if batch:
                self._commit(state)
            return refused
        keys = KEYS
        pieces = s.chunks(new.withColumn("_key", F.concat_ws("\u0000", "workspace", "entry_id")), "_key")
        pieces = pieces.select(F.split("_key", "\u0000")[0].alias("workspace"), F.split("_key", "\u0000")[1].alias("entry_id"), "chunk_no", "start", "stop", F.col("body").alias("chunk_text"))
        chunks = pieces.join(new.select(*keys, "title", "author", "publisher", "publish_date"), keys)
        counted = new.join(pieces.groupBy(*keys).agg(F.count("*").alias("chunk_count")), keys, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint")))
        before = State(**json.loads(json.dumps(state.__dict__)))
        here = lambda name: self.table(name, before).where(F.col("workspace").isin(touched))
        newer = new.where(F.col("source_ref").isNotNull() & F.col("replace")).select("workspace", "source_ref").distinct()
        kept = here("entries").join(newer, ["workspace", "source_ref"], "left_anti")
        plain = counted.drop(*ORIGIN, "replace").withColumn("_k", F.struct(*keys))
        old_dates = here("entries").select(F.struct(*keys).alias("_k"), F.col("created_at").alias("_first"))
        dated = plain.join(old_dates, "_k", "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
        merged = materialise(i.upsert(kept.withColumn("_k", F.struct(*keys)), dated, "_k").drop("_k"), "merged")
        stays = merged.select(*keys)

        def rest(name: str) -> DataFrame:
            return here(name).join(new.select(*keys), keys, "left_anti").join(stays, keys, "left_semi")

        self._replace(state, "chunks", rest("chunks").unionByName(chunks), touched)
        self._replace(state, "headings", rest("headings").unionByName(self._headings(new)), touched)
        self._replace(state, "ledger", rest("ledger").unionByName(_ledger(new)), touched)
        vectors = rest("vectors")
        if embedder:
            vectors = vectors.unionByName(self._vectors(pieces, embedder))
        self._replace(state, "vectors", vectors, touched)
        self._replace(state, "entries", merged, touched)
        self._index(state, touched)
        self._commit(state)
        return refused

    def ingest_stream(self, folder: str, schema: str, checkpoint: str, now: Callable[[], str], embedder: Embedder | None = None, replace: bool = False, name: str = "landing") -> StreamingQuery:
        """Ingest the Parquet files that land in ``folder``, once each, with all that ``ingest`` does.

        Each micro-batch is one change of the library that also remembers the batch's number, so a
        batch that Spark runs again after a failure does nothing. ``name`` tells streams apart.
        """
        rows = self.spark.readStream.schema(schema).parquet(folder)

        def one(batch: DataFrame, number: int) -> None:
            self.ingest(batch, now(), embedder, replace, (name, number))

        return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _headings(self, entries: DataFrame) -> DataFrame:
        """The headings of entries with ``ORIGIN`` columns: bookmarks at the start of their page, and lines that look like headings."""
        rows = entries.select(F.concat_ws("\0", *KEYS).alias("_entry"), "text", "pages", "outline").withColumn("_pages", F.coalesce(F.size("pages"), F.lit(0)))
        starts = rows.where(F.size("outline") > 0).select("_entry", F.posexplode("pages").alias("_no", "_x")).select("_entry", (F.col("_no") + 1).cast("bigint").alias("page"), "_x.start")
        marks = rows.select("_entry", F.posexplode("outline").alias("outline_no", "_x")).select("_entry", "outline_no", "_x.level", F.col("_x.title").alias("heading_text"), "_x.page")
        return self._numbered(a.merge_outline(a.headings(rows, "_entry", pages="_pages"), marks, starts, "_entry"))

    def _numbered(self, headings: DataFrame) -> DataFrame:
        number = F.row_number().over(W.partitionBy("_entry").orderBy("start")).cast("bigint")
        key = F.split("_entry", "\0")
        return headings.select(key[0].alias("workspace"), key[1].alias("entry_id"), number.alias("heading_no"), "start", "level", "heading_text")

    def _vectors(self, chunks: DataFrame, embedder: Embedder) -> DataFrame:
        key = F.concat_ws("\u0000", "workspace", "entry_id", F.col("chunk_no").cast("string"), F.col("start").cast("string"))
        found = embed_column(s.windows(chunks.select(key.alias("_key"), F.col("chunk_text").alias("text")), "_key"), embedder)
        part = F.split("_key", "\u0000")
        return found.select(part[0].alias("workspace"), part[1].alias("entry_id"), part[2].cast("bigint").alias("chunk_no"), (part[3].cast("bigint") + F.col("win_start")).alias("win_start"), (part[3].cast("bigint") + F.col("win_end")).alias("win_end"), "embedding", F.lit(None).cast("int").alias("cell"))

    def embed(self, embedder: Embedder) -> int:
        """Vectors for the entries that have none; returns how many entries."""
        keys = ["workspace", "entry_id"]
        state = self.state()
        vectors = self.table("vectors", state)
        missing = materialise(self.table("entries", state).select(*keys).join(vectors.select(*keys).distinct(), keys, "left_anti"), "missing")
        touched = sorted(r.workspace for r in missing.select("workspace").distinct().collect())
        if touched:
            more = self._vectors(self.table("chunks", state).join(missing, keys, "left_semi"), embedder)
            self._replace(state, "vectors", vectors.where(F.col("workspace").isin(touched)).unionByName(more), touched)
            self._commit(state)
        return missing.count()

    def remove(self, workspace: str, entry_id: str, confirm: bool = False) -> bool:
        """Drop an entry from every table; False if it isn't there."""
        if not confirm:
            raise ValueError("confirm_needed")
        hit = (F.col("workspace") == workspace) & (F.col("entry_id") == entry_id)
        state = self.state()
        if self.table("entries", state).where(hit).isEmpty():
            return False
        for name in ("entries", *PARTS):
            self._replace(state, name, self.table(name, state).where((F.col("workspace") == workspace) & ~hit), [workspace])
        self._index(state, [workspace])
        self._commit(state)
        return True

    def reindex(self, workspace: str) -> None:
        """Find the headings of a workspace anew from its texts and their numbers of pages; bookmarks aren't kept, so these go."""
        state = self.state()
        mine = F.col("workspace") == workspace
        key = F.concat_ws("\0", *KEYS).alias("_entry")
        pages = self.table("ledger", state).where(mine & (F.col("kind") == "page")).groupBy(key).agg(F.count("*").alias("_pages"))
        rows = self.table("entries", state).where(mine).select(key, "text").join(pages, "_entry", "left")
        self._replace(state, "headings", self._numbered(a.headings(rows, "_entry", pages="_pages")), [workspace])
        self._commit(state)

    def vacuum(self, workspace: str) -> None:
        """Rewrite a workspace's files, few and sorted, with a new keyword index and its vectors in cells, and delete what no version of the last two names."""
        state = self.state()
        for name in ("entries", "chunks", "headings", "ledger"):
            self._replace(state, name, self.table(name, state).where(F.col("workspace") == workspace), [workspace])
        self._cells(state, workspace)
        self._index(state, [workspace])
        self._commit(state)
        self.prune()

    # reading

    def library(self) -> Library:
        state = self.state()
        tables = {n: self.table(n, state) for n in SCHEMAS}
        return Library(*(tables[n] for n in ("entries", "chunks", "vectors", "headings", "ledger")), r.KeywordIndex(tables["postings"], tables["index_stats"]), tables["cells"])

    def search(self, text: str, embedder: Embedder | None = None, limit: int = 20, mode: str = "fused", workspaces: list[str] | None = None) -> tuple[DataFrame, Search]:
        """(hits by section with all their details, the planned search)."""
        known = self.names()
        for w in workspaces or []:
            if w.lstrip("@") not in known:
                raise ValueError(f"workspace_not_found: {w}")
        if not known:
            raise ValueError("no_workspaces")
        lib = self.library()
        vector = embedder.embed([text])[0].tolist() if embedder else None
        found = plan(lib, text, vector, limit, mode, [w.lstrip("@") for w in workspaces] if workspaces else None)
        # the hits, at most 100 short rows, are found once; what is joined to them is then a small plan
        found.hits = self.spark.createDataFrame(found.hits.collect(), found.hits.schema)
        return detailed(lib, found), found

    def envelope(self, search: Search) -> DataFrame:
        """One row about a search: candidates, truncation, misses, the terms matched as plain substrings."""
        row = r.envelope(search.candidates, search.keyword, self.table("vectors"), search.limit, search.allowed)
        return row.withColumn("like_terms", F.array(*[F.lit(x) for x in search.like_terms]).cast("array<string>"))

    def chunk_times(self, workspace: str) -> DataFrame:
        """(entry_id, chunk_no, start_ms, end_ms) of the chunks of a workspace's timed entries."""
        mine = F.col("workspace") == workspace
        times = self.table("ledger").where(mine & (F.col("kind") == "time"))
        following = F.lead("start").over(W.partitionBy("entry_id").orderBy("start"))
        totals = self.table("entries").where(mine).select("entry_id", "total_chars")
        spans = times.withColumn("_next", following).join(totals, "entry_id").select("entry_id", F.col("start").alias("char_start"), F.coalesce(F.col("_next") - 1, "total_chars").alias("char_end"), F.col("v1").alias("start_ms"), F.col("v2").alias("end_ms"))
        return a.chunk_times(self.table("chunks").where(mine).join(times.select("entry_id").distinct(), "entry_id", "left_semi"), spans, "entry_id")

    def section(self, ref: str, most: int = read.READ_CHARS) -> DataFrame:
        """What a section reference names, around its place: a section, the front, or a sub-section (``#u``)."""
        p = self.spark.createDataFrame([(ref,)], "ref string").select(read.parse_ref(F.col("ref")).alias("p")).where("p is not null").select("p.*")
        one = p.first()  # the reference itself
        own = F.col("entry_id") == (one.entry_id if one else "")
        entries = self.table("entries").where(own).dropDuplicates(["entry_id"])
        heads = self.table("headings").where(own).dropDuplicates(["entry_id", "heading_no"])
        number = F.coalesce(F.when(F.col("kind") == "u", -F.col("number")).otherwise(F.col("number")), F.lit(0).cast("bigint"))
        spans = read.anchored(heads, entries).join(p.withColumn("section_no", number), ["entry_id", "section_no"])
        shown = spans.select("entry_id", "section_no", "start", "stop", "at", F.col("title").alias("heading_text"), F.col("level").alias("heading_level"))
        return read.read_spans(shown, entries, most)

    def entry(self, entry_id: str, chunk_no: int | None = None, most: int = read.READ_CHARS) -> DataFrame:
        """An entry's text, or one of its chunks, capped."""
        if chunk_no is None:
            return self.table("entries").where(F.col("entry_id") == entry_id).select("workspace", "entry_id", "title", t.capped(F.col("text"), most).alias("content"), "total_chars")
        rows = self.table("chunks").where((F.col("entry_id") == entry_id) & (F.col("chunk_no") == chunk_no))
        return rows.select("workspace", "entry_id", "title", t.capped(F.col("chunk_text"), most).alias("content"), F.length("chunk_text").cast("bigint").alias("total_chars"))

    def stats(self) -> DataFrame:
        lib = self.library()
        return read.library_stats(lib.entries, lib.chunks, lib.vectors)

    def problems(self) -> DataFrame:
        """(check, problems) of the integrity checks, over all workspaces."""
        key = F.concat_ws("\u0000", "workspace", "entry_id")
        state = self.state()
        entries, chunks, heads, ledger, vectors = (self.table(n, state).withColumn("entry_id", key) for n in ("entries", "chunks", "headings", "ledger", "vectors"))
        known = entries.select("entry_id")
        orphans = lambda df: df.select("entry_id").distinct().join(known, "entry_id", "left_anti")
        return verify.summary({
            "chunk_count": verify.chunk_counts(entries, chunks), "chunk_text": verify.text_mismatch(entries, chunks), "coverage": verify.coverage(entries, chunks), "heading_range": verify.headings_outside(entries, heads),
            "chunk_index": verify.index_mismatch(entries, chunks, ("entry_id",)), "ledger_offset": verify.ledger_invalid(ledger), "ledger_orphan": orphans(ledger), "vector_orphan": orphans(vectors),
        })
