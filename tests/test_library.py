"""A library's life: ingest, update, supersede, search, read, maintain, remove."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.embed import HashEmbedder
from tessera.plans.library import Store

LONG = "# One\n" + "alpha beta gamma sentence. " * 2000 + "\n\n# Two\n" + "delta topic words here. " * 2000
SCHEMA = "workspace string, text string, title string, author string, source_ref string"


def test_life_of_a_library(spark, tmp_path):
    store, embedder = Store(spark, f"file://{tmp_path}/lib"), HashEmbedder(8)
    with pytest.raises(ValueError):
        store.search("alpha")
    store.create("notes", "2024-01-01")
    with pytest.raises(ValueError):
        store.create("notes", "2024-01-01")
    with pytest.raises(ValueError):
        store.create("bad name", "2024-01-01")
    rows = [("notes", LONG, None, "ann", "f1"), ("notes", "short alpha text", "T", None, "f2"), ("books", LONG, "Book", None, None), ("books", " \n", None, None, None), ("a/b", "text", None, None, None)]
    refused = store.ingest(spark.createDataFrame(rows, SCHEMA), "2024-01-02", embedder)
    assert sorted(r.reason for r in refused.collect()) == ["bad_workspace", "empty_text"]
    assert store.names() == ["books", "notes"]
    entries = {(r.workspace, r.title): r for r in store.table("entries").collect()}
    assert set(entries) == {("notes", "One"), ("notes", "T"), ("books", "Book")} and entries["notes", "One"].chunk_count == 4
    assert {r.check: r.problems for r in store.problems().collect()} == dict.fromkeys(("chunk_count", "chunk_text", "coverage", "heading_range", "chunk_index", "ledger_offset", "ledger_orphan", "vector_orphan"), 0)
    counts = {r.workspace: (r.entries, r.chunks) for r in store.stats().collect()}
    assert counts == {"notes": (2, 5), "books": (1, 4)}

    # the same text again: one entry, created_at stays; missing metadata from the same source
    store.ingest(spark.createDataFrame([("notes", LONG, None, None, "f1"), ("notes", "new version alpha", None, None, "f1")], SCHEMA), "2024-02-01")
    found = {r.entry_id: r for r in store.table("entries").where("workspace = 'notes'").collect()}
    assert len(found) == 3 and found[entries["notes", "One"].entry_id].created_at == "2024-01-02" and found[entries["notes", "One"].entry_id].updated_at == "2024-02-01"
    assert [r.author for r in found.values() if r.text == "new version alpha"] == ["ann"]
    assert store.table("entries").where("workspace = 'books'").count() == 1
    assert store.embed(embedder) == 2 and store.embed(embedder) == 0

    hits, search = store.search("delta topic", embedder, workspaces=["@notes"])
    top = hits.orderBy("section_rank").first()
    assert top.workspace == "notes" and "#" in top.section_ref and search.vector_available
    about = store.envelope(search).first()
    assert about.vectors_rows == store.table("vectors").count() and not about.keyword_miss and not about.truncated_by_limit and about.like_terms == []
    part = store.section(top.section_ref, 500).first()
    assert part.content in LONG + "short alpha text" + "new version alpha" and len(part.content) <= 500
    assert store.section("no ref").count() == 0
    assert store.entry(entries["notes", "One"].entry_id, 1, 100).where("workspace = 'notes'").first().content.startswith(LONG[:1]) is False
    with pytest.raises(ValueError):
        store.search("alpha", workspaces=["none"])

    # a new version replaces what its source had
    store.ingest(spark.createDataFrame([("notes", "latest alpha", None, None, "f1")], SCHEMA), "2024-03-01", replace=True)
    left = sorted(r.text for r in store.table("entries").where("workspace = 'notes'").collect())
    assert left == ["latest alpha", "short alpha text"]
    assert store.table("chunks").where("workspace = 'notes'").count() == 2 == store.table("chunks").where("workspace = 'notes'").select("entry_id").distinct().count()
    before = store.table("headings").where("workspace = 'books'").count()
    store.reindex("books")
    store.vacuum("books")
    assert store.table("headings").where("workspace = 'books'").count() == before == 2
    with pytest.raises(ValueError):
        store.remove("notes", "x")
    assert not store.remove("notes", "x", confirm=True)
    gone = store.table("entries").where(F.col("text") == "latest alpha").first().entry_id
    assert store.remove("notes", gone, confirm=True)
    assert all(store.table(n).where(F.col("entry_id") == gone).count() == 0 for n in ("entries", "chunks", "vectors", "headings"))
    store.rename("books", "shelf")
    assert store.names() == ["notes", "shelf"]
    store.delete("shelf", confirm=True)
    assert store.names() == ["notes"] and store.table("entries").count() == 1


def test_command_line(spark, tmp_path, capsys):
    import json

    from tessera.__main__ import _parser, main, run

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Head\nalpha topic words")
    (tmp_path / "in" / "b.docx").write_bytes(b"broken")
    root = ["--root", f"file://{tmp_path}/lib"]
    store = Store(spark, root[1])
    done = run(_parser().parse_args([*root, "ingest", "notes", str(tmp_path / "in")]), store)
    assert done["refused"] == [] and len(done["unreadable"]) == 1
    hits = run(_parser().parse_args([*root, "search", "alpha topic"]), store)["hits"]
    assert hits[0]["title"] == "Head" and run(_parser().parse_args([*root, "section", hits[0]["section_ref"]]), store)["found"][0]["content"].startswith("# Head")
    assert main([*root, "--lang", "zh", "search", "alpha", "--workspace", "none"]) == 1
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["code"] == "workspace_not_found" and said["error"] == said["error_i18n"]["zh"]
    assert main([*root, "search", "publish_date>=2020"]) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["code"] == "range_only"
    with pytest.raises(SystemExit) as e:
        main([*root, "nothing"])
    assert e.value.code == 2


def test_origins_and_details(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/lib")
    store.create("lib", "2024-01-01")
    paged = "first page words\nmore\nsecond page kiwi words\n" + "filler line\n" * 20
    second = paged.index("second")
    long = "# Head\n" + "plain text here. " * 3000 + "papaya at the end"
    srt = "1\n00:00:01,000 --> 00:00:02,500\n hello there \n\n2\n00:01:05,000 --> 00:01:06,000\nmango speech\n"
    rows = [
        {"workspace": "lib", "text": paged, "source_ref": "a.pdf", "pages": [{"start": 0, "page": 1}, {"start": second, "page": 2}]},
        {"workspace": "lib", "text": "intro\nchapter with quince", "source_ref": "b.epub", "chapters": [{"start": 0, "chapter": 1, "title": "Intro"}, {"start": 6, "chapter": 2, "title": "Two"}]},
        {"workspace": "lib", "srt_text": srt, "source_ref": "c.srt"},
        {"workspace": "lib", "segments": [{"start_ms": 0, "end_ms": 900, "text": " "}, {"start_ms": 900, "end_ms": 1900, "text": "a durian talk"}], "text": "not used"},
        {"workspace": "lib", "segments": [], "text": None},
        {"workspace": "lib", "text": long, "source_ref": "d.md"},
        {"workspace": "copy", "text": long},
    ]
    schema = "workspace string, text string, source_ref string, srt_text string, pages array<struct<start:bigint,page:bigint>>, chapters array<struct<start:bigint,chapter:bigint,title:string>>, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
    refused = store.ingest(spark.createDataFrame(rows, schema), "2024-01-02")
    assert [r.reason for r in refused.collect()] == ["empty_text"]
    assert {r.text for r in store.table("entries").where("source_ref = 'c.srt' or source_ref is null and workspace = 'lib'").collect()} == {"hello there\nmango speech", "a durian talk"}
    assert sorted((r.kind, r.start, r.v1, r.v2, r.title) for r in store.table("ledger").where("kind <> 'time'").collect()) == [("chapter", 0, 1, None, "Intro"), ("chapter", 6, 2, None, "Two"), ("page", 0, 1, None, None), ("page", second, 2, None, None)]
    assert sorted((r.start, r.v1, r.v2) for r in store.table("ledger").where("kind = 'time'").collect()) == [(0, 900, 1900), (0, 1000, 2500), (12, 65000, 66000)]
    assert sorted((r.start_ms, r.end_ms) for r in store.chunk_times("lib").collect()) == [(900, 1900), (1000, 66000)]

    def hit(word, workspace="lib"):
        found = store.search(word, workspaces=[workspace])[0].collect()
        assert len(found) == 1
        return found[0]

    kiwi = hit("kiwi")
    assert tuple(kiwi.source_location)[:2] == ("pdf", 2) and kiwi.start_ms is None and "『kiwi』" in kiwi.snippet and kiwi.locator.label == "pdf 2" and kiwi.section_ref.endswith(f"#front@{paged.index('kiwi')}")
    assert kiwi.heading_text is None and kiwi.section_chars == len(paged)
    quince = hit("quince")
    assert (quince.source_location.kind, quince.source_location.n, quince.source_location.title) == ("epub", 2, "Two")
    mango = hit("mango")
    assert (mango.start_ms, mango.end_ms, mango.timestamp_precision, mango.locator.label) == (65000, 66000, "segment", "1:05") and mango.locator.link.endswith("&at=65")
    papaya = hit("papaya")
    assert (papaya.source_location.kind, papaya.source_location.n) == ("line", 2) and papaya.heading_text.startswith("Head") and "#u2@" in papaya.section_ref
    part = store.section(papaya.section_ref, 200).first()
    assert "papaya" in part.content and part.heading_text == papaya.heading_text and part.stop - part.start == papaya.section_chars == len(long) - 40000
    both = store.search("papaya")[0].collect()
    assert sorted(r.workspace for r in both) == ["copy", "lib"]

    # item by item: the new version replaces what the source had, the other stays beside it
    more = [("lib", "newer kiwi", "a.pdf", True), ("lib", "newer quince", "b.epub", None)]
    store.ingest(spark.createDataFrame(more, "workspace string, text string, source_ref string, replace boolean"), "2024-02-01")
    left = {(r.source_ref, r.n) for r in store.table("entries").where("workspace = 'lib'").groupBy("source_ref").agg(F.count("*").alias("n")).collect()}
    assert left >= {("a.pdf", 1), ("b.epub", 2), ("c.srt", 1)}
    assert store.table("ledger").where("kind = 'page'").count() == 0 and all(r.problems == 0 for r in store.problems().collect())
