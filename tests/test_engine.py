"""Search, anchors, sources, ingest, streaming; every registered query against its SQL."""

import io
import math
import sqlite3
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import anchors as a
from tessera.operators import ingest as i
from tessera.operators import query as q
from tessera.operators import read
from tessera.operators import retrieve as r
from tessera.plans import catalogue
from tessera.plans.search import Library, plan, shaped
from tessera.sources import files
from tessera.streaming import landing

CHUNK = "workspace string, entry_id string, chunk_no long, start long, chunk_text string, title string, author string, publisher string, publish_date string"
TEXTS = ["alpha beta gamma", "alpha alpha delta", "beta café note", "gamma alphabet soup alpha beta", "nothing here", "ALPHA Beta", "abcabcabc abc", "quick brown fox jumps"]


def chunk_rows(spark):
    return spark.createDataFrame([("w", f"e{n}", 0, 0, x, f"title {n}", "ann", None, f"20{n:02d}-05") for n, x in enumerate(TEXTS)], CHUNK)


@pytest.mark.parametrize("text", ["alpha", "alpha beta", "abc", "gamma alpha soup", "title", "alpha AND beta", "alpha NOT beta", "gamma OR alpha AND beta NOT soup", '"alpha beta"', "title:title", "cafe", "NEAR(alpha soup, 12)", "NEAR(alpha soup, 9)"])
def test_bm25_as_sqlite(spark, text):
    """The same rows and scores as the full-text index of the standard library."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(chunk_text, title, author, publisher, publish_date, tokenize='trigram')")
    con.executemany("INSERT INTO f(rowid, chunk_text, title, author, publisher, publish_date) VALUES (?,?,?,?,?,?)", [(n + 1, x, f"title {n}", "ann", None, f"20{n:02d}-05") for n, x in enumerate(TEXTS)])
    topic = q.parse(text)
    expected = {f"e{row - 1}": score for row, score in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", [topic.match])}
    found = {x.entry_id: x.bm25 for x in r.bm25(chunk_rows(spark), topic, q.TEXT_COLUMNS).where(q.condition(topic, F.col)).collect()}
    assert found.keys() == expected.keys()
    if "NEAR" not in text and "OR" not in text:  # that index leaves out terms of branches which don't hold for a row
        assert all(math.isclose(found[k], expected[k], rel_tol=1e-9) for k in found)


def test_keyword_order_and_short_terms(spark):
    hits = r.keyword_route(chunk_rows(spark), q.parse("alpha beta")).orderBy("route_rank").collect()
    assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    assert {h.entry_id for h in hits if h.score == 1.0} == {"e0", "e3", "e5"}
    both = r.keyword_route(chunk_rows(spark), q.parse("alpha no")).orderBy("route_rank").collect()
    assert {h.entry_id for h in both if h.match_mode != "fts"} == {"e2", "e4"}


def library(spark):
    chunks = chunk_rows(spark)
    entries = chunks.select("workspace", "entry_id", "title", "author", "publisher", "publish_date", F.col("publish_date").alias("created_at"), F.col("chunk_text").alias("text"), F.length("chunk_text").alias("total_chars"))
    vectors = spark.createDataFrame([("w", f"e{n}", 0, 0, [math.cos(n), math.sin(n)]) for n in range(len(TEXTS))], "workspace string, entry_id string, chunk_no long, win_start long, embedding array<float>")
    headings = spark.createDataFrame([("w", "e0", 1, 6, 1, "beta gamma"), ("w", "e3", 1, 0, 1, "gamma alphabet")], "workspace string, entry_id string, heading_no long, start long, level long, heading_text string")
    return Library(entries, chunks, vectors, headings)


def test_search_modes_and_filters(spark):
    lib = library(spark)
    found = plan(lib, "alpha beta", [1.0, 0.0])
    rows = found.candidates.collect()
    assert all(abs(x.score - x.fts_score - x.vector_score - x.heading_score) < 3e-4 for x in rows)
    assert {"fused", "heading"} <= {x.score_source for x in rows}
    assert {x.entry_id for x in plan(lib, "publish_date>=2003 publish_date<2005 alpha", [1.0, 0.0]).candidates.collect()} <= {"e3", "e4"}
    assert plan(lib, "title:title").mode == "fts"
    for text, code in (("", "empty_query"), ("publish_date>=2000", "range_only")):
        with pytest.raises(q.QueryError) as e:
            plan(lib, text)
        assert e.value.code == code
    with pytest.raises(q.QueryError):
        plan(lib, "alpha", None, mode="vector")
    capped = plan(lib, "author:ann alpha", [1.0, 0.0], vector_cap=2)
    assert (capped.error, capped.vector_available) == ("vector_candidates_exceeded", False)
    assert plan(lib, "author:ann zzz", [1.0, 0.0], workspaces=["none"]).candidates.count() == 0
    merged = shaped(lib, plan(lib, "gamma", [1.0, 0.0])).collect()
    assert any("+" in x.score_source for x in merged) and all("#" in x.section_ref for x in merged)
    assert [x.section_rank for x in sorted(merged, key=lambda x: x.section_rank)] == sorted(x.section_rank for x in merged)


def test_subsections(spark):
    totals = spark.createDataFrame([("a", 165_000), ("b", 165_000), ("c", 20_000), ("d", 40_000)], "entry_id string, total_chars long")
    heads = spark.createDataFrame([("b", 0, 1, "H")], "entry_id string, start long, level long, heading_text string")
    found = a.subsections(heads, totals).collect()
    count = {k: sum(x.entry_id == k for x in found) for k in "abcd"}
    assert count == {"a": 7, "b": 8, "c": 0, "d": 0}
    assert min(x.title for x in found if x.entry_id == "b") == "H·续1"


def test_headings(spark):
    text = "# Top #x\nbody\n第一章 开端\n第2节 x\n条款 3\nChapter 4\nsection 5 ends.\n1.2.3 deep\nRun head\n## Rep\n## rep\n##  REP"
    rows = a.headings(spark.createDataFrame([("e", text)], "entry_id string, text string")).orderBy("start").collect()
    assert [(x.level, x.heading_text) for x in rows] == [(1, "Top #x"), (1, "第一章 开端"), (2, "第2节 x"), (2, "条款 3"), (1, "Chapter 4"), (3, "1.2.3 deep")]
    assert all(text[x.start :].lstrip("# ").startswith(x.heading_text) for x in rows)


def test_section_reads(spark):
    refs = spark.createDataFrame([("e#s3@120",), ("e#u2",), ("e#front@5",), ("e#front",), ("e",), ("e#s",)], "ref string").select(read.parse_ref(F.col("ref")).alias("p")).collect()
    assert [tuple(x.p) if x.p else None for x in refs] == [("e", "s", 3, 120), ("e", "u", 2, None), ("e", "front", None, 5), ("e", "front", None, None), None, None]
    text = "".join(f"line {n}\n" for n in range(500))
    entries = spark.createDataFrame([("e", text)], "entry_id string, text string")
    spans = spark.createDataFrame([("e", 100, 3000, 1500), ("e", 100, 3000, 2990), ("e", 100, 3000, None), ("e", 0, 50, 20)], "entry_id string, start long, stop long, at long")
    for row in read.read_spans(spans, entries, 400).collect():
        assert row.content in text[row.start : row.stop] and len(row.content) <= 400
        assert row.read_chars + row.remaining_chars == row.stop - row.start and row.truncated == (row.remaining_chars > 0)
        if row["at"] == 1500:
            assert abs(text.index(row.content) + 200 - 1500) < 220


def test_upsert_twice_is_once(spark):
    new = spark.createDataFrame([("a", "2"), ("b", "2")], "entry_id string, created_at string")
    old = spark.createDataFrame([("a", "1"), ("c", "1")], "entry_id string, created_at string")
    once = i.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", "1"), ("b", "2"), ("c", "1")] == sorted(map(tuple, i.upsert(once, new).collect()))


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    docx = zipped({"word/document.xml": f'<w:document {w}><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:p/></w:document>'})
    xlsx = zipped({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>{"9" * 600}</v></c></row><row><c r="A2"/></row><row><c r="A3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    })
    pptx = zipped({
        "ppt/presentation.xml": '<p:x xmlns:p="p" xmlns:r="http://r"><p:sldId id="256" r:id="r1"/></p:x>', "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="r1" Target="slides/slide1.xml"/></R>',
        "ppt/slides/slide1.xml": '<p:s xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>Title</a:t></a:p></p:sp><p:sp><a:p><a:t>point</a:t></a:p></p:sp><p:graphicFrame><a:tr><a:tc><a:t>1</a:t></a:tc><a:tc><a:t>2</a:t></a:tc></a:tr></p:graphicFrame></p:s>',
    })
    epub = zipped({
        "META-INF/container.xml": '<c><rootfile full-path="O/c.opf"/></c>',
        "O/c.opf": '<p><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="t" href="t.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/></p>',
        "O/t.ncx": '<n><navPoint><navLabel><text>Second</text></navLabel><content src="b.xhtml#x"/></navPoint></n>', "O/nav.xhtml": "<p>nav</p>", "O/a.xhtml": "<h1>One</h1><p>text</p>", "O/b.xhtml": "<p>more</p>",
    })
    made = {"a.docx": docx, "b.xlsx": xlsx, "c.pptx": pptx, "d.epub": epub, "e.txt": "中文".encode("gbk"), "f.md": "é".encode(), "g.docx": b"broken", "h.bin": b"skip"}
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "z.txt").write_text("below")
    found = {x.path.rsplit("/", 1)[1]: x for x in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert sorted(found) == ["a.docx", "b.xlsx", "c.pptx", "d.epub", "e.txt", "f.md", "g.docx"]
    assert found["a.docx"].text == "## Head\nsome text"
    assert found["b.xlsx"].text == "## 工作表: S1\nshared |  | " + "9" * 500 + "\nin"
    assert found["c.pptx"].text == "## 幻灯片 1\n# Title\npoint\n1 | 2"
    assert found["d.epub"].text == "# One\ntext\n\nmore" and [tuple(c) for c in found["d.epub"].chapters] == [(0, 1, ""), (12, 2, "Second")]
    assert (found["e.txt"].text, found["f.md"].text) == ("中文", "é")
    assert found["g.docx"].text is None and "BadZipFile" in found["g.docx"].error


def test_streams(spark, small, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), (" ", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")], "text string, arrived_at string")
    rows.select("text", F.col("arrived_at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    landing.ingest_stream(spark, str(tmp_path / "in"), "text string, arrived_at timestamp", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(x.text for x in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = landing.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), watermark="1 hour")
    stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, landing.tumbling(events).collect()))


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(df):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        return f"{x:.6g}" if isinstance(x, float) else str(int(x)) if not isinstance(x, str) and hasattr(x, "__int__") and not hasattr(x, "year") else str(x)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def same(spark, small, duck, query, sql):
    found, expected = query(spark, small).toPandas(), duck.sql(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    number = {c for c in found.columns if found[c].dtype.kind in "if" and expected[c].dtype.kind in "if"}
    for c in number:
        found[c], expected[c] = found[c].astype(float), expected[c].astype(float)
    assert plain(found) == plain(expected)
    return len(found)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_as_sql(spark, small, duck, name):
    if name in catalogue.ORACLE_SQL:
        same(spark, small, duck, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    else:
        assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_subsection_spans(spark):
    entries = spark.createDataFrame([("a", 50_000), ("b", 90_000)], "entry_id string, total_chars long")
    heads = spark.createDataFrame([("b", 1, 30_000, 1, "x"), ("b", 2, 80_000, 1, "y")], "entry_id string, heading_no long, start long, level long, heading_text string")
    found = sorted((r.entry_id, r.section_no, r.start, r.stop) for r in read.subsection_spans(heads, entries).collect())
    assert found == [("a", 1, 20_000, 50_000), ("b", 1, 20_000, 30_000), ("b", 2, 50_000, 70_000), ("b", 3, 70_000, 80_000)]
