"""Pages, bookmarks and footers from a PDF file to the headings and places of a library."""

import sys

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import drop_page_noise
from tessera.plans.library import Store
from tessera.sources import files

#: Stands for the optional library: a "PDF" here is its pages by form feeds and a list of bookmarks.
READER = '''
import json


class Page:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        if self.text == "broken":
            raise ValueError(self.text)
        return self.text


class Mark:
    def __init__(self, title, page):
        self.title, self.page = title, page


class PdfReader:
    def __init__(self, stream):
        body = json.loads(stream.read())
        self.pages, self.marks = [Page(p) for p in body["pages"]], body["outline"]

    @property
    def outline(self):
        if self.marks is None:
            raise ValueError("no outline")
        build = lambda nodes: [build(n) if isinstance(n[0], list) else Mark(*n) for n in nodes]
        return build(self.marks)

    def get_destination_page_number(self, mark):
        return mark.page
'''
FOOTER = "file:///D|/book/item_1.html (1 of 3)2005-4-26 10:11:12"


@pytest.fixture
def reader(tmp_path, monkeypatch):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "pypdf.py").write_text(READER)
    monkeypatch.syspath_prepend(str(tmp_path / "lib"))
    yield str(tmp_path / "lib")
    sys.modules.pop("pypdf", None)


def write(folder, name, pages, outline):
    import json

    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"pages": pages, "outline": outline}))


def test_pages_and_bookmarks_of_a_file(spark, tmp_path, reader):
    import pypdf  # noqa: F401  the stand-in

    found = files.pdf_text(b'{"pages": ["a", "broken", "b"], "outline": [["One", 0], [["Below", 2], ["Nowhere", null], [" ", 1]], ["Two", 2]]}')
    assert found == files.Extracted(None, ["a", "", "b"], [], [(1, "One", 1), (2, "Below", 3), (1, "Two", 3)])
    assert files.pdf_text(b'{"pages": ["a"], "outline": null}') == files.Extracted(None, ["a"])
    env = spark.sparkContext.environment  # the workers of this test find the stand-in
    before = env.get("PYTHONPATH", "")
    env["PYTHONPATH"] = f"{reader}:{before}"
    try:
        write(tmp_path / "in", "x.pdf", ["first page\n" + FOOTER, "second", "broken", "2005-4-26 1:02:03\nlast"], [["One", 0]])
        rows = files.extract(files.scan(spark, str(tmp_path / "in"))).collect()
    finally:
        env["PYTHONPATH"] = before
    assert [r.text for r in rows] == ["first page\nsecond\n\nlast"]
    assert [tuple(p) for p in rows[0].pages] == [(0, 1), (11, 2), (18, 3), (19, 4)] and [tuple(o) for o in rows[0].outline] == [(1, "One", 1)] and rows[0].error is None


def test_footers(spark):
    rows = spark.createDataFrame([(f"a\n{FOOTER}\nfile:///short\nfile:///正文\n2005-4-26 10:11:12\nb",), (None,)], "x string")
    assert [r.y for r in rows.select(drop_page_noise(F.col("x")).alias("y")).collect()] == ["a\nfile:///正文\nb", None]


def test_bookmarks_become_headings_of_their_page(spark, tmp_path):
    one = "第1页文本内容，讨论主题甲。" * 20
    text = one + "\n" + "第2页文本内容，讨论主题乙。" * 20
    schema = "workspace string, text string, pages array<struct<start:bigint,page:bigint>>, outline array<struct<level:bigint,title:string,page:bigint>>"
    pages = [(0, 1), (len(one) + 1, 2)]
    outline = [(1, "第一章 主题甲", 1), (1, "第二章 主题乙", 2), (2, "第一节", 2), (1, "beyond", 9)]
    store = Store(spark, f"file://{tmp_path}/lib")
    store.ingest(spark.createDataFrame([("a", text, pages, outline), ("b", text, None, outline), ("c", text, pages, None)], schema), "2024-01-01")
    heads = {(r.workspace, r.start, r.level, r.heading_text) for r in store.table("headings").collect()}
    assert heads == {("a", 0, 1, "第一章 主题甲"), ("a", len(one) + 1, 1, "第二章 主题乙")}  # the first bookmark of a page stands
    hits, _ = store.search("主题乙", mode="fts", workspaces=["a"])
    hit = hits.first()
    assert hit.heading_text == "第二章 主题乙" and hit.source_location.n == 2
    assert "讨论主题乙" in store.section(hit.section_ref).first().content


def test_running_headers_by_the_number_of_pages(spark, tmp_path):
    body = [f"# Book title\n# Part {n}\n" + "words " * 30 for n in range(10)]
    starts = [sum(len(b) + 1 for b in body[:n]) for n in range(10)]
    recurring = "# Twice\nx\n# Twice\ny\n# Twice\nz\n# Twice\n# Twice"
    rows = [("a", "\n".join(body), [(s, n + 1) for n, s in enumerate(starts)]), ("b", recurring, [(0, n) for n in range(1, 11)]), ("c", recurring, None)]
    store = Store(spark, f"file://{tmp_path}/lib")
    store.ingest(spark.createDataFrame(rows, "workspace string, text string, pages array<struct<start:bigint,page:bigint>>"), "2024-01-01")
    count = lambda: {w: store.table("headings").where(f"workspace = '{w}'").count() for w in "abc"}
    assert count() == {"a": 10, "b": 5, "c": 0}
    store.reindex("b")
    assert count() == {"a": 10, "b": 5, "c": 0}
