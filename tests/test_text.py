"""Scalar functions, segmentation, the query parser: expected values and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.embed import HashEmbedder, embed_column
from tessera.operators import query as q
from tessera.operators import segment as s
from tessera.sources import subtitles


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_timestamps(spark):
    assert one(spark, ["00:01:02,345", "1:02.3", " 01:00:00.05 ", "1:2", "x", None], t.timestamp_ms) == [62345, 62300, 3600050, None, None, None]
    assert one(spark, [0, 62345, 3_599_600], t.clock, "long") == ["00:00:00", "00:01:02", "01:00:00"]
    assert one(spark, ["90", "1:30", "1:01:01", "90.4", "", "a:b"], t.play_at) == [90, 90, 3661, 90, None, None]
    assert one(spark, [5, 61, 3661], t.play_label, "long") == ["0:05", "1:01", "1:01:01"]


def test_content_types(spark):
    names = ["https://youtu.be/x", "http://b23.tv/a", "https://a.b/c.pdf", "/d/e.PDF", "f.md", "g.xlsx", "h.mkv", "i", "", None]
    assert one(spark, names, t.content_type) == ["youtube", "bilibili", "web", "pdf", "text", "excel", "video", "unknown", "unknown", "unknown"]
    assert one(spark, ["https://youtu.be/abcdefghijk", "none"], t.video_id) == ["abcdefghijk", None]
    assert one(spark, ["https://b.c/BV1234567890?p=1", ""], t.bvid) == ["BV1234567890", None]


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHello\nworld\n\n2\nno time\n\n3\n00:00:03,000 --> 00:00:04,000\n\n\n4\n00:00:05,000 --> 00:00:06,000\nlast"
    assert [tuple(x) for x in one(spark, [srt], subtitles.parse_srt)[0]] == [(1000, 2500, "Hello world"), (5000, 6000, "last")]
    vtt = "WEBVTT\nKind: captions\n\nNOTE x\n\n00:01.500 --> 00:02.000 align:start\n<v A>Hi</v> there\n\nSTYLE\n::cue {}\n"
    assert [tuple(x) for x in one(spark, [vtt], subtitles.parse_vtt)[0]] == [(1500, 2000, "Hi there")]
    assert one(spark, [srt], t.clean_subtitle) == ["Hello\nworld\nno time\nlast"]
    assert [tuple(x) for x in one(spark, ['[{"from":1.5,"to":2,"content":"a"},{"from":3,"content":""}]'], subtitles.parse_json_subtitle)[0]] == [(1500, 2000, "a")]


def test_page_noise_and_html(spark):
    page = "keep\nfile:///D|/x/item_14.html (1 of 3)2005-4-26 10:00:00\n2005-4-26 10:00:00\nfile:///short\nfile:///引用 is text\nend"
    assert one(spark, [page], t.drop_page_noise) == ["keep\nfile:///引用 is text\nend"]
    html = "<h1 class='a'>One <b>bold</b><i>x</i></h1><p>a  b\tc</p>\n<H2>Two\n</H2><h3>open"
    assert one(spark, [html], t.html_to_text) == ["# One boldx\na b c\n## Two\nopen"]


def test_titles_caps_snippets(spark):
    assert one(spark, ["\n ## Head \nx", "   ", "y" * 100], lambda c: t.title_hint(F.lit(None).cast("string"), c, F.lit("key"))) == ["Head", "key", "y" * 80]
    texts = ["ab\ncd\nef", "abcdefgh", "a\nbcdefgh", "abc", ""]

    def cap(x, n):
        if len(x) <= n:
            return x
        at = x.rfind("\n", 0, n)
        return x[: at if at >= n // 2 else n]

    assert one(spark, texts, lambda c: t.capped(c, 6)) == [cap(x, 6) for x in texts]
    assert one(spark, texts, lambda c: t.capped(c, 0)) == texts
    assert one(spark, ["x" * 50 + "Term" + "y" * 50, "none"], lambda c: t.snippet(c, ["term"])) == ["…" + "x" * 32 + "『Term』" + "y" * 28 + "…", "none"]
    assert one(spark, ["a b/é+"], t.url_quote) == ["a%20b%2F%C3%A9%2B"]


GOOD = "0123456789abcdef"


@pytest.mark.parametrize("uri,expected", [
    (f"lib://goto?ws=a&entry={GOOD}", ("goto", "a", GOOD, None)), (f"lib://goto?ws=知-1&entry={GOOD.upper()}&at=1.6", ("goto", "知-1", GOOD, 2)), (f"lib://play?ws=a&entry={GOOD}&at=86400", ("play", "a", GOOD, 86400)),
    (f"lib://play?ws=a&entry={GOOD}", None), (f"lib://goto?ws=a&entry={GOOD}&x=1", None), (f"lib://goto?ws=a/b&entry={GOOD}", None), (f"lib://goto?ws=&entry={GOOD}", None), ("lib://goto?ws=a&entry=123", None),
    (f"lib://goto?entry={GOOD}", None), ("lib://goto?ws=a", None), (f"other://goto?ws=a&entry={GOOD}", None), (f"lib://open?ws=a&entry={GOOD}", None), (f"lib://goto?ws=a&entry={GOOD}&at=-1", None),
    (f"lib://goto?ws=a&entry={GOOD}&at=86401", None), (f"lib://goto?ws=a&entry={GOOD}&at=x", None), (f"lib://goto?ws=a&entry={GOOD}&at=", None), ("", None), (None, None), ("lib://goto", None),
])
def test_links(spark, uri, expected):
    found = one(spark, [uri], lambda c: t.link_fields(c, "lib"))[0]
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize("text,match,like,phrases", [
    ("hello world", '"hello" OR "world"', [], ["hello", "world"]), ('"hello world"', '"hello world"', [], ["hello world"]), ("hello AND world", '"hello" AND "world"', [], ["hello", "world"]),
    ("hello and world", '"hello" AND "world"', [], ["hello", "world"]), ("ab", None, ["ab"], []), ("hello ab", '"hello"', ["ab"], ["hello"]), ("hel* x", '"hel"*', ["x"], ["hel"]),
    ("title:abc hello", 'title:"abc" OR "hello"', [], ["hello"]), ("chunk_text:abc", 'chunk_text:"abc"', [], ["abc"]), ("publish_date>=2020 hello", '"hello"', [], ["hello"]),
    ("NEAR(abc def, 5) hello", 'NEAR(abc def, 5) "hello"', [], ["hello"]), ("Hello hello", '"Hello" OR "hello"', [], ["Hello"]), ('"open', '"open"', [], ["open"]), ("", None, [], []), ("don't stop", '"don\'t" OR "stop"', [], ["don't", "stop"]),
])
def test_query_expressions(text, match, like, phrases):
    found = q.parse(text)
    assert (found.match, found.like_terms, found.phrases) == (match, like, phrases)


def test_query_filters():
    found = q.parse("title:abc author:xy publish_date>=2020 created_at<2021-01 topic", as_filters=True)
    assert found.filters == [("title", "abc"), ("author", "xy")] and found.ranges == [("publish_date", ">=", "2020"), ("created_at", "<", "2021-01")] and found.match == '"topic"'


@pytest.mark.parametrize("text", ["AND abc", "abc AND", "abc OR OR def", "NOT abc"])
def test_bad_queries(text):
    with pytest.raises(q.QueryError) as e:
        q.condition(q.parse(text), F.col)
    assert e.value.code == "bad_query"


def texts():
    rnd = random.Random(3)
    parts = ["word ", "句子。", "end. ", "\n", "\n \n", "x" * 60, "?", "  "]
    return ["", "   ", "short", "a" * 5000, *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 200))) for _ in range(60))]


@pytest.mark.parametrize("text", texts())
def test_segments_hold(text):
    spans = s.window_spans(text, 80, 10)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b and b < d
    covered = [any(a <= i < b for a, b in spans) for i in range(len(text))]
    assert all(hit or c.isspace() for hit, c in zip(covered, text, strict=True))
    assert all(b - a <= 80 and text[a:b].strip() for a, b in spans)
    chunks = s.chunk_spans(text, 100, 12)
    assert all(any(a <= i < b for a, b in chunks) or c.isspace() for i, c in enumerate(text))
    assert all(c == max(0, b - 12) for (_, b), (c, _) in zip(chunks, chunks[1:], strict=False))
    paras = s.paragraphs(text)
    assert all(text[a:b] == text[a:b].strip() != "" and not s.BLANK.search(text[a:b]) for a, b in paras)
    assert "".join(text.split()) == "".join("".join(text[a:b].split()) for a, b in paras)
    slices = s.slice_texts(text, 100, 12)
    assert slices == s.slice_texts(text, 100, 12)


def test_windows_end_at_sentences():
    text = "a" * 50 + "。" + "b" * 100
    assert s.window_spans(text, 80, 10)[:2] == [(0, 51), (41, 121)]
    assert s.window_spans("a" * 30 + "。" + "b" * 100, 80, 10)[0] == (0, 80)  # too early to cut there


def test_hash_embedder(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "body string")
    found = [list(r.embedding) for r in embed_column(rows, HashEmbedder(8)).collect()]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in found) and found[0] != found[1]
    assert found == [list(r.embedding) for r in embed_column(rows, HashEmbedder(8)).collect()]
