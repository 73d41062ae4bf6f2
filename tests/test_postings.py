"""The stored keyword index against the scan."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import postings
from tessera.operators import query as q
from tessera.operators import retrieve as r

CHUNK = "workspace string, entry_id string, chunk_no long, start long, chunk_text string, title string, author string, publisher string, publish_date string"
TEXTS = ["alpha beta gamma", "alpha alpha delta", "beta café note", "gamma alphabet soup alpha beta", "nothing here", "ALPHA Beta", "abcabcabc abc", "quick brown fox jumps", "", "x", "no", "aaaaaaa aaa", "ΣΑΣ İstanbul alpha" + " x" * 4000 + " alpha soup"]
QUERIES = ["alpha", "alpha beta", "abc", "aaa", "gamma alpha soup", "title", "alpha AND beta", "alpha NOT beta", "gamma OR alpha AND beta NOT soup", '"alpha beta"', "title:title", "cafe", "café", "NEAR(alpha soup, 12)", "NEAR(alpha soup, 9)", "NEAR(beta alpha gamma)", "alph*", "abcabc", "alpha no", "σας", "chunk_text:alpha author:ann", "zzz"]


def rows(spark):
    made = [("w" if n % 3 else "v", f"e{n}", n % 2, 10 * n, x, f"title {n}" if n % 4 else None, "ann", None, f"20{n:02d}-05") for n, x in enumerate(TEXTS)]
    return spark.createDataFrame(made, CHUNK).repartition(2)


@pytest.fixture(scope="module")
def both(spark):
    chunks = rows(spark).cache()
    return chunks, r.KeywordIndex(postings.build(chunks).cache(), postings.statistics(chunks).cache())


def test_index_answers_as_the_scan(both):
    chunks, index = both
    for text in QUERIES:
        topic = q.parse(text)
        found = sorted(map(tuple, r.keyword_route(chunks, topic, 20, index=index).collect()))
        assert found == sorted(map(tuple, r.keyword_route(chunks, topic, 20).collect())), text


def test_index_reads_its_own_grams(spark, both, tmp_path):
    chunks, index = both
    index.postings.write.partitionBy("workspace", "bucket").parquet(str(tmp_path / "p"))
    stored = r.KeywordIndex(spark.read.schema(postings.SCHEMA).parquet(str(tmp_path / "p")), index.statistics)
    found = r.indexed_matches(stored, q.parse("gamma soup"))
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [x for x in plan.split("\n\n") if "Scan parquet" in x.split("\n")[0]]
    assert scans and all("PartitionFilters: [" in x and "bucket" in x.split("PartitionFilters")[1] and "In(gram" in x for x in scans) and "chunk_text" not in plan
    assert {x.entry_id for x in found.collect()} == {"e0", "e3", "e12"}
    allowed = chunks.where("workspace = 'v'").select("entry_id")
    assert {x.entry_id for x in r.keyword_route(chunks, q.parse("alpha"), 20, allowed, stored).collect()} == {"e0", "e3", "e12"}


def test_empty_index(spark):
    none = rows(spark).limit(0)
    index = r.KeywordIndex(postings.build(none), postings.statistics(none))
    assert r.keyword_route(none, q.parse("alpha"), 20, index=index).count() == 0 and not postings.usable(q.parse("no")) and not postings.usable(q.parse('"of" alpha'))


def test_index_says_each_chunk_once(spark, both):
    chunks, index = both
    stored = index.postings
    said = stored.where(F.col("gram") == postings.DIRECTORY).select("workspace", F.explode("chunks").alias("c")).select("workspace", "c.entry_id", "c.chunk_no")
    assert sorted(map(tuple, said.collect())) == sorted(map(tuple, chunks.select(*postings.KEY).collect()))
    assert "entry_id" not in stored.schema["places"].dataType.simpleString()
    assert sorted(map(tuple, postings.stored_statistics(stored).collect())) == sorted(map(tuple, postings.statistics(chunks).collect()))


@pytest.mark.parametrize("alphabet", ["ab", "abc de\u00e9\U0001d11e", "".join(map(chr, range(0x3000, 0xD000)))])
def test_sorted_grams_brute_force(alphabet):
    text = "".join(alphabet[i * i * 7919 % 100_003 % len(alphabet)] for i in range(70_000))
    points = np.array([ord(c) for c in text], np.int64)
    at = np.array([i for i in range(len(points) - 2) if i % 7 < 5])
    places, heads = postings._sorted_grams(points, at)
    assert places.tolist() == sorted(at.tolist(), key=lambda i: (ord(text[i + 2]), ord(text[i + 1]), ord(text[i]), i))
    assert heads.tolist() == [n for n, i in enumerate(places) if n == 0 or text[i : i + 3] != text[places[n - 1] : places[n - 1] + 3]]


def test_blocks_of_any_size(spark, both, monkeypatch):
    chunks, index = both
    monkeypatch.setattr(postings, "BLOCK", 2)
    small = r.KeywordIndex(postings.build(chunks.coalesce(1)).cache(), index.statistics)
    monkeypatch.setattr(postings, "BLOCK_CHARS", 30)
    short = r.KeywordIndex(postings.build(chunks.coalesce(1)).cache(), index.statistics)
    for text in ("gamma alpha soup", "NEAR(alpha soup, 12)"):
        wanted = sorted(map(tuple, r.keyword_route(chunks, q.parse(text), 20).collect()))
        assert wanted and all(sorted(map(tuple, r.keyword_route(chunks, q.parse(text), 20, index=x).collect())) == wanted for x in (small, short))


def test_texts_do_not_pass_the_join_with_the_statistics(spark):
    made = [("w" if n % 2 else "v", f"e{n}", 0, 0, f"alpha {n}", None, None, None, f"{2000 + n}") for n in range(20)]
    chunks = spark.createDataFrame(made, CHUNK)
    topic = q.parse("publish_date>=2010 alpha")
    found = r.keyword_route(chunks, topic, 20, r.entry_filter(chunks, topic))
    joins = re.findall(r"\n(?:[ :]*)[+:]- Join Inner[^\n]*\n(?:[ :]*):- Project (\[[^\n]*\])", found._jdf.queryExecution().optimizedPlan().toString())
    assert joins and all(re.search(r"[ \[]chunk_text#\d+[,\]]", re.sub(r"\(.*?\) AS", "AS", j)) is None for j in joins)
    assert {x.entry_id for x in found.collect()} == {f"e{n}" for n in range(10, 20)}
