"""Cases that were lost or slow once: long near-copies, languages of few ids, mixed contents, many licences in one text."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, jaccard, langid, licenses, suffix_dedup


@pytest.mark.parametrize("seed", [1])
def test_near_copies_among_long_texts(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "COMMON", 0)  # common passages are not known as such
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    common = [rnd.choice(words) for _ in range(4000)]
    rows = [(n, " ".join(common + [rnd.choice(words) for _ in range(3500)])) for n in range(14)]
    copy = rows[5][1].split()
    for i in range(0, 1200, 10):
        copy[-1 - i] = "changed"
    rows.append((99, " ".join(copy)))
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert found[99] == 5 and all(found[n] == n for n in range(14))


def test_languages_of_few_ids_are_learnt(spark):
    rows = [(n, f"the text number {n} of the house", "en") for n in range(900)] + [(5001 + n % 2, "žluťoučký kůň úpěl", "cs") for n in range(4000)]
    found = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    each = {r.lang: r.n for r in found.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    held = spark.createDataFrame([(5001,), (5002,)], "doc_id long").where(~langid.held_out()).count()
    assert each["en"] == 50 and each.get("cs", 0) == held > 0


def test_contents_of_both_kinds(spark):
    parts = [{"type": "text", "text": "y"}, {"type": "text", "text": "o"}]
    rows = [(1, "messages", ["hi", parts]), (2, "messages", [parts, "[1]"]), (3, "conversations", ["hi", parts])]
    frame = spark.createDataFrame([(k, json.dumps({top: [{"role": "user", "content": c[0]}, {"role": "assistant", "content": c[1]}]})) for k, top, c in rows], "id long, record string")
    found = {(r.id, r.turn): r.text for r in chat.canonical_json(frame, "id").collect()}
    assert found == {(1, 0): "hi", (1, 1): "yo", (2, 0): "yo", (2, 1): "[1]", (3, 0): "hi", (3, 1): "yo"}


def test_buckets_at_any_size():
    assert suffix_dedup.bucket_count(0) == 8 and suffix_dedup.bucket_count(1 << 30) == 128
    assert suffix_dedup.bucket_count(900 << 30) < 100_000 > suffix_dedup.bucket_count(1 << 50)


def test_many_licences_in_one_text(spark):
    name, body = max((t for t in licenses.TEMPLATES if t[0] == "MIT"), key=lambda t: len(t[1]))
    words = body.split()
    changed = " ".join(w if n % 40 else "other" for n, w in enumerate(words))
    texts = [body, " ".join(["before"] + words + ["after"] * 900), "\n".join([changed] * 30 + ["x"]), "\n".join(words * 1000), ("word " * 300 + body + " ") * 20]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    start = time.time()
    found = {r.doc_id: r for r in licenses.scan_documents(frame).collect()}
    assert all("MIT" in r.licenses for r in found.values()) and found[3].dice == 1.0 and time.time() - start < 60
