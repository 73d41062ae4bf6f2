"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tessera.llm import jaccard  # noqa: E402

SCHEMA = "doc_id long, text string, extra string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """doc_id to the smallest doc_id of its component."""
    sets = [(d, shingles(t)) for d, t, _ in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d in root}


def made_rows(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = [rnd.choice(words) for _ in range(40)]
    rows = [(0, None, "x"), (1, "", "x"), (2, "one two", "x"), (3, "One  two", "x"), (4, "one two three", "x")]
    while len(rows) < 220:
        text = [rnd.choice(words) for _ in range(rnd.choice([4, 5, 6, 9, 60, 150]))]
        if rnd.random() < 0.4:
            text[3:3] = common
        for _ in range(rnd.choice([1, 1, 2, 6])):
            rows.append((len(rows), " ".join(text), "x"))
            for _ in range(rnd.randint(0, 2)):  # around the threshold, and chains
                text[rnd.randrange(len(text))] = rnd.choice(words)
            text += [rnd.choice(words) for _ in range(rnd.choice([0, 0, 3, len(text) // 5]))]
    rnd.shuffle(rows)
    return [*rows, rows[7], (rows[9][0], "another text of this document " * 9, "y"), (None, rows[8][1], "z"), (None, None, "z")]


@pytest.mark.parametrize("sample", [20_000, 20])
def test_near_dedup_finds_every_pair(spark, monkeypatch, sample):
    monkeypatch.setattr(jaccard, "SAMPLE_ROWS", sample)
    rows = made_rows(sample)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    want = brute_groups(rows)
    found = jaccard.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id is not None) == sorted((d, want[d]) for d, _, _ in rows if d is not None)
    assert all(r.component_id is None for r in found if r.doc_id is None)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d in want if want[d] == d)
    assert kept.where("doc_id is null").count() == 2


def test_near_dedup_empty(spark):
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
