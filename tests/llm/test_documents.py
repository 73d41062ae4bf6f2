"""Operators over documents against brute force, and odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import bpe, langid, licenses, packing, quality, simhash, suffix_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _id string, component_id string, length int, score int"
WORDS = "the of and tion er an re on at en nd ha es st ing MIT Released under License. # *".split()


def texts(seed: int, n: int) -> list[str | None]:
    rnd = random.Random(seed)
    made: list[str | None] = [None, "", " ", "\n\n", "a", "é" * 70, "x" * 5000, "12 34", "Released under the MIT License."]
    while len(made) < n:
        words = [rnd.choice(WORDS) + rnd.choice(["", "x", "é", "q"]) * rnd.randint(0, 2) for _ in range(rnd.randint(1, 160))]
        made.append(rnd.choice([" ", "\n"]).join(words) + rnd.choice(["", "\nReleased under the MIT License.", "\n" + words[0]]))
        if rnd.random() < 0.3 and made[-1]:
            made.append(made[-1] if rnd.random() < 0.5 else made[-1] + " tail")
    return made


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and long texts, repeated rows and repeated ids."""
    made = [(i, t, None if i % 9 == 0 else "en" if i % 2 else "fr", None, None, "k", "i", "c", 1, 2) for i, t in enumerate(texts(1, 120))]
    return [*made, made[10], made[10], (None, made[12][1], "en", *made[0][3:]), (5, "other words " * 60, None, *made[0][3:]), (None, None, *[None] * 8)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_stats(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\x0b\x0c\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_rules(docs, rows):
    found = quality.score_documents(docs, None).collect()
    assert len(found) == len(rows)
    expected = sorted(((r[0], *brute_stats(r[1])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found), key=str) == expected
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_forest_learns_and_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = (x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) + 0.1 * rng.random(2000) < 0.6).astype(float)
    forest = quality.train_forest(x[:1500], y[:1500], (-1, 0, 0, 0))
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9
    grid = np.repeat(rng.random((50, 4)), 40, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(forest.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    for row, score in zip(x[:20], forest.score(x[:20]), strict=True):  # node by node
        margin = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            margin += forest.value[at]
        assert abs(1 / (1 + np.exp(-margin)) - score) < 1e-12


def test_quality_held_out(spark, small):
    docs, labels = spark.read.parquet(f"{small[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{small[:-5]}0.01/labels.parquet")
    forest = quality.train_quality(docs, labels.where("doc_id % 3 <> 0"))
    found = quality.score_documents(docs, forest).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").toPandas()
    assert ((found.score >= 0.3) == (found.quality == 1)).mean() > 0.9
    assert found[found.quality == 1].kept.mean() > 0.97


def test_quality_without_labels(spark, docs):
    assert quality.train_quality(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality.train_quality(docs, spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, quality int")) is None


def test_language_kernel_is_the_string_kernel():
    def sets(t):
        b = t.lower().encode()
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    known = ["le chat et la souris", "der hund und die katze", "the cat and the dog", "el gato y el perro"] * 3
    model = langid.train_language_model([langid.grams(t) for t in known], ["fr", "de", "en", "es"] * 3, landmarks=8)
    landmarks = [known[i] for name in sorted({"fr", "de", "en", "es"}) for i in [j for j in range(12) if ["fr", "de", "en", "es"][j % 4] == name][::1][:2]]
    for t in ("le chien", "zzz", "Der GATO é"):
        expected = [len(sets(t) & sets(x)) / (len(sets(t)) * len(sets(x))) ** 0.5 for x in landmarks]
        assert np.allclose(model.kernel([langid.grams(t)])[0], expected, atol=1e-6)
    assert langid.identify(["le chat", None, "", "123 !?", "the dog"], model)[0] == ["fr", "und", "und", "und", "en"]


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small[:-5]}0.01/documents.parquet")
    found = langid.identify_documents(docs, langid.fit_language_model(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 100 and (found.lang_pred == found.lang).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_language_odd_rows(docs, rows):
    found = langid.identify_documents(docs, langid.fit_language_model(docs, per_label=5)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1


def test_language_trains_on_nothing_held_out(spark):
    import zlib

    ids = range(400)
    hidden = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, f"text {i}", "odd" if i in hidden else "en") for i in ids], "doc_id long, text string, lang string")
    assert langid.fit_language_model(docs).labels == ["en"]
    found = langid.identify_documents(docs, langid.fit_language_model(docs)).collect()
    assert sorted(r.doc_id for r in found if r.held_out) == hidden


def brute_repeats(rows):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            if doc is not None:
                first[b[i : i + 50]] = min(doc, first.get(b[i : i + 50], doc))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if doc is not None and first[b[i : i + 50]] < doc:
                gone[i : i + 50] = True
        left = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((doc, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch_bytes", [8 << 20, 3000])
def test_suffix_dedup_brute_force(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch_bytes)
    rnd = random.Random(7)
    shared = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 300))) for _ in range(20)]
    made = [(200, "a" * 2500), (201, "a" * 1700), (202, "ab" * 700), (199, "x" + "a" * 60), (None, "a" * 80), (3, None), (4, "")]
    for _ in range(90):
        t = "".join(rnd.choice([rnd.choice(shared)[rnd.randint(0, 40) :], "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 80)))]) for _ in range(rnd.randint(0, 4)))
        made.append((rnd.choice([None, *range(60)]), t))
    made += made[20:23]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found), key=str) == brute_repeats(made)


def test_suffix_ranks_order_suffixes():
    data = np.frombuffer(b"banana bandana " * 12, np.uint8)
    rank, raw = suffix_dedup.suffix_ranks(data), data.tobytes()
    ends = range(len(raw) - 49)
    assert sorted(ends, key=lambda i: (rank[i], i)) == sorted(ends, key=lambda i: (raw[i : i + 50], i))
    assert all((rank[i] == rank[j]) == (raw[i : i + 50] == raw[j : j + 50]) for i in ends for j in ends)


def test_long_texts_are_parsed_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 700)
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdefg ") for _ in range(5000))
    made = [(1, base), (2, "zz" + base[300:4100] + "yy"), (3, base[:200])]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(tuple, found), key=str) == brute_repeats(made)


def test_suffix_filter_keeps_columns(docs, rows):
    out = suffix_dedup.filter_documents(docs)
    assert out.schema == docs.schema
    assert out.count() == len(rows)


def brute_components(prints, budget=4):
    label = {i: i for i in range(len(prints))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= budget:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("spread", [2, 5, 40])
def test_trie_links_brute_force(spread):
    rnd = random.Random(spread)
    prints = set()
    while len(prints) < 300:
        base = rnd.getrandbits(64) if not prints or rnd.random() < 0.2 else rnd.choice(sorted(prints))
        for _ in range(rnd.randint(0, spread)):
            base ^= 1 << rnd.randrange(64)
        prints.add(base)
    prints = sorted(prints)
    key = np.array(prints, np.uint64)
    labels = simhash.trie_links(np.zeros(len(key), int), key, 64, 4)
    assert len({*zip(labels.tolist(), brute_components(prints), strict=True)}) == len(set(labels.tolist())) == len(set(brute_components(prints)))


@pytest.mark.parametrize("spare", [0, 1, 2])
def test_more_blocks_lose_no_link(spark, spare):
    rnd = random.Random(9)
    prints = {rnd.getrandbits(64) for _ in range(40)}
    for p in sorted(prints):
        for _ in range(4):
            for _ in range(rnd.randint(1, 5)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for e in simhash.link_edges(rows, 4, spare).collect():
        label[root(e.a % 2**64)] = root(e.b % 2**64)
    expected = brute_components(prints)
    assert len({(root(p), g) for p, g in zip(prints, expected, strict=True)}) == len(set(expected)) == len({root(p) for p in prints})
    assert [simhash.spare_blocks(n, 4) for n in (10**6, 10**9, 10**11)] == [0, 1, 2]


def test_simhash_brute_force(docs, rows):
    import xxhash

    def print_of(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    known = [(r[0], print_of(r[1])) for r in rows if r[0] is not None]
    group = brute_components([p for _, p in known])
    low = {}
    for (doc, _), g in zip(known, group, strict=True):
        low[g] = min(doc, low.get(g, doc))
    expected = sorted([(d, p, low[g]) for (d, p), g in zip(known, group, strict=True)] + [(None, print_of(r[1]), None) for r in rows if r[0] is None], key=str)
    found = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=str) == expected
    kept = simhash.filter_documents(docs)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(low.values()))
    assert ids.count(None) == sum(r[0] is None for r in rows)


def test_connected_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (7, 7)]
    found = {r.node: r.root for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == 100 and found[103] == 102


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_as_tiktoken(codec):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(5)
    tokens = list(codec.ranks)
    for i in range(3000):
        if i % 3 == 0:
            t = "".join(rnd.choice(["a", "e", "  ", "\n", "é", "中", "\U0001f600", "'s", "1", "!!", "\x1c", "\x85", " ", "=", "<|endoftext|>"]) for _ in range(rnd.randint(0, 30)))
        elif i % 3 == 1:
            t = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 6))).decode("utf-8", "ignore")
        else:
            t = "".join(chr(rnd.choice([rnd.randint(0, 0x7F), rnd.randint(0, 0x2FFF), rnd.randint(0x3000, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(rnd.randint(1, 12)))
        ids = codec.encode(t)
        assert ids == own.encode_ordinary(t)
        assert codec.decode_bytes(codec.encode_packed(t)) == t.encode()
        assert "".join(codec.decode_pieces(ids)) == t
        assert all(t[a:b].encode().find(codec.tokens[i]) >= 0 for i, a, b in codec.spans(t))


def test_bpe_round_trip_rows(docs, rows, codec):
    found = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    expected = [(r[0], len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows for p in [codec.encode_packed(r[1] or "")]]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.ids) for r in ids) == sorted(codec.encode_packed(r[1] or "") for r in rows)


def brute_bounds(lengths, counts, k):
    from itertools import combinations

    best = None
    for n in range(1, min(k, len(lengths)) + 1):
        for cut in combinations(range(len(lengths) - 1), n - 1):
            bounds = [lengths[i] for i in (*cut, len(lengths) - 1)]
            cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
            best = cost if best is None else min(best, cost)
    return best


def test_optimal_bounds_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(40), rnd.randint(1, 9)))
        counts = [rnd.randint(1, 20) for _ in lengths]
        k = rnd.randint(1, 5)
        bounds = packing.optimal_bounds(np.array(lengths), np.array(counts), k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1]
        assert sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True)) == brute_bounds(lengths, counts, k)


def test_packing_batches(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 20)
    found = packing.pack(docs, n_buckets=4, budget=300).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in found) == sorted((r[0] is None, r[0] or 0, brute_stats(r[1])[0]) for r in rows)
    for bucket in {r.bucket for r in found}:
        own = [r for r in found if r.bucket == bucket]
        bound = own[0].bucket_len
        per = max(1, 300 // max(bound, 1))
        assert all(r.bucket_len == bound and r.padding == bound - r.length >= 0 for r in own)
        assert sorted((r.batch, r.place) for r in own) == [(i // per, i % per) for i in range(len(own))]


def brute_license(text):
    import re

    def words(x):
        return re.sub(r"[^a-z0-9é]+", " ", (x or "").lower()).split()

    def grams(w):
        return Counter(zip(w, w[1:], strict=False))

    lines, whole = [words(x) for x in (text or "").split("\n")], words(text)
    out = []
    for name, body in licenses.TEMPLATES:
        b = grams(words(body))
        n = b.total()
        units = [*lines, whole, *(whole[i : i + n + 1] for i in range(len(whole) - n))]
        dice = max(2 * (a & b).total() / (a.total() + n) for a in map(grams, units))
        if dice >= 0.8:
            out.append((dice, name))
    best = min(out, key=lambda x: (-x[0], x[1])) if out else (0.0, None)
    return best[1], round(best[0], 6), len(out), ",".join(sorted({n for _, n in out}))


def test_licenses_brute_force(docs, rows, spark):
    more = [(900 + i, body, *rows[1][2:]) for i, (_, body) in enumerate(licenses.TEMPLATES)]
    more += [(950, licenses.TEMPLATES[3][1].replace("compliance", "line") + " extra", *rows[1][2:]), (951, "a b c d e\nlicensed under THE apache license,version 2.0!", *rows[1][2:])]
    rnd = random.Random(3)
    for i, (_, body) in enumerate(licenses.TEMPLATES):  # wrapped, changed, inside a longer text
        w = body.split()
        for _ in range(rnd.randint(0, 1 + len(w) // 12)):
            w[rnd.randrange(len(w))] = "other"
        lines = [" ".join(w[j : j + 7]) for j in range(0, len(w), 7)]
        more.append((1000 + i, "some words before the license here " * 9 + "\n# ".join(lines) + " and words after it" * rnd.randint(0, 30), *rows[1][2:]))
    found = licenses.scan_documents(docs.unionByName(spark.createDataFrame(more, SCHEMA))).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((r[0], *brute_license(r[1])) for r in [*rows, *more]), key=str)


def test_license_in_a_paragraph(spark):
    mit = next(b for n, b in licenses.TEMPLATES if n == "MIT" and len(b) > 400).split()
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    made = [(1, "Foo is a library. Released under the MIT License."), (2, "x = 1\n" * 200 + wrapped + "\ny = 2" * 500), (3, "nothing of the kind " * 5000)]
    found = {r.doc_id: r.license for r in licenses.scan_documents(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert found == {1: "MIT", 2: "MIT", 3: None}


@pytest.mark.parametrize("build", [
    lambda d: quality.score_documents(d, None), lambda d: quality.filter_documents(d, None), lambda d: langid.identify_documents(d, langid.fit_language_model(d)), lambda d: langid.filter_documents(d, None),
    suffix_dedup.remove_repeats, suffix_dedup.filter_documents, simhash.near_duplicates, simhash.filter_documents, packing.pack, licenses.scan_documents,
    lambda d: bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
])
def test_empty_tables(empty, build):
    assert build(empty).count() == 0


def test_filters_keep_all_columns(docs):
    for out in (quality.filter_documents(docs, None), langid.filter_documents(docs, langid.fit_language_model(docs, per_label=5))):
        assert out.schema == docs.schema
        assert out.count() > 0


def test_stats_of_an_empty_batch():
    counts, features = quality.document_stats(pa.array([], pa.string()))
    assert counts.shape == (0, 5) and features.shape == (0, len(quality.FEATURES))
