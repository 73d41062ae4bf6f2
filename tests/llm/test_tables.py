"""Chat formatting, top-k search, WARC archives and the pipeline against brute force."""

import base64
import hashlib
import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tessera.llm import chat, packing, queries, topk, warc  # noqa: E402
from tessera.session import materialise, shared_folder  # noqa: E402


def test_escape_is_reversible(spark):
    rnd = random.Random(4)
    bits = ["\\", "<", "|", "<|", "|>", "<|im_end|>", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "[", "s>", "a", "\n", "é", ""]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


CHAT_ROWS = [
    (1, 1, "assistant", "second"), (1, 0, "user", "first <|im_end|> \\ [INST]"), (1, 2, None, None), (1, 2, "user", "tie"), (1, 0, "user", "first <|im_end|> \\ [INST]"), (2, 0, "assistant", None),
    (None, 5, "user", "no id"), (3, None, "user\n<|im_sep|>", "odd role"), (3, -70, "assistant", "x" * 9000), *[(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)],
]


def test_chat_against_python(spark):
    rows = spark.createDataFrame(CHAT_ROWS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("k", F.lit(2)).withColumn("run", F.lit(3))
    done = chat.format_chats(chat.canonical_turns(rows.select("conv_id", "turn", "role", "text"), "conv_id")).collect()
    extra = chat.format_chats(chat.canonical_turns(rows, "conv_id")).collect()
    assert {r.conv_id: r.formatted for r in extra} == {r.conv_id: r.formatted for r in done}
    read = spark.createDataFrame(done).select("conv_id", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    assert all(sum(x.length for x in r.loss) == len(r.formatted) for r in done)
    for r in read:
        own = sorted((x for x in CHAT_ROWS if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [tuple(t) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")


def test_layouts_by_fingerprint(spark):
    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})), (2, json.dumps({"prompt": "q", "response": "a"})),
        (3, json.dumps({"instruction": "q", "input": "", "output": "a"})), (4, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]})),
        (5, json.dumps({"output": "a", "instruction": "q"})), (6, json.dumps({"question": "q", "answer": "a"})), (7, json.dumps({"other": 1})), (8, None), (9, "not json"), (10, json.dumps({"prompt": "q", "completion": "a"})),
    ]
    rows = spark.createDataFrame(records, "id long, record string")
    turns = {(r.id, r.turn): (r.role, r.text) for r in chat.canonical_json(rows, "id").collect()}
    assert turns == {(i, t): (("user", "q"), ("assistant", "a"))[t] for i in (1, 2, 3, 4, 5, 6, 10) for t in (0, 1)}
    for i, record in records[:6]:
        frame = spark.read.json(spark.sparkContext.parallelize([record])).withColumn("id", F.lit(i))
        assert [(r.role, r.text) for r in chat.canonical_turns(frame, "id").orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "id long, body string"), "id")


def test_json_records_are_not_lost(spark):
    """Further fields, paths of any depth, lists of parts; what no mapping fits comes out apart."""
    parts = [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]
    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": "q", "n": {"deep": [{"er": 1}]}}], "id": "x"})), (2, json.dumps({"conversations": [{"role": "user", "content": "q"}]})),
        (3, json.dumps({"messages": [{"role": "user", "content": parts}]})), (4, json.dumps({"a": {"b": [[{"c d": 1}]]}, "e": None, "f": {}})), (5, "not json"), (6, None), (7, json.dumps({"a": {"b": [[{"c d": 2}]]}, "e": None, "f": {}})), (8, "[1]"),
    ]
    rows = spark.createDataFrame(records, "id long, record string").withColumn("layout", F.lit("x"))
    assert {(r.id, r.turn, r.role, r.text) for r in chat.canonical_json(rows, "id").collect()} == {(1, 0, "user", "q"), (2, 0, "user", "q"), (3, 0, "user", "ab")}
    lost = {r.id: r.paths for r in chat.unmapped_json(rows, "id").collect()}
    assert lost == {4: ["a.b[][].c d", "e"], 5: None, 6: None, 7: ["a.b[][].c d", "e"], 8: None}
    assert sorted((r.records, r.paths is None) for r in chat.unmapped_layouts(rows, "id").collect()) == [(2, False), (3, True)]
    assert chat.canonical_json(rows.limit(0), "id").count() == 0


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chat.canonical_turns(empty, "conv_id")).count() == 0


def brute_top(rows, k):
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.r_[v, np.zeros(width - len(v), int)]) for i, v in good]
    first = {}
    for i, v in good:
        if i % 100 == 0 and (i not in first or tuple(v) < tuple(first[i])):
            first[i] = v
    out = []
    for q, v in first.items():
        best = sorted((-int(v @ c), i) for i, c in good if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 3, 700])
def test_top_k_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.normal(size=8).round(2).astype(float).tolist()) for i in range(n)]
    rows += [(800 + i, [0.5] * 8) for i in range(60 if n else 0)]  # one common vector
    rows += [(900, None), (1000, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1200, [float("inf")] * 8), (None, [1.0] * 8), (5, [0.1] * 8), (-100, [0.3] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit(2)).repartition(3)
    assert sorted(map(tuple, topk.top_k(table).collect())) == brute_top(rows, 10)


def test_top_k_sends_no_query_blocks_through_the_driver(spark):
    table = spark.range(400).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i * F.col("id") % 17).cast("float")).alias("embedding"))
    found = topk.top_k(table)
    assert found.count() == 40 and found.collect()
    assert "BroadcastHashJoin [part" not in found._jdf.queryExecution().executedPlan().toString()


def test_top_k_large_values_are_exact(spark):
    rows = [(0, [3e5, -2e5]), (1, [3e5, 1.0]), (2, [2.9e5, -9e5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(table).collect())) == brute_top(rows, 10)


PAGES = [
    (3, "u3", "<p>é</p>"), (1, "u1", "<p>é</p>"), (2, None, "<p>é</p>"), (4, "u\r\n4", "other\r\n\r\nbody"), (5, "u5", ""), (6, "u6", None), (7, "u7", "x" * 3_000_000), (1, "u1", "<p>é</p>"),
    (None, "u", "alone"), (None, "u", "other\r\n\r\nbody"), (8, "u8", "x" * 3_000_000),
]


def brute_warc(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        revisit = f is not None and i != f
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip(spark, zip64):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("mark", F.lit(1)).withColumn("first_id", F.lit(2)).repartition(2)
    archives = materialise(warc.pack_archives(warc.plan_records(pages), archive_bytes=1000, zip64=zip64), "test-archives")
    found = warc.read_archives(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute_warc(PAGES)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in found)
    assert archives.count() > 2


def test_zip_as_the_standard_library_reads_it():
    members = [("a.txt", b"hello"), ("archive/data.warc", bytes(range(256)) * 50), ("é", b"")]
    for zip64 in (False, True):
        data = warc.zip_stored(members, zip64)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert [(n, z.read(n)) for n in z.namelist()] == members and z.testzip() is None
        found = warc.zip_members(memoryview(data))
        assert {n: data[a : a + size] for n, (a, size) in found.items()} == dict(members)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.comment = b"a comment with PK\x05\x06 inside"
        z.writestr("stored", b"123")
        z.writestr("packed", b"1" * 1000, zipfile.ZIP_DEFLATED)
    found = warc.zip_members(memoryview(other.getvalue()))
    assert list(found) == ["stored"] and other.getvalue()[found["stored"][0] :][:3] == b"123"
    with pytest.raises(ValueError):
        warc.zip_members(memoryview(b"no archive"))


def test_broken_archives_give_error_rows(spark):
    pages = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string").coalesce(1)
    good = bytes(warc.pack_archives(warc.plan_records(pages)).first().content)
    data = bytearray(good)
    data[data.index(b"body")] ^= 1
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr(warc.MEMBER, b"x" * 500, zipfile.ZIP_DEFLATED)
        z.writestr(warc.INDEX, json.dumps({"offset": 0, "length": 5, "filename": warc.MEMBER}) + "\nnot json")
    made = [(good,), (bytes(data),), (b"no archive",), (None,), (good[: len(good) // 2],), (other.getvalue(),)]
    found = warc.read_archives(spark.createDataFrame(made, "content binary")).collect()
    errors = [r.error for r in found if r.error]
    assert len(found) - len(errors) == 5 + 4 and len(errors) == 1 + 1 + 1 + 1 + 2
    assert any("compressed" in e for e in errors) and any("digest" in e for e in errors)


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_files_round_trip(spark, monkeypatch, zip64):
    monkeypatch.setattr(warc, "RANGE_RECORDS", 2)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    paths = materialise(warc.write_archives(warc.plan_records(pages), shared_folder(spark, "test-files"), archive_bytes=1000, zip64=zip64), "test-paths")
    found = warc.read_archive_files(paths).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute_warc(PAGES)
    assert paths.count() > 2 and all(r.error is None and (r.payload is None) == (r.record_type == "revisit") for r in found)
    assert warc.record_ranges(paths).where("size(firsts) > 2").isEmpty()


def test_archive_file_beyond_4_gb_is_read_by_seeks(spark, tmp_path):
    payload = b"far away"
    record = warc.warc_record(7, "http://x/", payload, warc.sha1_base32(payload), None, "")
    large = tmp_path / "large.zip"
    with open(large, "wb") as f:
        f.truncate(5 << 30)  # a hole, no bytes on the disk
    with zipfile.ZipFile(large, "a") as z:  # appended behind the hole, so offsets need ZIP64
        z.writestr(warc.MEMBER, record * 3)
        z.writestr(warc.INDEX, "\n".join(json.dumps({"offset": i * len(record), "length": len(record), "filename": warc.MEMBER}) for i in range(3)))
    found = warc.read_archive_files(spark.createDataFrame([(f"file://{large}",)], "path string")).collect()
    assert [(r.page_id, bytes(r.payload), r.error) for r in found] == [(7, payload, None)] * 3


def test_broken_and_missing_files_give_error_rows(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string").coalesce(1)
    good = bytes(warc.pack_archives(warc.plan_records(pages)).first().content)
    bad = bytearray(good)
    bad[bad.index(b"body")] ^= 1
    for name, data in (("good", good), ("bad", bytes(bad)), ("half", good[: len(good) // 2]), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    paths = [(f"file://{tmp_path}/{name}",) for name in ("good", "bad", "half", "empty", "missing")]
    found = warc.read_archive_files(spark.createDataFrame([*paths, (None,)], "path string")).collect()
    errors = sorted(r.error for r in found if r.error)
    assert len(found) - len(errors) == 5 + 4 and len(errors) == 4
    assert sum("broken archive" in e for e in errors) == 3 and sum("digest" in e for e in errors) == 1


def test_min_bytes_leaves_small_payloads(spark):
    planned = warc.plan_records(spark.createDataFrame(PAGES, "page_id long, url string, html string"), min_bytes=1000)
    assert {r.page_id for r in planned.where("refers_to is not null").collect()} == {8}


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.pack_archives(warc.plan_records(pages))).count() == 0
    assert warc.read_archive_files(warc.write_archives(warc.plan_records(pages), shared_folder(spark, "test-files"))).count() == 0


def test_pipeline_stages(spark, small):
    """Each stage keeps the columns and works on what is left; the stages' own rules are tested by operator."""
    docs = before = spark.read.parquet(f"{small}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, small), f"test-{name}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == before.columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    assert corpus_pipeline.run(spark, small).count() == counts[-1]


def test_pipeline_decisions(spark, small):
    """The last stages against brute force on what the first three keep."""
    from tests_support import brute_left  # noqa: PLC0415

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = materialise(stage(spark, kept, small), "test-kept")
    rows = kept.select("doc_id", "text").collect()
    left = corpus_pipeline.repeats(spark, kept, small)
    found = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert found == {d: (t, len(t)) for d, t in brute_left(rows).items()}
    packed = {r.doc_id: r.length for r in packing.pack(left).collect()}
    assert packed == {d: len(t.encode().split()) for d, (t, _) in found.items()}


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
