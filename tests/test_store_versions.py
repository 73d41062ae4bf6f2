"""Changes of a library are whole or not there; streams are ingested once."""

import pytest

from tessera.functions.embed import HashEmbedder
from tessera.plans.library import Conflict, Store

SCHEMA = "workspace string, text string, source_ref string"


def contents(store):
    """All rows of all tables but the index, without times."""
    return {n: sorted(map(str, store.table(n).drop("created_at", "updated_at").collect())) for n in ("entries", "chunks", "headings", "ledger", "vectors")}


def items(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("failing", ["chunks", "manifest"])
def test_a_change_that_ends_early_changes_nothing(spark, tmp_path, monkeypatch, failing):
    store = Store(spark, f"file://{tmp_path}/lib")
    store.ingest(items(spark, ("w", "# Head\nold words", "f"), ("v", "other text", None)), "2024-01-01", HashEmbedder(4))
    before, version = contents(store), store.state().version
    real = Store._replace

    def broken(self, state, name, *rest):
        real(self, state, name, *rest)  # the table's files are there already
        if name == failing:
            raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Store, "_replace", broken)
        if failing == "manifest":
            m.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.ingest(items(spark, ("w", "# New\nnew words", "f")), "2024-02-01", HashEmbedder(4), replace=True)
    assert contents(store) == before and store.state().version == version
    assert [r.entry_id for r in store.search("new")[0].collect()] == [] and store.search("old")[0].count() == 1
    store.ingest(items(spark, ("w", "# New\nnew words", "f")), "2024-02-01", HashEmbedder(4), replace=True)
    assert store.search("new")[0].count() == 1 and store.search("old", workspaces=["w"])[0].count() == 0
    assert contents(Store(spark, store.root, version)) == before  # a pinned reader still has the old state
    assert store.prune(1) > 0 and store.search("new")[0].count() == 1 and store.prune(1) == 0


def test_versions(spark, tmp_path):
    store, late = Store(spark, f"file://{tmp_path}/lib"), Store(spark, f"file://{tmp_path}/lib")
    assert store.state().version == 0 and store.table("entries").count() == 0
    store.create("w", "2024-01-01")
    state = late.state()
    store.ingest(items(spark, ("w", "one text", None)), "2024-01-02")
    with pytest.raises(Conflict):
        late._commit(state)
    with pytest.raises(ValueError):
        Store(spark, store.root, 1).create("x", "2024-01-03")
    assert Store(spark, store.root, 1).names() == ["w"] and Store(spark, store.root, 1).table("entries").count() == 0
    store.rename("w", "x")
    assert store.names() == ["x"] and [r.workspace for r in store.search("one text")[0].collect()] == ["x"]


def test_a_stream_is_ingested_once(spark, tmp_path):
    schema = SCHEMA
    texts = [("w", f"# Part {n}\nwords of {n}", f"s{n}") for n in range(6)]
    whole = Store(spark, f"file://{tmp_path}/whole")
    whole.ingest(items(spark, *texts), "2024-01-01", HashEmbedder(4))
    store = Store(spark, f"file://{tmp_path}/lib")
    run = lambda checkpoint: store.ingest_stream(str(tmp_path / "in"), schema, str(tmp_path / checkpoint), lambda: "2024-01-01", HashEmbedder(4)).awaitTermination()
    items(spark, *texts[:4]).coalesce(1).write.parquet(str(tmp_path / "in"))
    run("cp")
    version = store.state().version
    run("cp")  # nothing new
    assert store.state().version == version and store.state().streams == {"landing": 0}
    items(spark, *texts[4:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("cp")
    assert contents(store) == contents(whole)
    # the same batch again, as after a failure between the change and the checkpoint
    refused = store.ingest(items(spark, *texts[4:]), "2025-01-01", HashEmbedder(4), batch=("landing", 1))
    assert refused.count() == 0 and contents(store) == contents(whole) and store.table("entries").where("updated_at > '2024-06'").count() == 0
    # a file that lands twice gives the same tables
    items(spark, *texts[:2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("cp")
    assert contents(store) == contents(whole) and store.state().streams == {"landing": 2}
    assert Store(spark, store.root).search("words")[0].count() == 6
