import os
import time

import pytest
from pyspark.sql import functions as F

from passagecraft.operators import index, storage, versions
from passagecraft.schema import ChunkConfig
from passagecraft.streaming import ingest

DIGEST = ["text"]


def words(docs):
    return docs.select("document_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))


def docs_of(spark, rows):
    return spark.createDataFrame(list(rows.items()) if isinstance(rows, dict) else rows, "document_id string, text string")


def held(spark, root, number=None):
    rows = versions.read(spark, root, number)
    return None if rows is None else sorted((r.document_id, r.word) for r in rows.collect())


def want(rows):
    return sorted((k, w) for k, t in rows.items() for w in (t or "").split(" "))


def test_only_changes_are_written(spark, tmp_path):
    root = f"{tmp_path}/s"
    made = []

    def counted(docs):
        made.append(sorted(r.document_id for r in docs.select("document_id").collect()))
        return words(docs)

    one = {f"d{i}": f"text {i} here" for i in range(20)}
    assert versions.read(spark, root) is None and versions.version(spark, root) == versions.NONE
    v1 = versions.commit(docs_of(spark, one), root, counted, DIGEST)
    assert (v1.number, v1.written, v1.removed) == (1, 20, 0) and held(spark, root) == want(one)
    assert versions.commit(docs_of(spark, one), root, counted, DIGEST).number == 1  # nothing changed: no version, no work
    two = {**one, "d3": "other words", "d5": None, "new": "one more"}
    del two["d7"]
    old = versions.read(spark, root)
    v2 = versions.commit(docs_of(spark, two), root, counted, DIGEST)
    assert (v2.number, v2.written, v2.removed) == (2, 3, 1) and made[1:] == [["d3", "d5", "new"]]
    assert held(spark, root) == want(two) and held(spark, root, 1) == want(one)
    assert sorted((r.document_id, r.word) for r in old.collect()) == want(one)  # a reader keeps what it has opened
    assert spark.read.parquet(f"{root}/{v2.parts[-1]}").select("document_id").distinct().count() == 3
    three = {k: two[k] for k in ("d0", "d5")}
    versions.commit(docs_of(spark, three), root, counted, DIGEST)
    v4 = versions.compact(spark, root)
    assert v4.number == 4 and held(spark, root) == want(three) and len(v4.parts) == 1 and versions.compact(spark, root).number == 4
    assert versions.vacuum(spark, root, keep=1) and held(spark, root) == want(three) and versions.numbers(spark, root) == [4]
    assert len(os.listdir(f"{root}/parts")) == 1
    versions.commit(docs_of(spark, {}), root, counted, DIGEST)
    assert held(spark, root) is None and made[1:] == [["d3", "d5", "new"]]


def test_added_documents_and_expiry(spark, tmp_path):
    root = f"{tmp_path}/s"
    versions.commit(docs_of(spark, {"a": "x", "b": "y"}), root, words, DIGEST)
    cut = F.timestamp_seconds(F.lit(time.time()))
    v = versions.commit(docs_of(spark, {"b": "y", "c": "z"}), root, words, DIGEST, whole=False)
    assert held(spark, root) == want({"a": "x", "b": "y", "c": "z"}) and v.written == 1
    assert versions.commit(docs_of(spark, {"c": "z"}), root, words, DIGEST, whole=False, expire_before=cut).removed == 1
    assert held(spark, root) == want({"b": "y", "c": "z"})


def test_several_rows_of_a_key_and_null_keys(spark, tmp_path):
    root = f"{tmp_path}/s"
    rows = [("a", "old"), ("a", "new"), ("a", "new"), ("b", "x")]
    df = docs_of(spark, rows).withColumn("at", F.when(F.col("text") == "old", 1).otherwise(2))
    versions.commit(df, root, words, DIGEST, newest=F.col("at"))
    assert held(spark, root) == [("a", "new"), ("b", "x")]
    with pytest.raises(ValueError, match="no document_id"):
        versions.commit(docs_of(spark, [(None, "x")]), root, words, DIGEST)
    assert held(spark, root) == [("a", "new"), ("b", "x")]


@pytest.mark.parametrize("step", ["made", "parts", "sources", "manifest", "taken"])
def test_a_failure_at_any_step_loses_no_version(spark, tmp_path, monkeypatch, step):
    root = f"{tmp_path}/s"
    one, two = {"a": "x", "b": "y"}, {"a": "x2", "c": "z"}
    versions.commit(docs_of(spark, one), root, words, DIGEST)

    def broken(*a, **b):
        raise OSError(step)

    with monkeypatch.context() as m, pytest.raises((OSError, versions.Conflict)):
        if step == "made":
            versions.commit(docs_of(spark, two), root, broken, DIGEST)
        if step in ("parts", "sources"):
            real = type(spark.range(1).write).parquet
            m.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **b: broken() if f"/{step}/" in path and root in path else real(self, path, *a, **b))
        if step == "manifest":
            m.setattr(versions, "write_new", broken)
        if step == "taken":  # another writer was faster
            m.setattr(versions, "write_new", lambda *a: False)
        versions.commit(docs_of(spark, two), root, words, DIGEST)
    assert held(spark, root) == want(one) and versions.numbers(spark, root) == [1]
    versions.commit(docs_of(spark, two), root, words, DIGEST)
    assert held(spark, root) == want(two) and held(spark, root, 1) == want(one)
    versions.vacuum(spark, root)
    assert held(spark, root) == want(two) and len(os.listdir(f"{root}/parts")) == 2


def chunks(spark, text, n=3):
    cfg = ChunkConfig()
    rows = [("c", "m", cfg.slug, f"t{i % 2}", f"d{i}", f"d{i}::0", text) for i in range(n)]
    return spark.createDataFrame(rows, "corpus_id string, embed_model string, chunk_slug string, doc_type string, document_id string, chunk_id string, text string")


@pytest.mark.parametrize("step", [1, 2])
@pytest.mark.parametrize("lost", [False, True])
def test_a_failed_replacement_leaves_a_collection(spark, tmp_path, monkeypatch, step, lost):
    path = f"{tmp_path}/s"
    texts = lambda: {r.text for r in index.read(spark, path, "c", ChunkConfig(), "m").collect()}
    index.write(chunks(spark, "old"), path)
    real, seen = index._replace, []

    def failing(store, new, place, aside):
        class Store:
            def __getattr__(self, name):
                return getattr(store, name)

            def rename(self, a, b):
                seen.append(1)
                if len(seen) == step:
                    if lost:
                        raise KeyboardInterrupt
                    return False
                if lost and len(seen) > step:
                    return False  # a driver that is gone puts nothing back
                return store.rename(a, b)

        real(Store(), new, place, aside)

    with monkeypatch.context() as m, pytest.raises((OSError, KeyboardInterrupt)):
        m.setattr(index, "_replace", failing)
        index.write(chunks(spark, "new"), path)
    assert texts() == {"old"}
    index.write(chunks(spark, "newer", 2), path)
    assert texts() == {"newer"} and not [f for f in os.listdir(path) if f.startswith("_old")]


def test_files_that_come_again(spark, tmp_path):
    inbox, store = tmp_path / "in", f"{tmp_path}/store"

    def deliver(day, **texts):
        (inbox / day).mkdir(parents=True, exist_ok=True)
        for name, t in texts.items():
            (inbox / day / f"{name}.md").write_text(t)

    def take(checkpoint="state"):
        ingest.upsert(spark, str(inbox), store, f"{tmp_path}/{checkpoint}").awaitTermination(180)
        return versions.version(spark, store).number, {(r.key, r.text) for r in versions.read(spark, store).collect()}

    deliver("1", a="# A\none text", b="# B\nanother text")
    assert take() == (1, {("a.md", "# A\none text"), ("b.md", "# B\nanother text")})
    assert take()[0] == 1
    deliver("2", a="# A\none text", b="# B\nchanged text", c="# C\nnew")
    time.sleep(0.1)
    want = {("a.md", "# A\none text"), ("b.md", "# B\nchanged text"), ("c.md", "# C\nnew")}
    assert take() == (2, want)
    assert take("another") == (2, want)  # all is delivered again: the newest of each is there already
    rows = versions.read(spark, store)
    assert {"vector", "chunk_id"} <= set(rows.columns) and rows.groupBy("chunk_id").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError, match="replaced as a whole"):
        index.write(chunks(spark, "x"), f"{tmp_path}/whole")
        ingest.ingest(spark, str(inbox), f"{tmp_path}/whole", f"{tmp_path}/s2")


def test_storage(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    assert storage.read_text(spark, path) is None and storage.write_new(spark, path, "é") and not storage.write_new(spark, path, "x")
    assert storage.read_text(spark, path) == "é" and os.listdir(f"{tmp_path}/a") in (["b.json"], [".b.json.crc", "b.json"], ["b.json", ".b.json.crc"])
