import numpy as np
import pytest
from pyspark.sql import functions as F

from passagecraft.operators import answering, chunking, embedding, evaluation, index, retrieval
from passagecraft.schema import ChunkConfig, RetrievalParams


def hits_of(spark, rows):
    """(rerank score, date) in cosine order, as hits of question 1."""
    data = [(1, f"c{i}", 0.9 - i / 100, i + 1, s, d) for i, (s, d) in enumerate(rows)]
    return spark.createDataFrame(data, "question_id long, chunk_id string, cosine double, cosine_rank int, rerank_score double, effective_date string")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0.998, "2025-04-01"), (0.996, "2026-04-01")], ["c1", "c0"]),
        ([(0.976, "2025-04-01"), (0.974, "2026-04-01")], ["c0", "c1"]),
        ([(0.125, "2026"), (0.12, "2027")], ["c1", "c0"]),
        ([(0.12, "2025"), (0.08, "2026")], ["c1", "c0"]),
        ([(0.5, ""), (0.5, "2026")], ["c1", "c0"]),
        ([(0.5, "2026"), (0.5, "2026")], ["c0", "c1"]),
    ],
)
def test_recency(spark, rows, want):
    got = retrieval.ranked(hits_of(spark, rows), RetrievalParams()).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == want


@pytest.mark.parametrize(
    ("n", "cosine", "rerank", "on", "grounded"),
    [(0, None, None, True, False), (20, 0.6399, 0.9, True, False), (20, 0.64, 0.0999, True, False), (20, 0.64, 0.1, True, True), (20, 0.7, None, False, True)],
)
def test_gates(spark, n, cosine, rerank, on, grounded):
    row = spark.createDataFrame([(n, cosine, rerank)], "n int, c double, r double")
    why = row.select(retrieval.reason(F.col("n"), F.col("c"), F.col("r"), RetrievalParams(rerank=on)).alias("w")).first().w
    assert (why == "") == grounded


def test_candidates_against_brute_force(spark):
    rnd = np.random.default_rng(0)
    v = rnd.normal(size=(300, 8))
    v[50:60] = v[0]
    idx = spark.createDataFrame([(f"c{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "chunk_id string, vector array<double>")
    asks = spark.createDataFrame([(i, v[i].tolist()) for i in range(7)], "question_id long, vector array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (2048, 3):
        got = {(r.question_id, r.cosine_rank): r.chunk_id for r in retrieval.candidates(asks, idx, 12, block).collect()}
        for q in range(7):
            order = sorted(range(300), key=lambda i: (-round(float(unit[i] @ unit[q]), 4), i))[:12]
            assert [got[q, k + 1] for k in range(12)] == [f"c{i:03d}" for i in order]
    assert retrieval.candidates(asks.limit(0), idx, 5).count() == 0


def test_plan_prunes_and_limits(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"text {i}", "a" if i % 2 else "b", "c") for i in range(20)], "document_id string, text string, doc_type string, corpus_id string")
    built = index.build(chunking.chunk(docs, ChunkConfig("fixed", 300, 0)))
    path = str(tmp_path / "index")
    index.write(built, path)
    index.write(built, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    mine = index.read(spark, path, "c", ChunkConfig("fixed", 300, 0))
    plan = mine.where(retrieval.matches(RetrievalParams(doc_type="a")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "doc_type" in plan.split("PartitionFilters")[1].split("]")[0]
    assert mine.count() == 20 and index.catalog(spark, path).first().n_documents == 20 and index.duplicate_ids(mine).count() == 0
    assert index.drop_corpus(spark, path, "c") and not index.drop_corpus(spark, path, "c")


RAW = {"A [2]. B [1][2].": ([2, 1], []), "A [1]. B [7].": ([1], ["7"]), "A [7] [0].": ([], ["7", "0"]), "A without marker": ([], []), "[99999999999999]": ([], ["99999999999999"])}


def test_cited(spark):
    used, invented = answering.cited(F.col("raw"), F.lit(5))
    for r in spark.createDataFrame([(k,) for k in RAW], "raw string").select("raw", used.alias("u"), invented.alias("i")).collect():
        assert (r.u, r.i) == RAW[r.raw]


def ask(spark, providers=None, **how):
    docs = spark.createDataFrame(
        [("BASE", "Base", "# Fees\nthe fee for claims is ten", "policy", "2025-01-01"), ("AMEND", "Amendment", "# Fees\nthe fee for claims is twelve", "policy", "2026-01-01"), ("X", "Other", "weather and birds", "note", "")],
        "document_id string, title string, text string, doc_type string, effective_date string",
    ).withColumns({"source_url": F.lit(""), "relpath": F.lit("")})
    built = index.build(chunking.chunk(docs))
    asks = spark.createDataFrame([(1, "what is the fee for claims"), (2, "zebra quantum")], "question_id long, question string").withColumn("vector", embedding.embed_query(F.col("question")))
    hits, decisions = retrieval.retrieve(asks, built, RetrievalParams(min_cosine=0.2, **how))
    return {r.question_id: r for r in answering.answer(hits, decisions, providers).collect()}


def test_answers(spark):
    got = ask(spark)
    assert got[1].mode == "extractive" and "> # Fees\n> the fee for claims is twelve" in got[1].text and got[1].citations[0].document_id == "AMEND"
    assert got[2].mode == "abstained" and not got[2].grounded and got[2].citations == []
    got = ask(spark, answering.Providers(mine=lambda prompts: ["It is twelve [1]. See [9]." for _ in prompts]))
    assert got[1].mode == "mine" and got[1].grounded and [c.n for c in got[1].citations] == [1] and "9" in got[1].reason

    def broken(prompts):
        raise RuntimeError("no quota.")

    got = ask(spark, answering.Providers(mine=broken))
    assert got[1].mode == "extractive" and got[1].reason == "no quota." and got[2].mode == "abstained"
    assert ask(spark, answering.Providers(mine=lambda p: ["none"] * len(p)))[1].mode == "unverified"
    assert ask(spark, answering.Providers(mine=lambda p: ["not_in_documents [1]"] * len(p)))[1].mode == "abstained"
    assert ask(spark, doc_type="nothing")[1].diagnostics.candidates == 0


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) == 1:
            raise answering.RateLimited("slow", 600)
        return "ok"

    assert answering.with_retry(call, 1, waits.append) == "ok" and waits == [60.0]
    assert answering.retry_delay(None) == 20 and answering.retry_delay(0.1) == 1
    assert not answering.Providers().status().ready and answering.Providers(a=len).status("b").ready is False


def test_metrics(spark):
    gold = spark.createDataFrame(
        [(1, "answerable", None, ["a", "B"], None, None, None, None), (2, "superseded", None, None, "C", ["new"], None, ["p", "q"]), (3, "unanswerable", None, None, None, None, None, None), (4, "answerable", "Z", ["a"], None, None, None, None)],
        "question_id long, kind string, expect_doc string, expect_text array<string>, current_doc string, current_text array<string>, stale_doc string, stale_text array<string>",
    )
    hits = spark.createDataFrame(
        [(1, 1, "D", "A only"), (1, 2, "D", "a and b"), (2, 1, "C", "q here"), (2, 2, "C", "NEW"), (2, 4, "C", "p here"), (4, 1, "D", "a")], "question_id long, rank int, document_id string, text string"
    )
    got = {r.question_id: r for r in evaluation.gold_ranks(gold, hits).collect()}
    assert got[1].expect_rank == 2 and got[2].current_rank == 2 and got[2].stale_rank == 4 and got[4].expect_rank is None
    s = evaluation.summary(evaluation.gold_ranks(gold, hits).withColumn("grounded", F.col("question_id") != 3)).first()
    assert s.n_gold == 3 and s.hit_at_k == pytest.approx(2 / 3) and s.mrr == pytest.approx(1 / 3) and s.current_wins == 1 and s.abstain_rate == 1


def test_calibration(spark):
    scores = spark.createDataFrame([(True, 0.5), (True, 0.9), (False, 0.1), (False, 0.2), (None, 0.7)], "positive boolean, score double").where("positive is not null")
    best = evaluation.best_threshold(evaluation.threshold_sweep(scores)).first()
    assert (best.threshold, best.kept, best.refused) == (0.21, 2, 2)
    assert evaluation.overlap(scores).first().overlaps is False


def test_embedder_plugs_in(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(embedding.embed(F.col("t"), lambda texts: np.array([[3.0, 4.0 * len(t)] for t in texts])).alias("v")).collect()]
    assert got[0] == pytest.approx([3 / np.hypot(3, 12), 12 / np.hypot(3, 12)]) and got[1] == [1, 0]
    assert embedding.hashed_words(["The the"]).max() == 2


def test_nearest_of_each_configuration_in_one_look(spark):
    rnd = np.random.default_rng(4)
    rows = [(f"c{i % 50}", ["a", "b", None][i % 3], rnd.normal(size=4).tolist()) for i in range(150)]
    index = spark.createDataFrame(rows, "chunk_id string, cfg string, vector array<float>").repartition(3)
    asks = spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in range(7)], "question_id long, vector array<float>")
    got = sorted(tuple(r) for r in retrieval.candidates(asks, index, 3, by="cfg").select("cfg", "question_id", "cosine_rank", "chunk_id", "cosine").collect())
    want = []
    for cfg in ("a", "b", ""):
        one = retrieval.candidates(asks, index.where(F.coalesce("cfg", F.lit("")) == cfg), 3, block=3)
        want += [(cfg, r.question_id, r.cosine_rank, r.chunk_id, r.cosine) for r in one.collect()]
    assert got == sorted(want) and len(got) == 63


def test_any_condition_before_candidates_are_chosen(spark):
    rows = [(f"c{i}", f"d{i}", f"text {i}", "", "", i % 2, [1.0, i / 10]) for i in range(20)]
    idx = spark.createDataFrame(rows, "chunk_id string, document_id string, text string, doc_type string, effective_date string, owner int, vector array<float>")
    asks = spark.createDataFrame([(1, "text", [1.0, 0.0])], "question_id long, question string, vector array<float>")
    params = RetrievalParams(top_k=3, candidate_k=3, rerank=False, min_cosine=0)
    for where in ("owner = 1", F.col("owner") == 1):
        hits, decided = retrieval.retrieve(asks, idx, params, where=where)
        assert [r.chunk_id for r in hits.orderBy("rank").collect()] == ["c1", "c3", "c5"] and decided.first().diagnostics.candidates == 3
    assert retrieval.retrieve(asks, idx, params, where="owner = 7")[1].first().reason == retrieval.NO_MATCH


def test_candidates_of_texts(spark):
    rnd = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"c{i:03d}", " ".join(rnd.choice(words, 6)), "ab"[i % 2]) for i in range(400)] + [(f"d{i}", "w1 w2 w3", "a") for i in range(90)] + [("none", None, "b"), ("empty", "", None)]
    index = spark.createDataFrame(rows, "chunk_id string, text string, kind string").repartition(3)
    asks = spark.createDataFrame([(i, " ".join(rnd.choice(words, 4))) for i in range(9)] + [(99, "w1 w2 w3")], "question_id long, question string").select("question_id", embedding.embed(F.col("question")).alias("vector"))
    made = index.withColumn("vector", embedding.embed(F.col("text")))
    for how in ({}, {"by": "kind"}, {"block": 4}):
        said = [sorted(map(str, df.collect())) for df in (retrieval.candidates(asks, made, 7, **how), retrieval.candidates(asks, index, 7, embedder=embedding.hashed_words, **how))]
        assert said[0] == said[1] and len(said[0]) == 10 * 7 * (3 if how.get("by") else 1) - (60 if how.get("by") else 0)


def test_a_worker_holds_few_pairs(monkeypatch):
    monkeypatch.setattr(retrieval, "_SCORES", 1 << 12)
    rnd = np.random.default_rng(2)
    best, scores = retrieval._Best(8, 5), rnd.normal(size=(20_000, 8))
    scores[7, 3] = np.nan
    for at in range(0, len(scores), 500):
        best.add(np.arange(at, at + 500), scores[at : at + 500])
        assert best.waiting <= 500 * 8 + 512
    q, ids, found = best.settle()
    assert len(q) == 40
    for j in range(8):
        order = sorted((i for i in range(len(scores)) if scores[i, j] == scores[i, j]), key=lambda i: (-round(scores[i, j], 4), i))[:5]
        assert ids[q == j].tolist() == order and found[q == j].tolist() == scores[order, j].tolist()


def test_named_queries_send_small_batches(spark, tmp_path):
    from passagecraft.plans.queries import QUERIES

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        assert QUERIES["embed_passages"](spark, str(tmp_path)).count() == 2
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)


def test_an_embedding_takes_little_beside_its_rows():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["some words of a text " * 5] * 4000)
    tracemalloc.start()
    rows = sum(len(v) for v in embedding.vectors(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and most < 2 << 20


def test_words_by_blanks_are_those_of_the_pattern():
    import random
    import re

    rnd = random.Random(0)
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}b" for c in chars[: 1 << 14]] + ["", "\0", "ΑΣ", "Σ", "x_y İ ß"]
    for most in (100, 3000, len(chars)):
        texts += ["".join(chars[rnd.randrange(most)] for _ in range(200)) for _ in range(40)]
    want = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert [embedding.words([t])[0] for t in texts] == want
    for n in (3, 64):
        assert [w for at in range(0, len(texts), n) for w in embedding.words(texts[at : at + n])] == want
    assert embedding.words([]) == []
