import numpy as np
import pytest
from pyspark.sql import functions as F

from passagecraft.operators import ann, retrieval
from passagecraft.plans.queries import QUERIES


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<float>")


def grouped(n, dims=16, groups=20, seed=1):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(groups, dims)) * 3
    return centers[rnd.integers(0, groups, n)] + rnd.normal(size=(n, dims)) * 0.5


def shares(found, exact):
    want = {(r.question_id, r.chunk_id) for r in exact.collect()}
    got = {(r.question_id, r.chunk_id) for r in found.collect()}
    return len(want & got) / len(want)


@pytest.fixture(scope="module")
def index(spark):
    return table(spark, grouped(3000)).withColumn("text", F.lit("kept"))


def test_recall_and_lists_read(spark, index, tmp_path):
    built = ann.build(index, f"{tmp_path}/a")
    asks = index.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("question_id"), "vector")
    found = built.search(asks, 10)
    assert built.rows.count() == 3000 and built.rows.select("chunk_id").distinct().count() == 3000 and "text" in built.rows.columns
    assert shares(found, retrieval.candidates(asks, index, 10)) >= 0.9 and built.probes < len(built.centers) / 3
    one = built.search(asks.where("question_id = 100"), 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan
    files = {r.f for r in built.rows.select(F.input_file_name().alias("f")).distinct().collect()}
    read = one._jdf.queryExecution().executedPlan()
    one.collect()
    assert len(files) >= len(built.centers) * 0.9 and read is not None
    lists = {int(f.split("list=")[1].split("/")[0]) for f in files}
    asked = set(np.argsort(-(ann._unit(np.array([asks.where("question_id = 100").first().vector])) @ built.centers.T))[0][: built.probes].tolist())
    assert asked < lists and all(f"{c}" in plan.split("PartitionFilters")[1].split("]")[0] for c in asked)


def test_all_lists_are_exact(spark, index, tmp_path):
    built = ann.build(index, f"{tmp_path}/a", lists=30)
    asks = table(spark, grouped(40, seed=9)).withColumnRenamed("chunk_id", "question_id")
    key = lambda df: sorted(tuple(r[c] for c in ("question_id", "chunk_id", "cosine", "cosine_rank")) for r in df.collect())
    assert key(built.search(asks, 7, probes=30)) == key(retrieval.candidates(asks, index, 7)) == key(built.search(asks, 7, probes=30, block=11)) == key(retrieval.candidates(asks, index, 7, block=9))


def test_copies_become_several_files(spark, tmp_path):
    v = np.concatenate([np.tile(grouped(1), (900, 1)), grouped(300, seed=3)])
    built = ann.build(table(spark, v), f"{tmp_path}/a", file_rows=100)
    per = {}
    for r in built.rows.groupBy("list", F.input_file_name().alias("f")).count().collect():
        per.setdefault(r["list"], []).append(r["count"])
    hot = max(per.values(), key=sum)
    assert sum(hot) >= 900 and len(hot) >= 9 and max(hot) <= 100


def test_odd_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0]), (None, [0.0, 1.0]), (1, [1.0, 0.0])]
    index = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    built = ann.build(index, f"{tmp_path}/a")
    asks = spark.createDataFrame([(7, [2.0, 0.0]), (8, None), (9, [1.0, 2.0, 3.0])], "question_id long, vector array<float>")
    got = built.search(asks, 9, probes=99).collect()
    assert sorted((r.question_id, r.cosine_rank, r.cosine) for r in got) == [(7, 1, 1.0), (7, 2, 1.0), (7, 3, 0.0), (7, 4, 0.0)]
    none = ann.build(index.limit(0), f"{tmp_path}/b")
    assert none.search(asks, 3).count() == 0 and built.search(asks.limit(0), 3).count() == 0


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.01"
    assert shares(QUERIES["ann_topk"](spark, d), QUERIES["vector_topk"](spark, d)) >= 0.9


def test_plan_of_exact_search_does_not_grow_with_the_questions(spark, index):
    asks = table(spark, grouped(60, seed=5)).withColumnRenamed("chunk_id", "question_id")
    plan = retrieval.candidates(asks, index, 3, block=5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Scan parquet") == 12
