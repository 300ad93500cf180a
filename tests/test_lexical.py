import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagecraft.operators import lexical


def plain(docs, questions, k):
    """BM25 by loops over all documents."""
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    average = max(sum(map(len, words.values())) / max(1, len(docs)), 1e-9)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in questions:
        asked = set(re.findall(r"[^\W_]+", (text or "").lower()))
        found = []
        for i, ws in words.items():
            tf = Counter(ws)
            if asked & set(ws):
                idf = {w: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) for w in asked & set(ws)}
                found.append((-round(sum(idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average)) for w in sorted(idf)), 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def said(df):
    return sorted((r.question_id, r.chunk_id, r.score, r.lexical_rank) for r in df.collect())


def tables(spark, docs, questions):
    return spark.createDataFrame(docs, "chunk_id long, text string").repartition(4), spark.createDataFrame(questions, "question_id long, question string")


@pytest.mark.parametrize("k, block", [(1, 4096), (5, 16), (1000, 16)])
def test_against_a_plain_search(spark, tmp_path, k, block):
    rnd = random.Random(k)
    usual, rare = ["the", "of", "and", "to"], [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choice(usual if rnd.random() < 0.7 else rare) for _ in range(rnd.randrange(80)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # copies: ties
    questions = [(i, " ".join([rnd.choice(rare), *rnd.sample(usual, 3), rnd.choice(rare)])) for i in range(25)] + [(90, "the THE the"), (91, "unknown"), (92, None), (93, "the of and to")]
    d, q = tables(spark, docs, questions)
    built = lexical.build(d.withColumn("term", F.lit("own")), f"{tmp_path}/a", block)
    assert said(built.search(q, k)) == plain(docs, questions, k)
    sizes = [r.n for r in built.postings.select(F.size("postings").alias("n")).collect()]
    assert max(sizes) <= 2 * block + 40


def test_odd_tables(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "É ß \U0001f600 x_y"), (4, "w " * 200_000), (5, "ß")]
    questions = [(1, "ß w é"), (None, "x"), (2, "")]
    d, q = tables(spark, docs, questions)
    built = lexical.build(d, f"{tmp_path}/a")
    assert said(built.search(q.where("question_id is not null"), 9)) == plain(docs, questions[:1], 9)
    assert built.search(q.limit(0), 9).count() == 0
    assert lexical.build(d.limit(0), f"{tmp_path}/b").search(q, 9).count() == 0
    assert lexical.build(d.where("chunk_id < 3"), f"{tmp_path}/c").search(q, 9).count() == 0


def test_only_the_folders_of_a_question_are_read(spark, tmp_path):
    d, q = tables(spark, [(i, f"alone{i} shared") for i in range(200)], [(1, "alone7")])
    built = lexical.build(d, f"{tmp_path}/a")
    asked = built.postings.where(F.col("folder") == lexical._folder(F.lit("alone7")))
    assert "PartitionFilters: [isnotnull(folder" in asked._jdf.queryExecution().executedPlan().toString()
    assert [(r.chunk_id, r.lexical_rank) for r in built.search(q, 3).collect()] == [(7, 1)]


def test_postings_are_moved_once(spark, tmp_path):
    docs = [(i, " ".join(f"w{(i * j) % 97}" for j in range(60))) for i in range(400)]
    d, q = tables(spark, docs, [(1, "w3 w5 w90")])
    built = lexical.build(d, f"{tmp_path}/a", 64)
    packed = built.postings.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("postings")).alias("n")).first()
    assert packed.n == sum(len(set(t.split())) for _, t in docs)
    assert built.postings.where("size(tf) != size(postings) or size(length) != size(postings)").count() == 0
    # a row holds a term's documents of a whole block, so far fewer rows than postings are shuffled
    assert packed.rows * 20 < packed.n
    assert said(built.search(q, 7)) == plain(docs, [(1, "w3 w5 w90")], 7)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "question_id long, chunk_id long, x int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 10, 2)], "question_id long, chunk_id long, y int")
    got = lexical.fused([(a, "x"), (b, "y")], 2).collect()
    tie = round(1 / 61 + 1 / 62, 9)
    assert sorted((r.question_id, r.fusion_rank, r.chunk_id, r.fusion) for r in got) == [(1, 1, 10, tie), (1, 2, 11, tie), (2, 1, 10, round(1 / 61, 9))]
