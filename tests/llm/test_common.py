import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from passagecraft.llm import common


@pytest.mark.parametrize("n_keys", [0, 1, 40, 5000])
def test_parted_loses_nothing(spark, n_keys):
    rnd = random.Random(n_keys)
    ids = [rnd.randrange(1 << 40) - (1 << 39) for _ in range(6000)] + [None, None]
    docs = spark.createDataFrame([Row(doc_id=i, bitmap_number="clash", bitmap_bits=str(i)) for i in ids], "doc_id long, bitmap_number string, bitmap_bits string")
    some = set(ids[:n_keys]) | ({None} if n_keys == 40 else set())
    keys = spark.createDataFrame([(k,) for k in some], "key long")
    sure, rest = common.parted(docs, docs["doc_id"], keys, len(some))
    assert sure.columns == rest.columns == docs.columns
    a, b = ([r.doc_id for r in x.collect()] for x in (sure, rest))
    assert sorted(a + b, key=str) == sorted(ids, key=str) and not some & set(a)
    assert len(b) <= 1.15 * len(some) + 1


def test_parted_by_text(spark):
    docs = spark.createDataFrame([(str(i),) for i in range(1000)], "text string")
    sure, rest = common.parted(docs, F.md5(docs["text"]), docs.limit(10).select(F.md5("text").alias("key")), 10)
    assert sure.count() + rest.count() == 1000 and 10 <= rest.count() <= 20


def test_tables_and_folders(spark):
    t = common.Tables()
    df = t.keep(spark.range(3).toDF("x"), "some")
    path = t.paths[0][1].removeprefix("file://")
    assert df.count() == 3 and path.startswith(common.shared_dir(spark).removeprefix("file://"))
    t.release()
    import os

    assert not os.path.exists(path)
    assert common.unused(spark.createDataFrame([(1, 2)], "A int, a_ int"), "a") == "a__"
