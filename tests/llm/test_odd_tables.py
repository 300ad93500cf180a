"""Every operator on nulls, repeated rows, a text of 10 MB, an empty table, and extra columns named like its own."""

import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from passagecraft.llm import boilerplate, langid, mixing, packing, pii, rules, simhash, tokencount, topk, warc
from passagecraft.llm.common import scratch

LONG = "Some words of mine, write to bob@corp.example.com. " * 200_000
TEXTS = [None, "", " \n", "One two three", "One two three", "1 2 3", LONG, "x", "É ß \U0001f600 \u0000 end"]
NAMES = (
    "predicted told words hashes windows lines stats rule kept base_failed key base terms pii_key pii_base pii_terms fp special again mix_key mix_rate mix_nth mix_size mix_copies mix_target "
    "mix_source_size own_mix_size rest salt bucket rank block data shard digest of bitmap_number bitmap_bits n won w least root score"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [Row(doc_id=i, text=t, lang=["en", "fr", None][i % 3], source=["a", None][i % 2]) for i, t in enumerate(TEXTS)]
    rows += [rows[3]] * 5 + [Row(doc_id=None, text="nobody's words", lang="en", source="b"), Row(doc_id=None, text=None, lang=None, source=None), Row(doc_id=4, text="another text under a known id", lang="en", source="a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def own_columns_are_there(df, names=NAMES):
    assert all(set(r) == {f"own {n}" for n in names} for r in df.select(*names).collect())


N = len(TEXTS) + 8


def test_language(spark, docs):
    for some in (docs, docs.limit(0)):
        got = langid.identify(some, langid.fit(docs), "found")
        own_columns_are_there(got)
        assert got.count() == some.count()
    got = corpus_pipeline.language(spark, docs, "")
    own_columns_are_there(got)
    assert got.columns == docs.columns and got.count() == N - 5  # two nulls, two without a character to see, one of digits
    one_id = docs.withColumn("doc_id", F.lit(1).cast("long")).withColumn("text", F.lit("the same words")).withColumn("lang", F.lit("en"))
    assert {r.predicted.lang for r in langid.identify(one_id, langid.fit(one_id, 4)).collect()} == {"en"}
    assert corpus_pipeline.language(spark, docs.limit(0), "").count() == 0


def test_near_duplicates(spark, docs):
    assert simhash.near_duplicates(docs).count() == N and simhash.near_duplicates(docs.limit(0)).count() == 0
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    own_columns_are_there(got)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:9]) for r in got.collect()) == sorted([("0", ""), ("3", "One two t"), ("4", "another t"), ("5", "1 2 3"), ("6", LONG[:9]), ("7", "x"), ("8", TEXTS[8][:9]), ("None", "nobody's ")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_personal_data(spark, docs):
    got = {r.doc_id: r for r in pii.report(docs).where("doc_id is not null and doc_id != 4").collect()}
    assert got[6].n_email == 200_000 and got[0].spans == ""
    clean = corpus_pipeline.personal_data(spark, docs, "")
    own_columns_are_there(clean)
    assert clean.columns == docs.columns and clean.count() == N
    assert "@" not in clean.where("doc_id = 6").first().text and clean.where("doc_id = 0").first().text is None
    assert pii.report(docs.limit(0)).count() == 0 and corpus_pipeline.personal_data(spark, docs.limit(0), "").count() == 0


def test_mixture(spark, docs):
    got = corpus_pipeline.mixture(spark, docs, "")
    own_columns_are_there(got)
    assert got.columns == docs.columns and mixing.allotment(docs).count() == N
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0


def test_packing_and_counts(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = corpus_pipeline.sequences(spark, docs, "")
    per = pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    counts = tokencount.count_tokens(docs, path).groupBy("doc_id").agg((F.sum("n_tokens") + F.count(F.lit(1))).alias("n")).collect()
    assert sorted(map(str, per)) == sorted(map(str, counts))
    assert tokencount.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).count() == N
    assert packing.pack(docs.limit(0), path).count() == 0 and tokencount.count_tokens(docs.limit(0), path).count() == 0


def test_rules(spark, docs):
    labels = spark.createDataFrame([(3, 0, "own label"), (6, 1, "own label"), (None, 1, ""), (4, None, "")], "doc_id long, quality int, label string")
    got = rules.assess(docs, rules.learn_from(docs, labels))
    own_columns_are_there(got, [n for n in NAMES if n not in ("stats", "rule", "kept", "base_failed")])
    assert got.count() == N and got.where("doc_id = 6").first().stats.n_words == 7 * 200_000
    assert rules.assess(docs.limit(0), rules.DecisionList()).count() == 0


def test_pages(spark, docs):
    pages = docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("http://x"))
    archive = warc.write_archive(pages, scratch(spark, "warc"))
    assert warc.read_archive(spark, archive, with_payload=False).count() == N
    got = pages.withColumn("main", boilerplate.extract("html"))
    own_columns_are_there(got)
    assert {r.page_id: len(r.main) for r in got.where("page_id in (0, 6)").collect()} == {0: 0, 6: len(LONG.strip())}


def test_search(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(None, [1.0, 1.0]), (5, None), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit("own") for n in NAMES})
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 3)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect() if r.query_id == 10) == [(10, 1, 19), (10, 2, 18), (10, 3, 17)]
