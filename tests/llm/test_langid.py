import random
import zlib

from pyspark.sql import Row
from pyspark.sql import functions as F

from passagecraft.llm import langid

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "en er ch ei un sch ge ie te ich", "fr": "ou eau re ai le tion eux an que é", "es": "ción as os ar la do ra el ie ue", "qq": "xz zx qk kq vz zv", "ru": "ст но ен то на ов ни ра во ко"}


def corpus(n=900, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        text = " ".join("".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 80)))
        out.append(Row(doc_id=i, text=text, lang=lang, predicted="x"))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows)
    model = langid.fit(df, max_labelled=500)
    assert model.families == ["germanic", "other", "romance", "slavic"] and len(model.pairs) == 2
    got = langid.identify(df, model).select("doc_id", "lang", "text", langid.held_out(F.col("doc_id")).alias("h"), "predicted.*").toDF("doc_id", "lang", "text", "h", "pred", "score").collect()
    for r in got:
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.h and len(r.text) > 30]
    assert sum(r.lang == r.pred for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_read(spark):
    rows = corpus(300)
    df = spark.createDataFrame(rows)
    changed = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("ru")).otherwise(F.col("lang")))
    a, b = (langid.fit(x, 200) for x in (df, changed))
    assert (a.weights == b.weights).all() and a.langs == b.langs


def test_odd_texts(spark):
    model = langid.fit(spark.createDataFrame(corpus(200)), 200)
    texts = [None, "", "1234 .!", "the", "x" * 3_000_000, "the the", "the the", "\U00010400", "𝟘 \ud800".encode("utf-8", "replace").decode()]
    df = spark.createDataFrame([Row(doc_id=None, text=t, source="s") for t in texts], "doc_id long, text string, source string")
    got = langid.identify(df, model).collect()
    assert [r.predicted.lang == "und" for r in got] == [True, True, True, False, False, False, False, False, True]
    assert got[5].predicted == got[6].predicted and got[0].predicted.score == 0
    none = langid.identify(df, langid.fit(df.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.predicted.lang for r in none.collect()} == {"und"}
    one = langid.fit(spark.createDataFrame([(1, "hello there", "en")], "doc_id long, text string, lang string"))
    assert langid.identify(df, one).collect()[3].predicted.lang == "en"


def test_pieces_of_a_long_text_add_up(monkeypatch):
    text = "abc dé, f" * 50
    whole = langid.ngram_shares(text)
    monkeypatch.setattr(langid, "_CHUNK", 7)
    assert abs(langid.ngram_shares(text) - whole).max() < 1e-6
