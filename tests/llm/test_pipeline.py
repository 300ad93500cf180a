import random

import public_tokenizers
from pyspark.sql import Row
from test_langid import SYLLABLES
from test_tokens import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(8)

    def text(lang, n):
        return " ".join("".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 4))) for _ in range(n))

    rows = []
    for i in range(240):
        lang = ["en", "de", "fr", "es"][i % 4]
        t = text(lang, rnd.randint(20, 120))
        rows.append(Row(doc_id=i, text=t, lang=lang, source=f"s{i % 3}", n_chars=len(t)))
    rows += [Row(doc_id=1000 + i, text=rows[0].text, lang="en", source="s0", n_chars=0) for i in range(30)]
    rows += [Row(doc_id=2000, text="12 34", lang="en", source="s0", n_chars=5), Row(doc_id=2001, text=None, lang=None, source=None, n_chars=None)]
    rows += [Row(doc_id=3000, text=rows[4].text + " write to bob@corp.example.com soon", lang="en", source="s1", n_chars=0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "sequences"]
    docs, seen = df, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == df.columns
    kept = {r.doc_id for r in seen[0]}
    assert kept == {r.doc_id for r in rows} - {2000, 2001}
    assert {r.doc_id for r in seen[1]} == {i for i in kept if i < 1000 or i == 3000} and len(seen[1]) == 241
    mail = next(r for r in seen[2] if r.doc_id == 3000)
    assert "<EMAIL>" in mail.text and "bob@" not in mail.text and mail.n_chars == len(mail.text)
    sizes = {s: sum(len(r.text.split()) for r in seen[3] if r.source == s) for s in ("s0", "s1", "s2")}
    assert sizes["s0"] > 1.5 * sizes["s1"] > 1.5 * sizes["s2"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    copies = {}
    for r in seen[3]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    texts = {r.doc_id: r.text for r in seen[3]}
    total = sum(copies[d] * (len(tok.encode(t, add_special_tokens=False).ids) + 1) for d, t in texts.items())
    assert sum(p.length for p in seen[4]) == total
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
    assert check_pieces  # pieces are checked one by one in test_tokens
