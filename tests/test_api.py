import pytest

from passagecraft import __main__ as cli
from passagecraft import api
from passagecraft.operators import answering, embedding, index
from passagecraft.schema import ChunkConfig, RetrievalParams
from passagecraft.sources import files
from passagecraft.streaming import ingest

GOLD = """
- {id: 1, question: what is the storage fee for boxes, kind: superseded, current_text: [twelve coins], stale_text: [seven coins]}
- {id: 2, question: when does the gate open in winter, kind: answerable, expect_doc: HOURS, expect_text: [nine]}
- {id: 3, question: zebra quantum chromodynamics, kind: unanswerable}
"""


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "rules").mkdir(parents=True)
    (root / "changes").mkdir()
    (root / "rules" / "base.md").write_text("---\ntitle: Rules\ndocument_id: BASE\neffective_date: 2024-01-01\n---\n# Storage\n\nThe storage fee for boxes is seven coins a week.\n\n# Damage\n\nTell the office of damage.\n")
    (root / "changes" / "one.md").write_text("---\ntitle: Change one\ndocument_id: CHANGE-1\neffective_date: 2025-01-01\n---\n# Storage\n\nThe storage fee for boxes is twelve coins a week.\n")
    (root / "changes" / "hours.html").write_text("<html><head><title>Hours</title></head><body><nav>menu</nav><main><h1>Gate</h1><p>In winter the gate does open at nine.</p></main></body></html>")
    return str(root)


def test_end_to_end(spark, corpus, tmp_path):
    store = str(tmp_path / "store")
    report = api.ingest(spark, corpus, store)
    assert {r.document_id for r in report.collect()} == {"BASE", "CHANGE-1", "HOURS"}
    got = api.ask(spark, "what is the storage fee for boxes", store, params=RetrievalParams(min_cosine=0.2)).first()
    assert got.mode == "extractive" and got.citations[0].document_id == "CHANGE-1" and got.diagnostics.collection == "default_hashedwords_recursive_800_150"
    assert api.ask(spark, ["zebra"], store).first().mode == "abstained"
    gold = files.read_questions(spark, GOLD).withColumnRenamed("id", "question_id")
    best = api.evaluate(spark, gold, corpus, store, (ChunkConfig(), ChunkConfig("fixed", 300, 0)), params=RetrievalParams(min_cosine=0.2)).collect()
    assert [r.chunk_slug for r in best] == ["recursive_800_150", "fixed_300_0"] and best[0].hit_at_k == 1 and best[0].current_wins == 1 and best[0].abstain_rate == 1
    assert {r.score for r in api.calibrate(spark, gold, store).collect()} == {"cosine", "rerank"}
    assert cli.main(["--store", store, "status"]) == 0 and cli.main(["--store", store, "ask", "storage fee", "--min-cosine", "0.1"]) == 0
    questions = tmp_path / "gold.yaml"
    questions.write_text(GOLD)
    assert cli.main(["--store", store, "eval", corpus, "--questions", str(questions), "--detail"]) == 0
    assert cli.main(["--store", store, "calibrate", "--questions", str(questions), "--detail"]) == 0
    assert cli.main(["--store", store, "--corpus", "nobody", "calibrate", "--questions", str(questions)]) == 1
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        api.ingest(spark, str(tmp_path / "none"), store)


def test_streaming(spark, corpus, tmp_path):
    out, state = str(tmp_path / "stream"), str(tmp_path / "state")
    ingest.ingest(spark, corpus, out, state).awaitTermination(120)
    n = spark.read.parquet(out).count()
    ingest.ingest(spark, corpus, out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == n >= 3


def test_rebuilding_takes_the_place_of_the_old_collection(spark, corpus, tmp_path):
    store = str(tmp_path / "store")
    held = lambda corpus_id="default": {(r.document_id, r.doc_type) for r in index.read(spark, store, corpus_id, ChunkConfig()).collect()}
    api.ingest(spark, corpus, store)
    api.ingest(spark, corpus, store, corpus_id="other")
    assert held() == {("BASE", "rules"), ("CHANGE-1", "changes"), ("HOURS", "changes")}
    (tmp_path / "corpus" / "rules" / "base.md").unlink()  # the last document of its type
    api.ingest(spark, corpus, store)
    assert held() == {("CHANGE-1", "changes"), ("HOURS", "changes")} and len(held("other")) == 3
    assert not [p for p in (tmp_path / "store").iterdir() if "staged" in p.name]
    # two documents of one id: an error, and what was there stays
    (tmp_path / "corpus" / "rules" / "again.md").write_text("---\ndocument_id: HOURS\n---\nother text")
    with pytest.raises(ValueError, match="share an id"):
        api.ingest(spark, corpus, store)
    assert held() == {("CHANGE-1", "changes"), ("HOURS", "changes")}
    assert index.drop_corpus(spark, store, "other") and len(held("other")) == 0


def test_files_that_cannot_be_read(spark, corpus, tmp_path):
    (tmp_path / "corpus" / "rules" / "bad.md").write_text("---\na: [1\n---\ntext")
    (tmp_path / "corpus" / "rules" / "bad.pdf").write_bytes(b"no pdf")
    assert {r.path.rsplit("/", 1)[1] for r in files.failures(spark, corpus).collect()} == {"bad.md", "bad.pdf"}
    assert {r.document_id for r in files.read_corpus(spark, corpus).collect()} == {"BASE", "CHANGE-1", "HOURS"}


def test_back_ends(spark, corpus, tmp_path, capsys):
    store = str(tmp_path / "store")
    api.ingest(spark, corpus, store)

    def down():
        raise OSError("no server")

    said = answering.Providers({"other": down, "third": lambda: answering.ProviderStatus(False, "no model")}, {"mine": "small"}, mine=lambda prompts, model="small": [f"Twelve coins [1] by {model}." for _ in prompts], other=None, third=None)
    assert [said.status(n) for n in ("mine", "other", "third", "none")] == [answering.ProviderStatus(True, "mine is ready"), answering.ProviderStatus(False, "other: no server"), answering.ProviderStatus(False, "no model"), answering.ProviderStatus(False, "none is unknown")]
    assert cli.main(["--store", store, "ask", "storage fee for boxes", "--min-cosine", "0.1", "--model", "large", "--provider", "mine", "--show-chunks"], said) == 0
    out = capsys.readouterr().out
    assert "Twelve coins [1] by large." in out and "cosine" in out
    assert cli.main(["--store", store, "status"], said) == 0
    assert "* mine" in capsys.readouterr().out
    assert api.ask(spark, "storage fee for boxes", store, params=RetrievalParams(min_cosine=0.1), providers=said, provider="third").first().mode == "extractive"


def test_embedders():
    calls = []

    def post(model, texts):
        calls.append((model, len(texts)))
        return reversed([(i, [float(len(t)), 1.0]) for i, t in enumerate(texts)])

    made = embedding.Hosted(post, "m", 2, batch=3)(["a", "bb", "", "dddd"])
    assert made.tolist() == [[1, 1], [2, 1], [0, 1], [4, 1]] and calls == [("m", 3), ("m", 1)]
    assert embedding.Hosted(post, "m", 2)([]).shape == (0, 2)
    with pytest.raises(ValueError):
        embedding.Hosted(lambda m, t: [(0, [1.0])], "m", 1)(["a", "b"])
    loads = []
    for _ in range(2):
        embedding.Loaded("some-model", lambda name: loads.append(name) or (lambda texts: [[1.0]] * len(texts)))(["x"])
    assert loads == ["some-model"]
