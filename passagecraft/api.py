"""The engine in three calls: ingest a corpus, ask it questions, evaluate it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagecraft.functions.text import collection_name
from passagecraft.operators import answering, chunking, embedding, evaluation, index, retrieval
from passagecraft.schema import SWEEP, ChunkConfig, RetrievalParams
from passagecraft.sources import files


def ingest(spark: SparkSession, root: str, store: str, cfg: ChunkConfig = ChunkConfig(), corpus_id: str = "default", embedder: embedding.Embedder = embedding.hashed_words, model: str = "hashed-words") -> DataFrame:
    """Reads, cuts, embeds and stores a corpus; a row for each document with its chunks. Raises if there is nothing to store, or if documents share an id; the collection is as before then."""
    docs = files.read_corpus(spark, root, corpus_id)
    if docs.isEmpty():
        raise ValueError(f"no documents below {root}")
    index.write(index.build(chunking.chunk(docs, cfg), model, embedder), store)
    stored = index.read(spark, store, corpus_id, cfg, model)
    return stored.groupBy("document_id", "relpath").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_chars").alias("n_chars"))


def as_questions(spark: SparkSession, questions: str | Iterable[str] | DataFrame) -> DataFrame:
    if isinstance(questions, DataFrame):
        return questions
    listed = [questions] if isinstance(questions, str) else list(questions)
    return spark.createDataFrame(list(enumerate(listed, 1)), "question_id long, question string")


def ask(
    spark: SparkSession, questions: str | Iterable[str] | DataFrame, store: str, cfg: ChunkConfig = ChunkConfig(), corpus_id: str = "default", params: RetrievalParams = RetrievalParams(),
    embedder: embedding.Embedder = embedding.hashed_words, model: str = "hashed-words", scorer: embedding.Scorer | None = None,
    providers: answering.Providers | None = None, provider: str | None = None, force_extractive: bool = False, where: Column | str | None = None, calls: answering.Calls = answering.Calls(),
) -> DataFrame:
    """An answer for each question, from the chunks for which ``where`` holds."""
    asks = as_questions(spark, questions).withColumn("vector", embedding.embed_query(F.col("question"), embedder, model))
    name = spark.range(1).select(collection_name(F.lit(corpus_id), F.lit(model), F.lit(cfg.slug))).first()[0]
    hits, decisions = retrieval.retrieve(asks, index.read(spark, store, corpus_id, cfg, model), params, scorer, name, where)
    return answering.answer(hits, decisions, providers, provider, force_extractive, calls=calls)


def hits(spark: SparkSession, questions: str | Iterable[str] | DataFrame, store: str, cfg: ChunkConfig = ChunkConfig(), corpus_id: str = "default", params: RetrievalParams = RetrievalParams(), where: Column | str | None = None) -> DataFrame:
    """The passages that answers are made from."""
    asks = as_questions(spark, questions).withColumn("vector", embedding.embed_query(F.col("question")))
    return retrieval.retrieve(asks, index.read(spark, store, corpus_id, cfg), params, where=where)[0]


def ranks(spark: SparkSession, gold: DataFrame, store: str, cfg: ChunkConfig = ChunkConfig(), corpus_id: str = "default", params: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Per gold question its kind, the ranks of what it looks for, and whether it was answered."""
    asks = gold.select("question_id", "question").withColumn("vector", embedding.embed_query(F.col("question")))
    found, decisions = retrieval.retrieve(asks, index.read(spark, store, corpus_id, cfg), params)
    return evaluation.gold_ranks(gold, found).join(decisions.select("question_id", "grounded"), "question_id").select("question_id", "kind", "expect_rank", "current_rank", "stale_rank", "grounded")


def evaluate(spark: SparkSession, gold: DataFrame, root: str, store: str, configs: Iterable[ChunkConfig] = SWEEP, corpus_id: str = "default", params: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Quality of each configuration on gold(question_id, question, kind, …) with its number of chunks, best first; builds the indexes."""
    rows = None
    for nth, cfg in enumerate(configs):
        n_chunks = ingest(spark, root, store, cfg, corpus_id).agg(F.sum("n_chunks")).first()[0]
        one = evaluation.summary(ranks(spark, gold, store, cfg, corpus_id, params), params.top_k)
        one = one.withColumns({"chunk_slug": F.lit(cfg.slug), "n_chunks": F.lit(n_chunks), "position": F.lit(nth)})
        rows = one if rows is None else rows.unionByName(one)
    return rows.orderBy(F.desc("mrr"), F.desc("hit_at_k"), "position")


def scores(spark: SparkSession, gold: DataFrame, store: str, cfg: ChunkConfig = ChunkConfig(), corpus_id: str = "default", params: RetrievalParams = RetrievalParams(min_cosine=0, min_rerank=0)) -> DataFrame:
    """Per gold question whether it has an answer, and its best cosine and rerank score."""
    found = hits(spark, gold.select("question_id", "question"), store, cfg, corpus_id, params)
    return evaluation.measured(found, gold.select("question_id", (F.col("kind") != "unanswerable").alias("positive"))).orderBy(F.desc("rerank"))


def calibrate(spark: SparkSession, gold: DataFrame, store: str, cfg: ChunkConfig = ChunkConfig(), corpus_id: str = "default", params: RetrievalParams = RetrievalParams(min_cosine=0, min_rerank=0)) -> DataFrame:
    """For cosine and rerank: the threshold that best tells answerable questions from others, and how many it keeps and refuses."""
    made = scores(spark, gold, store, cfg, corpus_id, params)
    best = [evaluation.best_threshold(evaluation.threshold_sweep(made, c)).withColumn("score", F.lit(c)) for c in ("cosine", "rerank")]
    return best[0].unionByName(best[1])
