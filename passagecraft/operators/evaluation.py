"""Retrieval quality over gold questions, and calibration of the gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Configurations that one call tells apart.
MOST_CONFIGS = 1000


def holds_all(text: Column, needles: Column) -> Column:
    """Whether each needle is in the text, case aside; none are always there."""
    return F.forall(F.coalesce(needles, F.array().cast("array<string>")), lambda n: F.contains(F.lower(text), F.lower(n)))


def first_rank(document_id: Column, text: Column, rank: Column, needles: Column, doc: Column) -> Column:
    """Aggregate: the best rank of a hit with all needles, in the document if one is named."""
    return F.min(F.when(holds_all(text, needles) & (doc.isNull() | (doc == document_id)), rank))


def gold_ranks(gold: DataFrame, hits: DataFrame, *by: str) -> DataFrame:
    """gold questions and, of hits(question_id, rank, document_id, text), expect_rank, current_rank and stale_rank.

    The alternatives of stale_text are tried in order: the first that is found at all says the rank. Questions without
    hits stay, with null ranks. ``by`` are more columns that hits are told apart by, such as a configuration.
    """
    keys = ["question_id", *by]
    g = gold.select("question_id", "expect_doc", "expect_text", "current_doc", "current_text", "stale_doc", "stale_text")
    at = F.col("document_id"), F.col("text"), F.col("rank")
    alternatives = F.transform(F.coalesce("stale_text", F.array().cast("array<string>")), lambda n, i: F.struct(i.alias("i"), holds_all(F.col("text"), F.array(n)).alias("has")))
    of_stale = F.col("stale_doc").isNull() | (F.col("stale_doc") == F.col("document_id"))
    named = F.filter(alternatives, lambda a: a["has"])
    joined = hits.select(*keys, "rank", "document_id", "text").join(g, "question_id").withColumn("_stale", F.when(of_stale, F.transform(named, lambda a: F.struct(a["i"].alias("i"), F.col("rank").alias("rank")))))
    one = joined.groupBy(*keys).agg(
        first_rank(*at, F.col("expect_text"), F.col("expect_doc")).alias("expect_rank"),
        first_rank(*at, F.col("current_text"), F.col("current_doc")).alias("current_rank"),
        F.min(F.array_min("_stale"))["rank"].alias("stale_rank"),
    )
    wanted = gold
    if by:  # every question under every configuration, of which there are few
        found = hits.select(*by).distinct().limit(MOST_CONFIGS + 1)
        rows = found.collect()
        if len(rows) > MOST_CONFIGS:
            raise ValueError(f"more than {MOST_CONFIGS} configurations")
        each = F.array(*[F.struct(*[F.lit(r[c]).cast(found.schema[c].dataType).alias(c) for c in by]) for r in rows]) if rows else None
        wanted = gold.select("*", F.inline(each)) if rows else gold.join(found, F.lit(False))
    return wanted.join(one, keys, "left")


def current_wins() -> Column:
    """Whether the current passage is found, and before any stale one."""
    c, s = F.col("current_rank"), F.col("stale_rank")
    return c.isNotNull() & (s.isNull() | (c < s))


def summary(scored: DataFrame, k: int = 5, *by: str) -> DataFrame:
    """hit_at_k, mrr, current_wins, abstain_rate of gold_ranks() with kind and grounded; shares of no questions are null."""
    answerable, superseded, hopeless = (F.col("kind") == x for x in ("answerable", "superseded", "unanswerable"))
    rank = F.when(answerable, F.col("expect_rank")).when(superseded, F.col("current_rank"))
    rank = F.when(rank <= k, rank)
    gold = answerable | superseded
    share = lambda ok: F.avg(ok.cast("double"))
    return (scored.groupBy(*by) if by else scored.groupBy()).agg(
        F.count(F.when(gold, 1)).alias("n_gold"),
        share(F.when(gold, rank.isNotNull())).alias("hit_at_k"),
        F.avg(F.when(gold, F.coalesce(1.0 / rank, F.lit(0.0)))).alias("mrr"),
        share(F.when(superseded, current_wins())).alias("current_wins"),
        share(F.when(hopeless, ~F.col("grounded"))).alias("abstain_rate"),
    )


def best_config(results: DataFrame, position: str = "position") -> DataFrame:
    """The row of the best mrr, then hit_at_k; of equals the first."""
    return results.orderBy(F.desc("mrr"), F.desc("hit_at_k"), position).limit(1)


def measured(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question the best cosine and rerank score among its hits; 0 where it has none."""
    best = hits.groupBy("question_id").agg(F.max("cosine").alias("cosine"), F.max("rerank_score").alias("rerank"))
    return questions.join(best, "question_id", "left").fillna(0.0, ["cosine", "rerank"])


def threshold_sweep(scores: DataFrame, score: str = "score", steps: int = 100) -> DataFrame:
    """threshold, kept, refused, right for each cut point 0, 1/steps … 1 of scores(positive boolean, score).

    A score counts from the first cut point above it: scores are summed up by that, not met by every threshold, so the
    work is one pass whatever the number of scores.
    """
    spark = scores.sparkSession
    from pyspark.sql import Window as W

    i = F.ceil(F.col(score) * steps).cast("int")
    exact = F.when((i - 1) / F.lit(float(steps)) >= F.col(score), i - 1).when(i / F.lit(float(steps)) < F.col(score), i + 1).otherwise(i)
    # positives are kept up to the last threshold not above them, negatives refused from the first one above them
    reach = F.when(exact / F.lit(float(steps)) == F.col(score), exact).otherwise(exact - 1)
    per = scores.where(F.col(score).isNotNull()).groupBy(F.greatest(F.lit(-1), F.least(F.lit(steps), reach)).alias("reach")).agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("n"))
    cuts = spark.range(-1, steps + 1).select(F.col("id").cast("int").alias("reach")).join(per, "reach", "left").fillna(0, ["p", "n"])
    down, up = W.orderBy(F.desc("reach")), W.orderBy("reach").rowsBetween(W.unboundedPreceding, -1)
    made = cuts.select("reach", F.sum("p").over(down).alias("kept"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("refused"))
    return made.where("reach >= 0").select((F.col("reach") / F.lit(float(steps))).alias("threshold"), "kept", "refused", (F.col("kept") + F.col("refused")).alias("right"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("right"), "threshold").limit(1)


def distribution(scores: DataFrame, score: str = "score") -> DataFrame:
    """n, min, upper median and max of positives and negatives; the median by counts of equal scores, so no task holds all."""
    from pyspark.sql import Window as W

    per = scores.where(F.col(score).isNotNull()).groupBy("positive", F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("k"))
    side = W.partitionBy("positive")
    ranked = per.withColumn("upto", F.sum("k").over(side.orderBy("s"))).withColumn("all", F.sum("k").over(side))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("s")))
    return ranked.groupBy("positive").agg(F.sum("k").alias("n"), F.min("s").alias("min"), middle.alias("median"), F.max("s").alias("max"))


def overlap(scores: DataFrame, score: str = "score") -> DataFrame:
    """Whether positives and negatives overlap, and the band in which they do."""
    low, high = F.min(F.when(F.col("positive"), F.col(score))), F.max(F.when(~F.col("positive"), F.col(score)))
    return scores.agg((low <= high).alias("overlaps"), F.when(low <= high, low).alias("band_low"), F.when(low <= high, high).alias("band_high"))
