"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, unused

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
_FIGURES = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the document only: 52 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source of sized(source, size): source_size, target, rate.

    Sources in code point order, null last, weigh ``weights`` cyclically and share all words. No target passes
    ``max_repeats`` times its source; the excess goes to the others by weight. The fixed point of that resharing is
    a water level: with sources in order of capacity per weight, a source is full when its capacity is at most the
    level that the words left over by the fuller ones give. One row per source, so the windows here hold sources,
    never documents. A source without words has target 0 and rate 0.
    """
    cyc = F.array(*[F.lit(int(w)) for w in weights])
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    fuller = W.orderBy(F.col("cap") / F.col("weight"), F.col("nth")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    full = F.col("cap") <= F.col("weight") * F.col("level")
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cyc, (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(int(max_repeats)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(fuller), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(fuller), F.lit(0)))
        .withColumn("level", level)
        # the first source that isn't full sets the level of all the rest
        .withColumn("rest", F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(every))
        .withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest.level")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def with_copies(docs: DataFrame, seed: int = 17, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, size: Column | None = None) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies: floor(rate) copies, and one more with probability of the fraction.

    Rows with equal doc_id draw alike; a null doc_id draws by its text. Null text has size 0. An empty table gives no
    rows. Only doc_id, text and source are read; other columns pass through, save those four names, which are replaced.
    ``size`` gives the words of a document where they are known already. The sources' table has one row for each source.
    It is written first, so Spark knows its size before it joins: a small one goes to the documents where they lie.
    """
    docs = docs.drop(*_FIGURES)
    size = size_of(F.col("text")) if size is None else size
    key, rate = unused(docs, "mix_key"), unused(docs, "mix_rate")
    per = materialize(source_rates(docs.select("source", size.alias("size")), weights, max_repeats), "mix-rates")
    rates = per.select(F.col("source").alias(key), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias(rate))
    whole = F.floor(rate)
    extra = F.when(draw(F.col("doc_id"), F.col("text"), seed) < F.col(rate) - whole, 1).otherwise(0)
    return (
        docs.join(rates, docs["source"].eqNullSafe(rates[key]), "left")
        .withColumns({"mix_size": size, "mix_copies": (whole + extra).cast("long")})
        .drop(key, rate)
    )


def mix(docs: DataFrame, seed: int = 17, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix: every row of docs as often as with_copies() says, in the columns of docs, whatever their names.

    A row without words has no share in its source's target and is drawn like any other. Repeated rows draw alike. An
    empty table stays empty.
    """
    # a column of docs whose name is taken by the figures of the mix goes by another one meanwhile
    own = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in _FIGURES}
    some = with_copies(docs.withColumnsRenamed(own), seed, weights, max_repeats).where(F.col("mix_copies") > 0)
    nth = unused(some, "mix_nth")
    copies = some.withColumn(nth, F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int"))))
    return copies.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def allotment(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Per document of docs: doc_id, size, source_size, target, taken. Reads each text once: the sizes are kept as a table."""
    sized = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"), "source", size_of(F.col("text")).alias("_size"))
    kept = with_copies(materialize(sized, "mix-sizes", narrow=False), seed, size=F.col("_size"))
    return kept.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    )
