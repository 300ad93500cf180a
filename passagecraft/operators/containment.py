"""Which of many needles stand in which of many texts, case aside."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .embedding import kept as kept_in_worker
from .storage import kept, scratch

#: Characters of needles that one automaton holds, about: it takes some forty bytes for each.
NEEDLE_CHARS = 1 << 21


def automaton(needles: list[str]):
    """Finds all needles in one look at a text, whatever their number; their places in the list are what it gives."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, n in enumerate(needles):
        found.add_word(n, i)
    found.make_automaton()
    return found


def _finder(name: str, needles, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept_in_worker(name, lambda: automaton(needles.value))  # made once a worker
        for batch in batches:
            ids, found = [], []
            for nth, text in enumerate(batch.column(1)):
                for n in {i for _, i in machine.iter(text.as_py())}:
                    ids.append(nth)
                    found.append(needles.value[n])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())).cast(kind), pa.array(found, pa.string())], ["doc_id", "needle"])

    return run


def contained(needles: DataFrame, texts: DataFrame, chars: int = NEEDLE_CHARS) -> DataFrame:
    """needle_id, doc_id of each pair of needles(needle_id, needle) and texts(doc_id, text) where the needle stands in the text, once.

    Different needles go in blocks of about ``chars`` characters, by a hash; each block is one automaton a worker and one
    look at the texts, in time linear in a text and what is found. Rows with a null needle or text are in no pair; an
    empty needle is in every text. Repeated rows are pairs of their own.
    """
    spark = texts.sparkSession
    lower = kept(needles.where("needle is not null").select("needle_id", F.lower("needle").alias("needle")), "needles")
    distinct = lower.where("needle != ''").select("needle").distinct()
    total = distinct.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()[0]
    blocks = -(-total // chars)
    some = texts.where("text is not null").select("doc_id", F.lower("text").alias("text"))
    kind = texts.schema["doc_id"].dataType
    found = some.select("doc_id", F.lit("").alias("needle")) if not lower.where("needle = ''").isEmpty() else None
    for b in range(blocks):
        own = sorted(r.needle for r in distinct.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).collect())  # about ``chars`` characters
        shared = spark.sparkContext.broadcast(own)
        part = some.mapInArrow(_finder(scratch(spark, "automaton"), shared, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, needle string")
        part = kept(part, "contained") if blocks > 1 else part
        if blocks > 1:
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = some.select("doc_id", F.lit("").alias("needle")).limit(0)
    return found.join(lower, "needle").select("needle_id", "doc_id")
