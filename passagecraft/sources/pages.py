"""Paged text: headings from layout, and pages joined to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagecraft.functions.text import bound, is_blank, strip

# Running headers, words that open a structural heading, and the shapes of headings.
NOISE = r"^\s*(?i:Page\s+\d+\s+of\s+\d+|\d+\s*/\s*\d+)\s*$"
STRUCTURAL_WORDS = ("PART", "SECTION", "CHAPTER", "ARTICLE", "ANNEXURE", "ANNEX", "APPENDIX", "SCHEDULE", "CLAUSE", "EXHIBIT", "TITLE", "DIVISION", "MODULE")
STRUCTURAL = rf"^(?:{'|'.join(STRUCTURAL_WORDS)})\s*[-–—:]?\s*(?:[IVXLC]+|[A-Z]|\d{{1,3}})\b"
CAPITALS = r"^[A-Z][A-Z &,\-'/()0-9.]{5,60}$"
NUMBERED = r"^(\d{1,2}(?:\.\d{1,2})*)\.?\s+([A-Z].{2,})$"
SHORT_LINE, LONGEST_LABEL = 80, 60


def promote_line(line: Column) -> Column:
    """A line of layout text as Markdown: headings marked, running headers emptied, others as they are."""

    def shortened(label: Column) -> Column:
        cut = F.concat(F.regexp_replace(F.substring(label, 1, LONGEST_LABEL - 3), r"(?U)\s+\z", ""), F.lit("..."))
        return F.when(F.length(label) <= LONGEST_LABEL, label).otherwise(cut)

    def told(s: Column) -> Column:
        number, label = F.regexp_extract(s, NUMBERED, 1), bound(strip(F.regexp_extract(s, NUMBERED, 2)), shortened)
        return (
            F.when((s == "") | s.rlike(NOISE), F.lit(""))
            .when((F.length(s) < SHORT_LINE) & (s.rlike(STRUCTURAL) | s.rlike(CAPITALS)), F.concat(F.lit("\n## "), s, F.lit("\n")))
            .when(s.rlike(NUMBERED), F.concat(F.lit("\n### "), number, F.lit(". "), label, F.lit("\n\n"), s))
            .otherwise(line)
        )

    return bound(strip(line), told)


def promote(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), promote_line), "\n")


def join_pages(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """pages(key, page_no, raw_text) to key, text, page_breaks: pages with text, in order, two line ends between them.

    Offsets are running sums within a document; a document's pages meet in one row, which is what a document is.
    """
    made = pages.withColumn("_t", strip(promote(strip(F.coalesce("raw_text", F.lit("")))))).where(~is_blank(F.col("_t")))
    start = F.coalesce(F.sum(F.length("_t") + 2).over(W.partitionBy(key).orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("page_no").cast("int").alias("page"), F.col("start"), F.col("_t"))))
    rows = made.withColumn("start", start).groupBy(key).agg(ordered.alias("p"))
    return rows.select(key, F.array_join(F.col("p._t"), "\n\n").alias("text"), F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["page"].alias("page"))).alias("page_breaks"))
