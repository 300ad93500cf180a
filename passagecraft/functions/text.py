"""Text and number functions: white space, rounding and names as the data model defines them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(c: Column, made: Callable[[Column], Column]) -> Column:
    """made(c), where c is computed once, however often it is used."""
    return F.transform(F.array(c), lambda x: made(x))[0]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def title_case(c: Column) -> Column:
    """Each run of letters with a case begins with a capital and goes on in lower case; digits and apostrophes end a run, too."""
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]+"
    runs = F.regexp_extract_all(c, F.lit(rf"{cased}|{cased.replace('[', '[^', 1)}"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def or_default(c: Column, default: Column | str) -> Column:
    """The default where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounded to the nearest, ties to the even digit."""
    return F.bround(c, digits) if digits else F.rint(c)


def upper_median(values: Column) -> Column:
    """The middle one of sorted values, of two the upper."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def safe_name(name: Column) -> Column:
    """A corpus name for collections: alphanumeric runs joined by underscores, lower case, 24 characters at most."""
    cleaned = F.lower(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))
    return F.substring(or_default(cleaned, "corpus"), 1, 24)


def model_tag(model: Column) -> Column:
    """The last part of a model's path, alphanumeric only, 14 characters at most."""
    last = F.element_at(F.split(F.lower(model), "/"), -1)
    return F.substring(F.regexp_replace(last, "[^a-z0-9]+", ""), 1, 14)


def collection_name(corpus: Column, model: Column, slug: Column) -> Column:
    return F.concat_ws("_", safe_name(corpus), model_tag(model), slug)


def citation_label(title: Column, document_id: Column, section: Column, page: Column) -> Column:
    """title > section > p.N, without the parts that are missing."""
    return F.concat_ws(" > ", or_default(title, document_id), F.nullif(section, F.lit("")), F.concat(F.lit("p."), page.cast("string")))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
