"""Personal data: patterns find entities, and corpus co-occurrence finds the terms that give them away.

A term discloses an entity by how much it says about it: the share of the texts with the term that hold the entity, too
(the posterior), against the entity's share of all texts. All documents count, and of each the whole text. The corpus
is the witness, never one text: a pair counts once a text, however often both stand in it, and copies and near copies of
a text are one witness. For that a text has SHAPES min-hashes of its shingles and, for each entity, the words around it: of a
pair's texts these are counted apart, and the least number of different ones is the number of witnesses, n. A pair needs
MIN_TEXTS of them; what two texts share by chance is told by the likelihood ratio (SIGNIFICANT); the posterior is smoothed
by n / (n + 1). A term over the posterior that tells enough of the entity's own information is generalised; one that names
its entity almost for certain is removed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, materialize, parted, unused

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side that are an entity's context; words of a shingle; min-hashes of a text.
CONTEXT, SHINGLE, SHAPES = 5, 5, 4
#: Witnesses that a pair needs; the least G2 of its likelihood ratio (chance alone reaches it about once in a million); share of the entity's own bits that a term must tell; posteriors to generalise and to remove.
MIN_TEXTS = 2
SIGNIFICANT = 24.0
MIN_SHARE = 0.5
GENERALISE, REMOVE = 0.5, 0.9
#: Places of the filter that spares most words the shuffle: its size is fixed, whatever the corpus.
FILTER = 1 << 22

# The patterns. The look-behind and the possessive runs only spare second looks that cannot succeed.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @ so that long runs of its characters cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(text: str, span: tuple[int, int, int]) -> str:
    value = text[span[0] : span[2]]
    return f"{KINDS[span[1]]}:{value.lower() if span[1] < 2 else re.sub('[^0-9]', '', value)}"


def _outside(spans: list[tuple[int, int, int]]):
    """Whether a piece of text keeps clear of all spans; pieces come in order."""
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts, ends = [m[0] for m in merged], [m[1] for m in merged]

    def clear(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return k == 0 or ends[k - 1] <= s

    return clear


def shapes_of(words: list[str]) -> list[int]:
    """Min-hashes of the shingles of words; texts that share most of those share most of these."""
    from xxhash import xxh64_intdigest

    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter((xxh64_intdigest(" ".join(words[i : i + SHINGLE])) for i in range(n)), np.uint64, n)
    return [int((h * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)).min()) >> 1 for k in range(SHAPES)]


def contexts_of(text: str) -> tuple[list[tuple[str, str]], list[str], list[int]]:
    """(entity, the words around one of its places) for each entity of the base spans; and, if there is one, all terms of the text and its shapes.

    Of the places of an entity the one with the least digest of its context counts, so a text is one witness.
    """
    spans = base_spans(text)
    if not spans:
        return [], [], []
    clear = _outside(spans)
    words = [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text) if clear(*m.span())]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    found: dict[str, str] = {}
    for start, kind, end in spans:
        k = bisect_right(ends, start)
        before, after = words[max(0, k - CONTEXT) : k], words[(j := bisect_left(starts, end)) : j + CONTEXT]
        around = hashlib.md5(" ".join(w[2] for w in before + after).encode()).hexdigest()
        entity = _entity(text, (start, kind, end))
        found[entity] = min(found.get(entity, around), around)
    return list(found.items()), sorted({w[2] for w in words}), shapes_of([w[2] for w in words])


_ENTITY = T.StructType([T.StructField("entity", T.StringType()), T.StructField("context", T.StringType())])
_CONTEXTS = T.StructType([T.StructField("entities", T.ArrayType(_ENTITY)), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("shapes", T.ArrayType(T.LongType()))])


@F.arrow_udf(_CONTEXTS)
def _contexts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.string())]))
    for batch in texts:
        found = [contexts_of(x.as_py() or "") for x in batch]
        entities = pa.array([[{"entity": e, "context": c} for e, c in f[0]] for f in found], kind)
        yield pa.StructArray.from_arrays([entities, pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["entities", "terms", "shapes"])


_contexts = _contexts.asNondeterministic()  # computed once, filter or not

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())])
_HIT = T.StructType([*_SPAN.fields, T.StructField("term", T.StringType())])
_SCAN = T.StructType([T.StructField("base", T.ArrayType(_SPAN)), T.StructField("hits", T.ArrayType(_HIT))])


class _Passing:
    """Words that a filter of fixed size lets through, as it is filled on the driver; remembers what it has looked up."""

    def __init__(self, filled) -> None:
        self.there = np.unpackbits(np.frombuffer(zlib.decompress(filled.value), np.uint8)).astype(bool)
        self.some = bool(self.there.any())
        self.known: dict[str, str] = {}

    def of(self, text: str) -> dict[str, str]:
        """Words of the text to their terms, those that pass."""
        if not self.some:
            return {}
        if len(self.known) > 200_000:
            self.known.clear()
        out = {}
        for w in set(_TERM.findall(text)):
            t = self.known.get(w)
            if t is None:
                t = w.lower()
                t = self.known[w] = t if self.there[zlib.crc32(t.encode()) % FILTER] else ""
            if t:
                out[w] = t
        return out


def _filled(terms: DataFrame):
    """The filter that terms(term) fill: at most FILTER places, whatever the number of terms."""
    places = terms.select((F.crc32(F.col("term").cast("binary")) % FILTER).alias("at")).distinct().toArrow().column("at").to_numpy()
    bits = np.zeros(FILTER, np.uint8)
    bits[places] = 1
    return terms.sparkSession.sparkContext.broadcast(zlib.compress(np.packbits(bits).tobytes()))


def _holding(filled):
    """How many texts of a partition hold each word that passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, counts = _Passing(filled), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for x in batch.column(0):
                counts.update(set(passing.of(x.as_py() or "").values()))
            if len(counts) > 100_000:
                yield flush()
        yield flush()

    return run


def _scanner(filled):
    """Base spans of a text, and the words of it that may be disclosing terms."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    hit = pa.struct([*span, pa.field("term", pa.string())])

    @F.arrow_udf(_SCAN)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        passing = _Passing(filled)
        for batch in texts:
            bases, hits = [], []
            for x in batch:
                text = x.as_py() or ""
                spans = base_spans(text)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                found = []
                if terms := passing.of(text):
                    clear = _outside(spans)
                    found = [{"start": m.start(), "kind": len(KINDS) - 1, "end": m.end(), "term": terms[m[0]]} for m in _TERM.finditer(text) if m[0] in terms and clear(*m.span())]
                hits.append(found)
            yield pa.StructArray.from_arrays([pa.array(bases, pa.list_(span)), pa.array(hits, pa.list_(hit))], ["base", "hits"])

    return scan


def _witnesses() -> Column:
    """Aggregate: the least number of different contexts and shapes."""
    return F.least(F.count_distinct("context"), *(F.count_distinct(F.col("shapes")[k]) for k in range(SHAPES))).alias("n")


def likelihood_ratio(both: Column, one: Column, other: Column, every: Column) -> Column:
    """G2 of two things that stand in ``one`` and ``other`` of ``every`` texts, in ``both`` together."""
    x = lambda c: F.when(c > 0, c * F.log(c.cast("double"))).otherwise(F.lit(0.0))
    return 2 * (x(both) + x(one - both) + x(other - both) + x(every - one - other + both) - x(one) - x(every - one) - x(other) - x(every - other) + x(every))


def judged(docs: DataFrame, tables: Tables) -> DataFrame:
    """term, entity_texts, n, posterior, own, g2 of the pairs of docs(text) that have MIN_TEXTS witnesses, by two looks at each whole text.

    The first takes of each text its entities with their contexts, and if it has one its terms and shapes. Entities with
    witnesses enough that stand in exactly the same texts are one class, as all counts of theirs are the same: a list of
    addresses costs its texts no more than one address. Only texts of such a class give pairs with terms. The second look
    counts the texts that hold a term: words that pass a filter of such terms, summed up within a partition, then joined
    exactly. The result reads tables that belong to ``tables``.
    """
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    looked = texts.select(F.md5("text").alias("key"), _contexts("text").alias("c")).where(F.size("c.entities") > 0)
    around = tables.keep(looked.select("key", "c.*"), "pii-contexts")
    # copies of a text have one key
    per = around.select("key", "shapes", F.inline("entities")).groupBy("entity", "key").agg(F.count(F.lit(1)).alias("copies"), F.first("context").alias("context"), F.first("shapes").alias("shapes"))
    same = [F.bit_xor(F.xxhash64(F.lit(i), F.col("key"))).alias(f"same{i}") for i in range(2)]
    of_entity = per.groupBy("entity").agg(F.sum("copies").alias("entity_texts"), _witnesses(), *same).where(F.col("n") >= MIN_TEXTS)
    of_entity = tables.keep(of_entity, "pii-entities")
    names = ["same0", "same1", "entity_texts"]
    classes = of_entity.groupBy(*names).agg(F.max("n").alias("entity_n"))
    of_class = per.join(of_entity.select("entity", *names), "entity").groupBy(*names, "key").agg(F.first("copies").alias("copies"), F.min("context").alias("context"), F.first("shapes").alias("shapes"))
    of_class = tables.keep(of_class, "pii-classes")
    held = around.select("key", "terms").join(of_class.select("key").distinct(), "key").dropDuplicates(["key"]).select("key", F.explode("terms").alias("term"))
    near = of_class.join(held, "key").groupBy(*names, "term").agg(F.sum("copies").alias("texts"), _witnesses()).where(F.col("n") >= MIN_TEXTS)
    near = tables.keep(near, "pii-terms")
    holding = texts.mapInArrow(_holding(_filled(near)), "term string, n long").groupBy("term").agg(F.sum("n").alias("all_texts"))
    both = near.join(classes, names).join(holding, "term")
    every = F.lit(max(texts.count(), 1))
    posterior = F.col("texts") / F.greatest("all_texts", "texts") * F.col("n") / (F.col("n") + 1)
    g2 = likelihood_ratio(F.col("n"), F.greatest("n", "entity_n"), F.col("n") + F.greatest(F.col("all_texts") - F.col("texts"), F.lit(0)), every)
    return both.select("term", "entity_texts", "n", posterior.alias("posterior"), F.log2(every.cast("double") / F.col("entity_texts")).alias("own"), g2.alias("g2"))


def disclosing(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """term, removed: the terms of docs(text) over the thresholds."""
    told = F.log2("posterior") + F.col("own")
    over = (F.col("posterior") >= GENERALISE) & (F.col("g2") >= SIGNIFICANT) & (told >= MIN_SHARE * F.col("own"))
    return judged(docs, tables or Tables()).where(over).groupBy("term").agg((F.max("posterior") >= REMOVE).alias("removed"))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scanned, added): the rows of docs without text, as doc_id, key (of the text) and base spans; and per key the added spans.

    added has key, terms (array of start, kind, end, removed). Only words that pass a filter of the disclosing terms are
    shuffled, and the join with those terms then decides exactly.
    """
    tables = Tables()
    terms = materialize(disclosing(docs, tables), "pii-disclosing")
    tables.release()
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.md5(text).alias("key"), _scanner(_filled(terms))(text).alias("s"))
    scanned = materialize(found.select("doc_id", "key", "s.base", "s.hits"), "pii-spans")
    hits = scanned.select("key", F.inline("hits")).distinct()
    added = hits.join(terms, "term").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "removed"))).alias("terms"))
    return scanned.drop("hits"), added


def _said(spans):
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, counts by kind, base_sha256, spans, n_terms.

    Null text is empty: no spans. Equal texts have equal spans, and rows keep theirs whatever their doc_id, null too. An
    empty table gives no rows; other columns are ignored. Added spans never overlap base spans.
    """
    scanned, added = find(docs)
    both = scanned.join(added, "key", "left")
    plain = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return both.select("doc_id", *map(count, range(4)), F.sha2(_said("base"), 256).alias("base_sha256"), _said(F.sort_array(F.concat("base", plain))).alias("spans"), F.size(plain).cast("long").alias("n_terms"))


@F.arrow_udf(T.StringType())
def _rewrite(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Base spans become the name of their kind, generalised terms <TERM>, removed ones nothing; overlaps become one, by the first."""
    for batch in texts:
        out = []
        for text, base, terms in zip(*batch, strict=True):
            t = text.as_py()
            spans = [(s["start"], s["end"], f"<{KINDS[s['kind']].upper()}>") for s in base.as_py() or []]
            spans += [(s["start"], s["end"], "" if s["removed"] else "<TERM>") for s in terms.as_py() or []]
            if t is not None and spans:
                parts, at = [], 0
                for s, e, name in sorted(spans):
                    if s >= at:
                        parts += [t[at:s], name]
                    at = max(at, e)
                t = "".join([*parts, t[at:]])
            out.append(t)
        yield pa.array(out, pa.string())


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with text rewritten, all rows kept; null text stays null, and empty text empty. Equal texts are rewritten alike.

    Texts that may have spans meet them by a digest, one row of each on the other side; all others stay where they lie. Columns of any name pass through; an empty
    table stays empty.
    """
    scanned, added = find(docs)
    own, base, terms = (unused(docs, c) for c in ("pii_key", "pii_base", "pii_terms"))
    spans = scanned.where(F.size("base") > 0).groupBy("key").agg(F.first("base").alias("base"))
    both = materialize(spans.join(added, "key", "full"), "pii-rewrites")
    digest = F.md5(F.coalesce(docs["text"], F.lit("")))
    clean, rest = parted(docs, digest, both, both.count())
    both = both.select(F.col("key").alias(own), F.col("base").alias(base), F.col("terms").alias(terms))
    joined = rest.join(both, F.md5(F.coalesce(rest["text"], F.lit(""))) == both[own], "left")
    touched = F.col(base).isNotNull() | F.col(terms).isNotNull()
    text = F.when(touched, _rewrite("text", base, terms)).otherwise(F.col("text"))
    return clean.unionByName(joined.withColumn("text", text).select(*docs.columns).hint("rebalance"))
