"""Quality rules as a learned decision list, applied in DataFrame functions only.

Sequential covering grows a rule, a conjunction of thresholds on a document's statistics, on two thirds of the labelled
rows, prunes it on the other third, and goes on with the rows that it does not cover. The list becomes an ordered
conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: The most labelled rows that a list is learned from: those with the smallest hash of their doc_id.
MAX_LABELLED = 10_000
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "mark_share", "digit_share")


def _repeated(hashes: Column, n_words: Column) -> Column:
    """Words in windows whose hash is there twice or more; hashes: of all windows, in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(hashes)
    as_next = lambda s: F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: a["h"] == b["h"])
    no = F.array(F.lit(False))

    def covered(s: Column) -> Column:
        twice = F.transform(F.array(as_next(s)), lambda e: F.zip_with(F.concat(no, e), F.concat(e, no), lambda a, b: a | b))[0]
        at = F.sort_array(F.filter(F.zip_with(s, twice, lambda p, t: F.when(t, p["i"])), lambda i: i.isNotNull()))
        gaps = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.transform(F.array(at), lambda p: F.when(F.size(p) > 0, F.aggregate(gaps(p), F.lit(WINDOW), lambda x, y: x + y)).otherwise(0))[0]

    slow = F.transform(F.array(placed), covered)[0]
    return F.when((n_words > WINDOW) & (F.size(F.array_distinct(hashes)) < n), slow).otherwise(0).cast("long")


def _bound(c: Column, made: Callable[[Column], Column]) -> Column:
    """made(c), where c is computed once however often it is used."""
    return F.transform(F.array(c), lambda x: made(x))[0]


def window_hashes(hashes: Column, n: Column) -> Column:
    """A hash of every WINDOW neighbours of ``hashes``, n of them, by doubling: of two, of four, of eight."""

    def doubled(x: Column, step: int) -> Column:
        beside = F.slice(x, 1 + step, F.greatest(F.size(x) - step, F.lit(0)))
        return F.zip_with(x, beside, lambda a, b: F.xxhash64(a, b))

    out = hashes
    for step in (1, 2, 4):
        # bound as an element, as a column that is used twice would be made twice
        out = _bound(out, lambda x, n=step: doubled(x, n))
    return F.when(n >= WINDOW, F.slice(out, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def with_statistics(docs: DataFrame, into: str = "stats") -> DataFrame:
    """docs and, in a column ``into``, the statistics of each whole text; those of a null text are those of an empty one.

    A column of that name is replaced, and all others pass through, whatever their names. Repeated rows have equal
    statistics; an empty table stays empty.
    """
    docs = docs.drop(into)
    named = {k: unused(docs, k) for k in ("words", "hashes", "windows", "lines")}
    text, w, h, lines = F.coalesce(F.col("text"), F.lit("")), F.col(named["words"]), F.col(named["hashes"]), F.col(named["lines"])
    made = docs.withColumns({named["words"]: words(F.col("text")), named["lines"]: F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))})
    made = made.withColumn(named["hashes"], F.transform(w, lambda x: F.xxhash64(x)))
    made = made.withColumn(named["windows"], window_hashes(h, F.size(w)))
    chars = F.length(F.array_join(w, ""))
    # a generator, so that no later use of a statistic computes it anew
    stats = F.array(
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated(F.col(named["windows"]), F.size(w)).alias("n_repeat_words"),
            F.size(lines).alias("n_lines"),
            F.size(F.array_distinct(h)).alias("n_distinct"),
            F.regexp_count(text, F.lit(r"[!?]")).alias("n_marks"),
            F.regexp_count(text, F.lit(r"[0-9]")).alias("n_digits"),
        ),
    )
    return made.select(*docs.columns, F.explode(stats).alias(into))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])


def features(q: Column) -> dict[str, Column]:
    """What rules look at; shares of nothing are 0."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "n_words": q["n_words"].cast("double"),
        "word_length": share(q["word_chars"], q["n_words"]),
        "symbol_share": share(q["n_symbols"], q["word_chars"]),
        "dup_line_share": share(q["n_dup_lines"], q["n_lines"]),
        "repeat_share": share(q["n_repeat_words"], q["n_words"]),
        "distinct_share": share(q["n_distinct"], q["n_words"]),
        "mark_share": share(q["n_marks"], q["word_chars"]),
        "digit_share": share(q["n_digits"], q["word_chars"]),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def of(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.bound if self.above else column <= self.bound

    def column(self, made: dict[str, Column]) -> Column:
        return made[self.feature] > self.bound if self.above else made[self.feature] <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects a document, and what none rejects is kept."""

    rules: Sequence[Sequence[Condition]] = field(default_factory=tuple)

    def verdict(self, q: Column) -> Column:
        """The text of the rule that rejects, null where none does."""
        made, out = features(q), None
        for rule in self.rules:
            holds, says = F.lit(True), F.lit(" and ".join(map(str, rule)))
            for c in rule:
                holds = holds & c.column(made)
            out = F.when(holds, says) if out is None else out.when(holds, says)
        return F.lit(None).cast("string") if out is None else out


def _cover(rule: Sequence[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.of(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[Condition]:
    """Adds the condition of the highest gain of information until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None)
        for f, name in enumerate(FEATURES):
            values = x[inside, f]
            order = np.argsort(values, kind="stable")
            v, b = values[order], bad[inside][order]
            p, n = np.cumsum(b), np.cumsum(~b)
            cut = np.nonzero(np.diff(v) > 0)[0]
            for above in (False, True):
                pos, neg = (p0 - p[cut], n0 - n[cut]) if above else (p[cut], n[cut])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - math.log2(p0 / (p0 + n0))), 0)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].of(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 3, max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.9) -> DecisionList:
    """A list that finds the rows marked bad; a rule must reach ``min_precision`` on the third it was not grown on."""
    order = np.random.default_rng(seed).permutation(len(x))
    x, bad = x[order], bad[order]
    grow = np.arange(len(x)) % 3 != 0
    rules: list[list[Condition]] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and (left & grow & bad).sum() >= 5:
        rule = _grow(x[left & grow], bad[left & grow], max_conditions)
        held, truth = x[left & ~grow], bad[left & ~grow]

        def worth(r: list[Condition], held=held, truth=truth) -> tuple[float, int]:
            c = _cover(r, held)
            return ((c & truth).sum() - (c & ~truth).sum()) / max(1, c.sum()), int((c & truth).sum())

        rule = max((rule[:i] for i in range(1, len(rule) + 1)), key=worth, default=[])
        c = _cover(rule, held)
        if not rule or not c.any() or (c & truth).sum() < min_precision * c.sum():
            break
        rules.append(rule)
        left &= ~_cover(rule, x)
    return DecisionList(rules)


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **how) -> DecisionList:
    """A list from labels(doc_id, quality), where quality 0 is bad; of repeated labels the lowest counts, null ones never.

    At most ``max_labelled`` labelled rows are used; that many and no more are sent to all executors and to the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    stats = with_statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    made = features(F.col("stats"))
    rows = stats.where(~base_failed(F.col("stats"))).orderBy(F.xxhash64("doc_id"), "doc_id", *(made[f] for f in FEATURES)).limit(max_labelled)
    found = rows.select("label", *(made[f].alias(f) for f in FEATURES)).collect()
    x = np.array([r[1:] for r in found], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r[0] == 0 for r in found], bool), **how)


def assess(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with stats (the statistics), base_failed, rule (the rule that rejects, else null) and kept; columns of these names are replaced.

    Null or empty text fails for want of words. Each row is judged by itself, so ties and repeats are judged alike. An
    empty table stays empty.
    """
    out = with_statistics(docs.drop("base_failed", "rule", "kept"))
    q = F.col("stats")
    return out.withColumns({"base_failed": base_failed(q), "rule": rules.verdict(q)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
