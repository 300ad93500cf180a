r"""Conversations as training windows: turn-aligned spans under a budget, in DataFrame functions only.

A turn is written ``### role ###``, a line end, its text, ``</turn>`` and a line end. Inside roles and texts a backslash
stands before every backslash, before a # that follows a # and before a / that follows a <, so neither mark can stand
there, and taking each backslash away that is before another character gives the text back.

Prefix sums of the turns' tokens choose the spans: a window takes turns as long as the sum from its first one stays within
the budget, less what the system turn takes and what is kept for history. The system turn leads every window; the last
turns before a window are repeated in it, as many as are allowed. Repeated turns are never targets, so the text of each
assistant turn is under the loss mask exactly once. A turn is never cut: one that is over the budget by itself makes a
window of its own that is over it, too.

A conversation is one row of arrays while it is dealt out, so a long one is first cut into chapters of CHAPTER turns: their
places come from ranges of the sorted turns, and a chapter begins with copies of the system turn and of the turns before
it. Only conversations of more turns than that are sorted; the others are just grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, parted, ranked

BUDGET = 1024
#: Turns, and tokens of them, that a window repeats at most.
HISTORY_TURNS, HISTORY_TOKENS = 2, 256
CHAPTER = 256
#: What the marks of a turn count for, in tokens.
MARKS = 4
#: A token: a run of letters, digits and underscores, or any other character but white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_OPEN, _MIDDLE, _CLOSE = "### ", " ###\n", "</turn>\n"


def escape(text: Column) -> Column:
    """A text without the marks of the template."""
    return F.regexp_replace(text, F.lit(r"\\|(?<=#)#|(?<=<)/"), F.lit(r"\\$0"))


def unescape(text: Column) -> Column:
    """What escape() was given."""
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(TOKEN)) + MARKS).cast("long")


def _chapters(rows: DataFrame, chapter: int, repeated: int) -> DataFrame:
    """rows(conv_id, turn, role, text) with place and chapter; turns that a later chapter needs are there for it, too."""
    tables = Tables()
    long = tables.keep(rows.groupBy("conv_id").count().where(F.col("count") > chapter).select(F.col("conv_id").alias("key")), "long-conversations")
    n = long.count()
    whole = lambda df: df.select("*", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("chapter"))
    if not n:
        tables.release()
        return whole(rows)
    short, rest = parted(rows, rows["conv_id"], long, n)
    short = short.unionByName(rest.join(long, rest["conv_id"].eqNullSafe(long["key"]), "left_anti"))
    some = rest.join(long, rest["conv_id"].eqNullSafe(long["key"]), "left_semi")
    dealt = ranked(some, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], tables, "place", "size")
    own = F.floor(F.col("place") / chapter).cast("long")
    last = F.floor((F.col("size") - 1) / chapter).cast("long")
    none = F.array().cast("array<bigint>")
    on = F.when((F.col("place") % chapter >= chapter - repeated) & (own < last), F.array(own + 1)).otherwise(none)
    led = F.when((F.col("place") == 0) & (F.col("role") == "system") & (last > 0), F.sequence(F.lit(1).cast("long"), last)).otherwise(none)
    return whole(short).unionByName(dealt.select(*rows.columns, "place", F.explode(F.concat(F.array(own), on, led)).alias("chapter")))


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, chapter: int = CHAPTER) -> DataFrame:
    """conv_id, chapter, window, text, loss, repeated, n_turns, n_tokens of conversations(conv_id, turn, role, text).

    text is the whole window, loss an array of struct(start, end) in its code points: the (escaped) texts that are
    targets. The first ``repeated`` turns of a window are copies of earlier ones. Rows go by turn (null first), then role,
    then text; repeated rows are turns like others. A null role or text is an empty one, and a null conv_id a
    conversation. The first turn is kept in every window if its role is ``system``; later system turns are turns like
    any other. An empty table gives no rows; other columns are ignored.
    """
    if not 0 <= history_turns < chapter - 1:
        raise ValueError("a chapter must hold more turns than are repeated")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("place", "turn", "role", "text")
    held = _chapters(rows, chapter, history_turns).groupBy("conv_id", "chapter").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = F.transform(
        "turns",
        lambda t: F.struct(
            t["place"].alias("place"), t["role"].alias("role"), F.concat(F.lit(_OPEN), escape(t["role"]), F.lit(_MIDDLE)).alias("head"), escape(t["text"]).alias("body"), tokens(t["text"]).alias("tokens")
        ),
    )
    held = held.select("conv_id", "chapter", written.alias("turns"))
    first = F.element_at("turns", 1)
    system = (first["role"] == "system") & (first["place"] == 0)
    copies = F.size(F.filter("turns", lambda t: t["place"] < F.col("chapter") * chapter))
    sums = F.aggregate("turns", F.array(F.lit(0).cast("long")), lambda s, t: F.array_append(s, F.element_at(s, -1) + t["tokens"]))
    held = held.select("*", sums.alias("sums"), F.when(system, 1).otherwise(0).alias("led"), copies.alias("copies"))
    led_tokens = F.when(F.col("led") == 1, first["tokens"]).otherwise(F.lit(0).cast("long"))
    held = held.select("*", led_tokens.alias("led_tokens"), F.greatest("led", "copies").alias("first"), F.size("turns").alias("n"))
    sum_at = lambda i: F.element_at("sums", i + 1)
    room = lambda starts: F.lit(budget) - F.col("led_tokens") - F.when((F.size(starts) == 1) & (F.col("chapter") == 0), F.lit(0)).otherwise(F.lit(history_tokens))
    full = lambda starts, i: (i > F.element_at(starts, -1)) & (sum_at(i + 1) - sum_at(F.element_at(starts, -1)) > room(starts))
    dealt = F.filter(F.sequence(F.col("first"), F.greatest(F.col("n") - 1, F.col("first"))), lambda i: i < F.col("n"))
    starts = F.aggregate(dealt, F.array(F.col("first")), lambda s, i: F.when(full(s, i), F.array_append(s, i)).otherwise(s))
    held = held.select("*", starts.alias("starts"))

    def span(s: Column, k: Column) -> Column:
        return F.struct(s.alias("s"), F.coalesce(F.get("starts", k + 1), F.col("n")).alias("e"), k.alias("k"))

    def with_history(w: Column) -> Column:
        left = F.least(F.lit(history_tokens).cast("long"), F.greatest(F.lit(0).cast("long"), F.lit(budget) - F.col("led_tokens") - (sum_at(w["e"]) - sum_at(w["s"]))))
        fits = F.filter(F.sequence(F.greatest(F.col("led"), w["s"] - history_turns), w["s"]), lambda h: sum_at(w["s"]) - sum_at(h) <= left)
        return F.struct(w["k"].alias("k"), w["s"].alias("s"), w["e"].alias("e"), F.element_at(fits, 1).alias("h"))

    def made(w: Column) -> Column:
        # the system turn is new only where the conversation begins
        again = w["s"] - w["h"] + F.when((F.col("chapter") == 0) & (w["k"] == 0), F.lit(0)).otherwise(F.col("led"))
        parts = F.concat(F.slice("turns", F.lit(1), F.col("led")), F.slice("turns", w["h"] + 1, w["e"] - w["h"]))
        return F.struct(w["k"].alias("window"), again.alias("repeated"), parts.alias("parts"), (F.col("led_tokens") + sum_at(w["e"]) - sum_at(w["h"])).alias("n_tokens"))

    def masked(w: Column) -> Column:
        text = F.array_join(F.transform(w["parts"], lambda p: F.concat(p["head"], p["body"], F.lit(_CLOSE))), "")
        ends = F.aggregate(w["parts"], F.array(F.lit(0)), lambda s, p: F.array_append(s, F.element_at(s, -1) + F.length(p["head"]) + F.length(p["body"]) + len(_CLOSE)))
        spans = F.zip_with(w["parts"], F.slice(ends, F.lit(1), F.size(w["parts"])), _target)
        loss = F.filter(F.slice(spans, w["repeated"] + 1, F.size(spans)), lambda x: x.isNotNull())
        return F.struct(w["window"].alias("window"), text.alias("text"), loss.alias("loss"), w["repeated"].alias("repeated"), F.size(w["parts"]).alias("n_turns"), w["n_tokens"].alias("n_tokens"))

    for build in (lambda: F.transform("starts", span), lambda: F.transform("spans", with_history), lambda: F.transform("spans", made), lambda: F.transform("spans", masked)):
        held = held.withColumn("spans", build())
    # no list is empty; for inline() Spark would test that first, and for the test make all of them
    return held.select("conv_id", "chapter", F.inline_outer("spans"))


def _target(p: Column, at: Column) -> Column:
    """Where the text of an assistant's turn stands that begins at a place; null for other turns."""
    start = at + F.length(p["head"])
    return F.when(p["role"] == "assistant", F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end")))


def turns(window: DataFrame, again: bool = False) -> DataFrame:
    """window with turns, an array of struct(role, text) read back from text; without the repeated ones, unless ``again``."""
    pieces = F.split("text", _CLOSE)
    since = F.lit(0) if again else F.col("repeated")
    own = F.slice(pieces, since + 1, F.greatest(F.size(pieces) - 1 - since, F.lit(0)))

    def parsed(piece: Column) -> Column:
        halves = F.split(piece, _MIDDLE, 2)
        return F.struct(unescape(F.substring(F.get(halves, F.lit(0)), F.lit(len(_OPEN) + 1), F.length(piece))).alias("role"), unescape(F.get(halves, F.lit(1))).alias("text"))

    return window.withColumn("turns", F.transform(own, parsed))


def report(window: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, read back from windows().

    A digest is of one string, so here a conversation's texts come together in a row; windows() never has them so.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    target = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    each = turns(window).select("conv_id", F.size("turns").cast("long").alias("n"), F.length("text").cast("long").alias("chars"), F.struct("chapter", "window", said.alias("said"), target.alias("target")).alias("w"))
    per = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.sort_array(F.collect_list("w")).alias("ws"))
    joined = lambda name: F.array_join(F.transform("ws", lambda w: w[name]), "")
    per = per.withColumn("target", joined("target"))
    return per.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length("target").cast("long").alias("loss_chars"), F.sha2("target", 256).alias("loss_sha256"), "formatted_chars", "n_windows"
    )
