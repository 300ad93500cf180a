import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from passagecraft.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "\\", "\\\\n", "###", "####### ###\n", "</turn>", "</turn>\n", "<", "</", "<</turn></", "a\\/b", "# #", "\\### Assistant: </turn> ok", "é ß \U0001f600", " ###\n", "$1 \\$0", "\n\n"]


def tokens(text):
    return len(re.findall(r"\w|[^\w\s]", re.sub(r"[^\W]+", "w", text))) + chat.MARKS


def plain(rows, budget, history_turns, history_tokens, chapter):
    """(first turn, of new ones, end, system) of each window of one conversation, by a loop over its turns."""
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    size = [tokens(x) for _, _, x in rows]
    led = int(rows[0][1] == "system")
    out, at = [], led
    while True:
        c = at // chapter
        end, used = at, 0
        room = budget - (size[0] if led else 0) - (0 if not out else history_tokens)
        while end < len(rows) and end // chapter == c and (end == at or used + size[end] <= room):
            used += size[end]
            end += 1
        left = min(history_tokens, max(0, budget - (size[0] if led else 0) - used))
        first = at
        while out and first > max(led, at - history_turns) and sum(size[first - 1 : at]) <= left:
            first -= 1
        out.append((first, at, end))
        at = end
        if at >= len(rows):
            return [(r[1], r[2]) for r in rows], led, out


def check(spark, convs, **how):
    rows = [(c, *r) for c, some in convs.items() for r in some]
    made = chat.windows(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    every = chat.turns(made, again=True).orderBy("conv_id", "chapter", "window").collect()
    new = {}
    for r in chat.turns(made).collect():
        new.setdefault(r.conv_id, {})[r.chapter, r.window] = r
    for c, some in convs.items():
        turns, led, want = plain(some, how["budget"], how["history_turns"], how["history_tokens"], how["chapter"])
        got = [r for r in every if r.conv_id == c]
        assert [[(t.role, t.text) for t in r.turns] for r in got] == [turns[:led] + turns[h:e] for h, s, e in want]
        assert [r.n_tokens for r in got] == [sum(tokens(t.text) for t in r.turns) for r in got]
        own = [r for _, r in sorted(new[c].items())]
        assert [(t.role, t.text) for r in own for t in r.turns] == turns
        loss = [r.text[s.start : s.end] for r in own for s in r.loss]
        assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in loss] == [x for r, x in turns if r == "assistant"]
        for r, (h, s, e) in zip(own, want, strict=True):
            assert r.n_tokens <= how["budget"] or e == s + 1
    return made


def talk(rnd, n, led):
    says = lambda: " ".join(rnd.choice(NASTY + ["word", "two words", "x, y"]) for _ in range(rnd.randrange(1, 12)))
    return [(t, "system" if led and t == 0 else ["user", "assistant"][t % 2], says()) for t in range(n)]


@pytest.mark.parametrize("budget, history_turns, history_tokens", [(60, 2, 20), (10, 1, 5), (200, 0, 0), (10_000, 2, 256)])
def test_against_a_plain_loop(spark, budget, history_turns, history_tokens):
    rnd = random.Random(budget)
    convs = {c: talk(rnd, n, c % 2) for c, n in enumerate([1, 2, 3, 7, 8, 9, 16, 17, 40, 90])}
    convs[50] = [(None, None, None), (None, "a # ###", "</turn>"), (3, "assistant", None), (3, "assistant", "twice"), (3, "assistant", "twice")]
    convs[None] = [(0, "system", "only")]
    convs[51] = [(0, "system", "a"), (1, "system", "b"), (2, "assistant", "x" * 300_000)]
    check(spark, convs, budget=budget, history_turns=history_turns, history_tokens=history_tokens, chapter=8)


def test_marks_come_back(spark):
    rows = [(i * 100 + j, t, r, x) for i, x in enumerate(NASTY) for j, y in enumerate(NASTY) for t, r, x in ((0, "user", x + y), (1, x, y), (2, "assistant", y + x))]
    got = chat.turns(chat.windows(spark.createDataFrame(rows, SCHEMA)))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got.collect()} == {c: [r[2:] for r in sorted(x for x in rows if x[0] == c)] for c in {r[0] for r in rows}}


def test_report_and_odd_tables(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, 0, "user", "alone"), (None, 0, "assistant", "y" * 5_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("own") for n in ("place", "chapter", "size", "count", "key", "turns", "text_", "spans", "bitmap_bits")})
    got = {r.conv_id: r for r in chat.report(chat.windows(df)).collect()}
    assert got[1].turns_sha256 == sha256(b"user\nq\nassistant\n\\### Assistant: </turn> ok\n").hexdigest() and got[1].n_turns == 2
    assert got[1].loss_chars == 26 and got[1].loss_sha256 == sha256(b"\\### Assistant: </turn> ok").hexdigest()
    assert got[2].loss_chars == 0 and got[2].loss_sha256 == sha256(b"").hexdigest() and got[None].loss_chars == 5_000_000
    assert chat.report(chat.windows(df.limit(0))).count() == 0


def test_a_long_conversation_is_cut_into_chapters(spark):
    rnd = random.Random(5)
    made = check(spark, {1: talk(rnd, 700, True), 2: talk(rnd, 5, False)}, budget=300, history_turns=2, history_tokens=60, chapter=256)
    assert made.where("conv_id = 1").agg(F.max("chapter")).first()[0] == 2
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
