import os
import time

from passagecraft.operators import answering


def test_calls_are_concurrent_and_kept(spark, tmp_path):
    log = f"{tmp_path}/log"
    os.makedirs(log)
    fails = f"{tmp_path}/fail"
    open(fails, "w").close()

    def slow(prompts):
        began = time.time()
        time.sleep(0.2)
        with open(f"{log}/{time.time_ns()}-{os.getpid()}-{id(prompts)}", "w") as f:
            f.write(f"{began} {time.time()} {prompts[0]}")
        if os.path.exists(fails) and prompts[0].endswith("7"):
            raise OSError("no answer")
        return [prompts[0].upper()]

    def called():
        return sorted(open(f"{log}/{f}").read().split(" ", 2) for f in os.listdir(log))

    df = spark.createDataFrame([(i, f"prompt {i % 30}") for i in range(60)] + [(99, None)], "question_id long, prompt string")
    calls = answering.Calls(at_once=5, tasks=2, store=f"file://{tmp_path}/answers")
    ask = lambda: {r.question_id: (r.raw, r.error) for r in answering.asked(df, slow, 0, calls, "slow").collect()}
    got = ask()
    want = lambda i: (None, "no answer") if i % 10 == 7 else (f"PROMPT {i % 30}", None)
    assert got == {i: want(i) for i in range(60)} | {99: (None, None)}
    first = called()
    assert sorted(c[2] for c in first) == sorted({f"prompt {i}" for i in range(30)})  # each prompt once, whoever asks it
    at = sorted([(float(a), 1) for a, _, _ in first] + [(float(b), -1) for _, b, _ in first])
    most = now = 0
    for _, step in at:
        now += step
        most = max(most, now)
    assert 2 < most <= 10  # several at a time, and no more than the budget
    os.remove(fails)
    assert ask() == {i: (f"PROMPT {i % 30}", None) for i in range(60)} | {99: (None, None)}
    assert sorted(c[2] for c in called()[len(first) :]) == ["prompt 17", "prompt 27", "prompt 7"]  # only what had failed
    ask()
    assert len(called()) == len(first) + 3


def test_a_task_that_is_run_again_asks_nothing_twice(spark, tmp_path):
    log = f"{tmp_path}/log"
    os.makedirs(log)

    def answer(prompts):
        open(f"{log}/{time.time_ns()}-{os.getpid()}-{id(prompts)}", "w").close()
        return [f"to {prompts[0]}"]

    calls = answering.Calls(at_once=2, tasks=1, store=f"file://{tmp_path}/answers")
    run = answering._generate(answer, 0, calls, "x")
    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(10)], "key string, prompt string").coalesce(1)

    def lost(batches):
        # the first attempt ends after all calls, before its rows are taken
        for b in run(batches):
            if not os.path.exists(f"{tmp_path}/once"):
                open(f"{tmp_path}/once", "w").close()
                raise OSError("executor lost")
            yield b

    out = df.mapInArrow(lost, "key string, raw string, error string")
    try:
        out.collect()
    except Exception:
        assert sorted((r.key, r.raw) for r in out.collect()) == sorted((str(i), f"to p{i}") for i in range(10))
    assert len(os.listdir(log)) == 10
