"""Retrieved passages to answers with verified citations."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagecraft.functions.text import citation_label, or_default, strip

NOT_FOUND = "NOT_IN_DOCUMENTS"
CONTEXT_CHARS, SNIPPET_CHARS = 1800, 400
SEPARATOR = "\n\n---\n\n"
SYSTEM_PROMPT = (
    "You answer from numbered passages and from nothing else. "
    f"When they do not hold the answer, say {NOT_FOUND} and no more. "
    "Put the number of the passage after each fact, as in [1]. Copy figures and dates as they stand. "
    "Where passages disagree, the one with the later effective_date counts; say so and cite both. Be short."
)

#: From prompts to raw answers; an exception counts as a failed call.
Generator = Callable[[Sequence[str]], Sequence[str]]


def _by_rank(value: Column) -> Column:
    """The values of a question's hits in the order of their rank."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("rank"), value.alias("v")))), lambda x: x["v"])


def context_entry() -> Column:
    """One hit as it stands in a prompt."""
    head = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] document_id="), F.col("document_id"), F.lit(" | title="), F.col("title"),
        F.lit(" | section="), or_default(F.col("section"), "-"), F.lit(" | effective_date="), or_default(F.col("effective_date"), "unknown"),
    )
    return F.concat(head, F.lit("\n"), F.left(F.col("text"), F.lit(CONTEXT_CHARS)))


def contexts(hits: DataFrame) -> DataFrame:
    """question_id and the context of its hits."""
    return hits.groupBy("question_id").agg(F.array_join(_by_rank(context_entry()), SEPARATOR).alias("context"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("CONTEXT\n"), context, F.lit("\n\nQUESTION\n"), question, F.lit(f"\n\nUse the CONTEXT alone and cite each fact as [n]; if it has no answer, reply {NOT_FOUND}."))


def citation() -> Column:
    """One hit as a citation."""
    label = citation_label(F.col("title"), F.col("document_id"), F.col("section"), F.col("page"))
    plain = [F.col(c).alias(c) for c in ("document_id", "title", "section", "page", "effective_date", "source_url", "relpath", "score")]
    return F.struct(F.col("rank").alias("n"), label.alias("label"), *plain, F.left("text", F.lit(SNIPPET_CHARS)).alias("snippet"))


def cited(raw: Column, n_hits: Column) -> tuple[Column, Column]:
    """(used, invented): the numbers of a raw answer's markers in the order they first stand there, by whether a hit has them."""
    marks = F.array_distinct(F.regexp_extract_all(raw, F.lit(r"\[([0-9]+)\]"), F.lit(1)))
    plain = F.array_distinct(F.transform(marks, lambda m: F.regexp_replace(m, "^0+(?=[0-9])", "")))
    valid = lambda m: F.coalesce(m.try_cast("int").between(1, n_hits), F.lit(False))
    return F.transform(F.filter(plain, valid), lambda m: m.cast("int")), F.filter(plain, lambda m: ~valid(m))


def extractive(best: Column, why: Column | None = None) -> Column:
    """The best passage as a quotation."""
    says = F.lit("no answer model is configured") if why is None else F.regexp_replace(strip(F.coalesce(F.nullif(why, F.lit("")), F.lit("no answer model is configured"))), r"\.+\z", "")
    return F.concat(F.lit("**Passage only** — "), says, F.lit(". The passage that supports an answer, as it stands:\n\n> "), F.replace(strip(best), F.lit("\n"), F.lit("\n> ")))


def mode(grounded: Column, ready: Column, failed: Column, raw: Column, n_hits: Column, provider: Column) -> Column:
    """abstained, extractive, unverified, or the provider's name: the first that holds."""
    used, _ = cited(raw, n_hits)
    return (
        F.when(~grounded, "abstained")
        .when(~ready | failed, "extractive")
        .when(F.upper(raw).contains(NOT_FOUND), "abstained")
        .when(F.size(used) == 0, "unverified")
        .otherwise(provider)
    )


@dataclass(frozen=True)
class Calls:
    """How a back end is called: ``tasks`` times ``at_once`` calls run at a time over the whole job, the provider's budget.

    ``store``, a folder that all workers share, keeps each answer under the digest of its name and prompt as soon as it is
    there: what a lost worker or an earlier job has asked is not asked again. Failed calls are not kept.
    """

    at_once: int = 8
    tasks: int = 4
    store: str | None = None


class Answers:
    """Answers in a folder, a file for each; one is there as a whole or not at all."""

    def __init__(self, store: str | None, name: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(store) if store else (None, "")
        self.name = name

    def _place(self, prompt: str) -> str:
        digest = hashlib.sha256(f"{self.name}\n{prompt}".encode()).hexdigest()
        return f"{self.root}/{digest[:2]}/{digest}.txt"

    def get(self, prompt: str) -> str | None:
        if not self.fs:
            return None
        try:
            with self.fs.open_input_stream(self._place(prompt)) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, prompt: str, answer: str) -> None:
        if not self.fs:
            return
        place = self._place(prompt)
        self.fs.create_dir(place.rpartition("/")[0], recursive=True)
        staged = f"{place}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(staged) as f:
            f.write(answer.encode())
        self.fs.move(staged, place)


def _generate(generator: Generator, retries: int, calls: Calls, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import ThreadPoolExecutor

        answers = Answers(calls.store, name)

        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                raw = answers.get(prompt)
                if raw is None:
                    raw = with_retry(lambda: generator([prompt])[0], retries)
                    answers.put(prompt, raw)
                return raw, None
            except Exception as e:  # a failed call is an outcome here, not a failure of the job
                return None, str(e) or type(e).__name__

        with ThreadPoolExecutor(calls.at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b.column("prompt").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["key", "raw", "error"])

    return run


def asked(prompts: DataFrame, generator: Generator, retries: int = 1, calls: Calls = Calls(), name: str = "") -> DataFrame:
    """question_id, raw, error of prompts(question_id, prompt): each different prompt is one call, however many questions have it."""
    kind = "key string, raw string, error string"
    keyed = prompts.withColumn("key", F.sha2(F.coalesce("prompt", F.lit("")), 256))
    each = keyed.groupBy("key").agg(F.first("prompt").alias("prompt")).where("prompt is not null").repartition(calls.tasks, "key")
    return keyed.select("question_id", "key").join(each.mapInArrow(_generate(generator, retries, calls, name), kind), "key", "left").drop("key")


class RateLimited(Exception):
    """A provider asks to wait; ``delay`` is what it says, in seconds."""

    def __init__(self, message: str, delay: float | None = None):
        super().__init__(message)
        self.delay = delay


def retry_delay(delay: float | None) -> float:
    """Seconds to wait: what the provider says, between 1 and 60, or 20."""
    return 20.0 if delay is None else min(60.0, max(1.0, delay))


def with_retry(call: Callable[[], str], retries: int = 1, sleep: Callable[[float], None] | None = None) -> str:
    import time

    for left in range(retries, -1, -1):
        try:
            return call()
        except RateLimited as e:
            if not left:
                raise
            (sleep or time.sleep)(retry_delay(e.delay))
    raise AssertionError


@dataclass(frozen=True)
class ProviderStatus:
    ready: bool
    detail: str


class Providers:
    """Answer back ends by name. None is built in: each is a function from prompts to answers, given by the caller.

    ``checks`` has for some names a function that says whether the back end can answer now, and if not, why: that its
    model is not installed, that a key is missing, that a server is down. ``models`` has the name of its model.
    """

    def __init__(self, checks: dict[str, Callable[[], ProviderStatus]] | None = None, models: dict[str, str] | None = None, **known: Generator):
        self.known, self.default = dict(known), next(iter(known), None)
        self.checks, self.models = dict(checks or {}), dict(models or {})

    def status(self, name: str | None = None) -> ProviderStatus:
        name = name or self.default
        if name is None:
            return ProviderStatus(False, "no answer model is configured")
        if name not in self.known:
            return ProviderStatus(False, f"{name} is unknown")
        if name not in self.checks:
            return ProviderStatus(True, f"{name} is ready")
        try:
            return self.checks[name]()
        except Exception as e:  # a check that fails says that its back end is not ready
            return ProviderStatus(False, f"{name}: {e or type(e).__name__}")

    def table(self) -> list[tuple[str, bool, bool, str, str]]:
        """(name, whether it is the default, whether it is ready, model, detail) of each back end."""
        return [(n, n == self.default, (s := self.status(n)).ready, self.models.get(n, ""), s.detail) for n in self.known]

    def with_model(self, name: str, model: str) -> Providers:
        """The same, where the back end ``name`` answers with another model: its function gets that name too."""
        known = dict(self.known)
        known[name] = partial(known[name], model=model)
        out = Providers(self.checks, self.models | {name: model}, **known)
        out.default = self.default
        return out

    def get(self, name: str | None = None) -> Generator:
        found = self.known.get(name or self.default or "")
        if found is None:
            raise KeyError(self.status(name).detail)
        return found


def answer(hits: DataFrame, decisions: DataFrame, providers: Providers | None = None, provider: str | None = None, force_extractive: bool = False, retries: int = 1, calls: Calls = Calls()) -> DataFrame:
    """A row for each question: text, grounded, mode, reason, citations, invented, diagnostics.

    The generator sees the prompts of grounded questions only, each once; ``calls`` says how many at a time and where
    answers are kept. mode names the provider that answered.
    """
    providers = providers or Providers()
    name = provider or providers.default
    status = providers.status(provider)
    per = hits.groupBy("question_id").agg(_by_rank(citation()).alias("all_citations"), F.min_by("text", "rank").alias("best"), F.array_join(_by_rank(context_entry()), SEPARATOR).alias("context"))
    empty = F.array().cast(per.schema["all_citations"].dataType)
    rows = decisions.join(per, "question_id", "left").withColumn("all_citations", F.coalesce("all_citations", empty)).withColumn("n_hits", F.size("all_citations"))
    if status.ready and not force_extractive:
        prompts = rows.where("grounded").select("question_id", prompt(F.col("context"), F.col("question")).alias("prompt"))
        rows = rows.join(asked(prompts, providers.get(provider), retries, calls, f"{name} {providers.models.get(name, '')}"), "question_id", "left")
    else:
        rows = rows.withColumns({"raw": F.lit(None).cast("string"), "error": F.lit("extractive answers were asked for" if force_extractive else status.detail)})
    used, invented = cited(F.coalesce("raw", F.lit("")), F.col("n_hits"))
    m = mode(F.col("grounded"), F.lit(status.ready and not force_extractive), F.col("error").isNotNull(), F.coalesce("raw", F.lit("")), F.col("n_hits"), F.lit(name or ""))
    rows = rows.withColumns({"mode": m, "_used": used, "invented": invented})
    text = F.when(F.col("mode") == "extractive", extractive(F.col("best"), F.col("error"))).when(F.col("mode") == "abstained", F.lit("The documents do not answer this question.")).when(F.col("mode") == "unverified", F.lit("The answer cited no passage and is withheld.")).otherwise(F.col("raw"))
    why = (
        F.when(~F.col("grounded"), F.col("reason"))
        .when(F.col("mode") == "extractive", F.col("error"))
        .when(F.col("mode") == "abstained", F.lit("The passages do not hold the answer."))
        .when(F.col("mode") == "unverified", F.lit("No marker names a passage."))
        .when(F.size("invented") > 0, F.concat(F.lit("Markers of no passage: "), F.array_join("invented", ", ")))
        .otherwise(F.lit(""))
    )
    picked = F.transform("_used", lambda i: F.element_at("all_citations", i))
    none = F.slice("all_citations", 1, 0)
    citations = F.when(F.col("mode") == "extractive", F.slice("all_citations", 1, 1)).when(F.col("mode").isin("abstained", "unverified"), none).otherwise(picked)
    return rows.select("question_id", "question", text.alias("text"), (F.col("grounded") & ~F.col("mode").isin("abstained", "unverified")).alias("grounded"), "mode", why.alias("reason"), citations.alias("citations"), "invented", "diagnostics")

