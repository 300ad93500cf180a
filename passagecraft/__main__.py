"""python -m passagecraft ingest|ask|status|eval|calibrate: a thin command line; main() takes answer back ends from a caller."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from passagecraft import api
from passagecraft.operators import index
from passagecraft.operators.answering import Providers
from passagecraft.schema import STRATEGIES, SWEEP, ChunkConfig, RetrievalParams
from passagecraft.sources import files


def _gold(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return files.read_questions(spark, f.read()).withColumnRenamed("id", "question_id")


def main(argv: list[str] | None = None, providers: Providers | None = None) -> int:
    providers = providers or Providers()
    p = argparse.ArgumentParser(prog="passagecraft")
    p.add_argument("--store", required=True)
    p.add_argument("--corpus", default="default")
    p.add_argument("--strategy", choices=STRATEGIES, default="recursive")
    p.add_argument("--chunk-size", type=int, default=800)
    p.add_argument("--overlap", type=int, default=150)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("root")
    i.add_argument("--all-sizes", action="store_true")
    a = sub.add_parser("ask")
    a.add_argument("question")
    a.add_argument("--top-k", type=int, default=5)
    a.add_argument("--candidates", type=int, default=20)
    a.add_argument("--no-rerank", action="store_true")
    a.add_argument("--doc-type")
    a.add_argument("--effective-after")
    a.add_argument("--min-cosine", type=float)
    a.add_argument("--min-rerank", type=float)
    a.add_argument("--extractive", action="store_true")
    a.add_argument("--model", help="another model of the provider")
    a.add_argument("--provider", choices=sorted(providers.known) if providers.known else None)
    a.add_argument("--show-chunks", action="store_true")
    sub.add_parser("status")
    e = sub.add_parser("eval")
    e.add_argument("root")
    e.add_argument("--questions", required=True)
    e.add_argument("--top-k", type=int, default=5)
    e.add_argument("--no-rerank", action="store_true")
    e.add_argument("--detail", action="store_true")
    c = sub.add_parser("calibrate")
    c.add_argument("--questions", required=True)
    c.add_argument("--detail", action="store_true")
    o = p.parse_args(argv)
    spark = SparkSession.builder.appName("passagecraft").getOrCreate()
    cfg = ChunkConfig(o.strategy, o.chunk_size, o.overlap)
    if o.command == "ingest":
        for c in SWEEP if o.all_sizes else (cfg,):
            api.ingest(spark, o.root, o.store, c, o.corpus).show(truncate=False)
    elif o.command == "ask":
        params = RetrievalParams(o.top_k, o.candidates, not o.no_rerank, True, o.doc_type, o.effective_after, o.min_cosine, o.min_rerank)
        name = o.provider or providers.default
        some = providers.with_model(name, o.model) if o.model and name else providers
        for r in api.ask(spark, o.question, o.store, cfg, o.corpus, params, providers=some, provider=o.provider, force_extractive=o.extractive).collect():
            print(r.text, *(f"[{c.n}] {c.label}" for c in r.citations), r.reason, sep="\n")
        if o.show_chunks:
            api.hits(spark, o.question, o.store, cfg, o.corpus, params).select("rank", "cosine", "rerank_score", "label", "text").orderBy("rank").show(o.top_k, truncate=False)
    elif o.command == "eval":
        params = RetrievalParams(o.top_k, rerank=not o.no_rerank)
        api.evaluate(spark, _gold(spark, o.questions), o.root, o.store, corpus_id=o.corpus, params=params).show(truncate=False)
        if o.detail:
            for each in SWEEP:
                print(each.slug)
                api.ranks(spark, _gold(spark, o.questions), o.store, each, o.corpus, params).show(10_000, truncate=False)
    elif o.command == "calibrate":
        if index.read(spark, o.store, o.corpus, cfg).isEmpty():
            print(f"no index of {o.corpus}: ingest it first")
            return 1
        api.calibrate(spark, _gold(spark, o.questions), o.store, cfg, o.corpus).show(truncate=False)
        if o.detail:
            api.scores(spark, _gold(spark, o.questions), o.store, cfg, o.corpus).show(10_000, truncate=False)
    else:
        index.catalog(spark, o.store).show(truncate=False)
        for name, active, ready, model, detail in providers.table():
            print(f"{'*' if active else ' '} {name:<12} {'ready' if ready else 'not ready':<10} {model} {detail}")
        if not providers.status().ready:
            print(f"answers are passages only: {providers.status().detail}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
