"""Command line: run, single, quick, report, clean.

    python -m quillspark.cli run --corpus DIR --questions FILE --out DIR [--configs a,b] [--ids q1,q2] [--llm local|cloud|auto]
        [--embedder pkg.module:name] [--reranker pkg.module:name] [--tokenizer pkg.module:name]

Without --llm answers are extracts of the best chunk. A model is named by a
module and what to call in it without arguments. Index, vectors, answers and the
parts of a run are kept below --out: a run that was broken off goes on.
"""

from __future__ import annotations

import argparse
import importlib
import os
import random
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import CHUNKINGS, SEARCHES, RetrievalConfig, all_configs, choose_llm, llm_presets, parse_name, sample_configs
from quillspark.operators.analyze import overall, summary
from quillspark.operators.chunk import chunk
from quillspark.operators.evaluate import evaluate, find_hits, run, run_name
from quillspark.providers import Models
from quillspark.sources import files
from quillspark.sources.report import write_charts, write_report


def evaluate_configs(docs: DataFrame, questions: DataFrame, configs: list[RetrievalConfig], models: Models = Models(), index_folder: str | None = None, parts: str | None = None, progress=None) -> DataFrame:
    """Results of just these configurations in the list's order; one named twice has its rows twice, though it is evaluated once. With `parts` results are kept there (see run)."""
    chunkings = [c for c in CHUNKINGS if c in {x.chunking for x in configs}]
    searches = [s for s in SEARCHES if s in {x.search for x in configs}]
    if parts:
        results = run(docs, questions, configs, f"{parts}/{run_name(docs, models)}", models, index_folder, progress)
    else:
        results = evaluate(docs, questions, chunkings, searches, sorted({x.top_k for x in configs}), models=models, index_folder=index_folder)
    listed = docs.sparkSession.createDataFrame([(k, c.name) for k, c in enumerate(configs)], "place int, config_name string")
    return results.join(F.broadcast(listed), "config_name").orderBy("place", "question_id").drop("place")


def _made(name: str):
    """What pkg.module:name gives when it is called."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def _models(a: argparse.Namespace) -> Models:
    llm = choose_llm(llm_presets(os.environ), None if a.llm == "auto" else a.llm) if a.llm else None
    return Models(_made(a.embedder), _made(a.reranker), llm, tokenizer=_made(a.tokenizer), store=f"{a.out}/models")


def _say(p: dict) -> None:
    print(f"{p['part']} of {p['parts']}: {p['chunking']} {p['search']}, {p['rows']} rows in {p['seconds']:.1f} s", file=sys.stderr, flush=True)


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    questions = files.read_questions(spark, a.questions)
    if a.ids:
        questions = questions.where(F.col("question_id").isin(a.ids.split(",")))  # unknown ids are ignored
    configs = [parse_name(n.strip()) for n in a.configs.split(",")] if a.configs else all_configs()
    if a.command == "quick":
        configs = sample_configs(a.n, a.seed)
        ids = sorted(r.question_id for r in questions.select("question_id").collect())  # the question set is a file
        questions = questions.where(F.col("question_id") == random.Random(a.seed).choice(ids))
    files.write_results(evaluate_configs(files.read_corpus(spark, a.corpus), questions, configs, _models(a), f"{a.out}/indexes", f"{a.out}/parts" if a.command == "run" else None, _say), f"{a.out}/results")
    overall(files.read_results(spark, f"{a.out}/results")).show()


def _single(spark: SparkSession, a: argparse.Namespace) -> None:
    config = parse_name(a.configs)
    asked = files.read_questions(spark, a.questions).where(F.col("question_id") == a.ids)
    if asked.isEmpty():
        raise SystemExit(f"no question {a.ids!r}")
    docs = files.read_corpus(spark, a.corpus)
    models = _models(a)
    chunks = chunk(docs, config.chunking, embedder=models.embedder, tokenizer=models.tokenizer)
    files.preview(find_hits(chunks, asked, (config.search,), (config.top_k,), models), chunks).orderBy("rank").show(truncate=False)
    evaluate_configs(docs, asked, [config], models).show(vertical=True, truncate=False)


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    results = files.read_results(spark, f"{a.out}/results")
    files.write_summary(summary(results), f"{a.out}/summary")
    write_report(results, f"{a.out}/report.md")
    print("\n".join(write_charts(results, f"{a.out}/charts")) or "no charts: matplotlib is not installed")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["run", "single", "quick", "report", "clean"])
    for name in ("corpus", "questions", "configs", "ids"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--out", default="results_out")
    p.add_argument("--n", type=int, default=5)
    p.add_argument("--seed", type=int, default=42)
    for name in ("llm", "embedder", "reranker", "tokenizer"):
        p.add_argument(f"--{name}", default="")
    a = p.parse_args(argv)
    if a.command == "clean":
        print("\n".join(files.clean(a.out)))
        return
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    {"run": _run, "quick": _run, "single": _single, "report": _report}[a.command](spark, a)


if __name__ == "__main__":
    main()
