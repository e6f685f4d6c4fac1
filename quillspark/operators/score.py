"""Scores of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import fact_found

#: Questions that are sent to all executors, at most, when texts are searched for them.
SENT_QUESTIONS = 10_000


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def retrieval_scores(sources: Column, gold: Column, distractors: Column) -> dict[str, Column]:
    """precision, recall and distractor rate of a list of sources.

    Repeated chunks of a source count each; every listed gold source counts,
    repeats included. Nothing retrieved, no gold or no distractors give 0.
    """
    got = F.coalesce(sources, F.array().cast("array<string>"))
    want, bad = (F.coalesce(x, F.array().cast("array<string>")) for x in (gold, distractors))
    hit = F.size(F.filter(got, lambda s: F.array_contains(want, s)))
    covered = F.size(F.filter(want, lambda g: F.array_contains(got, g)))
    wrong = F.size(F.filter(got, lambda s: F.array_contains(bad, s)))
    return {"context_precision": _share(hit, F.size(got)), "context_recall": F.when(F.size(got) > 0, _share(covered, F.size(want))).otherwise(0.0), "distractor_rate": _share(wrong, F.size(got))}


def retrieval_counts(hits: DataFrame, gold: DataFrame, bad: DataFrame) -> DataFrame:
    """config_name, question_id and the scores of retrieval_scores, by joins: no list of gold sources or distractors is ever gathered.

    hits: config_name, question_id, source_file, a row for each retrieved chunk.
    gold: question_id, source_file, repeats counted. bad: source_file, and
    question_id where distractors differ by question. Questions without a hit
    have no row.
    """
    got = hits.groupBy("config_name", "question_id", "source_file").agg(F.count("*").alias("times"))
    got = got.join(gold.groupBy("question_id", "source_file").agg(F.count("*").alias("wanted")), ["question_id", "source_file"], "left")
    on = [c for c in ("question_id", "source_file") if c in bad.columns]
    got = got.join(bad.select(*on).distinct().withColumn("bad", F.lit(True)), on, "left")
    of = lambda on: F.coalesce(F.sum(F.when(on, F.col("times"))), F.lit(0))
    sums = got.groupBy("config_name", "question_id").agg(F.sum("times").alias("n"), of(F.col("wanted").isNotNull()).alias("hit"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("covered"), of(F.col("bad")).alias("wrong"))
    sums = sums.join(gold.groupBy("question_id").agg(F.count("*").alias("n_gold")), "question_id", "left")
    return sums.select("config_name", "question_id", _share(F.col("hit"), F.col("n")).alias("context_precision"), _share(F.col("covered"), F.coalesce("n_gold", F.lit(0))).alias("context_recall"), _share(F.col("wrong"), F.col("n")).alias("distractor_rate"))


def fact_scores(answer: Column, facts: Column) -> dict[str, Column]:
    """fact_recall, found_facts, missing_facts; without facts recall is 1. Lists keep the order of facts."""
    facts, answer = F.coalesce(facts, F.array().cast("array<string>")), F.coalesce(answer, F.lit(""))
    found = F.filter(facts, lambda f: fact_found(answer, f))
    return {"fact_recall": F.when(F.size(facts) > 0, F.size(found) / F.size(facts)).otherwise(1.0), "found_facts": found, "missing_facts": F.filter(facts, lambda f: ~fact_found(answer, f))}


def vector_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors with a guarded denominator, held within 0 and 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)))


def gold_pairs(docs: DataFrame, questions: DataFrame, block: int = 1000) -> DataFrame:
    """question_id, source_file of documents that contain a question's text.

    A text that contains another has its inner words as they stand, so the
    longest inner word is the join key, and `contains` is checked. Up to
    SENT_QUESTIONS questions are sent to the texts, so nothing travels; for more,
    texts are fetched for what the key brings together only. Questions of fewer
    than three words have no inner word: they are held against all texts, `block`
    of them at a time.
    """
    from quillspark.functions.text import words

    inner = F.slice(words(F.col("question")), 2, F.greatest(F.size(words(F.col("question"))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = questions.where("question is not null").select("question_id", "question", longest.alias("word"))
    keyed, short = asked.where("word is not null"), asked.where("word is null").drop("word")
    each = F.explode(F.array_distinct(words(F.col("text")))).alias("word")
    if keyed.limit(SENT_QUESTIONS + 1).count() <= SENT_QUESTIONS:
        found = docs.select("source_file", "text", each).join(F.broadcast(keyed), "word").where(F.contains("text", "question")).select("question_id", "source_file")
    else:
        held = docs.select("source_file", each).join(keyed.select("word").distinct(), "word", "left_semi")
        met = held.join(keyed.select("word", "question_id"), "word").select("source_file", "question_id").distinct()
        found = met.join(keyed.drop("word"), "question_id").join(docs, "source_file").where(F.contains("text", "question")).select("question_id", "source_file")
    blocks = -(-short.count() // block)
    for k in range(blocks):
        part = short.where(F.pmod(F.xxhash64("question_id", "question"), F.lit(blocks)) == k)
        found = found.unionByName(docs.join(F.broadcast(part), F.contains("text", "question")).select("question_id", "source_file"))
    return found.distinct()
