"""The evaluation: every configuration answers every question, and each answer is scored."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.config import CHUNKINGS, DEPTH, SEARCHES, SEMANTIC_THRESHOLD, TOP_KS, RetrievalConfig
from quillspark.functions.text import lexical_cosine, terms
from quillspark.operators.chunk import chunk_all
from quillspark.operators.index import KEY, build_index
from quillspark.operators.ranges import range_hits
from quillspark.operators.retrieve import best_pairs, nearest, ranked_pairs, retrieve
from quillspark.operators.score import fact_scores, retrieval_counts, vector_similarity
from quillspark.providers import Models, chat_answers, embed, extractive_answer, model_name, rescore
from quillspark.schemas import RESULTS
from quillspark.session import shared_folder
from quillspark.sources.files import corpus_fingerprint
from quillspark.sources.segments import SegmentStore

SEPARATOR = "\n---\n"


def config_matrix(spark, chunkings=CHUNKINGS, searches=SEARCHES, top_ks=TOP_KS) -> DataFrame:
    """config_name, chunking, search, top_k: the full factorial."""
    part = lambda name, values: spark.createDataFrame([(v,) for v in values], [name])
    out = part("chunking", chunkings).crossJoin(part("search", searches)).crossJoin(part("top_k", top_ks).withColumn("top_k", F.col("top_k").cast("int")))
    return out.select(F.concat_ws("__", "chunking", "search", F.concat(F.lit("k"), F.col("top_k"))).alias("config_name"), "chunking", "search", "top_k")


def experiment_plan(configs: DataFrame, questions: DataFrame) -> DataFrame:
    """Every configuration with every question; the configurations are the few rows that are sent around."""
    return questions.crossJoin(F.broadcast(configs))


def contexts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """config_name, question_id, context, context_tokens, sources, best_text, chunks_retrieved.

    Chunks come in the order of their rank; tokens include the separators'.
    """
    texts = chunks.select("strategy", "source_file", "chunk_index", "text", "n_tokens")
    joined = hits.join(texts, ["strategy", "source_file", "chunk_index"])
    ordered = joined.groupBy("config_name", "question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "source_file", "n_tokens"))).alias("h"))
    tokens = F.aggregate("h", F.lit(0), lambda acc, x: acc + x["n_tokens"]) + F.size("h") - 1
    return ordered.select("config_name", "question_id", F.array_join(F.col("h.text"), SEPARATOR).alias("context"), tokens.cast("int").alias("context_tokens"), F.col("h.source_file").alias("sources"), F.get("h.text", F.lit(0)).alias("best_text"), F.size("h").alias("chunks_retrieved"))


def vector_pairs(chunks: DataFrame, questions: DataFrame, models: Models, depth: int) -> DataFrame:
    """KEY, question_id, cosine: the `depth` nearest chunks of each question by the embedder's vectors."""
    keyed = chunks.select(*KEY, "text", F.xxhash64(*KEY).alias("id"))
    asked = embed(questions.select("question_id", F.xxhash64(F.lit("question"), "question_id").alias("id"), F.coalesce("question", F.lit("")).alias("text")), models.embedder, store=models.store)
    out = None
    for strategy in sorted(r["strategy"] for r in chunks.select("strategy").distinct().collect()):  # the names of the chunkings
        held = embed(keyed.where(F.col("strategy") == strategy), models.embedder, store=models.store)
        found = nearest(held.select("id", "vec"), asked.select("id", "vec"), depth).withColumn("strategy", F.lit(strategy))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return keyed.select(*KEY, F.lit("").alias("question_id"), F.lit(0.0).alias("cosine")).limit(0)
    return out.join(keyed.drop("text"), ["strategy", "id"]).join(asked.select(F.col("id").alias("query_id"), "question_id"), "query_id").select(*KEY, "question_id", F.col("score").alias("cosine"))


def find_hits(chunks: DataFrame, questions: DataFrame, searches=SEARCHES, top_ks=TOP_KS, models: Models = Models(), index=None, bounds: bool | None = None) -> DataFrame:
    """The hits of every configuration; `bounds` as in best_pairs. With an embedder vector search goes by its vectors, with a reranker rescoring by its scores, else by their stand-ins."""
    depth = max(top_ks) * max(DEPTH[s] for s in searches)
    own_vectors = set(searches) != {"bm25"} and models.embedder is None
    pairs = best_pairs(index or build_index(chunks), questions, depth, own_vectors, bounds)
    if models.embedder and set(searches) != {"bm25"}:
        on = [*KEY, "question_id"]
        pairs = pairs.drop("cosine").join(vector_pairs(chunks, questions, models, depth), on, "full").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    ranked = ranked_pairs(pairs, depth)
    if models.reranker and "hybrid_rerank" in searches:
        texts = ranked.join(chunks.select(*KEY, "text"), KEY).join(questions.select("question_id", "question"), "question_id")
        ranked = rescore(texts, models.reranker).withColumn("coverage", F.col("rerank_score")).drop("text", "question", "rerank_score")
    return retrieve(ranked, searches, top_ks)


def measured_hits(chunks: DataFrame, questions: DataFrame, searches=SEARCHES, top_ks=TOP_KS, models: Models = Models(), index=None) -> tuple[DataFrame, dict[str, float]]:
    """The hits of every configuration, and for each search the milliseconds that it took a question.

    Questions are answered together, so a question's time is its share of its
    search's: the wall-clock time until the hits of the search, of all depths, are
    a table in the shared folder. Chunks are cut before; what an index that is
    not stored yet has to make for a search counts.
    """
    spark = chunks.sparkSession
    folder = f"{shared_folder(spark)}/hits-{uuid.uuid4().hex}"
    if index is None:
        chunks.write.parquet(f"{folder}/chunks")
        chunks = spark.read.schema(chunks.schema).parquet(f"{folder}/chunks")
    asked, taken, out = questions.count(), {}, None
    for search in searches:
        begin = time.monotonic()
        found = find_hits(chunks, questions, (search,), top_ks, models, index)
        found.write.parquet(f"{folder}/{search}")
        taken[search] = 1000.0 * (time.monotonic() - begin) / max(asked, 1)
        found = spark.read.schema(found.schema).parquet(f"{folder}/{search}")
        out = found if out is None else out.unionByName(found)
    return out, taken


def evaluate(
    docs: DataFrame, questions: DataFrame, chunkings=CHUNKINGS, searches=SEARCHES, top_ks=TOP_KS, delimiter: str = "\n\n", threshold: float = SEMANTIC_THRESHOLD, models: Models = Models(), index_folder: str | None = None, gold: DataFrame | None = None, distractors: DataFrame | None = None, only: DataFrame | None = None, measured: bool | None = None
) -> DataFrame:
    """A row for each configuration and question, also where nothing is retrieved.

    questions: question_id, question, category, difficulty, gold_answer,
    key_facts, and gold_source_ids, distractors unless these are given as tables
    (see retrieval_counts). Models that are not given have stand-ins: answers are
    then extracts and latencies modelled, so that results repeat: a candidate
    costs 1 ms, a rescored one 20 ms, a context token 0.5 ms. With an
    index_folder chunks and index are kept there and brought up to date: of a
    corpus that was changed since, only new and changed documents are cut and tokenised.
    `only` (config_name, question_id) leaves out all other rows before anything is answered.
    With `measured`, or where it is None and any of the three models is given,
    retrieval latency is measured instead (see measured_hits), and each search runs by itself.
    """
    cut = lambda d: chunk_all(d, chunkings, delimiter, threshold, models.embedder, models.tokenizer)
    if index_folder:
        settings = hashlib.sha256(repr((tuple(chunkings), delimiter, threshold, model_name(models.embedder))).encode()).hexdigest()[:16]
        store = SegmentStore(docs.sparkSession, f"{index_folder}/{settings}", cut)
        index = store.index(store.update(docs))
        chunks = index.chunks
    else:
        chunks, index = cut(docs), None
    measured = any((models.embedder, models.reranker, models.llm)) if measured is None else measured
    plain = not (index_folder or measured or any((models.embedder, models.reranker, models.tokenizer)))
    if plain and (found := range_hits(docs, questions, chunkings, searches, top_ks, delimiter, threshold)):
        (hits, chunks), taken = found, {}
    else:
        hits, taken = measured_hits(chunks, questions, searches, top_ks, models, index) if measured else (find_hits(chunks, questions, searches, top_ks, models, index), {})
    plan = experiment_plan(config_matrix(docs.sparkSession, chunkings, searches, top_ks), questions)
    plan = plan if only is None else plan.join(only.select("config_name", "question_id"), ["config_name", "question_id"], "left_semi")
    gold = questions.select("question_id", F.explode("gold_source_ids").alias("source_file")) if gold is None else gold
    distractors = questions.select("question_id", F.explode("distractors").alias("source_file")) if distractors is None else distractors
    rows = plan.join(contexts(hits, chunks), ["config_name", "question_id"], "left").join(retrieval_counts(hits, gold, distractors), ["config_name", "question_id"], "left")
    tokens, got = F.coalesce("context_tokens", F.lit(0)), F.coalesce("chunks_retrieved", F.lit(0))
    if models.llm:
        rows = chat_answers(rows.withColumn("context", F.coalesce("context", F.lit(""))), models.llm, models.prompt, store=models.store).withColumnRenamed("answer", "generated_answer")
    else:
        rows = rows.withColumn("generated_answer", F.when(F.col("chunks_retrieved") > 0, extractive_answer(F.col("question"), F.col("best_text"))).otherwise("")).withColumn("generation_latency_ms", (0.5 * tokens).cast("double"))
    reach = F.col("top_k") * F.when(F.col("search") == "hybrid", 2 * DEPTH["hybrid"]).when(F.col("search") == "hybrid_rerank", 22 * DEPTH["hybrid_rerank"]).otherwise(1)
    if taken:
        reach = F.element_at(F.create_map(*[F.lit(x) for pair in taken.items() for x in pair]), F.col("search"))
    if models.embedder:
        both = embed(embed(rows, models.embedder, "generated_answer", "answer_vec", models.store), models.embedder, "gold_answer", "gold_vec", models.store)
        rows, similarity = both, vector_similarity(F.col("answer_vec"), F.col("gold_vec"))
    else:
        similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lexical_cosine(terms(F.col("generated_answer")), terms(F.col("gold_answer")))))
    facts = fact_scores(F.col("generated_answer"), F.col("key_facts"))
    return rows.select(
        "config_name", "question_id", F.col("question").alias("question_text"), F.col("category").alias("question_category"), F.col("difficulty").alias("question_difficulty"), got.cast("int").alias("chunks_retrieved"), reach.cast("double").alias("retrieval_latency_ms"), "generation_latency_ms",
        (reach + F.col("generation_latency_ms")).cast("double").alias("total_latency_ms"), tokens.cast("int").alias("context_tokens"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("context_precision", "context_recall", "distractor_rate")], similarity.alias("gold_similarity"), facts["fact_recall"].alias("fact_recall"),
        facts["missing_facts"].alias("missing_facts"), "generated_answer", "gold_answer",
    )


def run(docs: DataFrame, questions: DataFrame, configs: list[RetrievalConfig], path: str, models: Models = Models(), index_folder: str | None = None, progress: Callable[[dict], None] | None = None, **settings) -> DataFrame:
    """Results of the configurations for the questions, kept at path part by part, a part being a chunking and a search.

    What is there already is not evaluated again: a run that was broken off goes on, a configuration
    or question that is added, or a question that is changed, is evaluated alone.
    path has to be named for what results depend on besides (corpus, models,
    settings): see run_name. Rows are told apart by configuration, question and
    the question's fingerprint, so each is there once. progress is told of each
    part when it is there: part (from 1), parts, chunking, search, rows (evaluated now) and seconds.
    """
    spark = docs.sparkSession
    plan = spark.createDataFrame([(c.name, c.chunking, c.search) for c in dict.fromkeys(configs)], "config_name string, chunking string, search string")
    key = ["config_name", "question_id", "print"]
    marked = questions.withColumn("print", F.xxhash64(*[c for c in ("question", "gold_answer", "key_facts", "gold_source_ids", "distractors", "category", "difficulty") if c in questions.columns]))
    wanted = marked.select("question_id", "print").distinct().crossJoin(F.broadcast(plan))  # configurations are few
    parts = list(dict.fromkeys((c.chunking, c.search) for c in configs))
    for k, (chunking, search) in enumerate(parts):
        begin, counted = time.monotonic(), Observation()
        tell = lambda rows: progress and progress({"part": k + 1, "parts": len(parts), "chunking": chunking, "search": search, "rows": rows, "seconds": time.monotonic() - begin})  # noqa: B023, E731
        lacking = wanted.where((F.col("chunking") == chunking) & (F.col("search") == search)).join(_results(spark, path).select(*key), key, "left_anti")
        names = [r["config_name"] for r in lacking.select("config_name").distinct().collect()]
        if not names:
            tell(0)
            continue
        top_ks = sorted({c.top_k for c in configs if c.name in names})
        asked = questions.join(lacking.select("question_id").distinct(), "question_id", "left_semi")
        made = evaluate(docs, asked, (chunking,), (search,), top_ks, models=models, index_folder=index_folder, only=lacking, **settings)
        made.join(marked.select("question_id", "print"), "question_id").observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy("config_name").parquet(path)
        tell(counted.get["rows"])
    return _results(spark, path).join(wanted.select(*key), key, "left_semi").select(*StructType.fromDDL(RESULTS).names)


def _results(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(f"{RESULTS}, print long").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{RESULTS}, print long")


def run_name(docs: DataFrame, models: Models = Models(), settings: str = "") -> str:
    """A name that changes with the corpus, a model or a setting."""
    parts = [model_name(models.embedder), model_name(models.reranker), model_name(models.tokenizer), f"{models.llm.base_url} {models.llm.model} {models.prompt}" if models.llm else "", settings]
    return corpus_fingerprint(docs, repr(parts))
