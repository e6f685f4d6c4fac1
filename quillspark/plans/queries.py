"""The registered queries: the library's operators over the given tables.

Bindings: a corpus document is a row of documents; a question is a row of
benchmark, its gold sources are the documents that contain it and its answer is
its own text; distractors are documents labelled as of low quality. Documents
have no blank lines, so paragraphs are lines here, and the likeness of
sentences is rated by their words, so its threshold is lower.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.config import sample_configs
from quillspark.functions.text import fact_found, lexical_cosine, quantised, sentences, terms, words
from quillspark.operators import analyze as A
from quillspark.operators import compressed, inverted
from quillspark.operators.chunk import chunk, chunk_all
from quillspark.operators.evaluate import config_matrix, contexts, evaluate, experiment_plan, find_hits
from quillspark.operators.index import build_index, corpus_statistics, document_frequencies, postings_of, stored_index, term_statistics
from quillspark.operators.retrieve import nearest, score_pairs
from quillspark.operators.score import fact_scores, gold_pairs, retrieval_counts
from quillspark.session import shared_folder, spread
from quillspark.sources.files import corpus_fingerprint, files_fingerprint, kept, preview, read_results, write_results, write_summary

LINE, THRESHOLD, CATEGORIES = "\n", 0.1, 5
#: Chunkings of the registered evaluation.
CHUNKINGS = ("fixed_256", "fixed_512", "semantic", "paragraph")
_SHOWN = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _named(name: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = f


def _q(c: str, digits: int = _SHOWN):
    return quantised(F.col(c), digits).alias(c)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_file"), "text"))


def whole_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each document as one chunk."""
    return documents(spark, d).select(F.lit("whole").alias("strategy"), "source_file", F.lit(0).alias("chunk_index"), "text", F.size(words(F.col("text"))).alias("n_tokens"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    return gold_pairs(documents(spark, d), questions(spark, d))


def low_quality(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").where("quality = 0").select(F.col("doc_id").cast("string").alias("source_file")).distinct()


def question_set(spark: SparkSession, d: str) -> DataFrame:
    """The bench's questions with what an evaluation needs beside its gold sources and distractors, which are tables."""
    w = words(F.col("question"))
    return questions(spark, d).select(
        "question_id", "question", F.col("question").alias("gold_answer"),
        F.array(F.get(w, F.lit(0)), F.get(w, (F.size(w) / 2).cast("int")), F.get(w, F.size(w) - 1)).alias("key_facts"), F.concat(F.lit("cat_"), F.pmod(F.col("question_id").cast("long"), F.lit(CATEGORIES))).alias("category"), F.lit("medium").alias("difficulty"),
    )


def _own_folder(spark: SparkSession) -> str:
    """Where this application keeps what its queries share; another one, perhaps of other code, makes its own."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The results of all configurations, kept by the application as a run is before its report, by the names, sizes and times of the files that are read: changed files are evaluated anew."""
    docs = documents(spark, d)
    name = files_fingerprint(spark, [f"{d}/{t}.parquet" for t in ("documents", "benchmark", "labels")], repr((CHUNKINGS, LINE, THRESHOLD)))

    def build() -> DataFrame:
        pairs = kept(spark, f"{_own_folder(spark)}/gold/{name}", lambda: gold(spark, d))  # read twice, found once
        # distractors are all low-quality documents, whatever the question
        return evaluate(docs, question_set(spark, d), CHUNKINGS, delimiter=LINE, threshold=THRESHOLD, gold=pairs, distractors=low_quality(spark, d))

    return kept(spark, f"{_own_folder(spark)}/evaluations/{name}", build)


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return A.summary(evaluation(spark, d))


# --- texts and chunks


@_query
def corpus_stats(spark, d):
    w = documents(spark, d).select("text", F.size(words(F.col("text"))).cast("long").alias("n"))
    return w.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"), F.max("n").alias("max_words"), F.sum(F.length("text")).alias("n_chars"))


@_query
def token_counts(spark, d):
    return documents(spark, d).select("source_file", F.size(words(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(terms(F.col("text")))).cast("long").alias("n_terms"))


@_query
def sentence_split(spark, d):
    return documents(spark, d).select("source_file", F.posexplode(sentences(F.col("text"))).alias("i", "s")).select("source_file", F.col("i").cast("long").alias("sentence_index"), F.md5("s").alias("sentence_md5"))


def _chunk_digest(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_file", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("text").alias("text_md5"))


for _s in CHUNKINGS:
    _named(f"chunk_{_s}", lambda spark, d, s=_s: _chunk_digest(chunk(documents(spark, d), s, LINE, THRESHOLD)))


@_query
def chunk_counts(spark, d):
    return chunk_all(documents(spark, d), CHUNKINGS, LINE, THRESHOLD).groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").cast("long").alias("n_tokens"))


# --- index


@_query
def postings_df(spark, d):
    c = whole_chunks(spark, d)
    return document_frequencies(c).join(postings_of(c).groupBy("strategy", "term").agg(F.sum("tf").alias("cf")), ["strategy", "term"]).select("term", "df", "cf")


@_query
def term_statistics_bm25(spark, d):
    c = whole_chunks(spark, d)
    return term_statistics(document_frequencies(c), corpus_statistics(c)).select("term", "df", _q("idf"), _q("weight"))


# --- retrieval over whole documents


def whole_hits(spark: SparkSession, d: str, search: str, k: int) -> DataFrame:
    """Hits over whole documents; their index is kept by the application, by the documents' fingerprint."""
    folder = f"{_own_folder(spark)}/indexes/whole-{corpus_fingerprint(documents(spark, d), 'whole')}"
    return find_hits(whole_chunks(spark, d), questions(spark, d), (search,), (k,), index=stored_index(whole_chunks(spark, d), folder))


def _hits(spark, d, search: str, k: int) -> DataFrame:
    return whole_hits(spark, d, search, k).select("question_id", F.col("rank").cast("long").alias("rank"), "source_file", _q("score"))


for _name, _search, _k in (("bm25_topk", "bm25", 10), ("vector_topk_tfidf", "vector", 5), *((f"rrf_hybrid_k{k}", "hybrid", k) for k in (3, 5, 10)), *((f"rerank_k{k}", "hybrid_rerank", k) for k in (3, 5, 10))):
    _named(_name, lambda spark, d, s=_search, k=_k: _hits(spark, d, s, k))


def keyword_questions(spark: SparkSession, d: str) -> DataFrame:
    """The four longest words of each question, of equally long ones the first by code point: as few keywords as are typed into a search."""
    longest = F.array_sort(F.transform(F.array_distinct(terms(F.col("question"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return questions(spark, d).select("question_id", F.array_join(F.slice(longest, 1, 4)["w"], " ").alias("question"))


@_query
def bm25_topk_bounds(spark, d):
    """Keyword search with bounds: of the postings only those of terms that can decide are added up, and only chunks that can be among the best are scored."""
    folder = f"{_own_folder(spark)}/indexes/whole-{corpus_fingerprint(documents(spark, d), 'whole')}"
    hits = find_hits(whole_chunks(spark, d), keyword_questions(spark, d), ("bm25",), (10,), index=stored_index(whole_chunks(spark, d), folder), bounds=True)
    return hits.select("question_id", F.col("rank").cast("long").alias("rank"), "source_file", _q("score"))


@_query
def bm25_positive_only(spark, d):
    scored = score_pairs(build_index(whole_chunks(spark, d)), questions(spark, d), vectors=False)
    return scored.where("bm25 > 0").groupBy("question_id").agg(F.count("*").alias("n_positive"), quantised(F.max("bm25"), _SHOWN).alias("best"))


@_query
def vector_topk_dense(spark, d):
    """Queries are the vectors whose id is divisible by 20, against all."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest(v, v.where("id % 20 = 0"), 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", _q("score"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The vectors, and where their indexes are kept."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    name = corpus_fingerprint(v.select(F.col("id").cast("string").alias("source_file"), F.xxhash64("vec").cast("string").alias("text")), "lists")
    return v, f"{_own_folder(spark)}/vectors/{name}"


@_query
def vector_topk_ivf(spark, d):
    """The same by the inverted file, from the lists alone that may hold one of a query's nearest."""
    v, folder = _vectors(spark, d)
    return inverted.nearest_by_bounds(inverted.stored(spark, folder, v), v.where("id % 20 = 0"), 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", _q("score"))


@_query
def vector_topk_pq(spark, d):
    """The same by product codes: their bounds leave few vectors to be scored in full."""
    v, folder = _vectors(spark, d)
    return compressed.nearest_by_codes(compressed.stored(spark, f"{folder}-codes", v), v.where("id % 20 = 0"), 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", _q("score"))


@_query
def vector_label_precision(spark, d):
    """How many of the ten nearest share the query's label."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = nearest(v, v.where("id % 20 = 0"), 10)
    a, b = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), e.select(F.col("vec_id").alias("id"), "label")
    return found.join(a, "query_id").join(b, "id").groupBy("query_id").agg(F.count_if(F.col("ql") == F.col("label")).alias("same_label"), F.count("*").alias("n"))


# --- plan, contexts, scores


@_query
def experiment_plan_rows(spark, d):
    return experiment_plan(config_matrix(spark, CHUNKINGS), questions(spark, d)).select("config_name", "chunking", "search", F.col("top_k").cast("long").alias("top_k"), "question_id")


@_query
def config_parse(spark, d):
    plan = experiment_plan(config_matrix(spark, CHUNKINGS), questions(spark, d)).select("config_name")
    return A.with_parts(plan).groupBy("config_name", "chunking", "search", F.col("top_k").cast("long").alias("top_k")).agg(F.count("*").alias("n"))


@_query
def question_filter(spark, d):
    return questions(spark, d).join(gold(spark, d).select("question_id").distinct(), "question_id", "left_semi").select("question_id", F.md5("question").alias("question_md5"))


@_query
def gold_sources(spark, d):
    return gold(spark, d)


@_query
def context_assembly(spark, d):
    return contexts(whole_hits(spark, d, "hybrid", 3), whole_chunks(spark, d)).select("question_id", F.md5("context").alias("context_md5"), F.col("context_tokens").cast("long").alias("context_tokens"), F.col("chunks_retrieved").cast("long").alias("n_chunks"))


@_query
def precision_recall_distractor(spark, d):
    scores = retrieval_counts(_hits(spark, d, "bm25", 10).withColumn("config_name", F.lit("bm25")), gold(spark, d), low_quality(spark, d))
    rows = questions(spark, d).join(scores, "question_id", "left")
    return rows.select("question_id", *[quantised(F.coalesce(c, F.lit(0.0)), _SHOWN).alias(c) for c in ("context_precision", "context_recall", "distractor_rate")])


@_query
def retrieved_context_labels(spark, d):
    """Labels of what keyword search finds: hits by quality and toxicity."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("source_file"), "quality", "toxic")
    return _hits(spark, d, "bm25", 10).join(labels, "source_file", "left").groupBy(F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic")).agg(F.count("*").alias("n_hits"))


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, question, answer: a user's turn and the assistant's next one."""
    next_turn = Window.partitionBy("conv_id").orderBy("turn")
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("next_role", F.lead("role").over(next_turn)).withColumn("answer", F.lead("text").over(next_turn))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@_query
def gold_similarity(spark, d):
    p = turn_pairs(spark, d)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lexical_cosine(terms(F.col("question")), terms(F.col("answer")))))
    return p.select("conv_id", "turn", quantised(s, _SHOWN).alias("similarity"))


@_query
def key_fact_recall(spark, d):
    """Facts are the first, middle and last word of the question's turn, looked for in the answer's."""
    w = words(F.col("question"))
    facts = F.filter(F.array(F.get(w, F.lit(0)), F.get(w, (F.size(w) / 2).cast("int")), F.get(w, F.size(w) - 1)), lambda x: x.isNotNull())
    s = fact_scores(F.col("answer"), facts)
    return turn_pairs(spark, d).select("conv_id", "turn", quantised(s["fact_recall"], _SHOWN).alias("fact_recall"), F.array_join(s["missing_facts"], "|").alias("missing_facts"))


@_query
def numeric_fact_match(spark, d):
    """Words with a digit in a page's address as facts, matched in its text."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html", F.explode(F.split(F.coalesce("url", F.lit("")), r"[/?&=#.]")).alias("fact")).where(r"fact rlike '[0-9]'")
    return p.groupBy("page_id").agg(F.count("*").alias("n_facts"), F.count_if(fact_found(F.coalesce("html", F.lit("")), F.col("fact"))).alias("n_found"))


# --- evaluation and its analysis


@_query
def eval_results(spark, d):
    e = evaluation(spark, d)
    return e.select("config_name", "question_id", "question_category", F.col("chunks_retrieved").cast("long").alias("chunks_retrieved"), F.col("context_tokens").cast("long").alias("context_tokens"), _q("context_precision"), _q("context_recall"), _q("distractor_rate"), _q("gold_similarity"), _q("fact_recall"), _q("total_latency_ms"), F.md5("generated_answer").alias("answer_md5"))


@_query
def summary_by_config(spark, d):
    return summaries(spark, d).select("config_name", *[_q(f"avg_{m}") for m in A.MEASURES])


@_query
def best_worst(spark, d):
    return A.best_and_worst(summaries(spark, d))


for _dim in ("search", "chunking", "top_k"):
    _named(f"grid_{_dim}_by_category", lambda spark, d, x=_dim: A.grid(evaluation(spark, d), x).select("question_category", F.col(x).cast("string").alias(x), _q("similarity")))


@_query
def grids_in_one_pass(spark, d):
    return A.all_grids(evaluation(spark, d)).select("question_category", "chunking", "search", F.col("top_k").cast("long").alias("top_k"), _q("similarity"))


@_query
def failure_modes(spark, d):
    return A.failure_modes(evaluation(spark, d))


@_query
def failure_mode_pct(spark, d):
    return A.failure_shares(evaluation(spark, d)).select("config_name", "mode", _q("pct"), _q("bar_start"))


@_query
def top10_bottom5(spark, d):
    return A.top_and_bottom(summaries(spark, d)).select(F.col("place").cast("long").alias("place"), "end", "config_name")


@_query
def pareto_frontier(spark, d):
    return A.pareto_frontier(summaries(spark, d)).select("config_name", _q("cost"), _q("quality"))


@_query
def plateau_tokens(spark, d):
    return A.plateau(summaries(spark, d)).select(F.col("plateau_tokens").cast("long").alias("plateau_tokens"))


@_query
def trend_fit(spark, d):
    return A.trend(summaries(spark, d)).select(_q("centre", 4), _q("scale", 4), _q("c0", 4), _q("c1", 4), _q("c2", 4))


@_query
def strategy_rank(spark, d):
    return A.strategy_rank(evaluation(spark, d)).select("search", _q("similarity"), F.col("rank").cast("long").alias("rank"))


@_query
def rerank_gain(spark, d):
    return A.rerank_gain(evaluation(spark, d)).select(_q("gain_pct", 4), _q("latency_ms", 4))


@_query
def overall_means(spark, d):
    return A.overall(evaluation(spark, d)).select("n_results", _q("mean_similarity"), _q("mean_fact_recall"))


@_query
def results_json_roundtrip(spark, d):
    """Results written as JSON lines and read again under the strict schema, compared by a count and sums."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    write_results(evaluation(spark, d), path)
    back = read_results(spark, path)
    return back.groupBy("config_name").agg(F.count("*").alias("n"), F.sum(F.col("context_tokens").cast("long")).alias("context_tokens"), F.sum(F.size("missing_facts").cast("long")).alias("n_missing"))


@_query
def quick_sample(spark, d):
    """Eight configurations that cycle through the dimensions, and one question picked by a hash of the seed."""
    picked = questions(spark, d).orderBy(F.md5(F.concat(F.lit("42:"), "question_id"))).limit(1).select("question_id")
    names = [(i, c.name) for i, c in enumerate(sample_configs(8, 42))]
    configs = spark.createDataFrame(names, "place long, config_name string")
    return evaluation(spark, d).join(picked, "question_id", "left_semi").join(F.broadcast(configs), "config_name").select("place", "config_name", "question_id", _q("gold_similarity"), _q("fact_recall"))


@_query
def hit_preview(spark, d):
    """What the console shows of each hit: its score at four digits and the first 300 characters."""
    return preview(whole_hits(spark, d, "hybrid", 3), whole_chunks(spark, d)).select("question_id", F.col("rank").cast("long").alias("rank"), "source_file", F.md5("preview").alias("preview_md5"))


@_query
def summary_csv_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/summary-{uuid.uuid4().hex}"
    write_summary(summaries(spark, d), path)
    back = spark.read.option("header", True).schema("config_name string, " + ", ".join(f"avg_{m} double" for m in A.MEASURES)).csv(path)
    return back.select("config_name", _q("avg_gold_similarity"), _q("avg_context_tokens"))
