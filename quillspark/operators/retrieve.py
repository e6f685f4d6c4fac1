"""Retrieval: keyword (BM25), vector (cosine), hybrid by reciprocal rank fusion, and hybrid with rescoring.

Every depth is a prefix of one ranked list, so lists are made once, at the
largest depth, and each configuration cuts its own part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.config import DEPTH, RRF_CONSTANT, SEARCHES, TOP_KS
from quillspark.functions.text import quantised, terms
from quillspark.operators.index import KEY, Index, damped

#: Vectors of one block of the exact nearest-neighbour search.
BLOCK_ROWS = 4096
#: Rows of a side that is sent to all executors, at most (about 100 MB).
BROADCAST_ROWS = 1_000_000
#: Questions that are scored against a block of chunks at once, at most, and scores of a block; more questions are joined.
DENSE_QUESTIONS, BLOCK_SCORES = 4096, 1 << 21
#: Chunks that a question's rarest terms lead to before its least score is taken, as a multiple of the depth; and what rounding may take from a bound.
SEED_CHUNKS, BOUND_SLACK = 4, 1e-9
#: A posting that is added up by itself costs as much as so many scores of a block.
PAIR_COST = 4


def query_terms(questions: DataFrame) -> DataFrame:
    """question_id, term, qtf."""
    return questions.select("question_id", F.explode(terms(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qtf"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to all executors if its known number of rows is within bounds."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def score_pairs(index: Index, questions: DataFrame, vectors: bool = True) -> DataFrame:
    """strategy, question_id, chunk, bm25, cosine, coverage of all pairs that share a term.

    Postings are reduced to the questions' terms and dealt by chunk; if the
    questions' terms are few enough to be sent around, pairs are then made and
    summed where the chunk is, so the many rows of frequent terms never travel.
    Without `vectors` no norms are computed and cosine is null.
    """
    asked = query_terms(questions)
    n_asked = asked.count()
    strategies = index.corpus_stats.count()
    stats = index.term_stats.join(_small(asked.select("term").distinct(), n_asked), "term", "left_semi")
    by_question = asked.join(stats, "term").withColumn("qw", F.col("qtf") * F.col("weight"))
    norms = by_question.groupBy("strategy", "question_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    sizes = asked.groupBy("question_id").agg(F.count("*").alias("qsize"))
    known = index.postings.join(_small(asked.select("term").distinct(), n_asked), "term", "left_semi").join(F.broadcast(index.corpus_stats.select("strategy", "avgdl")), "strategy")
    known = known.select(*KEY, "term", "tf", damped(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("damped")).repartition(*KEY)
    asks = by_question.select("strategy", "term", "question_id", (F.col("qtf") * F.col("idf")).alias("b"), (F.col("qw") * F.col("weight")).alias("c"))
    met = known.join(_small(asks, n_asked * strategies), ["strategy", "term"])
    sums = met.groupBy(*KEY, "question_id").agg(F.sum(F.col("b") * F.col("damped")).alias("bm25"), F.sum(F.col("c") * F.col("tf")).alias("dot"), F.count("*").alias("shared"))
    out, cosine = sums.join(_small(sizes, n_asked), "question_id"), F.lit(None).cast("double")
    if vectors:
        out = out.join(index.norms, KEY).join(_small(norms, n_asked * strategies), ["strategy", "question_id"])
        cosine = F.col("dot") / (F.col("norm") * F.col("qnorm") + 1e-10)
    return out.select("strategy", "question_id", "source_file", "chunk_index", "bm25", cosine.alias("cosine"), (F.col("shared") / F.col("qsize")).alias("coverage"))


class _Best:
    """The best `depth` chunks of each question by one score: highest at nine digits first, equals by source_file and chunk_index."""

    def __init__(self, depth: int):
        self.depth, self.kept = depth, {}

    def add(self, question: tuple, scores: np.ndarray, chunks: list[tuple[str, int]], on: np.ndarray, values: tuple[np.ndarray, ...]) -> None:
        rows = np.flatnonzero(on)
        if not len(rows):
            return
        by = np.floor(scores[rows] * 1e9 + 0.5)
        if len(rows) > self.depth:
            far = by >= np.partition(by, len(by) - self.depth)[len(by) - self.depth]
            rows, by = rows[far], by[far]
        new = [(-b, *chunks[r], *(float(v[r]) for v in values)) for b, r in zip(by.tolist(), rows.tolist(), strict=True)]
        self.kept[question] = sorted(self.kept.get(question, []) + new)[: self.depth]


def best_pairs(index: Index, questions: DataFrame, depth: int, vectors: bool = True, bounds: bool | None = None) -> DataFrame:
    """The rows of score_pairs that are among a question's `depth` best by bm25 or by cosine, and a few more: what ranked_pairs needs.

    A task scores blocks of chunks, of which the index has all terms, against all
    questions and passes on only its own best of each question, so pairs are
    neither shuffled nor written. For keywords alone bounds can show which chunks
    may be among the best (see candidates), and others are not scored: so it is
    done with `bounds`, or where that is not said if the postings to be added up
    are few against all pairs of chunks and questions. The result is the same.
    With more questions than can be sent around, pairs are made by a join.
    """
    asked = query_terms(questions)
    size = asked.agg(F.count("*").alias("rows"), F.count_distinct("question_id").alias("questions")).first()
    if size["rows"] * index.corpus_stats.count() > BROADCAST_ROWS or size["questions"] > DENSE_QUESTIONS:
        return score_pairs(index, questions, vectors)
    sides = asked_sides(index, asked)
    if vectors:
        return _scored(index.forward.join(index.norms, KEY), index, sides, depth, True)
    chosen = candidates(index, sides, depth, bounds) if bounds is not False else None
    held = index.forward if chosen is None else index.forward.join(chosen, KEY, "left_semi")
    return _scored(held.withColumn("norm", F.lit(None).cast("double")), index, sides, depth, False)


def asked_sides(index: Index, asked: DataFrame) -> dict[str, _Asked]:
    """The questions' terms of each strategy with their statistics; their number has been checked."""
    stats = index.term_stats.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    sizes = asked.groupBy("question_id").count().toPandas().set_index("question_id")["count"]
    known = asked.join(stats, "term").withColumn("qw", F.col("qtf") * F.col("weight")).toPandas()
    return {s: _Asked(part.reset_index(drop=True), sizes) for s, part in known.groupby("strategy")}


def candidates(index: Index, sides: dict[str, _Asked], depth: int, bounds: bool | None = True) -> DataFrame | None:
    """KEY of chunks that may be among a question's `depth` best by bm25; None where that cannot be told, or unless `bounds` asks for it would take more than scoring all.

    A question's rarest terms lead to a few chunks, whose whole scores give the
    least score that counts. Its terms are then ordered by the most that each
    can add: those that together stay below the least score need not be looked up,
    as a chunk with no other term cannot reach it. Of the others the postings
    are added up, and a chunk goes on if its sum and all that the left-out terms
    could add reach the least score.
    """
    spark, rows = index.corpus_stats.sparkSession, pd.concat([s.rows.assign(strategy=n) for n, s in sides.items()]) if sides else pd.DataFrame()
    if not len(rows) or (rows["idf"] < 0).any():
        return None
    group = ["strategy", "question_id"]
    pairs = sum(r["n_chunks"] * len(sides[r["strategy"]].questions) for r in index.corpus_stats.collect() if r["strategy"] in sides)
    if bounds is None and rows["df"].sum() * PAIR_COST > pairs:
        return None
    rows = rows.assign(w=rows["qtf"] * rows["idf"], bound=rows["qtf"] * rows["idf"] * rows["most"])
    rare = rows.sort_values([*group, "df", "term"])
    rare = rare[rare.groupby(group)["df"].cumsum() - rare["df"] < SEED_CHUNKS * depth]
    first = Window.partitionBy(*group).orderBy(F.desc("sum"), *KEY[1:])
    seeds = _term_sums(spark, index, rare).withColumn("place", F.row_number().over(first)).where(F.col("place") <= depth).select(*KEY).distinct()
    scored = _scored(index.forward.join(seeds, KEY, "left_semi").withColumn("norm", F.lit(None).cast("double")), index, sides, depth, False)
    by_score = Window.partitionBy(*group).orderBy(F.desc("bm25"), *KEY[1:])
    least = scored.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == depth).select(*group, F.col("bm25").alias("least")).toPandas()  # a row for each question at most
    rows = rows.merge(least, on=group, how="left").fillna({"least": -1.0}).sort_values([*group, "bound", "term"])
    rows["below"] = rows.groupby(group)["bound"].cumsum()
    out = rows["below"] < rows["least"] * (1 - BOUND_SLACK)
    rest = rows[out].groupby(group)["bound"].sum().rename("rest")
    needed = rows[["strategy", "question_id", "least"]].drop_duplicates().merge(rest, on=group, how="left").fillna({"rest": 0.0})
    needed["needed"] = (needed["least"] - needed["rest"]) * (1 - BOUND_SLACK) - BOUND_SLACK
    limits = F.broadcast(spark.createDataFrame(needed[[*group, "needed"]], "strategy string, question_id string, needed double"))
    return _term_sums(spark, index, rows[~out]).join(limits, group).where(F.col("sum") >= F.col("needed")).select(*KEY).distinct()


def _term_sums(spark: SparkSession, index: Index, rows: pd.DataFrame) -> DataFrame:
    """strategy, question_id, source_file, chunk_index, sum of the weighted postings of the given terms of each question."""
    sent = spark.createDataFrame(rows[["strategy", "term", "question_id", "w"]], "strategy string, term string, question_id string, w double")
    met = index.postings.join(F.broadcast(index.corpus_stats.select("strategy", "avgdl")), "strategy").join(F.broadcast(sent), ["strategy", "term"])
    return met.groupBy(*KEY, "question_id").agg(F.sum(F.col("w") * damped(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("sum"))


def _scored(held: DataFrame, index: Index, sides: dict[str, _Asked], depth: int, vectors: bool) -> DataFrame:
    """Of held (KEY, dl, terms, norm) each task's best rows of each question."""
    held = held.join(F.broadcast(index.corpus_stats.select("strategy", "avgdl")), "strategy")

    def score(batches):
        best = {"w": _Best(depth), "v": _Best(depth)}
        for batch in batches:
            names = batch.column("strategy").to_numpy(zero_copy_only=False)
            for s in set(names):
                side = sides.get(s)
                rows = np.flatnonzero(names == s)
                step = max(1, BLOCK_SCORES // max(1, len(side.questions))) if side else 1
                for at in range(0, len(rows) if side else 0, step):
                    part = batch.take(pa.array(rows[at : at + step]))
                    bm25, cosine, coverage, shared = side.scores(part)
                    chunks = list(zip(part.column("source_file").to_pylist(), part.column("chunk_index").to_pylist(), strict=True))
                    for j, q in enumerate(side.questions):
                        values = (bm25[j], cosine[j], coverage[j])
                        best["w"].add((s, q), bm25[j], chunks, bm25[j] > 0, values)
                        if vectors:
                            best["v"].add((s, q), cosine[j], chunks, shared[j] > 0, values)
        found = sorted({(*q, *x[1:]) for b in best.values() for q, xs in b.kept.items() for x in xs})
        cols = list(zip(*found, strict=True)) or [[]] * 7
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        out = [pa.array([None if n == "cosine" and not vectors else v for v in c], k) for c, k, n in zip(cols, kinds, names_of, strict=True)]
        yield pa.RecordBatch.from_arrays(out, names=names_of)

    names_of = ["strategy", "question_id", "source_file", "chunk_index", "bm25", "cosine", "coverage"]
    return held.mapInArrow(score, "strategy string, question_id string, source_file string, chunk_index int, bm25 double, cosine double, coverage double")


class _Asked:
    """The questions' terms of one strategy, as arrays: for each term the questions that have it and its factors."""

    def __init__(self, rows: pd.DataFrame, sizes: pd.Series):
        self.rows = rows
        self.terms = pa.array(sorted(rows["term"].unique()), pa.string())
        self.questions = sorted(rows["question_id"].unique())
        term = rows["term"].map({t: k for k, t in enumerate(self.terms.to_pylist())}).to_numpy()
        order = np.argsort(term, kind="stable")
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        place = {q: k for k, q in enumerate(self.questions)}
        self.question = rows["question_id"].map(place).to_numpy()[order]
        self.idf = (rows["qtf"] * rows["idf"]).to_numpy()[order]
        self.weight = (rows["qw"] * rows["weight"]).to_numpy()[order]
        self.norm = np.sqrt(np.bincount(self.question, weights=rows["qw"].to_numpy()[order] ** 2, minlength=len(self.questions)))
        self.size = sizes.loc[self.questions].to_numpy(float)

    def scores(self, chunks: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """bm25, cosine, coverage and shared terms: a row for each question, a column for each chunk."""
        lists = chunks.column("terms")
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        term = pc.index_in(flat.field("term"), self.terms).to_numpy(zero_copy_only=False)
        tf = flat.field("tf").to_numpy(zero_copy_only=False).astype(float)
        ok = ~np.isnan(term.astype(float))
        row, term, tf = row[ok], term[ok].astype(np.int64), tf[ok]
        of = lambda c: chunks.column(c).to_numpy(zero_copy_only=False).astype(float)
        bm25, dot, shared = self.sums(term, row, tf, damped(tf, of("dl")[row], of("avgdl")[row]), len(lists))
        return bm25, dot / (self.norm[:, None] * of("norm")[None, :] + 1e-10), shared / self.size[:, None], shared

    def sums(self, term: np.ndarray, row: np.ndarray, tf: np.ndarray, part: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
        """bm25, dot and shared terms of postings (place of the term, row of the chunk, count, damped count)."""
        n = self.first[term + 1] - self.first[term]
        posting = np.repeat(np.arange(len(term)), n)
        at = np.arange(int(n.sum())) + np.repeat(self.first[term] - np.append(0, np.cumsum(n)[:-1])[: len(n)], n)
        cell, shape = self.question[at] * rows + row[posting], (len(self.questions), rows)
        total = lambda w: np.bincount(cell, weights=w, minlength=shape[0] * shape[1]).reshape(shape)
        return total(self.idf[at] * part[posting]), total(self.weight[at] * tf[posting]), total(None).astype(float)


def ranked_pairs(scored: DataFrame, depth: int = max(TOP_KS) * max(DEPTH.values())) -> DataFrame:
    """Adds bm25_rank and vector_rank (from 1, null beyond the depth); keeps rows that one of the lists has.

    Equal scores go by source_file and chunk_index. A chunk is in the keyword
    list only with a positive score. Both lists are ranked in one window, of
    which each task passes on its own best rows only, whatever a question's
    number of chunks.
    """
    entry = lambda name, by, on: F.when(on, F.struct(F.lit(name).alias("list"), quantised(F.col(by), 9).alias("by")))
    lists = F.array_compact(F.array(entry("v", "cosine", F.col("cosine").isNotNull()), entry("w", "bm25", F.col("bm25") > 0)))
    wide = scored.withColumn("l", F.explode(lists)).select("strategy", "question_id", "source_file", "chunk_index", "bm25", "cosine", "coverage", "l.list", "l.by")
    rank = F.row_number().over(Window.partitionBy("strategy", "question_id", "list").orderBy(F.desc("by"), "source_file", "chunk_index"))
    best = wide.withColumn("rank", rank).where(F.col("rank") <= depth)
    values = [F.max(c).alias(c) for c in ("bm25", "cosine", "coverage")]  # a chunk's values are the same in both lists
    in_list = lambda name: F.max(F.when(F.col("list") == name, F.col("rank")))
    return best.groupBy("strategy", "question_id", "source_file", "chunk_index").agg(*values, in_list("v").alias("vector_rank"), in_list("w").alias("bm25_rank"))


def fused(ranked: DataFrame, reach: Column) -> DataFrame:
    """Adds rrf over the lists cut at `reach`; rows in neither list go. Cutting comes before fusing."""
    in_list = lambda c: F.when(F.col(c) <= reach, F.col(c))
    part = lambda c: F.coalesce(1.0 / (RRF_CONSTANT + F.col(c)), F.lit(0.0))
    cut = ranked.withColumn("v", in_list("vector_rank")).withColumn("w", in_list("bm25_rank")).where("v is not null or w is not null")
    return cut.withColumn("rrf", part("v") + part("w"))


def retrieve(ranked: DataFrame, searches=SEARCHES, top_ks=TOP_KS) -> DataFrame:
    """config_name, strategy, search, top_k, question_id, rank, source_file, chunk_index, score: the hits of all configurations."""
    kinds = [F.struct(F.lit(s).alias("search"), F.lit(k).alias("top_k"), F.lit(DEPTH[s] * k).alias("reach")) for s in searches for k in top_ks]
    wide = ranked.withColumn("c", F.explode(F.array(*kinds))).select("*", "c.*").drop("c")
    wide = fused(wide, F.col("reach"))
    wide = wide.where(((F.col("search") != "vector") | F.col("v").isNotNull()) & ((F.col("search") != "bm25") | F.col("w").isNotNull()))
    per = Window.partitionBy("strategy", "search", "top_k", "question_id")
    # a chunk of the vector list comes before one that only the keyword list has
    fusion = per.orderBy(quantised(F.col("rrf"), 12).desc(), F.col("v").asc_nulls_last(), F.col("w").asc_nulls_last())
    wide = wide.withColumn("fused_rank", F.row_number().over(fusion)).where("search != 'hybrid_rerank' or fused_rank <= reach")
    first = F.when(F.col("search") == "vector", -F.col("v")).when(F.col("search") == "bm25", -F.col("w")).when(F.col("search") == "hybrid", -F.col("fused_rank")).otherwise(quantised(F.col("coverage"), 9))
    out = wide.withColumn("rank", F.row_number().over(per.orderBy(first.desc(), F.col("fused_rank")))).where("rank <= top_k")
    score = F.when(F.col("search") == "vector", F.col("cosine")).when(F.col("search") == "bm25", F.col("bm25")).when(F.col("search") == "hybrid", F.col("rrf")).otherwise(F.col("coverage"))
    name = F.concat_ws("__", "strategy", "search", F.concat(F.lit("k"), F.col("top_k")))
    return out.select(name.alias("config_name"), "strategy", "search", "top_k", "question_id", "rank", "source_file", "chunk_index", score.alias("score"))


def usable() -> Column:
    """Whether vec is a vector that can match: it has an id and is not null, not zero and of finite components."""
    return F.col("id").isNotNull() & F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def block_best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, id, score: for each row of a block that asks, its k best of those that don't, of equals the smaller ids."""
    ask, ids = rows["asks"].to_numpy(), rows["id"].to_numpy()
    lengths = rows["vec"].map(len).to_numpy()
    out = []
    for dims in np.unique(lengths):
        q, h = np.flatnonzero(ask & (lengths == dims)), np.flatnonzero(~ask & (lengths == dims))
        if not len(q) or not len(h):
            continue
        x, y = (np.array(rows["vec"].iloc[at].tolist(), np.float64) for at in (q, h))
        for s in range(0, len(q), 256):
            part = x[s : s + 256]
            sim = (part @ y.T) / (np.sqrt((part * part).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :] + 1e-10)
            key = np.floor(sim * 1e9 + 0.5)
            key[ids[q[s : s + 256]][:, None] == ids[h][None, :]] = -np.inf
            # all that reach the k-th best of a row; of equals the smaller ids go on
            least = np.partition(key, max(key.shape[1] - k, 0), axis=1)[:, max(key.shape[1] - k, 0)]
            r, c = np.nonzero((key >= least[:, None]) & np.isfinite(key))
            order = np.lexsort((ids[h[c]], -key[r, c], r))
            r, c = r[order], c[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            r, c = r[place < k], c[place < k]
            out.append(pd.DataFrame({"query_id": ids[q[s + r]], "id": ids[h[c]], "score": sim[r, c]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, "i8"), "id": np.empty(0, "i8"), "score": np.empty(0)})


def best_of_blocks(asked: DataFrame, held: DataFrame, key: list[str], k: int) -> DataFrame:
    """query_id, rank, id, score: the k best of the blocks that have equal keys on both sides."""
    rows = asked.withColumn("asks", F.lit(True)).unionByName(held.withColumn("asks", F.lit(False)))
    found = rows.groupBy(*key).applyInPandas(lambda x: block_best(x, k), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(quantised(F.col("score"), 9).desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, id, score: the k nearest of vectors (id, vec) for each of queries (id, vec) by cosine, exactly.

    Both sides are dealt into blocks of bounded size; each pair of blocks is one
    matrix product in one task and returns its k best of each query only. Null
    and zero vectors match nothing; a query does not match its own id.
    """
    left, right = queries.where(usable()), vectors.where(usable())
    n, m = max(1, -(-left.count() // block_rows)), max(1, -(-right.count() // block_rows))
    block = lambda of: F.pmod(F.xxhash64("id"), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    return best_of_blocks(left.select("id", "vec", block(n).alias("i"), every(m).alias("j")), right.select("id", "vec", every(n).alias("i"), block(m).alias("j")), ["i", "j"], k)
