"""Comparisons of evaluation results (config_name, question_id, scores ...).

Results are grouped once, and what follows works on one row a configuration;
windows without a partition only ever see those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import quantised

#: Averages of a summary row, in the order of its columns.
MEASURES = ("gold_similarity", "fact_recall", "context_precision", "context_recall", "distractor_rate", "retrieval_latency_ms", "generation_latency_ms", "total_latency_ms", "context_tokens")
#: Names of the failure modes, in the order of their bars.
MODES = ("correct", "partial", "wrong_source", "insufficient")


def with_parts(results: DataFrame) -> DataFrame:
    """Adds chunking, search, top_k of config_name."""
    part = F.split("config_name", "__")
    return results.withColumn("chunking", F.get(part, F.lit(0))).withColumn("search", F.get(part, F.lit(1))).withColumn("top_k", F.substring(F.get(part, F.lit(2)), 2, 9).try_cast("int"))


def summary(results: DataFrame) -> DataFrame:
    """config_name and avg_<measure> for MEASURES, 0 where all are null."""
    return results.groupBy("config_name").agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}") for m in MEASURES])


def _rated(summaries: DataFrame, name: str = "q") -> DataFrame:
    return summaries.withColumn(name, quantised(F.col("avg_gold_similarity"), 9))


def best_and_worst(summaries: DataFrame) -> DataFrame:
    """best_config, worst_config by mean similarity; equals by name."""
    rated = _rated(summaries)
    return rated.agg(F.min_by("config_name", F.struct(-F.col("q"), F.col("config_name"))).alias("best_config"), F.max_by("config_name", F.struct(-F.col("q"), F.col("config_name"))).alias("worst_config"))


def grid(results: DataFrame, dimension: str, categories=None) -> DataFrame:
    """question_category, dimension, similarity: every cell of the grid, 0 where nothing is. categories: those shown, default all that occur."""
    rows = with_parts(results)
    cells = rows.groupBy("question_category", dimension).agg(F.avg("gold_similarity").alias("similarity"))
    names = rows.select("question_category").distinct() if categories is None else results.sparkSession.createDataFrame([(c,) for c in categories], ["question_category"])
    full = names.crossJoin(F.broadcast(rows.select(dimension).distinct()))
    return full.join(cells, ["question_category", dimension], "left").select("question_category", dimension, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def all_grids(results: DataFrame) -> DataFrame:
    """The three grids in one pass: question_category and one of chunking, search, top_k."""
    category, dims = F.col("question_category"), [F.col(c) for c in ("chunking", "search", "top_k")]
    sets = with_parts(results).groupingSets([[category, d] for d in dims], category, *dims)
    return sets.agg(F.avg("gold_similarity").alias("similarity")).select("question_category", "chunking", "search", "top_k", "similarity")


def failure_mode() -> Column:
    """The first that fits; what has low similarity in spite of good sources is again taken for a wrong source."""
    return (
        F.when((F.col("gold_similarity") >= 0.8) & (F.col("fact_recall") >= 0.8), "correct").when(F.col("context_precision") < 0.3, "wrong_source").when(F.col("context_recall") < 0.5, "insufficient").when(F.col("gold_similarity") >= 0.5, "partial").otherwise("wrong_source")
    )


def failure_modes(results: DataFrame) -> DataFrame:
    """config_name and a count for each of MODES."""
    return results.withColumn("mode", failure_mode()).groupBy("config_name").agg(*[F.count_if(F.col("mode") == m).alias(m) for m in MODES])


def failure_shares(results: DataFrame) -> DataFrame:
    """config_name, mode, pct, bar_start: percentages and where each part of a stacked bar begins."""
    counts = failure_modes(results)
    total = sum((F.col(m) for m in MODES[1:]), F.col(MODES[0]))
    parts = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(m).alias("mode"), F.when(total > 0, 100.0 * F.col(m) / total).otherwise(0.0).alias("pct")) for i, m in enumerate(MODES)])
    long = counts.select("config_name", F.inline(parts))
    before = Window.partitionBy("config_name").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    return long.withColumn("bar_start", F.coalesce(F.sum("pct").over(before), F.lit(0.0))).drop("o")


def top_and_bottom(summaries: DataFrame, top: int = 10, bottom: int = 5) -> DataFrame:
    """place, end, config_name: the best `top` and the worst `bottom`; with few configurations some are in both."""
    rated = _rated(summaries)
    pick = lambda order, n, end: rated.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", F.lit(end).alias("end"), "config_name")
    return pick([F.col("q").desc(), F.col("config_name").asc()], top, "top").unionAll(pick([F.col("q").asc(), F.col("config_name").desc()], bottom, "bottom"))


def pareto_frontier(summaries: DataFrame, cost: str = "avg_total_latency_ms") -> DataFrame:
    """Configurations that are better than all that cost less."""
    rated = _rated(summaries).withColumn("c", quantised(F.col(cost), 6))
    earlier = Window.orderBy("c", "config_name").rowsBetween(Window.unboundedPreceding, -1)
    return rated.withColumn("before", F.max("q").over(earlier)).where("before is null or q > before").select("config_name", F.col("c").alias("cost"), F.col("q").alias("quality"))


def plateau(summaries: DataFrame, share: float = 0.95, least: int = 5) -> DataFrame:
    """plateau_tokens: the fewest mean context tokens that reach a share of the best quality; no row for `least` configurations or fewer."""
    everything = Window.partitionBy()
    rated = _rated(summaries).withColumn("top", F.max("q").over(everything)).withColumn("n", F.count("*").over(everything))
    reached = rated.where((F.col("n") > least) & (F.col("q") >= share * F.col("top")))
    return reached.orderBy("avg_context_tokens", "q", "config_name").limit(1).select(F.col("avg_context_tokens").cast("int").alias("plateau_tokens"))


def trend(summaries: DataFrame, x: str = "avg_context_tokens", y: str = "avg_gold_similarity") -> DataFrame:
    """c0, c1, c2 of y = c0 + c1 t + c2 t^2 with t = (x - centre) / scale, by least squares; no row below three points or when x has fewer than three values."""
    base = summaries.agg(F.avg(x).alias("centre"), F.greatest(F.stddev_pop(x), F.lit(1e-9)).alias("scale"))
    t = summaries.select(F.col(x).alias("x"), F.col(y).alias("y")).crossJoin(F.broadcast(base)).withColumn("t", (F.col("x") - F.col("centre")) / F.col("scale"))
    sums = t.agg(F.first("centre").alias("centre"), F.first("scale").alias("scale"), F.count_distinct("x").alias("n_x"), F.count("*").cast("double").alias("s0"), *[F.sum(F.pow("t", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(F.col("y") * F.pow("t", F.lit(k))).alias(f"y{k}") for k in (0, 1, 2)])
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    s0, s1, s2, s3, s4, y0, y1, y2 = map(F.col, ("s0", "s1", "s2", "s3", "s4", "y0", "y1", "y2"))
    whole = det(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    cs = (det(y0, s1, s2, y1, s2, s3, y2, s3, s4), det(s0, y0, s2, s1, y1, s3, s2, y2, s4), det(s0, s1, y0, s1, s2, y1, s2, s3, y2))
    return sums.where("n_x > 2").select("centre", "scale", *[(c / whole).alias(f"c{k}") for k, c in enumerate(cs)])


def trend_line(fit: DataFrame, low: float, high: float, points: int = 100) -> DataFrame:
    x = F.lit(low) + F.col("i") * (high - low) / max(points - 1, 1)
    t = (F.col("x") - F.col("centre")) / F.col("scale")
    return fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x).select("x", (F.col("c0") + F.col("c1") * t + F.col("c2") * t * t).alias("y"))


def strategy_rank(results: DataFrame) -> DataFrame:
    """search, similarity, rank by mean over all results."""
    means = with_parts(results).groupBy("search").agg(F.avg("gold_similarity").alias("similarity"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(quantised(F.col("similarity"), 9).desc(), "search")))


def rerank_gain(results: DataFrame) -> DataFrame:
    """gain_pct of rescoring over plain fusion, latency_ms that it adds to retrieval; 0 where one of them is missing."""
    of = lambda s, c: F.avg(F.when(F.col("search") == s, F.col(c)))
    x = with_parts(results).agg(*[of(s, c).alias(f"{n}_{m}") for s, n in (("hybrid", "h"), ("hybrid_rerank", "r")) for c, m in (("gold_similarity", "q"), ("retrieval_latency_ms", "t"))])
    return x.select(F.when(F.coalesce("h_q", F.lit(0.0)) > 0, 100.0 * (F.coalesce("r_q", F.lit(0.0)) - F.col("h_q")) / F.col("h_q")).otherwise(0.0).alias("gain_pct"), F.coalesce(F.col("r_t") - F.col("h_t"), F.lit(0.0)).alias("latency_ms"))


def overall(results: DataFrame) -> DataFrame:
    """n_results, mean_similarity, mean_fact_recall; 0 for no rows."""
    return results.agg(F.count("*").alias("n_results"), F.coalesce(F.avg("gold_similarity"), F.lit(0.0)).alias("mean_similarity"), F.coalesce(F.avg("fact_recall"), F.lit(0.0)).alias("mean_fact_recall"))
