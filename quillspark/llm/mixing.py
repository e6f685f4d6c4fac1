"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone.

Every source is a queue of its documents in shuffled order (by a hash of the
document's key), as many passes long as a document may repeat. A document's
virtual finish time is what its source has sent when the document is through,
divided by the source's target. One range sort by these times is the mix, and it is
truncated where the budget is used up. Since targets add up to the budget, each
source has then sent its target to within about one document.

Targets are found by filling up: the budget is shared by weight, and what is over
a source's limit is shared again among the others, until no source is over it.

Nothing depends on how many rows a source has: queues are cut by hash into
buckets of about BUCKET_ROWS, so running sums are taken within a bucket and over
the buckets' sums; sources are ranked by a range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import group_count, settle_table, table

#: Weights of the sources in the order of their names, repeating; the mix's size as a share of all words; how often a document may be in it.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rows of a queue's bucket, rows of a part of the range sort, and parts at most.
BUCKET_ROWS, PART_ROWS, MOST_PARTS = 2048, 4096, 4096
#: Sources whose targets are sent to all tasks: so many rows and bytes of names at most; more are joined.
SENT_ROWS, SENT_BYTES = 100_000, 4 << 20
#: In monotonically_increasing_id the bits of a row's number within its partition.
_ROW_BITS = 33


def word_count(text: Column) -> Column:
    """Words between space, tab, line feed, vertical tab, form feed and return; null has none."""
    return F.size(F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5), " "), "")).cast("long")


def ranked_sources(sized: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """source, source_size, docs, rank (from 0, by code point, null last), weight; a range sort numbers them, so no task sees all sources."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    placed = settle_table(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", _ROW_BITS)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("before", before)  # a row for each partition of the sort
    ranked = placed.withColumn("part", part).join(F.broadcast(parts.drop("n")), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    return ranked.select("source", "source_size", "docs", "rank", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int")).alias("weight"))


def water_level(sources: DataFrame, total: float, most: float) -> float:
    """What a unit of weight gets: sources over `most` times their size stop there, and the rest is shared by the others, until none is over."""
    level, stopped = None, 0
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > most * F.col("source_size")
        x = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most * F.col("source_size"))).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if level is not None and (x["n"] == stopped or not x["weight"]):
            return level
        level, stopped = (total - (x["used"] or 0.0)) / x["weight"], x["n"]


def queued(sized: DataFrame, targets: DataFrame, sent: bool) -> DataFrame:
    """sized with rank, source_size, target and `served`: what the source has sent in a pass when the row is through."""
    t = (F.broadcast(targets) if sent else targets).withColumnRenamed("source", "its_source")
    met = sized.join(t, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    prefix = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    met = met.withColumn("bucket", F.shiftright(prefix * F.ceil(F.col("docs") / BUCKET_ROWS), 32))
    behind = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = met.groupBy("rank", "bucket").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(behind), F.lit(0))).drop("n")
    within = Window.partitionBy("rank", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    return met.join(before, ["rank", "bucket"]).withColumn("served", F.col("before") + F.sum("size").over(within)).drop("before", "bucket", "docs", "place")


def finish(turn: Column | int) -> Column:
    """A row's virtual finish time in a pass (from 0); null where there is nothing to send."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    return F.when(F.col("size") > 0, (turn * F.col("source_size") + F.col("served")) / F.col("target"))


def truncation(queue: DataFrame, rows: int, budget: float, most: int) -> tuple[float, int] | None:
    """(finish time, source's rank) of the first document that the budget does not hold, or None if it holds all.

    The range sort is written as a table: sums by part show in which part the
    budget ends, and only that part's rows are added up one by one.
    """
    passes = queue.where("size > 0").select("rank", "size", "served", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn"))
    times = passes.select(finish(F.col("turn")).alias("finish"), "rank", "size")
    parts = min(MOST_PARTS, group_count(rows * most, PART_ROWS))
    ranged = times.repartitionByRange(parts, "finish", "rank").sortWithinPartitions("finish", "rank")
    placed = settle_table(ranged.withColumn("at", F.monotonically_increasing_id()))
    part, before = F.shiftright("at", _ROW_BITS), 0
    for p, n in sorted(map(tuple, placed.groupBy(part.alias("part")).agg(F.sum("size")).collect())):  # MOST_PARTS rows at most
        if before + n > budget:
            running = F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
            first = placed.where(part == p).withColumn("running", running).where(F.col("running") + before > budget).orderBy("at").first()
            return first["finish"], first["rank"]
        before += n
    return None


def mix(rows: DataFrame, size: Column, source: Column, key: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """row (all columns of rows, so that no name clashes), size, source, source_size, rank, target, served, copies, taken of every row.

    `size` is what a document counts (null: 0), `source` its source, null being one of its own, `key`
    what the shuffle hashes: equal keys and sizes of a source are interchangeable. Documents are taken whole, at most `most` times;
    what does not fit the budget's rest ends the mix. Documents without size are
    never taken. Rows that repeat count each. Results are the same in every run.
    An empty table gives an empty one.
    """
    place = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    sized = settle_table(rows.select(F.struct("*").alias("row"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), source.cast("string").alias("source"), place.alias("place")))
    sources = settle_table(ranked_sources(sized.select("source", "size"), weights))
    known = sources.agg(F.sum("source_size").alias("size"), F.sum("docs").alias("docs"), F.count("*").alias("n"), F.sum(F.octet_length("source")).alias("bytes")).first()
    total = share * (known["size"] or 0)
    level = water_level(sources, total, most) if total else 0.0
    targets = sources.select("source", "source_size", "docs", "rank", F.least(F.col("weight") * level, most * F.col("source_size").cast("double")).alias("target"))
    queue = queued(sized, targets, known["n"] <= SENT_ROWS and (known["bytes"] or 0) <= SENT_BYTES)
    end = truncation(queue, known["docs"], total, most) if total else None
    taken = F.lit(0)
    for turn in range(most):
        fits = F.lit(True) if end is None else (finish(turn) < end[0]) | ((finish(turn) == end[0]) & (F.col("rank") < end[1]))
        taken = taken + F.when((F.col("size") > 0) & fits, 1).otherwise(0)
    return queue.withColumn("copies", taken).withColumn("taken", F.col("copies") * F.col("size"))


def in_order(mixed: DataFrame) -> DataFrame:
    """row, turn, finish: the mix itself, each document as often as it was taken, range-sorted by virtual finish time."""
    sent = mixed.where("copies > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return sent.select("row", "rank", "turn", finish(F.col("turn")).alias("finish")).orderBy("finish", "rank").drop("rank")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    found = mix(docs, F.col("size"), F.col("source"), F.col("doc_id"))
    return found.select("row.doc_id", "size", "source_size", "target", "taken")
