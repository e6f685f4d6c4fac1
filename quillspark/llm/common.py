"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What separates words in every contract: space, tab, line feed, vertical tab, form feed, return.
WORD_GAPS = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
ASCII_LOWER = bytes.maketrans(_UPPER, _LOWER)
#: Bytes of text that one step of the vectorised operators holds at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """Run make()(batch) over the Arrow batches of each partition; it yields dicts of the schema's columns.

    What make() returns may have a `finish` that gives one more dict at the partition's end.
    """
    names = StructType.fromDDL(schema).names

    def run(batches):
        step = make()
        as_batch = lambda out: pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)
        for batch in batches:
            yield from map(as_batch, step(batch))
        if hasattr(step, "finish"):
            yield as_batch(step.finish())

    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of slices of about limit bytes, one text at least; null reads as empty."""
    values = batch.column(column).cast(pa.binary())
    start, size, part = 0, 0, []
    for k in range(len(values)):
        raw = values[k].as_py() or b""
        if part and size + len(raw) > limit:
            yield start, part
            start, size, part = k, 0, []
        part.append(raw)
        size += len(raw)
    if part:
        yield start, part


def group_count(rows: int, each: int, least: int = 1) -> int:
    """Groups of about `each` rows, so that a group's size does not follow the input."""
    return max(least, math.ceil(rows / max(1, each)))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in any case of letters: names that differ in case only are one to Spark."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names.

    spark.checkpoint.dir is read from the session; only where it is unset (local
    tests) is a folder of our own set, below the warehouse.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine one below the warehouse where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillspark"


def settle_table(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed Parquet table in the shared folder: smaller than a checkpoint where rows are long."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def minimum_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links u-v, and for each the smallest node of its component."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (u, v), for nodes that have links.

    Alternates the large-star and small-star steps; every step is a grouped
    minimum (summed before the shuffle) and a join that AQE can split where a
    node has very many links, and each round is checkpointed.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = settle(links.where(F.col("u") != F.col("v")).select(high.alias("u"), low.alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(small_min.select("u", F.col("m").alias("v")))
        edges = settle(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
