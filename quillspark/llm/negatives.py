"""Hard-negative mining with Four-Russians scoring.

Vectors are integers and kept as an index of packed bit planes: for each plane
and each group of eight dimensions one byte. For an anchor all 256 subset sums
of each group are tabulated once; a candidate's byte picks its subset's sum, the
sums of a plane are added over the groups, and the planes are shifted and
added from the sign down, which gives the full inner product, exactly.

Anchors are a stated set. They are dealt into blocks of a bounded size; the
block is sent to all tasks, which score the part of the index that they read and
pass on their own best of each anchor only. A first scan finds the positives, a
second one the negatives that are allowed by the positives' scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import group_count, map_batches, settle_table, shared_folder, table
from quillspark.llm.whitening import as_integers, finite

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's: the least and the most.
LEAST, MOST = 30, 90
#: Bytes of an anchor block's tables, and anchors of a block, at most on average; scores that a task holds at once.
TABLE_BYTES, BLOCK_ANCHORS, SLICE_SCORES = 32 << 20, 2048, 1 << 20
#: What stands for a score that 64 bits don't hold; and the rows of a slice for which a sort key has to fit, or a stable sort is taken.
LIMIT, KEYED_ROWS = 2**63 - 2, 256
#: All 256 subsets of eight dimensions; the first is the lowest bit.
SUBSETS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def bit_planes(x: np.ndarray, planes: int) -> np.ndarray:
    """rows x planes x groups of bytes: the two's complement of integers, plane 0 the lowest bits."""
    groups = -(-x.shape[1] // 8)
    x = np.pad(x, ((0, 0), (0, groups * 8 - x.shape[1])))
    return np.stack([np.packbits(((x >> k) & 1).astype(np.uint8), axis=1, bitorder="little") for k in range(planes)], axis=1)


def from_planes(packed: np.ndarray, dims: int) -> np.ndarray:
    """The integers of bit_planes."""
    planes = packed.shape[1]
    bits = np.unpackbits(packed, axis=2, bitorder="little")[:, :, :dims].astype(np.int64)
    weight = np.array([1 << k for k in range(planes - 1)] + [-(1 << (planes - 1))], np.int64)
    return np.einsum("npd,p->nd", bits, weight)


def subset_sums(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """groups x 256 x anchors: for each group of eight dimensions the sums of all subsets of an anchor's entries."""
    groups = -(-anchors.shape[1] // 8)
    a = np.pad(anchors, ((0, 0), (0, groups * 8 - anchors.shape[1]))).reshape(len(anchors), groups, 8)
    return np.ascontiguousarray(np.einsum("sb,agb->gsa", SUBSETS, a), dtype=kind)


def shift_add(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """rows x anchors: inner products by look-ups, plane by plane from the sign down."""
    planes, groups = packed.shape[1:]
    total = np.zeros((len(packed), tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for k in reversed(range(planes)):
        total <<= 1
        for g in range(groups):
            np.take(tables[g], packed[:, k, g], axis=0, out=found)
            if k == planes - 1:
                total -= found
            else:
                total += found
    return total


class Best:
    """The k best (score, smaller id) of each group among what is added."""

    def __init__(self, groups: int, k: int):
        self.k, self.limit, self.held, self.pending = k, 4 * groups * k + 65_536, [], 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((group, score, ids))
        self.pending += len(group)
        if self.pending > self.limit:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, ids = (np.concatenate([x[c] for x in self.held]) if self.held else np.empty(0, np.int64) for c in range(3))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        kept = np.arange(len(group)) - np.searchsorted(group, group) < self.k
        self.held, self.pending = [(group[kept], score[kept], ids[kept])], int(kept.sum())
        return self.held[0]


def best_places(score: np.ndarray, allowed: np.ndarray, k: int, keyed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed scores of each row; of equals the first columns. Without `keyed` a score and a place need not fit 64 bits together."""
    n = score.shape[1]
    if not keyed:
        order = np.argsort(np.where(allowed, -score, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
        kept = np.take_along_axis(allowed, order, axis=1)
        return np.nonzero(kept)[0], order[kept]
    key = np.where(allowed, score * n + np.arange(n - 1, -1, -1), np.iinfo(np.int64).min)
    least = np.partition(key, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(key), 1), np.iinfo(np.int64).min)
    return np.nonzero(allowed & (key >= least))


def plane_index(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int, int]:
    """(vec_id, label, dims, packed) of the distinct usable rows, written as a table; the number of planes; the largest magnitude.

    Rows without vec_id or label, and vectors that are null or hold null or
    non-finite entries, have no place in it.
    """
    usable = vectors.where(finite() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    x = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), as_integers("embedding", scale).alias("x")).distinct()
    x = settle_table(x)
    low, high = x.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    most = max(-(low or 0), high or 0)
    planes = max(int(high or 0).bit_length(), int(-(low or 0) - 1).bit_length() if (low or 0) < 0 else 0) + 1

    def make():
        def step(batch: pa.RecordBatch):
            lists = batch.column("x")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                packed = bit_planes(flat[starts[rows][:, None] + np.arange(dims)], planes)
                yield {"vec_id": batch.column("vec_id").take(pa.array(rows)), "label": batch.column("label").take(pa.array(rows)), "dims": pa.array(np.full(len(rows), dims), pa.int32()), "packed": pa.array([p.tobytes() for p in packed], pa.binary())}

        return step

    return settle_table(map_batches(x, "vec_id long, label long, dims int, packed binary", make)), planes, most


class AnchorBlock:
    """Anchors of one length, by label, with what a scan of the index finds for them."""

    def __init__(self, rows: pd.DataFrame, planes: int, dims: int, most: int):
        rows = rows.sort_values(["label", "vec_id", "packed"], ignore_index=True)
        self.ids, self.labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.planes, self.dims, self.groups = planes, dims, -(-dims // 8)
        packed = np.frombuffer(b"".join(rows["packed"]), np.uint8).reshape(len(rows), planes, self.groups)
        self.x = from_planes(packed, dims)
        bound = dims * max(most, 1) ** 2
        self.kind = np.int32 if 2 * bound < 2**31 else np.int64
        # places within a slice are the lower part of a sort key, if that fits
        self.slice, keyed_rows = max(256, SLICE_SCORES // len(rows)), 2**62 // max(1, bound)
        self.fits, self.keyed = keyed_rows > 0, keyed_rows >= min(self.slice, KEYED_ROWS)
        if self.keyed:
            self.slice = min(self.slice, keyed_rows)

    def parts(self, packed: np.ndarray, tables: Callable[[type], np.ndarray]) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
        """Rows of a slice with tables in which their scores are exact: Python's integers for those that might not fit 64 bits."""
        if self.fits:
            yield slice(None), tables(self.kind)
            return
        most = np.abs(self.x).astype(float) @ np.abs(from_planes(packed, self.dims)).astype(float).T
        small = most.max(axis=0) < 2.0**62
        if small.any():
            yield np.flatnonzero(small), tables(np.int64)
        large = np.flatnonzero(~small)
        for at in range(0, len(large), KEYED_ROWS):
            yield large[at : at + KEYED_ROWS], tables(object)

    def scan(self, index: DataFrame, groups: int, k: int, choose: Callable) -> DataFrame:
        """group, score, id: each task's k best of each group; choose(block, tables, packed, labels, ids) yields (group, score, id) arrays of a slice."""
        own = self

        def make():
            best, made = Best(groups, k), {}

            def tables(kind):
                if kind not in made:
                    made[kind] = subset_sums(own.x, kind)
                return made[kind]

            def step(batch: pa.RecordBatch):
                ids = batch.column("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                labels, raw = batch.column("label").to_numpy()[order], batch.column("packed").take(pa.array(order)).to_pylist()
                packed = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), own.planes, own.groups)
                ids = ids[order]
                for at in range(0, len(ids), own.slice):
                    cut = slice(at, at + own.slice)
                    for rows, sums in own.parts(packed[cut], tables):
                        for found in choose(own, sums, packed[cut][rows], labels[cut][rows], ids[cut][rows]):
                            best.add(*found)
                return iter(())

            step.finish = lambda: dict(zip(("group", "score", "id"), (pa.array(x, pa.int64()) for x in best.settle()), strict=True))
            return step

        return map_batches(index.where(F.col("dims") == own.dims), "group long, score long, id long", make)


def _scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """anchors x rows in 64 bits; what doesn't fit is LIMIT or -LIMIT."""
    score = shift_add(tables, packed).T
    return np.ascontiguousarray(np.clip(score, -LIMIT, LIMIT) if score.dtype == object else score, np.int64)


def _same_label(k: int) -> Callable:
    def choose(block, tables, packed, labels, ids):
        for label in np.intersect1d(labels, block.labels):
            a, c = np.flatnonzero(block.labels == label), np.flatnonzero(labels == label)
            score = _scores(np.ascontiguousarray(tables[:, :, a[0] : a[-1] + 1]), packed[c])
            i, j = best_places(score, block.ids[a][:, None] != ids[c][None, :], k, block.keyed)
            yield a[i], score[i, j], ids[c[j]]

    return choose


def _other_label(positive: np.ndarray, known: np.ndarray, k: int, least: int, most: int) -> Callable:
    """Groups are anchor * positives + place of the positive; positive and known are anchors x positives."""
    # the least and the most score that count, as whole numbers
    goal = positive.astype(object)
    low, high = -(-least * goal // 100), most * goal // 100
    if np.abs([low, high]).max() >= LIMIT:
        raise OverflowError("a negative's score may not fit 64 bits")
    low, high = low.astype(np.int64), high.astype(np.int64)

    def choose(block, tables, packed, labels, ids):
        score = _scores(tables, packed)
        other = (block.labels[:, None] != labels[None, :]) & (block.ids[:, None] != ids[None, :])
        for p in range(positive.shape[1]):
            i, j = best_places(score, other & known[:, p, None] & (low[:, p, None] <= score) & (score <= high[:, p, None]), k, block.keyed)
            yield i * positive.shape[1] + p, score[i, j], ids[j]

    return choose


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of `vectors` (vec_id, label, embedding) for which `anchor`, a condition on vec_id and label, holds.

    Positives are an anchor's best rows of its label, negatives the best of other labels whose score is
    within `least` and `most` hundredths of the positive's; of equal scores the
    smaller ids come first. Rows without id or label and vectors with null or
    non-finite entries take no part. Only vectors of equal length are scored.
    Rows that repeat in full are one; rows that repeat an id with another vector
    or label take part each, and none pairs with its own id. An empty table, or
    one without anchors, gives an empty result. Scores beyond 64 bits are told
    apart, and raise only where one is among an anchor's positives. Other columns are not carried.
    """
    spark = vectors.sparkSession
    index, planes, largest = plane_index(vectors, scale)
    asked = index.where(anchor)
    path, wrote = f"{shared_folder(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}", False
    for dims, count in sorted(map(tuple, asked.groupBy("dims").count().collect())):  # a row for each length
        block_rows = int(np.clip(TABLE_BYTES // (-(-dims // 8) * 256 * 8), 1, BLOCK_ANCHORS))
        blocks = group_count(count, block_rows)
        for b in range(blocks):
            part = asked.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("vec_id", "label", "packed"), F.lit(blocks)) == b)).toPandas()  # about block_rows
            if not len(part):
                continue
            block = AnchorBlock(part, planes, dims, largest)
            near = _best(block.scan(index, len(part), positives, _same_label(positives)), positives).toPandas()  # positives of one block
            if not len(near):
                continue
            if near["score"].abs().max() >= LIMIT:
                raise OverflowError("inner products do not fit 64 bits")
            goal, known = np.zeros((len(part), positives), np.int64), np.zeros((len(part), positives), bool)
            at = near["group"].to_numpy(), near["rank"].to_numpy() - 1
            goal[at], known[at] = near["score"].to_numpy(), True
            found = _best(block.scan(index, len(part) * positives, negatives, _other_label(goal, known, negatives, least, most)), negatives)
            names = pd.DataFrame({"group": at[0] * positives + at[1], "anchor_id": block.ids[at[0]], "positive_id": near["id"].to_numpy(), "positive_score": near["score"].to_numpy()})
            named = found.join(F.broadcast(spark.createDataFrame(names, "group long, anchor_id long, positive_id long, positive_score long")), "group")
            named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
            wrote = True
    return spark.read.schema(RESULT).parquet(path) if wrote else spark.createDataFrame([], RESULT)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
