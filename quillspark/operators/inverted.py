"""Nearest neighbours by an inverted file: each vector is in the list of its nearest centroid, and a query searches the lists nearest to it.

Centroids are fitted on a bounded sample; the lists hold every row. A search of
some lists has its recall measured against retrieve.nearest. The search by
bounds is exact: a list whose nearest possible vector is farther off than a
query's k-th so far is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillspark.operators.retrieve import BLOCK_ROWS, BROADCAST_ROWS, best_of_blocks, nearest, usable
from quillspark.sources.files import kept

#: Vectors that centroids are fitted on, at most, and their components, at most (32 MB).
SAMPLE_ROWS, SAMPLE_VALUES = 65_536, 1 << 22
#: Lists of one vector length at most, sampled vectors a list at least, and rounds of the fit.
MAX_LISTS, ROWS_A_LIST, ROUNDS = 4096, 8, 10
#: Recall that probes_for aims at, and queries that it is judged by, at most.
RECALL, RECALL_QUERIES = 0.95, 256
#: Lists that give the search by bounds its first k hits, and what rounding may add to an angle.
FIRST_PROBES, ANGLE_SLACK = 4, 1e-3
_STRIP = 4096


@dataclass(frozen=True)
class InvertedFile:
    """lists: dims, list, away (angle to the centroid), id, vec of every usable vector; centroids by vector length (a length that the sample lacks is one list); n_lists bounds the lists there are."""

    lists: DataFrame
    centroids: dict[int, np.ndarray]
    n_lists: int


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit vectors; one that loses all its vectors stays where it is."""
    c = x[np.random.default_rng(k).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[s : s + _STRIP] @ c.T, axis=1) for s in range(0, len(x), _STRIP)])
        total = np.zeros(c.shape)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(axis=1))[:, None]
        c = np.where(norm > 0, total / np.maximum(norm, 1e-30), c)
    return c


def sampled(vectors: DataFrame) -> tuple[dict[int, tuple[int, np.ndarray]], int]:
    """By vector length, the most frequent first: how many rows there are, and those of a bounded hash sample as unit vectors. And how many lengths there are."""
    counted = {r["dims"]: r["count"] for r in vectors.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1000).collect()}
    lengths = vectors.select(F.size("vec").alias("dims")).distinct().count() if len(counted) == 1000 else len(counted)
    if not counted:
        return {}, 0
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(counted)))
    share = 0.95 * rows / sum(counted.values())
    sample = vectors if share >= 1 else vectors.where(F.pmod(F.xxhash64("id", "vec", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = sample.select("id", "vec").limit(rows).toPandas().sort_values("id", kind="stable")
    sizes = got["vec"].map(len).to_numpy()
    return {int(d): (n, _unit(np.array(got["vec"][sizes == d].tolist()).reshape(-1, d))) for d, n in counted.items()}, lengths


def fit_centroids(vectors: DataFrame, n_lists: int | None = None) -> tuple[dict[int, np.ndarray], int]:
    """Centroids by vector length, and how many lengths there are. By default as many lists as the root of the rows, and at most MAX_LISTS."""
    by_length, lengths = sampled(vectors)
    sizes = {d: min(n_lists or round(n**0.5), MAX_LISTS, len(x) // ROWS_A_LIST) for d, (n, x) in by_length.items()}
    return {d: spherical_kmeans(by_length[d][1], k) for d, k in sizes.items() if k > 1}, lengths


def _place(vectors: DataFrame, choose: Callable[[int, np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """dims, list, away, id, vec: each vector in the lists that choose(length, unit vectors, their rows) names as (row, list, angle)."""
    kinds = [StructField("dims", IntegerType()), StructField("list", IntegerType()), StructField("away", DoubleType())]

    def place(batches):
        for batch in batches:
            lists = batch.column("vec")
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(starts)
            for dims in np.unique(sizes):
                of = np.flatnonzero(sizes == dims)
                for s in range(0, len(of), _STRIP):
                    rows = of[s : s + _STRIP]
                    part = batch.take(pa.array(rows))
                    at, to, away = choose(int(dims), _unit(flat[starts[rows][:, None] + np.arange(dims)]), part)
                    part = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dims, np.int32)), pa.array(to.astype(np.int32)), pa.array(away), part.column("id"), part.column("vec")], names=["dims", "list", "away", "id", "vec"])

    return vectors.mapInArrow(place, StructType(kinds + list(vectors.select("id", "vec").schema)))


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ c.T, -1, 1))


def listed(vectors: DataFrame, centroids: dict[int, np.ndarray], probes: int = 1) -> DataFrame:
    """dims, list, away, id, vec: each vector in the `probes` lists whose centroids are nearest to it."""

    def choose(dims, x, part):
        c = centroids.get(dims)
        if c is None:
            return np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x))
        angle, n = _angles(x, c), min(probes, len(c))
        to, at = np.argpartition(angle, n - 1, axis=1)[:, :n].ravel(), np.repeat(np.arange(len(x)), n)
        return at, to, angle[at, to]

    return _place(vectors.select("id", "vec"), choose)


def within_reach(queries: DataFrame, centroids: dict[int, np.ndarray], radii: dict[tuple[int, int], float]) -> DataFrame:
    """dims, list, away, id, vec: each query (id, vec, least) in the lists that may hold a vector whose cosine is `least` or more; a null or negative one is in all."""

    def choose(dims, x, part):
        c = centroids.get(dims)
        if c is None:
            return np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x))
        least = part.column("least").to_numpy(zero_copy_only=False).astype(float)
        reach = np.where(least > 0, np.arccos(np.clip(least, -1, 1)), np.inf)
        angle = _angles(x, c)
        at, to = np.nonzero(angle - np.array([radii.get((dims, k), -np.inf) for k in range(len(c))]) <= reach[:, None] + ANGLE_SLACK)
        return at, to, angle[at, to]

    return _place(queries.select("id", "vec", F.col("least").cast("double").alias("least")), choose)


def build(vectors: DataFrame, n_lists: int | None = None) -> InvertedFile:
    """The index of vectors (id, vec). Null and zero vectors, and those with null or NaN components, are in no list. Other columns are not carried."""
    known = vectors.select("id", "vec").where(usable())
    centroids, lengths = fit_centroids(known, n_lists)
    return InvertedFile(listed(known, centroids), centroids, sum(map(len, centroids.values())) + lengths)


def stored(spark: SparkSession, path: str, vectors: DataFrame, n_lists: int | None = None) -> InvertedFile:
    """The index kept at path, built where there is none. Rows are sorted by list, so a few lists are read without the others; a full list spreads over files."""
    made: list[InvertedFile] = []

    def centroid_rows() -> DataFrame:
        made.append(build(vectors, n_lists))
        rows = [(d, k, [float(v) for v in row]) for d, c in made[0].centroids.items() for k, row in enumerate(c)]
        return spark.createDataFrame([(-1, made[0].n_lists, []), *rows], "dims int, list int, centroid array<double>")

    names: dict[int, list] = {}
    for r in kept(spark, f"{path}/centroids", centroid_rows).orderBy("dims", "list").collect():  # as many rows as there are lists at most
        names.setdefault(r["dims"], []).append(r["centroid"] if r["dims"] >= 0 else r["list"])
    n = names.pop(-1)[0]
    centroids = {d: np.array(c) for d, c in names.items()}
    lists = kept(spark, f"{path}/lists", lambda: listed(vectors.select("id", "vec").where(usable()), centroids).repartitionByRange("dims", "list", "id").sortWithinPartitions("dims", "list"))
    return InvertedFile(lists, centroids, n)


def nearest_listed(index: InvertedFile, queries: DataFrame, k: int, probes: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, id, score: the k nearest of the vectors in the `probes` lists nearest to each query; all lists give the exact result.

    Lists and the queries of a list are cut into blocks of bounded size, so a
    full list is many tasks. A query does not match its own id; one whose lists
    hold fewer than k others gets fewer rows.
    """
    return _search(index, listed(queries.select("id", "vec").where(usable()), index.centroids, probes), k, block_rows)


def nearest_by_bounds(index: InvertedFile, queries: DataFrame, k: int, probes: int = FIRST_PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, id, score: what retrieve.nearest gives, from the lists alone that may hold one of a query's k nearest."""
    first = nearest_listed(index, queries, k, probes, block_rows).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    radii = {(r["dims"], r["list"]): r["radius"] for r in index.lists.groupBy("dims", "list").agg(F.max("away").alias("radius")).where("dims in (%s)" % ", ".join(map(str, [-1, *index.centroids]))).collect()}
    asked = queries.select("id", "vec").where(usable()).join(first, "id", "left")
    return _search(index, within_reach(asked, index.centroids, radii), k, block_rows)


def _search(index: InvertedFile, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
    blocks = lambda of, name: of.groupBy("dims", "list").agg(F.ceil(F.count("*") / block_rows).alias(name))
    cut = blocks(asked, "n").join(blocks(index.lists, "m"), ["dims", "list"])
    cut = F.broadcast(cut) if index.n_lists <= BROADCAST_ROWS else cut
    own = lambda of: F.pmod(F.xxhash64("id", "vec"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    left = asked.join(cut, ["dims", "list"]).select("dims", "list", "id", "vec", own("n").alias("i"), every("m").alias("j"))
    right = index.lists.join(cut, ["dims", "list"]).select("dims", "list", "id", "vec", every("n").alias("i"), own("m").alias("j"))
    return best_of_blocks(left, right, ["dims", "list", "i", "j"], k)


def probes_for(index: InvertedFile, queries: DataFrame, k: int, target: float = RECALL, sample: int = RECALL_QUERIES) -> int:
    """The fewest lists by which `target` of the exact hits are found, judged by a bounded hash sample of the queries against all vectors."""
    asked = queries.select("id", "vec").where(usable()).orderBy(F.xxhash64("id", F.lit(13)), "id").limit(sample)
    exact = nearest(index.lists.select("id", "vec"), asked, k).select("query_id", "id")
    hits = exact.join(index.lists.select("id", "dims", "list"), "id").groupBy("query_id", "id").agg(F.min("list").alias("list"), F.min("dims").alias("dims"))
    vec, places = {r["id"]: r["vec"] for r in asked.collect()}, []
    for r in hits.collect():  # k rows a sampled query
        c = index.centroids.get(r["dims"])
        if c is None:
            places.append(1)
        else:
            near = c @ _unit(np.array([vec[r["query_id"]]]))[0]
            places.append(1 + int((near > near[r["list"]]).sum()))
    return sorted(places)[max(0, ceil(target * len(places)) - 1)] if places else 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact search's hits that were found; 1 where there are none."""
    r = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return r["hits"] / r["n"] if r["n"] else 1.0
