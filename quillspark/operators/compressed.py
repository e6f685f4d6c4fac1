"""Nearest neighbours by product codes: two bytes for every two components stand for a vector, and only few vectors are scored in full.

A unit vector is cut into parts; each part goes by the nearest of 256 code words,
and what the word leaves of it by the nearest of 256 more. Words are fitted on a
bounded sample. How far they are from the vector is kept beside the code, so a code gives a lower and an upper bound of every score.
The exact search scores those vectors alone whose upper bound reaches the k-th
best lower bound of the query. The search by a shortlist scores as many as it is
told to; inverted.recall measures it.

Code words are put together and multiplied block by block, which gives the sums
that distance tables would, by one matrix product.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType, IntegerType, StructField, StructType

from quillspark.functions.text import quantised
from quillspark.operators.inverted import _unit, sampled
from quillspark.operators.retrieve import BLOCK_ROWS, nearest, usable
from quillspark.session import shared_folder
from quillspark.sources.files import kept

#: Components a code word stands for, words that are added up, words a place, rounds of the fit, and sampled vectors that it sees at most.
PART, LEVELS, WORDS, ROUNDS, BOOK_ROWS = 2, 2, 256, 8, 16_384
#: Components of all lengths that get code words, at most (64 MB of words); vectors of the rarer lengths are searched without codes.
BOOK_DIMS = 16_384
#: Candidates of a query in a block, and in all, above which the query goes to the search by blocks.
MOST_IN_BLOCK, MOST = 512, 4096
#: What rounding and the nine digits of the order may add to a bound.
SLACK = 1e-6
_STRIP = 256


@dataclass(frozen=True)
class CodedVectors:
    """codes: id, dims, code, error, norm of every usable vector; the vectors (id, vec) that they stand for; books: code words (LEVELS, places, words, PART) by vector length."""

    codes: DataFrame
    vectors: DataFrame
    books: dict[int, np.ndarray]


def _parts(x: np.ndarray) -> np.ndarray:
    """Unit vectors as (rows, places, PART), the last place filled up with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PART))).reshape(len(x), -1, PART)


def _nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    # the nearest word has the greatest x.w - w.w / 2; a strip's products stay in the processor's cache
    half, near = (words * words).sum(axis=1) / 2, np.empty(len(x), np.intp)
    for s in range(0, len(x), 512):
        product = x[s : s + 512] @ words.T
        product -= half
        near[s : s + 512] = product.argmax(axis=1)
    return near


def code_words(x: np.ndarray, n: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """n code words of rows of PART components by k-means; a word that loses all its rows stays where it is."""
    words = x[np.random.default_rng(n).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = _nearest_words(x, words)
        held = np.bincount(near, minlength=n)
        total = np.stack([np.bincount(near, x[:, c], n) for c in range(x.shape[1])], axis=1)
        words = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], words)
    return words


def fit_books(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Code words by vector length, of the most frequent lengths within BOOK_DIMS, from a bounded sample."""
    books, room = {}, BOOK_DIMS
    for dims, (_, x) in sampled(vectors)[0].items():
        room -= dims
        if len(x) and room >= 0:
            parts = _parts(x[:BOOK_ROWS])
            books[dims] = book_of(parts)
    return books


def book_of(parts: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Code words of all places; those of a level are fitted on what the levels before leave."""
    book = np.empty((LEVELS, parts.shape[1], min(n, len(parts)), PART))
    for p in range(parts.shape[1]):
        left = parts[:, p]
        for level in book:
            level[p] = code_words(left, level.shape[1])
            left = left - level[p][_nearest_words(left, level[p])]
    return book


def encode(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The codes (rows, LEVELS * places) of unit vectors."""
    left, codes = _parts(x), np.empty((len(book), book.shape[1], len(x)), np.uint8)
    for level, at in zip(book, codes, strict=True):
        for p, words in enumerate(level):
            at[p] = _nearest_words(left[:, p], words)
            left[:, p] -= words[at[p]]
    return np.ascontiguousarray(codes.reshape(-1, len(x)).T)


def decode(codes: np.ndarray, book: np.ndarray, dims: int) -> np.ndarray:
    places = np.arange(book.shape[1])
    return sum(level[places, at].reshape(len(codes), -1)[:, :dims] for level, at in zip(book, np.split(codes, len(book), axis=1), strict=True))


def coded(vectors: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """id, dims, code, error (distance of the unit vector from its code words, rounded up), norm. A length without a book has an empty code and an error of one."""
    schema = StructType([vectors.schema["id"], StructField("dims", IntegerType()), StructField("code", BinaryType()), StructField("error", FloatType()), StructField("norm", DoubleType())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(starts)
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                raw = flat[starts[rows][:, None] + np.arange(dims)].astype(np.float64)
                x, book = _unit(raw), books.get(int(dims))
                codes = np.empty((len(x), 0), np.uint8) if book is None else encode(x, book)
                off = np.ones(len(x)) if book is None else np.sqrt(((x - decode(codes, book, dims)) ** 2).sum(axis=1))
                ends = np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]
                code = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])
                error = np.nextafter(off.astype(np.float32), np.float32(np.inf))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(np.full(len(x), dims, np.int32)), code, pa.array(error), pa.array(np.sqrt((raw * raw).sum(axis=1)))], names=schema.names)

    return vectors.select("id", "vec").mapInArrow(rows_of, schema)


def build(vectors: DataFrame) -> CodedVectors:
    """Codes of vectors (id, vec). Vectors that can't match (null, zero, or with null or non-finite components) have none. Other columns are not carried."""
    known = vectors.select("id", "vec").where(usable())
    books = fit_books(known)
    return CodedVectors(coded(known, books), known, books)


def stored(spark: SparkSession, path: str, vectors: DataFrame) -> CodedVectors:
    """Books and codes kept at path, made where there are none. The vectors themselves are not copied."""
    known = vectors.select("id", "vec").where(usable())

    def book_rows() -> DataFrame:
        rows = [(d, p, [float(v) for v in words.ravel()]) for d, book in fit_books(known).items() for p, words in enumerate(book.reshape(-1, *book.shape[2:]))]
        return spark.createDataFrame(rows, "dims int, place int, words array<double>")

    by_length: dict[int, list[np.ndarray]] = {}
    for r in kept(spark, f"{path}/books", book_rows).orderBy("dims", "place").collect():  # LEVELS * BOOK_DIMS / PART rows at most
        by_length.setdefault(r["dims"], []).append(np.array(r["words"]).reshape(-1, PART))
    books = {d: np.stack(b).reshape(LEVELS, -1, *b[0].shape) for d, b in by_length.items()}
    return CodedVectors(kept(spark, f"{path}/codes", lambda: coded(known, books)), known, books)


def _bounds(asks: pd.DataFrame, held: pd.DataFrame, books: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places of some queries, places of the rows of their length, and least and greatest scores (-inf for a query's own id)."""
    lengths, ids, asked = asks["vec"].map(len).to_numpy(), held["id"].to_numpy(), asks["id"].to_numpy()
    for dims in np.unique(lengths):
        q, h = np.flatnonzero(lengths == dims), np.flatnonzero(held["dims"].to_numpy() == dims)
        if not len(q) or not len(h):
            continue
        x, book = np.array(asks["vec"].iloc[q].tolist(), np.float64), books.get(int(dims))
        size = np.sqrt((x * x).sum(axis=1))
        y = np.zeros((len(h), dims)) if book is None else decode(np.frombuffer(b"".join(held["code"].iloc[h]), np.uint8).reshape(len(h), -1), book, dims)
        off, norm = held["error"].to_numpy(np.float64)[h], held["norm"].to_numpy()[h]
        for s in range(0, len(q), _STRIP):
            at = q[s : s + _STRIP]
            product = size[s : s + _STRIP, None] * norm[None, :]
            share = product / (product + 1e-10)  # the score's guarded denominator
            about = (x[s : s + _STRIP] / size[s : s + _STRIP, None]) @ y.T
            low, high = share * (about - off), share * (about + off)
            own = asked[at][:, None] == ids[h][None, :]
            low[own] = high[own] = -np.inf
            yield at, h, low, high


def _pairs(asks: pd.DataFrame, held: pd.DataFrame, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """query_id, id, value of (places of queries, places of rows or -1, values)."""
    r, c, v = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(3))
    r, c = r.astype(int), c.astype(int)
    ids = pd.array(np.append(held["id"].to_numpy("i8"), 0)[c], "Int64")
    ids[c < 0] = pd.NA
    return pd.DataFrame({"query_id": asks["id"].to_numpy("i8")[r], "id": ids, "value": v})


def _block_best(asks: pd.DataFrame, held: pd.DataFrame, books: dict[int, np.ndarray], k: int, middle: bool) -> pd.DataFrame:
    """Each query's k rows of the greatest least score, or of the greatest score by the code; of equals the smaller ids."""
    parts, ids = [], held["id"].to_numpy()
    for at, h, low, high in _bounds(asks, held, books):
        key = (low + high) / 2 if middle else low
        k_th = np.partition(key, max(key.shape[1] - k, 0), axis=1)[:, max(key.shape[1] - k, 0)]
        r, c = np.nonzero((key >= k_th[:, None]) & np.isfinite(key))
        order = np.lexsort((ids[h[c]], -key[r, c], r))
        r, c = r[order], c[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        parts.append((at[r[first]], h[c[first]], key[r[first], c[first]]))
    return _pairs(asks, held, parts)


def _block_reached(asks: pd.DataFrame, held: pd.DataFrame, books: dict[int, np.ndarray], most: int) -> pd.DataFrame:
    """The rows whose greatest score reaches `least`; a query that more than `most` rows reach gets one row without id."""
    parts = []
    for at, h, low, high in _bounds(asks, held, books):
        least = np.nan_to_num(asks["least"].to_numpy(np.float64)[at], nan=-np.inf)
        reached = (high >= least[:, None] - SLACK) & np.isfinite(high)
        full = reached.sum(axis=1) > most
        reached[full] = False
        r, c = np.nonzero(reached)
        over = np.flatnonzero(full)
        parts += [(at[r], h[c], high[r, c]), (at[over], np.full(len(over), -1), np.zeros(len(over)))]
    return _pairs(asks, held, parts)


def _blocks(index: CodedVectors, asked: DataFrame, block_rows: int) -> tuple[int, int]:
    """How many blocks queries and codes are dealt into."""
    return max(1, -(-asked.count() // block_rows)), max(1, -(-index.codes.count() // block_rows))


def _scan(index: CodedVectors, asked: DataFrame, n: int, m: int, best) -> DataFrame:
    """query_id, id, value: best(queries, codes) of each of n blocks of queries with each of m blocks of codes."""
    block = lambda of: F.pmod(F.xxhash64("id"), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    left = asked.withColumn("i", block(n)).withColumn("j", every(m))
    right = index.codes.withColumn("i", every(n)).withColumn("j", block(m))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda a, b: best(a, b), "query_id long, id long, value double")


def _norm(vec: str) -> Column:
    return F.sqrt(_dot(F.col(vec), F.col(vec)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _in_order(rated: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(quantised(F.col("score"), 9).desc(), "id"))
    return rated.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _rated(pairs: DataFrame, index: CodedVectors, asked: DataFrame, k: int) -> DataFrame:
    """The k best of pairs (query_id, id) by whole vectors."""
    a = asked.select(F.col("id").alias("query_id"), F.col("vec").alias("asks"), _norm("vec").alias("n"))
    both = pairs.distinct().join(a, "query_id").join(index.vectors.withColumn("m", _norm("vec")), "id").where(F.size("asks") == F.size("vec"))
    return _in_order(both.select("query_id", "id", (_dot(F.col("asks"), F.col("vec")) / (F.col("n") * F.col("m") + 1e-10)).alias("score")), k)


def nearest_shortlisted(index: CodedVectors, queries: DataFrame, k: int, shortlist: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, id, score: the k nearest of the `shortlist` vectors whose codes are nearest to each query."""
    asked, books = queries.select("id", "vec").where(usable()), index.books
    first = _scan(index, asked, *_blocks(index, asked, block_rows), lambda a, b: _block_best(a, b, books, shortlist, True))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "id"))
    return _rated(first.withColumn("rank", rank).where(F.col("rank") <= shortlist).select("query_id", "id"), index, asked, k)


def candidates(index: CodedVectors, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, most: int = MOST_IN_BLOCK) -> DataFrame:
    """query_id, id: the vectors that may be among a query's k nearest; null ids for blocks where these are more than `most`."""
    asked, books = queries.select("id", "vec").where(usable()), index.books
    n, m = _blocks(index, asked, block_rows)
    low = _scan(index, asked, n, m, lambda a, b: _block_best(a, b, books, k, False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value")))
    least = low.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("value").alias("least"))
    return _scan(index, asked.join(least, "id", "left"), n, m, lambda a, b: _block_reached(a, b, books, most)).select("query_id", "id")


def nearest_by_codes(index: CodedVectors, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, most: int = MOST_IN_BLOCK, most_in_all: int = MOST) -> DataFrame:
    """query_id, rank, id, score: what retrieve.nearest gives, with few vectors scored in full.

    Candidates are a table in the shared folder. A query that too many vectors
    may be near to (copies, say) is answered by retrieve.nearest. A query does
    not match its own id.
    """
    spark, asked = index.codes.sparkSession, queries.select("id", "vec").where(usable())
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    candidates(index, asked, k, block_rows, most).write.parquet(folder)
    met = spark.read.parquet(folder)
    full = met.groupBy("query_id").agg(F.count("*").alias("n"), F.count("id").alias("known")).where((F.col("known") < F.col("n")) | (F.col("n") > most_in_all)).select("query_id")
    if full.isEmpty():
        return _rated(met, index, asked, k)
    rest = nearest(index.vectors, asked.join(full.withColumnRenamed("query_id", "id"), "id", "left_semi"), k, block_rows)
    return _rated(met.join(full, "query_id", "left_anti"), index, asked, k).unionByName(rest)
