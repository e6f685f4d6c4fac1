"""Inverted index and statistics of chunks, all keyed by chunking strategy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import BM25_B, BM25_EPSILON, BM25_K1
from quillspark.functions.text import terms

KEY = ["strategy", "source_file", "chunk_index"]
FORWARD = "strategy string, source_file string, chunk_index int, dl long, terms array<struct<term:string,tf:bigint>>"


class Index:
    """Parts of an index, each made when it is first asked for.

    forward (KEY, dl, terms): what each chunk holds; postings (KEY, term, tf, dl): the same by
    term; term_stats (strategy, term, df, idf, weight, most): most bounds what a
    chunk's tf and length make of the term; corpus_stats (strategy, n_chunks, avgdl); norms (KEY, norm) for cosines.
    `part(name, build)` keeps a part or hands it through.
    """

    def __init__(self, forward: Callable[[], DataFrame], part: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda _, build: build()):
        self._forward, self._part = forward, part

    @cached_property
    def forward(self) -> DataFrame:
        return self._part("forward", self._forward)

    @property
    def lengths(self) -> DataFrame:
        return self.forward.select(*KEY, "dl")

    @property
    def entries(self) -> DataFrame:
        """The postings in the order of the chunks."""
        return self.forward.select(*KEY, "dl", F.explode("terms").alias("t")).select(*KEY, "t.term", "t.tf", "dl")

    @cached_property
    def postings(self) -> DataFrame:
        """Sorted by term, so a search for few terms reads few row groups, and the postings of a very frequent term may be in many files."""
        return self._part("postings", lambda: self.entries.repartitionByRange("strategy", "term", "source_file", "chunk_index").sortWithinPartitions("strategy", "term"))

    @cached_property
    def corpus_stats(self) -> DataFrame:
        """Chunks without tokens count, as they do for the mean length."""
        return self._part("corpus", lambda: self.lengths.groupBy("strategy").agg(F.count("*").alias("n_chunks"), (F.sum("dl") / F.count("*")).alias("avgdl")))

    @cached_property
    def term_stats(self) -> DataFrame:
        """Combined where the chunks are, so a row for each term and task travels."""
        sizes = F.broadcast(self.corpus_stats.select("strategy", "avgdl"))  # a row for each strategy
        counted = self.forward.join(sizes, "strategy").select("strategy", "dl", "avgdl", F.explode("terms").alias("t")).groupBy("strategy", F.col("t.term").alias("term"))
        return self._part("terms", lambda: term_statistics(counted.agg(F.count("*").alias("df"), F.max(damped(F.col("t.tf"), F.col("dl"), F.col("avgdl"))).alias("most")), self.corpus_stats))

    @cached_property
    def norms(self) -> DataFrame:
        return self._part("norms", lambda: norms_of(self.entries, self.term_stats))


def damped(tf, dl, avgdl):
    """What Okapi makes of a term's count in a chunk: the more the higher, the longer the chunk the lower."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))


def forward_of(chunks: DataFrame) -> DataFrame:
    """KEY, dl, terms of each chunk, counted where the chunk is: nothing travels. A chunk without tokens has no terms."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            sizes = np.diff(lists.offsets.to_numpy())
            words = lists.flatten().dictionary_encode()
            n = max(1, len(words.dictionary))
            held, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + words.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(held, np.arange(len(sizes) + 1) * n)
            flat = pa.StructArray.from_arrays([words.dictionary.take(pa.array(held % n)), pa.array(times)], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat).cast(kind)], names=[*KEY, "dl", "terms"])

    return chunks.select("strategy", "source_file", F.col("chunk_index").cast("int").alias("chunk_index"), terms(F.col("text")).alias("t")).mapInArrow(count, FORWARD)


def postings_of(chunks: DataFrame) -> DataFrame:
    """A chunk's tokens are in one task, so counting them is done before the shuffle and only postings travel."""
    return chunks.select(*KEY, F.explode(terms(F.col("text"))).alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("tf"))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """Chunks that hold each term; the grouped count is combined before the shuffle."""
    return chunks.select("strategy", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("strategy", "term").agg(F.count("*").alias("df"))


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select(*KEY, F.size(terms(F.col("text"))).cast("long").alias("dl"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """Rows without tokens count as chunks, as they do for the mean length."""
    return lengths(chunks).groupBy("strategy").agg(F.count("*").alias("n_chunks"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def term_statistics(df: DataFrame, corpus: DataFrame) -> DataFrame:
    """df with idf as Okapi has it, negative ones replaced by a share of the mean over the vocabulary; weight is for cosines."""
    raw = df.join(F.broadcast(corpus.select("strategy", "n_chunks")), "strategy")  # a row for each strategy
    raw = raw.withColumn("raw", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("strategy").agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, BM25_EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean), "strategy").select(*df.columns, idf.alias("idf"), F.log(1 + F.col("n_chunks") / F.col("df")).alias("weight"))


def stored_index(chunks: DataFrame, folder: str) -> Index:
    """build_index kept in a folder, which has to be named for the chunks' texts and settings; a part that is there is read, and only parts that a search asks for are made."""
    from quillspark.sources.files import kept

    return Index(lambda: forward_of(chunks), lambda name, build: kept(chunks.sparkSession, f"{folder.rstrip('/')}/{name}", build))


def norms_of(postings: DataFrame, stats: DataFrame) -> DataFrame:
    weighted = postings.join(stats.select("strategy", "term", "weight"), ["strategy", "term"])
    return weighted.groupBy(*KEY).agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("weight"), 2))).alias("norm"))


def build_index(chunks: DataFrame) -> Index:
    """An empty table gives empty statistics, so retrieval over it returns no rows."""
    return Index(lambda: forward_of(chunks))
