"""An index that grows: segments, a manifest of versions, and tombstones.

A version names its segments and the documents in them that are dead. A changed
corpus is compared by each document's fingerprint with the live documents: new
and changed ones are cut and tokenised into one more segment, changed and
removed ones get tombstones, and the rest is left as it is. Statistics are
sums over the segments' own tables, less what dead documents had. A merge
rewrites small segments as one, without dead documents and without reading texts again.

    folder/segments/<name>/{chunks,forward,postings,terms,docs}
    folder/versions/<n>/{segments,dead} and <n>.whole once the version is complete
    folder/statistics/<n>/{corpus,terms,norms} as far as searches have asked for them

A version counts once its marker is written, so an update that breaks off
changes nothing, and readers of a version keep it. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.index import KEY, Index, damped, forward_of, norms_of, term_statistics
from quillspark.sources.files import kept

#: Segments of a version from which an update merges the smaller ones, and how many are then left.
MERGE_AT, MERGE_TO = 8, 4
_SEGMENTS, _DEAD = "segment string, docs long", "segment string, source_file string"


class SegmentedIndex(Index):
    """The live part of a version, as an index; nothing of it is computed from texts. Statistics and norms are kept with the version."""

    def __init__(self, store: SegmentStore, segments: list[str], dead: DataFrame, version: int | None = None):
        super().__init__(lambda: self._live("forward"))
        self._store, self._segments, self._dead, self._version = store, segments, dead, version

    def _with_version(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return build() if self._version is None else kept(self._store.spark, f"{self._store.folder}/statistics/{self._version}/{name}", build)

    def _every(self, table: str) -> DataFrame:
        table_of = self._store.postings if table == "postings" else lambda s: self._store.table(s, table)
        return reduce(DataFrame.unionByName, (table_of(s).withColumn("segment", F.lit(s)) for s in self._segments))

    def _live(self, table: str) -> DataFrame:
        return self._every(table).join(self._dead, ["segment", "source_file"], "left_anti").drop("segment")

    @cached_property
    def chunks(self) -> DataFrame:
        return self._live("chunks")

    @cached_property
    def postings(self) -> DataFrame:
        return self._live("postings")

    @cached_property
    def corpus_stats(self) -> DataFrame:
        return self._with_version("corpus", lambda: self.lengths.groupBy("strategy").agg(F.count("*").alias("n_chunks"), (F.sum("dl") / F.count("*")).alias("avgdl")))

    @cached_property
    def term_stats(self) -> DataFrame:
        """Chunk counts are summed over the segments' terms, less those of dead documents; `most` follows from a term's largest count and shortest chunk, so it may be too high, but not too low."""
        gone = self._every("forward").join(self._dead, ["segment", "source_file"], "left_semi").select("strategy", F.explode("terms.term").alias("term")).groupBy("strategy", "term").agg((-F.count("*")).alias("df"))
        parts = self._every("terms").select("strategy", "term", "df", "tf", "dl").unionByName(gone, allowMissingColumns=True)
        sums = parts.groupBy("strategy", "term").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"), F.min("dl").alias("dl")).where("df > 0")
        bound = sums.join(F.broadcast(self.corpus_stats.select("strategy", "avgdl")), "strategy").select("strategy", "term", "df", damped(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("most"))
        return self._with_version("terms", lambda: term_statistics(bound, self.corpus_stats))

    @cached_property
    def norms(self) -> DataFrame:
        return self._with_version("norms", lambda: norms_of(self.entries, self.term_stats))


class SegmentStore:
    """Versions of an index in a folder; `chunker` makes chunks (KEY, text, n_tokens) of documents (source_file, text)."""

    def __init__(self, spark: SparkSession, folder: str, chunker: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.chunker = spark, folder.rstrip("/"), chunker

    def table(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/segments/{segment}/{name}")

    def postings(self, segment: str) -> DataFrame:
        """A segment's postings, written when a search first asks for them."""
        part = lambda name, build: kept(self.spark, f"{self.folder}/segments/{segment}/{name}", build)
        return Index(lambda: self.table(segment, "forward"), part).postings

    def version(self) -> int:
        """The last complete version, 0 if there is none."""
        try:
            return self.spark.read.schema("version long").parquet(f"{self.folder}/versions/*.whole").agg(F.max("version")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def _state(self, version: int) -> tuple[dict[str, int], DataFrame]:
        """(documents of each segment, tombstones). A version has few segments."""
        if not version:
            return {}, self.spark.createDataFrame([], _DEAD)
        at = f"{self.folder}/versions/{version}"
        return {r["segment"]: r["docs"] for r in self.spark.read.schema(_SEGMENTS).parquet(f"{at}/segments").collect()}, self.spark.read.schema(_DEAD).parquet(f"{at}/dead")

    def _commit(self, version: int, segments: dict[str, int], dead: DataFrame) -> int:
        at = f"{self.folder}/versions/{version}"
        self.spark.createDataFrame(sorted(segments.items()), _SEGMENTS).coalesce(1).write.mode("overwrite").parquet(f"{at}/segments")
        dead.write.mode("overwrite").parquet(f"{at}/dead")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{at}.whole")
        return version

    def _write(self, chunks: DataFrame | None, forward: DataFrame | None, docs: DataFrame) -> tuple[str, int]:
        """A new segment of chunks, or of chunks and what they hold."""
        name = uuid.uuid4().hex
        at = lambda t: f"{self.folder}/segments/{name}/{t}"
        chunks.write.parquet(at("chunks"))
        made = Index(lambda: forward if forward is not None else forward_of(self.table(name, "chunks")), lambda t, build: kept(self.spark, at(t), build))
        each = made.forward.select("strategy", "dl", F.explode("terms").alias("t")).select("strategy", "t.term", "t.tf", "dl")
        counted = each.groupBy("strategy", "term").agg(F.count("*").alias("df"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        counted.repartitionByRange("strategy", "term").sortWithinPartitions("strategy", "term").write.parquet(at("terms"))
        docs.write.parquet(at("docs"))
        return name, self.table(name, "docs").count()

    def update(self, docs: DataFrame) -> int:
        """Make the index hold just these documents; the version that does. Rows that share a source_file are one document; null names take no part."""
        docs, version = docs.where("source_file is not null"), self.version()
        segments, dead = self._state(version)
        now = docs.groupBy("source_file").agg(F.count("*").alias("n"), F.sum(F.xxhash64("text").cast("decimal(38,0)")).alias("print"))
        if segments:
            index = SegmentedIndex(self, list(segments), dead)
            live = index._every("docs").join(dead, ["segment", "source_file"], "left_anti")
            fresh = now.join(live, ["source_file", "n", "print"], "left_anti")
            gone = live.join(now, ["source_file", "n", "print"], "left_anti").select("segment", "source_file")
        else:
            fresh, gone = now, dead
        added, removed = not segments or not fresh.isEmpty(), bool(segments) and not gone.isEmpty()
        if not (added or removed):
            return version
        if added:
            name, n = self._write(self.chunker(docs.join(fresh.select("source_file"), "source_file", "left_semi")), None, fresh)
            segments = segments | {name: n}
        version = self._commit(version + 1, segments, dead.unionByName(gone) if removed else dead)
        return self.merge() if len(segments) >= MERGE_AT else version

    def merge(self, left: int | None = None) -> int:
        """Rewrite the smallest segments as one, so that `left` are left; dead documents in them are dropped. Texts are not tokenised again."""
        version, left = self.version(), MERGE_TO if left is None else left
        segments, dead = self._state(version)
        small = sorted(segments, key=lambda s: (segments[s], s))[: max(0, len(segments) - left + 1)]
        if len(small) < 2:
            return version
        part = SegmentedIndex(self, small, dead)
        name, n = self._write(part.chunks, part.forward, part._live("docs"))
        rest = {s: k for s, k in segments.items() if s not in small}
        return self._commit(version + 1, rest | {name: n}, dead.where(~F.col("segment").isin(small)))

    def index(self, version: int | None = None) -> SegmentedIndex:
        """A version's index, by default the last one's; update() comes first."""
        version = version or self.version()
        segments, dead = self._state(version)
        return SegmentedIndex(self, list(segments), dead, version)
