"""The growing index against one built anew."""

import numpy as np
import pytest

from quillspark.operators.chunk import chunk_all
from quillspark.operators.evaluate import find_hits
from quillspark.operators.index import build_index
from quillspark.sources import segments as S

CHUNKINGS = ("fixed_256",)


def texts(seed, names):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    return {n: "\n\n".join(" ".join(rng.choice(words, rng.integers(1, 70))) for _ in range(3)) for n in names}


@pytest.fixture
def store(spark, tmp_path):
    """A store whose chunker takes down which documents it is given."""
    seen = []

    def chunker(docs):
        seen.append(sorted(r.source_file for r in docs.select("source_file").distinct().collect()))
        return chunk_all(docs, CHUNKINGS)

    made = S.SegmentStore(spark, str(tmp_path / "ix"), chunker)
    made.seen = seen
    return made


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "source_file string, text string")


def hits(spark, chunks, index, **how):
    asked = spark.createDataFrame([("a", "w1 w2 w30"), ("b", "w7 w7 w50 zzz"), ("c", "w3")], "question_id string, question string")
    return sorted((r.config_name, r.question_id, r["rank"], r.source_file, r.chunk_index, round(r.score, 9)) for r in find_hits(chunks, asked, ("bm25",), (3,), index=index, **how).collect())


def same(spark, store, docs):
    index, chunks = store.index(), chunk_all(frame(spark, docs), CHUNKINGS)
    rows = lambda df: sorted(map(str, df.select("strategy", "source_file", "chunk_index", "text", "n_tokens").collect()))
    assert rows(index.chunks) == rows(chunks)
    want = {(r.strategy, r.term): (r.df, round(r.idf, 9), r.most) for r in build_index(chunks).term_stats.collect()}
    got = {(r.strategy, r.term): (r.df, round(r.idf, 9), r.most) for r in index.term_stats.collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and all(got[k][2] >= want[k][2] - 1e-12 for k in want)
    assert hits(spark, index.chunks, index) == hits(spark, chunks, None)
    return index


def test_grows_by_what_is_new(spark, store):
    docs = texts(1, [f"d{k}" for k in range(30)])
    assert store.update(frame(spark, docs)) == 1 and store.seen == [sorted(docs)]
    assert store.update(frame(spark, docs)) == 1 and len(store.seen) == 1  # nothing changed, nothing done
    docs |= texts(2, ["d31", "d5"])  # one new, one changed
    del docs["d7"]
    assert store.update(frame(spark, docs)) == 2 and store.seen[1:] == [["d31", "d5"]]
    del docs["d8"]
    assert store.update(frame(spark, docs)) == 3 and len(store.seen) == 2  # only a tombstone
    index = same(spark, store, docs)
    assert hits(spark, index.chunks, index, bounds=True) == hits(spark, index.chunks, index, bounds=False)
    # a version that was broken off before its marker does not count, and older versions stay
    (tmp := frame(spark, {})).write.parquet(f"{store.folder}/versions/4/segments")
    assert tmp.isEmpty() and store.version() == 3
    assert store.index(1).forward.select("source_file").distinct().count() == 30


def test_merges_keep_the_result_and_drop_the_dead(spark, store, monkeypatch):
    monkeypatch.setattr(S, "MERGE_AT", 3)
    monkeypatch.setattr(S, "MERGE_TO", 2)
    docs = texts(3, [f"d{k}" for k in range(8)])
    store.update(frame(spark, docs))
    docs |= texts(4, ["d1", "e1"])
    store.update(frame(spark, docs))
    docs |= texts(5, ["d1", "e2"])
    assert store.update(frame(spark, docs)) == 4  # an update and a merge
    assert len(store.seen) == 3  # the merge has cut and tokenised nothing
    store.merge(1)
    segments, dead = store._state(store.version())
    assert len(segments) == 1 and list(segments.values()) == [len(docs)] and dead.isEmpty()
    same(spark, store, docs)


def test_edges(spark, store):
    empty = spark.createDataFrame([(None, "x")], "source_file string, text string")
    store.update(empty)
    assert store.index().forward.count() == 0 and hits(spark, store.index().chunks, store.index()) == []
    twice = spark.createDataFrame([("a", "w1 w2"), ("a", "w3"), ("b", None), ("c", "")], "source_file string, text string")
    store.update(twice)
    assert store.index().chunks.where("source_file = 'a'").count() == 2 and store.update(twice) == 2
    store.update(empty)
    assert store.index().chunks.count() == 0
