"""Search over ranges of words against search over chunks, and what it writes."""

import random
from pathlib import Path

import pyarrow as pa
import pytest

from quillspark.config import CHUNKINGS
from quillspark.operators import ranges as R
from quillspark.operators.chunk import chunk_all
from quillspark.operators.evaluate import find_hits
from quillspark.plans import queries as Q
from quillspark.sources.files import files_fingerprint

THRESHOLD = 0.3


def texts(n, seed, vocabulary=80):
    """Texts of lines and sentences, some of them odd, with copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice(("w", "W", "é", "ΑΣ", "İ")) + str(int(rng.paretovariate(0.5)) % vocabulary) + rng.choice(("", "", "", ".", "!", "?", ".x"))
    gap = lambda: rng.choice((" ", " ", " ", " ", "  ", "\n", "\n\n", "\t", " ", "\x85", "\x1c"))
    out = ["", " \n ", ". ! ?", "One.", "One. Two.", "One. Two. Three.", "\n\nlast", " w1. w2 "]
    out += ["".join(word() + gap() for _ in range(rng.choice((3, 30, 300, 900)))) for _ in range(n)]
    return out + out[-5:] * 9


def frame(spark, rows):
    return spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(rows)] + [("none", None)], "source_file string, text string").repartition(3)


@pytest.mark.parametrize("delimiter", ["\n", "\n\n"])
def test_ranges_are_the_chunks(spark, delimiter):
    rows = texts(16, 1)
    want = sorted((r.strategy, r.source_file, r.chunk_index, r.text.lower().split()) for r in chunk_all(frame(spark, rows).where("text is not null"), CHUNKINGS, delimiter, THRESHOLD).collect())
    made = R.cut(pa.array([t.lower() for t in rows]), CHUNKINGS, delimiter, THRESHOLD)
    words = [None] * len(made.order)
    for at, term in zip(made.order, made.term, strict=True):
        words[at] = made.terms[int(term)].as_py()
    got = sorted((x.strategy, f"d{d}", int(p), words[b : b + z]) for x in made.layers for d, p, b, z in zip(x.doc, x.place, x.begin, x.size, strict=True))
    assert got == want
    for x in made.layers:
        assert [list(x.of).count(k) for k in range(len(x.size))] == list(x.size)


@pytest.mark.parametrize(("frequent", "held", "size"), [(1 << 16, 50_000, 1 << 19), (0, 30, 2000)])
def test_hits_are_those_of_all_chunks(spark, monkeypatch, frequent, held, size):
    for name, value in (("FREQUENT", frequent), ("HELD_ROWS", held), ("SLICE_BYTES", size)):
        monkeypatch.setattr(R, name, value)
    docs = frame(spark, texts(25, 2))
    asked = spark.createDataFrame([("a", "w1 w2 w30 é3"), ("b", "w7 W7 w50 zzz"), ("c", "w3."), ("d", "zzz"), ("e", None), ("f", " ".join(texts(1, 3)[8].split()[:40]))], "question_id string, question string")
    chunks = chunk_all(docs, CHUNKINGS, "\n", THRESHOLD)
    kinds = lambda hits: sorted((r.config_name, r.question_id, r["rank"], r.source_file, r.chunk_index, round(r.score, 8)) for r in hits.collect())
    hits, some = R.range_hits(docs, asked, CHUNKINGS, delimiter="\n", threshold=THRESHOLD)
    assert kinds(hits) == kinds(find_hits(chunks, asked))
    key = ["strategy", "source_file", "chunk_index", "text", "n_tokens"]
    assert some.select(*key).exceptAll(chunks.select(*key)).isEmpty() and hits.join(some, key[:3], "left_anti").isEmpty()


def test_names_twice_are_left_to_the_other_way(spark):
    docs = frame(spark, ["w1 w2", "w3"])
    asked = spark.createDataFrame([("a", "w1")], "question_id string, question string")
    assert R.range_hits(docs.union(docs), asked, CHUNKINGS) is None and R.range_hits(docs, asked, CHUNKINGS, delimiter="--") is None


#: Queries that read the results of one evaluation.
READERS = ("best_worst", "grid_search_by_category", "grid_top_k_by_category", "plateau_tokens", "quick_sample", "rerank_gain", "grids_in_one_pass", "pareto_frontier", "results_json_roundtrip", "summary_csv_roundtrip", "top10_bottom5", "trend_fit")


def test_an_evaluation_writes_less_than_it_reads(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    docs = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(400))) for k in range(2000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    spark.createDataFrame([(7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/in/labels.parquet")
    monkeypatch.setattr(Q, "shared_folder", lambda _: f"{tmp_path}/out")
    monkeypatch.setattr(R, "shared_folder", lambda _: f"{tmp_path}/out")
    size = lambda at: sum(p.stat().st_size for p in Path(tmp_path, at).rglob("*") if p.is_file())
    for name in READERS:
        Q.QUERIES[name](spark, f"{tmp_path}/in").collect()
        assert size("out") < size("in"), name


def test_changed_files_are_evaluated_anew(spark, tmp_path):
    frame(spark, ["a"]).write.parquet(f"{tmp_path}/x")
    name = lambda settings="": files_fingerprint(spark, [f"{tmp_path}/x"], settings)
    first = name()
    assert name() == first != name("other")
    frame(spark, ["b"]).write.mode("overwrite").parquet(f"{tmp_path}/x")
    assert name() != first
