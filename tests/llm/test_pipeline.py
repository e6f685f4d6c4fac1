import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from tests.llm.test_packing import pieces_of
from tests.llm.test_secrets import ASSIGN
from tests.llm.test_simhash import slow_components, slow_fingerprint


def corpus():
    rng = np.random.default_rng(8)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = text(60)
    rows = [(i, text(80)) for i in range(30)]
    rows += [(30 + i, f"{text(30)} {passage} {text(30)}") for i in range(5)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, rows[7][1] + " password=hunter22 end"), (43, text(50) + " password=hunter22 end"), (44, "short"), (45, None), (46, "same " * 100)]
    return rows, passage


def brute_force(rows):
    """The stages one after the other, with plain Python."""
    rows = [(i, t) for i, t in rows if t and len(t.split()) >= 20 and len(set(t.split())) > 5]
    label = slow_components({i: slow_fingerprint(t) for i, t in rows})
    rows = [(i, t) for i, t in rows if label[i] == i]
    first, out = {}, []
    for i, t in sorted(rows):
        w = t.split()
        windows = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        gone = {p for k, x in enumerate(windows) if first.get(x, i) < i for p in range(k, k + 13)}
        for x in windows:
            first.setdefault(x, i)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
        if kept:
            out.append((i, ASSIGN.sub("[SECRET]", kept)))
    return out


def test_run_equals_brute_force(spark, plain, tmp_path):
    rows, passage = corpus()
    plain(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = [x for i, t in brute_force(rows) for x in pieces_of(i, t, 2048)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert {r.doc_id for r in got} == {*range(35), 43} | ({42} & {i for i, _ in brute_force(rows)})
    assert zlib.crc32(b"") == 0 and passage


def test_stages_keep_columns(spark, plain, tmp_path):
    rows, _ = corpus()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (plain(rows), plain([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.dtypes == frame.dtypes, name
            assert {r.doc_id for r in out.collect()} >= (set(range(30)) if not frame.isEmpty() else set()), name
