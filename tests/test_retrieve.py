import math
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.config import RetrievalConfig, all_configs, choose_llm, LLMConfig, parse_name, sample_configs
from quillspark.operators.evaluate import config_matrix, evaluate, find_hits
from quillspark.operators.index import build_index
from quillspark.operators.retrieve import nearest, ranked_pairs, retrieve, score_pairs
from quillspark.operators.score import fact_scores, gold_pairs, retrieval_scores, vector_similarity
from quillspark.schemas import QUESTIONS

TEXTS = {
    "code.md": "Our services are written in Rust and Kotlin, and every change is reviewed.",
    "money.md": "Revenue in the third quarter was 42 million, and margins rose to 31 percent.",
    "ops.md": "A release goes to the canary servers first, then to all regions by the pipeline.",
    "people.md": "Staff get health cover, a pension plan and thirty days of paid leave.",
}


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([("fixed_256", s, 0, t, len(t.split())) for s, t in TEXTS.items()], "strategy string, source_file string, chunk_index int, text string, n_tokens int")


@pytest.fixture
def questions(spark):
    rows = [("q1", "what was revenue in the third quarter", "money.md"), ("q2", "how many days of paid leave", "people.md"), ("q3", "where does a release go first", "ops.md")]
    return spark.createDataFrame([(i, q, g) for i, q, g in rows], "question_id string, question string, gold string")


@pytest.mark.parametrize("search", ["vector", "bm25", "hybrid", "hybrid_rerank"])
def test_expected_source_comes_first_and_k_bounds(chunks, questions, search):
    for k in (1, 2, 3):
        hits = find_hits(chunks, questions, (search,), (k,)).join(questions, "question_id").collect()
        assert {r.gold for r in hits if r["rank"] == 1} == {r.source_file for r in hits if r["rank"] == 1}
        assert max(Counter(r.question_id for r in hits).values()) <= k and all(r.config_name == f"fixed_256__{search}__k{k}" for r in hits)


def test_bm25_scores(spark, chunks, questions):
    docs = {s: t.lower().split() for s, t in TEXTS.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    got = score_pairs(build_index(chunks), questions).join(questions, "question_id").collect()
    assert got
    for r in got:
        d, tf = docs[r.source_file], Counter(docs[r.source_file])
        want = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in r.question.split())
        assert abs(r.bm25 - want) < 1e-9 and 0 < r.coverage <= 1


def test_best_pairs_are_what_all_pairs_rank(spark, monkeypatch):
    """Scoring in blocks and keeping each task's best gives the ranks that all pairs give, ties and repeated chunks included."""
    from quillspark.operators import retrieve as R

    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(40)]
    rows = [(s, f"d{i % 90}", i // 90, " ".join(rng.choice(words, rng.integers(0, 30)))) for s in ("fixed_256", "paragraph") for i in range(120)] + [("fixed_256", f"t{i}", 0, "w1 w2 w3") for i in range(50)]
    chunks = spark.createDataFrame([(*r, 1) for r in rows], "strategy string, source_file string, chunk_index int, text string, n_tokens int").repartition(5)
    asked = spark.createDataFrame([(f"q{k}", " ".join(rng.choice(words, 4)) + (" w1 w2 w3" if k % 2 else " zzz")) for k in range(9)], "question_id string, question string")
    monkeypatch.setattr(R, "BLOCK_SCORES", 200)
    index = build_index(chunks)
    cols = ["strategy", "question_id", "source_file", "chunk_index", "bm25_rank", "vector_rank"]
    values = lambda f, v: sorted((tuple(r[c] for c in cols), *(None if r[c] is None else round(r[c], 9) for c in ("bm25", "cosine", "coverage"))) for r in ranked_pairs(f(index, v), 6).collect())
    for vectors in (True, False):
        every = values(lambda i, v: score_pairs(i, asked, v), vectors)
        assert every and sorted(map(str, values(lambda i, v: R.best_pairs(i, asked, 6, v), vectors))) == sorted(map(str, every))
    monkeypatch.setattr(R, "DENSE_QUESTIONS", 3)
    assert R.best_pairs(index, asked, 6).count() == score_pairs(index, asked).count()


class Letters:
    """An embedder: counts of letters."""

    def encode(self, texts):
        return texts.map(lambda t: [float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] + [1e-3])


class Longest:
    """A reranker that prefers long texts."""

    def predict(self, questions, texts):
        return texts.map(lambda t: float(len(t)))


@pytest.fixture
def server():
    """A chat server that answers with what it was asked, in capitals."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert self.path == "/v1/chat/completions" and self.headers["Authorization"] == "Bearer k" and asked["model"] == "m"
            body = json.dumps({"choices": [{"message": {"content": asked["messages"][-1]["content"].upper()}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/v1"
    http.shutdown()


def test_bounds_leave_out_postings_and_no_hit(spark, monkeypatch):
    """Keyword search with bounds gives the ranks that full scoring gives, from under half of the postings and a few of the chunks."""
    from quillspark.operators import retrieve as R

    rng = np.random.default_rng(11)
    words = np.array([f"w{k}" for k in range(3000)])
    often = 1 / np.arange(1, 3001)
    rows = [("whole", f"d{i:04}", 0, " ".join(rng.choice(words, rng.integers(1, 80), p=often / often.sum())), 1) for i in range(1500)] + [("whole", f"t{i}", 0, "w5 w700 w700", 1) for i in range(40)] + [("whole", "none", 0, "", 1)]
    chunks = spark.createDataFrame(rows, "strategy string, source_file string, chunk_index int, text string, n_tokens int")
    asked = [(f"q{k}", " ".join([*rng.choice(words[:20], 2), *rng.choice(words[20:], 3)])) for k in range(20)] + [("ties", "w700 w5"), ("few", "w2999 w1"), ("unknown", "zzz yyy"), ("common", "w0 w1 w2"), ("empty", "")]
    asked, index = spark.createDataFrame(asked, "question_id string, question string"), build_index(chunks)
    read, sums = [], R._term_sums
    monkeypatch.setattr(R, "_term_sums", lambda s, i, r: read.append(r.drop_duplicates(["strategy", "term"])["df"].sum()) or sums(s, i, r))
    ranks = lambda **how: sorted((r.question_id, r.source_file, r.bm25_rank, round(r.bm25, 9)) for r in ranked_pairs(R.best_pairs(index, asked, 5, False, **how), 5).collect())
    want = ranks(bounds=False)
    assert not read and ranks(bounds=True) == want and ranks() == want
    assert {q for q, *_ in want} >= {"ties", "few", "common"}
    assert sum(read[:2]) < index.postings.count() / 2
    chosen = R.candidates(index, R.asked_sides(index, R.query_terms(asked.where("question_id = 'ties'"))), 5)
    assert chosen.count() < 100


def test_parts_are_made_on_demand(spark, chunks, questions, tmp_path):
    from quillspark.operators.index import stored_index

    find_hits(chunks, questions, ("bm25",), (3,), index=stored_index(chunks, f"{tmp_path}/ix"), bounds=False).collect()
    assert {p.name for p in (tmp_path / "ix").iterdir() if not p.name.endswith(".whole")} == {"forward", "corpus", "terms"}


def test_models_take_the_place_of_stand_ins(spark, server, tmp_path):
    from quillspark.operators.chunk import chunk_semantic
    from quillspark.providers import Models

    docs = spark.createDataFrame(list(TEXTS.items()), "source_file string, text string")
    asked = spark.createDataFrame([("q1", "third quarter revenue", "REVENUE", ["money.md"], ["ops.md"], ["42"], "a", "easy"), ("q2", "zzz", "none", ["ops.md"], None, ["x"], "b", "hard")], QUESTIONS)
    models = Models(Letters(), Longest(), LLMConfig(server, "m", "k"), "{question}|{context}")
    rows = evaluate(docs, asked, ("fixed_256",), ("vector", "hybrid_rerank"), (3,), models=models, index_folder=str(tmp_path)).collect()
    assert len(rows) == 4 and all(r.chunks_retrieved == 3 for r in rows)  # vectors find chunks without a shared word too
    by = {(r.config_name.split("__")[1], r.question_id): r for r in rows}
    letters = lambda t: np.array([t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] + [1e-3], float)
    cos = lambda a, b: float(letters(a) @ letters(b) / np.linalg.norm(letters(a)) / np.linalg.norm(letters(b)))
    nearest_first = sorted(TEXTS.values(), key=lambda t: -cos("third quarter revenue", t))
    assert by["vector", "q1"].generated_answer == ("third quarter revenue|" + "\n---\n".join(nearest_first[:3])).upper()
    longest_first = sorted(TEXTS.values(), key=len, reverse=True)[:3]
    assert by["hybrid_rerank", "q2"].generated_answer == ("zzz|" + "\n---\n".join(longest_first)).upper()
    for r in rows:
        assert abs(r.gold_similarity - cos(r.generated_answer, r.gold_answer)) < 1e-6 and r.generation_latency_ms > 0 and r.total_latency_ms == r.retrieval_latency_ms + r.generation_latency_ms
    groups = chunk_semantic(spark.createDataFrame([("s", "Aaa aaa. Aab aa. Zzz zz. Zzy zz.")], "source_file string, text string"), 0.8, Letters())
    assert [r.text for r in groups.orderBy("chunk_index").collect()] == ["Aaa aaa. Aab aa.", "Zzz zz. Zzy zz."]


def test_stored_index(spark, chunks, questions, tmp_path):
    """An index that is there is read, and what is found with it is the same."""
    from quillspark.operators.index import stored_index

    folder = f"{tmp_path}/index"
    rows = lambda index: sorted((*r[:8], round(r[8], 9)) for r in find_hits(chunks, questions, index=index).collect())
    want = rows(None)
    assert rows(stored_index(chunks, folder)) == want
    written = (tmp_path / "index/postings").stat().st_mtime_ns
    shutil.rmtree(tmp_path / "index/terms.whole")  # as if its writing had been broken off
    assert rows(stored_index(chunks, folder)) == want and (tmp_path / "index/terms.whole").exists()
    assert (tmp_path / "index/postings").stat().st_mtime_ns == written


def test_parts_that_are_there_are_read(spark, chunks, questions, tmp_path):
    """Postings are written when a search by bounds first asks for them; what is there is written once, and hits are the same."""
    from quillspark.operators.index import stored_index

    folder = tmp_path / "index"
    rows = lambda index, **how: sorted((*r[:8], round(r[8], 9)) for r in find_hits(chunks, questions, index=index, **how).collect())
    assert rows(stored_index(chunks, str(folder))) == rows(None) and not (folder / "postings").exists()
    keywords = {"searches": ("bm25",), "bounds": True}
    assert rows(stored_index(chunks, str(folder)), **keywords) == rows(None, **keywords)
    written = {p.name: p.stat().st_mtime_ns for p in folder.iterdir()}
    assert {"forward", "corpus", "terms", "norms", "postings"} <= set(written)
    assert rows(stored_index(chunks, str(folder))) == rows(None) and rows(stored_index(chunks, str(folder)), **keywords) == rows(None, **keywords)
    assert {p.name: p.stat().st_mtime_ns for p in folder.iterdir()} == written


def test_retrieval_counts(spark):
    from quillspark.operators.score import retrieval_counts

    hits = spark.createDataFrame([("c", "1", s) for s in ("q3", "q3", "deploy")] + [("c", "2", s) for s in ("q3", "q2", "q2")] + [("c", "3", "a")], "config_name string, question_id string, source_file string")
    gold = spark.createDataFrame([("1", "q3"), ("1", "policy"), ("1", "deploy"), ("1", "deploy"), ("2", "q3")], "question_id string, source_file string")
    bad = spark.createDataFrame([("2", "q2"), ("1", "q2"), ("2", "q2")], "question_id string, source_file string")
    got = {r.question_id: tuple(r)[2:] for r in retrieval_counts(hits, gold, bad).collect()}
    assert got == {"1": pytest.approx((1, 3 / 4, 0)), "2": pytest.approx((1 / 3, 1, 2 / 3)), "3": (0, 0, 0)}
    assert {r.question_id: r.distractor_rate for r in retrieval_counts(hits, gold, bad.select("source_file")).collect()}["2"] == pytest.approx(2 / 3)


def test_llm_presets():
    from quillspark.config import llm_presets

    assert choose_llm(llm_presets({})).provider == "local"
    cloud = llm_presets({"QUILL_CLOUD_URL": "https://api.example.com/v1", "QUILL_CLOUD_MODEL": "m", "QUILL_CLOUD_KEY": "k"})
    assert choose_llm(cloud).api_key == "k" and choose_llm(cloud, "local").provider == "local"


def test_fusion_bounds(chunks, questions):
    scores = [r.score for r in find_hits(chunks, questions, ("hybrid",), (3,)).collect()]
    assert scores and all(1 / (60 + 6) <= s <= 2 / 61 + 1e-12 for s in scores)


def test_empty_corpus_and_unknown_words(spark, chunks, questions):
    assert find_hits(chunks.limit(0), questions).count() == 0
    assert find_hits(chunks, spark.createDataFrame([("q", "zzz yyy"), ("r", None)], "question_id string, question string")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 6))
    v[7] = v[3]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [0.0] * 6)], "id long, vec array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    # a vector with an infinite component is no match, and takes no other's place
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)] + [(10, [1.0, float("inf")])], "id long, vec array<double>")
    assert [r.id for r in nearest(few, few.where("id = 0"), 3).orderBy("rank").collect()] == [1, 2, 3]
    for rows in (4096, 8):
        got = {}
        for r in nearest(frame, frame.where("id % 5 = 0"), 4, rows).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.id
        for i in range(0, 50, 5):
            want = sorted(range(50), key=lambda j: (-round(sim[i, j], 8), j))[:4]
            assert [got[i][k] for k in (1, 2, 3, 4)] == want
        assert 90 not in got and 91 not in got


def test_retrieval_scores(spark):
    cases = [(["q3", "q3", "deploy"], ["q3"], None, (2 / 3, 1, 0)), (["q3", "deploy"], ["q3", "policy", "deploy"], [], (1, 2 / 3, 0)), (["q3", "q2", "q2"], ["q3"], ["q2"], (1 / 3, 1, 2 / 3)), ([], ["q3"], ["q2"], (0, 0, 0)), (None, ["q3"], None, (0, 0, 0)), (["a"], [], None, (0, 0, 0))]
    frame = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, got array<string>, gold array<string>, bad array<string>")
    for r in frame.select("i", *[c.alias(n) for n, c in retrieval_scores(F.col("got"), F.col("gold"), F.col("bad")).items()]).collect():
        assert (r.context_precision, r.context_recall, r.distractor_rate) == pytest.approx(cases[r.i][3])


def test_fact_scores(spark):
    cases = [("Revenue was 42.3M and margin 28%", ["42.3M", "28%"], 1, []), ("it rose to $47.1M or 12 PERCENT", ["47.1", "12%"], 1, []), ("nothing", ["a1", "b2", "c3"], 0, ["a1", "b2", "c3"]), ("only ALPHA", ["alpha", "beta"], 0.5, ["beta"]), ("x", [], 1, []), ("see 1280", ["28%"], 1, []), (None, ["", "z"], 0.5, ["z"])]
    frame = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, f array<string>")
    for r in frame.select("i", *[c.alias(n) for n, c in fact_scores(F.col("a"), F.col("f")).items()]).collect():
        assert (r.fact_recall, r.missing_facts) == cases[r.i][2:]


def test_vector_similarity(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0)], "a array<float>, b array<float>, w double")
    assert all(abs(r.s - r.w) < 1e-6 for r in frame.select("w", vector_similarity(F.col("a"), F.col("b")).alias("s")).collect())


def test_gold_pairs(spark):
    docs = spark.createDataFrame([("a", 'He said: "the quick brown fox" today'), ("b", "the quick brown dog"), ("c", None)], "source_file string, text string")
    asked = spark.createDataFrame([("1", "the quick brown fox"), ("2", "quick brown dog"), ("3", "two words"), ("4", "brown dog"), ("5", "rown"), ("6", None), ("7", "e quick brown d")], "question_id string, question string")
    want = {("1", "a"), ("2", "b"), ("4", "b"), ("5", "a"), ("5", "b"), ("7", "b")}
    for block in (1000, 1):  # questions without an inner word, together and one by one
        found = gold_pairs(docs, asked, block).collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)
    just = spark.createDataFrame([("a", "just two words here")], "source_file string, text string")
    assert [tuple(r) for r in gold_pairs(just, asked.where("question_id = '3'")).collect()] == [("3", "a")]


def test_configs(spark):
    names = [c.name for c in all_configs()]
    assert len(set(names)) == 48 and {r.config_name for r in config_matrix(spark).collect()} == set(names)
    assert all(parse_name(n).name == n for n in names)
    for bad in ("fixed_256__bm25", "fixed_256__bm25__kk3", "x__bm25__k3"):
        with pytest.raises(ValueError):
            parse_name(bad)
    assert len({c.name for c in sample_configs(48, 1)}) == 12 and len({c.name for c in sample_configs(48, 1, coprime=True)}) == 48
    presets = {"here": LLMConfig("http://localhost:1/v1", "m"), "there": LLMConfig("https://api.example.com/v1", "m", "key"), "bare": LLMConfig("https://api.example.com/v1", "m")}
    assert choose_llm(presets).api_key == "key" and choose_llm(presets, "here").provider == "local" and "key" not in repr(presets["there"])
    with pytest.raises(ValueError, match="key"):
        choose_llm(presets, "bare")
    assert RetrievalConfig("semantic", "bm25", 7).name == "semantic__bm25__k7"


def test_evaluate_has_a_row_for_everything(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "source_file string, text string")
    asked = spark.createDataFrame([("q1", "third quarter revenue", "Revenue was 42 million", ["money.md"], ["ops.md"], ["42"], "a", "easy"), ("q2", "zzz", "none", ["ops.md"], None, ["x"], "b", "hard")], QUESTIONS)
    rows = evaluate(docs, asked).collect()
    assert len(rows) == 96
    for r in rows:
        if r.question_id == "q2":
            assert (r.chunks_retrieved, r.context_tokens, r.context_precision, r.fact_recall, r.missing_facts) == (0, 0, 0, 0, ["x"])
        else:
            assert r.context_recall == 1 and r.fact_recall == 1 and r.chunks_retrieved >= 1
