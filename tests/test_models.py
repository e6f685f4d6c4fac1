"""Tokens of a model, stored vectors and answers, and runs that go on."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.config import LLMConfig, RetrievalConfig
from quillspark.operators import chunk as C
from quillspark.operators.evaluate import evaluate, run, run_name
from quillspark.providers import FileTokenizer, Models, RankTokenizer, chat_answers, embed
from quillspark.schemas import QUESTIONS
from tests.fakes import Characters, Letters, Slow, busy_server

TOKENIZERS = "/opt/tokenizers"
TEXTS = ["", "plain words in a row, and then some more of them.", "Grüße an 日本 und \U0001f600\U0001f469‍\U0001f4bb, naïve café", "a\n\n\nb  c\td", "x" * 700, "wort " * 900]


def tokenizers():
    if not os.path.isdir(TOKENIZERS):
        return []
    import public_tokenizers as known

    return [FileTokenizer(str(known.path("word_bpe_49k.json"))), RankTokenizer(str(known.path("byte_bpe_50k.tiktoken")), known.PATTERN)]


def slow_windows(n, window, overlap):
    out, start = [], 0
    while start < n:
        end = min(start + window, n)
        out.append((start, end))
        if end == n:
            break
        start = end - overlap
    return out


@pytest.mark.parametrize("k", range(2))
def test_token_windows(spark, k):
    import tiktoken
    import tokenizers as hf

    pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers()[k]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate([*TEXTS, None])], "source_file string, text string")
    got = {}
    for r in C.chunk(docs, "fixed_256", tokenizer=tokenizer).collect():
        got.setdefault(r.source_file, {})[r.chunk_index] = (r.text, r.n_tokens)
    for i, text in enumerate(TEXTS):
        if k == 0:
            offsets = hf.Tokenizer.from_file(tokenizer.path).encode(text, add_special_tokens=False).offsets
            want = [(text[offsets[a - 1][1] if a else 0 : offsets[b - 1][1]], b - a) for a, b in slow_windows(len(offsets), 256, 50)]
        else:
            from tiktoken.load import load_tiktoken_bpe

            made = tiktoken.Encoding("x", pat_str=tokenizer.pattern, mergeable_ranks=load_tiktoken_bpe(tokenizer.path), special_tokens={})
            ids = made.encode_ordinary(text)
            # what lies between two borders, of which one within a character counts as before it
            before = lambda n: made.decode_bytes(ids[:n]).decode(errors="ignore")
            want = [(before(b)[len(before(a)) :], b - a) for a, b in slow_windows(len(ids), 256, 50)]
        assert [got.get(f"d{i}", {}).get(j) for j in range(len(want))] == want and len(got.get(f"d{i}", {})) == len(want)
    assert "d6" not in got


def test_paragraphs_and_counts_by_tokens(spark):
    docs = spark.createDataFrame([("a", "x" * 30 + "\n\n" + "y" * 30 + "\n\nz"), ("b", None)], "source_file string, text string")
    got = [(r.text, r.n_tokens) for r in C.chunk(docs, "paragraph", tokenizer=Characters()).orderBy("chunk_index").collect()]
    assert got == [("x" * 30 + "\n\n" + "y" * 30 + "\n\nz", 65)]
    got = C.chunk(docs, "semantic", tokenizer=Characters()).orderBy("source_file").collect()
    assert [(r.source_file, r.n_tokens) for r in got] == [("a", 65), ("b", 0)]
    counts = C.chunk_all(docs, tokenizer=Characters()).groupBy("strategy").agg(F.max("n_tokens").alias("n")).collect()
    assert {r.strategy for r in counts} == set(C.CHUNKINGS)


def test_each_text_is_embedded_once(spark, tmp_path):
    seen, store = tmp_path / "seen", str(tmp_path / "store")
    seen.mkdir()
    count = lambda kind: len([p for p in os.listdir(seen) if p.startswith(kind)])
    model = Letters(str(seen))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "aa", None, "", "aa"])], "id int, text string").repartition(6)
    first = {r.id: list(r.vec) for r in embed(rows, model, store=store).collect()}
    assert count("text") == 3  # aa, bb and no text
    assert {r.id: list(r.vec) for r in embed(rows, model, store=store).collect()} == first and count("text") == 3
    more = rows.unionByName(spark.createDataFrame([(9, "cc")], "id int, text string"))
    assert embed(more, model, name="other", store=store).where("other is null").count() == 0 and count("text") == 4
    # one load a worker, however many tasks
    loads = {p.split("-")[1] for p in os.listdir(seen) if p.startswith("load")}
    for _ in range(3):
        embed(spark.range(40).selectExpr("cast(id as string) AS text").repartition(20), model).write.format("noop").mode("overwrite").save()
    by_worker = [p.split("-")[1] for p in os.listdir(seen) if p.startswith("load")]
    assert loads and len(by_worker) == len(set(by_worker)) < 20


def test_calls_in_flight_and_stored_answers(spark, tmp_path):
    server, state = busy_server(0.15, failures=2)
    llm = LLMConfig(f"http://127.0.0.1:{server.server_port}/v1", "m", "k")
    rows = spark.createDataFrame([(k, f"q{k % 12}", "c") for k in range(24)], "id int, question string, context string").coalesce(1)
    ask = lambda r, store=str(tmp_path / "s"): {x.id: x.answer for x in chat_answers(r, llm, "{question}|{context}", store=store).collect()}
    assert ask(rows) == {k: f"Q{k % 12}|C" for k in range(24)}
    assert 1 < state["most"] <= 8 * 4 and sorted(state["prompts"]) == sorted(f"q{k}|c" for k in range(12)) and state["calls"] == 14
    assert len(ask(rows)) == 24 and state["calls"] == 14  # all from the table
    ask(rows.unionByName(spark.createDataFrame([(99, "new", None)], rows.schema)))
    assert state["calls"] == 15
    assert ask(rows.where("id < 3"), None) == {0: "Q0|C", 1: "Q1|C", 2: "Q2|C"} and state["calls"] == 18
    server.shutdown()


def test_a_run_goes_on(spark, tmp_path):
    """A run that breaks off half-way ends with the table of a whole run, and nothing that it had is asked again."""
    server, state = busy_server()
    docs = spark.createDataFrame([("a.md", "Revenue was 42 million in the third quarter."), ("b.md", "Staff get thirty days of leave.")], "source_file string, text string")
    asked = spark.createDataFrame([("q1", "revenue", "42 million", ["a.md"], ["b.md"], ["42"], "a", "easy"), ("q2", "leave bad", "thirty", ["b.md"], None, ["thirty"], "b", "easy")], QUESTIONS)
    llm = LLMConfig(f"http://127.0.0.1:{server.server_port}/v1", "m", "k")
    models = Models(llm=llm, prompt="{question}|{context}")
    configs = [RetrievalConfig("fixed_256", s, 3) for s in ("bm25", "vector")]
    path = f"{tmp_path}/{run_name(docs, models)}"
    run(docs, asked.where("question_id = 'q1'"), configs[:1], path, models)
    state["broken"] = True
    with pytest.raises(Exception, match="400"):
        run(docs, asked, configs, path, models)
    state["broken"] = False
    got = run(docs, asked, configs, path, models)
    prompts = list(state["prompts"])
    quiet = [c for c in got.columns if "latency" not in c]
    want = evaluate(docs, asked, ("fixed_256",), ("bm25", "vector"), (3,), models=models)
    rows = lambda df: sorted(map(str, df.select(quiet).collect()))
    assert rows(got) == rows(want) and got.count() == 4
    assert sum(p.startswith("revenue|") for p in prompts) == 2 and sum("bad" in p for p in prompts) == 2  # once each for each configuration
    before = state["calls"]
    assert run(docs, asked, configs, path, models).count() == 4 and state["calls"] == before
    changed = asked.withColumn("gold_answer", F.when(F.col("question_id") == "q1", "43").otherwise(F.col("gold_answer")))
    assert {r.gold_answer for r in run(docs, changed, configs, path, models).collect()} == {"43", "thirty"}
    server.shutdown()


def test_measured_times_and_progress(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "Revenue was 42 million in the third quarter."), ("b.md", "Staff get thirty days of leave.")], "source_file string, text string")
    asked = spark.createDataFrame([("q1", "revenue", "42 million", ["a.md"], ["b.md"], ["42"], "a", "easy"), ("q2", "leave", "thirty", ["b.md"], None, ["thirty"], "b", "easy")], QUESTIONS)
    configs = [RetrievalConfig("fixed_256", s, k) for s, k in (("bm25", 3), ("hybrid_rerank", 3), ("hybrid_rerank", 5))]
    models, said = Models(reranker=Slow()), []
    got = run(docs, asked, configs, str(tmp_path / "r"), models, progress=said.append)
    times = {c.name: {r.retrieval_latency_ms for r in got.where(F.col("config_name") == c.name).collect()} for c in configs}
    assert all(len(t) == 1 and min(t) > 0 for t in times.values())  # a question's share of its search's time
    assert times[configs[1].name] == times[configs[2].name] and min(times[configs[1].name]) >= 300  # 0.6 s for two questions
    assert all(r.total_latency_ms == r.retrieval_latency_ms + r.generation_latency_ms for r in got.collect())
    assert [(p["part"], p["parts"], p["search"], p["rows"]) for p in said] == [(1, 2, "bm25", 2), (2, 2, "hybrid_rerank", 4)] and said[1]["seconds"] > 0.6
    run(docs, asked, configs, str(tmp_path / "r"), models, progress=said.append)
    assert [p["rows"] for p in said[2:]] == [0, 0]
    quiet = [c for c in got.columns if "latency" not in c]
    rows = lambda df: sorted(map(str, df.select(quiet).collect()))
    modelled = evaluate(docs, asked, ("fixed_256",), ("bm25", "hybrid_rerank"), (3, 5), models=models, measured=False).where("config_name not like '%bm25__k5'")
    assert rows(got) == rows(modelled) and {r.retrieval_latency_ms for r in modelled.where("config_name like '%bm25%'").collect()} == {3.0}
