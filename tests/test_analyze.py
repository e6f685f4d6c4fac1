import sys
import types

import numpy as np
import pytest

from quillspark.operators import analyze as A
from quillspark.schemas import RESULTS
from quillspark.sources import files
from quillspark.sources.report import report_text, write_charts
from quillspark.streaming.results import result_stream, running_summary


def row(name, qid, sim, facts=1.0, precision=1.0, recall=1.0, latency=100.0, tokens=100, category="a"):
    return (name, qid, "text", category, "easy", 3, latency / 2, latency / 2, latency, tokens, precision, recall, 0.0, sim, facts, [], "answer", "gold")


@pytest.fixture
def results(spark):
    rows = []
    for k in range(12):
        name = f"{('fixed_256', 'semantic')[k % 2]}__{('vector', 'hybrid', 'hybrid_rerank')[k % 3]}__k{(3, 5)[k // 6]}"
        rows += [row(name, f"q{j}", 0.05 * k + 0.1 * j, latency=50.0 * (12 - k) if k % 3 else 40.0 * k + 1, tokens=100 * k, category="ab"[j % 2]) for j in range(3)]
    return spark.createDataFrame(rows, RESULTS)


def test_failure_modes_in_order(spark):
    cases = [(0.9, 0.9, 0.0, 0.0, "correct"), (0.9, 0.5, 0.2, 1.0, "wrong_source"), (0.9, 0.5, 0.5, 0.4, "insufficient"), (0.6, 0.0, 1.0, 1.0, "partial"), (0.4, 0.9, 1.0, 1.0, "wrong_source"), (0.8, 0.8, 0, 0, "correct")]
    frame = spark.createDataFrame([row(str(i), "q", s, f, float(p), float(r)) for i, (s, f, p, r, _) in enumerate(cases)], RESULTS)
    assert {r.config_name: r.m for r in frame.select("config_name", A.failure_mode().alias("m")).collect()} == {str(i): c[-1] for i, c in enumerate(cases)}


def test_summary_and_orders(results):
    s = A.summary(results).toPandas().set_index("config_name")
    assert s["avg_gold_similarity"].between(0, 1).all() and list(s.columns) == [f"avg_{m}" for m in A.MEASURES]
    best = A.best_and_worst(A.summary(results)).first()
    assert (best.best_config, best.worst_config) == (s["avg_gold_similarity"].idxmax(), s["avg_gold_similarity"].idxmin())
    ends = A.top_and_bottom(A.summary(results)).collect()
    assert len([r for r in ends if r.end == "top"]) == min(10, len(s)) and len([r for r in ends if r.end == "bottom"]) == min(5, len(s))


def test_pareto(results):
    s = A.summary(results).toPandas().sort_values(["avg_total_latency_ms", "config_name"])
    want, top = set(), -1.0
    for r in s.itertuples():
        if round(r.avg_gold_similarity, 9) > top:
            top = round(r.avg_gold_similarity, 9)
            want.add(r.config_name)
    assert {r.config_name for r in A.pareto_frontier(A.summary(results)).collect()} == want


def test_trend(results):
    s = A.summary(results).toPandas()
    fit = A.trend(A.summary(results)).first()
    t = (s["avg_context_tokens"] - fit.centre) / fit.scale
    assert np.allclose(np.polyfit(t, s["avg_gold_similarity"], 2)[::-1], [fit.c0, fit.c1, fit.c2])
    assert A.trend_line(A.trend(A.summary(results)), 0.0, 100.0).count() == 100
    assert A.trend(A.summary(results).limit(2)).count() == 0


def test_grids(results):
    cells = A.grid(results, "search", ["a", "b", "other"]).collect()
    assert len(cells) == 9 and all(r.similarity == 0 for r in cells if r.question_category == "other")
    assert A.all_grids(results).count() == 2 * (2 + 3 + 2)


def test_plateau_gain_and_overall(spark, results):
    assert A.plateau(A.summary(results)).count() == 1 and A.plateau(A.summary(results).limit(5)).count() == 0
    gain = A.rerank_gain(spark.createDataFrame([row("a__hybrid__k3", "q", 0.5, latency=10.0), row("a__hybrid_rerank__k3", "q", 0.6, latency=30.0)], RESULTS)).first()
    assert (round(gain.gain_pct, 6), gain.latency_ms) == (20.0, 10.0)
    none = A.rerank_gain(results.limit(0)).first()
    assert (none.gain_pct, none.latency_ms) == (0, 0) and tuple(A.overall(results.limit(0)).first()) == (0, 0, 0)
    assert abs(sum(r.pct for r in A.failure_shares(results).where("config_name like '%k3'").collect()) - 100 * results.where("config_name like '%k3'").select("config_name").distinct().count()) < 1e-9


def test_json_round_trip_and_strictness(spark, results, tmp_path):
    files.write_results(results, f"{tmp_path}/r")
    assert sorted(map(str, files.read_results(spark, f"{tmp_path}/r").collect())) == sorted(map(str, results.collect()))
    for name, line in (("extra", '{"config_name": "x", "strange": 1}'), ("short", '{"config_name": "x"}'), ("broken", "{"), ("wrong", "[1]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(line + "\n\n")
        with pytest.raises(Exception, match="keys|JSON"):
            files.read_results(spark, f"{tmp_path}/{name}").collect()


def test_files(spark, results, tmp_path):
    corpus = tmp_path / "corpus" / "a b"
    corpus.mkdir(parents=True)
    (corpus / "x+1.md").write_bytes("line\r\nüber".encode())
    (corpus / "x.txt").write_text("no")
    got = files.read_corpus(spark, str(tmp_path / "corpus")).collect()
    assert [tuple(r) for r in got] == [("a b/x+1.md", "line\nüber")]
    assert not files.write_summary(A.summary(results.limit(0)), f"{tmp_path}/none") and not (tmp_path / "none").exists()
    assert files.write_summary(A.summary(results), f"{tmp_path}/summary")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/summary").toPandas()
    assert back["avg_gold_similarity"].is_monotonic_decreasing and len(back) == A.summary(results).count()
    docs = files.read_corpus(spark, str(tmp_path / "corpus"))
    built = []
    build = lambda: built.append(1) or spark.range(3).selectExpr("'s' AS strategy", "id")
    for _ in range(2):
        assert files.stored(spark, f"{tmp_path}/store", docs, "v1", build).count() == 3
    files.stored(spark, f"{tmp_path}/store", docs, "v2", build)
    assert len(built) == 2
    (tmp_path / "out" / "results").mkdir(parents=True)
    assert files.clean(str(tmp_path / "out")) == [str(tmp_path / "out" / "results")]
    pytest.importorskip("yaml")
    (tmp_path / "q.yaml").write_text("questions:\n- {id: a, question: q, gold_answer: g, gold_source_ids: [s], category: c, difficulty: easy}\n")
    asked = files.read_questions(spark, f"{tmp_path}/q.yaml").first()
    assert asked.key_facts == [] and asked.distractors is None


def test_report(results, tmp_path):
    text = report_text(results)
    assert "configurations" in text and "Best:" in text and report_text(results.limit(0)).endswith("No results.\n")
    assert isinstance(write_charts(results, f"{tmp_path}/charts"), list)


class _Axes:
    """Takes down what is drawn."""

    def __init__(self, drawn):
        self.drawn = drawn

    def __getattr__(self, name):
        return lambda *args, **named: self.drawn.append((name, args, named))


def test_charts_draw_their_data(results, tmp_path, monkeypatch):
    charts = {}

    def subplots(**_):
        drawn = []
        save = lambda path, **_: charts.update({path.rsplit("/", 1)[1]: drawn})
        return types.SimpleNamespace(savefig=save), _Axes(drawn)

    pyplot = types.SimpleNamespace(subplots=subplots, close=lambda fig: None)
    monkeypatch.setitem(sys.modules, "matplotlib", types.SimpleNamespace(use=lambda kind: None, pyplot=pyplot))
    monkeypatch.setitem(sys.modules, "matplotlib.pyplot", pyplot)
    assert len(write_charts(results, str(tmp_path))) == len(charts) == 6
    summaries = A.summary(results)
    calls = lambda chart, what: [(args, named) for name, args, named in charts[f"{chart}.png"] if name == what]
    frontier = sorted((r.cost, r.config_name) for r in A.pareto_frontier(summaries).collect())
    assert [args[0] for args, _ in calls("quality_by_latency", "annotate")] == [name for _, name in frontier]
    assert np.allclose(calls("quality_by_latency", "plot")[0][0][0], [c for c, _ in frontier])
    assert sum(len(args[0]) for args, _ in calls("quality_by_latency", "scatter")) == summaries.count()
    assert [len(args[0]) for args, _ in calls("quality_by_tokens", "plot")] == [100] * A.trend(summaries).count()
    cells = A.grid(results, "search").toPandas()
    assert [named["label"] for _, named in calls("search_by_category", "bar")] == sorted(cells["search"].unique())
    assert sorted(h for args, _ in calls("search_by_category", "bar") for h in args[1]) == sorted(cells["similarity"])
    stacks = calls("failure_modes", "barh")
    assert [named["label"] for _, named in stacks] == list(A.MODES)
    assert np.allclose(np.add(stacks[0][0][1], stacks[0][1]["left"]), stacks[1][1]["left"])
    assert stacks[0][0][0][0] == A.top_and_bottom(summaries).where("`end` = 'top' and place = 1").first().config_name
    assert write_charts(results.limit(0), str(tmp_path)) == []


def test_stream(spark, results, tmp_path):
    files.write_results(results, f"{tmp_path}/in")
    running_summary(result_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().set_index("config_name")["avg_gold_similarity"]
    want = A.summary(results).toPandas().set_index("config_name")["avg_gold_similarity"]
    assert np.allclose(got.sort_index(), want.sort_index())
