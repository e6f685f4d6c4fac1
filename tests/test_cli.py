import pytest

pytest.importorskip("yaml")

from quillspark import cli

QUESTIONS = """
- {id: a1, question: what was revenue in the third quarter, gold_answer: Revenue was 42 million, gold_source_ids: [money.md], key_facts: ['42'], category: a, difficulty: easy}
- {id: a2, question: how many days of paid leave, gold_answer: thirty days, gold_source_ids: [people.md], distractors: [money.md], category: b, difficulty: easy}
"""


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus/money.md").write_text("Revenue in the third quarter was 42 million. Margins rose.")
    (tmp_path / "corpus/people.md").write_text("Staff get thirty days of paid leave. Ask early.")
    (tmp_path / "q.yaml").write_text(QUESTIONS)
    common = ["--corpus", str(tmp_path / "corpus"), "--questions", str(tmp_path / "q.yaml"), "--out", str(tmp_path / "out")]
    names = "fixed_256__bm25__k3,paragraph__hybrid__k5,fixed_256__bm25__k3"
    cli.main(["run", *common, "--configs", names, "--ids", "a1,unknown"])
    # a configuration named twice has its rows twice, in the list's order
    assert [r.config_name for r in spark.read.json(str(tmp_path / "out/results")).collect()] == names.split(",")
    assert any((tmp_path / "out/indexes").iterdir())
    cli.main(["report", "--out", str(tmp_path / "out")])
    assert "fixed_256__bm25__k3" in (tmp_path / "out/report.md").read_text()
    cli.main(["single", *common, "--configs", "semantic__hybrid_rerank__k3", "--ids", "a2"])
    assert "thirty days" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["single", *common, "--configs", "semantic__bm25__k3", "--ids", "none"])
    cli.main(["single", *common, "--configs", "fixed_256__vector__k3", "--ids", "a2", "--embedder", "tests.fakes:Letters", "--reranker", "tests.fakes:Longest", "--tokenizer", "tests.fakes:Characters"])
    assert "thirty days" in capsys.readouterr().out and any((tmp_path / "out/models/vectors").iterdir())
    cli.main(["quick", *common, "--n", "3"])
    assert spark.read.json(str(tmp_path / "out/results")).count() == 3
    cli.main(["clean", "--out", str(tmp_path / "out")])
    assert not (tmp_path / "out/results").exists()
