import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspark.llm import quality


def slow(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    counts = Counter(windows)
    covered = {p for k, x in enumerate(windows) if counts[x] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs):
    rows = [(1, None), (2, ""), (3, "a b\n\n \na b\na  b"), (4, "x y z " * 9), (5, "é 日本 #*$%&|<> \x1c"), (5, "again"), (6, " ".join(str(k) for k in range(30))), (7, "w" * 100_000), (None, "no id")]
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_statistics(docs(rows)).collect())
    assert got == sorted((str(i), *slow(t)) for i, t in rows)
    assert quality.text_statistics(docs([])).count() == 0


def sample(n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({c: rng.integers(50, 300, n) for c in quality.COUNTS})
    rows["n_symbols"] = (rows["n_words"] * rng.uniform(0, 0.1, n)).astype(int)
    rows["n_repeat_words"] = 0
    bad = np.arange(n) % 5 == 0
    rows.loc[bad, "n_symbols"] = rows.loc[bad, "n_words"]
    return rows, bad


def test_learned_list(spark):
    rows, bad = sample()
    rules = quality.learn_list(rows, bad)
    assert rules and all(c.feature in quality.FEATURES for r in rules for c in r)
    fresh, truth = sample(seed=2)
    fresh["doc_id"] = range(len(fresh))
    kept = spark.createDataFrame(fresh).select("doc_id", quality.list_verdict(rules).alias("kept")).toPandas().sort_values("doc_id")["kept"].to_numpy()
    assert (kept == ~truth).all()
    assert quality.learn_list(rows, np.zeros(len(rows), bool)) == [] and quality.learn_list(rows.head(0), np.empty(0, bool)) == []


def test_judge_and_stage(spark, docs, plain):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, " ".join(f"word{k}x{j}" for j in range(60))) for k in range(40)] + [(100 + k, " ".join(f"w{k}x{j}###" for j in range(60))) for k in range(40)] + [(200, "short"), (201, "same words " * 30), (202, None), (None, good)]
    labels = spark.createDataFrame([(i, 0 if i >= 100 else 1, 0) for i, _ in rows[:80]] + [(None, 1, 0), (5, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs(rows), labels).collect()}
    assert all(got[k] == (False, True) for k in range(40)) and all(got[100 + k] == (False, False) for k in range(40))
    assert got[200] == got[201] == got[202] == (True, False) and got[None] == (False, True)
    kept = quality.quality_rules(plain(rows), labels)
    assert kept.columns == plain([]).columns and {r.doc_id for r in kept.collect()} == {*range(40), None}
    assert quality.judge(docs(rows), labels.limit(0)).where("kept").count() == 81
    assert quality.judge(docs([]), labels).count() == 0


def test_each_row_is_judged_by_itself(spark, docs):
    """Rows that share a doc_id or have none, very long texts, and columns with the names of counts."""
    good, long = " ".join(f"word{k}" for k in range(60)), " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, good), (1, "too short"), (1, good), (None, "too short"), (None, good), (2, long), (3, "same " * 5_000), (4, None)]
    frame = docs(rows).withColumnRenamed("h", "n_words").withColumnRenamed("key", "_1")
    out = quality.quality_rules(frame, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.dtypes == frame.dtypes
    assert sorted((r.doc_id or 0, len(r.text), r.n_words, r._1) for r in out.collect()) == sorted((i or 0, len(t), 2, 1) for i, t in rows if t in (good, long))
