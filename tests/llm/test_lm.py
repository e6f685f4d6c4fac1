import math
import pathlib
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lm

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def tokens(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [" "]


def base(rows):
    held = [zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, z = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    return sorted((str(i), h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10(c[w] + 0.5) - z for w in tokens(t)), 6)) for (i, t), h in zip(rows, held, strict=True))


def found(frame):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in frame.collect())


def corpus(n=120):
    rng = np.random.default_rng(4)
    follow = {k: rng.choice(30, 3) for k in range(30)}
    rows = []
    for i in range(n):
        w, out = 0, []
        for _ in range(rng.integers(20, 80)):
            w = int(rng.choice(follow[w])) if rng.random() < 0.9 else int(rng.integers(30))
            out.append(f"Word{w}" if rng.random() < 0.95 else f"rare{rng.integers(500)}")
        rows.append((i, " ".join(out)))
    return rows


def test_base_and_edges(docs, monkeypatch):
    monkeypatch.setattr(lm, "LONGEST", 8)
    rows = [*corpus(40), (50, None), (51, ""), (None, "no id"), (52, "twice twice"), (52, "twice twice"), (53, "É é " + "long" * 5_000)]
    assert found(lm.score(docs(rows))) == base(rows)
    assert lm.score(docs([])).count() == 0
    only_held_out = [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    assert found(lm.score(docs(only_held_out))) == base(only_held_out)


def test_model_beats_the_base(docs, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 256)
    rows = corpus(300)
    got = [r for r in lm.score(docs(rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


DATA = pathlib.Path("/root/testdata/sf0.1/documents.parquet")


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_training_beats_its_start_and_the_base(spark, monkeypatch):
    """Log10 a token on training texts and on held-out texts without an unknown word, with the committed settings."""
    docs = spark.read.parquet(str(DATA)).select("doc_id", "text").repartition(8)

    def rates():
        cases = F.when(~F.col("held_out"), "train").when(F.col("n_known") == F.col("n_tokens"), "known").otherwise("new words")
        of = lm.score(docs).groupBy(cases.alias("case")).agg((F.sum("score") / F.sum("n_tokens")).alias("model"), (F.sum("base_score") / F.sum("n_tokens")).alias("base"))
        return {r.case: (r.model, r.base) for r in of.collect()}

    trained = rates()
    monkeypatch.setattr(lm, "RATES", (0.0,))
    start = rates()
    print(trained, start)
    for case in ("train", "known", "new words"):
        assert trained[case][0] > start[case][0] + 0.1 and trained[case][0] > trained[case][1] + 0.1, (case, trained, start)


def slow_scores(rows, params, alone, listed):
    """Every token's probability by a softmax over all classes, written out."""
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w.encode() for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    ends = c.pop(b" ")
    lone = {w: k + 1 for k, w in enumerate(listed[:alone])}
    cls = lambda w: 0 if w == b" " else lone.get(w) or 1 + alone + zlib.crc32(w[-3:]) % lm.SPELLINGS
    members = {}
    for w, n in c.items():
        members.setdefault(cls(w), []).append(n)
    size = 1 + alone + lm.SPELLINGS
    A, B, Q = params[: 3 * size * lm.DIMS].reshape(3, size, lm.DIMS)
    bias = params[3 * size * lm.DIMS :]
    out = []
    for _, t in rows:
        one = two = 0
        total = 0.0
        for w in (x.encode() for x in tokens(t)):
            k = cls(w)
            s = (A[one] + B[two]) @ Q.T + bias
            p = math.exp(s[k]) / sum(math.exp(x) for x in s)
            if k > alone:
                m = members.get(k, [])
                new = min(max((sum(n == 1 for n in m) + 0.5) / (sum(m) + 1), 1e-9), 0.5)
                p *= (1 - new) * (c[w] - lm.DISCOUNT) / (sum(m) - lm.DISCOUNT * len(m)) if c[w] else new
            total += math.log10(p)
            one, two = k, one
        out.append(total)
    return out, ends


def test_score_against_brute_force(docs, monkeypatch):
    for name, value in (("CLASSES", 24), ("SPELLINGS", 9), ("FREQUENT", 40), ("BATCH", 256), ("LONGEST", 20)):
        monkeypatch.setattr(lm, name, value)
    seen, train = {}, lm.train_model

    def spy(frame, lexicon, unigram):
        seen["lexicon"], seen["params"] = lexicon.value, train(frame, lexicon, unigram)[0]
        return seen["params"], train(frame, lexicon, unigram)[1]

    monkeypatch.setattr(lm, "train_model", spy)
    rows = [*corpus(80), (200, ""), (201, None), (202, "never seen words here"), (203, "twice twice é")]
    got = {r.doc_id: r.score for r in lm.score(docs(rows)).collect()}
    want, _ = slow_scores(rows, seen["params"], seen["lexicon"].alone, list(seen["lexicon"].id))
    assert len(seen["lexicon"].id) > seen["lexicon"].alone == 14
    for (i, _), x in zip(rows, want, strict=True):
        assert abs(got[i] - x) < 1e-6 * max(1, abs(x)), (i, got[i], x)


def test_hot_long_word_is_listed(docs, monkeypatch):
    """A long word in every text is in the list, so it is no key of the shuffle."""
    monkeypatch.setattr(lm, "LONGEST", 8)
    long = "L" * 5000
    rows = [(i, f"{long} word{i} {long}") for i in range(40)]
    frame = docs(rows)
    assert found(lm.score(frame)) == base(rows)
    nominees, texts, n, spelled = lm.nominated_words(frame.select("text"), 10)
    assert nominees[0] == (lm.name_of(long.lower().encode(), 8).decode(), 80) and (texts, n, spelled.sum()) == (40, 160, 120) and len(nominees) <= 10


def test_scores_are_normalised():
    classes = 9
    rng = np.random.default_rng(0)
    model = lm.LogBilinear(rng.normal(0, 1, 3 * classes * lm.DIMS + classes), classes)
    tables = model.tables()
    for a, b in ((0, 0), (3, 8)):
        p = 10 ** lm.log10_probabilities(tables, np.full(classes, a), np.full(classes, b), np.arange(classes))
        assert abs(p.sum() - 1) < 1e-5


def test_each_round_trains_on_all_texts(docs, monkeypatch):
    train = docs([(1, "a b a b c")]).select(F.lit(0).alias("text_key"), "text")
    words = lm.Lexicon(["a", "b", "c"], 3)
    lexicon, unigram = train.sparkSession.sparkContext.broadcast(words), np.full(words.classes, 1 / words.classes)
    for rates in ((0.1, 0.0), (0.0, 0.1)):
        monkeypatch.setattr(lm, "RATES", rates)
        params, counts = lm.train_model(train, lexicon, unigram)
        assert not np.allclose(params, lm.LogBilinear.start(unigram)) and counts.tolist() == [1, 2, 2, 1]
    assert lm.NOISE >= 32


def test_texts_are_cut_into_words_twice(spark, docs):
    """Once for the frequent words of training texts, once for the ids of all texts; both rounds, the rare words and the scores read the ids."""
    rows, read = corpus(60), spark.sparkContext.accumulator(0)

    def passed(t):
        read.add(1)
        return t

    texts = docs(rows).withColumn("text", F.udf(passed, "string").asNondeterministic()("text"))
    assert found(lm.score(texts)) == base(rows)
    assert 0 < read.value <= 2 * len(rows)


def test_most_frequent_words_and_ties():
    counts = Counter({b"b": 2, b"c": 3, b"a": 2, b"d": 2, b"e": 1})
    for most in range(1, 7):
        assert sorted(lm.most_frequent(counts, most)) == sorted(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most])
