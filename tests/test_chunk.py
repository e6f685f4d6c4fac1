import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions.text import fact_found, lexical_cosine, quantised, sentences, words
from quillspark.operators import chunk as C

DOC = """# Handbook

## Pay

Everyone is paid on the last day. Bonuses come twice a year! Who asks? The office answers.

## Leave

There are thirty days of leave. Ask two weeks ahead. Unused days lapse in March.

## Travel

Trains come first. Flights need approval. Keep receipts. Claims close after sixty days.

## Devices

Laptops stay encrypted. Report losses at once. Do not share passwords.

## Leaving

Return all devices. A last talk is usual. Certificates follow within a month.
"""


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("a/handbook.md", DOC * 12), ("empty.md", ""), ("null.md", None), ("one.md", "  single sentence without end ")], "source_file string, text string")


def collected(frame):
    return [r.asDict() for r in frame.orderBy("source_file", "chunk_index").collect()]


@pytest.mark.parametrize("name, most", [("fixed_256", 256), ("fixed_512", 512)])
def test_windows_are_bounded(docs, name, most):
    rows = collected(C.chunk(docs, name))
    assert rows and all(0 < r["n_tokens"] <= most for r in rows) and {r["source_file"] for r in rows} == {"a/handbook.md", "one.md"}
    assert [r["chunk_index"] for r in rows if r["source_file"] == "a/handbook.md"] == list(range(sum(r["source_file"] == "a/handbook.md" for r in rows)))


@pytest.mark.parametrize("name", ["fixed_256", "fixed_512", "semantic", "paragraph"])
def test_no_words_are_lost(docs, name):
    rows = collected(C.chunk(docs, name))
    kept = {w for r in rows if r["source_file"] == "a/handbook.md" for w in r["text"].split()}
    assert set(DOC.split()) == kept and all(r["strategy"] == name for r in rows)


def test_empty_texts(docs):
    """No window or paragraph of an empty text, but one semantic chunk, as it is."""
    for name, n in (("fixed_256", 0), ("paragraph", 0), ("semantic", 1)):
        rows = [r for r in collected(C.chunk(docs, name)) if r["source_file"] in ("empty.md", "null.md")]
        assert len(rows) == 2 * n and all(r["text"] == "" for r in rows)
    assert [r["text"] for r in collected(C.chunk(docs, "semantic")) if r["source_file"] == "one.md"] == ["  single sentence without end "]


def test_unknown_chunking(docs):
    with pytest.raises(ValueError, match="unknown"):
        C.chunk(docs, "by_moon")


def test_window_count(spark):
    def slow(n, window, overlap):
        count, start = 0, 0
        while start < n:
            count += 1
            if start + window >= n:
                break
            start += window - overlap
        return count

    frame = spark.range(0, 1500).select(F.col("id").cast("int").alias("n"))
    for window, overlap in ((256, 50), (512, 100), (3, 2), (5, 0)):
        got = frame.select("n", C.window_count(F.col("n"), window, overlap).alias("c")).collect()
        assert all(r.c == slow(r.n, window, overlap) for r in got)


def slow_merge(sizes):
    out = []
    for i, n in enumerate(sizes):
        after = sizes[i + 1] if i + 1 < len(sizes) else None
        if n < 2 and out and (after is None or out[-1] <= after):
            out[-1] += n
        else:
            out.append(n)
    return out


def test_merged_sizes(spark):
    from itertools import product

    cases = [list(c) for n in range(1, 7) for c in product((1, 2, 3), repeat=n)]
    got = spark.createDataFrame([(c,) for c in cases], "g array<int>").select("g", C.merged_sizes(F.col("g")).alias("m")).collect()
    assert all(r.m == slow_merge(r.g) for r in got)
    assert slow_merge([3, 1, 2]) == [3, 1, 2] and slow_merge([1, 1]) == [2]


def test_merged_paragraphs(spark):
    def slow(parts, least):
        done, rest = [], ""
        for p in parts:
            rest = f"{rest}\n\n{p}" if rest else p
            if len(rest.split()) >= least:
                done.append(rest)
                rest = ""
        if rest and done:
            done[-1] += "\n\n" + rest
        elif rest:
            done.append(rest)
        return done

    cases = [["a b c", "d", "e f", "g"], ["a"], [], ["a b c d e"], ["a b", "c d e f", "g"], ["x"] * 11]
    got = spark.createDataFrame([(c,) for c in cases], "p array<string>").select("p", C.merged_paragraphs(F.col("p"), "\n\n", 5).alias("m")).collect()
    assert all(r.m == slow(r.p, 5) for r in got)


def test_text_functions(spark):
    text = "One. Two!  Three?\nFour . five…\x1csix seven　eight "
    r = spark.createDataFrame([(text,)], "t string").select(words(F.col("t")).alias("w"), sentences(F.col("t")).alias("s")).first()
    assert r.w == text.split() and r.s == [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]
    r = spark.sql("SELECT array('a', 'b') AS a, array('b', 'c', 'b') AS b, array() AS z, 0.5227375e0 AS x").select(lexical_cosine(F.col("a"), F.col("b")).alias("c"), lexical_cosine(F.col("a"), F.col("z").cast("array<string>")).alias("e"), quantised(F.col("x"), 6).alias("q")).first()
    assert abs(r.c - 0.5) < 1e-9 and r.e == 0 and r.q == 0.522737


@settings(max_examples=20, deadline=None)
@given(answer=st.text("abc 128%$,.", max_size=12), fact=st.text("abc 128%$,.-", max_size=5))
def test_fact_found(spark, answer, fact):
    m = re.match(r"^(-?[\d,]+\.?\d*)(%?)$", fact.strip(), re.A)
    want = fact.lower() in answer.lower() or bool(m and m[1] in answer.lower())
    assert spark.createDataFrame([(answer, fact)], "a string, f string").select(fact_found(F.col("a"), F.col("f")).alias("x")).first().x == want


def test_folded(spark):
    """Blocks of any size give the same array, and nothing that is put out is lost."""
    from quillspark.functions.text import folded

    for block in (1, 2, 128):
        step = lambda at, x: (at + x, F.when(x > 0, at + x))
        for items in ([], [1], [1, 0, 2, 0, 0, 3], list(range(300))):
            frame = spark.createDataFrame([(items,)], "a array<int>")
            got = frame.select(folded(F.col("a"), F.lit(0), step, "int", lambda last, out: F.struct(last, out), block).alias("r")).first().r
            sums = [sum(items[: k + 1]) for k in range(len(items))]
            assert got[0] == sum(items) and got[1] == [s for s, x in zip(sums, items) if x > 0]


@pytest.mark.parametrize("name", ["semantic", "paragraph"])
def test_time_follows_the_length(spark, name):
    """Twice the sentences or lines take about twice the time; folds that copied their array took four times."""
    import time

    def took(n):
        unit = " ".join(f"word{k} and so." for k in range(4)) if name == "semantic" else "\n".join(["w " * 50] * 2)
        text = (" " if name == "semantic" else "\n").join([unit] * n)
        rows = C.chunk(spark.createDataFrame([("long", text)], "source_file string, text string"), name, "\n", 0.9).agg(F.count("*"), F.sum(F.length("text")))
        began = time.time()
        rows.collect()
        return time.time() - began

    took(500)
    short, long = took(5_000), took(20_000)
    assert long < 8 * max(short, 0.5), (short, long)
