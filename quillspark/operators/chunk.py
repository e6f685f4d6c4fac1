"""Chunkers: documents (source_file, text) to chunks (strategy, source_file, chunk_index, text, n_tokens).

All work on one row each, by array expressions, or for a model's tokens a batch
at a time: no shuffle, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.config import CHUNKINGS, PARAGRAPH_TOKENS, SEMANTIC_THRESHOLD, WINDOWS
from quillspark.functions.text import folded, let, lexical_cosine, pieces, sentences, terms, words
from quillspark.operators.score import vector_similarity
from quillspark.providers import embed_lists, shared


def window_count(n: Column, window: int, overlap: int) -> Column:
    """Windows over n tokens; the last is the first one that reaches the end."""
    steps = F.ceil((n - overlap) / F.lit(float(window - overlap))).cast("int")
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), steps))


def _explode(docs: DataFrame, strategy: str, texts: Column) -> DataFrame:
    return docs.select(F.lit(strategy).alias("strategy"), "source_file", F.posexplode(texts).alias("chunk_index", "text")).withColumn("n_tokens", F.size(words(F.col("text"))))


def chunk_fixed(docs: DataFrame, window: int, overlap: int, strategy: str) -> DataFrame:
    """Windows of `window` tokens that share `overlap` with the one before; no tokens, no chunk."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be smaller than the window")

    def cut(tokens: Column) -> Column:
        n = window_count(F.size(tokens), window, overlap)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i * (window - overlap) + 1, window), " "))

    return _explode(docs, strategy, let(words(F.col("text")), cut))


def joined_groups(parts: Column, sizes: Column, delimiter: str) -> Column:
    """Parts joined in groups of the given sizes, in order."""

    def texts(p: Column) -> Column:
        ends = folded(sizes, F.lit(0), lambda at, n: (at + n, F.struct(at.alias("at"), n.alias("n"))), "struct<at:int,n:int>")
        return F.transform(ends, lambda g: F.array_join(F.slice(p, g["at"] + 1, g["n"]), delimiter))

    return let(parts, texts)


def merged_paragraphs(parts: Column, delimiter: str, least: int) -> Column:
    """Paragraphs, none empty, joined forward until they have `least` tokens; what is left over goes to the last one."""

    def step(acc: Column, words_of_part: Column) -> tuple[Column, Column]:
        n, full = acc["n"] + words_of_part, acc["n"] + words_of_part >= least
        return F.struct(F.when(full, 0).otherwise(n).alias("n"), F.when(full, 0).otherwise(acc["parts"] + 1).alias("parts")), F.when(full, acc["parts"] + 1)

    def close(acc: Column, done: Column) -> Column:
        rest = acc["parts"]
        tail = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.element_at(done, -1) + rest))
        return F.when(rest == 0, done).when(F.size(done) == 0, F.array(rest)).otherwise(tail)

    def joined(p: Column) -> Column:
        counts = F.transform(p, lambda x: F.size(words(x)))
        return joined_groups(p, folded(counts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("parts")), step, "int", close), delimiter)

    return let(parts, joined)


def chunk_paragraph(docs: DataFrame, delimiter: str = "\n\n", least: int = PARAGRAPH_TOKENS) -> DataFrame:
    """Paragraphs, short ones merged. The delimiter has to be white space, so that token counts add up."""
    return _explode(docs, "paragraph", merged_paragraphs(pieces(F.col("text"), delimiter), delimiter, least))


def group_sizes(similar: Column) -> Column:
    """Sizes of runs of sentences; `similar` says for each neighbouring pair whether the run goes on."""
    step = lambda n, goes_on: (F.when(goes_on, n + 1).otherwise(1), F.when(~goes_on, n))
    return folded(similar, F.lit(1), step, "int", lambda n, out: F.concat(out, F.array(n)))


def merged_sizes(sizes: Column) -> Column:
    """Single sentences join the group before, unless that one is longer than the raw group that follows.

    The first group stays as it is, and a last single sentence always joins, so
    no repair of the tail is needed.
    """

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        joins = (x["size"] < 2) & (last > 0) & (x["after"].isNull() | (last <= x["after"]))
        return F.when(joins, last + x["size"]).otherwise(x["size"]), F.when(~joins & (last > 0), last)

    pairs = let(sizes, lambda s: F.transform(s, lambda n, i: F.struct(n.alias("size"), F.get(s, i + 1).alias("after"))))
    return folded(pairs, F.lit(0), step, "int", lambda last, out: F.concat(out, F.array(last)))


def chunk_semantic(docs: DataFrame, threshold: float = SEMANTIC_THRESHOLD, embedder=None) -> DataFrame:
    """Neighbouring sentences that are alike stay together; texts of up to two sentences stay whole, as they are.

    Likeness is the cosine of the sentences' vectors, or without an embedder of
    their word sets.
    """
    text = F.coalesce("text", F.lit(""))
    if embedder is not None:
        parts = docs.select("source_file", text.alias("text"), sentences(text).alias("parts"))
        docs = embed_lists(parts, embedder, "parts", "vectors")

    def likeness(t: Column) -> Column:
        alike = lexical_cosine if embedder is None else vector_similarity
        return F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: alike(F.get(t, i - 1), F.get(t, i)) >= threshold)

    def joined(s: Column) -> Column:
        sizes = let(group_sizes(let(F.transform(s, terms) if embedder is None else F.col("vectors"), likeness)), merged_sizes)
        return joined_groups(s, sizes, " ")

    return _explode(docs, "semantic", let(sentences(text), lambda s: F.when(F.size(s) > 2, joined(s)).otherwise(F.array(text))))


def token_windows(text: str, ends, window: int, overlap: int) -> list[tuple[str, int]]:
    """(text, tokens) of the windows over a text whose tokens end at `ends`."""
    out, start = [], 0
    while start < len(ends):
        stop = min(start + window, len(ends))
        out.append((text[ends[start - 1] if start else 0 : ends[stop - 1]], stop - start))
        if stop == len(ends):
            break
        start = stop - overlap
    return out


def token_paragraphs(parts: list[str], count: Callable[[str], int], delimiter: str, least: int) -> list[tuple[str, int]]:
    """merged_paragraphs with tokens counted over what is joined."""
    done: list[str] = []
    rest = ""
    for p in parts:
        rest = f"{rest}{delimiter}{p}" if rest else p
        if count(rest) >= least:
            done.append(rest)
            rest = ""
    if rest:
        done = [*done[:-1], f"{done[-1]}{delimiter}{rest}"] if done else [rest]
    return [(t, count(t)) for t in done]


def chunk_by_tokens(docs: DataFrame, strategy: str, tokenizer, delimiter: str = "\n\n", threshold: float = SEMANTIC_THRESHOLD, embedder=None) -> DataFrame:
    """Chunks by a model's tokens, cut and counted where the document is, a batch at a time.

    A window's text is the document's from its first token's beginning to its
    last one's end; a window border within a character lies before it. Sentence groups do not
    depend on tokens, but are counted by them.
    """
    model = shared(docs.sparkSession, tokenizer)
    kind = "strategy string, source_file string, chunk_index int, text string, n_tokens int"

    def rows(batch: pd.DataFrame, made: list[list[tuple[str, int]]]) -> pd.DataFrame:
        flat = [(strategy, s, k, t, n) for s, chunks in zip(batch["source_file"], made, strict=True) for k, (t, n) in enumerate(chunks)]
        return pd.DataFrame(flat, columns=["strategy", "source_file", "chunk_index", "text", "n_tokens"])

    if strategy in WINDOWS:
        window, overlap = WINDOWS[strategy]

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ends = model().ends(batch["text"])
                yield rows(batch, [token_windows(t, e, window, overlap) for t, e in zip(batch["text"], ends, strict=True)])

        return docs.select("source_file", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, kind)
    if strategy == "paragraph":

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count = lambda t: len(model().ends(pd.Series([t])).iloc[0])
            for batch in batches:
                yield rows(batch, [token_paragraphs(list(p), count, delimiter, PARAGRAPH_TOKENS) for p in batch["parts"]])

        return docs.select("source_file", pieces(F.col("text"), delimiter).alias("parts")).mapInPandas(merge, kind)

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return model().ends(texts).map(len)

    return chunk(docs, strategy, delimiter, threshold, embedder).withColumn("n_tokens", counted("text"))


def chunk(docs: DataFrame, strategy: str, delimiter: str = "\n\n", threshold: float = SEMANTIC_THRESHOLD, embedder=None, tokenizer=None) -> DataFrame:
    """Chunks by one strategy. Tokens are words, or with a tokenizer its tokens."""
    if tokenizer is not None and strategy in CHUNKINGS:
        return chunk_by_tokens(docs, strategy, tokenizer, delimiter, threshold, embedder)
    if strategy in WINDOWS:
        return chunk_fixed(docs, *WINDOWS[strategy], strategy)
    if strategy == "paragraph":
        return chunk_paragraph(docs, delimiter)
    if strategy == "semantic":
        return chunk_semantic(docs, threshold, embedder)
    raise ValueError(f"unknown chunking {strategy!r}; there are {CHUNKINGS}")


def chunk_all(docs: DataFrame, strategies=CHUNKINGS, delimiter: str = "\n\n", threshold: float = SEMANTIC_THRESHOLD, embedder=None, tokenizer=None) -> DataFrame:
    return reduce(DataFrame.unionByName, (chunk(docs, s, delimiter, threshold, embedder, tokenizer) for s in strategies))
