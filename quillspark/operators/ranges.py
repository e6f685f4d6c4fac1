"""Search over chunks as ranges of their documents' words: nothing is written for each chunk.

Every chunker cuts a document's words into ranges, so one look at the words
serves all chunkings. Documents are read twice: once to count in how many chunks
each term is, once to score. In between only the terms' counts are a table.

A chunk's norm needs the weights of all its terms, of which tasks have the
frequent ones. The others lie between two bounds, and so does the cosine: chunks
that may be among a question's best go on, and only for these, a few for each
question, texts are cut and norms worked out in full. The result is the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import BM25_EPSILON, DEPTH, PARAGRAPH_TOKENS, SEARCHES, TOP_KS, WINDOWS
from quillspark.functions.text import quantised
from quillspark.operators.chunk import chunk
from quillspark.operators.index import KEY, Index, damped, forward_of, norms_of
from quillspark.operators.retrieve import BLOCK_SCORES, BROADCAST_ROWS, DENSE_QUESTIONS, _Asked, query_terms, ranked_pairs, retrieve
from quillspark.session import shared_folder

#: Bytes of text that are cut at once, unless one document has more.
SLICE_BYTES = 1 << 19
#: Terms whose weights are sent to all executors, at most, beside those of the questions.
FREQUENT = 1 << 16
#: What rounding and the nine digits of the order may take from a bound; rows that a task holds before it drops what others have beaten.
SLACK, HELD_ROWS = 2e-9, 50_000
_PAIRS = "strategy string, question_id string, source_file string, chunk_index int, bm25 double, coverage double, dot double, qnorm double, least double, most double, mark long"


@dataclass
class Layer:
    """Chunks of a strategy that do not overlap: document and place of each, its first word and its size; `of` has each word's chunk, or -1."""

    strategy: str
    doc: np.ndarray
    place: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    of: np.ndarray


@dataclass
class Cut:
    """Some documents' words: `terms` are the different ones, `order` the words' positions sorted by term, `term` and `before` the term of each of these and its last position before."""

    terms: pa.Array
    order: np.ndarray
    term: np.ndarray
    before: np.ndarray
    layers: list[Layer]


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets and elements, without empty elements."""
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return np.append(0, np.cumsum(full))[at], words.filter(pa.array(full))


def _ends(words: pa.Array) -> np.ndarray:
    """Whether each word, none empty, ends a sentence."""
    if not len(words):
        return np.zeros(0, bool)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset + 1 : words.offset + len(words) + 1]
    return np.isin(np.frombuffer(data, np.uint8)[at - 1], np.frombuffer(b".!?", np.uint8))


def cut(texts: pa.Array, strategies: tuple[str, ...], delimiter: str, threshold: float) -> Cut:
    """The ranges of the chunkers in `chunk` over texts, which are lower-cased and not null; the delimiter is white space."""
    lines = pc.split_pattern(texts, delimiter)
    line_at, words = _flat(pc.utf8_split_whitespace(lines.flatten()))
    doc_line = lines.offsets.to_numpy() - lines.offsets[0].as_py()
    first = line_at[doc_line]  # of each document's words, and their end
    n, docs = len(words), len(texts)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    key = np.sort((ids << 32) | np.arange(n))
    order, term = key & 0xFFFFFFFF, key >> 32
    before = np.full(n, -1)
    before[1:] = np.where(term[1:] == term[:-1], order[:-1], -1)
    doc_of = np.repeat(np.arange(docs), np.diff(first))
    layers: list[Layer] = []

    def whole(strategy: str, begin: np.ndarray, empty: np.ndarray) -> Layer:
        """Chunks that begin at these words and together hold all, and an empty one for each of some documents."""
        size, doc = np.diff(np.append(begin, n)), doc_of[begin]
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        more = np.zeros(len(empty), np.int64)
        return Layer(strategy, np.append(doc, empty), np.append(place, more), np.append(begin, first[empty]), np.append(size, more), np.repeat(np.arange(len(begin)), size))

    for s in strategies:
        if s in WINDOWS:
            layers += _windows(s, first, n)
        elif s == "paragraph":
            counts = np.diff(line_at)
            begin = line_at[:-1][counts > 0]
            layers.append(whole(s, begin[_paragraphs(doc_of[begin], counts[counts > 0])], np.zeros(0, np.int64)))
        elif s == "semantic":
            prev = np.empty(n, np.int64)
            prev[order] = before
            layers.append(whole(s, _sentence_groups(doc_of, _ends(words), prev, threshold), np.flatnonzero(np.diff(first) == 0)))
        else:
            raise ValueError(f"unknown chunking {s!r}")
    return Cut(coded.dictionary, order, term, before, layers)


def _windows(strategy: str, first: np.ndarray, n: int) -> list[Layer]:
    """Every so many windows of a document overlap no more, so they make a layer."""
    window, overlap = WINDOWS[strategy]
    stride, sizes = window - overlap, np.diff(first)
    count = np.where(sizes == 0, 0, np.maximum(1, np.ceil((sizes - overlap) / float(stride)))).astype(np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin, size = first[doc] + place * stride, np.minimum(window, sizes[doc] - place * stride)
    out, each = [], -(-window // stride)
    for k in range(each):
        on = place % each == k
        b, z, of = begin[on], size[on], np.full(n, -1)
        of[np.repeat(b - (np.cumsum(z) - z), z) + np.arange(z.sum())] = np.repeat(np.arange(len(b)), z)
        out.append(Layer(strategy, doc[on], place[on], b, z, of))
    return out


def _paragraphs(doc: np.ndarray, counts: np.ndarray) -> list[int]:
    """Which paragraphs, none empty, begin a chunk: see merged_paragraphs."""
    heads: list[int] = []
    full, tokens, last = 0, 0, -1
    for k, (d, c) in enumerate(zip(doc.tolist(), counts.tolist(), strict=True)):
        if d != last:
            if tokens and full:
                heads.pop()
            full, tokens, last = 0, 0, d
        if not tokens:
            heads.append(k)
        tokens += c
        if tokens >= PARAGRAPH_TOKENS:
            full, tokens = full + 1, 0
    if tokens and full:
        heads.pop()
    return heads


def _sentence_groups(doc_of: np.ndarray, ends: np.ndarray, prev: np.ndarray, threshold: float) -> np.ndarray:
    """First words of the groups of sentences that are alike: see chunk_semantic. prev: where each word was last before, or -1."""
    n = len(doc_of)
    if not n:
        return np.zeros(0, np.int64)
    new = np.append(True, ends[:-1] | (doc_of[1:] != doc_of[:-1]))
    begin, sentence = np.flatnonzero(new), np.cumsum(new) - 1
    doc, own = doc_of[begin], prev < begin[sentence]  # the first of equal words in a sentence
    different = np.bincount(sentence[own], minlength=len(begin)).astype(float)
    shared = np.bincount(sentence[own & (prev >= begin[np.maximum(sentence - 1, 0)])], minlength=len(begin))
    follows = np.append(False, doc[1:] == doc[:-1])
    root = np.sqrt(different)
    alike = np.append(False, shared[1:] / (root[:-1] * root[1:] + 1e-10) >= threshold)
    few = np.bincount(doc)[doc] <= 2
    starts = np.flatnonzero(~follows | ~(alike | few))
    size = np.diff(np.append(starts, len(begin)))
    opens = ~follows[starts]
    after = np.append(np.where(opens[1:], 0, size[1:]), 0)  # of the next group of the document, 0 if there is none
    heads, last = [], 0
    for k, (z, o, a) in enumerate(zip(size.tolist(), opens.tolist(), after.tolist(), strict=True)):
        if not o and z < 2 and (a == 0 or last <= a):
            last += z
        else:
            heads.append(k)
            last = z
    return begin[starts[heads]]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.select("source_file", F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def _counted(docs: DataFrame, strategies: tuple[str, ...], delimiter: str, threshold: float) -> DataFrame:
    """kind, term, n0, n1 ... of the strategies: for kind 0 the chunks that hold a term, for kind 1 all chunks and for kind 2 their words."""
    names = ["kind", "term", *(f"n{k}" for k in range(len(strategies)))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _slices(batch)):
            made = cut(part.column("text"), strategies, delimiter, threshold)
            held, all_of = np.zeros((len(strategies), len(made.terms)), np.int64), np.zeros((len(strategies), 2), np.int64)
            for x in made.layers:
                k, of = strategies.index(x.strategy), x.of[made.order]
                # x.begin has no -1; a word of no chunk is left out
                on = (of >= 0) & (made.before < x.begin[of] if len(x.begin) else False)
                held[k] += np.bincount(made.term[on], minlength=len(made.terms))
                all_of[k] += len(x.size), x.size.sum()
            kinds = np.append(np.zeros(len(made.terms), np.int32), np.array([1, 2], np.int32))
            cols = [pa.array(np.append(h, a)) for h, a in zip(held, all_of, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.concat_arrays([made.terms, pa.nulls(2, pa.string())]), *cols], names=names)

    rows = _lowered(docs).mapInArrow(count, "kind int, term string, " + ", ".join(f"{c} long" for c in names[2:]))
    return rows.groupBy("kind", "term").agg(*[F.sum(c).alias(c) for c in names[2:]])


class _Statistics:
    """Statistics of a table that _counted made."""

    def __init__(self, table: DataFrame, strategies: tuple[str, ...]):
        self.strategies, self.columns = strategies, [F.col(f"n{k}") for k in range(len(strategies))]
        self.counts = table.where("kind = 0").drop("kind")
        sums = {r["kind"]: r[2:] for r in table.where("kind > 0").collect()}
        self.chunks, words = sums.get(1, (0,) * len(strategies)), sums.get(2, (0,) * len(strategies))
        self.avgdl = {s: w / c for s, c, w in zip(strategies, self.chunks, words, strict=True) if c}
        means = self.counts.agg(*[F.avg(F.when(c > 0, self._raw(c, n))).alias(f"m{k}") for k, (c, n) in enumerate(zip(self.columns, self.chunks, strict=True))]).first()
        self.means = [m or 0.0 for m in means]

    @staticmethod
    def _raw(df: Column, n: int) -> Column:
        return F.log(n - df + 0.5) - F.log(df + 0.5)

    def of(self, counts: DataFrame) -> DataFrame:
        """strategy, term, df, idf, weight of a part of the counts, as in term_statistics."""
        rows = F.array(*[F.struct(F.lit(s).alias("strategy"), c.alias("df"), F.lit(n).cast("long").alias("n"), F.lit(float(m)).alias("mean")) for s, c, n, m in zip(self.strategies, self.columns, self.chunks, self.means, strict=True)])
        long = counts.select("term", F.inline(rows)).where("df > 0").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        return long.select("strategy", "term", "df", F.when(F.col("raw") < 0, BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), F.log(1 + F.col("n") / F.col("df")).alias("weight"))

    def weights(self, asked: DataFrame) -> _Weights:
        """Weights of the frequent terms and of those that are asked for, and bounds of the others'."""
        step = F.floor(4 * F.log2(F.greatest(*self.columns, F.lit(1)))).cast("int")  # a hundred and more steps, whatever the corpus
        steps = sorted((r for r in self.counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), *[F.max(c).alias(f"m{k}") for k, c in enumerate(self.columns)]).collect()), key=lambda r: -r["step"])
        n, least = 0, 1 << 20
        for r in steps:
            n += r["n"]
            if n > FREQUENT:
                break
            least = r["step"]
        most = [max([1, *(r[f"m{k}"] for r in steps if r["step"] < least)]) for k in range(len(self.strategies))]
        frequent = self.counts.where(step >= least).unionByName(self.counts.where(step < least).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi"))
        weight = [F.when(c > 0, F.log(1 + n / c)).otherwise(0.0).alias(s) for s, c, n in zip(self.strategies, self.columns, self.chunks, strict=True)]
        sent = frequent.select("term", *weight).toArrow().sort_by("term")
        terms, table = sent.column("term").combine_chunks(), {s: sent.column(s).to_numpy() for s in self.strategies}
        others = {s: (float(np.log1p(n / m)), float(np.log1p(n))) for s, n, m in zip(self.strategies, self.chunks, most, strict=True)}
        return _Weights(terms, table, others)


@dataclass
class _Weights:
    """terms with their weights in each strategy, and the least and most weight of any other term."""

    terms: pa.Array
    table: dict[str, np.ndarray]
    others: dict[str, tuple[float, float]]


class _Held:
    """Of one strategy the rows that may be among a question's `depth` best by bm25 or by cosine.

    least_w and least_v are what a row has to exceed in one of them: the depth-th
    best bm25, and the depth-th best of the lower bounds of the cosine. Of chunks
    with equal words (mark) the first `depth` go on, as their cosines are equal.
    """

    def __init__(self, depth: int, questions: int):
        self.depth, self.least_w, self.least_v = depth, np.zeros(questions), np.zeros(questions)
        self.parts: list[pd.DataFrame] = []
        self.size, self.limit = 0, HELD_ROWS

    def masks(self, bm25: np.ndarray, dot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which cells (question, chunk) go on; low and high are the bounds of what dot is divided by."""
        out = bm25 > self.least_w[:, None]
        if len(many := np.flatnonzero(out.sum(1) > 4 * self.depth)):
            self.least_w[many] = np.maximum(self.least_w[many], self._kth(bm25[many]) - SLACK)
            out[many] = bm25[many] > self.least_w[many, None]
        near = dot > self.least_v[:, None] * low
        if len(many := np.flatnonzero(near.sum(1) > 4 * self.depth)):
            self.least_v[many] = np.maximum(self.least_v[many], self._kth(dot[many] / high[many]) - SLACK)
            near[many] = dot[many] > self.least_v[many, None] * low[many]
        return out | near

    def _kth(self, x: np.ndarray) -> np.ndarray:
        return np.partition(x, x.shape[1] - self.depth, axis=1)[:, x.shape[1] - self.depth]

    def add(self, rows: pd.DataFrame) -> None:
        self.parts.append(rows)
        self.size += len(rows)
        if self.size > self.limit:
            self.limit = max(HELD_ROWS, 2 * len(self.rows()))

    def rows(self) -> pd.DataFrame:
        """What is held, without rows that others have beaten."""
        if not self.parts:
            return pd.DataFrame()
        x = pd.concat(self.parts, ignore_index=True)
        by = np.floor(x["bm25"].to_numpy() * 1e9 + 0.5)
        words = self._best(x, by, by, self.least_w, 1e-9) & (x["bm25"].to_numpy() > 0)
        near = self._best(x, x["least"].to_numpy(), x["most"].to_numpy() + SLACK, self.least_v, 1.0)
        words &= self._first(x, words, ["by"], by)
        near &= self._first(x, near, ["mark"], by)
        x = x[words | near].reset_index(drop=True)
        self.parts, self.size = [x], len(x)
        return x

    def _best(self, x: pd.DataFrame, by: np.ndarray, reach: np.ndarray, least: np.ndarray, unit: float) -> np.ndarray:
        """Whether a row's reach is not below the depth-th best of its question; raises `least`."""
        q = x["q"].to_numpy()
        order = np.lexsort((-by, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        kth = np.full(len(least), -np.inf)
        at = order[place == self.depth - 1]
        kth[q[at]] = by[at]
        np.maximum(least, np.where(np.isfinite(kth), kth * unit - SLACK, 0.0), out=least)
        return reach >= kth[q]

    def _first(self, x: pd.DataFrame, on: np.ndarray, equal: list[str], by: np.ndarray) -> np.ndarray:
        """Of a question's rows that are equal in this, and of which too many are on, the first `depth` by source_file and chunk_index."""
        out = np.ones(len(x), bool)
        many = on & (np.bincount(x["q"].to_numpy()[on], minlength=len(self.least_w))[x["q"].to_numpy()] > 2 * self.depth)
        if many.any():
            part = x[many].assign(by=by[many]).sort_values(["source_file", "chunk_index"])
            late = part.groupby(["q", *equal]).cumcount() >= self.depth
            out[late[late].index] = False
        return out


def _found(docs: DataFrame, strategies: tuple[str, ...], delimiter: str, threshold: float, sides: dict[str, _Asked], weights: _Weights, avgdl: dict[str, float], depth: int) -> DataFrame:
    """_PAIRS: each task's rows that may be among a question's best."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: _Held(depth, len(x.questions)) for s, x in sides.items()}
        for part in (p for batch in batches for p in _slices(batch)):
            made = cut(part.column("text"), strategies, delimiter, threshold)
            at = pc.index_in(made.terms, value_set=weights.terms)
            rare = at.is_null().to_numpy(zero_copy_only=False)
            at = at.fill_null(0).to_numpy()
            code = pd.util.hash_array(made.terms.to_numpy(zero_copy_only=False)) if len(made.terms) else np.zeros(0, np.uint64)
            codes = [(code & 0xFFFFFFFF).astype(float), (code >> np.uint64(32)).astype(float)]
            places = {s: pc.index_in(made.terms, value_set=x.terms).fill_null(-1).to_numpy() for s, x in sides.items()}
            for x in made.layers:
                if (side := sides.get(x.strategy)) is None or not len(x.begin):
                    continue
                weight = np.where(rare, 0.0, weights.table[x.strategy][at] if len(weights.terms) else 0.0)
                _score(x, made, side, held[x.strategy], weight, rare, codes, places[x.strategy], weights.others[x.strategy], avgdl[x.strategy], part.column("source_file"))
        for s, x in held.items():
            if len(rows := x.rows()):
                side = sides[s]
                cols = {"strategy": s, "question_id": np.array(side.questions, object)[rows["q"]], "qnorm": side.norm[rows["q"]]}
                yield from pa.Table.from_pandas(rows.assign(**cols)[names], schema=kinds, preserve_index=False).to_batches(10_000)

    names = [c.split()[0] for c in _PAIRS.split(", ")]
    of = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    kinds = pa.schema([(c.split()[0], of[c.split()[1]]) for c in _PAIRS.split(", ")])
    return _lowered(docs).mapInArrow(score, _PAIRS)


def _score(x: Layer, made: Cut, side: _Asked, held: _Held, weight: np.ndarray, rare: np.ndarray, codes: list[np.ndarray], places: np.ndarray, others: tuple[float, float], avgdl: float, files: pa.Array) -> None:
    """Scores a layer's chunks against all questions."""
    of = x.of[made.order]
    on = np.flatnonzero(of >= 0)
    of = of[on]
    head = np.flatnonzero(made.before[on] < x.begin[of])  # a term's words in a chunk stand side by side
    tf = np.diff(np.append(head, len(on))).astype(float)
    term, chunk_of, n = made.term[on[head]], of[head], len(x.begin)
    total = lambda w: np.bincount(chunk_of, weights=w, minlength=n)
    known, other = total((tf * weight[term]) ** 2), total(tf * tf * rare[term])
    mark = sum((np.mod(total(c[term] * tf), 1 << 32).astype(np.int64) << (31 * k) for k, c in enumerate(codes)), np.zeros(n, np.int64))
    low, high = (np.sqrt(known + other * w * w) for w in others)
    at = np.flatnonzero(places[term] >= 0)
    term, chunk_of, tf = places[term[at]], chunk_of[at], tf[at]
    part = damped(tf, x.size[chunk_of], avgdl)
    step = max(1, BLOCK_SCORES // max(1, len(side.questions)))
    for begin in range(0, n, step):
        end = min(begin + step, n)
        here = slice(None) if step >= n else (chunk_of >= begin) & (chunk_of < end)
        bm25, dot, shared = side.sums(term[here], chunk_of[here] - begin, tf[here], part[here], end - begin)
        below, above = (side.norm[:, None] * y[None, begin:end] + 1e-10 for y in (low, high))
        q, c = np.nonzero(held.masks(bm25, dot, below, above))
        if len(q):
            k, d = c + begin, dot[q, c]
            held.add(pd.DataFrame({"q": q, "source_file": files.take(pa.array(x.doc[k])).to_numpy(zero_copy_only=False), "chunk_index": x.place[k].astype(np.int32), "bm25": bm25[q, c], "coverage": shared[q, c] / side.size[q], "dot": d, "least": d / above[q, c], "most": d / below[q, c], "mark": mark[k]}))


def _pruned(found: DataFrame, depth: int) -> DataFrame:
    """Of all tasks' rows those that may be among a question's best."""
    per = Window.partitionBy("strategy", "question_id")
    ranked = found.withColumn("w", F.row_number().over(per.orderBy(quantised(F.col("bm25"), 9).desc(), "source_file", "chunk_index"))).withColumn("l", F.row_number().over(per.orderBy(F.desc("least"))))
    ranked = ranked.withColumn("copy", F.row_number().over(Window.partitionBy("strategy", "question_id", "mark").orderBy("source_file", "chunk_index")))
    ranked = ranked.withColumn("least_of_best", F.max(F.when(F.col("l") == depth, F.col("least"))).over(per))
    near = (F.col("copy") <= depth) & (F.col("most") + SLACK >= F.coalesce("least_of_best", F.lit(0.0)))
    return ranked.where(((F.col("w") <= depth) & (F.col("bm25") > 0)) | near).drop("w", "l", "copy", "least_of_best", "least", "most", "mark")


def range_hits(docs: DataFrame, questions: DataFrame, strategies, searches=SEARCHES, top_ks=TOP_KS, delimiter: str = "\n\n", threshold: float = 0.5) -> tuple[DataFrame, DataFrame] | None:
    """The hits of every configuration, as find_hits has them, and the chunks that they are (with a few more); None where this does not do it.

    docs: source_file, text, where no name is twice (chunks of such documents are not told apart by
    their key); the delimiter is white space. Null names take no part. Questions
    are as many as can be sent around. Tables in between are in the shared folder.
    """
    strategies, docs, spark = tuple(strategies), docs.where("source_file is not null"), docs.sparkSession
    asked = query_terms(questions)
    size = asked.agg(F.count("*").alias("rows"), F.count_distinct("question_id").alias("questions")).first()
    if not delimiter.isspace() or size["rows"] * len(strategies) > BROADCAST_ROWS or size["questions"] > DENSE_QUESTIONS:
        return None
    if not docs.groupBy("source_file").count().where("count > 1").isEmpty():
        return None
    folder, depth = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", max(top_ks) * max(DEPTH[s] for s in searches)

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    stats = _Statistics(written("terms", _counted(docs, strategies, delimiter, threshold)), strategies)
    held = stats.counts.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    known = asked.join(stats.of(held), "term").withColumn("qw", F.col("qtf") * F.col("weight")).toPandas()
    sizes = asked.groupBy("question_id").count().toPandas().set_index("question_id")["count"]
    sides = {s: _Asked(part.reset_index(drop=True), sizes) for s, part in known.groupby("strategy")}
    pairs = written("pairs", _pruned(_found(docs, strategies, delimiter, threshold, sides, stats.weights(asked), stats.avgdl, depth), depth))
    chunks = written("chunks", chunks_of(docs, pairs, strategies, lambda d, s: chunk(d, s, delimiter, threshold)))
    entries = Index(lambda: forward_of(chunks)).entries
    terms = entries.select("term").distinct()
    norms = norms_of(entries, stats.of(stats.counts.join(terms, "term", "left_semi")))
    scored = pairs.join(norms, KEY, "left").withColumn("cosine", F.col("dot") / (F.col("norm") * F.col("qnorm") + 1e-10)).drop("dot", "qnorm", "norm")
    return written("hits", retrieve(ranked_pairs(scored, depth), searches, top_ks)), chunks


def chunks_of(docs: DataFrame, keys: DataFrame, strategies: tuple[str, ...], cut_by: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The chunks of the given keys (KEY, few): only their documents are cut."""
    out = None
    for s in strategies:
        own = keys.where(F.col("strategy") == s).select("source_file", "chunk_index").distinct()
        made = cut_by(docs.join(F.broadcast(own.select("source_file").distinct()), "source_file", "left_semi"), s).join(F.broadcast(own), ["source_file", "chunk_index"], "left_semi")
        out = made if out is None else out.unionByName(made)
    return out
