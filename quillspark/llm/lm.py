"""Language-model scoring with a log-bilinear model.

The model's classes are the end of a text, the most frequent words, and classes
of rarer words by their spelling: a hash of a word's last three bytes. So rarer
words tell contexts apart too, and a word that training never saw has a class.
The prediction is bilinear: a matrix for each of the two words before, added up,
times the matrix of output vectors, plus biases. It is trained with
noise-contrastive estimation: each position against samples of the unigram
distribution. As the context is a pair of classes, the normalisers of all pairs
are one table, filled by batched matrix products, and every score is a
normalised log-probability.

Within a class of rarer words one that training saw c times has a part in
proportion to c - DISCOUNT, and the words of the class that training never saw
have, as one token, the share that its words seen once suggest (Good-Turing).
Counts of all words cover all training texts: the most frequent words by a
broadcast list of bounded length, the others by a shuffle. Texts are cut into
words twice, to find these words and to write the ids of all tokens; training
and scoring read the ids.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ASCII_LOWER, map_batches, settle_table, table, text_slices

#: Classes in all and those by spelling, words that are counted without a shuffle, and the longest of these in bytes (longer ones go by their hash): the broadcast list is below 16 MB.
CLASSES, SPELLINGS, FREQUENT, LONGEST = 512, 256, 65_536, 256
#: Dimensions, noise samples a batch, positions a batch, and the learning rate of each round of training.
DIMS, NOISE, BATCH, RATES = 16, 64, 1024, (0.05, 0.02)
#: Training tokens after which a model is passed on to be averaged and the next one starts: so what a model has seen does not follow how the texts are dealt to tasks.
SHARD_TOKENS = 1 << 19
DISCOUNT = 0.5
#: Bits of a text's hash that go with its doc_id, to tell texts apart that share one; few, as every rare word carries them.
TEXT_KEY = (1 << 24) - 1
#: Stand for the number of texts, of tokens and of tokens by spelling among counts of words; no word has white space.
_TEXTS, _TOKENS, _SPELLED = " texts", " tokens", " spelled "


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def spelling(word: bytes, spellings: int) -> int:
    return zlib.crc32(word[-3:]) % spellings


def name_of(word: bytes, longest: int) -> bytes:
    """The word, or what stands for it if it is very long."""
    return word if len(word) <= longest else b"\n" + blake2b(word, digest_size=16).hexdigest().encode()


def most_frequent(counts: Counter[bytes], most: int) -> list[tuple[bytes, int]]:
    """(word, count) of the `most` most frequent words in any order, of equals the smaller ones: only those equal to the last are sorted."""
    if len(counts) <= most:
        return list(counts.items())
    least = int(-np.partition(-np.fromiter(counts.values(), np.int64, len(counts)), most - 1)[most - 1])
    above = [x for x in counts.items() if x[1] > least]
    return above + [(w, least) for w in sorted(w for w, c in counts.items() if c == least)[: most - len(above)]]


def nominated_words(train: DataFrame, most: int) -> tuple[list[tuple[str, int]], int, int, np.ndarray]:
    """(word, count), at most `most`, of the most frequent words of the training texts; the texts; the tokens; the tokens by spelling.

    Every task counts all its words and passes its own most frequent ones on;
    their counts are summed over all tasks. The driver first gets how many words
    have about each count, and then only the words above the limit that follows.
    """

    spellings, longest = SPELLINGS, LONGEST

    def make():
        counts: Counter[bytes] = Counter()
        ends = _Spelled(spellings)
        texts = tokens = 0

        def step(batch):
            nonlocal texts, tokens
            for _, raws in text_slices(batch):
                for raw in raws:
                    words = raw.translate(ASCII_LOWER).split()
                    counts.update(words)
                    tokens += len(words) + 1
                texts += len(raws)
            # a task passes on what it has once its table is large, and at its end
            if len(counts) > 8 * most:
                yield shed()

        def shed():
            nonlocal texts, tokens
            kinds = [-1 - ends[w[-3:]] for w in counts]
            spelled = np.bincount(kinds, weights=np.fromiter(counts.values(), float, len(counts)), minlength=spellings).astype(np.int64)
            rows = [(name_of(w, longest).decode(), c) for w, c in most_frequent(counts, most)] + [(_TEXTS, texts), (_TOKENS, tokens)] + [(f"{_SPELLED}{k}", c) for k, c in enumerate(spelled.tolist()) if c]
            counts.clear()
            texts = tokens = 0
            return {"word": pa.array([w for w, _ in rows], pa.string()), "n": pa.array([c for _, c in rows], pa.int64())}

        step.finish = shed
        return step

    found = settle_table(map_batches(train.select("text"), "word string, n long", make).groupBy("word").agg(F.sum("n").alias("n")))
    marker, size = F.col("word").startswith(" "), F.when(F.col("n") < 64, F.col("n")).otherwise(16 + F.floor(8 * F.log2("n"))).cast("int")
    about = {r["word"]: r["n"] for r in found.where(marker).collect()}
    words, left, limit, share = found.where(~marker), most, 1 << 30, 0
    for r in words.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # some hundred sizes
        if r["count"] > left:
            share = int(left / r["count"] * 0.98 * (1 << 20))  # of the words of the last size, a part by hash
            break
        left, limit = left - r["count"], r["size"]
    part = (size == (r["size"] if share else -1)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)
    top = sorted(((x["word"], x["n"]) for x in words.where((size >= limit) | part).collect()), key=lambda x: (-x[1], x[0].encode()))[:most]
    return top, about.get(_TEXTS, 0), about.get(_TOKENS, 0), np.array([about.get(f"{_SPELLED}{k}", 0) for k in range(spellings)])


class _Spelled(dict):
    """Ids of words that the lexicon lacks, by their last three bytes: -1 less the class of the spelling."""

    def __init__(self, spellings: int):
        self.spellings = spellings

    def __missing__(self, end: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[end] = -1 - spelling(end, self.spellings)
        return self[end]


class Lexicon:
    """Ids of frequent words by rank from 1; 0 is the end of a text, and what is below 0 every other word, by its spelling.

    The first `alone` words are classes of their own.
    """

    def __init__(self, words: list[str], alone: int):
        names = [w.encode() for w in words]
        self.id = {w: k + 1 for k, w in enumerate(names)}
        self.longest, self.size, self.alone, self.classes = LONGEST, len(words) + 1, alone, 1 + alone + SPELLINGS
        self.class_of_id = np.array([*range(alone + 1), *(1 + alone + spelling(w, SPELLINGS) for w in names[alone:])])
        self.spelled = _Spelled(SPELLINGS)

    def rare(self, word: bytes) -> int:
        """The id of a word that is not in the list as it stands."""
        if len(word) > self.longest:
            word = name_of(word, self.longest)
            return self.id.get(word) or self.spelled[word[-3:]]
        return self.spelled[word[-3:]]

    def ids(self, raw: bytes) -> tuple[list[int], Counter[bytes]]:
        """The ids of a text, its end's last, and how often it has each word that the list lacks, by name."""
        get, rare, spelled, longest = self.id.get, self.rare, self.spelled, self.longest
        words = raw.translate(ASCII_LOWER).split()
        out = [get(w) or (spelled[w[-3:]] if len(w) <= longest else rare(w)) for w in words]
        others = Counter([w for w, k in zip(words, out, strict=True) if k < 0])
        if others and len(max(others, key=len)) > longest:
            others = Counter({name_of(w, longest): n for w, n in others.items()})
        out.append(0)
        return out, others

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        """0 the end, 1 to `alone` frequent words, then the spellings."""
        return np.where(ids < 0, self.alone - ids, self.class_of_id[np.maximum(ids, 0)])


def contexts(targets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each position; what lies before a text is the end's class."""
    one = np.concatenate([[0], targets[:-1]])
    one[first] = 0
    two = np.concatenate([[0], one[:-1]])
    two[first] = 0
    return one, two


class LogBilinear:
    """Scores s(w | a, b) = (A[a] + B[b]) . Q[w] + bias[w] over classes."""

    def __init__(self, params: np.ndarray, classes: int, dims: int = DIMS):
        self.classes, self.dims, self.params = classes, dims, params
        self.A, self.B, self.Q = params[: 3 * classes * dims].reshape(3, classes, dims)
        self.bias = params[3 * classes * dims :]
        self.squares = None

    @staticmethod
    def start(unigram: np.ndarray, dims: int = DIMS) -> np.ndarray:
        small = np.random.default_rng(7).normal(0, 0.1, 3 * len(unigram) * dims)
        return np.concatenate([small, np.log(unigram)])

    def _sums(self, at: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """Rows of grad added up by class, as one flat array."""
        places = at[:, None] * self.dims + np.arange(self.dims)
        return np.bincount(places.ravel(), weights=grad.ravel(), minlength=self.classes * self.dims)

    def nce_step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, rate: float) -> None:
        """One AdaGrad step for positions (a, b) -> w against `noise` classes that the batch shares."""
        shift = self.bias - log_noise - np.log(len(noise)).astype(log_noise.dtype)
        r, q, qn = self.A.take(a, 0) + self.B.take(b, 0), self.Q.take(w, 0), self.Q.take(noise, 0)
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", r, q) + shift[w]))
        # 1 / (1 + exp(-score)) in place
        false = r @ -qn.T
        false -= shift[noise]
        np.exp(false, out=false)
        false += 1
        np.reciprocal(false, out=false)
        dr = up[:, None] * q - false @ qn
        both = np.concatenate([w, noise])
        grad, n = np.empty_like(self.params), self.classes * self.dims
        grad[:n], grad[n : 2 * n] = self._sums(a, dr), self._sums(b, dr)
        grad[2 * n : 3 * n] = self._sums(both, np.concatenate([up[:, None] * r, -(false.T @ r)]))
        grad[3 * n :] = np.bincount(both, weights=np.concatenate([up, -false.sum(0)]), minlength=self.classes)
        grad /= grad.dtype.type(len(w))
        if self.squares is None:
            self.squares = np.full_like(grad, 1e-12)
        self.squares += grad * grad
        self.params += grad.dtype.type(rate) * grad / np.sqrt(self.squares)

    def normalisers(self) -> np.ndarray:
        """log of the sum over all classes, for every pair of context classes."""
        out = np.empty((self.classes, self.classes))
        q, bias = self.Q.astype(np.float32), self.bias.astype(np.float32)
        for a in range(self.classes):
            s = (self.A[a] + self.B).astype(np.float32) @ q.T + bias
            top = s.max(axis=1, keepdims=True)
            out[a] = np.log(np.exp(s - top).sum(axis=1, dtype=np.float64)) + top[:, 0]
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each context class adds to each class's score, by matrix products, and the normalisers."""
        A, B, Q = (x.astype(np.float64) for x in (self.A, self.B, self.Q))
        return A @ Q.T + self.bias, B @ Q.T, self.normalisers()


def log10_probabilities(tables: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    one, two, z = tables
    return (one[a, w] + two[b, w] - z[a, b]) / np.log(10)


@lru_cache(maxsize=2)
def _ready(raw: bytes, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return LogBilinear(np.frombuffer(raw).copy(), classes).tables()


def encoded(rows: DataFrame, lexicon) -> DataFrame:
    """The rows with `ids`, the lexicon's ids of a text's tokens as 32-bit integers, and `rare`, its words that the lexicon lacks, in place of `text`; kind is a word's spelling."""
    carried = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["ids binary", "rare array<struct<word:string,times:int,kind:int>>"])

    def make():
        def step(batch):
            words, spelled = lexicon.value, lexicon.value.spelled
            for row, raws in text_slices(batch):
                ids, names, times, ends = [], [], [], [0]
                for raw in raws:
                    own, others = words.ids(raw)
                    ids.append(np.array(own, np.int32).tobytes())
                    names += others
                    times += others.values()
                    ends.append(len(names))
                kinds = [-1 - spelled[w[-3:]] for w in names]
                flat = pa.StructArray.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(times, pa.int32()), pa.array(kinds, pa.int32())], ["word", "times", "kind"])
                yield {f.name: batch.column(f.name).slice(row, len(raws)) for f in carried} | {"ids": pa.array(ids, pa.binary()), "rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}

        return step

    return map_batches(rows, schema, make)


def _joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other; first place of each text)."""
    sizes = np.array([len(raw) // 4 for raw in raws])
    return np.frombuffer(b"".join(raws), np.int32), np.cumsum(sizes) - sizes


def train_model(train: DataFrame, lexicon, unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameters after training on every position of the training texts in each round, and the exact count of each id of the lexicon.

    The texts come as `encoded` has them, or as they are.

    Each round goes over all texts in shards of about SHARD_TOKENS, each
    started from the same parameters, and the results are averaged by number of
    positions: a task starts anew after each shard. The average is a grouped sum, so the driver receives
    one set of parameters. Counts of ids are added up along the first round.
    """
    classes, params, log_noise = len(unigram), LogBilinear.start(unigram), np.log(unigram).astype(np.float32)
    if "ids" not in train.columns:
        train = encoded(train.select("text"), lexicon)
    counts, batch_size, samples, shard, bits = np.zeros(lexicon.value.size, np.int64), BATCH, NOISE, SHARD_TOKENS, classes.bit_length()
    for turn, rate in enumerate(RATES):
        now = train.sparkSession.sparkContext.broadcast(params)

        def make(turn=turn, rate=rate, now=now):
            model, rng = LogBilinear(now.value.astype(np.float32), classes), np.random.default_rng(11)
            seen, own, drawn = 0, np.zeros(lexicon.value.size, np.int64), np.cumsum(unigram)

            def step(batch):
                nonlocal seen, model
                for _, raws in text_slices(batch, "ids"):
                    if seen >= shard:
                        yield finish()
                        model, seen = LogBilinear(now.value.astype(np.float32), classes), 0
                        own[:] = 0
                    ids, first = _joined(raws)
                    if turn == 0:
                        own[:] += np.bincount(ids[ids >= 0], minlength=len(own))
                    w = lexicon.value.classes_of(ids)
                    a, b = contexts(w, first)
                    # a position's three classes are shuffled as one number
                    mixed = rng.permutation(a << 2 * bits | b << bits | w)
                    a, b, w = mixed >> 2 * bits, mixed >> bits & (1 << bits) - 1, mixed & (1 << bits) - 1
                    noise = np.minimum(np.searchsorted(drawn, rng.random((-(-len(w) // batch_size), samples))), classes - 1)
                    for k, s in enumerate(range(0, len(w), batch_size)):
                        at = slice(s, s + batch_size)
                        model.nce_step(a[at], b[at], w[at], noise[k], log_noise, rate)
                    seen += len(w)

            def finish():
                values, known = (model.params.astype(np.float64) if seen else np.empty(0)), np.flatnonzero(own)
                k = np.concatenate([np.arange(len(values)), -1 - known])
                return {"k": pa.array(k, pa.int32()), "v": pa.array(np.concatenate([values * seen, own[known]])), "n": pa.array(np.append(np.full(len(values), seen), np.zeros(len(known), int)).astype("i8"))}

            step.finish = finish
            return step

        done = map_batches(train.select("ids"), "k int, v double, n long", make).groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas().sort_values("k")
        own, found = done[done["k"] < 0], done[done["k"] >= 0]
        counts[-1 - own["k"].to_numpy(int)] += own["v"].to_numpy().astype(np.int64)
        if len(found):
            params = (found["v"] / found["n"]).to_numpy()
    return params, counts


def _rare_rows(rows: DataFrame) -> DataFrame:
    """doc, text_key, times, kind, c, first: a row for each text and word of it that the lexicon lacks.

    c is how often training texts have the word, first marks one row of each
    word. The most frequent words are in the lexicon, so no word of the shuffle is hot.
    """
    words = rows.select("doc", "text_key", "held_out", F.explode("rare").alias("r")).select("doc", "text_key", "held_out", "r.*")
    by_word = Window.partitionBy("word")
    # the numbering comes first: its order serves the sum too
    numbered = words.withColumn("first", F.row_number().over(by_word.orderBy("doc", "text_key")) == 1)
    return numbered.withColumn("c", F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("times"))).over(by_word)).drop("word", "held_out")


def _rare_sums(seen: DataFrame, unseen: np.ndarray) -> DataFrame:
    """doc, text_key and sums over the rare words of each text; unseen has what a word that training never saw adds, by kind."""
    t, c, known = F.col("times"), F.col("c"), F.col("c") > 0
    new = F.element_at(F.array(*[F.lit(float(x)) for x in unseen]), F.col("kind") + 1)
    part = F.when(known, F.log10(F.greatest(c, F.lit(1)) - DISCOUNT)).otherwise(new)
    return seen.groupBy("doc", "text_key").agg(F.sum(F.when(known, t).otherwise(0)).alias("rare_known"), F.sum(t * F.log10(c + 0.5)).alias("rare_base"), F.sum(t * part).alias("rare_parts"))


def _class_sums(rows: DataFrame, lexicon, model, counts) -> DataFrame:
    """doc, text_key, doc_id, held_out and sums over the tokens of each text, as if training had seen all words; rare words' own parts are left out."""

    def make():
        params, share = model.value
        tables = _ready(params, len(share))
        n = counts.value
        base = np.log10(n + 0.5)
        part = np.where(np.arange(len(n)) > lexicon.value.alone, np.log10(np.maximum(n - DISCOUNT, 1e-9)), 0.0)

        def step(batch):
            for row, raws in text_slices(batch, "ids"):
                ids, first = _joined(raws)
                w = lexicon.value.classes_of(ids)
                a, b = contexts(w, first)
                listed = ids >= 0
                total = lambda x: np.add.reduceat(x, first)
                of = np.where(listed, ids, 0)
                yield {c: batch.column(c)[row : row + len(raws)] for c in ("doc", "text_key", "doc_id", "held_out")} | {
                    "n_tokens": pa.array(total(np.ones(len(ids), np.int64))), "known": pa.array(total((listed & (n[of] > 0)).astype(np.int64))), "base": pa.array(total(np.where(listed, base[of], 0.0))),
                    "lm": pa.array(total(log10_probabilities(tables, a, b, w) + share[w] + np.where(listed, part[of], 0.0))),
                }

        return step

    return map_batches(rows.drop("rare"), "doc long, text_key long, doc_id long, held_out boolean, n_tokens long, known long, base double, lm double", make)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null or empty text is its end alone; a null doc_id counts as training
    text. Repeated rows are scored alike, and each adds to the counts. Without
    training texts every token is unknown. Other columns are not carried.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").bitwiseAND(F.lit(TEXT_KEY)).alias("text_key"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    train = rows.where(~F.col("held_out"))
    nominees, texts, about, spelled = nominated_words(train, FREQUENT)
    alone = min(CLASSES - 1 - SPELLINGS, len(nominees))
    words = Lexicon([w for w, _ in nominees], alone)
    lexicon = sc.broadcast(words)
    for w, c in nominees[:alone]:
        spelled[spelling(w.encode(), SPELLINGS)] -= c
    unigram = np.array([texts, *(c for _, c in nominees[:alone]), *np.maximum(spelled, 0)]) + 0.5
    rows = settle_table(encoded(rows, lexicon))
    # small partitions are read together by one task, which shuffles nothing
    params, exact = train_model(rows.where(~F.col("held_out")).coalesce(max(1, round(about / SHARD_TOKENS))), lexicon, unigram / unigram.sum())
    rare = settle_table(_rare_rows(rows))
    copies = rows.groupBy("doc", "text_key").agg(F.count("*").alias("copies")).where("copies > 1")

    # times, distinct words, and words seen once of each spelling: those of the list and the others
    others = rare.where(F.col("first") & (F.col("c") > 0)).groupBy("kind").agg(F.sum("c").alias("times"), F.count("*").alias("words"), F.count_if(F.col("c") == 1).alias("once")).collect()
    own, at = exact[alone + 1 :], words.class_of_id[alone + 1 :] - 1 - alone
    times, distinct, once = (np.bincount(at, weights=x, minlength=SPELLINGS) for x in (own, own > 0, own == 1))
    for r in others:
        times[r["kind"]] += r["times"]
        distinct[r["kind"]] += r["words"]
        once[r["kind"]] += r["once"]
    tokens, kinds = int(exact[: alone + 1].sum() + times.sum()), int((exact[: alone + 1] > 0).sum() + distinct.sum())
    new = np.clip((once + 0.5) / (times + 1), 1e-9, 0.5)
    seen = np.log10((1 - new) / np.maximum(times - DISCOUNT * distinct, 1e-9))
    share = np.concatenate([np.zeros(alone + 1), seen])

    found = _class_sums(rows, lexicon, sc.broadcast((params.tobytes(), share)), sc.broadcast(exact)).join(_rare_sums(rare, np.log10(new) - seen), ["doc", "text_key"], "left").join(copies, ["doc", "text_key"], "left")
    per_copy = lambda c: F.coalesce(c / F.coalesce("copies", F.lit(1)), F.lit(0.0))
    known = F.col("known") + per_copy(F.col("rare_known"))
    base = F.col("base") + per_copy(F.col("rare_base")) - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (kinds + 1)))
    scored = F.col("lm") + per_copy(F.col("rare_parts"))
    return found.select("doc_id", "held_out", "n_tokens", F.round(known).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), scored.alias("score"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
