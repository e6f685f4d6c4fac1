"""What a model would do, as interfaces, with deterministic offline stand-ins.

The stand-ins make the dataflow testable; their scores say nothing about models.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import LLMConfig
from quillspark.functions.text import let, sentences, terms


class Tokenizer(Protocol):
    """For each text where its tokens end, in code points: an array that does not fall. A border within a character counts as before it."""

    def ends(self, texts: pd.Series) -> pd.Series: ...


class Embedder(Protocol):
    def encode(self, texts: pd.Series) -> pd.Series: ...


class Reranker(Protocol):
    def predict(self, questions: pd.Series, texts: pd.Series) -> pd.Series: ...


#: What a model is told, unless Models says otherwise; {context} and {question} are filled in.
PROMPT = "Here are passages from our files:\n\n{context}\n\nUse only them to reply to: {question}\nIf they do not say, reply that they do not."


@dataclass(frozen=True)
class Models:
    """The models of an evaluation; what is None has a stand-in."""

    embedder: Embedder | None = None
    reranker: Reranker | None = None
    llm: LLMConfig | None = None
    prompt: str = PROMPT
    tokenizer: Tokenizer | None = None
    #: A shared folder where vectors and answers are kept, so that a model sees each text once.
    store: str | None = None


def model_name(model) -> str:
    """What tells a model from others in stored tables: its own `fingerprint` if it has one, else its class and settings as pickled."""
    if model is None:
        return ""
    named = getattr(model, "fingerprint", None)
    if named is not None:
        return str(named() if callable(named) else named)
    from pyspark import cloudpickle

    return f"{type(model).__name__}-{hashlib.sha256(cloudpickle.dumps(model)).hexdigest()[:16]}"


class FileTokenizer:
    """A tokenizer of a JSON file of the tokenizers library, loaded once a worker."""

    def __init__(self, path: str):
        self.path, self.fingerprint = path, f"file-{path}"

    def __getstate__(self):
        return {"path": self.path, "fingerprint": self.fingerprint}

    def ends(self, texts: pd.Series) -> pd.Series:
        if "made" not in self.__dict__:
            from tokenizers import Tokenizer as Made

            self.made = Made.from_file(self.path)
        found = self.made.encode_batch(list(texts), add_special_tokens=False)
        return pd.Series([np.array([end for _, end in e.offsets], np.int64) for e in found], index=texts.index, dtype=object)


class RankTokenizer:
    """Byte-level BPE by a file of ranks and a splitting pattern, as tiktoken encodes; loaded once a worker."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.fingerprint = path, pattern, f"ranks-{path}-{pattern}"

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("path", "pattern", "fingerprint")}

    def ends(self, texts: pd.Series) -> pd.Series:
        if "made" not in self.__dict__:
            import tiktoken
            from tiktoken.load import load_tiktoken_bpe

            self.made = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=load_tiktoken_bpe(self.path), special_tokens={})
        out = []
        for text in texts:
            raw = np.frombuffer(text.encode(), np.uint8)
            tokens = np.cumsum([len(t) for t in self.made.decode_tokens_bytes(self.made.encode_ordinary(text))], dtype=np.int64)
            begins = (raw & 0xC0) != 0x80
            before = np.append(0, np.cumsum(begins))
            # a token that ends within a character leaves this one to the next token
            out.append(before[tokens] - ~np.append(begins, True)[tokens])
        return pd.Series(out, index=texts.index, dtype=object)


_LOADED: dict[str, object] = {}


def _loaded(name: str, raw) -> object:
    """A function of the module, so that workers share the module's own dictionary."""
    from pyspark import cloudpickle

    if name not in _LOADED:
        _LOADED[name] = cloudpickle.loads(raw.value)
    return _LOADED[name]


def shared(spark: SparkSession, model) -> Callable[[], object]:
    """What gives the model inside a task. It is sent to each executor once and unpickled once a Python worker, however many tasks that runs."""
    from pyspark import cloudpickle

    name, raw = model_name(model), spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: _loaded(name, raw)


def embed(df: DataFrame, embedder: Embedder, column: str = "text", name: str = "vec", store: str | None = None) -> DataFrame:
    """df with the vectors of a column; null reads as no text. With a store each different text goes through the model once, in all runs."""
    model = shared(df.sparkSession, embedder)

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield model().encode(batch.fillna(""))

    if store is None:
        return df.withColumn(name, encode(column))
    make = lambda new: new.select("key", encode("text").alias("vec"))
    return _by_content(df, F.coalesce(F.col(column), F.lit("")), f"{store.rstrip('/')}/vectors/{_folder_name(model_name(embedder))}", "vec array<double>", make, {"vec": name})


def _folder_name(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:24]


def _stored(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The table of `key` and columns at path; empty where nothing was written."""
    try:
        return spark.read.schema(f"key string, {columns}").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"key string, {columns}")


def _by_content(df: DataFrame, text: Column, path: str, columns: str, make: Callable[[DataFrame], DataFrame], names: dict[str, str], slice_rows: int | None = None) -> DataFrame:
    """df with what make() gives for a text, from a table by the text's hash; only texts that it lacks are made and added, each once.

    With slice_rows they are made in parts of about so many, so that what breaks
    off loses one part at most.
    """
    spark, key = df.sparkSession, "_content"
    keyed = df.withColumn(key, F.sha2(text, 256))
    lacking = keyed.select(F.col(key).alias("key"), text.alias("text")).dropDuplicates(["key"]).join(_stored(spark, path, columns).select("key"), "key", "left_anti")
    n = lacking.count()
    parts = 1 if slice_rows is None else -(-n // slice_rows)
    for k in range(parts if n else 0):
        part = lacking if parts == 1 else lacking.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        make(part).write.mode("append").parquet(path)
    known = _stored(spark, path, columns).dropDuplicates(["key"]).withColumnRenamed("key", key)  # two writers may have made the same
    for of, to in names.items():
        known = known.withColumnRenamed(of, to)
    return keyed.join(known, key, "left").drop(key)


def embed_lists(df: DataFrame, embedder: Embedder, column: str, name: str) -> DataFrame:
    """df with the vectors of each text of an array column; the texts of a batch are encoded together."""

    model = shared(df.sparkSession, embedder)

    @F.pandas_udf("array<array<double>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            flat = list(model().encode(pd.Series([t for texts in batch for t in texts], dtype=object)))
            ends = np.cumsum([len(texts) for texts in batch])
            yield pd.Series([flat[e - len(texts) : e] for e, texts in zip(ends, batch, strict=True)])

    return df.withColumn(name, encode(column))


def rescore(pairs: DataFrame, reranker: Reranker) -> DataFrame:
    """pairs (question, text) with `rerank_score`."""

    model = shared(pairs.sparkSession, reranker)

    @F.pandas_udf("double")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            yield model().predict(questions, texts)

    return pairs.withColumn("rerank_score", predict("question", "text"))


def extractive_answer(question: Column, text: Column) -> Column:
    """The sentence of a text that shares most words with the question, the first of equals; the stand-in for a generator."""
    rated = let(F.array_distinct(terms(question)), lambda asked: F.transform(sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(terms(s), asked)).alias("n"), (-i).alias("i"), s.alias("s"))))
    return F.coalesce(F.array_max(rated)["s"], F.lit(""))


#: Calls that a task has under way at once, tries of a call, the first pause between tries, and prompts of a part that is written before the next one is asked.
IN_FLIGHT, TRIES, PAUSE, PART_PROMPTS = 8, 5, 0.5, 4096


def ask(llm: LLMConfig, message: str, timeout: float, tries: int = TRIES, pause: float = PAUSE) -> tuple[str, float]:
    """(answer, milliseconds of the call that gave it). A server that is busy or away is tried again after pauses that double; other failures raise at once."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {llm.api_key}"} if llm.api_key else {})
    body = json.dumps({"model": llm.model, "temperature": 0.1, "messages": [{"role": "user", "content": message}]}).encode()
    for k in range(tries):
        began = time.perf_counter()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{llm.base_url.rstrip('/')}/chat/completions", body, headers), timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"] or "", (time.perf_counter() - began) * 1000
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            final = isinstance(e, urllib.error.HTTPError) and e.code not in (408, 429) and e.code < 500
            if final or k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError("no try was made")


def chat_answers(rows: DataFrame, llm: LLMConfig, prompt: str = PROMPT, timeout: float = 120.0, store: str | None = None, in_flight: int = IN_FLIGHT) -> DataFrame:
    """rows (with question, context) with `answer` and `generation_latency_ms` from an OpenAI-compatible server.

    A task has up to in_flight calls under way. Equal prompts are asked once; with a
    store answers are kept there by the prompt's hash and the model's name and address, in parts, so a run
    that breaks off, and a later one, asks only for what is lacking. Failures
    that stay raise, so that Spark retries the task.
    """
    message = F.replace(F.replace(F.lit(prompt), F.lit("{question}"), F.coalesce("question", F.lit(""))), F.lit("{context}"), F.coalesce("context", F.lit("")))
    columns = "answer string, generation_latency_ms double"

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                got = list(pool.map(lambda m: ask(llm, m, timeout), batch["text"]))
                yield pd.DataFrame({"key": batch["key"], "answer": [a for a, _ in got], "generation_latency_ms": [ms for _, ms in got]})

    make = lambda new: new.select("key", "text").mapInPandas(answer, f"key string, {columns}")
    if store is None:
        keyed = rows.withColumn("_content", F.sha2(message, 256))
        asked = keyed.select(F.col("_content").alias("key"), message.alias("text")).dropDuplicates(["key"])
        return keyed.join(make(asked).withColumnRenamed("key", "_content"), "_content", "left").drop("_content")
    path = f"{store.rstrip('/')}/answers/{_folder_name(f'{llm.base_url} {llm.model}')}"
    return _by_content(rows, message, path, columns, make, {}, PART_PROMPTS)
