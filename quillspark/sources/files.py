"""Sources and sinks: Markdown corpora, YAML questions, JSON-lines results, CSV summaries, reports, vector stores."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions.text import quantised
from quillspark.schemas import OPTIONAL_RESULTS, QUESTIONS, RESULTS


def read_corpus(spark: SparkSession, folder: str, suffix: str = ".md") -> DataFrame:
    """source_file (path below the folder), text of all files with the suffix, at any depth; CR LF reads as LF."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    below = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"^\w+:/*", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/" if folder.startswith(("/", "file:")) else None
    name = F.substring(below, len(root) + 1, 1 << 20) if root else F.element_at(F.split(below, F.lit("/")), -1)
    return files.select(name.alias("source_file"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The question set of a YAML file: a list, or a mapping that holds one under `questions`. distractors and key_facts may lack."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    rows = data["questions"] if isinstance(data, dict) else data
    keys = ("id", "question", "gold_answer", "gold_source_ids", "distractors", "key_facts", "category", "difficulty")
    return spark.createDataFrame([tuple(r.get(k) if k == "distractors" else r.get(k, []) if k == "key_facts" else r[k] for k in keys) for r in rows], QUESTIONS)


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines, nulls kept; replaces what is there."""
    results.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results under a fixed schema; unknown or missing keys and wrong types raise once rows are read."""
    schema = StructType.fromDDL(RESULTS)
    lines = spark.read.text(path).where("value != ''")
    keys = F.json_object_keys("value")
    known, needed = F.array(*map(F.lit, schema.names)), F.array(*[F.lit(n) for n in schema.names if n not in OPTIONAL_RESULTS])
    strange, lacking = F.array_except(keys, known), F.array_except(needed, keys)
    wrong = keys.isNull() | (F.size(strange) > 0) | (F.size(lacking) > 0)
    note = F.concat(F.lit("unknown keys: "), F.array_join(strange, ", "), F.lit("; missing keys: "), F.array_join(lacking, ", "))
    checked = F.when(wrong, F.raise_error(F.coalesce(note, F.lit("not a JSON object"))).cast("string")).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_summary(summaries: DataFrame, path: str) -> bool:
    """One CSV file with a header, best first; nothing is written for no rows. Returns whether it wrote."""
    if summaries.isEmpty():
        return False
    ordered = summaries.orderBy(quantised(F.col("avg_gold_similarity"), 9).desc(), "config_name")
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row for each configuration
    return True


def corpus_fingerprint(docs: DataFrame, settings: str) -> str:
    """Changes with any text, name or setting; order doesn't matter."""
    x = docs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("source_file", "text").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{x['n']}:{x['s']}:{settings}".encode()).hexdigest()[:16]


def files_fingerprint(spark: SparkSession, paths: list[str], settings: str) -> str:
    """Changes with any name, size or time of the Parquet files at the paths, or a setting; of the files only their footers are read."""
    sums = []
    for path in paths:
        files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        x = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")).alias("s")).first()
        sums.append((path, x["n"], str(x["s"])))
    return hashlib.sha256(f"{sums!r}:{settings}".encode()).hexdigest()[:16]


def kept(spark: SparkSession, path: str, build: Callable[[], DataFrame], *partition: str) -> DataFrame:
    """The table at path, written with build() where there is none. A small table beside it marks it as whole; what was left half-written is written anew."""
    try:
        spark.read.schema("id long").parquet(f"{path}.whole")
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").partitionBy(*partition).parquet(path)
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.whole")
    return spark.read.parquet(path)


def stored(spark: SparkSession, folder: str, docs: DataFrame, settings: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, kept in the folder by the corpus's fingerprint, a part for each strategy; a changed corpus is built anew."""
    return kept(spark, f"{folder.rstrip('/')}/{corpus_fingerprint(docs, settings)}", build, "strategy")


def preview(hits: DataFrame, chunks: DataFrame, length: int = 300) -> DataFrame:
    """rank, source, score and the beginning of each hit's text, for the console."""
    joined = hits.join(chunks.select("strategy", "source_file", "chunk_index", "text"), ["strategy", "source_file", "chunk_index"])
    shown = F.when(F.length("text") > length, F.concat(F.substring("text", 1, length), F.lit("..."))).otherwise(F.col("text"))
    return joined.select("config_name", "question_id", "rank", "source_file", "chunk_index", F.format_string("%.4f", "score").alias("score"), shown.alias("preview"))


def clean(folder: str, names=("results", "indexes", "parts", "models")) -> list[str]:
    """Remove the engine's own output below a local folder; returns what was removed."""
    import shutil

    gone = [p for n in names if (p := Path(folder) / n).is_dir() and not p.is_symlink()]
    for p in gone:
        shutil.rmtree(p)
    return [str(p) for p in gone]
