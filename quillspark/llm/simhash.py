"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into k blocks. Two fingerprints that differ in d bits or
fewer agree in at least k - d blocks, so each choice of k - d blocks is a join
key, and every close pair meets under one of them; there the Hamming distance
is verified. k grows with the number of distinct fingerprints, so that a key
stays selective. Very full keys are cut into chunks whose pairs are dealt to
different tasks, and a task returns links that keep its components together
instead of all its pairs.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ASCII_LOWER, components, fresh_name, group_count, map_batches, minimum_labels, settle, table

BITS = 3
SHINGLE = 3
#: Fingerprints of one key that one task compares, and mean rows of a group of keys.
CHUNK, GROUP_ROWS = 512, 6000


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in more than half the shingles' hashes; no words: 0."""
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=42)
    n = len(words) - shingle + 1
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), joined), "<u8", n)
    ones = np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp (the 64 bits as a signed long) of every whole text; null reads as empty. text_key tells texts of one doc_id apart."""

    def make():
        def step(batch):
            texts = batch.column("text").cast(pa.binary())
            fps = [fingerprint((x.as_py() or b"").translate(ASCII_LOWER).split(), shingle) for x in texts]
            yield {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "fp": pa.array(np.array(fps, "u8").view("i8"))}

        return step

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "doc_id long, text_key long, fp long", make)


def block_masks(blocks: int, agree: int) -> list[int]:
    """The masks, as signed longs, of every choice of `agree` of the blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [int(np.array(sum(part[k] for k in c), "u8").view("i8")) for c in combinations(range(blocks), agree)]


def blocks_for(n: int, bits: int = BITS) -> int:
    """Blocks such that a key of random fingerprints holds few of n: 16 bits of key up to 2^18, then about 26, then 32."""
    return bits + 1 if n <= 1 << 18 else bits + 2 if n <= 1 << 26 else bits + 3


def close_links(classes: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """(u, v) links that join all nodes of (node, fp), fp distinct, that are linked through fingerprints at most `bits` apart."""
    blocks = blocks_for(n, bits)
    masks = block_masks(blocks, blocks - bits)
    keys = classes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for j, m in enumerate(masks)])).alias("k")).select("node", "fp", "k.j", "k.part")
    full = keys.groupBy("j", "part").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1")
    cut = keys.join(full, ["j", "part"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    met = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.withColumn("cell", F.xxhash64("j", "part", F.least("own", "other"), F.greatest("own", "other")))
    dealt = met.select("node", "fp", "cell", F.pmod(F.xxhash64("cell", F.lit(7)), F.lit(group_count(n * len(masks), GROUP_ROWS))).alias("g"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(rows["cell"].to_numpy(), kind="stable")
        cell, fp, node = (rows[c].to_numpy()[order] for c in ("cell", "fp", "node"))
        fp = fp.view("u8")
        us, vs, left = [], [], np.arange(len(cell))
        for d in range(1, len(cell)):
            left = left[left + d < len(cell)]
            left = left[cell[left] == cell[left + d]]
            if not len(left):
                break
            near = left[np.bitwise_count(fp[left] ^ fp[left + d]) <= bits]
            us.append(node[near])
            vs.append(node[near + d])
        if not us:
            return pd.DataFrame({"u": np.empty(0, "i8"), "v": np.empty(0, "i8")})
        nodes, low = minimum_labels(np.concatenate(us), np.concatenate(vs))
        return pd.DataFrame({"u": nodes, "v": low})[nodes != low]

    return dealt.groupBy("g").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, text_key, fp, group, component_id of every row: the component, by its smallest linked fingerprint and by the smallest doc_id that links reach.

    Equal fingerprints are one node, whatever the number of rows; texts that only
    share a doc_id are not linked by that. Empty and null
    texts have fingerprint 0. A null doc_id gets the component of its equals
    (null if it has none). Other columns are not carried; an empty table gives
    an empty one.
    """
    fps = settle(fingerprints(docs, shingle))
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).where("least is not null"))
    found = components(close_links(classes.select(F.col("fp").alias("node"), "fp"), classes.count(), bits)).withColumnRenamed("node", "fp")
    grouped = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    named = grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group").drop("least")
    return fps.join(named, "fp", "left").select("doc_id", "text_key", "fp", "group", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of docs for each component, that with its smallest doc_id; all columns stay. Rows without doc_id stay.

    Of texts that share the smallest doc_id of a component that with the smallest
    hash stays, and of rows that repeat doc_id and text any one.
    """
    found = settle(near_duplicates(docs, shingle, bits).where("doc_id is not null").groupBy("doc_id", "text_key", "group", "component_id").agg(F.count("*").alias("rows")))
    named, others = found.where("doc_id = component_id"), found.where("doc_id != component_id").select("doc_id", "text_key")
    named = named.join(named.groupBy("group").agg(F.min("text_key").alias("first")), "group")  # rows of the smallest doc_id alone, few a group
    gone = others.unionByName(named.where("text_key != first").select("doc_id", "text_key"))
    repeated = named.where("text_key = first and rows > 1").select("doc_id", "text_key")
    key = fresh_name(docs, "text_key")
    on = ["doc_id", key]
    kept = docs.withColumn(key, F.xxhash64("text")).join(gone.withColumnRenamed("text_key", key), on, "left_anti")
    if not repeated.isEmpty():
        again = repeated.withColumnRenamed("text_key", key)
        kept = kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates(on))
    return kept.select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
