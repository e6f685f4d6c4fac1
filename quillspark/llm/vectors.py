"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a rotation they are cut
into blocks; if each block gets a share of the squared distance in proportion to
its dimensions, a linked pair keeps to the share in at least one block. There
the vectors are joined by range: a grid over the block's leading coordinates, of
which larger tables use more, brings together what may lie within reach. The union of the candidates is
verified by the exact cosine, and a pair counts in the first block only whose
share it keeps to, so that links can be counted without listing pairs.

Equal vectors are one class with a count. Cells with very many vectors are cut
into chunks whose pairs are dealt to different tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import components, group_count, map_batches, minimum_labels, settle, settle_table, table

COSINE = 0.93
BLOCK_DIMS = 8
#: Vectors of one cell that one task compares, mean rows of a group of cells, and query rows at a time.
CHUNK, GROUP_ROWS, STRIP = 4096, 8192, 512
#: What rounding may add to a squared distance.
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int) -> list[int]:
    n = max(1, dims // BLOCK_DIMS)
    return [round(dims * k / n) for k in range(n + 1)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def classes_of(vectors: DataFrame) -> DataFrame:
    """label, embedding, least (smallest vec_id), copies, node: the distinct vectors that can link. node is an id of the vector's own, as vectors may share a vec_id; it holds once the table is settled."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite)
    return valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())


def grid_dims(largest: int) -> int:
    """Leading coordinates of a block that its grid uses: one more for each factor of 8 by which the largest label grows, as each leaves about half of a label to compare."""
    return min(BLOCK_DIMS, 2 + max(0, -(-((max(largest, 1) - 1) >> 15).bit_length() // 3)))


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ (x.astype("i8").view("u8") + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def cells(classes: DataFrame, cosine: float = COSINE, leads: int = 2) -> DataFrame:
    """cell, block, home, node: each class in its own grid cell of each block (home), and in those after it that its reach touches. Vectors are not carried along.

    A cell is wider than twice the reach, so on each axis a vector touches its
    own cell and the nearer neighbour. Of two vectors in different cells that
    are within reach, one is in the other's cell, that of the smaller cell; so
    each pair meets once a block.
    """
    far = 2 - 2 * cosine + SLACK

    def make():
        def step(batch):
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            label = batch.column("label").to_pylist()
            base = {x: np.uint64(xxhash.xxh3_64_intdigest(repr(x))) for x in set(label)}
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                x = _unit(flat[starts[rows][:, None] + np.arange(dims)]) @ rotation(int(dims))
                edges, own_label = block_edges(int(dims)), np.array([base[label[k]] for k in rows])
                out: list[tuple[np.ndarray, int, bool, np.ndarray]] = []
                for b in range(len(edges) - 1):
                    reach = np.sqrt(far * (edges[b + 1] - edges[b]) / dims)
                    lead = x[:, edges[b] : min(edges[b + 1], edges[b] + leads)] / (2 * reach * (1 + 1e-6))
                    own = np.floor(lead).astype(np.int64)
                    side = np.where(lead - own < 0.5, -1, 1)
                    for mask in range(1 << lead.shape[1]):
                        bits = [c for c in range(lead.shape[1]) if mask >> c & 1]
                        use = side[:, bits[0]] > 0 if bits else np.ones(len(rows), bool)
                        h = _mixed(_mixed(own_label[use], np.full(use.sum(), dims)), np.full(use.sum(), b))
                        for c in range(lead.shape[1]):
                            h = _mixed(h, own[use, c] + (side[use, c] if c in bits else 0))
                        out.append((h.view("i8"), b, not bits, rows[use]))
                n = [len(x[0]) for x in out]
                yield {
                    "cell": pa.array(np.concatenate([x[0] for x in out])), "block": pa.array(np.repeat([x[1] for x in out], n), pa.int32()), "home": pa.array(np.repeat([x[2] for x in out], n)),
                    "node": batch.column("node").take(pa.array(np.concatenate([x[3] for x in out]))),
                }

        return step

    return map_batches(classes.select("label", "embedding", "node"), "cell long, block int, home boolean, node long", make)


def _compare(raw: np.ndarray, node: np.ndarray, home: np.ndarray, asks: np.ndarray, answers: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, answer) of the pairs that link and that count in this block; two home rows meet once, by their nodes."""
    dims = raw.shape[1]
    edges = block_edges(dims)
    share = [(2 - 2 * cosine + SLACK) * (edges[k + 1] - edges[k]) / dims for k in range(len(edges) - 1)]
    norm = np.sqrt((raw * raw).sum(axis=1))
    turned = ((raw / norm[:, None]) @ rotation(dims)[:, edges[block] : edges[block + 1]]).astype(np.float32)
    half, one = (turned * turned).sum(1)[:, None] / 2, np.ones((len(raw), 1), np.float32)
    # one product gives x.y - |x|^2 / 2 - |y|^2 / 2; single precision only widens what is verified
    x, y = np.hstack([turned, -half, one])[asks], np.hstack([turned, one, -half])[answers].T.copy()
    asks, answers = np.flatnonzero(asks), np.flatnonzero(answers)
    us, vs = [], []
    for s in range(0, len(asks), STRIP):
        i, j = np.divmod(np.flatnonzero(x[s : s + STRIP] @ y >= -share[block] / 2 - 2e-6), len(answers))
        i, j = asks[i + s], answers[j]
        once = ~home[i] | (node[i] < node[j])
        i, j = i[once], j[once]
        if not len(i):
            continue
        cos = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j])
        i, j = i[cos >= cosine], j[cos >= cosine]
        gap = ((raw[i] / norm[i, None] - raw[j] / norm[j, None]) @ rotation(dims)) ** 2
        first = np.ones(len(i), bool)
        for k in range(block + 1):
            kept = gap[:, edges[k] : edges[k + 1]].sum(1) <= share[k]
            first &= kept if k == block else ~kept
        us.append(i[first])
        vs.append(j[first])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, int), np.empty(0, int))


def meetings(classes: DataFrame, placed: DataFrame) -> DataFrame:
    """key, block, home, node, asks, answers: the rows that compare with each other. Cells with very many vectors are cut into chunks, and each pair of chunks is a key of its own."""
    full = placed.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1")
    cut = placed.join(full, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    # as a query against the other chunk's home rows, and as a home row for the other chunk's queries
    same = F.col("own") == F.col("other")
    one = F.struct(F.xxhash64("cell", "own", "own").alias("key"), F.lit(True).alias("asks"), F.col("home").alias("answers"))
    asks = F.struct(F.xxhash64("cell", "own", "other").alias("key"), F.lit(True).alias("asks"), F.lit(False).alias("answers"))
    answers = F.struct(F.xxhash64("cell", "other", "own").alias("key"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    two = F.when(F.col("home"), F.array(asks, answers)).otherwise(F.array(asks))
    return cut.withColumn("role", F.explode(F.when(same, F.array(one)).otherwise(two))).select("block", "home", "node", "role.*")


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """u, v, links: rows with v join the components together; rows without count the links that u has."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    placed = settle_table(cells(classes, cosine, grid_dims(largest)))
    met = meetings(classes, placed).join(classes.select("node", "copies", "embedding"), "node")
    dealt = met.withColumn("g", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(group_count(placed.count(), GROUP_ROWS))))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        key, block, node, copies = (rows[c].to_numpy() for c in ("key", "block", "node", "copies"))
        home, asks, answers = (rows[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "asks", "answers"))
        lists = rows["embedding"].chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.float32()))
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        order = np.lexsort((block, key))
        cuts = np.flatnonzero((key[order[1:]] != key[order[:-1]]) | (block[order[1:]] != block[order[:-1]])) + 1
        us, vs = [], []
        for part in np.split(order, cuts):
            if not (asks[part].any() and answers[part].any()) or len(part) < 2:
                continue
            dims = starts[part[0] + 1] - starts[part[0]]
            raw = flat[starts[part][:, None] + np.arange(dims)].astype(np.float64)
            i, j = _compare(raw, node[part], home[part], asks[part], answers[part], int(block[part[0]]), cosine)
            us.append(part[i])
            vs.append(part[j])
        u, v = (np.concatenate(x) if x else np.empty(0, int) for x in (us, vs))
        nodes, low = minimum_labels(node[u], node[v])
        linked, at = np.unique(np.concatenate([node[u], node[v]]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([copies[v], copies[u]]), minlength=len(linked)).astype("i8")
        star = nodes != low
        return pa.table({
            "u": pa.array(np.concatenate([nodes[star], linked]), pa.int64()), "v": pa.array(np.concatenate([low[star], np.zeros(len(linked), "i8")]), pa.int64(), mask=np.arange(star.sum() + len(linked)) >= star.sum()),
            "links": pa.array(np.concatenate([np.zeros(star.sum(), "i8"), count]), pa.int64()),
        })

    return settle(dealt.groupBy("g").applyInArrow(compare, "u long, v long, links long"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors with a null label, null, zero or with null or non-finite components
    link with nothing. Vectors of different length never link. Rows that repeat
    a vec_id count as vectors of their own. Other columns are not carried.
    """
    classes = settle(classes_of(vectors))
    found = links(classes, cosine)
    named = components(found.where("v is not null").select("u", "v"))
    counts = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    # links lead to a smallest node; what counts is the smallest vec_id among the nodes that lead there
    linked = classes.select("node", "least").join(named, "node")
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    named = linked.select("node", "component").join(smallest, "component").select("node", "smallest")
    known = classes.join(named, "node", "left").join(counts.withColumnRenamed("u", "node"), "node", "left")
    known = known.select("label", "embedding", F.coalesce("smallest", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = vectors.select("vec_id", "label", "embedding").join(known, ["label", "embedding"], "left")
    out = out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
