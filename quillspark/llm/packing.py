"""Sum-of-squares packing of token sequences.

With N(g) the number of open sequences that have a gap of g tokens, each piece
goes where the sum of N(g)^2 over all gaps becomes smallest: into an open
sequence, or into a new one. Pieces come longest first.

Pieces are dealt by a hash into groups of a fixed mean size, one task each, so
no task's work follows the corpus; what stays ill filled in its group is taken
apart and packed again with such pieces of other groups.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import group_count, map_batches, settle, table, text_slices

CAPACITY = 2048
#: Mean pieces of a group, and the share of a sequence that may stay empty before its pieces are packed again.
GROUP_PIECES, LOOSE = 2048, 0.005
#: Words that a worker remembers before it starts afresh.
MEMORY_PIECES = 800_000
#: The tokenizer's own splitting, for texts of U+0000 to U+00FF, where letters, numbers and white space are these.
_LETTER, _NUMBER, _WHITE = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_WHITE}{_LETTER}{_NUMBER}]+"


class WordIds:
    """Token ids of texts, as bytes; the ids of frequent words are remembered, so that each is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold a token which the tokenizer knows as a whole are left to it.
        self.whole = re.compile("|".join(re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.split = re.compile(SPLIT).findall
        self.memory: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, owner = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, dtype=np.int64)
        cuts = [0, *(4 * (np.flatnonzero(np.diff(owner)) + 1)).tolist(), len(ids)]
        if len(cuts) == len(words) + 1:
            self.memory.update(zip(words, (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        else:  # a word that the joined text would split otherwise
            for w in words:
                self.memory[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        memory, new = self.memory, []
        pieces: list[list[str] | None] = []
        for x in texts:
            try:
                x.encode("latin-1")
                low = x.lower()
                pieces.append(None if self.whole(low) else self.split(low))
                new += [p for p in pieces[-1] or () if p not in memory]
            except UnicodeEncodeError:
                pieces.append(None)
        if new:
            new = set(new)
            if len(memory) + len(new) > MEMORY_PIECES:
                memory.clear()
                new = {p for ps in pieces for p in ps or ()}
            self._learn(list(new))
        get = memory.__getitem__
        return [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() if p is None else b"".join(map(get, p)) for x, p in zip(texts, pieces, strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut every `capacity` tokens.

    A null or empty text is the end id alone. Rows with equal doc_id are each
    cut on their own.
    """

    def make():
        coder = word_ids(path)

        def step(batch):
            keys = batch.column("doc_id").to_pylist()
            for at, raws in text_slices(batch, limit=4 << 20):
                rows = []
                for k, ids in enumerate(coder.encode_many([x.decode() for x in raws])):
                    ids += int(end_id).to_bytes(4, "little")
                    n = len(ids) // 4
                    rows += [(keys[at + k], p, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for p, s in enumerate(range(0, n, capacity))]
                cols = list(zip(*rows, strict=True))
                yield {n: pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(("doc_id", "piece", "start", "length", "ids_crc32"), cols, strict=True)}

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the order given."""
    n_gap = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        # placing into gap g changes the sum by 2 * (N(g - s) - N(g) + 1), where a gap of 0 counts nothing
        change = 2 * (n_gap[: capacity + 1 - s] - n_gap[s:] + 1)
        change[0] = 1 - 2 * n_gap[s]
        change[n_gap[s:] == 0] = np.iinfo(np.int64).max
        g = int(np.argmin(change))
        if change[g] <= (2 * n_gap[capacity - s] + 1 if s < capacity else 0):
            gap = g + s
            at = open_at[gap].pop()
            n_gap[gap] -= 1
        else:
            gap, at = capacity, len(filled)
            filled.append(0)
        sequence[k], offset[k] = at, filled[at]
        filled[at] += s
        if gap > s:
            n_gap[gap - s] += 1
            open_at[gap - s].append(at)
    return sequence, offset


def _pack_groups(pieces: DataFrame, groups: int, capacity: int, part: int) -> DataFrame:
    """Pack each group by itself; sequence ids hold the pass, the group and the place in it. Adds `fill`."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        fill = np.bincount(sequence, weights=rows["length"].to_numpy()).astype("i8")
        return rows.assign(sequence_id=(part << 62) | (int(key[0]) << 24) | sequence, offset=offset, fill=fill[sequence]).drop(columns="packing_group")

    dealt = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(part)), F.lit(groups)))
    return dealt.groupBy("packing_group").applyInPandas(pack, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. Every piece is placed once; an empty table stays empty."""
    pieces = settle(pieces)
    first = settle(_pack_groups(pieces, group_count(pieces.count(), GROUP_PIECES), capacity, 0))
    loose = F.col("fill") < int(capacity * (1 - LOOSE))
    again = first.where(loose).select(*pieces.columns)
    second = _pack_groups(again, group_count(again.count(), GROUP_PIECES // 4), capacity, 1)
    return first.where(~loose).unionByName(second).drop("fill")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack documents: null texts are empty, long ones are cut, no token is lost or repeated."""
    return pack(token_pieces(docs, path, capacity), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
