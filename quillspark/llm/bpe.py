"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can come last
in the prefix's BPE encoding. PrefixEncoding stores that token per prefix, so
appending bytes extends the table, and an edit only renews the entries that it
can reach. Two tokens may stand side by side exactly if, while each of them is
built from bytes by its merges in rank order, no merge over their border would
come first.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import map_batches, table

#: Unicode's White_Space, written out: what \s means to the tokenizer's own engine.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Pieces that a worker remembers before it starts afresh, and the longest of them.
MEMORY_PIECES, MEMORY_LENGTH = 600_000, 64
NEVER = 1 << 60


def split_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


class Vocabulary:
    """Ranks of a byte-level BPE, and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, k in ranks.items():
            self.token[k] = raw
        self.longest = max(map(len, ranks), default=1)
        self._edges: dict[bytes, tuple[list[bytes], list[bytes]]] = {}
        self._fits: dict[int, bool] = {}

    def _halves(self, raw: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes the token."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if best == NEVER:
                break
        return parts[0], b"".join(parts[1:])

    def edges(self, raw: bytes) -> tuple[list[bytes], list[bytes]]:
        """What stands at the token's left end, and at its right end, as its merges go on."""
        if raw not in self._edges:
            if len(raw) == 1:
                self._edges[raw] = ([raw], [raw])
            else:
                a, b = self._halves(raw)
                self._edges[raw] = (self.edges(a)[0] + [raw], self.edges(b)[1] + [raw])
        return self._edges[raw]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        key = left << 32 | right
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._border_holds(self.edges(self.token[left])[1], self.edges(self.token[right])[0])
        return known

    def extend(self, raw: bytes, last: list[int], stop: int | None = None) -> None:
        """Fill last up to the prefix of `stop` bytes (all of raw): the loop that every encoding spends its time in."""
        get, known, longest = self.rank.get, self._fits.get, self.longest
        for i in range(len(last), (len(raw) if stop is None else stop) + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = get(raw[j:i])
                if t is not None:
                    if not j:
                        break
                    fit = known(last[j] << 32 | t)
                    if self.fits(last[j], t) if fit is None else fit:
                        break
            else:
                raise ValueError("a byte is missing in the vocabulary")
            last.append(t)

    def _border_holds(self, ends: list[bytes], starts: list[bytes]) -> bool:
        rank, i, j = self.rank, 0, 0
        while True:
            across = rank.get(ends[i] + starts[j], NEVER)
            next_end = rank[ends[i + 1]] if i + 1 < len(ends) else NEVER
            next_start = rank[starts[j + 1]] if j + 1 < len(starts) else NEVER
            # of equal ranks the leftmost merge comes first
            if across < next_end and across <= next_start and across != NEVER:
                return False
            if next_end == next_start == NEVER:
                return True
            if next_end <= next_start:
                i += 1
            else:
                j += 1


class PrefixEncoding:
    """The encoding of one piece, kept open: last[i] is the last token of the first i bytes."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", [-1]
        self.append(raw)

    def append(self, more: bytes) -> PrefixEncoding:
        self.raw += more
        self.vocabulary.extend(self.raw, self.last)
        return self

    def edit(self, start: int, stop: int, new: bytes) -> PrefixEncoding:
        """Replace bytes start to stop. Entries before stay; renewing ends once a whole token length agrees with the old table."""
        raw, old = self.raw[:start] + new + self.raw[stop:], self.last
        last, shift, same = old[: start + 1], len(new) - (stop - start), 0
        for i in range(start + 1, len(raw) + 1):
            self.vocabulary.extend(raw, last, i)
            back = i - shift
            clear = i - self.vocabulary.longest >= start + len(new)
            same = same + 1 if clear and last[i] == old[back] else 0
            if same > self.vocabulary.longest:
                last += old[back + 1 :]
                break
        self.raw, self.last = raw, last
        return self

    def ids(self) -> list[int]:
        out, i = [], len(self.raw)
        while i:
            out.append(self.last[i])
            i -= len(self.vocabulary.token[self.last[i]])
        return out[::-1]


class PieceMemory(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        k = self.vocabulary.rank.get(raw)
        ids = PrefixEncoding(self.vocabulary, raw).ids() if k is None else [k]
        out = np.array(ids, "<u4").tobytes()
        if len(piece) <= MEMORY_LENGTH:
            if len(self) >= MEMORY_PIECES:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class ByteBPE:
    """Encoder and decoder of whole texts: each match of the pattern is encoded separately."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        self.pieces = regex.compile(split_pattern(pattern)).findall
        self.memory = PieceMemory(vocabulary)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.pieces(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>): the token ids of every whole text.

    A null text reads as empty and gives no ids, as an empty one does; repeated
    rows give repeated rows; other columns are not carried, so their names
    cannot clash; an empty table gives an empty one. `path` names the rank file
    on every executor.
    """

    def make():
        c = coder(path, pattern)

        def step(batch):
            texts = batch.column("text")
            for k in range(0, len(texts), 64):
                ids = [c.encode(x.as_py() or "") for x in texts[k : k + 64]]
                ends = np.cumsum([0] + [len(x) for x in ids]).astype("i4")
                yield {"key": batch.column("key")[k : k + 64], "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype("i4")))}

        return step

    kind = dict(docs.dtypes)[key]
    return map_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")), f"key {kind}, ids array<int>", make).withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, decoded binary) of (key, ids array<int>); null ids decode to no bytes."""

    def make():
        c = coder(path, pattern)

        def step(batch):
            for k in range(0, batch.num_rows, 64):
                rows = batch.column("ids")[k : k + 64]
                yield {"key": batch.column("key")[k : k + 64], "decoded": pa.array([c.decode(np.array(x.as_py() or [], "i4")) for x in rows], pa.binary())}

        return step

    kind = dict(encoded.dtypes)[key]
    return map_batches(encoded.select(encoded[key].alias("key"), "ids"), f"key {kind}, decoded binary", make).withColumnRenamed("key", key)


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode the ids, and digest both in the same pass.

    Only digests leave the worker, so the ids of a corpus never cross to the JVM.
    Nulls and empty texts have no tokens and the digests of nothing.
    """

    def make():
        c = coder(path, pattern)

        def step(batch):
            n, ids_sha, text_sha = [], [], []
            for x in batch.column("text"):
                ids = c.encode(x.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
