"""Substring dedup by relative Lempel-Ziv parsing.

Every document is a reference block for the documents with larger doc_id. The
index of a block holds anchors: in each window of 13 words, the run of 6 words
with the smallest hash (its seed). A window that two documents share has the same
anchor in both, so the index answers for every window, with about 0.22 entries a
word. An entry has the anchor's place in its block, a hash of the stretch that
the anchor's windows span, and a hash of all words before it, so that any words
between two anchors of a block have a hash too.

A document is parsed against the index: an anchor whose seed a smaller block
holds gives a source and a place in it. From there a factor goes on for as long
as the words up to a next anchor are the source's words, and it takes in whole
stretches that are the source's. Factors of 13 words or more are duplicate text.
Where a stretch is not the source's, at factors' borders mostly, another block
may still hold some of its windows, so these are looked up one by one.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SLICE_BYTES, fresh_name, map_batches, settle_table, table, text_slices

WINDOW = 13
ANCHOR = 6
_STEP = 0x9E3779B97F4A7C15
_SHORT = np.uint64((1 << 48) - 1)
_BACK = pow(_STEP, -1, 1 << 64)
#: Stands for no source in arrays.
_NONE = -(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Stretches:
    """Hashes of any run of words of a slice of texts: sums of word hashes times powers, moved to power 0."""

    def __init__(self, raws: list[bytes]):
        self.words = [r.split() for r in raws]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        total = int(self.first[-1])
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in self.words for w in ws), np.uint64, total)
        up = np.full(total + 1, _STEP, np.uint64)
        down = np.full(total + 1, _BACK, np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down, dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * np.cumprod(up, dtype=np.uint64)[:-1], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def before(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Hash of the words of a document before a place: the same in whatever slice the document is."""
        base = self.first[doc]
        return (self.sums[at] - self.sums[base]) * self.down[base] & _SHORT

    def anchors(self) -> tuple[np.ndarray, ...]:
        """(document in the slice, anchor, first and last start of its windows, seed, stretch), words counted over the slice."""
        total, reach = int(self.first[-1]), WINDOW - ANCHOR
        none = np.empty(0, np.int64)
        if total < WINDOW:
            return none, none, none, none, none.view("u8"), none.view("u8")
        at = np.arange(total - ANCHOR + 1)
        seed = self.hashes(at, at + ANCHOR)
        doc = np.repeat(np.arange(len(self.n)), self.n)
        starts = np.flatnonzero(doc[: total - WINDOW + 1] == doc[WINDOW - 1 :])
        best, arg = seed[starts], np.zeros(len(starts), np.int64)
        for k in range(1, reach + 1):
            other = seed[starts + k]
            less = other < best
            best = np.where(less, other, best)
            arg[less] = k
        where = starts + arg
        # windows of one anchor follow each other, as the leftmost smallest moves to the right only
        new = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else none
        anchor, low = where[new], starts[new]
        high = starts[np.append(new[1:], len(starts)) - 1] if len(new) else none
        return doc[anchor], anchor, low, high, seed[anchor] & _SHORT, (self.hashes(low, high + WINDOW) ^ _mix(seed[anchor])) & _SHORT


class Entries:
    """Columns of index entries, one for each document and seed; see index_entries."""

    names = ("seed", "doc_id", "source", "whole", "asked", "at", "mark", "stretch")

    def __init__(self, seed: np.ndarray, key: np.ndarray, at: np.ndarray, mark: np.ndarray, stretch: np.ndarray):
        order = np.lexsort((at, key, seed))
        seed, key, at, mark, stretch = (x[order] for x in (seed, key, at, mark, stretch))
        new = np.ones(len(seed), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        #: whether the document has the seed in several surroundings
        self.several = np.add.reduceat(stretch != np.repeat(stretch[first], np.diff(np.append(first, len(seed)))), first, dtype=np.int64) > 0 if len(first) else np.zeros(0, bool)
        self.seed, self.doc_id, self.at, self.mark, self.stretch = seed[first], key[first], at[first], mark[first], stretch[first]
        n = len(first)
        self.source, self.settled, self.whole, self.asked = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool), self.several.copy()

    def settle(self, part: slice, source: tuple) -> None:
        """Give entries a source, (doc_id, at, mark, stretch)."""
        self.source[part], self.settled[part] = source[0], True
        self.whole[part] = (self.stretch[part] == source[3]) & ~self.several[part]
        self.at[part], self.mark[part] = source[1], source[2]

    def open(self, k: int, own: tuple) -> None:
        """Undo what settle did to an entry, whose own (at, mark) are given: it asks in the index."""
        self.settled[k] = self.whole[k] = False
        self.asked[k], self.at[k], self.mark[k] = True, *own


class Sources:
    """Finds sources within a slice and, for seeds that a task has met in several documents, among what the task has met before.

    Remembered is the smallest document with the seed: its entry has been left
    open, and what it knows of others that ask (see index_entries).
    """

    def __init__(self, most: int = 1 << 16):
        self.most, self.known = most, {}

    def settle(self, *columns: np.ndarray) -> Entries:
        e = Entries(*columns)
        new = np.ones(len(e.seed), bool)
        new[1:] = e.seed[1:] != e.seed[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(e.seed)))
        for k, s, n in zip(first.tolist(), e.seed[first].tolist(), size.tolist(), strict=True):
            if n == 1 and s not in self.known:
                continue
            best, told = self.known.get(s, (None, False))
            mine = (int(e.doc_id[k]), int(e.at[k]), e.mark[k], e.stretch[k])
            if best and best[0] < mine[0]:
                part, own = slice(k, k + n), (e.at[k : k + n].copy(), e.mark[k : k + n].copy())
                e.settle(part, best)
                lacking = np.flatnonzero(~e.whole[part])
                if len(lacking) and not told:
                    j = int(lacking[0])
                    e.open(k + j, (own[0][j], own[1][j]))
                    self.known[s] = best, True
                continue
            if n > 1:
                e.settle(slice(k + 1, k + n), mine)
                e.asked[k] |= not e.whole[k + 1 : k + n].all()
            if not best or mine[0] < best[0]:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[s] = mine, bool(e.asked[k]) or told
        return e


def index_entries(docs: DataFrame) -> DataFrame:
    """key, seed, doc_id, source, whole, asked, at, mark, stretch: an entry for each block and seed, at the seed's first place.

    Where the task knows a smaller block with the seed, that is the source, at
    and mark are the source's, and whole says whether the stretch is the
    source's too. Other entries are open: they have no source yet, at and mark
    are their own, and asked says that windows of the seed will be looked up; the seed is
    the key. Entries with a source have nothing to look for and are dealt by keys
    of their own. So of a seed that very many documents hold, a task leaves few
    entries with its key.

    Seeds and marks keep 48 bits: a seed that two blocks share by chance leads to
    a source that the parse finds to be wrong, and to windows that are looked up.
    """

    def make():
        sources = Sources()

        def step(batch):
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, raws in text_slices(batch):
                s = Stretches(raws)
                doc, anchor, _, _, seed, stretch = s.anchors()
                e = sources.settle(seed, keys[row + doc].astype(np.int64), anchor - s.first[doc], s.before(anchor, doc), stretch)
                yield {
                    "key": pa.array(np.where(e.settled, _mix(e.seed + _mix(e.doc_id.view("u8"))), e.seed).view("i8")), "seed": pa.array(e.seed.view("i8"), mask=~e.settled), "doc_id": pa.array(e.doc_id), "source": pa.array(e.source, pa.int64(), mask=~e.settled), "whole": pa.array(e.whole), "asked": pa.array(e.asked), "at": pa.array(e.at, pa.int32()), "mark": pa.array(e.mark.view("i8")),
                    "stretch": pa.array(e.stretch.view("i8")),
                }

        return step

    return map_batches(docs.select("doc_id", "text").where("doc_id is not null"), "key long, seed long, doc_id long, source long, whole boolean, asked boolean, at int, mark long, stretch long", make)


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, found: (seed, source, whole, at, mark) for each seed of a block that a smaller block holds; source is null where it is the smallest itself and others will ask."""
    entries = index_entries(docs)
    every, ordered = Window.partitionBy("key"), Window.partitionBy("key").orderBy("doc_id")
    for c in ("doc_id", "at", "mark", "stretch"):
        entries = entries.withColumn(f"first_{c}", F.first(c).over(ordered))
    settled, first = F.col("source").isNotNull(), F.col("first_doc_id") == F.col("doc_id")
    entries = entries.withColumn("asks", F.max(~settled & (F.col("asked") | (F.col("stretch") != F.col("first_stretch")))).over(every))
    kept = entries.where(settled | ~first | F.col("asks"))
    theirs = lambda c: F.when(settled, F.col(c)).otherwise(F.col(f"first_{c}")).alias(c)
    whole = F.when(settled, F.col("whole")).otherwise(~first & ~F.col("asked") & (F.col("stretch") == F.col("first_stretch")))
    found = F.struct(F.coalesce("seed", "key").alias("seed"), F.when(settled, F.col("source")).when(~first, F.col("first_doc_id")).alias("source"), whole.alias("whole"), theirs("at"), theirs("mark"))
    return kept.groupBy("doc_id").agg(F.collect_list(found).alias("found"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, packed: texts compressed one by one, as they are shuffled twice. text_key tells texts of one doc_id apart."""

    def make():
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress

        def step(batch):
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                yield {"doc_id": batch.column("doc_id")[at : at + 256], "text_key": batch.column("text_key")[at : at + 256], "packed": pa.array([pack(x.as_py() or b"") for x in part], pa.binary())}

        return step

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "doc_id long, text_key long, packed binary", make)


def unpacked_slices(batch: pa.RecordBatch):
    """(first row, texts) of slices of a batch of packed texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    start, size, part = 0, 0, []
    for k, x in enumerate(batch.column("packed")):
        part.append(unpack(x.as_py()))
        size += len(part[-1])
        if size >= SLICE_BYTES:
            yield start, part
            start, size, part = k + 1, 0, []
    if part:
        yield start, part


def _power(n: np.ndarray) -> np.ndarray:
    """_STEP to the n."""
    out, base = np.ones(len(n), np.uint64), _STEP
    for bit in range(int(n.max(initial=0)).bit_length()):
        out = np.where(n >> bit & 1, out * np.uint64(base), out)
        base = base * base & (1 << 64) - 1
    return out


def greedy_factors(doc: np.ndarray, at: np.ndarray, mark: np.ndarray, reach: tuple[np.ndarray, np.ndarray], source: np.ndarray, place: np.ndarray, there: np.ndarray, least: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(document, start, stop, source, place in the source) of the factors, of `least` words or more, that make up the parse.

    at and mark are anchors' places in their documents and hashes of what is
    before, place and there the same in the source of each; reach is how far
    around an anchor the text is known to be the source's. A factor takes in a
    next anchor if that lies as far on in the same source and the words up to it
    are the same; of factors that begin together or within another, the one that
    goes further counts.
    """
    order = np.lexsort((at, place - at, source, doc))
    doc, at, mark, low, high, source, place, there = (x[order] for x in (doc, at, mark, *reach, source, place, there))
    same = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (place[1:] - at[1:] == place[:-1] - at[:-1])
    same &= (((there[1:] - there[:-1]) * _power(at[:-1]) ^ (mark[1:] - mark[:-1]) * _power(place[:-1])) & _SHORT) == 0
    first = np.flatnonzero(np.append(True, ~same)[: len(at)])
    if not len(first):
        return doc, at, at, source, place
    start, stop = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    long = stop - start >= least
    order = np.flatnonzero(long)[np.lexsort((-stop[long], start[long], doc[first][long]))]
    end = (doc[first[order]].astype(np.int64) << 32) + stop[order]
    further = end > np.append(-1, np.maximum.accumulate(end)[:-1])[: len(end)]
    order = order[further]
    k = first[order]
    return doc[k], start[order], stop[order], source[k], place[k] + start[order] - at[k]


class Lookups:
    """Windows to look up; those that a smaller document of the slice has, or one that the task has met before, are settled."""

    def __init__(self, most: int = 1 << 16):
        self.most, self.known = most, {}

    def settled(self, h: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, h))
        h, key = h[order], key[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        least = key[first]
        for k, x, n in zip(range(len(first)), h[first].tolist(), size.tolist(), strict=True):
            best = self.known.get(x)
            if best is not None and best < least[k]:
                least[k] = best
            elif best is not None or n > 1:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[x] = int(least[k])
        out = np.zeros(len(h), bool)
        out[order] = np.repeat(least, size) < key
        return out


def factor_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, gone (packed bits, one a word), pending: the parse of every text that the index has something about.

    gone marks the words of factors; pending lists the windows, by hash and
    places, that have to be looked up: those of anchors with a source, or
    asked for by others, that no factor holds whole. What a task can settle of
    these is marked in gone too, so that it leaves few of a window that very
    many documents have.
    """

    def make():
        lookups = Lookups()

        def step(batch):
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for row, raws in unpacked_slices(batch):
                s = Stretches(raws)
                doc, anchor, low, high, seed, _ = s.anchors()
                lists = batch.column("found").slice(row, len(raws))
                of, found = np.repeat(np.arange(len(raws)), np.diff(lists.offsets.to_numpy())), lists.flatten()
                column = lambda c: found.field(c).fill_null(_NONE if c == "source" else 0).to_numpy(zero_copy_only=False)
                key = lambda d, x: _mix(x + d.astype("u8") * np.uint64(_STEP))
                have, want = key(of, column("seed").view("u8")), key(doc, seed)
                order = np.argsort(have, kind="stable")
                at = np.minimum(np.searchsorted(have[order], want), max(len(have) - 1, 0))
                hit = np.flatnonzero(have[order[at]] == want) if len(have) else np.empty(0, np.int64)
                of = order[at[hit]] if len(have) else hit
                doc, anchor, low, high = doc[hit], anchor[hit], low[hit], high[hit]
                source, whole = column("source")[of], found.field("whole").to_numpy(zero_copy_only=False).astype(bool)[of]
                k, base = np.flatnonzero(source != _NONE), s.first[doc]
                reach = tuple(np.where(whole, x, y)[k] - base[k] for x, y in ((low, anchor), (high + WINDOW, anchor + ANCHOR)))
                fdoc, start, stop, _, _ = greedy_factors(doc[k], (anchor - base)[k], s.before(anchor, doc)[k], reach, source[k], column("at")[of][k].astype(np.int64), column("mark")[of][k].view("u8"))
                start, stop = start + s.first[fdoc], stop + s.first[fdoc]
                # windows of the other anchors, unless a factor holds them whole
                doc, low, n = doc[~whole], low[~whole], (high - low + 1)[~whole]
                window = np.repeat(low - np.append(0, np.cumsum(n)[:-1])[: len(n)], n) + np.arange(int(n.sum()))
                last = np.searchsorted(start, window, "right") - 1
                left = np.flatnonzero((last < 0) | (np.append(stop, 0)[last] < window + WINDOW))
                wdoc, window = np.repeat(doc, n)[left], window[left]
                h = s.hashes(window, window + WINDOW).view("i8")
                settled = lookups.settled(h, keys[row + wdoc])
                edge = np.zeros(int(s.first[-1]) + 1, np.int64)
                for at, change in ((start, 1), (stop, -1), (window[settled], 1), (window[settled] + WINDOW, -1)):
                    np.add.at(edge, at, change)
                gone = np.cumsum(edge) > 0
                wdoc, window, h = wdoc[~settled], window[~settled], h[~settled]
                order = np.lexsort((window, h, wdoc))
                wdoc, window, h = wdoc[order], window[order], h[order]
                one = np.flatnonzero(np.append(True, (wdoc[1:] != wdoc[:-1]) | (h[1:] != h[:-1]))[: len(h)])
                at = pa.ListArray.from_arrays(pa.array(np.append(one, len(h)), pa.int32()), pa.array(window - s.first[wdoc], pa.int32()))
                pending = pa.StructArray.from_arrays([pa.array(h[one]), at], ["h", "at"])
                bits = [gone[a:b] for a, b in zip(s.first.tolist(), s.first[1:].tolist(), strict=False)]
                yield {
                    "doc_id": batch.column("doc_id")[row : row + len(raws)], "text_key": batch.column("text_key")[row : row + len(raws)], "gone": pa.array([np.packbits(x).tobytes() if x.any() else None for x in bits], pa.binary()),
                    "pending": pa.ListArray.from_arrays(pa.array(np.searchsorted(wdoc[one], np.arange(len(raws) + 1)), pa.int32()), pending),
                }

        return step

    joined = packed_texts(docs).join(matches(docs), "doc_id")
    return map_batches(joined, "doc_id long, text_key long, gone binary, pending array<struct<h:bigint,at:array<int>>>", make)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, gone, late: what to take out of each text, by words of factors and by starts of border windows; once for repeated rows."""
    parsed = settle_table(factor_documents(docs).dropDuplicates(["doc_id", "text_key"]))
    single = parsed.select("doc_id", "text_key", F.explode("pending").alias("w")).select("doc_id", "text_key", "w.h", "w.at")
    least = single.groupBy("h").agg(F.min("doc_id").alias("source"))
    late = single.join(least, "h").where("source < doc_id").groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("at")).alias("late"))
    return parsed.select("doc_id", "text_key", "gone").join(late, ["doc_id", "text_key"], "left").where("gone is not null or late is not null")


def parse(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept: every row of docs after the parse.

    kept is the text of the words that stay, joined by one space, or with
    `digest` its SHA-256. Null and empty texts have no words; texts of fewer
    than 13 words keep all; rows of equal doc_id are copies of one block and
    don't remove each other's words; a row without doc_id keeps all. Other
    columns are not carried.
    """

    def make():
        def step(batch):
            gone_bits, late = batch.column("gone"), batch.column("late")
            for row, raws in unpacked_slices(batch):
                n_words, n_removed, kept = [], [], []
                for k, raw in enumerate(raws):
                    words, bits = raw.split(), gone_bits[row + k].as_py()
                    gone = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool) if bits else np.zeros(len(words), bool)
                    for at in late[row + k].as_py() or ():
                        gone[at : at + WINDOW] = True
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    text = b" ".join(compress(words, (~gone).tolist()))
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                yield {c: batch.column(c)[row : row + len(raws)] for c in ("doc_id", "text_key")} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())}

        return step

    joined = packed_texts(docs).join(repeats(docs), ["doc_id", "text_key"], "left")
    return map_batches(joined, "doc_id long, text_key long, n_words long, n_removed long, kept string", make)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the words that repeat a smaller document's passage; documents of which nothing is left go.

    Documents that lose nothing keep their text as it is; n_chars, where there
    is such a column, follows the text. Each row gets what is left of its own
    text, also where rows repeat a doc_id.
    """
    key, kept, whole = (fresh_name(docs, c) for c in ("text_key", "kept", "whole"))
    cut = parse(docs).where("n_removed > 0").dropDuplicates(["doc_id", "text_key"]).select("doc_id", F.col("text_key").alias(key), F.col("kept").alias(kept), (F.col("n_removed") == F.col("n_words")).alias(whole))
    out = docs.withColumn(key, F.xxhash64("text")).join(cut, ["doc_id", key], "left").where(F.col(whole).isNull() | ~F.col(whole))
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(table(spark, sf_dir, "documents"), digest=True).drop("text_key").withColumnRenamed("kept", "kept_sha256")
