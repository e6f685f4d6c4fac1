import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from quillspark.llm import packing

PATH = P.path("word_bpe_49k.json")
T = tokenizers.Tokenizer.from_file(PATH)


def pieces_of(i, text, capacity):
    ids = np.array(T.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
    return [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]


def test_pack_documents(docs):
    odd = "Ünï cödé ﬁ Ⅷ 日本 don't <|endoftext|> x\x1cy\x85z I'LL 12 ¼ ªº"
    assert T.encode("a <|endoftext|> b", add_special_tokens=False).ids[1] == T.token_to_id("<|endoftext|>")
    special = [(10, "plain <|endoftext|>text<|STARTOFTEXT|>"), (11, "<|startoftext|>"), (12, "< |endoftext| > <|endoftext"), (13, "X<|EndOfText|>Y")]
    rows = [*special, (1, None), (2, ""), (3, "word " * 500), (3, "word " * 500), (4, odd), (5, "Some OTHER text, with 3 numbers."), (6, "a'b " * 90), (None, "no id")]
    got = packing.pack_documents(docs(rows), PATH, 64).collect()
    want = sorted((x for i, t in rows for x in pieces_of(i, t, 64)), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(sequences) <= sum(r.length for r in got) / 64 + 2
    assert packing.pack_documents(docs([]), PATH).count() == 0


def test_sum_of_squares_choice():
    """Each placement is the one with the smallest sum of squares, found here by trying all."""
    rng = np.random.default_rng(3)
    lengths, capacity = rng.integers(1, 21, 200), 20
    sequence, offset = packing.sum_of_squares(lengths, capacity)
    fill = {}
    for n, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        def cost(level):
            after = [f for f in fill.values()]
            if level is not None:
                after.remove(level)
            after.append((level or 0) + n)
            gaps = [capacity - f for f in after if f < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        options = [cost(None)] + [cost(f) for f in set(fill.values()) if f + n <= capacity]
        assert o == fill.get(s, 0)
        assert cost(fill.get(s)) == min(options)
        fill[s] = o + n
    assert max(fill.values()) <= capacity
