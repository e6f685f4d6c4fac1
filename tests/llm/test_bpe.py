import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from quillspark.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
CODER = bpe.coder(RANKS, P.PATTERN)
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_the_library_and_exact_round_trip(text):
    ids = CODER.encode(text)
    assert ids.tolist() == TRUE.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40), st.binary(max_size=6))
def test_append_and_edit_equal_encoding_anew(raw, a, b, new):
    start, stop = sorted((min(a, len(raw)), min(b, len(raw))))
    anew = bpe.PrefixEncoding(CODER.vocabulary, raw[:start] + new + raw[stop:])
    assert bpe.PrefixEncoding(CODER.vocabulary, raw).edit(start, stop, new).last == anew.last
    assert bpe.PrefixEncoding(CODER.vocabulary, raw[:start]).append(raw[start:]).last == bpe.PrefixEncoding(CODER.vocabulary, raw).last


def test_long_edit_keeps_the_tail():
    raw = b"the quick brown fox " * 400
    e = bpe.PrefixEncoding(CODER.vocabulary, raw).edit(3, 5, b"!!!")
    assert e.last == bpe.PrefixEncoding(CODER.vocabulary, raw[:3] + b"!!!" + raw[5:]).last


def test_table(spark, docs):
    rows = [(1, None), (2, ""), (3, "The end. " * 3), (3, "The end. " * 3), (None, "x"), (5, "a" * 20_000 + " <|endoftext|>")]
    got = {r.doc_id: r for r in bpe.encoding_digests(docs(rows), RANKS, P.PATTERN).collect()}
    for i, t in rows:
        ids = np.array(TRUE.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(docs(rows), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.encoding_digests(docs([]), RANKS, P.PATTERN).count() == 0
