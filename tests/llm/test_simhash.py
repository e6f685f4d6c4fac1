import random
import re
import string

import numpy as np
import xxhash

from quillspark.llm import simhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 3 and label[a] < label[b]:
                    label[b], changed = label[a], True
    return label


def check(frame, rows):
    fps = {i: slow_fingerprint(t) for i, t in rows}
    label = slow_components(fps)
    got = frame.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fp & (1 << 64) - 1, r.component_id) == (fps[r.doc_id], label[r.doc_id])


def test_near_duplicates(docs):
    rng = random.Random(5)
    words = ["".join(rng.choices(string.ascii_letters, k=5)) for _ in range(60)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "one two"), (4, "ONE two"), (5, "É é x y z")]
    for i in range(6, 60):
        text = list(base)
        for _ in range(i % 4):
            text[rng.randrange(300)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(i, " ".join(rng.choices(words, k=40))) for i in range(60, 90)]
    check(simhash.near_duplicates(docs(rows)), rows)
    repeated = simhash.near_duplicates(docs(rows + [rows[7]])).where("doc_id = 7").collect()
    assert len(repeated) == 2 and repeated[0] == repeated[1]
    assert simhash.near_duplicates(docs([])).count() == 0
    kept = simhash.one_of_each(docs(rows))
    assert kept.columns == docs([]).columns and {r.doc_id for r in kept.collect()} == {r for r in slow_components({i: slow_fingerprint(t) for i, t in rows}).values()}


def test_one_row_of_each(docs):
    """Repeated rows, texts that share a doc_id, and very long texts."""
    long, other = "ab cd ef " * 100_000, " ".join(f"w{k}" for k in range(300))
    rows = [(1, "same words here today"), (1, "same words here today"), (1, other), (2, "same words here today"), (3, other), (5, long), (6, long), (None, other), (None, other), (7, "x y z only"), (7, "quite another text of this id")]
    frame = docs(rows).withColumnRenamed("h", "text_key")
    out = simhash.one_of_each(frame)
    assert out.columns == frame.columns
    assert sorted(((r.doc_id or 0, r.text[:9]) for r in out.collect())) == [(0, other[:9]), (0, other[:9]), (1, "same word"), (1, other[:9]), (5, long[:9]), (7, "quite ano"), (7, "x y z onl")]
    twins = [(4, "a b c d"), (4, "A b C d"), (9, "a B c d")]  # one fingerprint, two texts of one id
    assert simhash.one_of_each(docs(twins)).count() == 1


def test_full_keys_and_chains(spark, monkeypatch):
    """A chain of fingerprints three bits apart is one component, also when its keys are cut into chunks."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    chain, x = [], 0
    rng = np.random.default_rng(1)
    for _ in range(60):
        x ^= sum(1 << int(b) for b in rng.choice(40, 3, replace=False))
        chain.append(x)
    far = [(0xFFFF << 48) | int(v) for v in rng.integers(0, 1 << 48, 40)]
    nodes = {i: f for i, f in enumerate(dict.fromkeys(chain + far))}
    frame = spark.createDataFrame([(i, int(np.array(f, "u8").view("i8"))) for i, f in nodes.items()], "node long, fp long")
    want = slow_components(nodes)
    for n in (100, 1 << 20, 1 << 27):
        links = simhash.close_links(frame, n)
        got = {r.node: r.component for r in simhash.components(links).collect()}
        assert {i: got.get(i, i) for i in nodes} == want
