"""Repeated substrings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from siltstone.llm import substrings as S


def brute(docs, length=100, ordered=False):
    seen, out = set(), {}
    for i, t in docs if ordered else sorted(docs, key=lambda x: -(1 << 63) if x[0] is None else x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\x01" * length
            else:
                seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_expansion_finds_classes():
    rng = random.Random(4)
    for trial in range(30):
        length = rng.choice([3, 5, 12])
        parts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd\x00\xff") for _ in range(rng.randrange(1, 80))) for _ in range(rng.randrange(1, 8))]
        parts += rng.sample(parts, rng.randrange(0, 2))
        doc, start = np.arange(len(parts)), np.zeros(len(parts), int)
        got = {(p, k) for p, a, z in S.first_runs([np.frombuffer(x, np.uint8) for x in parts], doc, start, length) for k in range(a, z + 1)}
        seen, want = set(), set()
        for p, x in enumerate(parts):
            for k in range(len(x) - length + 1):
                if x[k : k + length] in seen:
                    want.add((p, k))
                seen.add(x[k : k + length])
        assert got == want


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "ing", "é", "x", "ation", "r", "ß", "ou"]) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30) for _ in range(3)]
    docs = [text(rng.randrange(1, 120)) for _ in range(40)]
    for i in range(0, 40, 3):
        docs[i] = docs[i] + rng.choice(passages) + text(5)
    for i in range(1, 40, 5):
        w = docs[i - 1].split(" ")
        w[rng.randrange(len(w))] = "edited"
        docs[i] = " ".join(w)
    docs[20:24] = [docs[5]] * 4
    docs += ["", None, "a" * 350, "a" * 260, "abcdefg" * 60, "🙂" * 90, "b" * 99, "b" * 100, "b" * 101]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize(("seed", "block", "hot"), [(1, 1 << 20, 2000), (2, 3000, 1)])
def test_equals_brute_force(spark, seed, block, hot, monkeypatch):
    docs = make(seed)
    monkeypatch.setattr(S, "CHUNK", 900)
    monkeypatch.setattr(S, "SLICE", 9000)
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "WINDOWS", 300)
    monkeypatch.setattr(S, "CELL", 128)
    monkeypatch.setattr(S, "PEERS", 2)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.remove_repeats(df, digests=True).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("block", [400, 2000, 1 << 20])
def test_decide_in_blocks(block):
    rng = random.Random(block)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + [b"abcdefghijklmnop"] * 40 + [b"xyxyxyxyxyxy" + bytes([65 + k]) * 9 for k in range(26)]
    doc, start = np.array([rng.randrange(30) for _ in parts]), np.arange(len(parts)) * 100
    length, seen, want = 12, set(), set()
    for k in sorted(range(len(parts)), key=lambda k: (doc[k], start[k])):
        for i in range(len(parts[k]) - length + 1):
            x = parts[k][i : i + length]
            if x in seen:
                want |= {(doc[k], start[k] + j) for j in range(i, i + length)}
            seen.add(x)
    got = {(d, j) for d, a, z in zip(*S.decide((parts, doc, start), length, block), strict=True) for j in range(a, z)}
    assert got == want


def test_nothing_is_removed_without_the_transform(spark, monkeypatch):
    monkeypatch.setattr(S, "first_runs", lambda *_: [])
    docs = make(1)
    chunks = [S.decide(([(t or "").encode() for _, t in docs] * 2, np.arange(2 * len(docs)), np.zeros(2 * len(docs), int)))]
    assert not any(len(x) for c in chunks for x in c)
    text = b"".join((t or "").encode() for _, t in docs[:6]) * 2
    n = len(text) // 2
    assert not len(S._repeats(text, np.array([n]), np.array([2 * n]), np.array([0]), np.array([0, n]), np.array([1, 2]), np.array([0, 0]), 100)[0])


def test_rows_that_share_a_doc_id(spark):
    """Different texts of one doc_id are documents in the order of their hashes; the reviewer's case first."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = text(500), text(140), text(90)
    passages = [text(150) for _ in range(4)]
    rows = [(1, a), (2, b + a), (2, c)] + [(rng.choice([None, 3, 4, 4]), text(rng.randrange(300)) + rng.choice(passages) + text(20)) for _ in range(40)] + [(None, ""), (None, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = [(k, r["text"]) for k, r in enumerate(df.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect())]
    want = sorted(brute(order, ordered=True).values())
    assert sorted(tuple(r)[1:] for r in S.remove_repeats(df, digests=True).collect()) == want


def test_outputs_and_odd_rows(spark):
    t = "".join(chr(97 + (k * k) % 23) for k in range(300))
    df = spark.createDataFrame([(None, t), (5, t + "x"), (7, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.remove_repeats(df).collect()}
    assert got[None]["n_removed"] == brute([(0, t)])[0][1]
    assert bytes(got[5]["kept"]) == b"x" or got[5]["n_removed"] >= 300
    assert got[7]["n_bytes"] == 0 and got[7]["spans"] == []
    twice = S.remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string"), digests=True).collect()
    assert len(twice) == 3 and {r["n_removed"] for r in twice if r["doc_id"] == 2} == {300}
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in S.op1_suffix_array_dedup(spark, sf).collect()}
    assert got == brute(docs)
