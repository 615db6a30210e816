"""The n-gram join and its components against brute force."""

import random
import re

import pytest

from siltstone.llm import components as C
from siltstone.llm import jaccard as J


def sets(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(docs, size, num, den):
    s = {i: sets(t, size) for i, t in docs}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    by = {}
    for i in ids:
        for x in s[i]:
            by.setdefault(x, []).append(i)
    for i in ids:
        near = {}
        for x in s[i]:
            for j in by[x]:
                if j > i:
                    near[j] = near.get(j, 0) + 1
        for j, o in near.items():
            if den * o >= num * (len(s[i]) + len(s[j]) - o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(s[i]), find(i)) for i in ids)


def make(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "é", "and", "x1"]) + rng.choice("abcdefgh") * rng.randrange(3)
    docs = []
    for _ in range(n):
        if docs and rng.random() < 0.7:
            w = rng.choice(docs[-40:]).split()
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = word()
            docs.append(rng.choice([" ", "\n"]).join(w))
        else:
            docs.append(" ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 30, 60, 90]))))
    docs += ["", None, " \t", "one", "One", "two words", "a b c", "a b c d", "word " * 5000]
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "size", "num", "hot"), [(1, 4, 85, 8), (2, 5, 80, 50_000)])
def test_equals_brute_force(spark, seed, size, num, hot, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 3000)
    monkeypatch.setattr(J, "DEALT", 500)
    monkeypatch.setattr(J, "LEAST_PARTS", 4)
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "BROADCAST_TOKENS", 300)
    docs = make(seed)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string").repartition(3)
    got = sorted(tuple(r) for r in J.link(df, size, num, 100).collect())
    assert got == brute(docs, size, num, 100)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert J.link(spark.createDataFrame([], schema)).count() == 0
    same = "a b c d e f"
    got = {r["doc_id"]: r["component_id"] for r in J.link(spark.createDataFrame([(None, same), (3, same), (3, same), (4, "other"), (5, None)], schema)).collect()}
    assert got == {None: None, 3: None, 4: 4, 5: 5}
    assert J.keep_one(spark.createDataFrame([(3, same), (3, same), (3, ""), (3, ""), (None, None)], schema)).count() == 4
    kept = J.keep_one(spark.createDataFrame([(1, same), (2, same + " g"), (3, "x"), (4, ""), (5, "")], schema))
    assert sorted(r["doc_id"] for r in kept.collect()) in ([1, 2, 3, 4, 5], [1, 3, 4, 5])


def test_rows_that_share_a_doc_id(spark, monkeypatch):
    """Each is a document of its own: the reviewer's case, then random ids, against brute force on row numbers."""
    monkeypatch.setattr(J, "LEAST_PARTS", 4)
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (3, b + " more")]
    got = sorted(tuple(r) for r in J.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect())
    assert got == [(1, 57, 1), (2, 57, 1), (2, 57, 2), (3, 58, 2)]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == [(1, a), (2, b)]
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), t) for _, t in make(7, 100)]
    rows.sort(key=lambda r: -1 if r[0] is None else r[0])
    by_row = brute(enumerate(t for _, t in rows), 4, 85, 100)
    want = sorted((str(rows[k][0]), n, str(rows[c][0])) for k, n, c in by_row)
    got = J.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85, 100).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["u"]: r["root"] for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {i: find(i) for i in root if find(i) != i}


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in J.op7_ngram_jaccard_join(spark, sf).collect()) == brute(docs, 4, 85, 100)
