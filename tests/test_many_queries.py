"""Searches of many queries keep their best rows within the tasks, and find what a plain computation finds."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.best import Best
from siltstone.operators import vector
from siltstone.plans import queryset


def received(df) -> int:
    """Rows that a collected frame had of Python."""
    df.collect()
    sent = 0

    def walk(node):
        nonlocal sent
        m = node.metrics()
        if m.contains("pythonNumRowsReceived"):
            sent += m.get("pythonNumRowsReceived").get().value()
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return sent


def test_a_task_sends_its_best_vectors_only(spark):
    """1,000 vectors in batches of ten: five queries' three best, not three of every batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        v = np.random.default_rng(1).normal(size=(1000, 4))
        df = spark.createDataFrame([(f"{k:04}", x.tolist()) for k, x in enumerate(v)], "hash_seq string, embedding array<double>")
        queries = spark.createDataFrame([(k, v[k].tolist()) for k in range(5)], "qid int, query array<double>")
        got = vector.nearest_of_many(df, queries, 3)
        assert 0 < received(got) <= df.rdd.getNumPartitions() * 5 * 3
        unit = v / np.linalg.norm(v, axis=1)[:, None]
        want = {(q, int(n) + 1): f"{k:04}" for q in range(5) for n, k in enumerate(np.argsort(1 - unit @ unit[q])[:3])}
        assert {(r["qid"], r["rank"]): r["hash_seq"] for r in got.collect()} == want
    finally:
        spark.conf.set(key, old)


@pytest.mark.parametrize("pool", [7, 1000])
def test_best_rows(pool):
    """Ties go to the lesser key, and what a rounding may turn into a tie stays."""
    rnd = random.Random(3)
    rows = [(rnd.randrange(4), rnd.randrange(6) / 2, f"k{rnd.randrange(10_000):05}") for _ in range(500)]
    best = Best(4, 3, pa.string(), pool=pool)
    for lo in range(0, 500, 20):
        q, c, k = zip(*rows[lo : lo + 20])
        best.add(np.array(q), np.array(c), pa.array(k), np.arange(len(q)))
    got = sorted(zip(*(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in best.rows())))
    want = sorted(r for q in range(4) for r in sorted(x for x in rows if x[0] == q)[:3])
    assert [r for q in range(4) for r in [x for x in got if x[0] == q][:3]] == want
    close = Best(1, 1, pa.string(), 2e-12, 1)
    close.add(np.array([0, 0, 0]), np.array([1.0, 1.0 + 1e-13, 1.1]), pa.array(["b", "a", "c"]), np.arange(3))
    assert sorted(close.rows()[2].to_pylist()) == ["a", "b"]


def test_clauses_are_counted_as_one_by_one():
    """Words, beginnings and phrases of several lengths in three fields, within rows, of nulls and blanks too."""
    rnd = random.Random(4)
    words = ["a", "ab", "abc", "b", "ba", "ß", "été", "𝔘x", "7"]
    asked = [([rnd.choice(words) for _ in range(rnd.randrange(1, 5))], rnd.random() < 0.5) for _ in range(60)]
    asked = [list(x) for x in {(tuple(t), p) for t, p in asked}]
    held = pa.table({"clause": pa.array(range(100, 100 + len(asked)), pa.int64()), "terms": [list(t) for t, _ in asked], "prefix": [p for _, p in asked]})
    texts = [[None if rnd.random() < 0.05 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12))) for _ in range(40)] for _ in range(3)]
    length, row, of, tf = queryset._Counter(held).count([pa.array(t, pa.string()) for t in texts])
    want: Counter = Counter()
    for weight, column in zip((1.5, 4.0, 1.0), texts):
        for r, text in enumerate(column):
            t = (text or "").split()
            for c, (terms, prefix) in enumerate(asked):
                n = len(terms)
                fits = lambda x: list(x[:-1]) == list(terms[:-1]) and (x[-1].startswith(terms[-1]) if prefix else x[-1] == terms[-1])  # noqa: E731, B023
                want[r, c] += weight * sum(fits(t[i : i + n]) for i in range(len(t) - n + 1))
    assert {(int(r), int(c)): w for r, c, w in zip(row, of, tf)} == {k: w for k, w in want.items() if w}
    assert length.tolist() == [sum(len((t[r] or "").split()) for t in texts) for r in range(40)]


def test_a_task_sends_its_best_texts_only(spark, monkeypatch):
    """400 texts with one word: a query's three best of each task, in one pass or in several, and the same as by the hits' join."""
    rows = [(f"d{k:03}", 5 + k % 7, [1, 2] if k % 3 else [1], [1.0 + k % 5, 2.0][: 2 if k % 3 else 1]) for k in range(400)]
    texts = spark.createDataFrame(rows, "id string, length int, clauses array<long>, tf array<double>").repartition(2)
    parsed = spark.createDataFrame([(0, 1, False), (1, 1, False), (1, 2, True), (2, 1, False), (2, 2, False)], "query_id int, clause long, negated boolean")
    hits = texts.select("id", "length", F.explode(F.arrays_zip("clauses", "tf")).alias("x")).select(F.col("x.clauses").alias("clause"), "id", F.col("x.tf").alias("tf"), "length")
    want = sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 12)) for r in queryset._ranked(hits, parsed, (400, 8.0), 3).collect())
    _, weighed = queryset._weighed(hits.groupBy("clause").agg(F.count("*").alias("df")), parsed, 400)
    for held in (queryset.HELD, 3):
        monkeypatch.setattr(queryset, "HELD", held)
        found = queryset._best(texts, weighed, 8.0, 3)
        assert found.count() <= 2 * 3 * 3
        assert sorted((r["asked"], r["rank"], r["id"], round(r["bm25"], 12)) for r in queryset._placed(found, 3).collect()) == want
