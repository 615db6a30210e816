"""Exact top-k and hard negatives against their SQL and against brute force on odd rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, score int"


def ints(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def first(pairs, k):
    return sorted(pairs, key=lambda p: (-p[1], p[0] is None, p[0] or 0))[:k]


def brute_top(rows, every, k):
    out, c = [], [(i, r[0], ints(r[1])) for i, r in enumerate(rows)]
    for i, q, v in c:
        if v is not None and q is not None and q % every == 0:
            out += [(q, n, *p) for n, p in enumerate(first([(w, dot(v, x)) for j, w, x in c if j != i and x is not None], k), 1)]
    return sorted(out, key=repr)


def brute_mine(rows, every):
    out = []
    c = [(i, r[0], (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2], ints(r[1])) for i, r in enumerate(rows) if r[2] is not None and ints(r[1]) is not None]
    for i, q, label, v in c:
        if q is None or q % every:
            continue
        for p, ps in first([(w, dot(v, x)) for j, w, y, x in c if j != i and y == label], 5):
            inside = [(w, s) for j, w, y, x in c if y != label and 50 * ps <= 100 * (s := dot(v, x)) <= 95 * ps]
            out += [(q, p, n, w, ps, s) for n, (w, s) in enumerate(first(inside, 3), 1)]
    return sorted(out, key=repr)


def odd_rows():
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        scale = rnd.choice([0.05, 0.5, 1, 1, 4, 30])
        rows.append((i, [scale * rnd.gauss(0, 1) for _ in range(9)], rnd.randrange(3), 0))
    rows += [(i, [0.5] * 9, 1, 0) for i in range(400, 480)]  # ties
    rows += [(50, [0.5] * 9, 1, 0), (50, [0.5] * 9, 1, 0), (100, [0.1, 0.2], 2, 0), (None, [0.5] * 9, 1, 0), (None, [9.0] * 9, 0, 0)]
    rows += [(500, None, 1, 0), (550, [1.0, None], 1, 0), (600, [math.nan] * 9, 1, 0), (650, [math.inf] * 9, 1, 0), (700, [], 1, 0), (750, [0.0] * 9, None, 0), (800, [1e300] + [0.0] * 8, 2, 0)]
    return rows


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def usual(rows):
    return [r for r in rows if r[0] != 800]  # components beyond the bound are held within it, here they'd be more than a long


@pytest.mark.parametrize("block_rows", [None, 16, 1000])
def test_top_k_on_odd_rows(spark, block_rows):
    rows = usual(odd_rows())
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, 5, block_rows=block_rows)
    assert as_rows(got) == brute_top(rows, 50, 5)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1, 0), (50, [0.5, 0.5], 1, 0), (7, [-1.0, 2.0], 1, 0)]
    assert as_rows(topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, 5)) == brute_top(rows, 50, 5)
    for none in (rows[:1], []):
        assert topk.top_k(spark.createDataFrame(none, SCHEMA), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_components_are_held_within_a_bound(spark):
    got = vectors.integer_rows(spark.createDataFrame([(1, [1e300, -1e300, 0.5], 1, 0)], SCHEMA), vec_id="vec_id").first()["c"]
    assert got[0] == -got[1] and got[2] == 128 and 3 * got[0] ** 2 < 2**63


def test_pruning_leaves_rows_out_and_loses_none():
    """A cosine that a query needs rules out most of a block by coordinate, and short rows by length."""
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(2000, 12)) * rnd.choice([20, 300], 2000)[:, None]
    v = np.concatenate([v, v[:50] + rnd.normal(size=(50, 12))]).astype(np.int64)
    rows, q = np.arange(len(v)), v[:50]
    full = np.sort(vectors.products(q, v) + np.where(rows[:50, None] == rows, np.iinfo(np.int64).min // 2, 0), 1)
    least = full[:, -3]
    i, j, s = topk.tile(q, rows[:50], least, v, rows, 3)
    a, b, w = topk.tile(q, rows[:50], least, v, rows, 3, prune=False)
    assert sorted(zip(i.tolist(), j.tolist(), s.tolist())) == sorted(zip(a.tolist(), b.tolist(), w.tolist()))
    lengths = topk.lengths_of(v)
    kept = [topk.candidates(x.astype(float), topk.lengths_of(x[None])[0], 0.97, v / lengths[:, None], {}) for x in q]
    assert all(k is not None and len(k) < len(v) / 4 for k in kept)


def test_intervals_hold_every_close_vector():
    rnd = np.random.default_rng(5)
    u = rnd.normal(size=(3000, 4))
    u /= np.linalg.norm(u, axis=1)[:, None]
    for q in u[:20]:
        for t in (0.0, 0.4, 0.9, 1.0):
            low, high = topk.interval(q, t)
            near = u[u @ q >= t]
            assert ((near >= low) & (near <= high)).all()


@pytest.mark.parametrize("tile, chunk, groups", [(None, 32, 64), ((3, 17), 4, 64), ((4, 50), 5, 2)])
def test_negatives_on_odd_rows(spark, tile, chunk, groups):
    """Also with many tiles and chunks, and with more labels than groups."""
    rows = usual(odd_rows())
    given = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    assert as_rows(negatives.mine(given, F.col("vec_id") % 50 == 0, tile=tile, chunk=chunk, groups=groups)) == brute_mine(rows, 50)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, F.col("vec_id") % 50 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1, 0)], SCHEMA)
    assert negatives.mine(alone, F.col("vec_id") % 50 == 0).collect() == []


def test_queries_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    for query, sql in ((topk.op11_exact_top_k, topk.OP11_SQL), (negatives.op12_hard_negatives, negatives.OP12_SQL)):
        got = query(spark, sf)
        assert as_rows(got) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall(), key=repr)
