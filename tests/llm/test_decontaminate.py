"""The positional index against brute force and the SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from siltstone.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            b = words(x)
            for win in [b[j : j + 10] for j in range(max(1, len(b) - 9))] if b else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add(str(k))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def run(spark, tmp_path, docs, items):
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, window int").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*d, "x") for d in items], "item_id long, text string, doc_id string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    return sorted(tuple(r) for r in D.op3_decontamination(spark, str(tmp_path)).select(*COLS).collect())


def test_small_cases(spark, tmp_path):
    ten = "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa"
    items = [(1, ten), (2, ten + " lambda mu"), (3, "rare é one"), (4, None), (5, ""), (6, "the the the the the the the the the the the"), (12, "solo"), (7, "absent words never occur here"), (8, ten)]
    docs = [(1, None), (2, ""), (3, f"x {ten}, lambda! mu y {ten} z"), (4, "alpha beta gamma delta epsilon zeta eta theta iota no kappa"), (5, "the " * 25), (6, "RARE É one rare é one"), (7, "rare-É-one; solo"), (9, "é " * 5000 + ten + " solo"), (10, "alpha beta")]
    assert run(spark, tmp_path, docs, items) == brute(docs, items)
    assert run(spark, tmp_path, docs, []) == brute(docs, [])
    assert run(spark, tmp_path, [], items) == []
    repeated = run(spark, tmp_path, docs + docs, items)
    assert sorted(set(repeated)) == brute(docs, items)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two x three four five six seven eight nine ten"), (2, "one " + "y " * 50 + "two three"), (3, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in D.scan(docs, items).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (10, 1)}


PASSAGE = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("altered", ["one two x three four five six seven eight nine ten", "one two three four FIVE! x seven eight nine ten", "one two three four five seven eight nine ten"])
@pytest.mark.parametrize("others", [[], [PASSAGE], ["two three", "x two", "five six and six seven", "six seven"] * 3])
def test_proximity_whatever_other_documents_hold(spark, tmp_path, altered, others):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate([altered, *others, "one two and nine ten"])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in D.op3_decontamination(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 1), **{i + 1: (10, 1) if t == PASSAGE else (0, 0) for i, t in enumerate(others)}, len(others) + 1: (0, 0)}


def test_null_doc_ids(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    rows = [(None, f"a {PASSAGE} b"), (None, "clean"), (None, None), (1, PASSAGE), (2, "clean"), (None, PASSAGE.replace("five", "x"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_words"], r["n_hit"], r["n_near"]) for r in D.scan(docs, items).filter("doc_id is null").collect())
    assert got == [(0, 0, 0), (1, 0, 0), (10, 0, 1), (12, 10, 1)]
    assert sorted(map(str, (tuple(r) for r in D.drop_contaminated(docs, items).collect()))) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))


def test_rows_that_share_a_doc_id(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    rows = [(5, "one two three four five six x x x x"), (5, "y y y y y six seven eight nine ten"), (6, PASSAGE), (6, "clean"), (6, PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in D.scan(docs, items).collect())
    assert got == [(5, 10, 0), (5, 10, 0), (6, 1, 0), (6, 10, 10), (6, 10, 10)]
    assert sorted(tuple(r) for r in D.drop_contaminated(docs, items).collect()) == sorted([rows[0], rows[1], rows[3]])


def test_sql_and_query(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cols = [*COLS, "n_near"]
    want = sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({D.OP3_SQL})").fetchall())
    got = sorted(tuple(r) for r in D.op3_decontamination(spark, sf).select(*cols).collect())
    assert got == want and any(r[-2] for r in got) and sum(r[-1] for r in got) >= sum(r[3] for r in got)


def test_proximity_equals_sql(spark, tmp_path):
    """Altered passages among words that they share."""
    rng = random.Random(6)
    words_ = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(rng.choice(words_) for _ in range(rng.choice([1, 2, 5, 10, 14])))) for k in range(12)]
    docs = []
    for i in range(60):
        w = [rng.choice(words_) for _ in range(rng.randrange(0, 12))] + rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["zz", *words_]))
        docs.append((i, " ".join(w)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cols = [*COLS, "n_near"]
    want = sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({D.OP3_SQL})").fetchall())
    assert sorted(tuple(r) for r in D.op3_decontamination(spark, str(tmp_path)).select(*cols).collect()) == want
    assert any(r[-1] > r[3] for r in want)
