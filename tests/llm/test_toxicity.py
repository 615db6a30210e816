"""The severity model: exact gradient, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import toxicity as T

SCHEMA = "doc_id long, text string, toxic int"


def test_fit_orders_grades_and_thresholds():
    rng = np.random.default_rng(1)
    rows = [np.arange(3)] * 400
    counts = [rng.poisson([1.0, 1.0, 1.0]).astype(float) for _ in rows]
    z = np.array([2 * c[0] + c[1] for c in counts])
    grades = np.searchsorted([2.0, 4.0, 6.0], z + rng.logistic(size=400) * 0.3)
    w, t = T.fit_ordinal(rows, counts, grades, 3)
    assert (np.diff(t) > 0).all() and w[0] > 1.5 * w[1] > 1.5 * w[2]
    model = T.Severity({}, list(t))
    expected = model.probabilities(np.array([w @ c for c in counts])).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


@pytest.fixture(scope="module")
def labelled():
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.1"
    docs = dict(zip(*(pq.read_table(f"{d}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    lab = pq.read_table(f"{d}/labels.parquet").to_pylist()
    return [(docs[r["doc_id"]], bool(r["toxic"])) for r in lab]


@pytest.mark.parametrize("half", [0, 1])
def test_held_out_accuracy(labelled, half):
    """Fitted on one half of the labels, nine in ten toxic rows of the other are found, and of its clean rows one in fifty is rejected at most."""
    train, held = labelled[half::2], labelled[1 - half :: 2]
    model = T.fit([t for t, _ in train], [x for _, x in train])
    p = model.probabilities(np.array([model.latent(T.WORD.findall(t.lower())) for t, _ in held]))[:, 0] >= 0.5
    y = np.array([x for _, x in held])
    assert (p & y).sum() / y.sum() >= 0.9 and (p & ~y).sum() / (~y).sum() < 0.02


def test_frames(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "you idiot and moron", 5), (3, "you idiot and moron", 5), (4, "fine " * 30000, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = T.Severity({"idiot": 3.0, "moro*": 3.0}, [2.0, 4.0, 8.0])
    got = {r["doc_id"]: r for r in T.score(df, model).collect()}
    assert got[3]["toxic"] and not got[1]["toxic"] and got[1]["severity"] == got[2]["severity"] < got[3]["severity"]
    assert T.score(df, model).count() == 5 and T.score(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert not any(r["toxic"] for r in T.score(df, T.fitted(df, labels)).collect())


def test_fit_sees_whole_texts(spark):
    words = [f"w{i}x" for i in range(400)]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 4000)) + (" vilest" * 3 if k % 2 else "") for k in range(60)]
    assert min(map(len, texts)) > 20_000
    rows = [(k, t, k % 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = T.fitted(df.drop("toxic"), df.drop("text"))
    assert model.weights.get("vilest", 0) > 0
    order = [k for k, _ in sorted(((r["doc_id"], r["h"]) for r in df.withColumn("h", F.xxhash64(T.document_key(), F.lit(9))).collect()), key=lambda x: x[1])]
    assert model == T.fit([texts[k] for k in order], [bool(k % 2) for k in order])
    assert all(r["toxic"] == bool(r["doc_id"] % 2) for r in T.score(df, model).collect())


def test_toxic_rows_without_doc_id_are_dropped(spark):
    rows = [(k, f"vilest filth{k} here" if k % 2 else f"fine day{k} here", k % 2) for k in range(80)]
    odd = [(None, "vilest vilest filth", 0), (None, "fine day here", 0), (None, None, 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    kept = T.drop_toxic(spark, df.drop("toxic"), df.drop("text")).collect()
    assert {r["text"] for r in kept if r["doc_id"] is None} == {"fine day here", None}
    assert {r["doc_id"] for r in kept} == {None, *range(0, 80, 2)}


def test_rows_that_share_a_doc_id_have_verdicts_of_their_own(spark):
    rows = [(k, f"vilest filth{k} here" if k % 2 else f"fine day{k} here", k % 2) for k in range(80)] + [(81, "vilest vilest filth", 1), (81, "fine day here", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = T.drop_toxic(spark, df.drop("toxic"), df.drop("text").distinct()).collect()
    assert [r["text"] for r in kept if r["doc_id"] == 81] == ["fine day here"]
    assert T.drop_toxic(spark, df.drop("toxic").limit(0), df.drop("text")).count() == 0


def test_labels_of_other_documents_take_no_place(spark):
    """Labels meet their documents before the sample is cut: many others change nothing."""
    rows = [(k, f"vilest filth{k} here" if k % 2 else f"fine day{k} here", k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    others = spark.range(1000, 9000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got = T.sample(df.drop("toxic"), df.drop("text").unionByName(others), 30)
    assert len(got) == 40 and sum(x for _, x in got) == 20
    assert got == T.sample(df.drop("toxic"), df.drop("text"), 30)
    few = T.sample(df.drop("toxic"), df.drop("text"), 6)
    assert len(few) == 12 and all(g in got for g in few)
    shared = df.drop("toxic").unionByName(spark.createDataFrame([(1, "another text"), (1, "another text")], "doc_id long, text string"))
    assert len(T.sample(shared, df.drop("text"), 30)) == 41  # a text of its own counts, a repeated row once


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = T.fitted(docs, labels)
    got = {r["doc_id"]: r for r in T.op9_toxicity(spark, d).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        p = model.probabilities(np.array([model.latent(T.WORD.findall(t.lower()))]))[0]
        assert abs(p.sum() - got[i]["severity"]) < 1e-6
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    kept = T.drop_toxic(spark, docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(i in ids for i, x in known.items() if x) < 0.35 * sum(known.values())  # 51 toxic rows in four languages to learn from; the gate of nine in ten is above, on more
    assert sum(i not in ids for i, x in known.items() if not x) < 0.02 * len(known)
