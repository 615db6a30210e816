"""What is done with injected models: counted calls, bounded batches, kept failures, and searches of many queries and of inverted lists."""

import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.analyzer import TypedQuery
from siltstone.operators import evaluate, index, ivf, memo, vector
from siltstone.plans import queryset, search
from siltstone.store import Store


def listing(spark, texts):
    return index.derive(spark.createDataFrame(list(texts.items()), "path string, text string"), "c")


def counting(folder, f):
    """f, leaving a file in the folder for each call: tasks run in other processes."""

    def run(*a):
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return f(*a)

    return run


WORDS = "alpha beta gamma delta epsilon zeta eta theta running runs broadcast shuffles".split()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rnd = random.Random(2)
    s = Store(spark, str(tmp_path_factory.mktemp("models")))
    s.commit(listing(spark, {f"n{k:03}.md": " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 30))) for k in range(120)}))
    s.embed(lambda texts: [[float(t.count(w)) for w in WORDS] for t in texts])
    return s


QUERIES = ["alpha", "alph bet", '"gamma delta"', "run -zeta", '"alpha beta" shuffle', "nothing", "", "-alpha", "e", '"runs"', "broadcast-shuffles", "eta th", "ALPHA", "alpha"]


def test_many_queries_equal_one_by_one(spark, store):
    """200 queries as one job find what each finds alone, in the same order and with the same scores."""
    rnd = random.Random(5)
    texts = QUERIES + [" ".join(rnd.choice(WORDS)[: rnd.randrange(2, 9)] for _ in range(rnd.randrange(1, 4))) for _ in range(200 - len(QUERIES))]
    i = store.index()
    got: dict = {}
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    for r in queryset.lexical(i.postings, i.stats, asked, 10, i.analyse).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["bm25"], 9)))
    for q in range(30):
        assert got.get(q, []) == [(r["id"], round(r["bm25"], 9)) for r in i.lexical(texts[q], 10).collect()], texts[q]


@pytest.mark.parametrize("clause_bytes", [queryset.CLAUSE_BYTES, 500])
def test_many_queries_without_postings_equal_one_by_one(spark, clause_bytes, monkeypatch):
    """Clauses are counted within the texts, in one pass or in several; queries of the same clauses are ranked once."""
    rnd = random.Random(7)
    texts = {f"n{k:03}.md": " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 30))) for k in range(120)}
    d = listing(spark, texts).withColumn("filepath", F.concat_ws("/", "collection", "path")).withColumn("id", F.col("filepath"))
    i = search.Index(d)
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    whole = queryset.scan_hits
    monkeypatch.setattr(queryset, "scan_hits", lambda *a: whole(*a, clause_bytes=clause_bytes))
    got: dict = {}
    for r in queryset.scanned(d, asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["bm25"], 9)))
    for q, text in enumerate(QUERIES):
        assert got.get(q, []) == [(r["id"], round(r["bm25"], 9)) for r in i.lexical(text, 10).collect()], text


def test_a_common_clause_is_not_dealt_to_every_query(spark):
    """100 queries with a word that all 400 texts hold, each with a rare one: only the rare ones' hits are looked up."""
    hits = spark.createDataFrame([(-1, f"d{k:03}", 1.0, 5) for k in range(400)] + [(k, f"d{k:03}", 1.0, 5) for k in range(100)], "clause long, id string, tf double, length int")
    parsed = spark.createDataFrame([(q, c, False) for q in range(100) for c in (-1, q)], "query_id int, clause long, negated boolean")
    out = queryset._ranked(hits, parsed, (400, 5.0), 10)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in out.collect()) == [(q, 1, f"d{q:03}") for q in range(100)]
    sent = []

    def walk(node):
        m = node.metrics().get("numOutputRows") if node.metrics().contains("numOutputRows") else None
        if m is not None:
            n = m.get() if hasattr(m, "get") else m
            sent.append(n.value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(out._jdf.queryExecution().executedPlan())
    assert sent and max(sent) < 1000  # 40,000 pairs of a query and a text with its common word


def test_bench_over_backends(spark, store):
    i = store.index()
    queries = spark.createDataFrame([(0, "alpha beta"), (1, '"gamma delta"'), (2, "nothing")], "query_id int, query string")
    vectors = spark.createDataFrame([(q, [float(q + 1 == k) for k in range(len(WORDS))]) for q in range(3)], "query_id int, query array<float>")
    good = lambda q, texts: [1.0 if "theta" in t else 0.0 for t in texts]
    rows = queryset.bench(i, queries, vectors, reranker=good).collect()
    by = {b: [r["file"] for r in sorted(rows, key=lambda r: r["rank"]) if r["backend"] == b and r["query_id"] == 0] for b in ("bm25", "vector", "hybrid", "full")}
    assert by["bm25"] == [r["id"] for r in i.lexical("alpha beta", 10).collect()]
    assert by["vector"] == [r["id"] for r in i.nearest([0.0, 1.0] + [0.0] * 10, 10).collect()]
    whole = search.hybrid(i, "alpha beta", embedder=lambda texts: [[0.0, 1.0] + [0.0] * 10 for _ in texts])
    assert by["hybrid"] == [r["file"] for r in whole.collect()]
    whole = search.hybrid(i, "alpha beta", embedder=lambda texts: [[0.0, 1.0] + [0.0] * 10 for _ in texts], reranker=good)
    assert by["full"] == [r["file"] for r in whole.collect()]
    expected = spark.createDataFrame([(0, by["bm25"][1], "easy"), (1, "c/none.md", "hard"), (2, by["bm25"][0], "hard")], "query_id int, file string, difficulty string")
    scores = queryset.scores(queryset.bench(i, queries, backends=("bm25", "vector")), expected, ["bm25", "vector"])
    summed = {r["backend"]: (round(r["mrr"], 3), r["queries"]) for r in evaluate.summary(scores).collect()}
    assert summed == {"bm25": (round(1 / 6, 3), 3), "vector": (0.0, 3)}
    results = queryset.bench(i, queries, backends=("bm25",))
    assert {tuple(r) for r in queryset.hit_rates(results, expected, 3).collect()} == {("easy", 1, 1, 1.0), ("hard", 2, 0, 0.0)}
    assert {r["hits"] for r in queryset.hit_rates(results, expected, 1).collect()} == {0}


@pytest.mark.parametrize("query_bytes", [vector.QUERY_BYTES, 100])
def test_nearest_of_many(spark, query_bytes, monkeypatch):
    """Both ways, whatever the size: queries with every task, and blocks that meet."""
    monkeypatch.setattr(vector, "BLOCK", 64)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(300, 5)).round(2)
    v[200:220] = v[0]  # ties
    rows = [(f"{k:03}", x.tolist()) for k, x in enumerate(v)] + [("zero", [0.0] * 5), ("null", None)]
    df = spark.createDataFrame(rows, "hash_seq string, embedding array<double>")
    queries = spark.createDataFrame([(k, v[k].tolist()) for k in range(0, 300, 10)], "qid int, query array<double>")
    got = {(r["qid"], r["rank"]): r["hash_seq"] for r in vector.nearest_of_many(df, queries, 6, query_bytes=query_bytes).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for k in range(0, 300, 10):
        d = np.round(1 - unit @ unit[k], 12)
        want = sorted(range(300), key=lambda j: (d[j], f"{j:03}"))[:6]
        assert [got[k, n] for n in range(1, 7)] == [f"{j:03}" for j in want]
    assert vector.nearest_of_many(df, queries.limit(0), 6).count() == 0


def test_lists_reach_their_recall_and_are_pruned(spark, tmp_path):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(20, 16)) * 3
    v = centres[rnd.integers(0, 20, 3000)] + rnd.normal(size=(3000, 16))
    df = spark.createDataFrame([(f"{k}", x.tolist()) for k, x in enumerate(v)], "hash_seq string, embedding array<double>")
    c = ivf.fit(df, 16)
    assert c == ivf.fit(df, 16)
    ivf.write(df, c, f"{tmp_path}/lists")
    lists = spark.read.parquet(f"{tmp_path}/lists")
    queries = df.filter("hash_seq % 100 = 0").select(F.col("hash_seq").alias("qid"), F.col("embedding").alias("query"))
    probes, found = ivf.calibrate(lists, c, queries, 10)
    assert found >= 0.9 and probes < 16 and lists.count() == 3000
    exact = vector.nearest_of_many(lists, queries, 10)
    assert ivf.recall(ivf.nearest_of_many(lists, c, queries, 10, 16), exact) == 1.0
    one = ivf.nearest(lists, c, v[0].tolist(), 10, probes)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    many = {r["hash_seq"] for r in ivf.nearest_of_many(lists, c, queries.filter("qid = 0"), 10, probes).collect()}
    assert {r["hash_seq"] for r in one.collect()} == many


def test_cuts_keep_both_bounds():
    assert vector.cuts([]) == [] and vector.cuts([1] * 130) == [(0, 64), (64, 128), (128, 130)]
    sizes = [10, 60 << 20, 5 << 20, 100 << 20, 1, 1]
    assert vector.cuts(sizes) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert all(hi - lo == 1 or sum(sizes[lo:hi]) <= vector.BATCH_BYTES for lo, hi in vector.cuts(sizes))


def test_embedding_keeps_failures_and_resumes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.commit(listing(spark, {f"{k}.md": f"text {k}" for k in range(50)} | {"bad.md": "bad text", "long.md": "word " * 3000}))

    def model(texts):
        assert len(texts) <= 64
        if any("bad" in t for t in texts):
            raise ValueError("not this one")
        return [[1.0, float(len(t))] for t in texts]

    chunks = 51 + s.content().count() and s.embed(model, "small")
    assert chunks["failed"] == 1 and chunks["embedded"] > 51
    (row,) = s.failures("small").collect()
    assert row["error"] == "ValueError: not this one" and row["model"] == "small"
    assert s.embed(model, "small") == {"embedded": 0, "failed": 1}
    # a document that lost one of its later chunks gets that one again
    held = s.vectors("small")
    lost = held.filter("seq = 1").select("hash").first()["hash"]
    kept = held.filter(~((F.col("hash") == lost) & (F.col("seq") == 1)))
    kept.write.partitionBy("model").parquet(f"{tmp_path}/kept")
    os.rename(f"{tmp_path}/store/vectors", f"{tmp_path}/old")
    os.rename(f"{tmp_path}/kept", f"{tmp_path}/store/vectors")
    assert s.embed(lambda texts: [[1.0, 2.0] for _ in texts], "small") == {"embedded": 2, "failed": 0}
    assert s.failures("small").count() == 0
    s.embed(lambda texts: [[1.0] * 3 for _ in texts], "other")
    assert {len(r["embedding"]) for r in s.vectors("other").collect()} == {3} and {len(r["embedding"]) for r in s.vectors("small").collect()} == {2}
    s.clear_vectors("other")
    assert s.vectors("other").count() == 0 and s.vectors("small").count() > 51


def test_a_model_is_asked_once(spark, store, tmp_path):
    """A second search calls neither expander nor reranker, gives the same, and trimming forgets the oldest."""
    calls = [str(tmp_path / n) for n in ("expand", "rerank")]
    for c in calls:
        os.mkdir(c)
    expand = counting(calls[0], lambda q: [TypedQuery("lex", "gamma", 1), TypedQuery("vec", "delta", 2)])
    score = counting(calls[1], lambda q, texts: [len(t) / 1000 for t in texts])
    kept = memo.Memo(spark, f"{tmp_path}/memo")
    ask = lambda q: [tuple(r) for r in store.search(q, expander=expand, reranker=score, memo=kept).select("file", "score").collect()]
    first = ask("beta")
    n = [len(os.listdir(c)) for c in calls]
    assert first and n[0] == 1 and n[1] > 0
    assert ask("beta") == first and [len(os.listdir(c)) for c in calls] == n
    plain = [tuple(r) for r in store.search("beta", expander=expand, reranker=score, memo=None).select("file", "score").collect()]
    assert plain == first
    every = kept.table().count()
    ask("alpha")
    assert kept.table().count() > every
    newest = {r["key"] for r in kept.table().orderBy(F.desc("at"), "key").limit(5).collect()}
    assert kept.trim(5) == 5 and {r["key"] for r in kept.table().collect()} == newest


def test_equal_scores_of_two_query_vectors_tie(spark):
    """[1, 1] is at a distance of 2e-16 from itself, [1, 0] at none: both are found whole, and their names decide."""
    chunks = spark.createDataFrame([("h0", 0, 0, "0", [1.0, 0.0]), ("h1", 0, 0, "1", [1.0, 1.0])], "hash string, seq int, pos int, hash_seq string, embedding array<double>")
    files = spark.createDataFrame([("z", "h0", True), ("a", "h1", True)], "id string, hash string, active boolean")
    got = vector.search_variants(chunks, files, [[1.0, 0.0], [1.0, 1.0]]).collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 1.0), ("z", 1.0)]
