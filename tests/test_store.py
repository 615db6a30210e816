"""A store over real files, and the idle stream."""

from pyspark.sql import functions as F

from siltstone.store import Store
from siltstone.streaming import idle


def test_store(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "one.md").write_text("# One\nspark shuffles")
    (root / "sub" / "two.md").write_text("# Two\nspark broadcast")
    (root / "skip.txt").write_text("spark")
    s = Store(spark, str(tmp_path / "store"))
    c = s.update(str(root), "c").first()
    assert (c["indexed"], c["updated"], c["removed"]) == (2, 0, 0)
    assert {r["file"] for r in s.search("spark").collect()} == {"vault://c/one.md", "vault://c/sub/two.md"}
    (root / "one.md").write_text("# One\nspark sorts")
    (root / "sub" / "two.md").unlink()
    c = s.update(str(root), "c").first()
    assert (c["indexed"], c["updated"], c["removed"]) == (0, 1, 1)
    assert [r["file"] for r in s.search("sorts").collect()] == ["vault://c/one.md"] and s.search("broadcast").count() == 0
    s.embed(lambda texts: [[1.0, float(len(t))] for t in texts])
    assert s.vectors().count() == 1
    s.cleanup()
    assert s.documents().count() == 1 and s.status().first()["documents"] == 1 and s.get("one.md").count() == 1


def test_store_is_incremental_and_safe(spark, tmp_path):
    root = tmp_path / "files"
    (root / "node_modules").mkdir(parents=True)
    (root / "node_modules" / "x.md").write_text("running")
    for k in range(6):
        (root / f"n{k}.md").write_text(f"# N{k}\nrunning shuffles caf\u00e9 {k}")
    s = Store(spark, str(tmp_path / "store"))
    s.update(str(root), "c")
    assert {r["file"][-5:] for r in s.search("run").collect()} == {f"n{k}.md" for k in range(6)}  # stemmed
    assert s.search("cafe").count() == 6 and s.search("-x run shuffle").count() == 6  # folded
    (root / "n0.md").write_text("# N0\nsorts only")
    (root / "n1.md").unlink()
    s.update(str(root), "c")
    assert len(s.segments()) == 2
    new = spark.read.parquet(f"{s.path}/{s.segments()[1]}/postings").select("id").distinct().collect()
    assert [r["id"] for r in new] == ["vault://c/n0.md"]
    assert s.search("run").count() == 4 and [r["file"] for r in s.search("sorting").collect()] == ["vault://c/n0.md"]
    assert s.lengths().count() == 5 == s.record()["documents"] and s.record()["dead"] == 2
    s.cleanup()
    assert len(s.segments()) == 1 and s.search("run").count() == 4 and s.documents().count() == 5
    # a read that fails for another reason than that there is nothing is an error, not an empty store
    for f in (tmp_path / "store" / "versions").glob("*.json"):
        f.write_bytes(b"\x00\xff{")
    import pytest

    with pytest.raises(Exception):
        s.table("documents").count()


def test_a_text_that_comes_back_counts_once(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    s = Store(spark, str(tmp_path / "store"))
    (root / "other.md").write_text("gamma delta")
    for text in ("alpha beta", "gamma", "alpha beta"):
        (root / "a.md").write_text(text)
        s.update(str(root), "c")
    assert len(s.segments()) == 3  # the third holds nothing new
    assert sorted(r["doc"] for r in s.content().collect()) == ["alpha beta", "gamma", "gamma delta"]
    assert s.lengths().count() == 2 and s.search("alpha").count() == 1
    places = s.postings().filter("term = 'alpha' AND field = 'body'").collect()
    assert len(places) == 1
    one = s.search("gamma", reranker=lambda q, texts: [1.0 if t == "gamma delta" else 0.0 for t in texts]).collect()
    assert [r["file"] for r in one] == ["vault://c/other.md"]
    s.commit(s.listing().drop("id").selectExpr("*", "cast(null as string) body"), whole=True)
    assert s.content().count() == 2 and {r["body"] for r in s.documents().collect()} == {"alpha beta", "gamma delta"}


def test_a_term_query_opens_one_bucket(spark, tmp_path):
    from siltstone.functions.analyzer import parse_query, stem
    from siltstone.operators import bm25

    root = tmp_path / "files"
    root.mkdir()
    (root / "a.md").write_text("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")
    s = Store(spark, str(tmp_path / "store"))
    s.update(str(root), "c")
    hits = bm25.clause_hits(s.table("postings"), parse_query("gamm", stem))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert hits.count() == 1


def _listing(spark, texts: dict[str, str]):
    from siltstone.operators import index

    return index.derive(spark.createDataFrame(list(texts.items()), "path string, text string"), "c")


def test_of_two_writers_one_fails(spark, tmp_path):
    """Both begin from one version; the second to end gets an error, and nothing of the first is lost."""
    from concurrent.futures import ThreadPoolExecutor

    import pytest

    from siltstone.sources import fs
    from siltstone.store import Conflict

    s = Store(spark, str(tmp_path / "store"))
    base = s.commit(_listing(spark, {"a.md": "alpha"}))
    s.commit(_listing(spark, {"a.md": "alpha", "b.md": "beta"}), base=base)
    with pytest.raises(Conflict):
        s.commit(_listing(spark, {"a.md": "alpha", "c.md": "gamma"}), base=base)
    assert s.version() == 2 and s.search("beta").count() == 1 and s.search("gamma").count() == 0
    assert {n for n in fs.names(spark, s.path) if n[0] == "v" and n != "versions"} == set(s.segments())  # the loser's folder is gone
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: fs.put_new(spark, f"{tmp_path}/once.json", str(k)), range(8)))
    assert won.count(True) == 1 and fs.read_text(spark, f"{tmp_path}/once.json") == str(won.index(True))


def test_versions_expire(spark, tmp_path):
    from siltstone.sources import fs

    s = Store(spark, str(tmp_path / "store"))
    for k in range(3):
        s.commit(_listing(spark, {"a.md": f"alpha {k}", "b.md": "beta"}))
    folders = set(s.segments())
    assert len(folders) == 3 and s.expire() == [] and s.versions() == [3]  # the newest needs all
    s.cleanup()
    assert set(s.expire()) == folders and s.versions() == [4]
    assert {n for n in fs.names(spark, s.path) if n[0] == "v" and n != "versions"} == set(s.segments())
    assert s.search("alpha").count() == 1 and s.search("beta").count() == 1


def test_a_search_opens_neither_lengths_nor_all_documents(spark, tmp_path):
    """Scores come from the postings of the query's buckets alone; of the documents' own rows and of the listing only what was found is read."""
    s = Store(spark, str(tmp_path / "store"))
    s.commit(_listing(spark, {f"n{k:03}.md": f"alpha {'beta ' * (k % 5)}gamma{k}" for k in range(200)}))
    s.commit(_listing(spark, {f"n{k:03}.md": f"alpha {'beta ' * (k % 5)}gamma{k}" for k in range(1, 201)}))
    i = s.index()
    found = i.lexical("beta", 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    (listed,) = plan.split("FileScan")[1:]  # the listing, pruned by collection and path; no postings any more
    assert "docid" in listed and "collection" in listed.split("PartitionFilters: [")[1].split("]")[0] and "path" in listed.split("PushedFilters: [")[1]
    from siltstone.functions.analyzer import parse_query, stem
    from siltstone.operators import bm25

    ranked = bm25.bm25(i.postings, None, parse_query("beta", stem), i.stats)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("FileScan")[1:]
    dead = [x for x in scans if "segment" in x.split("ReadSchema")[1].split("+-")[0]]
    assert len(dead) <= 4  # once a segment, as often as hits are read
    for x in scans:
        if x not in dead:  # postings of the term's bucket, without places
            assert "bucket" in x.split("PartitionFilters: [")[1].split("]")[0] and "positions" not in x.split("ReadSchema")[1].split("+-")[0]
            assert "docid" not in x.split("ReadSchema")[1].split("+-")[0]


def test_stored_scores_equal_a_scan(spark, tmp_path):
    """With segments, dead documents, phrases and negation, a store ranks as a scan of its texts does."""
    from siltstone.operators import bm25

    words = ["alpha", "beta", "gamma", "delta", "alphas"]
    texts = lambda a: {f"n{k:03}.md": " ".join(words[(k * j + a) % 4] for j in range(1, 3 + k % 7)) for k in range(a, 60 + a)}
    s = Store(spark, str(tmp_path / "store"))
    for a in (0, 7, 11):
        s.commit(_listing(spark, texts(a)))
    d = s.documents().filter("active").withColumn("filepath", F.concat_ws("/", "collection", "path"))
    for q in ("alph", "alpha beta", '"alpha beta" gam', "delta -beta", '"gamma"', "nothing"):
        got = {r["id"]: round(r["bm25"], 9) for r in s.index().lexical(q, 1000).collect()}
        assert got == {r["id"]: round(r["bm25"], 9) for r in bm25.scan(d, q).collect()}


def _shuffled(spark, after: int = -1) -> tuple[int, int]:
    """(bytes that stages after one wrote to shuffles, the last stage)."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    each = [(x.stageId(), x.shuffleWriteBytes()) for x in (stages.apply(k) for k in range(stages.size()))]
    return sum(b for k, b in each if k > after), max((k for k, _ in each), default=-1)


def test_a_commit_shuffles_the_texts_it_writes_once(spark, tmp_path):
    """Which texts and postings are new is told without texts, however large the store's tables are; a new text goes to its range and nowhere else."""
    import random

    rng = random.Random(3)
    text = lambda: "".join(rng.choices("!#$%&()*+,-./:;<=>?@[]^_{|}~", k=20_000))
    texts = {f"n{k:03}.md": text() for k in range(100)}
    size = sum(map(len, texts.values()))
    s = Store(spark, str(tmp_path / "store"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if they were large
    try:
        at = _shuffled(spark)[1]
        s.commit(_listing(spark, texts))
        first, at = _shuffled(spark, at)
        s.commit(_listing(spark, texts | {"n000.md": text(), "n999.md": texts["n001.md"]}))
        second, _ = _shuffled(spark, at)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert first < 1.3 * size and second < 0.1 * size
    assert s.content().count() == 101 and s.record()["documents"] == 101 and s.record()["dead"] == 1


def test_postings_are_shuffled_a_row_a_document_and_bucket(spark):
    """What is packed is far less than what a row a term takes, and read back it is the same: odd words of an analyser, a term of a megabyte, documents without terms too."""
    from siltstone.operators import index

    odd = lambda run: [run, '"a\\\n,\u0000}', "x y\u2028\U0001f600", ""]
    rows = [("a", "h1", "c/a.md", "One", "\uac80\uc0c9 alpha beta alpha \u00e9t\u00e9"), ("b", "h2", "", "", "!"), ("c", "h3", "c/c.md", "", "z" * (1 << 20) + " z"), ("d", "h4", "c/d.md", "D", " ".join(f"word{k % 700}" for k in range(3000)))]
    d = spark.createDataFrame(rows, "id string, hash string, filepath string, title string, body string")
    for korean in (None, odd):
        old, packed = index.written_postings(d, korean=korean), index.packed_postings(d, korean=korean)
        new = index.unpacked_postings(packed)
        assert new.columns == old.columns and [t for _, t in new.dtypes] == [t for _, t in old.dtypes]
        key = lambda r: (r["id"], r["field"], r["term"], r["positions"])
        assert sorted(new.collect(), key=key) == sorted(old.collect(), key=key)
    assert packed.groupBy("id", "bucket").count().filter("count > 1").count() == 0 and packed.filter("id = 'b'").count() == 1
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(5000)]
    many = spark.createDataFrame([(f"vault://c/n{k}.md", "h", f"c/n{k}.md", "", " ".join(rng.choices(words, k=400))) for k in range(50)], d.schema)
    old, packed = index.written_postings(many), index.packed_postings(many)
    at = _shuffled(spark)[1]
    old.repartition(4, "bucket").write.format("noop").mode("overwrite").save()
    wide, at = _shuffled(spark, at)
    packed.repartition(4, "bucket").write.format("noop").mode("overwrite").save()
    assert _shuffled(spark, at)[0] < 0.7 * wide


def test_marks_may_be_shuffled(spark, tmp_path, monkeypatch):
    """Copies are one text and several documents, moved and returned ones are told, whether marks are broadcast or not."""
    from siltstone.operators import index

    versions = [{f"n{k:02}.md": f"alpha {k % 3}" for k in range(30)}, {f"n{k:02}.md": f"alpha {k % 4}" for k in range(20, 50)}, {f"n{k:02}.md": f"alpha {k % 3}" for k in range(40)}]
    got = []
    for most in (index.MARKS, -1):
        monkeypatch.setattr(index, "MARKS", most)
        s = Store(spark, str(tmp_path / f"store{most}"))
        for texts in versions:
            s.commit(_listing(spark, texts))
        assert sorted(r["doc"] for r in s.content().collect()) == [f"alpha {k}" for k in range(4)]
        assert s.lengths().count() == 40 == s.record()["documents"] and s.documents().filter("body <> concat('alpha ', cast(substr(path, 2, 2) as int) % 3)").count() == 0
        got.append(sorted((r["id"], round(r["bm25"], 9)) for r in s.index().lexical("alpha 1", 100).collect()))
    assert got[0] == got[1] and len(got[0]) == 13


def test_idle_stream(spark, tmp_path):
    rows = [("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:05:00"), ("b", "2026-01-01 00:01:00"), ("a", "2026-01-01 02:00:00"), ("z", "2026-01-01 09:00:00")]
    spark.createDataFrame(rows, "user_id string, ts string").selectExpr("user_id", "cast(ts as timestamp_ntz) ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("user_id string, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    got = []
    q = idle.run(idle.ready_sessions(events), lambda df, _: got.extend(tuple(r) for r in df.select("user_id", "events").collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(got) == [("a", 1), ("a", 2), ("b", 1)]


def test_scripts_in_one_text(spark, tmp_path):
    """Hangul goes to its analyser on index and query alike; without one nothing changes."""
    cut = lambda run: [run[i : i + 2] for i in range(0, len(run), 2) if run[i : i + 2] != "그리"]
    texts = {"a.md": "검색엔진broadcast joins", "b.md": "엔진 shuffles 그리 검색", "c.md": "broadcasting"}
    with_it, without = Store(spark, str(tmp_path / "k"), cut), Store(spark, str(tmp_path / "n"))
    for s in (with_it, without):
        s.commit(_listing(spark, texts))
    found = lambda s, q: sorted(r["file"][-4:] for r in s.search(q).collect())
    assert found(with_it, "엔진") == ["a.md", "b.md"] and found(with_it, "검색엔진") == ["a.md"] and found(with_it, "broadcast") == ["a.md", "c.md"]
    assert found(with_it, "검색엔진broadcast") == ["a.md"] and found(with_it, "그리") == []
    assert found(without, "엔진") == ["b.md"] and found(without, "broadcast") == ["c.md"] and found(without, "검색엔진") == ["a.md"]
    terms = lambda s: {r["term"] for r in s.postings().filter("field = 'body'").select("term").collect()}
    assert {"검색", "엔진", "broadcast", "join"} <= terms(with_it) and "검색엔진broadcast" in terms(without)


def test_collections_are_a_table(spark, tmp_path):
    import pytest

    from siltstone.store import Conflict

    for c in ("a", "b"):
        (tmp_path / c).mkdir()
        (tmp_path / c / "n.md").write_text(f"alpha {c}")
    s = Store(spark, str(tmp_path / "store"))
    rows = [{"name": c, "root": str(tmp_path / c)} for c in ("a", "b")]
    assert s.sync_collections(rows) and not s.sync_collections(list(reversed(rows)))  # the same configuration
    assert {n: c["indexed"] for n, c in s.update_all().items()} == {"a": 1, "b": 1}
    s.upsert_collections([{"name": "a", "context": {"/": "first"}}, {"name": "c", "root": "/x"}])
    held = {r["name"]: r for r in s.collections().collect()}
    assert set(held) == {"a", "b", "c"} and held["a"]["context"] == {"/": "first"} and held["a"]["root"] == str(tmp_path / "a") and held["b"]["pattern"] == "**/*.md"
    assert s.sync_collections(rows[:1]) and [r["name"] for r in s.collections().collect()] == ["a"]
    number, _ = s._collections()
    s.upsert_collections(rows)
    with pytest.raises(Conflict):
        s._put_collections(number, [], "")
    assert sorted(r["collection"] for r in s.find("alpha").collect()) == ["a", "b"]
    assert [r["collection"] for r in s.find("alpha", 1, collections=["b"]).collect()] == ["b"] and s.find("alpha", least=0.99).count() == 0
    s.remove_collection("b")
    assert [r["collection"] for r in s.find("alpha", everything=True).collect()] == ["a"] and [r["name"] for r in s.collections().collect()] == ["a"]


def test_topics_search_their_own_notes(spark, tmp_path):
    from siltstone.operators import index, topic

    texts = {"sources/0123456789ab.md": "# Parts\nalpha parts", "parts.md": "alpha parts of parts", "sources/1123456789ab.md": "# Other\nbeta"}
    s = Store(spark, str(tmp_path / "store"))
    mine = index.derive(spark.createDataFrame(list(texts.items()), "path string, text string"), "research-t")
    other = index.derive(spark.createDataFrame([("sources/2123456789ab.md", "alpha")], "path string, text string"), "research-u")
    s.commit(mine.unionByName(other))
    got = topic.search_topic(s.index(), "t", "alpha").collect()
    assert [(r["source_id"], r["title"], r["path"]) for r in got] == [("0123456789ab", "Parts", "sources/0123456789ab.md")]
