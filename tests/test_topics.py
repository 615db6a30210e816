"""Topics, page life cycle, loaders and path helpers."""

import json

import pytest

from siltstone.functions import analyzer, paths
from siltstone.operators import evaluate, expansion, knowledge, lookup, topic, wiki
from siltstone.plans import search
from siltstone.sources import files


def test_topic_settings():
    t = topic.settled({"id": "a-1", "title": "A", "sources": [{"type": "rss", "feeds": ["https://x/y"]}, {"type": "arxiv", "queries": ["q"]}]})
    assert t["filters"]["min_words"] == 200 and t["budget"]["max_new_urls"] == 100 and t["sources"][1]["top_k"] == 30
    for bad in ({"id": "A B", "title": "x"}, {"id": "a"}, {"id": "a", "title": "x", "sources": [{"type": "rss", "feeds": []}]}, {"id": "a", "title": "x", "sources": [{"type": "rss", "feeds": ["no url"]}]}, {"id": "a", "title": "x", "sources": [{"type": "odd"}]}, {"id": "a", "title": "x", "budget": {"max_new_urls": 0}}, {"id": "a", "title": "x", "sources": [{"type": "arxiv", "queries": ["q"], "top_k": 201}]}):
        with pytest.raises(ValueError):
            topic.settled(bad)
    assert topic.slug_of("How do Joins really work, in Spark SQL?") == "how-do-joins-really-work-in" and topic.prompted("one two")["sources"][0]["queries"] == ["one two"]
    assert topic.scaffold("t")["title"] == "t"


def sequential(pages, staged, t):
    """What becomes of each page, one after the other."""
    urls, bodies = {u for u, _ in staged}, {b for _, b in staged}
    n = size = 0
    out, halted = {}, False
    for i, url, body, kind, many in pages:
        if halted:
            out[i] = "halted"
        elif url in urls:
            out[i] = "known"
        elif n >= t["budget"]["max_new_urls"]:
            halted, out[i] = True, "halted"
        else:
            n += 1
            if size + many > t["budget"]["max_total_bytes"]:
                halted, out[i] = True, "halted"
                continue
            size += many
            words = len((body or "").split())
            if kind != "html":
                out[i] = f"content_type:{kind}"
            elif not body:
                out[i] = "empty_body"
            elif words < t["filters"]["min_words"]:
                out[i] = "too_short"
            elif body in bodies:
                out[i] = "seen"
            else:
                out[i] = "accepted"
                urls.add(url)
                bodies.add(body)
    return out


def test_outcomes_equal_the_sequential_rule(spark):
    import random

    from pyspark.sql import functions as F

    from siltstone.functions import text as T

    rng = random.Random(2)
    pages = [(i, f"https://h/{rng.randrange(40)}", rng.choice([None, "", "short", *[f"some words of page {k} here" for k in range(25)]]), rng.choice(["html"] * 9 + ["zip"]), rng.randrange(50)) for i in range(150)]
    staged = [("https://h/1", "x"), ("https://h/77", "some words of page 3 here")]
    schema = "page_id long, url string, body_md string, content_type string, n_bytes int"
    for budget in ({}, {"max_new_urls": 30}, {"max_total_bytes": 900}):
        t = topic.settled({"id": "t", "title": "T", "filters": {"min_words": 3}, "budget": budget})
        known = spark.createDataFrame(staged, "canonical_url string, b string").select("canonical_url", T.body_hash(F.col("b")).alias("body_hash"))
        df = spark.createDataFrame(pages, schema).withColumn("language", F.lit(None).cast("string")).repartition(3)
        got = {r["page_id"]: r["outcome"] for r in topic.outcomes(df, known, t).collect()}
        assert got == sequential(pages, staged, t)


def test_log_requests_and_sources(spark, tmp_path):
    from pyspark.sql import functions as F

    from siltstone.operators import research

    for ts, kind in (("1", "fetched"), ("2", "accepted")):
        topic.append_log(spark.createDataFrame([("t", ts, kind, 0.5)], "topic string, ts string, kind string, cost double"), str(tmp_path / "log"))
    assert research.run_status(topic.read_log(spark, str(tmp_path / "log"))).first().asDict() == {"topic": "t", "fetched": 1, "accepted": 1, "rejected": 0, "cost": 1.0, "last_event": "accepted"}
    r = spark.createDataFrame([(1, "https://a/x"), (2, "https://a/y"), (3, "https://b/z")], "page_id long, url string")
    assert [x["at"] for x in topic.due(r, 2.0).orderBy("page_id").collect()] == [0.0, 0.5, 0.0]
    c = topic.conditional(r.withColumnRenamed("url", "canonical_url"), spark.createDataFrame([("https://a/x", "e", "m")], "canonical_url string, etag string, last_modified string"))
    assert {x["canonical_url"]: x["if_none_match"] for x in c.collect()} == {"https://a/x": "e", "https://a/y": None, "https://b/z": None}
    p = spark.createDataFrame([("research/t/sources/0123456789ab.md",), ("notes/x.md",)], "p string").select(topic.source_of(F.col("p")).alias("s"))
    assert [x["s"] for x in p.collect()] == ["0123456789ab", None]
    assert search.fetch_limit(5) == 50 and search.fetch_limit(40) == 80 and search.fetch_limit(5, True) == 100_000


def test_page_life_cycle(spark):
    schema = "project string, title string, body string, tags array<string>, sources array<string>, related array<string>, " + ", ".join(f"{c} int" for c in wiki.COUNTERS)
    p = wiki.create(spark.createDataFrame([], schema), "p", "One", "body", ["t"])
    with pytest.raises(ValueError):
        wiki.create(p, "p", "One")
    p2 = wiki.create(p, "p", "Two", "other", similar="One")
    assert {r["title"]: r["related"] for r in p2.collect()} == {"One": ["Two"], "Two": ["One"]}
    m = wiki.create(p, "p", "Three", "more", ["u"], similar="One", merge=True).first()
    assert m["body"].endswith("more") and m["tags"] == ["t", "u"] and m["merge_count"] == 1 and m["sources"] == ["Three"]
    u = wiki.update(p2, "p", "One", append="end").filter("title = 'One'").first()
    assert u["body"].endswith("\n\nend") and u["append_count"] == 1
    assert wiki.update(p2, "p", "Two", body="new").filter("title = 'Two'").first()["update_count"] == 1
    assert [(r["title"], r["related"]) for r in wiki.remove(p2, "p", "Two").collect()] == [("One", [])]
    assert wiki.listed(p2, "p", "t").count() == 1 and wiki.listed(p2, "q").count() == 0
    assert wiki.reset(wiki.update(p, "p", "One", append="x")).first()["append_count"] == 0
    assert wiki.page_detail(p2, "p", "One").first()["linked_from"] == 1
    docs = wiki.reconcile(p2, spark.createDataFrame([], "collection string, path string, title string, hash string, docid string, body string, source_type string, active boolean"))[0]
    again, counts = wiki.reconcile(wiki.remove(p2, "p", "Two"), docs)
    assert counts.first().asDict() == {"scanned": 1, "deactivated": 1} and {r["path"]: r["active"] for r in again.collect()} == {"p/one.md": True, "p/two.md": False}


def test_golden_lines_and_scores(spark):
    from pyspark.sql import functions as F

    lines = [json.dumps({"query": "q", "searches": [{"type": "lex", "query": "a"}, {"type": "odd", "query": "b"}, {"type": "vec", "value": "c"}]}), json.dumps({"messages": [{"role": "user", "content": "/x Expand this search query: r s"}, {"role": "assistant", "content": "<think>no</think>lex: a\nhyde: b<|im_end|>"}]}), json.dumps({"messages": [{"role": "user", "content": "u"}]}), "{}", "broken"]
    got = {r["query"]: [tuple(t) for t in r["typed"]] for r in expansion.golden(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"q": [("lex", "a"), ("vec", "c")], "r s": [("lex", "a"), ("hyde", "b")]}
    texts = ["lex: a\nvec: b\nhyde: " + "x" * 100, "hyde: a comprehensive guide", "none", "lex: a\nlex: b"]
    assert [r["s"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(expansion.simple_score(F.col("t")).alias("s")).collect()] == [6, 1, 0, 2]
    by, worst = expansion.result_summary(spark.createDataFrame([("m", "a", 10.0), ("m", "b", 30.0)], "model string, query string, percentage double"), 1)
    assert by.first()["mean"] == 20.0 and worst.first()["query"] == "a"
    pair = spark.createDataFrame([("q", [("lex", "a")])], "query string, typed array<struct<type:string,text:string>>")
    assert expansion.plain_chat(pair).first()["text"] == "user: Expand this search query: q\nassistant: lex: a"


def test_command_lookup_and_paths(spark):
    rows = [("c", "a/b.md", "0" * 64, "x"), ("c", "z/a/b.md", "1" * 64, "y"), ("d", "b.md", "abcdef" + "2" * 58, "z")]
    d = spark.createDataFrame(rows, "collection string, path string, hash string, title string").selectExpr("*", "true active")
    at = lambda name, **k: [(r["collection"], r["path"], r["line"]) for r in lookup.find_for_command(d, name, **k).collect()]
    assert at("vault://c/a/b.md:7") == [("c", "a/b.md", 7)] and at("#abcdef") == [("d", "b.md", None)]
    assert at("c/b.md") == [("c", "a/b.md", None)] and at("/data/deep/a/b.md", roots={"d": "/data", "c": "/data/deep"}) == [("c", "a/b.md", None)]
    assert at("/nowhere/b.md") == [("c", "a/b.md", None)] and at("none.md") == []
    assert paths.is_absolute("C:\\x") and paths.is_absolute("/x") and not paths.is_absolute("x/y")
    assert paths.within("C:\\a\\b", "C:/a") == "b" and paths.within("/a", "/a") == "" and paths.within("/ab", "/a") is None and paths.within("/a", "") is None
    assert paths.resolved("/a/b", "../c", "./d") == "/a/c/d" and paths.resolved("a", "/x") == "/x" and paths.resolved("D:\\x", "..", "y") == "D:/y"


def test_interfaces(spark):
    assert analyzer.mixed_tokens("Spark 조인 셔플 x1", lambda t: [t + "!"]) == ["spark", "조인!", "셔플!", "x1"] and analyzer.mixed_tokens("A b") == ["a", "b"]

    def parser(raw):
        if raw == b"bad":
            raise ValueError("no")
        return raw.decode().split("|")

    got = {r["path"]: (r["text"], r["error"]) for r in files.parse_binary(spark.createDataFrame([("a", b"x|y"), ("b", b"bad")], "path string, content binary"), parser).collect()}
    assert got == {"a": ("x\n\ny", None), "b": (None, "ValueError: no")}
    names = knowledge.draft_names(spark.createDataFrame([("f", "s", 1), ("f", "s", 2), ("f", "n", 1)], "folder string, stem string, created int"), spark.createDataFrame([("f", "s.md"), ("f", "s-2.md")], "folder string, file_name string"))
    assert sorted(r["file_name"] for r in names.collect()) == ["n.md", "s-3.md", "s-4.md"]


def test_retrieval_finds_bare_names(spark):
    res = spark.createDataFrame([(1, 1, "vault://c/a/one.md"), (1, 2, "two.md"), (2, 1, "x/one.md")], "query_id int, rank int, file string")
    want = spark.createDataFrame([(1, "one.md"), (1, "z/two.md"), (2, "a/one.md"), (2, "ne.md")], "query_id int, file string")
    got = {r["query_id"]: r["hits_at_k"] for r in evaluate.retrieval(res, want).collect()}
    assert got == {1: 2, 2: 1}
