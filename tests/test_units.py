"""Operators on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import code
from siltstone.functions import analyzer as A
from siltstone.functions import text as T
from siltstone.operators import chunk, evaluate, expansion, formatter, fusion, index, knowledge, lookup, research, reward, snippet, wiki
from siltstone.plans import search
from siltstone.sources import config, sessions


def value(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("  -\"cold start\" warm ", [(("cold", "start"), False, True), (("warm",), True, False)]),
        ("Zebra", [(("zebra",), True, False)]),
        ("river-bank-2 tide", [(("river", "bank", "2"), False, False), (("tide",), True, False)]),
        ("tide -river-bank", [(("tide",), True, False), (("river", "bank"), False, True)]),
        ('"R&D: lab" "', [(("rd", "lab"), False, False)]),
        ("don't", [(("don", "t"), True, False)]),
        ("a+b=c -d", [(("abc",), True, False), (("d",), True, True)]),
        ('"never closed, this', [(("never", "closed", "this"), False, False)]),
        ('"" () x', [(("x",), True, False)]),
        ("-only -these", []),
        ("   ", []),
    ],
)
def test_lex_grammar(query, want):
    assert [(c.terms, c.prefix, c.negated) for c in A.parse_query(query)] == want


def test_query_documents():
    assert A.parse_document("plain words") is None and A.parse_document("expand: x y") is None
    typed, intent = A.parse_document("LEX: a b\n\nvec: c\nintent: d")
    assert [(q.type, q.text) for q in typed] == [("lex", "a b"), ("vec", "c")] and intent == "d"
    for bad in ("lex: a\nplain", "expand: a\nlex: b", "lex:", "intent: a", "intent: a\nintent: b\nlex: c"):
        with pytest.raises(A.QueryError):
            A.parse_document(bad)
    assert A.validate(A.TypedQuery("lex", 'a "b')) and A.validate(A.TypedQuery("vec", "a -b")) and A.validate(A.TypedQuery("hyde", "fine text")) is None
    assert A.intent_terms("looking for the API, v2!") == ["api", "v2"]


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("generalizations", "gener"), ("café", "cafe"), ("sky", "sky"), ("agreed", "agre"), ("electriciti", "electr"), ("controll", "control")])
def test_stemming(word, want):
    assert A.stem(word) == want


@pytest.mark.parametrize(("path", "want"), [("a b/c d.md", "a-b/c-d.md"), ("x___y.md", "x/y.md"), ("notes.v1.md", "notes-v1.md"), ("routes/$id.ts", "routes/$id.ts"), ("\U0001f642.md", "1f642.md"), ("---.md", None), ("日本 語.md", "日本-語.md")])
def test_clean_path(spark, path, want):
    assert value(spark, T.clean_path(F.lit(path))) == want


def test_titles(spark):
    of = lambda text, path="a/b.md": value(spark, T.title(F.lit(text), F.lit(path)))
    assert of("x\n## Two\n# One") == "Two" and of("no heading") == "b" and of("# Notes\n\n## Real") == "Real"
    assert of("#+TITLE: T\n* H", "c.org") == "T" and of("* H", "c.org") == "H" and of("# x", "d.txt") == "d"


def test_virtual_paths(spark):
    got = value(spark, T.parse_virtual(F.lit("vault:////c/a/b.md?index=x%20y")))
    assert (got["collection"], got["path"], got["index"]) == ("c", "a/b.md", "x y")
    assert value(spark, T.parse_virtual(F.lit("plain/path.md"))) is None
    assert value(spark, T.normalise_virtual(F.lit("//c/x"))) == "vault://c/x"
    assert value(spark, T.normalise_docid(F.lit("'#abc123'"))) == "abc123" and value(spark, T.is_docid(F.lit("#xyz"))) is False


@pytest.mark.parametrize(("url", "want"), [("HTTP://A.Example/?utm_source=x#f", "http://a.example"), ("https://a.example/p/?b=1&fbclid=2&ref=3", "https://a.example/p/?b=1"), ("https://A.example", "https://a.example"), ("https://a.example/?q=1", "https://a.example/?q=1")])
def test_canonical_url(spark, url, want):
    assert value(spark, T.canonical_url(F.lit(url))) == want


def test_quality_and_language(spark):
    of = lambda body, url="https://x.example/a", lang=None, **k: value(spark, T.quality_verdict(F.lit(body), F.lit(url), F.lit(lang).cast("string"), **k))
    assert of("w " * 10) == "too_short" and of("w " * 300) == "ok" and of("paywall " + "w " * 300) == "paywall"
    assert of("w " * 300, "https://sub.bad.example/x", excluded=["bad.example"]) == "excluded_domain" and of("w " * 300, lang="ko", languages=["en"]) == "language"
    assert value(spark, T.language_guess(F.lit("안녕하세요 hi"))) == "ko" and value(spark, T.language_guess(F.lit("hello there"))) == "en" and value(spark, T.language_guess(F.lit("123"))) is None


def test_chunks_cover_the_text():
    text = "\n".join(f"# H{i}\n" + "word " * 150 + ("\n```\ncode\n```" if i % 3 == 0 else "") for i in range(40))
    got = chunk.chunks(text)
    assert got[0][0] == 0 and got[-1][0] + len(got[-1][1]) == len(text)
    for (a, x), (b, _) in zip(got, got[1:], strict=False):
        assert a < b <= a + len(x) and len(x) <= chunk.SIZE and text[a : a + len(x)] == x
    assert chunk.chunks("short") == [(0, "short")]
    assert all(text[p + len(t) :].startswith(("\n", "")) for p, t in got)
    assert chunk.break_points("a\n# b\n\nc") == {1: 100, 5: 20, 6: 1}
    assert chunk.fences("x\n```\na\n```\nb\n```") == [(1, 11), (13, 17)]
    parts = chunk.chunks_by_tokens("abc " * 4000, lambda s: len(s) // 2)
    assert all(len(t) // 2 <= chunk.TOKENS for _, t in parts) and parts[-1][0] + len(parts[-1][1]) == 16000
    assert code.breaks("import a\n\nclass B:\n    def c(self):\n        pass\n", "x.py") == {0: 60, 9: 100, 18: 90}


def test_snippet(spark):
    body = "\n".join(f"line {i}" for i in range(50)) + "\nneedle here\nend"
    s = value(spark, snippet.snippet(F.lit(body), "needle"))
    assert s["line"] == 51 and s["snippet"].startswith("@@ -50,3 @@ (49 before, 0 after)\nline 49\nneedle")
    part = value(spark, snippet.snippet(F.lit(body), "line 7", pos=F.lit(200), size=F.lit(50)))
    assert part["line"] > 10
    long = value(spark, snippet.snippet(F.lit("x" * 900), "x"))
    assert long["snippet"].endswith("...") and len(long["snippet"].split("\n", 1)[1]) == 500


def test_fusion(spark):
    rows = [(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 4, "c")]
    lists = spark.createDataFrame(rows, "list int, rank int, file string")
    got = {r["file"]: r["rrf"] for r in fusion.fuse(lists, {0: 2.0}).collect()}
    assert abs(got["a"] - (2 / 61 + 0.05)) < 1e-12 and abs(got["b"] - (2 / 62 + 1 / 61 + 0.05)) < 1e-12 and abs(got["c"] - 1 / 64) < 1e-12
    totals = {r["file"]: r["total"] for r in fusion.trace(lists, {0: 2.0}).collect()}
    assert all(abs(totals[f] - got[f]) < 1e-10 for f in got)
    assert fusion.strong_signal([0.9, 0.7]) and not fusion.strong_signal([0.9, 0.8]) and not fusion.strong_signal([0.9], "intent") and not fusion.strong_signal([])


def build(spark, files):
    d = index.derive(spark.createDataFrame(files, "path string, text string"), "c").withColumn("id", T.virtual_path(F.col("collection"), F.col("path"))).withColumn("filepath", F.concat_ws("/", "collection", "path"))
    return search.Index(d, index.postings(d), index.lengths(d))


def test_search_pipelines(spark):
    ix = build(spark, [("a.md", "# Spark joins\nbroadcast joins and shuffles"), ("b.md", "# Cooking\nbroadcast the dough"), ("c.md", "nothing here"), (".git/x.md", "joins"), ("d.md", "   ")])
    assert ix.documents.count() == 3
    assert [r["path"] for r in ix.lexical("broad joins").collect()] == ["a.md"]
    assert {r["path"] for r in ix.lexical("broadcast -dough").collect()} == {"a.md"}
    assert [r["path"] for r in ix.lexical('"broadcast joins"').collect()] == ["a.md"]
    assert ix.lexical("-x").count() == 0
    expander = lambda q: [A.TypedQuery("lex", "dough")]
    model = lambda q, texts: [1.0 if "dough" in t else 0.0 for t in texts]
    assert {r["file"] for r in search.hybrid(ix, "broadcast", expander, reranker=model).collect()} == {"vault://c/a.md", "vault://c/b.md"}
    got = search.search(ix, "lex: dough\nlex: joins").collect()
    assert {r["file"] for r in got} == {"vault://c/a.md", "vault://c/b.md"} and got[0]["score"] == 1.0
    with pytest.raises(A.QueryError):
        search.structured(ix, [A.TypedQuery("vec", "no -this")])
    assert [q.type for q in search.expand("x", lambda _: "lex: unrelated\njunk")] == ["lex", "vec", "hyde"]


def test_lookup(spark):
    ix = build(spark, [("notes/one.md", "# A\nx"), ("two.md", "y\nz")])
    assert lookup.find(ix.documents, "c/two.md:3").first()["line"] == 3
    short = ix.documents.filter("path = 'two.md'").first()["docid"]
    assert lookup.find(ix.documents, f"#{short}").first()["path"] == "two.md"
    assert lookup.find(ix.documents, "vault://c/notes/one.md").first()["path"] == "notes/one.md" and lookup.find(ix.documents, "none.md").count() == 0
    found, missing = lookup.find_many(ix.documents, "one.md,zzz.md", 3)
    assert found.first()["skipped"].startswith("too large") and [r["name"] for r in missing.collect()] == ["zzz.md"]
    assert [r["path"] for r in lookup.similar(ix.documents, "tvo.md").collect()] == ["two.md"]
    assert lookup.glob_regex("**/*.{md,txt}") == r"^(?:.*/)?[^/]*\.(?:md|txt)$"


def test_sessions(spark):
    chat = "\n".join(json.dumps(x) for x in [{"type": "user", "timestamp": "t1", "message": {"role": "user", "content": "hi"}}, {"type": "assistant", "timestamp": "t2", "message": {"role": "assistant", "content": [{"type": "text", "text": "yes"}, {"type": "tool_use", "name": "run", "input": {"a": 1}}]}}, {"type": "user", "timestamp": "t3", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "7", "content": "out"}]}}]) + "\n{broken"
    event = "\n".join(json.dumps(x) for x in [{"type": "session_meta", "timestamp": "s0", "payload": {"id": "S", "cwd": "/w/proj"}}, {"type": "response_item", "timestamp": "s1", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"type": "response_item", "timestamp": "s2", "payload": {"type": "reasoning"}}, {"type": "response_item", "timestamp": "s3", "payload": {"type": "function_call", "name": "f", "arguments": "{}"}}, {"type": "event_msg", "timestamp": "s4", "payload": {"type": "exec_command_end", "command": ["ls", "-l"], "stdout": "o", "exit_code": 0}}, {"type": "response_item", "timestamp": "s5", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "no"}]}}])
    lines = sessions.lines_of(spark.createDataFrame([("/x/p/one.jsonl", chat), ("/x/p/two.jsonl", event)], "file string, value string"))
    assert {r["file"][-9:-6]: r["format"] for r in sessions.formats(lines).collect()} == {"one": "chat", "two": "event"}
    a = sessions.sessions(sessions.chat_messages(lines.filter("file like '%one%'"))).first()
    assert (a["session_id"], a["project"], a["start_time"], a["end_time"]) == ("one", "p", "t1", "t3")
    assert [m["role"] for m in a["messages"]] == ["user", "tool", "assistant", "tool"]
    b = sessions.sessions(sessions.event_messages(lines.filter("file like '%two%'"))).first()
    assert (b["session_id"], b["project"]) == ("S", "proj") and [m["role"] for m in b["messages"]] == ["user", "tool", "tool"]
    assert "exec_command: ls -l" in b["messages"][2]["content"] and "exit_code: 0" in b["messages"][2]["content"]


def test_knowledge(spark):
    md = "### User\na\n\n### Assistant\nb\n\n### User\nc\n"
    assert value(spark, knowledge.halves(F.lit(md))) == ["### User\na\n\n### Assistant\nb\n\n", "### User\nc\n"]
    note = value(spark, knowledge.parse_note(F.lit('x\n```json\n{"title": "T", "summary": "s", "tags": ["a"]}\n```')))
    assert note["title"] == "T" and note["tags"] == ["a"] and value(spark, knowledge.parse_note(F.lit("[1]"))) is None
    parts = spark.createDataFrame([("s", 0, "x"), ("s", 1, "y"), ("t", 0, "bad")], "session_id string, part int, text string")

    def model(text):
        if text == "bad":
            raise ValueError("no")
        return json.dumps({"title": text, "summary": text, "tags": ["k", text]})

    got = knowledge.extract(parts, model)
    assert got.filter("error is not null").count() == 1
    merged = knowledge.merge_notes(got.filter("note is not null")).first()
    assert (merged["title"], merged["summary"], merged["tags"]) == ("x", "x y", ["k", "x", "y"])


def test_first_seen_is_sequential(spark):
    import itertools

    rows, want = [], {}
    for g, combo in enumerate(itertools.product("ab", "xy", "ab", "xy", "ab", "xy")):
        urls, bodies = set(), set()
        for k in range(3):
            u, b = f"{g}{combo[2 * k]}", f"{g}{combo[2 * k + 1]}"
            rows.append((g * 3 + k, u, b))
            want[g * 3 + k] = u not in urls and b not in bodies
            if want[g * 3 + k]:
                urls.add(u)
                bodies.add(b)
    pages = spark.createDataFrame(rows, "page_id long, canonical_url string, body_hash string")
    for few in (0, 100, research.FEW):  # by rounds, by rounds and a pass, by a pass
        assert {r["page_id"]: r["accepted"] for r in research.first_seen(pages, few=few).collect()} == want


def test_research(spark, tmp_path):
    rules = "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: Bot\nDisallow:\n"
    assert not research.robots_allows(rules, "other", "/a/x") and research.robots_allows(rules, "other", "/a/b/c") and research.robots_allows(rules, "bot", "/a")
    title, body = research.html_to_markdown("<title>T</title><nav>no</nav><h1>Head</h1><p>One <a href='u'>link</a></p><ul><li>x</li></ul><pre>a  b</pre><script>z</script>")
    assert title == "T" and "# Head" in body and "[link](u)" in body and "- x" in body and "```\na  b\n```" in body and "no" not in body.split() and "z" not in body
    feed = "<rss><item><title>A</title><link>http://a</link><pubDate>d</pubDate></item></rss><entry><title>B</title><id>http://b</id></entry>"
    assert [(x["url"], x["title"]) for x in value(spark, research.from_feed(F.lit(feed)))] == [("http://a", "A"), ("http://b", "B")]
    path = str(tmp_path / "staged")
    rows = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y")], "id string, v string")
    research.stage(rows, path)
    research.stage(rows, path)
    assert research.load_staged(spark, path, "id string, v string").count() == 2 and spark.read.json(path).count() == 2


def test_wiki(spark):
    p = spark.createDataFrame([("p", "A", "See [[B]]", ["t"], [], [], None), ("p", "B", "text", ["t", "u"], [], [], 2)], "project string, title string, body string, tags array<string>, sources array<string>, related array<string>, merge_count int")
    both = wiki.link(p, "p", "A", "B")
    assert {r["title"]: r["related"] for r in both.collect()} == {"A": ["B"], "B": ["A"]}
    assert "- [[B]]" in both.filter("title = 'A'").first()["body"]
    off = wiki.link(both, "p", "A", "B", remove=True)
    assert off.filter("title = 'B'").first()["body"] == "text"
    m = wiki.merge_into(p, "p", "A", "more", ["t", "z"], "s1").filter("title = 'A'").first()
    assert m["tags"] == ["t", "z"] and m["sources"] == ["s1"] and m["merge_count"] == 1 and m["body"].endswith("more")
    assert "## t\n\n- [[A]] - See [[B]]\n- [[B]] - text" in wiki.index_page(p, "p").first()["page"]
    assert [(r["title"], r["from_title"]) for r in wiki.backlinks(p).collect()] == [("B", "A")]


def test_expansions(spark):
    rows = [("q", [["lex", "a"], ["vec", "b c"]]), ("Q ", [["lex", "x"]]), ("", [["lex", "x"]]), ("r", [["bad", "x"]])]
    p = spark.createDataFrame([(q, o, i) for i, (q, o) in enumerate(rows)], "query string, output array<array<string>>, n int")
    assert [r["v"] for r in p.select("n", expansion.valid(p).alias("v")).orderBy("n").collect()] == [True, True, False, False]
    assert sorted(r["n"] for r in expansion.dedup(p, ["n"]).collect()) == [0, 2, 3]
    typed = expansion.parse_lines(F.lit("vec: b\nhyde: h\nnoise\nlex: a"))
    assert value(spark, expansion.render_lines(expansion.hyde_first(typed))) == "hyde: h\nvec: b\nlex: a"
    good = "lex: spark joins\nvec: how do spark joins work\nhyde: Spark joins combine two tables by their keys, and may broadcast the small one."
    s = reward.score(spark.createDataFrame([("spark join speed", good), ("a", "no prefix"), ("spark joins", "lex: spark joins\nvec: what they are")], "query string, expansion string")).collect()
    assert s[0]["rating"] == "Excellent" and s[1]["total"] == 0 and s[1]["rating"] == "Failed" and s[2]["percentage"] <= 50


def test_metrics(spark):
    res = spark.createDataFrame([("q", 1, "x.md"), ("q", 2, "vault://c/a/b.md")], "query_id string, rank int, file string")
    want = spark.createDataFrame([("q", "a/b.md"), ("q", "z.md"), ("r", "y.md")], "query_id string, file string")
    got = {r["query_id"]: r for r in evaluate.retrieval(res, want, 1).collect()}
    assert (got["q"]["precision_at_k"], got["q"]["recall"], got["q"]["mrr"]) == (0, 0.5, 0.5) and got["r"]["mrr"] == 0
    p = spark.createDataFrame([("q", "lex", "fast joins"), ("q", "lex", "other thing")], "query string, type string, text string")
    g = spark.createDataFrame([("q", "lex", "fast join joins"), ("q", "vec", "x y")], "query string, type string, text string")
    m = {r["type"]: r for r in evaluate.expansion_match(p, g).collect()}
    assert m["lex"]["precision"] == 0.5 and m["lex"]["recall"] == 1.0 and m["vec"]["f1"] == 0


def test_formats_and_config(spark):
    rows = spark.createDataFrame([(1, "d", 0.5, "f", 'a "b"', "s<")], "rank int, docid string, score double, file string, title string, snippet string")
    assert [r["line"] for r in formatter.as_csv(rows, ["title", "file"]).orderBy("rank").collect()] == ["title,file", '"a ""b""",f']
    assert formatter.as_files(rows).first()["line"] == "#d,0.50,f" and "s&lt;" in formatter.as_xml(rows).first()["line"]
    assert config.merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    assert config.substitute({"a": ["${X}"]}, {"X": "y"}) == {"a": ["y"]}
    with pytest.raises(ValueError):
        config.require({"a": {}}, ["a.b"])
    with pytest.raises(ValueError):
        config.collection_name("a/b")


def test_nearest_of_many_goes_on_in_blocks(spark):
    from siltstone.operators import vector

    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "hash_seq int, embedding array<double>")
    q = spark.createDataFrame([(i, e) for i, e in rows if i % 4 == 0], "qid int, query array<double>")
    got = [sorted(vector.nearest_of_many(v, q, 3, query_bytes=n).select("qid", "hash_seq", "rank").collect()) for n in (0, 100, 1 << 20)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 30


def test_retry_queue_keeps_new_sessions(spark):
    sessions_ = spark.createDataFrame([("new",), ("once",), ("thrice",), ("once",)], "session_id string")
    failed = spark.createDataFrame([("once",), ("thrice",), ("thrice",), ("thrice",)], "session_id string")
    assert sorted(r["session_id"] for r in knowledge.retry_queue(sessions_, failed, 3).collect()) == ["new", "once"]


def test_nulls_are_shared_with_nobody(spark):
    pages = spark.createDataFrame([(1, "u1", "b1"), (2, None, "b1"), (3, None, None), (4, None, None), (5, "u1", None), (6, "u2", "b2"), (7, "u2", "b3"), (8, "u3", "b3")], "page_id long, canonical_url string, body_hash string")
    got = {r["page_id"]: r["accepted"] for r in research.first_seen(pages).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False, 8: True}
    assert research.first_seen(pages.limit(0)).count() == 0


def test_ordered_budgets_over_many_ranges(spark):
    rows = spark.range(0, 500, 1, 7).selectExpr("id page_id", "cast(repeat('x', cast(id % 5 as int)) as string) body_md")
    spent, want = 0, 0
    for k in range(500):
        spent += k % 5
        want += spent <= 300 and k < 200
    assert research.budgeted(rows, 200, 300).count() == want
    kept = knowledge.within_budget(rows.withColumn("c", F.length("body_md")), "c", ["page_id"], 301)
    assert kept.count() == sum(sum(j % 5 for j in range(k)) < 301 for k in range(500))


def test_chunks_leave_in_small_batches(spark):
    """A task's batches of texts and of chunks are bounded, whatever the number of documents."""
    from siltstone import batches

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    d = spark.range(3000, numPartitions=1).selectExpr("cast(id as string) as hash", "repeat('word ', 1000) as doc")
    out = chunk.chunk_documents(d)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= batches.BATCH_ROWS
    assert out.count() == 3000 * len(chunk.chunks("word " * 1000))


def test_vocabulary_counts_repeated_ids_once(spark):
    rows = [("a", "x/a.md", "t", "one two two"), ("a", "x/a.md", "t", "one three"), ("b", "x/b.md", "t", "two t"), ("c", "x/c.md", None, None)]
    d = spark.createDataFrame(rows, "id string, filepath string, title string, body string")
    got = {tuple(r) for r in index.vocabulary_of(d).collect()}
    assert got == {tuple(r) for r in index.vocabulary(index.postings(d)).collect()}
    assert ("two", 2, 3) in got and ("one", 1, 2) in got and ("t", 2, 4) in got
    plan = index.vocabulary_of(d.filter("id <> 'a'"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # terms and counts only


def test_texts_without_an_index_are_stemmed(spark):
    from siltstone.operators import bm25

    rows = [("a", "a.md", "t", "a thing", True), ("b", "b.md", "t", "Things and thieves", True), ("c", "c.md", "t", "nothing", True)]
    d = spark.createDataFrame(rows, "id string, filepath string, title string, body string, active boolean")
    got = bm25.search(None, None, d, A.parse_query('"things"', A.stem), terms=lambda text: A.stemmed(A.tokens(text)))
    assert {r["id"] for r in got.collect()} == {"a", "b"}
