"""The score of expansions, by cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import reward


@pytest.fixture(scope="module")
def scored(spark):
    def of(query, expansion):
        return reward.score(spark.createDataFrame([(query, expansion)], "query string, expansion string")).first().asDict()

    return of


def test_entities(spark):
    want = {
        "API deploy": {"api", "deploy"},
        "Deploy React app": {"react", "app"},
        "what is HoW node.js today": {"how", "node.js", "today"},
        "Bob asked about deploy": {"bob"},
        "the TDS motorsports team": {"tds", "motorsports"},
        "compare two lists": set(),
        "": set(),
    }
    rows = spark.createDataFrame([(q,) for q in want], "q string").select("q", reward.entities(F.col("q")).alias("e")).collect()
    assert {r["q"]: set(r["e"]) for r in rows} == want


def test_lines(spark):
    rows = [("how to", True, False), ("search for it", True, False), ("overview of rome", False, True), ("guide to the roman forum", False, False)]
    got = spark.createDataFrame([(x[0],) for x in rows], "x string").select("x", reward.says_nothing(F.col("x")), reward.has_filler(F.col("x"), F.lit("rome"))).collect()
    assert [tuple(r) for r in got] == rows


def test_repetition(spark):
    rows = [("one two", 0), ("word word word word", 4), ("the the the the", 0), ("ab ab ab", 0), ("", 0)]
    got = spark.createDataFrame([(x[0],) for x in rows], "x string").select("x", reward.repetition(F.col("x"))).collect()
    assert [tuple(r) for r in got] == rows


def test_names_that_are_dropped_cost_points(scored):
    kept = scored("Postgres tuning", "lex: memory for tuning of postgres\nvec: how does tuning the memory of postgres work")
    assert (kept["entity_points"], kept["total"], kept["max_points"]) == (20, 120, 120) and kept["reward"] == 1.0
    gone = scored("Postgres tuning", "lex: memory settings\nvec: how should memory be set up")
    # -30 for the lines, -20 for each of the two names, and a lex line without any term of the query
    assert gone["entity_points"] == 0 and gone["total"] == 30 + 30 + 15 - 70 + 20


def test_echo_caps(scored):
    s = scored("spark joins", "lex: spark joins\nvec: what joins in spark are")
    assert s["percentage"] == 50.0 and s["rating"] == "Acceptable"


def test_one_kind_only(scored):
    s = scored("spark join /only:hyde", "hyde: " + "x" * 60)
    assert (s["only_mode"], s["format_points"], s["diversity_points"], s["quality_points"], s["entity_points"], s["total"]) == ("hyde", 30, 15, 20, 10, 95)
    assert scored("spark join /only:lex", "vec: a")["rating"] == "Failed"
    assert scored("spark join /ONLY:vec ", "vec: how does spark join\nvec: how are rows of two tables joined\nlex: x")["format_points"] == 20


def test_thoughts_marks_and_odd_lines(scored):
    assert scored("a b", "<think>hm\n</think>\n lex: b c \n\nvec: what a b may be like\n")["think_points"] == 0
    assert scored("a b", "lex: b c\nvec: x<|im_start|>")["total"] == 0
    assert scored("a b", "said\nlex: b c")["max_points"] == 100
    assert scored("a b", "lex: b c\nvec: what a b may be like<|im_end|>")["think_points"] == 20


def test_second_scorer(spark):
    """Points worked out by hand: names in a chain, fixed distances, light echoes."""
    rows = [
        ("how to use AWS lambda layers", "lex: aws lambda\nlex: lambda layers\nvec: use layers with AWS lambda functions", dict(format_points=30, diversity_points=30, quality_points=20, entity_points=20, think_points=20, total=120, max_points=120, rating="Excellent")),
        # the second lex line has one word more: too near for 2; it keeps one name of the chain
        ("Redis cache", "lex: cache size\nlex: cache size max\nvec: Redis", dict(diversity_points=28, quality_points=12, entity_points=10)),
        # `Postgres` is no name at the start; an echo costs 3
        ("Postgres tuning", "lex: postgres tuning\nvec: tuning a large database server\nhyde: Postgres postgres postgres postgres.", dict(diversity_points=27, hyde_points=13, entity_points=10, max_points=140)),
        ("Node.js and C++ bindings", "lex: what is\nvec: node.js bindings", dict(entity_points=0, quality_points=15)),
        ("plain query", "lex: x\nnoise", dict(total=0, max_points=100, rating="Failed")),
        ("plain query", "<think>x</think>lex: plain\nvec: the plain query that is asked", dict(think_points=0, entity_points=10)),
    ]
    got = reward.second_score(spark.createDataFrame([(k, q, e) for k, (q, e, _) in enumerate(rows)], "n int, query string, expansion string")).orderBy("n").collect()
    for r, (q, e, want) in zip(got, rows):
        assert {k: r[k] for k in want} == want, (q, r)
    names = spark.createDataFrame([("what is the GitHub Actions cache for my-app",)], "query string").select(reward.chained_entities(F.col("query")).alias("n")).first()["n"]
    assert names == ["github", "actions", "cache", "my-app"]
