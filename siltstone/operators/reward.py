"""A rule-based score of query expansions, as Spark expressions over (query, expansion)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import let

TEMPLATE_MARKS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "\nassistant\n", "\nuser\n"]
KINDS = ["lex", "vec", "hyde"]

# Words that tell nothing about what a query is after, words that open a query without being a name, phrases that say nothing, filler, and words that a passage may repeat.
COMMON = [
    "what", "is", "how", "to", "the", "a", "an", "in", "on", "for", "of",
    "and", "or", "with", "my", "your", "do", "does", "can", "i", "me", "we",
    "who", "where", "when", "why", "which", "find", "get", "show", "tell",
    "about", "from", "into", "between", "through", "during", "after",
    "before", "like", "than", "then", "that", "this", "their", "its",
    "was", "were", "has", "had", "been", "being", "have", "not", "but",
    "just", "also", "very", "so", "if", "at", "by", "up", "out", "all",
    "some", "any", "no", "each", "every", "both", "few", "more", "most",
    "other", "only", "same", "such", "here", "there", "asked", "said",
    "notes", "meeting", "email", "discussion", "conversation", "call",
]
OPENERS = [
    "configure", "setup", "install", "build", "create", "make", "run",
    "start", "stop", "check", "test", "debug", "fix", "update", "change",
    "add", "remove", "delete", "use", "using", "need", "want", "should",
    "would", "could", "help", "please", "best", "good", "new", "old",
    "latest", "recent", "setting", "settings", "compare", "comparing",
    "implement", "implementing", "deploy", "deploying", "migrate",
    "migrating", "optimize", "optimizing", "understand", "understanding",
    "explain", "list", "describe", "define", "convert", "connecting",
    "performance", "overview", "introduction", "tutorial", "example",
    "difference", "between", "about", "review", "resolve", "resolving",
    "troubleshoot", "troubleshooting", "monitor", "monitoring", "manage",
    "managing", "enable", "disable", "set", "write", "read", "search",
    "possible", "common", "typical", "recommended", "alternative",
]
EMPTY_PHRASES = [
    "find information about", "search for", "look up", "get information",
    "learn about", "information on", "details about", "find out about",
    "what is", "how to", "guide to", "help with",
]
FILLER = ["overview", "basics"]
MAY_REPEAT = ["the", "a", "an", "is", "are", "to", "for", "of", "in", "and", "or", "it", "this", "that", "be", "with", "as", "on", "by"]
#: A query that asks for one kind of line ends so. Fixed value.
ONLY = r"(?i)\s+/only:(lex|vec|hyde)\s*\z"

#: White space as Unicode has it, and with it the separators of records.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
EDGE = r"[.,!?:;()\[\]\"']"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{WS}+|{WS}+\z", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, f"{WS}+"), lambda w: w != "")


def _among(w: Column, known: list[str]) -> Column:
    return w.isin(known)


def _count(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def _lines(text: Column, kind: str) -> Column:
    own = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.startswith(f"{kind}:"))
    return F.transform(own, lambda x: strip(F.substr(x, F.lit(len(kind) + 2))))


def _alike(a: Column, b: Column, least: Column) -> Column:
    """Whether two lines say the same: equal, one within the other, or fewer than `least` words apart."""
    x, y = F.lower(a), F.lower(b)
    apart = F.size(F.array_except(words(x), words(y))) + F.size(F.array_except(words(y), words(x)))
    return x.contains(y) | y.contains(x) | (apart < least)


def _pairs_alike(lines: Column, least: Column) -> Column:
    """Pairs of lines that say the same; a handful of lines a row."""
    per = F.transform(lines, lambda a, i: _count(F.slice(lines, i + 2, F.size(lines)), lambda b: _alike(a, b, least)))
    return F.aggregate(per, F.lit(0), lambda s, n: s + n)


def _echo(line: Column, query: Column) -> Column:
    e, q = F.lower(strip(line)), F.lower(strip(query))
    return (e == q) | (e.contains(q) & (F.length(e) < F.length(q) + 10))


def entities(query: Column) -> Column:
    """Names in a query, in lower case: acronyms, capitalised words that are no common ones, words with technical signs or capitals inside, and the word after such a name."""

    def told(w: Column, i: Column) -> Column:
        c = F.regexp_replace(w, rf"\A{EDGE}+|{EDGE}+\z", "")
        low, long = F.lower(c), F.length(c) >= 2
        capital = c.rlike(r"^\p{Lu}")
        acronym = long & c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")
        proper = capital & ~_among(low, COMMON)
        odd = long & (c.rlike(r"[.+\-#@]") | (capital & c.rlike(r"^.+\p{Lu}")))
        name = F.when(acronym, True).when(proper, (i > 0) | ~_among(low, OPENERS)).otherwise(odd)
        return F.struct(low.alias("low"), name.alias("name"), (~acronym & ~proper & ~odd & ~_among(low, COMMON) & (c != "")).alias("may_follow"))

    def chosen(t: Column) -> Column:
        after = lambda x, i: x["may_follow"] & (i > 0) & F.coalesce(F.get(t, i - 1)["name"], F.lit(False))
        picked = F.transform(t, lambda x, i: F.when(x["name"] | after(x, i), x["low"]))
        return F.array_distinct(F.filter(picked, lambda x: x.isNotNull()))

    return let(F.transform(words(query), told), chosen)


def keeps_terms(line: Column, terms: Column) -> Column:
    return (F.size(terms) == 0) | F.arrays_overlap(terms, words(F.lower(line)))


def keeps_entities(line: Column, names: Column) -> Column:
    return (F.size(names) == 0) | F.exists(names, lambda e: F.lower(line).contains(e))


def says_nothing(line: Column) -> Column:
    """Whether next to nothing is left of a line without the words of an empty phrase that it holds or whose first word it starts with."""
    low = F.lower(strip(line))

    def empty(phrase: str) -> Column:
        rest = low
        for w in phrase.split():
            rest = strip(F.regexp_replace(rest, rf"(?s)\A(.*?){w}", "$1"))
        return (low.contains(phrase) | low.startswith(phrase.split()[0])) & (F.length(rest) < 3)

    return reduce(lambda a, b: a | b, [empty(p) for p in EMPTY_PHRASES])


def has_filler(line: Column, query: Column) -> Column:
    asked = words(F.lower(query))
    return F.exists(words(F.lower(line)), lambda w: _among(w, FILLER) & ~F.array_contains(asked, w))


def repetition(text: Column) -> Column:
    """Two points for each use after the second of a word of three letters or more; in sorted order such a use equals the word two places before."""
    told = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~_among(w, MAY_REPEAT))
    return let(F.sort_array(told), lambda s: 2 * F.size(F.filter(F.transform(s, lambda w, i: (i >= 2) & F.get(s, i - 2).eqNullSafe(w)), lambda x: x)))


def _mean_length(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x)) / F.size(lines)


def _all_or_some(n: Column, of: Column, whole: int, some: int, none: int = 0) -> Column:
    return F.when(n == F.size(of), whole).when(n > 0, some).otherwise(none)


PARTS = ["format_points", "diversity_points", "hyde_points", "quality_points", "entity_points", "think_points"]


def _plain(q: Column, lex: Column, vec: Column, hyde: Column, names: Column) -> dict[str, Column]:
    """Points of an expansion that may hold every kind of line."""
    n_lex, n_vec = F.size(lex), F.size(vec)
    some = lambda c: (F.size(c) > 0).cast("int")
    least = F.when(F.size(words(q)) >= 5, 3).otherwise(2)
    terms = F.array_except(words(F.lower(q)), F.array(*map(F.lit, COMMON)))
    natural = _count(vec, lambda v: v.contains(" ") & (F.length(v) > 15))
    echo = 5 - 10 * _count(lex, lambda x: _echo(x, q)) - 3 * _count(vec, lambda x: _echo(x, q))
    diverse = 10 * some(lex) * some(vec) + F.when(n_lex + n_vec >= 2, 5).otherwise(0) + F.greatest(F.lit(0), 5 - 2 * _pairs_alike(lex, least)) + F.greatest(F.lit(0), 5 - 2 * _pairs_alike(vec, least)) + F.greatest(F.lit(-10), echo)
    passage = let(F.get(hyde, F.lit(0)), lambda h: 10 + F.when(F.length(h).between(50, 200), 5).when(F.length(h) < 50, 2).otherwise(0) + F.greatest(F.lit(0), 5 - repetition(h)))
    with_terms = _count(lex, lambda x: keeps_terms(x, terms))
    quality = (
        5
        + F.when((n_lex > 0) & (n_vec > 0) & (_mean_length(lex) <= _mean_length(vec)), 5).otherwise(0)
        + F.when(n_vec > 0, F.when(natural == n_vec, 5).otherwise(2)).otherwise(0)
        + F.when(n_lex > 0, _all_or_some(with_terms, lex, 5, 2)).otherwise(0)
        - 3 * _count(lex, lambda x: has_filler(x, q))
        + F.when((F.size(words(q)) >= 2) & F.exists(lex, lambda x: x.contains('"')), 3).otherwise(0)
    )
    said = F.lower(F.array_join(F.concat(lex, vec), " "))
    kept = (
        _all_or_some(_count(lex, lambda x: keeps_entities(x, names)), lex, 15, 5, -30)
        - 20 * _count(names, lambda e: ~said.contains(e))
        - 15 * _count(lex, says_nothing)
        + F.when(F.exists(vec, lambda x: keeps_entities(x, names)), 5).otherwise(0)
    )
    return {
        "format_points": 10 * (1 + some(lex) + some(vec)),
        "diversity_points": diverse,
        "hyde_points": F.when(F.size(hyde) > 0, passage).otherwise(0),
        "quality_points": quality,
        "entity_points": F.when(F.size(names) == 0, 10).when(n_lex > 0, kept).otherwise(0),
    }


def _one_kind(kind: str, q: Column, wanted: Column, others: Column, names: Column) -> dict[str, Column]:
    """Points of an expansion that was to hold lines of one kind only; others is how many it has besides."""
    n = F.size(wanted)
    least = F.when(F.size(words(q)) >= 5, 3).otherwise(2)
    diverse = F.when(n >= 2, 15 + F.greatest(F.lit(0), 15 - 5 * _pairs_alike(wanted, least))).otherwise(15) - 5 * _count(wanted, lambda x: _echo(x, q))
    if kind == "lex":
        terms = F.array_except(words(F.lower(q)), F.array(*map(F.lit, COMMON)))
        good = F.when(_count(wanted, lambda x: keeps_terms(x, terms)) == n, 5).otherwise(0) + F.when(_count(wanted, says_nothing) == 0, 5).otherwise(0) - 3 * _count(wanted, lambda x: has_filler(x, q))
    elif kind == "vec":
        good = F.when(_count(wanted, lambda v: v.contains(" ") & (F.length(v) > 15)) == n, 10).otherwise(5)
    else:
        size = F.length(F.get(wanted, F.lit(0)))
        good = F.when(size.between(50, 200), 10).when(size.between(30, 300), 5).otherwise(0)
    kept = _all_or_some(_count(wanted, lambda x: keeps_entities(x, names)), wanted, 20, 15)
    return {
        "format_points": F.greatest(F.lit(0), 30 - 10 * others),
        "diversity_points": F.greatest(F.lit(0), diverse),
        "hyde_points": F.lit(0),
        "quality_points": 10 + good,
        "entity_points": F.when(F.size(names) == 0, 10).otherwise(kept),
    }


def score(rows: DataFrame) -> DataFrame:
    """rows (query, expansion) with the points of each part, total, max_points, percentage, rating, only_mode (the one kind that the query asks for) and reward (0 to 1).

    An expansion with template marks or an unprefixed line gets nothing, nor does one without a line of the one kind asked for; one with a lex line that echoes the query gets half at most."""
    from siltstone.operators.evaluate import rating

    raw = strip(F.replace(strip(F.col("expansion")), F.lit("<|im_end|>"), F.lit("")))
    thought = raw.contains("<think>") & raw.contains("</think>")
    text = F.when(thought, strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))).otherwise(raw)
    only = F.nullif(F.lower(F.regexp_extract("query", ONLY, 1)), F.lit(""))
    base = F.when(only.isNotNull(), strip(F.regexp_replace("query", ONLY, ""))).otherwise(F.col("query"))
    clean = rows.select(*rows.columns, text.alias("_t"), thought.alias("_thought"), only.alias("only_mode"), base.alias("_q"), entities(base).alias("_names"))
    bad_line = F.exists(F.filter(F.transform(F.split("_t", "\n"), strip), lambda x: x != ""), lambda x: ~x.rlike(r"^(?:lex|vec|hyde):"))
    marked = reduce(lambda a, b: a | b, [F.col("_t").contains(m) for m in TEMPLATE_MARKS])
    kinds = {k: F.col(f"_{k}") for k in KINDS}
    parts = clean.select("*", (marked | bad_line).alias("_bad"), *[_lines(F.col("_t"), k).alias(f"_{k}") for k in KINDS])
    q, names = F.col("_q"), F.col("_names")
    missing = reduce(lambda a, b: a | b, [(F.col("only_mode") == k) & (F.size(kinds[k]) == 0) for k in KINDS])
    points = _plain(q, kinds["lex"], kinds["vec"], kinds["hyde"], names)
    for k in KINDS:
        others = reduce(lambda a, b: a + b, [F.size(v) for o, v in kinds.items() if o != k])
        one = _one_kind(k, q, kinds[k], others, names)
        points = {p: F.when(F.col("only_mode") == k, one[p]).otherwise(points[p]) for p in points}
    failed = F.col("_bad") | F.coalesce(missing, F.lit(False))
    points["think_points"] = F.when(F.col("_thought"), 0).otherwise(20)
    out = parts.select(*rows.columns, "only_mode", failed.alias("_failed"), F.size("_hyde").alias("_n_hyde"), (F.col("only_mode").isNull() & F.exists("_lex", lambda x: _echo(x, q))).alias("_echoed"), *[F.when(failed, 0).otherwise(points[p]).alias(p) for p in PARTS])
    out = out.withColumn("_total", reduce(lambda a, b: a + b, [F.col(p) for p in PARTS]))
    out = out.withColumn("max_points", F.when(F.col("_failed"), 100).when(F.col("only_mode").isNull() & (F.col("_n_hyde") > 0), 140).otherwise(120))
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.col("_total") / F.col("max_points")))
    out = out.withColumn("_share", F.when(F.col("_echoed"), F.least(share, F.lit(50.0))).otherwise(share))
    out = out.withColumn("total", F.greatest(F.lit(0), "_total")).withColumn("entity_points", F.greatest(F.lit(0), "entity_points"))
    out = out.withColumn("rating", rating(F.col("_share"))).withColumn("percentage", F.round("_share", 1)).withColumn("reward", F.least(F.lit(1.0), F.col("total") / F.col("max_points")))
    return out.select(*rows.columns, "only_mode", *PARTS, "total", "max_points", "percentage", "rating", "reward")


#: The second scorer's words that tell nothing: those that ask, the first of COMMON.
ASKING = COMMON[: COMMON.index("tell") + 1]


def chained_entities(query: Column) -> Column:
    """Names as the second scorer finds them: a capitalised first word is none, and every word after a name is one too, up to the next that asks."""

    def seen(state: Column, x: Column) -> Column:
        c = F.regexp_replace(x["w"], rf"\A{EDGE}+|{EDGE}+\z", "")
        low, long, capital = F.lower(c), F.length(c) >= 2, c.rlike(r"^\p{Lu}")
        acronym = long & c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")
        other = (x["i"] > 0) & capital & ~_among(low, ASKING)
        odd = long & (c.rlike(r"[.+\-#@]") | (capital & c.rlike(r"^.+\p{Lu}")))
        name = (c != "") & (acronym | other | odd | (state["after"] & ~_among(low, ASKING)))
        return F.struct(name.alias("after"), F.when(name, F.array_append(state["names"], low)).otherwise(state["names"]).alias("names"))

    numbered = F.transform(words(query), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    start = F.struct(F.lit(False).alias("after"), F.array().cast("array<string>").alias("names"))
    return F.array_distinct(F.aggregate(numbered, start, seen, lambda s: s["names"]))


def second_score(rows: DataFrame) -> DataFrame:
    """rows (query, expansion) with the points of the evaluation's own, lighter scorer: fixed distances between lines (2 for lex, 3 for vec), 3 points for an echo, no filler, coverage, quotes or cap, and no queries for one kind; otherwise as score."""
    from siltstone.operators.evaluate import rating

    raw = strip(F.replace(strip(F.col("expansion")), F.lit("<|im_end|>"), F.lit("")))
    thought = raw.contains("<think>") & raw.contains("</think>")
    text = F.when(thought, strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))).otherwise(raw)
    clean = rows.select(*rows.columns, text.alias("_t"), thought.alias("_thought"), chained_entities(F.col("query")).alias("_names"))
    parts = clean.select("*", *[_lines(F.col("_t"), k).alias(f"_{k}") for k in KINDS])
    lex, vec, hyde, names, q = (F.col(c) for c in ("_lex", "_vec", "_hyde", "_names", "query"))
    n_lex, n_vec = F.size(lex), F.size(vec)
    some = lambda c: (F.size(c) > 0).cast("int")
    bad_line = F.exists(F.filter(F.transform(F.split("_t", "\n"), strip), lambda x: x != ""), lambda x: ~x.rlike(r"^(?:lex|vec|hyde):"))
    failed = bad_line | reduce(lambda a, b: a | b, [F.col("_t").contains(m) for m in TEMPLATE_MARKS])
    terms = F.array_except(words(F.lower(q)), F.array(*map(F.lit, ASKING)))
    natural = _count(vec, lambda v: v.contains(" ") & (F.length(v) > 15))
    zero = F.lit(0)
    points = {
        "format_points": 10 * (1 + some(lex) + some(vec)),
        "diversity_points": 10 * some(lex) * some(vec) + F.when(n_lex + n_vec >= 2, 5).otherwise(0) + F.greatest(zero, 5 - 2 * _pairs_alike(lex, F.lit(2))) + F.greatest(zero, 5 - 2 * _pairs_alike(vec, F.lit(3))) + F.greatest(zero, 5 - 3 * _count(F.concat(lex, vec), lambda x: _echo(x, q))),
        "hyde_points": F.when(F.size(hyde) > 0, let(F.get(hyde, zero), lambda h: 10 + F.when(F.length(h).between(50, 200), 5).when(F.length(h) < 50, 2).otherwise(0) + F.greatest(zero, 5 - repetition(h)))).otherwise(0),
        "quality_points": 5 + F.when((n_lex > 0) & (n_vec > 0) & (_mean_length(lex) <= _mean_length(vec)), 5).otherwise(0) + F.when(n_vec > 0, F.when(natural == n_vec, 5).otherwise(2)).otherwise(0) + F.when(n_lex > 0, _all_or_some(_count(lex, lambda x: keeps_terms(x, terms)), lex, 5, 2)).otherwise(0),
        "entity_points": F.when(F.size(names) == 0, 10).when(n_lex > 0, _all_or_some(_count(lex, lambda x: keeps_entities(x, names)), lex, 15, 5, -30) - 15 * _count(lex, says_nothing) + F.when(F.exists(vec, lambda x: keeps_entities(x, names)), 5).otherwise(0)).otherwise(0),
        "think_points": F.when(F.col("_thought"), 0).otherwise(20),
    }
    out = parts.select(*rows.columns, failed.alias("_failed"), F.size(hyde).alias("_n"), *[F.when(failed, 0).otherwise(points[p]).alias(p) for p in PARTS])
    out = out.withColumn("_total", reduce(lambda a, b: a + b, [F.col(p) for p in PARTS]))
    out = out.withColumn("max_points", F.when(F.col("_failed"), 100).when(F.col("_n") > 0, 140).otherwise(120))
    out = out.withColumn("_share", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.col("_total") / F.col("max_points"))))
    out = out.withColumn("total", F.greatest(zero, "_total")).withColumn("entity_points", F.greatest(zero, "entity_points"))
    return out.withColumn("rating", rating(F.col("_share"))).withColumn("percentage", F.round("_share", 1)).select(*rows.columns, *PARTS, "total", "max_points", "percentage", "rating")
