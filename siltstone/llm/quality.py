"""Quality rules by weak supervision: each rule votes good (1), bad (-1) or abstains (0); expectation-maximisation estimates what each vote is worth from all documents, and the posterior probability of good quality replaces all-must-pass filtering.

The votes of a document form one of at most 3^rules patterns, so the estimation works on counts of patterns: a bounded aggregate over the whole table.

Edge cases: null and empty texts have no words, every count is 0, and they fail the base rule; very long texts are read whole, in time that grows with their words and the logarithm of them; repeated rows each count; no rows give no rows; further columns are ignored."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import let, materialise, table

#: What parts words; splitting by it is several times as fast as extracting by its complement.
GAP, IN_WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more, by sorting the windows' hashes with their places."""

    def hit(s: Column) -> Column:
        twin = lambda x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
        places = F.transform(s, lambda x, k: F.when(twin(x, k - 1) | twin(x, k + 1), x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(F.filter(places, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2)))))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) >= 4, let(F.sort_array(windows), hit)).otherwise(0)

    return let(words, of).cast("long")


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts of the whole text, and what the rules look at besides."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, GAP, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(IN_WORD))
    counts = documents.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    return counts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]+")).cast("long").alias("n_symbol_runs"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;\"')\]]\s*$"))).cast("long").alias("n_ended_lines"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote; the limits follow the usual published heuristics for web text."""
    w, ch = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    share = {"symbols": F.col("n_symbols") / w, "runs": F.col("n_symbol_runs") / w, "dup": F.col("n_dup_lines") / lines, "repeat": F.col("n_repeat_words") / w, "letters": F.col("n_letters") / ch, "ended": F.col("n_ended_lines") / lines, "mean": F.col("word_chars") / w}
    return {
        "v_length": vote(F.col("n_words") < 20, F.col("n_words") >= 50),
        "v_symbols": vote(share["symbols"] > 0.3, share["symbols"] < 0.05),
        "v_symbol_runs": vote(share["runs"] > 0.2, share["runs"] < 0.05),
        "v_dup_lines": vote((F.col("n_lines") > 2) & (share["dup"] > 0.3), (F.col("n_lines") > 2) & (share["dup"] == 0)),
        "v_repeats": vote(share["repeat"] > 0.4, share["repeat"] < 0.15),
        "v_mean_word": vote((share["mean"] < 2.5) | (share["mean"] > 14), share["mean"].between(3.5, 10)),
        "v_letters": vote(share["letters"] < 0.7, share["letters"] > 0.85),
        "v_ended": vote((F.col("n_lines") > 1) & (share["ended"] < 0.1), share["ended"] > 0.5),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], steps: int = 100, held: float = 0.1) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over counted vote patterns: the share of good documents, and for each rule P(vote | good), P(vote | bad).

    It starts from rules that are mostly right and a share of 0.8, and keeps `held` of the documents' weight at that start (a Dirichlet prior), so that rules which depend on each other don't become a class of their own; a vote for good is at least as likely on good documents, so the classes can't swap."""
    rules = len(patterns[0][0]) if patterns else 0
    start = {1: (0.8, 0.6), -1: (0.02, 0.3), 0: (0.18, 0.1)}
    prior, model = 0.8, [start for _ in range(rules)]
    total = sum(n for _, n in patterns)
    for _ in range(steps if total else 0):
        seen = [{v: [1 + held * total * x for x in start[v]] for v in (-1, 0, 1)} for _ in range(rules)]
        good = 0.0
        for p, n in patterns:
            a = math.log(prior) + sum(math.log(m[v][0]) for m, v in zip(model, p, strict=True))
            b = math.log(1 - prior) + sum(math.log(m[v][1]) for m, v in zip(model, p, strict=True))
            q = 1 / (1 + math.exp(min(700, b - a)))
            good += q * n
            for s, v in zip(seen, p, strict=True):
                s[v][0] += q * n
                s[v][1] += (1 - q) * n
        prior = min(0.99, max(0.01, good / total))
        model = []
        for s in seen:
            g, b = (sum(x[k] for x in s.values()) for k in (0, 1))
            m = {v: (x[0] / g, x[1] / b) for v, x in s.items()}
            for v in (1, -1):
                if (m[v][0] - m[v][1]) * v < 0:
                    m[v] = ((m[v][0] + m[v][1]) / 2,) * 2
            model.append(m)
    return prior, model


def judge(measured: DataFrame) -> DataFrame:
    """measured (materialised) with base_failed, the posterior probability of good quality, and kept."""
    rules = votes()
    voted = measured.select("*", *[v.cast("int").alias(k) for k, v in rules.items()])
    counted = voted.groupBy(*rules).agg(F.count("*").alias("n")).collect()  # at most 3^rules rows
    prior, model = fit([(tuple(r[k] for k in rules), r["n"]) for r in counted])
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, m in zip(rules, model, strict=False):
        for v in (-1, 0, 1):
            odds = odds + F.when(F.col(k) == v, math.log(m[v][0] / m[v][1])).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(materialise(measure(table(spark, sf_dir, "documents")), "quality"))
    return out.select("doc_id", *MEASURES, "base_failed", "kept", "posterior")
