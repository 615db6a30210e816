"""Retrieval metrics, and scores of query expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least similarity of a predicted and a golden expansion, by type and over all. Fixed values.
LEAST = {"lex": 0.5, "vec": 0.35, "hyde": 0.25, "all": 0.4}
#: Bands of a reward's percentage. Fixed values.
BANDS = [(80, "Excellent"), (60, "Good"), (40, "Acceptable"), (20, "Poor")]


def normal_path(p: Column) -> Column:
    bare = F.when(p.rlike(r"^\w+://"), F.regexp_replace(p, r"^\w+://[^/]*/?", "")).otherwise(p)
    return F.regexp_replace(F.lower(bare), "^/+|/+$", "")


def same_file(a: Column, b: Column) -> Column:
    a, b = normal_path(a), normal_path(b)
    return a.endswith(b) | b.endswith(a)


def retrieval(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision_at_k, recall, mrr, f1, hits_at_k) over results (query_id, rank, file) and expected (query_id, file)."""
    want = expected.select("query_id", F.col("file").alias("want"))
    # One path is the other's end: then their last steps are equal, unless the shorter one is a bare name.
    last = lambda c: F.element_at(F.split(normal_path(F.col(c)), "/"), -1)
    bare = lambda c: ~normal_path(F.col(c)).contains("/")
    r, w = results.withColumn("last", last("file")).withColumn("bare", bare("file")), want.withColumn("last", last("want")).withColumn("bare", bare("want"))
    same = r.drop("bare").join(w.drop("bare"), ["query_id", "last"]).select("query_id", "rank", "file", "want")
    some = lambda a, b: a.filter("bare").drop("bare", "last").join(b.drop("bare"), "query_id")
    odd = some(r, w).filter(last("file") != F.col("last")).drop("last").unionByName(some(w, r.filter("not bare")).filter(last("want") != F.col("last")).drop("last"))
    met = same.unionByName(odd.select("query_id", "rank", "file", "want")).filter(same_file(F.col("file"), F.col("want")))
    of = met.groupBy("query_id", "want").agg(F.min("rank").alias("r")).groupBy("query_id").agg(F.count("*").alias("found"), F.count_if(F.col("r") <= k).alias("hits_at_k"), F.min("r").alias("first"))
    n = want.groupBy("query_id").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    p, r = zero("hits_at_k") / F.least(F.lit(k), F.col("n")), zero("found") / F.col("n")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return n.join(of, "query_id", "left").select("query_id", p.alias("precision_at_k"), r.alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), f1.alias("f1"), zero("hits_at_k").alias("hits_at_k"))


def summary(scores: DataFrame, by: str = "backend") -> DataFrame:
    return scores.groupBy(by).agg(*[F.avg(c).alias(c) for c in ("precision_at_k", "recall", "mrr", "f1")], F.count("*").alias("queries"))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def words(text: Column, stop: list[str] | None = None) -> Column:
    t = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    t = F.filter(t, lambda w: F.length(w) > 1)
    return F.array_except(t, F.array(*[F.lit(s) for s in stop])) if stop else t


def expansion_match(predicted: DataFrame, golden: DataFrame) -> DataFrame:
    """(query, type, precision, recall, f1): predictions match their most similar golden line of the type if it is similar enough; precision counts matched predictions, recall distinct matched golden lines."""
    p = predicted.select("query", "type", F.col("text").alias("p"), words(F.col("text")).alias("pw")).distinct()
    g = golden.select("query", "type", F.col("text").alias("g"), words(F.col("text")).alias("gw")).distinct()
    least = F.lit(LEAST["all"])
    for t in ("lex", "vec", "hyde"):
        least = F.when(F.col("type") == t, LEAST[t]).otherwise(least)
    pairs = p.join(g, ["query", "type"]).withColumn("s", jaccard(F.col("pw"), F.col("gw")))
    best = pairs.groupBy("query", "type", "p").agg(F.max_by("g", F.struct("s", "g")).alias("g"), F.max("s").alias("s")).filter(F.col("s") >= least)
    hit = best.groupBy("query", "type").agg(F.count("*").alias("mp"), F.count_distinct("g").alias("mg"))
    n = p.groupBy("query", "type").agg(F.count("*").alias("np")).join(g.groupBy("query", "type").agg(F.count("*").alias("ng")), ["query", "type"], "full_outer").join(hit, ["query", "type"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    pr, rc = F.when(zero("np") > 0, zero("mp") / F.col("np")).otherwise(0.0), F.when(zero("ng") > 0, zero("mg") / F.col("ng")).otherwise(0.0)
    return n.select("query", "type", pr.alias("precision"), rc.alias("recall"), F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0).alias("f1"))


def rating(percentage: Column) -> Column:
    out = F.lit("Failed")
    for least, name in reversed(BANDS):
        out = F.when(percentage >= least, name).otherwise(out)
    return out


def reward_profile(scores: DataFrame, column: str = "percentage") -> DataFrame:
    """One row: mean, median, least, most, and the share of 70 and more."""
    c = F.col(column)
    return scores.agg(F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg((c >= 70).cast("double")).alias("share_70"))


def dataset_profile(pairs: DataFrame) -> DataFrame:
    """(band, category, n, with_lex, with_vec, with_hyde) of training pairs (query, category, types)."""
    n = F.size(F.split(F.trim("query"), r"\s+"))
    band = F.when(n <= 2, "short").when(n <= 6, "medium").otherwise("long")
    has = lambda t: F.count_if(F.array_contains("types", t)).alias(f"with_{t}")
    return pairs.groupBy(band.alias("band"), "category").agg(F.count("*").alias("n"), has("lex"), has("vec"), has("hyde"))
