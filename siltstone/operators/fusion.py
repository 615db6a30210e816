"""Reciprocal-rank fusion of ranked lists with traces, best chunks, and the blend with a reranker's scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.memo import key as _key

#: Rank constant, bonuses for a first and for a second or third place, candidates kept, limits of a strong first hit. Fixed values.
K, FIRST, NEXT, CANDIDATES, STRONG, GAP = 60, 0.05, 0.02, 40, 0.85, 0.15
#: Share of the fused rank in the blend, for the first ranks, the next and the rest. Fixed values.
BLEND = [(3, 0.75), (10, 0.60), (None, 0.40)]


def rank_lists(lists: DataFrame) -> DataFrame:
    """rank (from 1) of each row within its list by score; ties go to the lesser file."""
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "file")))


def fuse(lists: DataFrame, weights: dict[int, float] | None = None, k: int = K) -> DataFrame:
    """(file, rrf, best_rank) over rows (list, rank, file): the sum of weight / (k + rank), and a bonus for the best place."""
    weight = F.lit(1.0)
    for i, w in (weights or {}).items():
        weight = F.when(F.col("list") == i, F.lit(float(w))).otherwise(weight)
    total = lists.groupBy("file").agg(F.sum(weight / (k + F.col("rank"))).alias("base"), F.min("rank").alias("best_rank"))
    return total.select("file", (F.col("base") + bonus(F.col("best_rank"))).alias("rrf"), "best_rank")


def bonus(best: Column) -> Column:
    return F.when(best == 1, FIRST).when(best <= 3, NEXT).otherwise(0.0)


def trace(lists: DataFrame, weights: dict[int, float] | None = None, k: int = K) -> DataFrame:
    """(file, contributions, base, bonus, total): what each list gave, in the order of lists."""
    weight = F.lit(1.0)
    for i, w in (weights or {}).items():
        weight = F.when(F.col("list") == i, F.lit(float(w))).otherwise(weight)
    part = F.struct("list", "rank", weight.alias("weight"), (weight / (k + F.col("rank"))).alias("part"))
    got = lists.groupBy("file").agg(F.sort_array(F.collect_list(part)).alias("contributions"), F.min("rank").alias("best"))
    base = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["part"])
    return got.select("file", "contributions", base.alias("base"), bonus(F.col("best")).alias("bonus"), (base + bonus(F.col("best"))).alias("total"))


def strong_signal(scores: list[float], intent: str | None = None) -> bool:
    """Whether the two best lexical scores make expansion needless."""
    first, second = (*scores, 0.0, 0.0)[:2]
    return intent is None and first >= STRONG and first - second >= GAP


def first_heavy(n_lists: int, heavy: int, weight: float = 2.0) -> dict[int, float]:
    """Weights by position: the first `heavy` lists count double."""
    return {i: weight if i < heavy else 1.0 for i in range(n_lists)}


def candidates(fused: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The best of the fused rows with their place; one small sort of a top-k."""
    top = fused.orderBy(F.desc("rrf"), "file").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rrf"), "file")))  # at most `limit` rows


def term_score(text: Column, terms: list[str], intent: list[str] | None = None, weight: float = 0.5) -> Column:
    """Query terms that text holds, and intent terms at a lower weight."""
    low = F.lower(text)
    score = sum((F.when(low.contains(t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))
    return sum((F.when(low.contains(t), weight).otherwise(0.0) for t in intent or []), score)


def best_chunk(chunks: DataFrame, query: str, intent: list[str] | None = None) -> DataFrame:
    """(file, seq, pos, text) of each file's first chunk (file, seq, pos, text) with the most query terms longer than two letters."""
    terms = [t for t in query.lower().split() if len(t) > 2]
    scored = chunks.withColumn("s", term_score(F.col("text"), terms, intent))
    return scored.groupBy("file").agg(F.max_by(F.struct("seq", "pos", "text"), F.struct("s", -F.col("seq"))).alias("b")).select("file", "b.*")


def rerank(chosen: DataFrame, query: str, model: Callable[[str, list[str]], list[float]], memo=None, name: str = "rerank") -> DataFrame:
    """chosen (file, text) with rerank scores of an injected model; equal texts are scored once, and with a memo (memo.Memo) texts that this model (name) has scored for this query before are not scored again."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(x) for x in model(query, b.column(0).to_pylist())], pa.float64())], ["text", "rerank"])

    def score(texts: DataFrame) -> DataFrame:
        return texts.mapInArrow(run, "text string, rerank double")

    each = chosen.select("text").dropDuplicates()
    if memo is None:
        scores = score(each)
    else:
        keyed = each.withColumn("key", _key(name, query, F.col("text")))
        answer = lambda todo: score(todo.select("text")).select(_key(name, query, F.col("text")).alias("key"), F.col("rerank").cast("string").alias("value"))
        scores = memo.through(keyed, answer).select("text", F.col("value").cast("double").alias("rerank"))
    return chosen.join(scores, "text", "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))


def blend(rows: DataFrame) -> DataFrame:
    """rows (place, rerank) with score: the fused place counts most at the top."""
    share = F.lit(BLEND[-1][1])
    for upto, w in reversed(BLEND[:-1]):
        share = F.when(F.col("place") <= upto, w).otherwise(share)
    return rows.withColumn("score", share / F.col("place") + (1 - share) * F.col("rerank"))


def finish(rows: DataFrame, limit: int = 10, least: float = 0.0) -> DataFrame:
    """One row a file, its best, of at least `least`, in order."""
    one = rows.groupBy("file").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "file"]), "score").alias("b")).select("file", "b.*")
    return one.filter(F.col("score") >= least).orderBy(F.desc("score"), "file").limit(limit)
