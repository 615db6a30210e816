"""Approximate vector search, for those who ask for it: inverted lists around k-means centres, as partitions of a table, of which a search opens the nearest. The exact search stays the default."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import vector

#: Vectors that centres are fitted on at most, those whose keys hash least; lists at most, and probes at first.
SAMPLE, LISTS = 20_000, 1024


def _unit(column: str):
    v = F.transform(column, lambda x: x.cast("double"))
    return F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))


def fit(vectors: DataFrame, lists: int | None = None, column: str = "embedding", key: str = "hash_seq", sample: int = SAMPLE, seed: int = 1) -> list[list[float]]:
    """Centres, by k-means on the directions of `sample` vectors at most (those whose keys hash least, so the same ones every time); as many as the root of the number of vectors unless given."""
    sound = vectors.filter(F.exists(column, lambda x: x != 0))
    n = sound.count()
    k = lists or max(1, min(LISTS, round(n**0.5)))
    part = sound.orderBy(F.xxhash64(key), key).limit(sample).select(array_to_vector(_unit(column)).alias("features"))
    return [c.tolist() for c in KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine").fit(part).clusterCenters()]


def _nearest_centre(centres: list[list[float]]):
    from pyspark.sql.functions import pandas_udf

    unit = np.array(centres)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1), 1e-300)[:, None]

    @pandas_udf("int")
    def of(vs):
        import pandas as pd

        # a zero or null vector lies in the first list
        rows = np.stack([np.zeros(unit.shape[1]) if v is None else np.asarray(v, np.float64) for v in vs]) if len(vs) else np.zeros((0, unit.shape[1]))
        return pd.Series((rows @ unit.T).argmax(1).astype(np.int32))

    return of


def assign(vectors: DataFrame, centres: list[list[float]], column: str = "embedding") -> DataFrame:
    """vectors with `list`, the number of the centre nearest in direction."""
    return vectors.withColumn("list", _nearest_centre(centres)(F.col(column)))


def write(vectors: DataFrame, centres: list[list[float]], path: str, column: str = "embedding") -> None:
    """All vectors under path, parted by list; a large list is as many files as its size asks for."""
    assign(vectors, centres, column).hint("rebalance", F.col("list")).write.partitionBy("list").parquet(path)


def probe(centres: list[list[float]], query: list[float], probes: int) -> list[int]:
    """The lists nearest to a query."""
    c, q = np.array(centres), np.array(query, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        close = np.nan_to_num(c @ q / np.linalg.norm(c, axis=1))
    return np.argsort(-close, kind="stable")[:probes].tolist()


def nearest(lists: DataFrame, centres: list[list[float]], query: list[float], k: int, probes: int, column: str = "embedding", key: str = "hash_seq") -> DataFrame:
    """vector.nearest over the probed lists: of a table parted by list only those partitions are read."""
    return vector.nearest(lists.filter(F.col("list").isin(probe(centres, query, probes))), query, k, column, key)


def nearest_of_many(lists: DataFrame, centres: list[list[float]], queries: DataFrame, k: int, probes: int, column: str = "embedding", key: str = "hash_seq") -> DataFrame:
    """(qid, key, distance, rank) as vector.nearest_of_many, over each query's probed lists. Queries meet a list's vectors in blocks of bounded size."""
    from pyspark.sql import Window
    from pyspark.sql.functions import pandas_udf

    c = np.array(centres)
    c = c / np.maximum(np.linalg.norm(c, axis=1), 1e-300)[:, None]

    @pandas_udf("array<int>")
    def probed(qs):
        import pandas as pd

        m = np.stack([np.asarray(q, np.float64) for q in qs]) if len(qs) else np.zeros((0, c.shape[1]))
        return pd.Series(np.argsort(-(m @ c.T), 1, kind="stable")[:, :probes].astype(np.int32).tolist(), dtype=object)

    rows = lists.filter(F.col(column).isNotNull()).select("list", key, column)
    held = rows.groupBy("list").agg(F.count("*").alias("n")).select("list", F.ceil(F.col("n") / vector.BLOCK).alias("parts"))
    parted = rows.join(F.broadcast(held), "list")  # a row a list, LISTS at most
    v = parted.groupBy("list", F.pmod(F.xxhash64(key), "parts").alias("part")).agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col(column).alias("v"))).alias("rows"))
    asked = queries.filter("query is not null")
    groups = max(1, -(-asked.count() // vector.QUERY_BLOCK))
    q = asked.withColumn("list", F.explode(probed("query"))).groupBy("list", F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("qid", "query")).alias("asked"))
    met = q.join(F.broadcast(held), "list").select("list", "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, {key} {lists.schema[key].dataType.simpleString()}, distance double"
    found = met.join(v.hint("shuffle_merge"), ["list", "part"]).select("asked", "rows").mapInArrow(vector._of_blocks(k, key), schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "hash_seq") -> float:
    """Share of the exact search's rows (qid, key) that were found."""
    n = exact.count()
    return exact.select("qid", key).join(found.select("qid", key), ["qid", key], "left_semi").count() / n if n else 1.0


def calibrate(lists: DataFrame, centres: list[list[float]], queries: DataFrame, k: int, least: float = 0.9, column: str = "embedding", key: str = "hash_seq") -> tuple[int, float]:
    """(probes, recall): the fewest probes, by doubling and then by halves, with which queries (qid, query) find `least` of what the exact search finds. All lists find all of it."""
    exact = vector.nearest_of_many(lists, queries, k, column, key)
    of = lambda p: recall(nearest_of_many(lists, centres, queries, k, p, column, key), exact, key)
    low, high, best = 0, 1, None
    while (best := of(high)) < least and high < len(centres):
        low, high = high, min(2 * high, len(centres))
    while high - low > max(1, len(centres) // 16):
        mid = (low + high) // 2
        got = of(mid)
        low, high, best = (low, mid, got) if got >= least else (mid, high, best)
    return high, best
