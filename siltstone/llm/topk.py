"""Exact top-k search by inner product: vectors are grouped by length, each query prunes a group by length or by coordinate from its local cosine threshold, and products of what is left are verified.

Steps. Components become integers, and rows are cut into buckets of similar length at quantiles of the length, the longest first, and a bucket into blocks of bounded size by hash (so equal lengths don't meet in one task). Queries, in blocks too, first meet one block of the longest vectors, which is broadcast; the k-th best score there is a query's threshold t from then on. A query block then meets the blocks of those buckets only whose longest vector can reach some query's t. Within such a pair, a query needs a cosine of t / (its length x the bucket's greatest length): over 1, it skips the bucket; if the interval that this cosine allows for the query's largest coordinates holds less than half of the block, only the rows inside these intervals are verified (coordinate pruning); else all rows of sufficient length are, as one matrix product for all such queries (length pruning). Products are exact integers. k rows a query and pair leave a task at most, and a window ranks them.

Work is that of the stated queries against all rows less what is pruned. Query blocks travel once per block that they meet, in blocks of up to 8 MB of rows and 1024 queries; nothing but one block is broadcast, and the driver sees quantiles and bucket sizes (64 each).

Edge cases: vectors that are null or hold null or non-finite components take no part; an empty vector is zero, and vectors of different lengths are compared as if zeros followed; components are held within a bound so that no score leaves 64 bits (vectors.integer_rows); rows with a null vec_id are candidates that lose ties, and no queries; rows that repeat a vec_id are rows of their own, candidates to each other; equal scores rank by vec_id; a query with fewer than k other rows gives all; no rows give no rows; further columns are ignored. There are no texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, released, table
from siltstone.llm.vectors import BLOCK_BYTES, NEVER, best, integer_rows, longs, matrix, nullable, packed, part_of, products

#: Buckets of lengths at most, and queries of a block.
BUCKETS, QUERY_ROWS = 64, 1024
#: Rows of a block at least, where there are enough; queries whose products are held at once.
LEAST_ROWS, AT_ONCE = 1024, 256
#: Coordinates that a query looks at, and the cosine from which it is worth looking.
FOCUS, COORDINATE_FROM = 3, 0.3
#: Relative slack of bounds computed in floating point.
SLACK = 1e-9

FOUND = "q_row long, query_id long, score long, vec_id long, row long"


def lengths_of(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(m.astype(np.float64)).sum(1))


def interval(q: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a unit vector's coordinates lie if its cosine with a unit vector of coordinates q is t (in [0, 1]) or more."""
    off = np.sqrt(np.maximum(0.0, (1 - q * q) * (1 - t * t)))
    return np.where(-q >= t, -1.0, q * t - off) - SLACK, np.where(q >= t, 1.0, q * t + off) + SLACK


def candidates(q: np.ndarray, q_len: float, t: float, units: np.ndarray, orders: dict) -> np.ndarray | None:
    """Rows of a block inside the intervals of a query's focus coordinates for a local cosine threshold t; None where that prunes less than half."""
    u = q / q_len
    focus = np.argsort(-np.abs(u))[:FOCUS]
    low, high = interval(u[focus], min(1.0, t))
    kept = None
    for f, lo, hi in zip(focus.tolist(), low, high):
        if kept is None:
            if f not in orders:
                order = np.argsort(units[:, f], kind="stable")
                orders[f] = order, units[order, f]
            order, values = orders[f]
            a, b = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
            if 2 * (b - a) > len(units):
                return None
            kept = np.sort(order[a:b])
        else:
            kept = kept[(units[kept, f] >= lo) & (units[kept, f] <= hi)]
    return kept


def tile(q: np.ndarray, q_rows: np.ndarray, least: np.ndarray, v: np.ndarray, v_rows: np.ndarray, k: int, prune: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of a query block against a block: each query's k best others with scores of `least` or more (NEVER: any), ties to the first row."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    none = np.zeros(0, np.int64)
    if not len(v):
        return none, none, none
    d = max(q.shape[1], v.shape[1])
    q, v = np.pad(q, ((0, 0), (0, d - q.shape[1]))), np.pad(v, ((0, 0), (0, d - v.shape[1])))
    q_len, v_len = lengths_of(q), lengths_of(v)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((least > NEVER) & (q_len > 0), least / q_len, -np.inf)  # the length that a row needs
        local = need / v_len.max() if v_len.max() > 0 else np.where(need > 0, np.inf, -np.inf)
    alive = local <= 1 + SLACK if prune else np.ones(len(q), bool)
    by_length = alive.copy()
    if prune and (alive & (local >= COORDINATE_FROM)).any():
        units, orders = v / np.maximum(v_len, 1e-300)[:, None], {}
        for i in np.flatnonzero(alive & (local >= COORDINATE_FROM)).tolist():
            kept = candidates(q[i].astype(np.float64), q_len[i], float(local[i]), units, orders)
            if kept is None:
                continue
            by_length[i] = False
            kept = kept[v_rows[kept] != q_rows[i]]
            scores = products(q[i : i + 1], v[kept])
            scores[scores < least[i]] = NEVER
            value = scores[0].copy()
            _, at = best(scores, k)
            out.append((np.full(len(at), i), kept[at], value[at]))
    left = np.flatnonzero(by_length)
    for some in (left[a : a + AT_ONCE] for a in range(0, len(left), AT_ONCE)):
        long = np.flatnonzero(v_len >= need[some].min() * (1 - SLACK)) if prune else np.arange(len(v))
        scores = products(q[some], v[long])
        scores[(scores < least[some, None]) | (v_rows[long] == q_rows[some, None])] = NEVER
        value = scores.copy()
        i, at = best(scores, k)
        out.append((some[i], long[at], value[i, at]))
    if not out:
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _seeds(k: int):
    """Query blocks joined with the first block: each with its found rows as arrays, the thresholds, and the length that one of its queries needs at least."""

    @released
    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                q, q_rows = matrix(x["mat"], x["n"], x["dim"], x["width"]), longs(x["row"])
                v_rows, ids, absent = longs(x["v_row"]), longs(x["v_vec_id"]), np.frombuffer(x["v_absent"], np.uint8)
                i, j, s = tile(q, q_rows, np.full(len(q), NEVER), matrix(x["v_mat"], x["v_n"], x["v_dim"], x["v_width"]), v_rows, k, prune=False)
                least = np.full(len(q), NEVER)
                full = np.bincount(i, minlength=len(q)) == k
                lowest = np.full(len(q), np.iinfo(np.int64).max)
                np.minimum.at(lowest, i, s)
                least[full] = lowest[full]
                q_len = lengths_of(q)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where((least > NEVER) & (q_len > 0), least / q_len, -np.inf)
                found = [{"q_row": int(q_rows[a]), "query_id": int(longs(x["vec_id"])[a]), "score": int(c), "vec_id": None if absent[e] else int(ids[e]), "row": int(v_rows[e])} for a, e, c in zip(i.tolist(), j.tolist(), s.tolist())]
                names = ["n", "dim", "width", "row", "vec_id", "mat"]
                cells = [pa.array([x[c]], pa.int32() if i < 3 else pa.binary()) for i, c in enumerate(names)]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("q_row", "query_id", "score", "vec_id", "row")]))
                cells += [pa.array([least.tobytes()], pa.binary()), pa.array([float(need.min())], pa.float64()), pa.array([found], kind)]
                yield pa.RecordBatch.from_arrays(cells, names=[*names, "least", "need", "found"])

    return run


def _search(k: int):
    @released
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = b.slice(r, 1).to_pylist()[0]
                q_rows, v_rows = longs(x["row"]), longs(x["v_row"])
                i, j, s = tile(matrix(x["mat"], x["n"], x["dim"], x["width"]), q_rows, longs(x["least"]), matrix(x["v_mat"], x["v_n"], x["v_dim"], x["v_width"]), v_rows, k)
                if len(i):
                    cells = [pa.array(q_rows[i]), pa.array(longs(x["vec_id"])[i]), pa.array(s), nullable(longs(x["v_vec_id"])[j], np.frombuffer(x["v_absent"], np.uint8)[j]), pa.array(v_rows[j])]
                    yield pa.RecordBatch.from_arrays(cells, names=["q_row", "query_id", "score", "vec_id", "row"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vector: str = "embedding", buckets: int = BUCKETS, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, vector) that satisfies `queries` and has a vec_id, its k highest inner products with other rows."""
    spark = vectors.sparkSession
    asked = F.coalesce(queries, F.lit(False)) & F.col("vec_id").isNotNull()
    base = integer_rows(vectors, vector, vec_id=F.col("vec_id").cast("long"), asked=asked)
    base = base.withColumn("length", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    steps = [i / buckets for i in range(1, buckets)]
    told = base.agg(F.count("*").alias("n"), F.max(F.size("c")).alias("dim"), F.sum(F.col("asked").cast("long")).alias("q"), F.percentile_approx("length", steps or [0.5], 10_000).alias("cuts")).first()
    if not told["n"] or not told["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = max(1, BLOCK_BYTES // (8 * max(1, told["dim"])))
    block_rows = block_rows or max(1, min(most, max(LEAST_ROWS, told["n"] // (4 * spark.sparkContext.defaultParallelism))))
    wanted = min(buckets, -(-told["n"] // block_rows))
    cuts = sorted({told["cuts"][round(i * buckets / wanted) - 1] for i in range(1, wanted)})
    inside = base.withColumn("bucket", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c > F.col("length"))))
    held = inside.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("most")).orderBy("bucket").collect()
    parts = {r["bucket"]: -(-r["n"] // block_rows) for r in held}
    deal = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    blocks = packed(inside.withColumn("part", part_of(deal[F.col("bucket")])), ["bucket", "part"], [], block_rows)
    blocks = materialise(blocks.select("bucket", "part", "piece", *[F.col(c).alias(f"v_{c}") for c in ("n", "dim", "width", "row", "vec_id", "absent", "mat")]), "topk-blocks")
    first = {"bucket": held[0]["bucket"], "part": 0, "piece": 0}
    is_first = F.lit(True)
    for c, v in first.items():
        is_first = is_first & (F.col(c) == v)
    query_rows = max(1, min(QUERY_ROWS, most))
    asking = packed(base.filter("asked").withColumn("group", part_of(-(-told["q"] // query_rows))), ["group"], [], query_rows)
    # One block by its key: its size is bounded by BLOCK_BYTES. Where its hash took no rows, no query has a threshold.
    seed = F.broadcast(blocks.filter(is_first).drop("part", "piece"))
    started = asking.withColumn("bucket", F.lit(first["bucket"])).join(seed, "bucket", "left").drop("bucket")
    empty = F.unhex(F.lit(""))
    started = started.withColumns({f"v_{c}": F.coalesce(f"v_{c}", F.lit(0)) for c in ("n", "dim")} | {"v_width": F.coalesce("v_width", F.lit(2))} | {f"v_{c}": F.coalesce(f"v_{c}", empty) for c in ("row", "vec_id", "absent", "mat")})
    seeded = "n int, dim int, width int, row binary, vec_id binary, mat binary, least binary, need double, found array<struct<q_row: long, query_id: long, score: long, vec_id: long, row: long>>"
    seeds = materialise(started.mapInArrow(_seeds(k), seeded), "topk-seeds")
    lots = F.array(*[F.struct(F.lit(r["bucket"]).alias("bucket"), F.lit(r["most"]).alias("most"), F.lit(parts[r["bucket"]]).alias("parts")) for r in held])
    open_lots = F.filter(lots, lambda b: b["most"] * (1 + SLACK) >= F.col("need"))
    every = F.flatten(F.transform(open_lots, lambda b: F.transform(F.sequence(F.lit(0), b["parts"] - 1), lambda p: F.struct(b["bucket"].alias("bucket"), p.alias("part")))))
    met = seeds.drop("found").withColumn("to", F.explode(every)).select("*", "to.bucket", "to.part").drop("to")
    pairs = met.join(blocks.hint("shuffle_merge"), ["bucket", "part"]).filter(~is_first).drop("bucket", "part", "piece")
    found = pairs.mapInArrow(_search(k), FOUND).unionByName(seeds.select(F.inline("found")))
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
