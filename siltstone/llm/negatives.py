"""Hard-negative mining by a block matrix multiply in two dimensions: rows are dealt to blocks and components to chunks; blocks of anchors meet blocks of rows once per chunk, their partial score tiles are shuffled to the tile's place and added as int64, and each finished tile is reduced to the best rows of every anchor-positive window before anything else moves.

Pass 1 takes the pairs of blocks that share a label group: a finished tile gives each anchor its best rows of the same label, a window over all tiles its positives. Pass 2 takes the pairs that can hold different labels, with the anchors' windows beside them; together the passes compute each product once where there are at most 64 labels (one group a label; more labels share groups by hash, and their blocks are met twice). A tile is 256 anchors by 2048 rows at most; a partial tile travels in the narrowest integers that hold it. Tasks hold one tile, whatever the number of rows, labels or components; a label with most rows is many blocks. Partial tiles are as many bytes as scores, for every chunk: that is what this method shuffles.

Edge cases: rows with a null label, or whose vector is null or holds null or non-finite components, take no part; an empty vector is zero, and vectors of different lengths are compared as if zeros followed; components are held within a bound so that no score leaves 64 bits (vectors.integer_rows); rows with a null vec_id are positives and negatives that lose ties, and no anchors; rows that repeat a vec_id are rows of their own; equal scores rank by vec_id; positives with negative scores have an empty window, and one with score 0 takes negatives of score 0; an anchor without positives or a window without rows gives nothing; no rows give no rows; further columns are ignored. There are no texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, released, table
from siltstone.llm.vectors import NEVER, best, integer_rows, longs, matrix, nullable, packed, part_of, products

#: Anchors and rows of a tile at most, components of a chunk, groups of labels.
TILE_ANCHORS, TILE_ROWS, CHUNK, GROUPS = 256, 2048, 32, 64

META = ["n", "row", "vec_id", "label", "absent"]


def chunked(rows: DataFrame, chunks: int, size: int) -> DataFrame:
    """Each row once per chunk of `size` components."""
    part = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda i: F.struct(i.alias("chunk"), F.slice("c", i * size + 1, size).alias("c")))
    return rows.withColumn("piece_of", F.explode(part)).withColumn("chunk", F.col("piece_of.chunk")).withColumn("c", F.col("piece_of.c")).drop("piece_of")


def _partial(windows: list[str]):
    """Products of one chunk of a block pair; what the rows are goes with the first chunk only."""
    keys = ["a_group", "a_part", "a_piece", "group", "part", "piece", "chunk"]
    bytes_of = ["a_row", "a_vec_id", "a_label", *windows, "row", "vec_id", "label", "absent"]

    @released
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = b.slice(r, 1).to_pylist()[0]
                t = products(matrix(x["a_mat"], x["a_n"], x["a_dim"], x["a_width"]), matrix(x["mat"], x["n"], x["dim"], x["width"]))
                top = int(max(t.max(), -int(t.min())))
                width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
                cells = [pa.array([x[c]], pa.int32()) for c in keys] + [pa.array([x["a_n"]], pa.int32()), pa.array([x["n"]], pa.int32()), pa.array([width], pa.int32())]
                cells += [pa.array([x[c] if x["chunk"] == 0 else b""], pa.binary()) for c in bytes_of]
                cells.append(pa.array([t.astype(f"i{width}").tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(cells, names=[*keys, "a_n", "n", "width", *bytes_of, "tile"])

    schema = ", ".join([f"{c} int" for c in [*keys, "a_n", "n", "width"]] + [f"{c} binary" for c in [*bytes_of, "tile"]])
    return run, schema, keys


def _finished(batches, keys: list[str]):
    """(first row's cells, added tile) of each block pair; batches in the order of the keys, the chunk last."""
    at = head = total = None
    for b in batches:
        for r in range(b.num_rows):
            x = b.slice(r, 1).to_pylist()[0]
            key = tuple(x[c] for c in keys[:-1])
            t = np.frombuffer(x["tile"], f"i{x['width']}").reshape(x["a_n"], x["n"])
            if key != at:
                if at is not None:
                    yield head, total
                at, head, total = key, x, t.astype(np.int64)
            else:
                total += t
    if at is not None:
        yield head, total


def _positives(keys: list[str], k: int):
    @released
    def run(batches):
        for x, t in _finished(batches, keys):
            rows, absent = longs(x["row"]), np.frombuffer(x["absent"], np.uint8)
            out = (longs(x["a_label"])[:, None] != longs(x["label"])) | (longs(x["a_row"])[:, None] == rows)
            value = np.where(out, NEVER, t)
            i, j = best(value, k)
            cells = [pa.array(longs(x["a_row"])[i]), pa.array(t[i, j]), nullable(longs(x["vec_id"])[j], absent[j]), pa.array(rows[j])]
            yield pa.RecordBatch.from_arrays(cells, names=["a_row", "score", "vec_id", "row"])

    return run


def _negatives(keys: list[str], windows: list[str], k: int, low: int, high: int):
    @released
    def run(batches):
        for x, t in _finished(batches, keys):
            rows, absent, ids = longs(x["row"]), np.frombuffer(x["absent"], np.uint8), longs(x["vec_id"])
            same = longs(x["a_label"])[:, None] == longs(x["label"])
            t[same] = NEVER
            for w, name in enumerate(windows):
                p = longs(x[name])  # negative: no such positive, or an empty window
                floor, ceiling = [np.array([f(int(v)) for v in p], object) for f in (lambda v: -(-low * v // 100), lambda v: high * v // 100)]
                floor, ceiling = floor.astype(np.int64), ceiling.astype(np.int64)
                live = np.flatnonzero((p >= 0) & (t.max(1) >= floor))
                if not len(live):
                    continue
                some = t[live]
                some[(some < floor[live, None]) | (some > ceiling[live, None])] = NEVER
                i, j = best(some, k)
                if len(i):
                    i = live[i]
                    cells = [pa.array(longs(x["a_row"])[i]), pa.array(longs(x["a_vec_id"])[i]), pa.array(np.full(len(i), w + 1, np.int32)), pa.array(t[i, j]), nullable(ids[j], absent[j]), pa.array(rows[j])]
                    yield pa.RecordBatch.from_arrays(cells, names=["a_row", "anchor_id", "place", "score", "vec_id", "row"])

    return run


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vector: str = "embedding", tile: tuple[int, int] | None = None, chunk: int = CHUNK, groups: int = GROUPS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of vectors (vec_id, label, vector), the rows that satisfy `anchors` each have as positives their first `positives` other rows of the same label; for each, the first `negatives` rows of other labels with low % to high % of its score. First: by inner product, then vec_id."""
    spark = vectors.sparkSession
    asked = F.coalesce(anchors, F.lit(False)) & F.col("vec_id").isNotNull()
    base = integer_rows(vectors.filter("label is not null"), vector, vec_id=F.col("vec_id").cast("long"), label=F.col("label").cast("long"), asked=asked)
    dim = base.agg(F.max(F.size("c"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    labels = sorted(r["label"] for r in base.select("label").distinct().limit(groups + 1).collect())
    alone = len(labels) <= groups  # a group holds one label
    group = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, i)]), F.col("label")) if alone else F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int")
    base = base.withColumn("group", group)
    held = base.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("q")).collect()
    total = sum(r["n"] for r in held)
    a_most, r_most = tile or (TILE_ANCHORS, max(256, min(TILE_ROWS, total // (4 * spark.sparkContext.defaultParallelism))))
    parts = {r["group"]: -(-r["n"] // r_most) for r in held}
    chunks = max(1, -(-dim // chunk))
    of = lambda n: F.element_at(F.create_map(*[F.lit(x) for kv in n.items() for x in kv]), F.col("group"))
    rows = chunked(base.withColumn("part", part_of(of(parts))), chunks, chunk)
    blocks = materialise(packed(rows, ["group", "part", "chunk"], ["label"], r_most), "negatives-rows")
    asking = base.filter("asked").withColumn("part", part_of(of({r["group"]: max(1, -(-r["q"] // a_most)) for r in held})))

    def tiles(ask: DataFrame, targets: Column, windows: list[str]) -> tuple[DataFrame, list[str]]:
        """Partial tiles of the anchors' blocks with all blocks of the target groups, dealt to their places."""
        a = packed(chunked(ask, chunks, chunk), ["group", "part", "chunk"], ["label", *windows], a_most)
        a = a.select("chunk", *[F.col(c).alias(f"a_{c}") for c in ("group", "part", "piece", "n", "dim", "width", "row", "vec_id", "label", "mat")], *windows)
        lots = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(n).alias("parts")) for g, n in sorted(parts.items())])
        every = F.flatten(F.transform(F.filter(lots, lambda b: targets(b["group"])), lambda b: F.transform(F.sequence(F.lit(0), b["parts"] - 1), lambda p: F.struct(b["group"].alias("group"), p.alias("part")))))
        met = a.withColumn("to", F.explode(every)).select("*", "to.group", "to.part").drop("to")
        run, schema, keys = _partial(windows)
        partial = met.join(blocks.hint("shuffle_merge"), ["group", "part", "chunk"]).mapInArrow(run, schema)
        return partial.repartition(*keys[:-1]).sortWithinPartitions(*keys), keys

    part, keys = tiles(asking, lambda g: g == F.col("a_group"), [])
    best_of = part.mapInArrow(_positives(keys, positives), "a_row long, score long, vec_id long, row long")
    place = F.row_number().over(Window.partitionBy("a_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    chosen = materialise(best_of.withColumn("place", place).filter(F.col("place") <= positives), "negatives-positives")
    windows = [f"w{i}" for i in range(1, positives + 1)]
    wide = chosen.groupBy(F.col("a_row").alias("row")).agg(*[F.max(F.when(F.col("place") == i, F.col("score"))).alias(w) for i, w in enumerate(windows, 1)])
    ask = asking.join(wide, "row").withColumns({w: F.coalesce(w, F.lit(-1)) for w in windows})
    part, keys = tiles(ask, (lambda g: g != F.col("a_group")) if alone else (lambda g: F.lit(True)), windows)
    found = part.mapInArrow(_negatives(keys, windows, negatives, low, high), "a_row long, anchor_id long, place int, score long, vec_id long, row long")
    rank = F.row_number().over(Window.partitionBy("a_row", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    with_ids = ranked.join(chosen.select("a_row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["a_row", "place"])
    return with_ids.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.r AS ar, v.vec_id, v.r, a.label = v.label AS same, CAST(list_inner_product(a.c, v.c) AS BIGINT) AS score
  FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.place <= 5
)
SELECT * FROM n WHERE rank <= 3
"""
