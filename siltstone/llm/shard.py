"""Sharding by minimax contiguous partition: binary-search the smallest feasible shard capacity over the ordered sizes of atomic groups, check each by a greedy pass, and cut there.

Groups are the sets of equal texts, in the order of their smallest doc_id, ties by the hash of the text. Sizes never leave the cluster as a whole: the driver sees sums of blocks (as many as partitions), and then only the group boundaries that lie where a cut can fall.

Edge cases: a null text is a group apart from the empty text and weighs 1 byte; fewer groups than shards leave the last shards empty; a group larger than an even share sets the capacity, and the greedy cut then fills the first shards up to it; repeated doc_ids are separate rows; very long texts count by their bytes and travel as hashes; groups that have no doc_id but null come first, and null doc_ids are dealt like any others; no rows give no rows; further columns are ignored."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, table

#: Group boundaries that the driver may hold at once (24 bytes each).
EXACT_ROWS = 100_000
#: Bins a search range is cut into while it holds more than EXACT_ROWS boundaries.
BINS = 1024


def greedy(ends: list[int], total: int, shards: int, capacity: int) -> list[int] | None:
    """Cut offsets of a greedy pass over sorted boundaries, each part at most capacity; None if shards parts don't reach total."""
    cuts, at = [], 0
    for _ in range(shards):
        if at >= total:
            break
        k = bisect_right(ends, at + capacity)
        if not k or ends[k - 1] <= at:
            return None
        cuts.append(at := ends[k - 1])
    return cuts if at >= total else None


def least_capacity(ends: list[int], total: int, shards: int, low: int, high: int) -> int:
    """The smallest feasible capacity in [low, high]; high is feasible."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(ends, total, shards, mid) is not None else (mid + 1, high)
    return low


def _reach(ends: list[int], shards: int, capacity: int) -> list[int]:
    """What a greedy pass reaches at least when only some boundaries are known."""
    out, at = [], 0
    for _ in range(shards):
        k = bisect_right(ends, at + capacity)
        at = max(at, ends[k - 1] if k else 0)
        out.append(at)
    return out


def cut_offsets(groups: DataFrame, shards: int, exact_rows: int = EXACT_ROWS, bins: int = BINS) -> tuple[DataFrame, list[int], int]:
    """groups (first, bytes, block), block-ordered by first: the groups with their end offsets, the cuts, the capacity."""
    spark = groups.sparkSession
    blocks = groups.groupBy("block").agg(F.sum("bytes").alias("b"), F.max("bytes").alias("m")).orderBy("block").collect()
    at, offset, ends, largest = 0, [], [], 0
    for r in blocks:
        offset.append((r["block"], at))
        ends.append(at := at + r["b"])
        largest = max(largest, r["m"])
    total = at
    of = F.broadcast(spark.createDataFrame(offset or [(0, 0)], "block int, before long"))
    in_order = Window.partitionBy("block").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.join(of, "block").withColumn("end", F.col("before") + F.sum("bytes").over(in_order))
    if not total:
        return placed, [], 0
    low = max(largest, -(-total // shards))
    while True:
        high = least_capacity(ends, total, shards, low, total)
        spans = [(a, min(total, (j + 1) * high)) for j, a in enumerate(_reach(ends, shards, low))]
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        where = F.lit(False)
        for a, b in merged:
            where = where | F.col("end").between(a, b)
        inside = placed.filter(where)
        if inside.count() <= exact_rows:
            ends = sorted({*ends, *(r["end"] for r in inside.select("end").collect())})
            best = least_capacity(ends, total, shards, low, high)
            return placed, greedy(ends, total, shards, best), best
        step = max(1, sum(b - a for a, b in merged) // bins)
        more = inside.groupBy(F.floor(F.col("end") / step)).agg(F.max("end").alias("end")).collect()
        finer = sorted({*ends, *(r["end"] for r in more)})
        if len(finer) == len(ends):
            exact_rows *= 2  # no finer bin tells more: what is left are the boundaries themselves
        ends, bins = finer, bins * 2


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; equal texts share a shard, and slots are gapless from 0 in each shard."""
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        documents.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("sha"), F.col("text").isNull().alias("absent")),
        "shard-rows",
    )
    groups = rows.groupBy("sha", "absent").agg(F.struct(F.min("doc_id").alias("doc_id"), "absent", "sha").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = materialise(groups.repartitionByRange("first").withColumn("block", F.spark_partition_id()), "shard-groups")
    placed, cuts, _ = cut_offsets(groups.select("first", "bytes", "block"), shards)
    # The first group of each shard after shard 0: one row a cut. As parts of a struct nulls compare, below all else.
    starts = [r["first"] for r in placed.filter((F.col("end") - F.col("bytes")).isin(cuts[:-1])).select("first").collect()] if len(cuts) > 1 else []
    id_type = documents.schema["doc_id"].dataType
    shard = F.lit(0)
    for s in starts:
        at = F.struct(F.lit(s["doc_id"]).cast(id_type).alias("doc_id"), F.lit(s["absent"]).alias("absent"), F.lit(bytes(s["sha"])).alias("sha"))
        shard = shard + (F.col("first") >= at).cast("int")
    shared = groups.filter("n > 1").select("sha", "absent", "first")
    of_group = rows.join(shared, ["sha", "absent"], "left").withColumn("first", F.coalesce("first", F.struct("doc_id", "absent", "sha")))
    dealt = materialise(of_group.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard")).repartitionByRange("doc_id").withColumn("block", F.spark_partition_id()), "shard-dealt")
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).orderBy("shard", "block").collect()  # partitions x shards rows
    before, at = [], {}
    for r in counts:
        before.append((r["shard"], r["block"], at.get(r["shard"], 0)))
        at[r["shard"]] = before[-1][2] + r["n"]
    of = F.broadcast(documents.sparkSession.createDataFrame(before or [(0, 0, 0)], "shard int, block int, before long"))
    rank = F.row_number().over(Window.partitionBy("block", "shard").orderBy("doc_id", "size", "text_crc32"))
    return dealt.join(of, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + rank - 1).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
