"""Status, statistics and alerts over an index, and the upkeep of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days without a change after which a collection is stale. Fixed value.
STALE_DAYS = 30


def status(documents: DataFrame) -> DataFrame:
    """(collection, documents, last_modified) of active documents."""
    return documents.filter("active").groupBy("collection").agg(F.count("*").alias("documents"), F.max("modified_at").alias("last_modified"))


def collection_stats(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """(name, total, active, last_modified); collections without documents show 0."""
    n = documents.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("total"), F.sum(F.when(F.col("active"), 1).otherwise(0)).alias("active"), F.max("modified_at").alias("last_modified"))
    return collections.select("name").join(n, "name", "left").select("name", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("active", F.lit(0)).alias("active"), "last_modified")


def missing_vectors(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: distinct active texts without a vector."""
    return documents.filter("active").join(vectors.select("hash"), "hash", "left_anti").agg(F.count_distinct("hash").alias("needs_embedding"))


def index_health(documents: DataFrame, vectors: DataFrame, now) -> DataFrame:
    """One row: documents, texts without vectors, whole days since the last change."""
    d = documents.filter("active").agg(F.count("*").alias("documents"), F.max("modified_at").alias("last"))
    days = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.to_timestamp("last"))) / 86400)
    return d.crossJoin(missing_vectors(documents, vectors)).select("documents", "needs_embedding", days.alias("days_stale"))  # one row each


def overlaps(collections: DataFrame) -> DataFrame:
    """(name_a, name_b) of collections one of whose roots holds the other's; collections are a small table of roots."""
    root = lambda c: F.concat(F.regexp_replace(c, "/+$", ""), F.lit("/"))
    # A root lies within another if one of its own ancestors is that root: an equi-join on ancestors, not on all pairs.
    mine = collections.select("name", root(F.col("root")).alias("r"))
    parts = F.split(F.col("r"), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    ancestors = mine.select(F.col("name").alias("inner"), F.explode(up).alias("r"))
    both = ancestors.join(mine.withColumnRenamed("name", "outer"), "r").filter("inner <> outer")
    return both.select(F.least("inner", "outer").alias("name_a"), F.greatest("inner", "outer").alias("name_b")).distinct()


def alerts(collections: DataFrame, documents: DataFrame, vectors: DataFrame, now, stale_days: int = STALE_DAYS) -> DataFrame:
    """(kind, subject) of all that asks for attention: overlap, no_context, empty, no_embedding, stale."""
    stats = collection_stats(collections, documents)
    parts = [
        overlaps(collections).select(F.lit("overlap").alias("kind"), F.concat_ws(",", "name_a", "name_b").alias("subject")),
        collections.filter(F.coalesce(F.size("context"), F.lit(0)) <= 0).select(F.lit("no_context").alias("kind"), F.col("name").alias("subject")),
        stats.filter("active = 0").select(F.lit("empty").alias("kind"), F.col("name").alias("subject")),
        documents.filter("active").join(vectors.select("hash"), "hash", "left_anti").select(F.lit("no_embedding").alias("kind"), F.col("collection").alias("subject")).distinct(),
        stats.filter(F.to_timestamp("last_modified") < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(stale_days))).select(F.lit("stale").alias("kind"), F.col("name").alias("subject")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tag_counts(pages: DataFrame) -> DataFrame:
    """(tag, pages, projects) over pages (project, tags)."""
    return pages.select("project", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("pages"), F.sort_array(F.collect_set("project")).alias("projects"))


def drop_orphan_content(content: DataFrame, documents: DataFrame) -> DataFrame:
    return content.join(documents.select("hash"), "hash", "left_semi")


def orphan_vectors(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors of texts that no active document has."""
    return vectors.join(documents.filter("active").select("hash"), "hash", "left_anti")


def drop_inactive(documents: DataFrame) -> DataFrame:
    return documents.filter("active")


def compact(spark, path: str, files: int) -> None:
    """Rewrite a table's files into fewer, beside the old ones, for the caller to swap in."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(f"{path}.compact")


def rename_collection(documents: DataFrame, old: str, new: str) -> DataFrame:
    return documents.withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection")))


def remove_collection(documents: DataFrame, name: str) -> DataFrame:
    return documents.withColumn("active", F.col("active") & (F.col("collection") != name))


def cache_key(url: str, body) -> str:
    """Key of a memoised model call."""
    import hashlib
    import json

    return hashlib.sha256((url + json.dumps(body, separators=(",", ":"), ensure_ascii=False)).encode()).hexdigest()


def trim_cache(cache: DataFrame, newest: int = 1000) -> DataFrame:
    """The newest entries."""
    return cache.orderBy(F.desc("created_at"), "hash").limit(newest)
