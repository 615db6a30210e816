"""Context texts attached to collections and path prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(collections: DataFrame) -> DataFrame:
    """(collection, prefix, context) of the collections' context maps."""
    return collections.select(F.col("name").alias("collection"), F.explode("context").alias("prefix", "context"))


def matching(documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """documents with each context whose prefix their path has; contexts are a small dimension, joined by collection."""
    c = contexts.withColumn("bare", F.regexp_replace("prefix", "^/+", ""))
    return documents.join(c, "collection").filter(F.col("path").startswith(F.col("bare")))


def all_contexts(documents: DataFrame, contexts: DataFrame, global_context: str | None = None) -> DataFrame:
    """(collection, path, context): the global text and every matching one, shortest prefix first, parted by blank lines; null if none."""
    got = matching(documents.filter("active").select("collection", "path"), contexts)
    texts = F.transform(F.sort_array(F.collect_list(F.struct(F.length("bare").alias("n"), "context"))), lambda x: x["context"])
    joined = got.groupBy("collection", "path").agg(texts.alias("texts"))
    both = documents.filter("active").select("collection", "path").join(joined, ["collection", "path"], "left")
    every = F.concat(F.array(F.lit(global_context)) if global_context else F.array().cast("array<string>"), F.coalesce("texts", F.array().cast("array<string>")))
    return both.select("collection", "path", F.nullif(F.array_join(every, "\n\n"), F.lit("")).alias("context"))


def longest_context(documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """(collection, path, context) by the longest matching prefix only."""
    got = matching(documents.filter("active").select("collection", "path"), contexts)
    return got.groupBy("collection", "path").agg(F.max_by("context", F.struct(F.length("bare"), "bare")).alias("context"))


def put(collections: DataFrame, collection: str, prefix: str, text: str) -> DataFrame:
    new = F.map_concat(F.map_filter(F.coalesce("context", F.create_map().cast("map<string,string>")), lambda k, _: k != prefix), F.create_map(F.lit(prefix), F.lit(text)))
    return collections.withColumn("context", F.when(F.col("name") == collection, new).otherwise(F.col("context")))


def remove(collections: DataFrame, collection: str, prefix: str) -> DataFrame:
    return collections.withColumn("context", F.when(F.col("name") == collection, F.map_filter("context", lambda k, _: k != prefix)).otherwise(F.col("context")))


def without_context(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """(name, documents) of collections with no context."""
    bare = collections.filter(F.coalesce(F.size("context"), F.lit(0)) <= 0).select("name")
    n = documents.filter("active").groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("documents"))
    return bare.join(n, "name", "left").select("name", F.coalesce("documents", F.lit(0)).alias("documents"))


def folders_without_context(documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """(collection, folder) of top folders that no context prefix names."""
    top = documents.filter(F.col("active") & F.col("path").contains("/")).select("collection", F.substring_index("path", "/", 1).alias("folder")).distinct()
    named = contexts.select("collection", F.substring_index(F.regexp_replace("prefix", "^/+", ""), "/", 1).alias("folder"))
    return top.join(named, ["collection", "folder"], "left_anti")
