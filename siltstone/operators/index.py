"""The content store and its inverted index: snapshots, differences between them, postings and statistics."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.batches import small_batches
from siltstone.durable import written
from siltstone.functions import text as T
from siltstone.functions.analyzer import analysed, places, script_tokens, spaced, stemmed, tokens
from siltstone.operators import packing

#: Fields in the order and with the weights of a match in them. Fixed values.
FIELDS = {"filepath": 1.5, "title": 4.0, "body": 1.0}
#: Rows up to which a list of keys is broadcast.
BROADCAST_ROWS = 500_000
EXCLUDED_FOLDERS = r"(^|/)(?:node_modules|\.git|\.cache|vendor|dist|build|\.[^/]+)(/|$)"


def derive(files: DataFrame, collection: str | None = None, source_type: str = "docs") -> DataFrame:
    """Documents of files (path, text[, collection]): hidden, excluded and blank ones go; hash, short id and title are derived."""
    named = files if collection is None else files.withColumn("collection", F.lit(collection))
    kept = named.filter(~F.col("path").rlike(EXCLUDED_FOLDERS) & (F.trim("text") != "") & F.col("text").rlike(r"\S"))
    clean = kept.withColumn("path", T.clean_path(F.col("path"))).filter(F.col("path").isNotNull())
    h = T.content_hash(F.col("text"))
    return clean.select("collection", "path", T.title(F.col("text"), F.col("path")).alias("title"), h.alias("hash"), T.docid(h).alias("docid"), F.col("text").alias("body"), F.lit(source_type).alias("source_type"), F.lit(True).alias("active"))


def split_store(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content by hash, documents without bodies): equal texts are stored once."""
    content = documents.groupBy("hash").agg(F.any_value("body").alias("doc"))
    return content, documents.drop("body")


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Each (collection, path) with its state: new, updated, retitled, unchanged or removed; previous counts active rows only."""
    old = previous.filter("active").select("collection", "path", F.col("hash").alias("old_hash"), F.col("title").alias("old_title"))
    both = old.join(current.select("collection", "path", "hash", "title"), ["collection", "path"], "full_outer")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("old_hash"), "updated").when(F.col("title") != F.col("old_title"), "retitled").otherwise("unchanged")
    return both.select("collection", "path", F.coalesce("hash", "old_hash").alias("hash"), state.alias("state"))


def merge(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The next snapshot: current rows, and rows that are gone kept as inactive."""
    gone = previous.join(current, ["collection", "path"], "left_anti").withColumn("active", F.lit(False))
    return current.unionByName(gone.select(current.columns))


def counts(states: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state").isin(*s))
    return states.groupBy("collection").agg(n(["new"]).alias("indexed"), n(["updated", "retitled"]).alias("updated"), n(["unchanged"]).alias("unchanged"), n(["removed"]).alias("removed"))


def rename_case(previous: DataFrame, current: DataFrame) -> DataFrame:
    """previous with paths that differ from a current one only by case moved to it, unless that path is taken."""
    free = current.join(previous, ["collection", "path"], "left_anti").select("collection", F.col("path").alias("to"), F.lower("path").alias("low"))
    one = free.groupBy("collection", "low").agg(F.min("to").alias("to"))
    old = previous.withColumn("low", F.lower("path")).join(one, ["collection", "low"], "left")
    return old.withColumn("path", F.coalesce("to", "path")).select(previous.columns)


#: Buckets of terms in a written index, by their first letters, so that a term's and a prefix's rows are found without opening the others.
BUCKETS, BUCKET_LETTERS = 64, 2


#: Columns of written postings. A document's own row, which tells its length, has no term and the bucket OWN, so that one pass over the texts writes both.
POSTINGS = "term string, id string, hash string, field string, n int, length int, positions array<int>, bucket int"
OWN = -1


def bucket(term: Column) -> Column:
    return (F.crc32(F.substring(term, 1, BUCKET_LETTERS).cast("binary")) % BUCKETS).cast("int")


def bucket_of(term: str, prefix: bool = False) -> int | None:
    """The bucket of a term, or of all terms with a prefix; None where a prefix is too short for one."""
    return None if prefix and len(term) < BUCKET_LETTERS else zlib.crc32(term[:BUCKET_LETTERS].encode()) % BUCKETS


def _terms(field: str, stem: bool, korean=None) -> Column:
    if korean is not None:
        return analysed(script_tokens(F.col(field)), korean, stem)
    return stemmed(tokens(F.col(field))) if stem else tokens(F.col(field))


def postings(documents: DataFrame, key: str = "id", stem: bool = False) -> DataFrame:
    """(term, key, field, positions) of active documents with filepath, title and body: one row a term, document and field, made within the document's row: nothing is shuffled. With stem, terms are folded and stemmed."""
    parts = [documents.select(key, F.lit(f).alias("field"), F.explode(places(_terms(f, stem))).alias("p")).select("p.term", key, "field", "p.positions") for f in FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lengths(documents: DataFrame, key: str = "id") -> DataFrame:
    """(key, length): tokens over all fields."""
    return documents.select(key, sum((F.size(tokens(F.col(f))) for f in FIELDS), F.lit(0)).alias("length"))


def statistics(lengths_: DataFrame) -> DataFrame:
    """One row: documents and their mean length."""
    return lengths_.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))


def vocabulary(postings_: DataFrame) -> DataFrame:
    """(term, df, cf): documents and places that hold it."""
    return postings_.groupBy("term").agg(F.count_distinct("id").alias("df"), F.sum(F.size("positions")).alias("cf"))


def vocabulary_of(documents: DataFrame, key: str = "id") -> DataFrame:
    """(term, df, cf) of documents with filepath, title and body, as vocabulary gives them of postings. A row's terms and, after them, its different ones are counted where they lie, so only terms and counts are shuffled; rows of a key that is there more than once are one document, and meet before."""
    every = lambda of: F.concat(*[F.coalesce(tokens(of(f)), F.array().cast("array<string>")) for f in FIELDS])
    repeated = written(documents.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "repeated")
    n = repeated.count()
    rows = documents.select(every(F.col).alias("terms")) if not n else None
    if n:
        named = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated.hint("shuffle_merge")
        alone = documents.join(named, key, "left_anti").select(every(F.col).alias("terms"))
        several = documents.join(named, key, "left_semi").groupBy(key).agg(F.collect_list(F.struct(*FIELDS)).alias("rows"))
        rows = alone.unionByName(several.select(F.flatten(F.transform("rows", lambda r: every(lambda f: r[f]))).alias("terms")))
    each = rows.select(F.size("terms").alias("n"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    return each.groupBy("term").agg(F.count_if(F.col("at") >= F.col("n")).alias("df"), F.count_if(F.col("at") < F.col("n")).alias("cf"))


def _entries(documents: DataFrame, stem: bool, korean) -> tuple[DataFrame, list[Column]]:
    """Documents (id, hash, length and their fields' terms), and each field's array<struct<term, field, positions>>: each text is split, by scripts where there is an analyser of Hangul, and stemmed once, within its row."""
    split = documents.select("id", "hash", *[_terms(f, stem, korean).alias(f) for f in FIELDS])
    length = sum((F.size(f) for f in FIELDS), F.lit(0))
    entries = lambda f: F.transform(places(F.col(f)), lambda p: _entry(p["term"], f, p["positions"]))
    return split.select("id", "hash", length.alias("length"), *FIELDS), [entries(f) for f in FIELDS]


def _entry(term: Column, field: str, at: Column) -> Column:
    return F.struct(term.alias("term"), F.lit(field).alias("field"), at.alias("positions"))


def _own() -> Column:
    return F.array(_entry(F.lit(""), "", F.array().cast("array<int>")))


def written_postings(documents: DataFrame, stem: bool = True, korean=None) -> DataFrame:
    """Postings as they are stored (stemmed, unless told otherwise), of documents (id, hash, filepath, title, body): every term of every field with its places, their number and the document's length, and the document's own row."""
    split, entries = _entries(documents, stem, korean)
    rows = split.select("id", "hash", "length", F.explode(F.concat(_own(), *entries)).alias("e")).select("e.*", "id", "hash", "length")
    is_own = F.col("field") == ""
    return rows.select("term", "id", F.when(is_own, F.col("hash")).alias("hash"), "field", F.size("positions").alias("n"), "length", "positions", F.when(is_own, OWN).otherwise(bucket(F.col("term"))).alias("bucket"))


def packed_postings(documents: DataFrame, stem: bool = True, korean=None) -> DataFrame:
    """(bucket, id, hash, length, numbers, terms): what written_postings has of a document and bucket as one row, made within the document's row, so that far less is shuffled than by a row a term."""
    fields = [(spaced(F.col(f)) if korean is None else _terms(f, stem, korean)).alias(f) for f in FIELDS]
    run = packing.pack(len(FIELDS), stem and korean is None, BUCKETS, BUCKET_LETTERS, OWN)
    return small_batches(documents).select("id", "hash", *fields).mapInArrow(run, "bucket int, id string, hash string, length int, numbers binary, terms string")


def unpacked_postings(rows: DataFrame) -> DataFrame:
    """written_postings' rows of packed_postings', each task's in the order of buckets and terms."""
    each = rows.select("bucket", "id", "hash", "length", "numbers", "terms").mapInArrow(packing.unpack([*FIELDS, ""]), "bucket int, term string, id string, hash string, field string, n int, length int, positions array<int>")
    return each.sortWithinPartitions("bucket", "term").select("term", "id", "hash", "field", "n", "length", "positions", "bucket")


#: What of a row is to be written, as bits: its text, its postings.
TEXT, POSTED = 1, 2
#: Rows up to which marks, two numbers and a state each, are broadcast: about as many bytes as BROADCAST_ROWS rows of names and hashes.
MARKS = 2_000_000


def _key(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.coalesce("collection", F.lit("")), "path", "hash", "active").alias(f"_key{salt}")


def marked(documents: DataFrame, listing: DataFrame, known: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """documents with `_todo`, without those that have nothing to do: TEXT on one row of each hash that `held` has not, POSTED on active rows whose (id, hash) `known` has not. listing, the documents without their texts, decides, so that no text is shuffled to tell; rows are told by 128 bits of a hash of their names, and those whose state isn't the commonest are broadcast. Above MARKS of them the texts meet them by one shuffle."""
    keys = ["_key0", "_key1"]
    rows = listing.select("collection", "path", "hash", "active", _key(0), _key(1))
    texts = rows.groupBy("hash").agg(F.min(F.struct(*keys)).alias("k"))
    if held is not None:
        texts = texts.join(held.select("hash"), "hash", "left_anti")
    posted = rows.filter("active").withColumn("id", T.virtual_path(F.col("collection"), F.col("path")))
    if known is not None:
        posted = posted.join(known.select("id", "hash"), ["id", "hash"], "left_anti")
    each = rows.select(*keys, F.lit(0).alias("_todo")).unionByName(texts.select("k.*", F.lit(TEXT).alias("_todo"))).unionByName(posted.select(*keys, F.lit(POSTED).alias("_todo")))
    states = written(each.groupBy(*keys).agg(F.bit_or("_todo").alias("_todo")), "states")
    counted = {r["_todo"]: r["count"] for r in states.groupBy("_todo").count().collect()}
    common = max(counted, key=counted.get, default=0)
    listed = states.filter(F.col("_todo") != common)
    few = sum(counted.values()) - counted.get(common, 0) <= MARKS
    met = documents.select("*", _key(0), _key(1)).join(F.broadcast(listed) if few else listed.hint("shuffle_merge"), keys, "left")
    todo = met.withColumn("_todo", F.coalesce("_todo", F.lit(common))).drop(*keys).filter("_todo <> 0")
    return todo if few else written(todo, "todo")


def write_snapshot(documents: DataFrame, path: str, known: DataFrame | None = None, held: DataFrame | None = None, korean=None) -> None:
    """Under path: all documents, in the order of their paths; the texts that `held` (hash) has not, in ranges of their hashes; postings of the active documents that `known` (id, hash) has not: stemmed terms, parted by bucket and in order, a bucket in as many files as it needs. A body may be null where both have it. A text is shuffled once, to its range, and only if it is written."""
    names = documents.drop("body")
    names.repartitionByRange("collection", "path").sortWithinPartitions("collection", "path").write.partitionBy("collection").parquet(f"{path}/documents")
    listing = documents.sparkSession.read.schema(names.schema).parquet(f"{path}/documents")
    todo = marked(documents, listing, known, held)
    fresh = todo.filter(F.col("_todo").bitwiseAND(TEXT) != 0).select("hash", "body")
    # ranges hold all rows of a hash: copies meet there without another shuffle
    split_store(fresh.repartitionByRange("hash"))[0].sortWithinPartitions("hash").write.option("compression", "zstd").parquet(f"{path}/content")
    posted = todo.filter(F.col("_todo").bitwiseAND(POSTED) != 0)
    keyed = posted.withColumn("id", T.virtual_path(F.col("collection"), F.col("path"))).withColumn("filepath", F.concat_ws("/", "collection", "path"))
    # rebalanced, not dealt by range: no second pass over the texts for a sample, and a large bucket is split by size
    rows = unpacked_postings(packed_postings(keyed, korean=korean).hint("rebalance", F.col("bucket")))
    rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
