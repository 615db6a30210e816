"""Finding documents by id, path, pattern or a misspelt name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.paths import within

#: Largest edit distance and results of suggestions. Fixed values.
DISTANCE, LOOKUP_DISTANCE, SUGGESTIONS = 3, 5, 5
MULTI_BYTES = 10 * 1024


def glob_regex(pattern: str) -> str:
    """A path pattern (*, **, ?, {a,b}, [..]) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(p)[1:-1] for p in pattern[i + 1 : end].split(",")) + ")", end + 1
        elif c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def match_glob(documents: DataFrame, pattern: str) -> DataFrame:
    """Active documents whose virtual path, path or collection/path the pattern matches."""
    r = glob_regex(pattern)
    names = (T.virtual_path(F.col("collection"), F.col("path")), F.col("path"), F.concat_ws("/", "collection", "path"))
    return documents.filter(F.col("active") & (names[0].rlike(r) | names[1].rlike(r) | names[2].rlike(r)))


def by_docid(documents: DataFrame, name: str) -> DataFrame:
    """The first active document whose hash starts with the id."""
    bare = re.sub(r"^[\"']?#?|[\"']$", "", name.strip()).lower()
    return documents.filter(F.col("active") & F.lower("hash").startswith(bare)).orderBy("collection", "path").limit(1)


def like_suffix(column: Column, suffix: str) -> Column:
    return F.lower(column).endswith(suffix.lower())


def find(documents: DataFrame, name: str) -> DataFrame:
    """At most one active document with `line`: by id, exact virtual path, path suffix, or path within a collection, whichever comes first. One pass, the least priority wins."""
    bare, line = (name, None) if not (m := re.search(r":(\d+)$", name)) else (name[: m.start()], int(m[1]))
    bare = bare.strip()
    short = re.sub(r"^[\"']?#?|[\"']$", "", bare).lower()
    virtual = re.sub(r"^/+", "", bare.split(":", 1)[1]) if bare.startswith(f"{T.SCHEME}:") else bare
    uri = F.concat_ws("/", "collection", "path")
    is_id = re.fullmatch(r"[0-9a-f]{6,}", short) is not None
    rank = F.when(F.lower("hash").startswith(short) if is_id else F.lit(False), 0)
    rank = rank.when(uri == virtual, 1).when(like_suffix(uri, virtual), 2).when(F.col("path") == bare, 3)
    got = documents.filter("active").withColumn("priority", rank).filter(F.col("priority").isNotNull())
    return got.orderBy("priority", "collection", "path").limit(1).withColumn("line", F.lit(line).cast("int"))


def similar(documents: DataFrame, name: str, most: int = DISTANCE, limit: int = SUGGESTIONS) -> DataFrame:
    """Paths within an edit distance, regardless of case, nearest first."""
    d = F.levenshtein(F.lower("path"), F.lit(name.lower()), most)
    return documents.filter("active").select("path", d.alias("distance")).filter("distance >= 0").distinct().orderBy("distance", "path").limit(limit)


def find_many(documents: DataFrame, pattern: str, most_bytes: int = MULTI_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents with body, or skipped with a reason; names that match nothing) of a comma list of names or one glob."""
    names = [p.strip() for p in pattern.split(",") if p.strip()]
    if "," in pattern and not re.search(r"[*?{\[]", pattern):
        wanted = documents.sparkSession.createDataFrame([(n, re.sub(rf"^{T.SCHEME}:/*", "", n)) for n in names], "name string, bare string")
        uri = F.concat_ws("/", "collection", "path")
        # few names against all documents: exact before suffix, a document a name
        hits = documents.filter("active").join(F.broadcast(wanted), F.lower(uri).endswith(F.lower(F.col("bare"))))
        found = hits.groupBy("name").agg(F.min_by(F.struct("collection", "path", "hash", "title", "body"), F.struct((uri != F.col("bare")).cast("int"), uri)).alias("d")).select("name", "d.*")
        missing = wanted.join(found, "name", "left_anti").select("name")
    else:
        found = match_glob(documents, pattern).select(F.lit(pattern).alias("name"), "collection", "path", "hash", "title", "body")
        missing = documents.sparkSession.createDataFrame([(pattern,)], "name string").join(found.select("name").limit(1), "name", "left_anti")
    size = F.octet_length("body")
    reason = F.when(size > most_bytes, F.format_string("too large (%d KB)", F.round(size / 1024).cast("int")))
    return found.select("name", "collection", "path", "hash", "title", F.when(reason.isNull(), F.col("body")).alias("body"), reason.alias("skipped")), missing


def list_files(documents: DataFrame, collection: str, prefix: str = "") -> DataFrame:
    return documents.filter(F.col("active") & (F.col("collection") == collection) & F.col("path").startswith(prefix)).select("collection", "path", "title", "docid").orderBy("path")


def default_collections(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Names searched unless others are asked for: those marked so, and those that only documents know."""
    known = documents.select(F.col("collection").alias("name")).distinct().join(collections.select("name"), "name", "left_anti")
    return collections.filter(F.coalesce("include_by_default", F.lit(True))).select("name").unionByName(known)


def find_for_command(documents: DataFrame, name: str, roots: dict[str, str] | None = None) -> DataFrame:
    """find's second table of priorities, for names as they are typed: by id; a virtual path exactly, then by its end within the collection; collection/path likewise, if there is such a collection; a file's path under the longest of the collections' roots; at last any path's end."""
    bare, line = (name, None) if not (m := re.search(r":(\d+)$", name)) else (name[: m.start()], int(m[1]))
    short = re.sub(r"^[\"']?#?|[\"']$", "", bare).lower()
    active = documents.filter("active")
    rank = F.when(F.lower("hash").startswith(short), 0) if re.fullmatch("[0-9a-f]{6,}", short) else F.when(F.lit(False), 0)
    is_virtual = bare.startswith(f"{T.SCHEME}:")
    rest = re.sub("^/+", "", bare.split(":", 1)[1]) if is_virtual else bare
    collection, _, path = rest.partition("/")
    if path and not bare.startswith(("/", "~")):
        own = F.col("collection") == collection
        rank = rank.when(own & (F.col("path") == path), 1).when(own & like_suffix(F.col("path"), path), 2)
    if not is_virtual:
        under = max(((len(r), c, p) for c, r in (roots or {}).items() if (p := within(bare, r))), default=None)
        if under is not None:
            rank = rank.when((F.col("collection") == under[1]) & (F.col("path") == under[2]), 3)
        rank = rank.when(like_suffix(F.col("path"), bare.rsplit("/", 1)[-1]), 4)
    got = active.withColumn("priority", rank).filter(F.col("priority").isNotNull())
    return got.orderBy("priority", "collection", "path").limit(1).withColumn("line", F.lit(line).cast("int"))
