"""Reading files into documents, and writing results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import SCHEME
from siltstone.operators import index
from siltstone.operators.lookup import glob_regex


def scan(spark: SparkSession, root: str, pattern: str = "**/*.md", ignore: list[str] | None = None) -> DataFrame:
    """(path, text, modified_at) of the files under root that the pattern matches, by Spark's own file listing; nothing is opened on the driver."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    last = pattern.rsplit("/", 1)[-1]
    if "**" not in last:  # files of other names are not opened
        reader = reader.option("pathGlobFilter", last)
    # Excluded folders are known by the listing, before any content is read.
    raw = reader.load(root).filter(~F.regexp_replace("_metadata.file_path", f"^(?:[a-z0-9]+:)?/*{_quoted(root.rstrip('/') + '/')}", "").rlike(index.EXCLUDED_FOLDERS))
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), f"^(?:[a-z0-9]+:)?/*{_quoted(base)}", "")
    files = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"))
    wanted = F.col("path").rlike(glob_regex(pattern))
    for p in ignore or []:
        wanted = wanted & ~F.col("path").rlike(glob_regex(p))
    return files.filter(wanted & ~F.col("path").rlike(index.EXCLUDED_FOLDERS))


def _quoted(path: str) -> str:
    import re

    return re.escape(re.sub(r"^(?:[a-z0-9]+:)?/*", "", path))


def reindex(spark: SparkSession, root: str, name: str, previous: DataFrame | None = None, pattern: str = "**/*.md", ignore: list[str] | None = None, source_type: str = "docs") -> tuple[DataFrame, DataFrame]:
    """(next snapshot, counts) of a collection's files against the previous snapshot."""
    current = index.derive(scan(spark, root, pattern, ignore), name, source_type)
    if previous is None:
        previous = current.limit(0)
    own = previous.filter(F.col("collection") == name).select(current.columns)
    states = index.diff(own, current)
    return index.merge(own, current), index.counts(states)


def rebuild(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """One snapshot of several roots, each under its source type."""
    parts = [index.derive(scan(spark, root), kind, kind) for kind, root in roots.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_markdown(rows: DataFrame, path: str) -> None:
    """rows (folder, text) as text files by folder."""
    rows.select("folder", F.col("text").alias("value")).write.mode("append").partitionBy("folder").option("lineSep", "\n").text(path)


def virtual(collection: str, path: str) -> str:
    return f"{SCHEME}://{collection}/{path}"


def parse_binary(files: DataFrame, parser) -> DataFrame:
    """(path, text, error) of files (path, content) by an injected parser of bytes into pages: pages are parted by a blank line, and a file that can't be parsed keeps its error in place of its text."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for raw in b.column(1).to_pylist():
                try:
                    text, error = "\n\n".join(parser(raw)), None
                except Exception as e:
                    text, error = None, f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")
