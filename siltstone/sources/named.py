"""Files with names of their own: notes, source cards, syntheses and drafts as Markdown, one file a row."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.knowledge import draft_names
from siltstone.sources import fs

#: Headings of a source card and of a knowledge note, and a card's line for no excerpts. Fixed values.
EXCERPTS, MEMO, ORIGINAL, SUMMARY, INSIGHTS, SESSION = "핵심 발췌", "메모", "원문 링크", "요약", "인사이트", "세션"
NO_EXCERPTS, ANALYSIS = "_(none)_", "<!-- analysis lives in synthesis notes -->"
#: The key that says whether notes of this kind are indexed.
INDEXED = "indexed"


def files_under(spark: SparkSession, root: str) -> DataFrame:
    """(target, text) of the files under root, by their paths from it; none where it isn't there."""
    if not fs.exists(spark, root):
        return spark.createDataFrame([], "target string, text string")
    at = root.rstrip("/").split("://")[-1].split(":", 1)[-1].lstrip("/")
    path = F.url_decode(F.col("_metadata.file_path"))
    target = F.regexp_extract(path, rf"^(?:[a-z0-9]+:)?/*(?:\Q{at}\E)/(.*)$", 1)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(target.alias("target"), F.decode("content", "UTF-8").alias("text"))
    return rows.filter("target <> ''")


def write(rows: DataFrame, root: str) -> int:
    """Write rows (target, text) as one file each under root, by their paths from it; how many were written. A text ends in one newline. Files that say the same already stay as they are.

    Executors write the texts beside; the driver then only renames, so that a reader sees a whole file or none. Two rows of one target are an error."""
    spark = rows.sparkSession
    given = rows.select("target", F.regexp_replace("text", r"\n+$", "").alias("text"))
    if given.groupBy("target").count().filter("count > 1").limit(1).count():
        raise ValueError("two rows go to one file")
    there = files_under(spark, root).select("target", F.sha2(F.regexp_replace("text", r"\n+$", ""), 256).alias("sha"))
    fresh = given.withColumn("sha", F.sha2("text", 256)).join(there, ["target", "sha"], "left_anti")
    beside = f"{root.rstrip('/')}/_{uuid.uuid4().hex}"
    # a row goes to a folder of its target's name, escaped; lines end as the text has them
    fresh.select(F.col("text").alias("value"), F.base64(F.encode("target", "UTF-8")).alias("name")).write.partitionBy("name").text(beside)
    moves = []
    for folder in fs.names(spark, beside):
        if folder.startswith("name="):
            (part,) = [n for n in fs.names(spark, f"{beside}/{folder}") if n.startswith("part-")]
            moves.append((f"{beside}/{folder}/{part}", f"{root.rstrip('/')}/{_decoded(unquote(folder[5:]))}"))
    fs.move_all(spark, moves)
    fs.remove(spark, beside)
    return len(moves)


def _decoded(name: str) -> str:
    import base64

    return base64.b64decode(name).decode()


def scalar(value: Column) -> Column:
    """A value of front matter: plain where that reads back as the same text, in quotes otherwise, null for none."""
    text = value.cast("string")
    plain = text.rlike(r"^[\p{L}_/][\p{L}\p{N} _./()+-]*$") & ~text.rlike(r"(?i)^(?:null|true|false|yes|no|on|off|~)$") & ~text.rlike(r"\s$")
    quoted = F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)
    return F.when(text.isNull(), "null").when(plain, text).otherwise(quoted)


def listed(values: Column) -> Column:
    items = F.array_join(F.transform(values, lambda v: F.concat(F.lit("\n  - "), scalar(v))), "")
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, items).otherwise(" []")


def front(**fields: Column) -> Column:
    """A block of front matter; arrays are given as (column,)."""
    lines = [F.concat(F.lit(f"{k}:"), listed(v[0])) if isinstance(v, tuple) else F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def cards(pages: DataFrame) -> DataFrame:
    """(target, text) of source cards (topic_id, source_id, url, title, author, published, fetched, language, tags, body_hash, tldr, excerpts)."""
    of = {c: scalar(F.col(c)) for c in ("url", "title", "author", "published", "fetched", "language", "body_hash")}
    head = front(type="research-card", topic=scalar(F.col("topic_id")), source_id=scalar(F.col("source_id")), **{c: of[c] for c in ("url", "title", "author", "published", "fetched", "language")}, tags=(F.col("tags"),), body_hash=of["body_hash"], **{INDEXED: "true"})
    bullets = F.array_join(F.transform("tldr", lambda b: F.concat(F.lit("- "), b)), "\n")
    quotes = F.when(F.size("excerpts") > 0, F.array_join(F.transform("excerpts", lambda q: F.concat(F.lit("> "), F.replace(q, F.lit("\n"), F.lit(" ")))), "\n\n")).otherwise(NO_EXCERPTS)
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n## TL;DR\n\n"), bullets, F.lit(f"\n\n## {EXCERPTS}\n\n"), quotes, F.lit(f"\n\n## {MEMO}\n\n{ANALYSIS}\n\n[{ORIGINAL}]("), F.col("url"), F.lit(")"))
    return pages.select(F.concat(F.lit("research/notes/"), "topic_id", F.lit("/sources/"), "source_id", F.lit(".md")).alias("target"), F.concat(head, body).alias("text"))


def card_front(text: Column) -> Column:
    """body_hash of a card, or null where it has no front matter."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    return F.nullif(F.regexp_replace(F.regexp_extract(block, r"(?m)^body_hash:\s*(\S+)", 1), '"', ""), F.lit(""))


def syntheses(notes: DataFrame) -> DataFrame:
    """(target, text) of synthesis notes (topic_id, subtopic, generated_at, model, source_cards, body_md)."""
    head = front(type="research-synthesis", topic=scalar(F.col("topic_id")), subtopic=scalar(F.col("subtopic")), generated_at=scalar(F.col("generated_at")), model=scalar(F.col("model")), source_cards=(F.col("source_cards"),), **{INDEXED: "true"})
    return notes.select(F.concat(F.lit("research/notes/"), "topic_id", F.lit("/"), "subtopic", F.lit(".md")).alias("target"), F.concat(head, "body_md").alias("text"))


def drafts(rows: DataFrame, root: str, order: str = "generated_at") -> DataFrame:
    """(target, text) of drafts (topic_id, slug, day, prompt, generated_at, model, context_sources, include_vault, body_md; order tells them apart), named by day and slug with a number where the name is taken. A draft that is there already, whatever its number, keeps its name."""
    spark = rows.sparkSession
    head = front(type="research-draft", topic=scalar(F.col("topic_id")), slug=scalar(F.col("slug")), prompt=scalar(F.col("prompt")), generated_at=scalar(F.col("generated_at")), model=scalar(F.col("model")), context_sources=(F.col("context_sources"),), include_vault=F.col("include_vault").cast("string"), **{INDEXED: "false"})
    new = rows.select(F.concat(F.lit("research/drafts/"), "topic_id").alias("folder"), F.concat_ws("-", "day", "slug").alias("stem"), order, F.concat(head, "body_md").alias("text"))
    there = files_under(spark, root).select(F.regexp_extract("target", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("target", r"([^/]*)$", 1).alias("file_name"), F.sha2(F.regexp_replace("text", r"\n+$", ""), 256).alias("sha"))
    sha = F.sha2(F.regexp_replace("text", r"\n+$", ""), 256)
    fresh = new.withColumn("sha", sha).join(there.select("folder", "sha"), ["folder", "sha"], "left_anti").drop("sha")
    named = draft_names(fresh, there, order)
    return named.select(F.concat_ws("/", "folder", "file_name").alias("target"), "text")


def knowledge(notes: DataFrame, root: str, today: str) -> DataFrame:
    """(target, text) of knowledge notes (folder, file_name, title, project, tags, summary, source, insights array<struct<date, session, content>>), several of one file in the order of their sources: the first makes the file, each further one adds its source and its insights; what a source has added is not added again."""
    line = lambda i: F.concat(F.lit("- **"), i["date"], F.lit(f"** ({SESSION} "), i["session"], F.lit("): "), i["content"])
    target = F.concat(F.lit("knowledge/"), "folder", F.lit("/"), "file_name")
    rows = notes.withColumn("target", target).withColumn("said", F.array_join(F.transform("insights", line), "\n"))
    one = rows.dropDuplicates(["target", "source"])
    there = files_under(notes.sparkSession, root).withColumnRenamed("text", "old")
    got = one.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("source", "said", "title", "project", "tags", "summary"))).alias("all")).join(there, "target", "left")
    fresh = F.filter("all", lambda n: ~F.contains(F.coalesce("old", F.lit("")), F.concat(F.lit("- "), n["source"])))
    got = got.withColumn("new", fresh).filter(F.size("new") > 0)
    n = F.get("new", F.lit(0))
    head = front(title=n["title"], project=n["project"], tags=F.concat(F.lit("["), F.array_join(n["tags"], ", "), F.lit("]")), created=today, updated=today, sources=(F.array(n["source"]),))
    created = F.concat(F.regexp_replace(head, r"(?m)^  - \"(.*)\"$", "  - $1"), F.lit(f"## {SUMMARY}\n"), n["summary"], F.lit(f"\n\n## {INSIGHTS}\n"), n["said"], F.lit("\n"))
    base = F.coalesce("old", created)
    rest = F.when(F.col("old").isNull(), F.slice("new", 2, 1 << 20)).otherwise(F.col("new"))

    def add(text: Column, x: Column) -> Column:
        dated = F.regexp_replace(text, r"(?m)^(updated:\s*).+$", F.lit(f"updated: {today}"))
        end = F.locate("\n---\n", dated)
        with_source = F.concat(F.substr(dated, F.lit(1), end), F.lit("  - "), x["source"], F.substr(dated, end))
        return F.concat(F.regexp_replace(with_source, r"\s+$", ""), F.lit("\n"), x["said"], F.lit("\n"))

    return got.select("target", F.aggregate(rest, base, add).alias("text"))
