"""Search results as JSON, CSV, file lists, Markdown and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_field(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike("[\",\n\r]"), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def xml_escape(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(raw), F.lit(coded))
    return s


def as_json(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select("rank", F.to_json(F.struct(*fields)).alias("line"))


def as_csv(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rank 0 is the header."""
    head = rows.sparkSession.createDataFrame([(0, ",".join(fields))], "rank int, line string")
    return head.unionByName(rows.select("rank", F.concat_ws(",", *[csv_field(F.col(f)) for f in fields]).alias("line")))


def as_files(rows: DataFrame) -> DataFrame:
    return rows.select("rank", F.concat_ws(",", F.concat(F.lit("#"), F.col("docid")), F.format_number("score", 2), "file").alias("line"))


def as_markdown(rows: DataFrame) -> DataFrame:
    return rows.select("rank", F.concat(F.lit("---\n# "), F.coalesce("title", "file"), F.lit("\n\n**docid:** `#"), F.col("docid"), F.lit("`\n\n"), F.coalesce("snippet", F.lit("")), F.lit("\n")).alias("line"))


def as_xml(rows: DataFrame) -> DataFrame:
    attr = lambda k: F.concat(F.lit(f' {k}="'), xml_escape(F.col(k)), F.lit('"'))
    return rows.select("rank", F.concat(F.lit("<file"), attr("docid"), attr("file"), attr("title"), F.lit(">\n"), xml_escape(F.col("snippet")), F.lit("\n</file>")).alias("line"))


EMPTY = {"json": "[]", "csv": "", "files": "", "md": "No results found.", "xml": "<results></results>"}
