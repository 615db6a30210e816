"""Training pairs for query expansion: typed outputs, checks, first-wins deduplication, split, chat export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = "query string, output array<array<string>>, category string, intent string, is_short boolean"
TYPES = ["lex", "vec", "hyde"]


def read_pairs(spark, path: str) -> DataFrame:
    return spark.read.schema(PAIR).json(path).select("*", F.col("_metadata.file_name").alias("file"))


def valid(pairs: DataFrame) -> Column:
    """A query that isn't blank, and typed lines that aren't either."""
    ok = lambda x: (F.size(x) == 2) & F.coalesce(F.get(x, F.lit(0)).isin(TYPES), F.lit(False)) & (F.trim(F.coalesce(F.get(x, F.lit(1)), F.lit(""))) != "")
    return (F.trim(F.coalesce("query", F.lit(""))) != "") & (F.size("output") > 0) & F.forall("output", ok)


def validation_counts(pairs: DataFrame) -> DataFrame:
    v = F.coalesce(valid(pairs), F.lit(False))
    return pairs.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(v).alias("valid"), F.count_if(~v).alias("invalid"))


def parse_lines(text: Column) -> Column:
    """array<struct<type, text>> of prefixed lines; other lines go."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(?:lex|vec|hyde):\s*\S"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\w+):", 1).alias("type"), F.trim(F.regexp_replace(x, r"^\s*\w+:\s*", "")).alias("text")))


def hyde_first(typed: Column) -> Column:
    return F.concat(F.filter(typed, lambda x: x["type"] == "hyde"), F.filter(typed, lambda x: x["type"] != "hyde"))


def render_lines(typed: Column) -> Column:
    return F.array_join(F.transform(typed, lambda x: F.concat(x["type"], F.lit(": "), x["text"])), "\n")


def has_type(typed: Column, kind: str) -> Column:
    return F.exists(typed, lambda x: x["type"] == kind)


def dedup(pairs: DataFrame, order: list[str]) -> DataFrame:
    """The first pair of each query regardless of case."""
    w = Window.partitionBy(F.lower(F.trim("query"))).orderBy(*order)
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def split(pairs: DataFrame, held_out: float = 0.1, seed: int = 42) -> DataFrame:
    """pairs with split train or eval, by a hash of the query: the same on any cluster."""
    part = F.pmod(F.xxhash64(F.lower("query"), F.lit(seed)), F.lit(10_000)) / 10_000
    return pairs.withColumn("split", F.when(part < held_out, "eval").otherwise("train"))


def chat(pairs: DataFrame, prompt: str = "Expand this search query: ") -> DataFrame:
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return pairs.withColumn("messages", F.array(said("user", F.concat(F.lit(prompt), F.col("query"))), said("assistant", render_lines(hyde_first(F.col("typed"))))))


def plain_chat(pairs: DataFrame, template=None) -> DataFrame:
    """chat for models without a thinking mode: the same two messages as one text, by an injected template of (role, content) columns or by role lines."""
    turn = template or (lambda role, content: F.concat(role, F.lit(": "), content))
    asked = chat(pairs)
    return asked.withColumn("text", F.array_join(F.transform("messages", lambda m: turn(m["role"], m["content"])), "\n"))


def clean_output(text: Column) -> Column:
    """A model's text without its thoughts and end marks."""
    return F.trim(F.replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), F.lit("<|im_end|>"), F.lit("")))


def golden(lines: DataFrame) -> DataFrame:
    """(query, typed) of golden lines (value) in either form: a query with typed searches, or a user's and an assistant's message. Lines that are neither, or lack a part, go."""
    one = "query string, searches array<struct<type:string,query:string,value:string>>, messages array<struct<role:string,content:string>>"
    g = lines.select(F.from_json("value", one).alias("g"))
    said = lambda role: F.try_element_at(F.transform(F.filter("g.messages", lambda m: m["role"] == role), lambda m: m["content"]), F.lit(-1))
    typed = F.transform(F.filter("g.searches", lambda s: s["type"].isin(TYPES)), lambda s: F.struct(s["type"].alias("type"), F.coalesce(F.nullif(s["query"], F.lit("")), s["value"], F.lit("")).alias("text")))
    asked = F.trim(F.regexp_replace(said("user"), r"(?s)^.*Expand this search query:", ""))
    is_typed = F.col("g.query").isNotNull() & F.col("g.searches").isNotNull()
    rows = g.select(F.when(is_typed, F.col("g.query")).otherwise(F.when(F.size("g.messages") > 0, asked)).alias("query"), F.when(is_typed, typed).otherwise(F.when(F.size("g.messages") > 0, parse_lines(clean_output(said("assistant"))))).alias("typed"))
    return rows.filter("query <> '' and typed is not null")


#: Points of the simple score, and what a passage shouldn't say. Fixed values.
SIMPLE = {"lex": 1, "vec": 1, "hyde": 2}
GENERIC = ["comprehensive guide", "everything you need to know", "beginners and advanced users"]


def simple_score(text: Column, generic_phrases: list[str] = GENERIC) -> Column:
    """Points for each typed line, more for a passage of a good length, less for one that says nothing but generic phrases."""
    lines = F.transform(F.split(F.trim(text), "\n"), F.trim)
    points = F.lit(0)
    for kind, n in SIMPLE.items():
        points = points + n * F.size(F.filter(lines, _starts(f"{kind}:")))
    passages = F.filter(lines, lambda x: x.startswith("hyde:"))
    passage = F.coalesce(F.trim(F.substr(F.get(passages, F.size(passages) - 1), F.lit(6))), F.lit(""))
    n = F.length(passage)
    generic = F.lit(0)
    for g in generic_phrases:
        generic = generic + F.lower(passage).contains(g).cast("int")
    return points + F.when(n.between(80, 200), 2).when(n.between(50, 250), 1).otherwise(0) - generic


def result_summary(scores: DataFrame, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """(a row a model: n, mean, least, most; the lowest scored queries) of scores (model, query, percentage)."""
    by = scores.groupBy("model").agg(F.count("*").alias("n"), F.avg("percentage").alias("mean"), F.min("percentage").alias("least"), F.max("percentage").alias("most"))
    return by, scores.orderBy("percentage", "model", "query").limit(worst)


def _starts(mark: str):
    return lambda x: x.startswith(mark)
