"""Agent session logs as sessions of messages: two line formats, told apart by their first line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "type string, text string, name string, input string, content string, tool_use_id string"
CHAT = f"type string, timestamp string, message struct<role string, content string>, toolUseResult string"  # noqa: F541
EVENT = "timestamp string, type string, payload string"
PAYLOAD = f"type string, id string, cwd string, role string, content array<struct<{BLOCK.replace(' string', ': string')}>>, name string, arguments string, output string, call_id string, command array<string>, stdout string, stderr string, exit_code int"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value) of every log under path, lines numbered within their file; each file is one row at first, as its order is its meaning."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines_of(whole)


def lines_of(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("n", "value")).filter(F.trim("value") != "")


def formats(lines: DataFrame) -> DataFrame:
    """(file, format): event logs open with a session_meta line."""
    first = lines.groupBy("file").agg(F.min_by("value", "n").alias("first"))
    return first.select("file", F.when(F.get_json_object("first", "$.type") == "session_meta", "event").otherwise("chat").alias("format"))


def details(summary: Column, body: Column) -> Column:
    return F.concat(F.lit("<details>\n<summary>"), summary, F.lit("</summary>\n\n"), F.coalesce(body, F.lit("")), F.lit("\n</details>"))


def _message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _none() -> Column:
    return F.array().cast("array<struct<role:string,content:string>>")


def chat_messages(lines: DataFrame) -> DataFrame:
    """(file, n, k, timestamp, role, content) of chat logs: a result of a tool is a tool's message, an answer's tool calls come before its text, and lines that don't parse go."""
    e = lines.select("file", "n", F.from_json("value", CHAT).alias("e")).filter(F.col("e.type").isNotNull())
    blocks = F.from_json("e.message.content", f"array<struct<{BLOCK.replace(' string', ': string')}>>")
    listed = F.col("e.message.content").startswith("[")
    e = e.select("file", "n", F.col("e.type").alias("type"), F.col("e.timestamp").alias("timestamp"), F.col("e.message.content").alias("raw"), F.col("e.toolUseResult").alias("result"), F.when(listed, F.coalesce(blocks, F.array().cast(f"array<struct<{BLOCK.replace(' string', ': string')}>>"))).otherwise(F.array(F.struct(F.lit("text").alias("type"), F.col("e.message.content").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("name", "input", "content", "tool_use_id")]))).alias("blocks"))
    of = lambda kind: F.filter("blocks", lambda b: b["type"] == kind)
    text = F.trim(F.array_join(F.transform(F.filter(of("text"), lambda b: b["text"].isNotNull()), lambda b: b["text"]), ""))
    results, uses = of("tool_result"), of("tool_use")
    is_result = F.col("result").isNotNull() | (F.size(results) > 0)
    user = F.when(is_result, F.array(_message("tool", F.array_join(F.transform(results, lambda b: details(F.concat(F.lit("result:"), F.coalesce(b["tool_use_id"], F.lit("unknown"))), b["content"])), "\n")))).when(text != "", F.array(_message("user", text))).otherwise(_none())
    answer = F.concat(F.transform(uses, lambda b: _message("tool", details(F.coalesce(b["name"], F.lit("unknown")), b["input"]))), F.when(text != "", F.array(_message("assistant", text))).otherwise(_none()))
    said = F.when(F.col("type") == "user", user).when(F.col("type") == "assistant", answer).otherwise(_none())
    return e.select("file", "n", "timestamp", F.posexplode_outer(said).alias("k", "m")).select("file", "n", "k", "timestamp", "m.role", "m.content")


def event_messages(lines: DataFrame) -> DataFrame:
    """As chat_messages, for event logs, with (session, cwd) where a line names them; reasoning, developer and system messages go."""
    e = lines.select("file", "n", F.from_json("value", EVENT).alias("e")).filter(F.col("e.type").isNotNull()).select("file", "n", "e.type", "e.timestamp", F.from_json("e.payload", PAYLOAD).alias("p"))
    kind = F.col("p.type")
    text = F.trim(F.array_join(F.transform(F.filter("p.content", lambda b: b["type"].isin("output_text", "input_text") & (b["text"] != "")), lambda b: b["text"]), "\n"))
    output = F.trim(F.array_join(F.filter(F.array(F.coalesce("p.stdout", F.lit("")), F.coalesce("p.stderr", F.lit(""))), lambda x: x != ""), "\n"))
    ran = details(F.concat(F.lit("exec_command: "), F.coalesce(F.array_join("p.command", " "), F.lit("unknown command"))), F.concat(output, F.lit("\nexit_code: "), F.coalesce(F.col("p.exit_code").cast("string"), F.lit("unknown"))))
    item = F.when(kind == "function_call", _message("tool", details(F.coalesce("p.name", F.lit("unknown")), F.col("p.arguments")))).when(kind == "function_call_output", _message("tool", details(F.concat(F.lit("result:"), F.coalesce("p.call_id", F.lit("unknown"))), F.col("p.output")))).when((kind == "message") & F.col("p.role").isin("user", "assistant") & (text != ""), _message(F.col("p.role"), text))
    said = F.when(F.col("type") == "response_item", item).when((F.col("type") == "event_msg") & (kind == "exec_command_end"), _message("tool", ran))
    meta = F.col("type") == "session_meta"
    return e.select("file", "n", F.lit(0).alias("k"), "timestamp", said.alias("m"), F.when(meta, F.col("p.id")).alias("session"), F.when(meta, F.col("p.cwd")).alias("cwd")).select("file", "n", "k", "timestamp", "m.role", "m.content", "session", "cwd")


def sessions(messages: DataFrame, version: str = "1.0") -> DataFrame:
    """(session_id, project, start_time, end_time, parser_version, messages) of each file."""
    parts = F.split("file", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
    folder = F.get(parts, F.size(parts) - 2)
    has_meta = "session" in messages.columns
    turn = F.struct("n", "k", "role", "content", "timestamp")
    got = messages.groupBy("file").agg(
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.sort_array(F.collect_list(F.when(F.col("role").isNotNull(), turn))).alias("turns"),
        (F.max("session") if has_meta else F.max(F.lit(None).cast("string"))).alias("session"),
        (F.max("cwd") if has_meta else F.max(F.lit(None).cast("string"))).alias("cwd"),
    )
    base = F.nullif(F.element_at(F.split("cwd", "/"), -1), F.lit(""))
    return got.select("file", F.coalesce("session", stem).alias("session_id"), F.coalesce(base, folder).alias("project"), "start_time", "end_time", F.lit(version).alias("parser_version"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), t["timestamp"].alias("timestamp"))).alias("messages"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of all logs under path, each by its own format."""
    lines = read_lines(spark, path)
    kinds = formats(lines)
    of = lambda k: lines.join(kinds.filter(F.col("format") == k), "file", "left_semi")
    return sessions(chat_messages(of("chat"))).unionByName(sessions(event_messages(of("event"))))


def to_markdown(rows: DataFrame) -> DataFrame:
    """sessions with markdown: five front matter keys, and a heading by role before each message."""
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), F.col(k)) for k in ("session_id", "project", "start_time", "end_time")], F.concat(F.lit('parser_version: "'), F.col("parser_version"), F.lit('"')), F.lit("---"))
    name = lambda r: F.when(r == "user", "### User").when(r == "assistant", "### Assistant").otherwise("### Tool")
    turns = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("\n\n"), name(m["role"]), F.lit("\n"), m["content"])), "")
    return rows.withColumn("markdown", F.concat(head, turns, F.lit("\n")))


def third_format(*_args) -> DataFrame:
    raise NotImplementedError("the third session format is not supported")
