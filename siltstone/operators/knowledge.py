"""From session texts to knowledge notes: preparation, budget, injected extraction, merging, and where notes go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.durable import sums_before, written
from siltstone.functions.text import slug, token_estimate

NOTE = "struct<title:string,summary:string,keyInsights:array<string>,tags:array<string>,relatedTopics:array<string>>"


def strip_tools(markdown: Column) -> Column:
    """Tool blocks become one line with their name."""
    return F.regexp_replace(markdown, r"(?s)<details>\s*\n\s*<summary>\s*(.*?)\s*</summary>.*?</details>", "[Tool call: $1]")


def halves(text: Column) -> Column:
    """The turns of a text in two halves, the first with the odd one; the text itself if there is only one turn."""
    turns = F.filter(F.split(text, r"(?m)(?=^### (?:User|Assistant))"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")) != "")
    mid = F.ceil(F.size(turns) / 2).cast("int")
    two = F.array(F.array_join(F.slice(turns, 1, mid), ""), F.array_join(F.slice(turns, mid + 1, F.size(turns)), ""))
    return F.when(F.size(turns) <= 1, F.array(text)).otherwise(two)


def prepare(sessions: DataFrame, most_tokens: int = 100_000) -> DataFrame:
    """(session_id, part, text) of sessions' markdown, halved where it is over most_tokens."""
    clean = sessions.select("session_id", strip_tools(F.col("markdown")).alias("text"))
    return clean.select("session_id", F.posexplode(F.when(token_estimate(F.col("text")) <= most_tokens, F.array("text")).otherwise(halves(F.col("text")))).alias("part", "text"))


def parse_note(answer: Column) -> Column:
    """A model's JSON answer, in a code fence or bare, as a note; null if it isn't an object."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    note = F.from_json(F.when(fenced != "", fenced).otherwise(answer), NOTE)
    return F.when(F.get_json_object(F.when(fenced != "", fenced).otherwise(answer), "$").startswith("{"), note)


def merge_notes(notes: DataFrame) -> DataFrame:
    """One note a session: the first part's title, all summaries, lists united in order."""
    got = notes.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("part", "note"))).alias("p"))
    parts = F.transform("p", lambda x: x["note"])
    listed = lambda f: F.array_distinct(F.flatten(F.transform(parts, lambda n: F.coalesce(n[f], F.array().cast("array<string>")))))
    return got.select("session_id", F.get(parts, F.lit(0))["title"].alias("title"), F.array_join(F.transform(parts, lambda n: n["summary"]), " ").alias("summary"), *[listed(f).alias(f) for f in ("keyInsights", "tags", "relatedTopics")])


def extract(parts: DataFrame, model: Callable[[str], str], tries: int = 3) -> DataFrame:
    """parts with the note that an injected model makes of each; failures keep a null note and their error."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for text in b.column(2).to_pylist():
                answer, error = None, None
                for _ in range(tries):
                    try:
                        answer, error = model(text), None
                        break
                    except Exception as e:
                        error = str(e)
                out.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["session_id", "part", "answer", "error"])

    got = parts.select("session_id", "part", "text").mapInArrow(run, "session_id string, part int, answer string, error string")
    return got.select("session_id", "part", parse_note(F.col("answer")).alias("note"), "error")


def within_budget(rows: DataFrame, cost: str, order: list[str], most: float, group: list[str] | None = None) -> DataFrame:
    """Rows in order as long as what was spent before them is under the budget: over all of them, or in each group, whose rows then meet in a task."""
    if not group:
        return sums_before(rows, order, _spent=F.col(cost)).filter(F.col("_spent") < most).drop("_spent")
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_spent", F.coalesce(F.sum(cost).over(w), F.lit(0))).filter(F.col("_spent") < most).drop("_spent")


def unprocessed(sessions: DataFrame, state: DataFrame) -> DataFrame:
    return sessions.join(state.filter("status = 'processed'").select("session_id"), "session_id", "left_anti")


def retry_queue(sessions: DataFrame, failed: DataFrame, most_tries: int = 3) -> DataFrame:
    """Sessions that are new or failed fewer than most_tries times, each once."""
    given_up = failed.groupBy("session_id").agg(F.count("*").alias("tries")).filter(F.col("tries") >= most_tries)
    return sessions.join(given_up.select("session_id"), "session_id", "left_anti").dropDuplicates(["session_id"])


def placed(notes: DataFrame) -> DataFrame:
    """notes with the folder and file they go to."""
    return notes.withColumn("folder", F.coalesce(F.nullif(F.col("project"), F.lit("")), F.lit("general"))).withColumn("file_name", F.concat(slug(F.col("title")), F.lit(".md")))


def note_markdown(notes: DataFrame) -> DataFrame:
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.concat(F.lit("---\ntitle: "), F.col("title"), F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n\n"), F.col("summary"), F.when(F.size("keyInsights") > 0, F.concat(F.lit("\n\n## Key insights\n\n"), bullets("keyInsights"))).otherwise(""), F.when(F.size("relatedTopics") > 0, F.concat(F.lit("\n\n## Related topics\n\n"), bullets("relatedTopics"))).otherwise(""), F.lit("\n"))
    return notes.withColumn("markdown", text)


def draft_names(drafts: DataFrame, taken: DataFrame, order: str = "created") -> DataFrame:
    """drafts (folder, stem, order; order tells them apart) with file_name: in order, each gets its stem, or the stem with the least number from 2 that no file there (folder, file_name) and no draft before it has.

    The k-th draft of a stem starts at the k-th number that no file has. Names of different stems can still meet (`a` with a number, and `a-2`): of those the first draft keeps the name, the others and the drafts of their stems behind them move on, until no two meet. A stem's drafts are numbered in one task."""
    number = lambda c, stem: F.when(c == F.concat(stem, F.lit(".md")), F.lit(1)).otherwise(F.regexp_extract(c, r"-(\d+)\.md$", 1).try_cast("int"))
    stems = drafts.select("folder", "stem").distinct()
    # A file counts for the stem that it is, and for the one that it is a number of; `a-1` and `a-02` are numbers of nothing.
    bare = taken.select("folder", "file_name").distinct().withColumn("whole", F.regexp_replace("file_name", r"\.md$", "")).withColumn("cut", F.regexp_extract("file_name", r"^(.*)-(?:[2-9]|[1-9]\d+)\.md$", 1))
    each = bare.select("folder", "file_name", F.explode(F.array_distinct(F.array("whole", "cut"))).alias("stem")).join(stems, ["folder", "stem"])
    held = each.select("folder", "stem", number(F.col("file_name"), F.col("stem")).alias("n")).groupBy("folder", "stem").agg(F.sort_array(F.collect_set("n")).alias("held"))
    of_stem = Window.partitionBy("folder", "stem").orderBy(order)
    k = F.row_number().over(of_stem)
    gaps = F.transform(F.coalesce("held", F.array().cast("array<int>")), lambda n, i: n - i - 1)
    rows = drafts.join(held, ["folder", "stem"], "left").withColumn("_k", k)
    rows = written(rows.withColumn("_n", F.col("_k") + F.size(F.filter(gaps, lambda g: g < F.col("_k")))), "drafts")
    name = F.concat("stem", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n"))).otherwise(""), F.lit(".md"))
    while True:
        named = rows.withColumn("file_name", name)
        first = named.groupBy("folder", "file_name").agg(F.min(order).alias("_first"), F.count("*").alias("_many")).filter("_many > 1").drop("_many")
        if not first.limit(1).count():
            return named.drop("_k", "_n", "held")
        moved = named.join(first, ["folder", "file_name"], "left").withColumn("_n", F.col("_n") + (F.coalesce("_first", F.col(order)) != F.col(order)).cast("int"))
        # past the numbers that files have, and behind the stem's drafts before
        free = F.aggregate(F.coalesce("held", F.array().cast("array<int>")), F.col("_n"), lambda n, t: F.when(t == n, n + 1).otherwise(n))
        behind = F.max(F.col("_n") - F.col("_k")).over(of_stem.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_k")
        rows = written(moved.withColumn("_n", free).withColumn("_n", behind).withColumn("_n", free).drop("file_name", "_first"), "drafts")
