"""Answers of models, kept: a table that is written through, so that no question is put twice, and trimmed to the newest answers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.durable import written
from siltstone.functions.analyzer import TypedQuery
from siltstone.operators.health import cache_key
from siltstone.sources import fs

SCHEMA = "key string, value string, at timestamp"
#: Answers that trim keeps. Fixed value.
NEWEST = 1000


def key(*parts: Column | str) -> Column:
    """A key of a model's name, a query, a text: equal parts give equal keys, and no others do."""
    named = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.to_json(F.array(*named)), 256)


class Memo:
    """Answers under `path`: each batch of them is a folder of its own, so writers don't disturb each other; of two answers to one question either serves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self) -> list[str]:
        return [n for n in fs.names(self.spark, self.path) if n.startswith("b-") and fs.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]

    def table(self) -> DataFrame:
        """(key, value, at)"""
        parts = [f"{self.path}/{n}" for n in self._folders()]
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def put(self, answers: DataFrame) -> None:
        """Keep answers (key, value)."""
        answers.select("key", "value", F.current_timestamp().alias("at")).write.parquet(f"{self.path}/b-{uuid.uuid4().hex}")

    def through(self, questions: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """questions (key, ...) with value: those without an answer go, each once, to `answer`, which gives (key, value), and what it says is kept before anything is returned."""
        asked = written(questions, "questions")
        todo = asked.dropDuplicates(["key"]).join(self.table().select("key"), "key", "left_anti")
        todo = written(todo, "unanswered")
        if todo.limit(1).count():
            self.put(answer(todo))
        known = self.table().join(asked.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        return asked.join(known.select("key", "value"), "key", "left")

    def one(self, body, name: str, answer: Callable[[], str]) -> str:
        """The answer to a single question."""
        k = cache_key(name, body)
        row = self.table().filter(F.col("key") == k).select("value").first()
        if row is not None:
            return row["value"]
        value = answer()
        self.put(self.spark.createDataFrame([(k, value)], "key string, value string"))
        return value

    def expander(self, expand: Callable[[str], list[TypedQuery]], name: str = "expand") -> Callable[[str], list[TypedQuery]]:
        """expand, asked once a query."""

        def ask(query: str) -> list[TypedQuery]:
            said = self.one({"query": query}, name, lambda: json.dumps([[q.type, q.text, q.line] for q in expand(query)]))
            return [TypedQuery(*x) for x in json.loads(said)]

        return ask

    def trim(self, newest: int = NEWEST) -> int:
        """Keep the newest answers only; how many stay. What others write meanwhile stays too."""
        before = self._folders()
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{n}") for n in before]
        if not parts:
            return 0
        rows = reduce(DataFrame.unionByName, parts)
        last = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), "value"))).filter("r = 1").drop("r")
        kept = last.orderBy(F.desc("at"), "key").limit(newest)
        kept.write.parquet(f"{self.path}/b-{uuid.uuid4().hex}")
        for n in before:
            fs.remove(self.spark, f"{self.path}/{n}")
        return self.table().count()
