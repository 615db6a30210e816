"""Tables of what source files define and use, and edges between files: a use is resolved to the file it means by joins on module keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import code


def _of_files(files: DataFrame, read, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1)) for r in read(t.as_py() or "", p or "")]
            cols = list(zip(*rows)) if rows else [[]] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), *types])], ["path", *names])

    return files.select("path", "text").mapInArrow(run, f"path string, {schema}")


def definitions(files: DataFrame) -> DataFrame:
    """(path, name, kind, line) of files (path, text)."""
    return _of_files(files, code.symbols, ["name", "kind", "line"], [pa.string(), pa.string(), pa.int32()], "name string, kind string, line int")


def uses(files: DataFrame) -> DataFrame:
    """(path, kind, source, ref, target, line) of files (path, text): imports, extends, implements, calls of what is imported."""
    s = pa.string()
    return _of_files(files, code.relations, ["kind", "source", "ref", "target", "line"], [s, s, s, s, pa.int32()], "kind string, source string, ref string, target string, line int")


def _kind(path: Column) -> Column:
    ends = F.create_map(*[F.lit(x) for kv in code.LANGUAGES.items() for x in kv])
    return F.element_at(ends, F.lower(F.element_at(F.split(path, r"\."), -1)))


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _normal(path: Column) -> Column:
    """A path without . and .. steps."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.array_join(walked, "/")


def modules(files: DataFrame) -> DataFrame:
    """(module, path, lang): the names by which files are imported: their paths without ends, folders of their index files, and in Go their folders, from any step on."""
    f = files.select("path", _kind(F.col("path")).alias("lang")).filter("lang is not null")
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    whole = F.regexp_replace(bare, r"(^|/)(?:index|__init__|mod)$", "")
    steps = F.split(_folder(F.col("path")), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))
    return f.select(F.explode(F.when(F.col("lang") == "go", ends).otherwise(F.array(whole))).alias("module"), "path", "lang").distinct()


def _wanted(u: DataFrame) -> DataFrame:
    """u with `modules`, what an import may mean, the likeliest first, each with the symbol sought there."""
    ref, folder = F.col("ref"), _folder(F.col("path"))
    pair = lambda m, s: F.struct(m.alias("module"), s.alias("symbol"))
    target = F.col("target")
    bare = F.regexp_replace(F.regexp_replace(_normal(F.concat_ws("/", folder, ref)), r"\.(?:[cm]?[jt]sx?)$", ""), r"(^|/)index$", "")
    script = F.when(ref.startswith("."), F.array(pair(bare, target)))
    dots = F.length(F.regexp_extract(ref, r"^(\.*)", 1))
    up = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0)).cast("int")), "/")
    rest = F.replace(F.regexp_replace(ref, r"^\.+", ""), F.lit("."), F.lit("/"))
    base = _normal(F.concat_ws("/", F.when(dots > 0, F.concat_ws("/", folder, up)), F.nullif(rest, F.lit(""))))
    python = F.array(pair(base, target), pair(_normal(F.concat_ws("/", base, target)), F.lit(None).cast("string")))
    # a symbol of a module, or a module
    steps = F.split(F.regexp_replace(F.regexp_replace(ref, r"^crate(?:::|$)", "src::"), r"^self::", ""), "::")
    inner = F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), "/")
    rust = F.array(pair(inner, target), pair(F.array_join(steps, "/"), F.lit(None).cast("string")))
    # an import names a module of its own first: any folder that the path ends in
    parts = F.split(ref, "/")
    go = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: pair(F.array_join(F.slice(parts, i, F.size(parts)), "/"), F.lit(None).cast("string")))
    lang = F.col("lang")
    return u.withColumn("modules", F.when(lang == "script", script).when(lang == "python", python).when(lang == "rust", rust).when(lang == "go", go))


def edges(files: DataFrame) -> DataFrame:
    """(path, line, ref, target, to_path, defined): the imports of files (path, text) that mean other files of them, by the likeliest reading that names any; defined says whether such a file defines the symbol."""
    u = uses(files).filter("kind = 'imports'").select("path", "line", "ref", "target", _kind(F.col("path")).alias("lang"))
    one = _wanted(u).filter("modules is not null").select("path", "line", "ref", "target", "lang", F.posexplode("modules").alias("n", "m"))
    met = one.select("path", "line", "ref", "target", "lang", "n", "m.module", "m.symbol").join(modules(files).withColumnRenamed("path", "to_path"), ["lang", "module"]).filter("to_path <> path")
    known = definitions(files).select(F.col("path").alias("to_path"), F.col("name").alias("symbol"), F.lit(True).alias("has")).distinct()
    got = met.join(known, ["to_path", "symbol"], "left").withColumn("defined", F.coalesce("has", F.lit(False)))
    # a module that defines what is sought, or is sought itself, comes before one that doesn't
    got = got.withColumn("n", F.col("n") + F.when(F.col("symbol").isNotNull() & ~F.col("defined"), 1000).otherwise(0))
    first = got.groupBy("path", "line", "ref", "target").agg(F.min("n").alias("n"))
    return got.join(first, ["path", "line", "ref", "target", "n"]).select("path", "line", "ref", "target", "to_path", "defined").distinct()
