"""Small files by Spark's own file systems: whatever store Spark reads, these read and write too. For pointers and names, not for data."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, its path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where it isn't there."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet, whole or not at all; False if another writer was first. The text is written beside and moved: by a rename that refuses an existing target where the store has one, by a hard link on a local disk."""
    fs, p = _at(spark, path)
    beside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    write_text(spark, beside, text)
    jvm = spark._jvm
    try:
        if fs.getScheme() == "file":
            local = lambda x: jvm.java.nio.file.Paths.get(fs.makeQualified(x).toUri())
            jvm.java.nio.file.Files.createLink(local(p), local(_at(spark, beside)[1]))
        else:
            kind = jvm.org.apache.hadoop.fs.Options.Rename
            refuse = spark.sparkContext._gateway.new_array(kind, 1)
            refuse[0] = kind.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(_at(spark, beside)[1], p, refuse)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        remove(spark, beside)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move_all(spark: SparkSession, moves: list[tuple[str, str]], threads: int = 16) -> None:
    """Rename files, several at a time; folders of the targets are made, and a file that is there is replaced."""

    def one(pair: tuple[str, str]) -> None:
        fs, a = _at(spark, pair[0])
        b = _at(spark, pair[1])[1]
        fs.mkdirs(b.getParent())
        if fs.exists(b):
            fs.delete(b, False)
        if not fs.rename(a, b):
            raise OSError(f"{pair[0]} could not be renamed to {pair[1]}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, moves))
