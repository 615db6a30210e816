"""Exact vector search: cosine distance in codegen-friendly expressions, best chunk a file, embedding jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.best import Best

#: Chunks taken per wanted result before filters and the choice of a file's best. Fixed value.
OVERFETCH = 3
#: Prompts of the two model families that ask for one. Fixed values.
QUERY_PROMPTS = {"gemma": "task: search result | query: {}", "qwen": "Instruct: Retrieve relevant documents for the given query\nQuery: {}"}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, column: str = "embedding", key: str = "hash_seq") -> DataFrame:
    """The k rows of least distance: a projection and a top-k per partition, no shuffle of vectors. Distances are rounded to 12 places, as nearest_of_many's are, so that what differs by the order of additions only ties."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", F.round(cosine_distance(F.col(column), q), 12)).orderBy("distance", key).limit(k)


#: Bytes of query vectors that every task may hold; rows of a block of vectors and of one of queries where there are more; best rows that a task holds before it sends them on.
QUERY_BYTES, BLOCK, QUERY_BLOCK, HELD = 16 << 20, 4096, 1024, 4 << 20


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of unit length; a zero vector has no direction, and its distance to all is null."""
    m = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(1))[:, None]


def _closest(q: np.ndarray, v: np.ndarray, k: int, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k least distances a query, and of all that equal the last of them; where a most is known for every query, of all up to it. Distances are rounded to 12 places, so that equal vectors tie."""
    d = np.round(1 - q @ v.T, 12)
    d[np.isnan(d)] = np.inf
    if most is not None and np.isfinite(most).all():
        last = most
    else:
        last = np.partition(d, k - 1, 1)[:, k - 1] if v.shape[0] > k else np.full(len(q), np.inf)
    i, j = np.nonzero((d <= last[:, None]) & (d < np.inf))
    return i, j, d[i, j]


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int, column: str = "embedding", key: str = "hash_seq", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(qid, key, distance, rank) of the k nearest rows of each of a table of queries (qid, query); ties go to the lesser key.

    Up to query_bytes of queries go to every task, which keeps each query's k best of all its batches (matrix products), so vectors are read once and never shuffled. Larger sets are cut into blocks by hash that meet blocks of vectors: every block of queries travels to every block of vectors."""
    qid = queries.schema["qid"].dataType.simpleString()
    schema = f"qid {qid}, {key} {vectors.schema[key].dataType.simpleString()}, distance double"
    told = queries.agg(F.count("*").alias("n"), F.max(F.size("query")).alias("dim")).first()
    rows = vectors.filter(F.col(column).isNotNull()).select(key, column)
    if told["n"] * 8 * (told["dim"] or 1) <= query_bytes:
        asked = queries.filter("query is not null").toArrow().combine_chunks()  # under query_bytes
        ids, q = asked["qid"].combine_chunks(), asked["query"].combine_chunks()
        name = f"{key}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, best = _matrix(q), None

            def told(of: Best) -> pa.RecordBatch:
                i, d, keys = of.rows()
                return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), keys, pa.array(d)], ["qid", name, "distance"])

            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    part = b.slice(lo, BLOCK)
                    v = _matrix(part.column(1))
                    for a in range(0, len(unit), QUERY_BLOCK):
                        best = best or Best(len(unit), k, part.schema.field(0).type)
                        i, j, d = _closest(unit[a : a + QUERY_BLOCK], v, k, best.most[a : a + QUERY_BLOCK])
                        best.add(i + a, d, part.column(0), j)
                        if best.n > HELD:
                            yield told(best)
                            best = None
            if best is not None:
                yield told(best)

        found = rows.mapInArrow(run, schema) if len(ids) else rows.sparkSession.createDataFrame([], schema)
    else:
        parts, groups = max(1, -(-rows.count() // BLOCK)), -(-told["n"] // QUERY_BLOCK)
        v = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col(column).alias("v"))).alias("rows"))
        q = queries.filter("query is not null").groupBy(F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("qid", "query")).alias("asked"))
        met = q.select("asked", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("n")).select("asked", F.col("n").cast("long").alias("part"))
        found = met.join(v.hint("shuffle_merge"), "part").select("asked", "rows").mapInArrow(_of_blocks(k, key), schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _of_blocks(k: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                asked, rows = (b.column(c).slice(r, 1).flatten() for c in (0, 1))
                i, j, d = _closest(_matrix(asked.field("query")), _matrix(rows.field("v")), k)
                yield pa.RecordBatch.from_arrays([asked.field("qid").take(pa.array(i)), rows.field("key").take(pa.array(j)), pa.array(d)], ["qid", key, "distance"])

    return run


def search(chunks: DataFrame, documents: DataFrame, query: list[float], limit: int = 10, collection: str | None = None, source_type: str | None = None) -> DataFrame:
    """Files by their best chunk: 3 x limit nearest chunks (hash, seq, pos, embedding) first, then filters, then one row a file with score = 1 - distance."""
    close = F.broadcast(nearest(chunks, query, OVERFETCH * limit).select("hash", "seq", "pos", "hash_seq", "distance"))
    files = documents.filter("active").join(close, "hash")
    if collection is not None:
        files = files.filter(F.col("collection") == collection)
    if source_type is not None:
        files = files.filter(F.col("source_type") == source_type)
    best = files.groupBy("id").agg(F.min_by(F.struct("seq", "pos", "hash"), F.struct("distance", "seq")).alias("best"), F.min("distance").alias("distance"))
    return best.select("id", "best.*", "distance", (1 - F.col("distance")).alias("score")).orderBy("distance", "id").limit(limit)


def search_variants(chunks: DataFrame, documents: DataFrame, queries: list[list[float]], limit: int = 10, least: float = 0.3) -> DataFrame:
    """Files by their best score over several query vectors, down to a least score."""
    rows = [search(chunks, documents, q, limit) for q in queries]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    top = both.groupBy("id").agg(F.max_by(F.struct("seq", "pos", "hash", "distance"), F.struct("score", -F.col("seq"))).alias("best"), F.max("score").alias("score"))
    return top.filter(F.col("score") >= least).select("id", "best.*", "score").orderBy(F.desc("score"), "id").limit(limit)


def pending(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(hash, path): active texts without a first chunk's vector, each once with its least path."""
    done = vectors.filter("seq = 0").select("hash")
    return documents.filter("active").join(done, "hash", "left_anti").groupBy("hash").agg(F.min("path").alias("path"))


def missing(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks (hash, seq, ...) that have no vector of the model: whole documents, and those that lost some of their chunks."""
    done = vectors.filter((F.col("model") == model) & F.col("embedding").isNotNull()).select("hash", "seq")
    return chunks.join(done, ["hash", "seq"], "left_anti")


def prompt(text: Column, title: Column | None = None, family: str = "gemma", query: bool = False) -> Column:
    if query:
        before, after = QUERY_PROMPTS[family].split("{}")
        return F.concat(F.lit(before), text, F.lit(after))
    if family == "gemma":
        return F.concat(F.lit("title: "), F.coalesce(title, F.lit("none")) if title is not None else F.lit("none"), F.lit(" | text: "), text)
    return F.concat_ws("\n", title, text) if title is not None else text


#: Chunks and bytes of text that a call of a model gets at most. Fixed values.
BATCH, BATCH_BYTES = 64, 64 << 20


def cuts(sizes: list[int], most: int = BATCH, most_bytes: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Spans of texts of these sizes with at most `most` texts and most_bytes bytes each; a text over that is alone."""
    out, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == most or held + size > most_bytes):
            out.append((start, i))
            start, held = i, 0
        held += size
    return [*out, (start, len(sizes))] if sizes else out


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], name: str = "default", batch: int = BATCH, batch_bytes: int = BATCH_BYTES, most_errors: float = 0.8) -> DataFrame:
    """(hash, seq, pos, model, embedding, error) of chunks (hash, seq, pos, text) by an injected model, which gets at most `batch` texts and batch_bytes bytes a call. A failed batch is tried text by text; a text that fails keeps its row with an error and no vector. A task with too many failures stops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = done = 0
        for b in batches:
            texts = b.column(3)
            for lo, hi in cuts([len(t.as_py().encode()) if t.is_valid else 0 for t in texts], batch, batch_bytes):
                part, given = b.slice(lo, hi - lo), [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                vectors, errors = [None] * len(given), [None] * len(given)
                try:
                    got = model(given)
                    if len(got) != len(given):
                        raise ValueError(f"{len(got)} vectors for {len(given)} texts")
                    vectors = got
                except Exception:
                    for k, t in enumerate(given):
                        try:
                            (vectors[k],) = model([t])
                        except Exception as e:
                            failed += 1
                            errors[k] = f"{type(e).__name__}: {e}"
                done += len(given)
                if done >= 10 and failed / done > most_errors:
                    raise RuntimeError(f"{failed} of {done} chunks failed")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array([name] * len(given)), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["hash", "seq", "pos", "model", "embedding", "error"])

    return chunks.select("hash", "seq", "pos", "text").mapInArrow(run, "hash string, seq int, pos int, model string, embedding array<float>, error string")


def check_dimension(vectors: DataFrame, size: int) -> None:
    odd = vectors.filter(F.size("embedding") != size).limit(1).collect()
    if odd:
        raise ValueError(f"vectors of another dimension than {size}")
